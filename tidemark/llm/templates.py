"""Main text of web pages, with the templates of their site removed.

Every element subtree that may be furniture gets a hash of its tags, attributes
and text. Spark counts in how many different pages of a host each hash occurs;
subtrees that recur across many of them are the site's template and are deleted.
What a page itself declares to be furniture (menus, footers, forms, scripts,
adverts, reader comments) is deleted as well, and an article or main element
stands for the rest where a page has one. Inside it only containers can be
template, never paragraphs or headings, so a passage that many articles quote
stays.

Pages are parsed twice and never shuffled for it: first for the hashes, then for
the text. Counts are summed before the shuffle, equal pages of a host count
once, and the templates of a host number at most its subtrees per page over the
share, so they join to pages as one short list.

Cases: null, empty and wordless pages give an empty text. Unclosed and stray
tags follow the usual rules of browsers; an unclosed comment, script or style
reaches to the end. A null or hostless url belongs to the host ''. Repeated rows
give repeated results. A br is white space. Only the named columns are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.session import checkpoint

#: A subtree is template if it is on so many pages of its host, and on this share of them.
AT_LEAST = 5
SHARE = 0.2

_TOKEN = re.compile(
    r"""<!--.*?(?:(?P<shut>-->)|\Z)
    |<(?P<raw>script|style|textarea|title|noscript|iframe|xmp|noembed|noframes)\b[^>]*+>.*?(?:(?P<shut2></(?P=raw)\s*+[^>]*+>)|\Z)
    |<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)>
    |<[!?/][^>]*+>""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_PARTS = re.compile(r"[_-]+")
_VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=|/)")

# Elements of the HTML standard by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr br img".split()
)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption address summary".split())
HOLDERS = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
HEAD = frozenset("meta link base title style script noscript template".split())
FURNITURE = frozenset("head nav header footer aside form button select option input dialog menu template svg math canvas object audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Names that pages give to furniture by habit, and what may follow them; no standard fixes these.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice popup modal "
    "newsletter subscribe menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead comment comments disqus reply replies "
    "share sharing social related recommended pagination pager toolbar login signup".split()
)
LAYOUT = frozenset(
    "area bar block body bottom box button buttons column container content count footer form head header icon icons inner item items left link "
    "links list main outer panel primary right row secondary section slot text thread title top unit widget wrap wrapper".split()
)
# End tags that HTML implies, and the elements that hold them back.
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KEEPS = frozenset("ul ol dl table article main section div body html td th".split())


@dataclass
class _Element:
    tag: str
    first: int
    furniture: bool
    parts: list[str] = field(default_factory=list)


@dataclass
class Page:
    """Text blocks in order, whether each is furniture, article or main, and the countable subtrees."""

    blocks: list[str] = field(default_factory=list)
    furniture: list[bool] = field(default_factory=list)
    article: list[bool] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)
    subtrees: list[tuple[int, int, int]] = field(default_factory=list)
    has_article: bool = False
    has_main: bool = False

    def text(self, templates: set[int]) -> str:
        gone = list(self.furniture)
        for digest, first, last in self.subtrees:
            if digest in templates:
                gone[first:last] = [True] * (last - first)
        inside = self.article if self.has_article else self.main if self.has_main else [True] * len(self.blocks)
        return "\n".join(b for b, out, here in zip(self.blocks, gone, inside) if here and not out)


def _named(names: str) -> bool:
    """Whether a class or id names furniture, by its head and nothing but words of layout after it.

    ``has-sidebar`` only speaks of a sidebar, and ``related-work`` is a subject.
    """

    def furniture(name: str) -> bool:
        head, *rest = _PARTS.split(name)
        return head in NAMES and all(part in NAMES or part in LAYOUT or part.isdigit() for part in rest)

    return any(furniture(name) for name in names.split())


def _declared(tag: str, attributes: str, nested: bool = False) -> tuple[bool, str]:
    """Whether an element says that it is furniture, and its role.

    The class and id of elements that hold or head the text say nothing, but for
    those of an article nested in another, as reader comments are.
    """
    role, by_name = "", tag not in HOLDERS or (nested and tag == "article")
    if "=" in attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            value = value.strip("\"'").lower()
            if name == "role":
                role = value
            elif name in ("class", "id") and by_name and _named(value):
                return True, role
            elif name == "aria-hidden" and value == "true":
                return True, role
    # What stands inside quotes is a value, whatever it says.
    return tag in FURNITURE or role in ROLES or ("hidden" in attributes and _HIDDEN.search(_VALUE.sub(" ", attributes)) is not None), role


class _Parser:
    def __init__(self) -> None:
        self.page, self.open, self.text = Page(), [], []
        self.counts: Counter[str] = Counter()
        self.hidden = self.articles = self.mains = 0

    def flush(self) -> None:
        if not self.text:
            return
        text = " ".join(html.unescape("".join(self.text)).split())
        self.text = []
        if text:
            page = self.page
            page.blocks.append(text)
            page.furniture.append(self.hidden > 0)
            page.article.append(self.articles > 0)
            page.main.append(self.mains > 0)
            if self.open:
                self.open[-1][0].parts.append(text)

    def start(self, tag: str, attributes: str) -> None:
        self.flush()
        if tag not in HEAD and self.counts["head"]:
            self.pop_to("head")
        self.close_implied(tag)
        furniture, role = _declared(tag, attributes, self.articles > 0)
        main, article = tag == "main" or role == "main", tag == "article" and not furniture
        element = _Element(tag, len(self.page.blocks), furniture, [tag, attributes.strip()])
        self.open.append((element, article, main))
        self.counts[tag] += 1
        self.hidden += furniture
        self.articles += article
        self.mains += main
        self.page.has_article |= article and not self.hidden
        self.page.has_main |= main and not self.hidden

    def close_implied(self, tag: str) -> None:
        ends = CLOSES_ITSELF.get(tag, ())
        if not any(self.counts[name] for name in ("p", *ends)):
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0].tag
            if name == "p" or name in ends:
                while len(self.open) > i:
                    self.pop()
                if name == "p" and not ends:
                    return
            elif name in _KEEPS and name not in ends:
                return

    def pop_to(self, tag: str) -> None:
        if not self.counts[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0].tag == tag:
                while len(self.open) > i:
                    self.pop()
                return

    def pop(self) -> None:
        self.flush()
        element, article, main = self.open.pop()
        self.counts[element.tag] -= 1
        self.hidden -= element.furniture
        self.articles -= article
        self.mains -= main
        digest = xxhash.xxh3_64_intdigest("\x00".join(element.parts).encode("utf-8", "replace"))
        if self.open:
            self.open[-1][0].parts.append(f"{digest:x}")
        last = len(self.page.blocks)
        holds = element.tag in ("html", "body", "article", "main") or article or main
        inside = self.articles or self.mains
        if last > element.first and not holds and not (inside and element.tag in TEXT_BLOCKS):
            self.page.subtrees.append((digest - (1 << 63), element.first, last))


def parse(source: str | None) -> Page:
    parser, at = _Parser(), 0
    source = source or ""
    # Behind the last ">" no tag can end, so none is looked for; only a comment can begin there.
    end = source.rfind(">") + 1
    for token in _TOKEN.finditer(source, 0, end):
        if token.start() > at:
            parser.text.append(source[at : token.start()])
        at = token.end()
        tag = token["tag"] or token["tag2"]
        if tag is None:
            if (token["raw"] or token[0].startswith("<!--")) and not (token["shut"] or token["shut2"]):
                at = len(source)
            continue
        tag = tag.lower()
        if tag in INLINE or tag == "hr":
            if tag == "br":
                parser.text.append(" ")
            elif tag == "hr":
                parser.flush()
        elif token["end"] or token["end2"]:
            parser.flush()
            parser.pop_to(tag)
        elif tag not in VOID:
            attributes = token["attrs"] if token["tag"] else token["attrs2"]
            parser.start(tag, attributes)
            if attributes.endswith("/") and tag in ("svg", "math"):
                parser.pop()
    if at < len(source):
        parser.text.append(source[at:].partition("<!--")[0])
    parser.flush()
    while parser.open:
        parser.pop()
    return parser.page


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def site_templates(pages: DataFrame, at_least: int = AT_LEAST, share: float = SHARE) -> DataFrame:
    """``host`` and ``templates``, the hashes of subtrees that recur on many of its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted({s[0] for s in parse(t).subtrees}) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["host", "page", "subtrees"])

    source = F.coalesce("html", F.lit(""))
    rows = pages.select(host(F.col("url")).alias("host"), F.xxhash64(source).alias("page"), source.alias("html"))
    parsed = rows.mapInArrow(run, "host string, page long, subtrees array<long>")
    distinct = checkpoint(parsed.groupBy("host", "page").agg(F.first("subtrees").alias("subtrees")))
    sizes = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = distinct.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    often = counts.filter(F.col("n") >= at_least).join(sizes, "host").filter(F.col("n") >= share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("subtree").alias("templates"))


def main_text(pages: DataFrame, at_least: int = AT_LEAST, share: float = SHARE) -> DataFrame:
    """page_id, url and ``text`` of every page."""
    templates = checkpoint(site_templates(pages, at_least, share)).withColumnRenamed("host", "_host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sources, lists = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            texts = [parse(s).text(set(t or ())) for s, t in zip(sources, lists)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("_host"))
    joined = rows.join(templates, "_host", "left").select("page_id", "url", "html", "templates")
    return joined.mapInArrow(run, pages.select("page_id", "url").schema.add("text", "string"))
