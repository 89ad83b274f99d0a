"""Personal data and the terms that give it away, with DataFrame functions alone.

E-mail and IP addresses, card and phone numbers are found by pattern. Such a
value is a protected entity. Terms around it are weighed by what the whole
corpus says: with N documents, the information content of entity e is
-log2 p(e), and term t reveals log2(p(t, e) / (p(t) p(e))) of it. A term that
reveals at least the share ``generalise`` of an entity is replaced by a general
mark in the texts that hold both, and from the share ``remove`` on it is
removed. A pair needs to occur together in ``support`` different texts, so a
rare word beside a single address, or copies of one text, prove nothing.

Most values occur in one text, where nothing has support. So an entity is also
counted on wider levels, and a term that discloses one of them is hidden for all
values of it: the domain and parent domain of an e-mail address, the /24 and /16
network of an IP address, the first eight and six digits of a card, a phone
number but its last four and seven digits, and the kind itself.

Terms are the distinct words of the whole text, any run of letters and digits
outside the base spans, however far from an entity. Document frequencies of
terms are counted over all documents. Pairs are made only of terms and entities
that have support and whose frequencies leave the share within reach: as
p(t, e) is at most p(e) and at most the share of documents that hold t and any
entity, that drops no pair that could be chosen. Joins run on text, pair and
term keys; a table is broadcast only where Spark measures it to be small.

Cases: null and empty texts have no spans. Texts of any length are searched
whole, by patterns that do not backtrack over long runs. Spans of different
kinds may overlap; in rewritten text an overlap is covered once, under the
mark of the span that starts first. Repeated rows get equal results. Columns
are renamed inside, so extra columns cannot clash. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns
from tidemark.session import checkpoint

SUPPORT = 2
GENERALISE = 0.6
REMOVE = 0.9
KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalise", "remove")

# The contract's patterns. A match can only begin where the one before ended or
# where a run of its characters begins, so runs are scanned once.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_ANY = "[@]|[0-9]"
_WORD = r"[\p{L}\p{M}\p{N}]++"
_RUN = 128
_PIECE = 1_024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _before(lengths: Column) -> Column:
    """For each length the sum of those ahead of it, in runs, so that long arrays stay cheap."""
    runs = F.transform(
        F.sequence(F.lit(0), (F.greatest(F.size(lengths) - 1, F.lit(0)) / _RUN).cast("int")),
        lambda b: _sum(F.slice(lengths, b * _RUN + 1, F.lit(_RUN))),
    )

    def place(totals: Column) -> Column:
        starts = F.transform(totals, lambda _, b: _sum(F.slice(totals, F.lit(1), b)))
        return _let(
            starts,
            lambda base: F.transform(
                lengths,
                lambda _, i: F.get(base, (i / _RUN).cast("int"))
                + _sum(F.slice(lengths, (i / _RUN).cast("int") * _RUN + 1, i % _RUN)),
            ),
        )

    return _let(runs, place)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind != "card":
        return F.lit(True)

    def luhn(d: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            digit = F.substring(d, -i, F.lit(1)).cast("int")
            twice = digit * 2 - F.when(digit > 4, F.lit(9)).otherwise(F.lit(0))
            return total + F.when(i % 2 == 0, twice).otherwise(digit)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0

    return _let(digits, lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))


_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _find(text: Column, pattern: str, kind: Column, keep: Callable[[Column], Column], when: Column) -> Column:
    """Matches with code point spans: what lies between them and they themselves add up to the text."""

    def spans(hits: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            lengths = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))
            return _let(
                _let(lengths, _before),
                lambda ahead: F.transform(
                    hits,
                    lambda h, i: F.struct(
                        (F.get(ahead, i) + F.length(F.get(gaps, i))).alias("start"),
                        kind.alias("kind"),
                        (F.get(ahead, i) + F.length(F.get(gaps, i)) + F.length(h)).alias("end"),
                        h.alias("value"),
                    ),
                ),
            )

        return F.filter(_let(F.split(text, pattern, -1), with_gaps), lambda s: keep(s["value"]))

    hits = F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    found = _let(hits, lambda h: F.when(F.size(h) > 0, spans(h)))
    return F.coalesce(found.cast(_SPAN), F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Personal data in ``text`` by start, then kind; ``kind`` indexes :data:`KINDS`."""
    text = F.coalesce(text, F.lit(""))
    signs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    each = [
        _find(text, PATTERNS[k], F.lit(i), lambda v, k=k: _valid(k, v), signs.get(k, text.rlike("[0-9]")))
        for i, k in enumerate(KINDS)
    ]
    return F.array_sort(F.concat(*each))


def shown(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, *TERM_KINDS)])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _levels(span: Column) -> Column:
    """What an entity counts as: its value, two ever wider groups of values, and its kind."""
    kind = span["kind"]

    def named(value: Column) -> Column:
        domain = F.substring_index(value, "@", -1)
        last = F.length(value)
        groups = F.when(kind == 0, F.array(value, domain, F.substring_index(domain, ".", -2)))
        groups = groups.when(kind == 1, F.array(value, F.substring_index(value, ".", 3), F.substring_index(value, ".", 2)))
        groups = groups.when(kind == 2, F.array(value, F.left(value, F.lit(8)), F.left(value, F.lit(6))))
        groups = groups.otherwise(F.array(value, F.left(value, last - 4), F.left(value, last - 7)))
        return F.concat(F.transform(groups, lambda g, i: F.concat_ws(":", kind, i, g)), F.array(kind.cast("string")))

    # One value in any way of writing it.
    plain = F.when(kind == 0, F.lower(span["value"])).when(kind == 1, F.regexp_replace(span["value"], r"\b0+(?=[0-9])", ""))
    levels = _let(plain.otherwise(F.regexp_replace(span["value"], "[^0-9]", "")), named)
    return F.transform(levels, lambda v: F.sha2(v, 256))


def _highest_before(ends: Column) -> Column:
    """For each end the greatest of those ahead of it (0: none), in runs as in :func:`_before`."""
    runs = F.transform(
        F.sequence(F.lit(0), (F.greatest(F.size(ends) - 1, F.lit(0)) / _RUN).cast("int")),
        lambda b: F.array_max(F.slice(ends, b * _RUN + 1, F.lit(_RUN))),
    )

    def place(tops: Column) -> Column:
        starts = F.transform(tops, lambda _, b: F.coalesce(F.array_max(F.slice(tops, F.lit(1), b)), F.lit(0)))
        inside = lambda i: F.array_max(F.slice(ends, (i / _RUN).cast("int") * _RUN + 1, i % _RUN))
        return _let(starts, lambda base: F.transform(ends, lambda _, i: F.greatest(F.get(base, (i / _RUN).cast("int")), inside(i))))

    return _let(runs, place)


def _cover(text: Column, spans: Column, mark: Callable[[Column, Column], Column]) -> Column:
    """``text`` with ``mark(span, at)`` for each span, where ``at`` is the end of what is covered so far.

    Gaps are cut from pieces of the text and joined once, so the work grows with the text and not with text times spans.
    """

    def fill(before: Column, pieces: Column) -> Column:
        def gap(a: Column, b: Column) -> Column:
            first = (a / _PIECE).cast("int")
            near = F.array_join(F.slice(pieces, first + 1, (b / _PIECE).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(near, a % _PIECE + 1, b - a)).otherwise(F.lit(""))

        parts = F.transform(spans, lambda s, i: F.concat(gap(F.get(before, i), s["start"]), mark(s, F.get(before, i))))
        covered = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
        rest = _let(covered, lambda at: gap(at, F.length(text)))
        return F.array_join(F.concat(parts, F.array(rest)), "")

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    ends = _let(F.transform(spans, lambda s: s["end"]), _highest_before)
    return _let(ends, lambda before: _let(pieces, lambda p: fill(before, p)))


def _blank(text: Column, spans: Column) -> Column:
    """``text`` with blanks in place of its spans, so that all else stays where it was."""
    return _cover(text, spans, lambda s, at: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0))))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1)), F.lower))


def disclosing_terms(
    docs: DataFrame,
    found: DataFrame,
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """``key``, ``term``, ``kind``: terms to hide in the texts with that key.

    ``found`` has the key, base spans and terms of every row with any span;
    ``docs.text`` gives the document frequencies.
    """
    entities = F.array_distinct(F.flatten(F.transform("spans", _levels)))
    texts = found.select("key", entities.alias("entities"), "terms").groupBy("key")
    texts = checkpoint(texts.agg(F.count(F.lit(1)).alias("rows"), F.first("entities").alias("entities"), F.first("terms").alias("terms")))
    total = float(max(docs.count(), 2))
    held = texts.select("key", "rows", F.explode("entities").alias("entity"))
    often = held.groupBy("entity").agg(F.sum("rows").alias("n_e"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support).drop("texts")
    words = texts.select("key", "rows", F.explode("terms").alias("term"))
    beside = words.groupBy("term").agg(F.sum("rows").alias("n_h"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support).drop("texts")
    spotted = docs.filter("text IS NOT NULL").select("text", base_spans(F.col("text")).alias("spans"))
    outside = F.when(F.size("spans") > 0, _blank(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    # Counts first: a join of single words would shuffle the corpus.
    frequency = spotted.select(F.explode(_terms(outside)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    # A pair's share is at most what n_te = least(n_e, n_h) gives, and that is largest at n_e = n_h.
    spare = 1.0 - min(generalise, 1.0)
    most = lambda n, n_e: n * F.pow(total / n_e, F.lit(spare)) * (1 + 1e-9)
    known = checkpoint(frequency.join(beside, "term").filter(F.col("n_t") <= most(F.col("n_h"), F.col("n_h"))))
    sides = held.join(often, "entity").join(words.drop("rows").join(known, "term"), "key")
    pairs = checkpoint(sides.filter(F.col("n_t") <= most(F.least("n_e", "n_h"), F.col("n_e"))).drop("n_h"))
    together = pairs.groupBy("entity", "term").agg(
        F.sum("rows").alias("n_te"), F.count(F.lit(1)).alias("texts"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e")
    )
    content = F.log2(total / F.col("n_e"))
    told = F.log2(total * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    weighed = together.filter(F.col("texts") >= support).withColumn("share", F.when(content > 0, told / content).otherwise(F.lit(0.0)))
    first = len(KINDS)
    kind = F.when(F.col("share") >= remove, F.lit(first + 1)).when(F.col("share") >= generalise, F.lit(first))
    chosen = weighed.select("entity", "term", kind.alias("kind")).filter("kind IS NOT NULL")
    return pairs.join(chosen, ["entity", "term"]).groupBy("key", "term").agg(F.max("kind").alias("kind"))


def _term_spans(text: Column, terms: Column) -> Column:
    """Where the terms (term to kind) stand in ``text``, its base spans left out."""
    words = _find(text, _WORD, F.lit(0), lambda v: F.map_contains_key(terms, F.lower(v)), F.lit(True))
    kinds = F.transform(words, lambda s: s.withField("kind", F.element_at(terms, F.lower(s["value"]))))
    return F.array_sort(kinds.cast(_SPAN))


def findings(
    docs: DataFrame,
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> tuple[DataFrame, DataFrame]:
    """All rows with base spans, and the term spans by text.

    The first table has ``doc_id``, ``key`` and ``spans``; the second ``key``
    and ``more``, for the texts that hold a term to hide. The key is a digest
    of the text and is null without base spans.
    """
    rows = docs.select("doc_id", "text", base_spans(F.col("text")).alias("spans"))
    found = F.when(F.size("spans") > 0, F.md5(F.col("text").cast("binary"))).alias("key")
    words = F.when(F.size("spans") > 0, _terms(_blank(F.col("text"), F.col("spans")))).alias("terms")
    rows = checkpoint(rows.select("doc_id", found, "spans", words))
    hidden = disclosing_terms(docs, rows.filter("key IS NOT NULL"), support, generalise, remove)
    by_text = hidden.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("terms"))
    texts = docs.filter(F.col("text").rlike(_ANY)).select(F.md5(F.col("text").cast("binary")).alias("key"), "text")
    texts = texts.join(by_text, "key").withColumn("spans", base_spans(F.col("text")))
    more = texts.select("key", "terms", _blank(F.col("text"), F.col("spans")).alias("text"))
    more = more.select("key", _term_spans(F.col("text"), F.col("terms")).alias("more"))
    return rows.drop("terms"), more.groupBy("key").agg(F.first("more").alias("more"))


def spans(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id, ``base`` and ``spans`` (base and term spans) of every row."""
    rows, more = findings(docs, **thresholds)
    plain = rows.filter("key IS NULL").select("doc_id", F.col("spans").alias("base"), "spans")
    both = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(_SPAN))))
    held = rows.filter("key IS NOT NULL").join(more, "key", "left").select("doc_id", F.col("spans").alias("base"), both.alias("spans"))
    return plain.unionByName(held)


def _rewrite(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced; overlapping spans are covered once."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit("[TERM]"), F.lit(""))
    return _cover(text, spans, lambda s, at: F.when(s["start"] >= at, F.get(marks, s["kind"])).otherwise(F.lit("")))


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with personal data replaced by its kind and disclosing terms generalised or removed."""
    _, more = findings(docs, **thresholds)
    more = checkpoint(more).select(F.col("key").alias("_key"), F.col("more").alias("_more"))
    # All but the text travels as one struct, so no column of it can clash with ours.
    rest = F.struct(*columns(docs, "text")).alias("_row")
    spotted = docs.select(rest, F.col("text").alias("_text"), base_spans(F.col("text")).alias("_spans"))

    def rows(df: DataFrame, text: Column) -> DataFrame:
        return df.select(*[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])

    held = spotted.filter(F.size("_spans") > 0).withColumn("_key", F.md5(F.col("_text").cast("binary"))).join(more, "_key", "left")
    every = F.array_sort(F.concat("_spans", F.coalesce("_more", F.array().cast(_SPAN))))
    clean = rows(spotted.filter(F.size("_spans") == 0), F.col("_text"))
    return clean.unionByName(rows(held, _rewrite(F.col("_text"), every)))
