"""Vector searches, page extraction, archives and the pipeline against brute force."""

import hashlib
import math
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_text_operators import cut_up, component_of, plain_fingerprint, plain_spans, removed_words
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import forest, packing, templates, topk, vectors, warc
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, key long, far string, vector string"
PAGES = "page_id long, url string, html string, host string, payload string, first long, text int"


@pytest.fixture(scope="module")
def points():
    """Clustered and copied vectors, one vector very often, and rows that take no part."""
    random_ = np.random.default_rng(3)
    centres = random_.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.4 * random_.normal(size=8)).astype(np.float32).tolist()) for i in range(500)]
    rows += [(i, rows[7][1]) for i in range(500, 900)]
    rows += [(900, [0.0] * 8), (901, None), (902, [1.0, None] + [0.0] * 6), (903, [math.nan] * 8), (904, [math.inf] * 8), (905, []), (906, [1.0] * 3), (1000, [9.0, 2.0]), (1050, []), (950, [0.0] * 8), (None, [1.0] * 8)]
    return rows


@pytest.fixture(scope="module")
def table(spark, points):
    return spark.createDataFrame([(i, v, 0, 1, "f", "v") for i, v in points], VECTORS).repartition(3).cache()


def usable(points, zero):
    fine = [(i, v) for i, v in points if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    return [(i, [*v, *[0.0] * (8 - len(v))]) for i, v in fine if zero or any(v)]


@pytest.mark.parametrize("block,pivots,k", [(2_048, 64, 5), (37, 9, 5), (64, 5, 3)])
def test_top_products(table, points, monkeypatch, block, pivots, k):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rows = usable(points, zero=True)
    ids, whole = np.array([i for i, _ in rows]), np.floor(np.array([v for _, v in rows], np.float64) * 256).astype(np.int64)
    want = []
    for at in np.flatnonzero(ids % 50 == 0):
        scores, others = whole @ whole[at], ids != ids[at]
        order = np.lexsort((ids[others], -scores[others]))[:k]
        want += [(ids[at], r + 1, ids[others][o], scores[others][o]) for r, o in enumerate(order)]
    got = topk.top_products(table, k, pivots=pivots)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 * (i % 7) - i), -float(2**19 + i)]) for i in range(60)]
    got = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).collect()
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    for r in got:
        assert r.score == sum(a * b for a, b in zip(whole[r.query_id], whole[r.vec_id]))


def test_nearest(table, points):
    rows = usable(points, zero=False)
    ids, units = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    got = {}
    for r in forest.nearest(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    queries = ids[ids % 50 == 0]
    assert sorted(got) == sorted(queries.tolist())
    found = 0
    for q in queries:
        scores, others = units @ units[ids == q][0], ids != q
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and q not in [m[1] for m in mine]
        for _, v, s in mine:
            assert abs(s - scores[ids == v][0]) < 1e-12
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        found += sum(s >= np.sort(scores[others])[-5] - 1e-12 for _, _, s in mine)
    assert found / (5 * len(queries)) >= 0.9


def test_recall_without_structure(spark):
    random_ = np.random.default_rng(1)
    points = random_.normal(size=(3_000, 64))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    found = forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    hits = 0
    for q in range(0, 3_000, 50):
        scores = units @ units[q]
        scores[q] = -2
        hits += len(set(np.argsort(-scores)[:5].tolist()) & {r.vec_id for r in found if r.query_id == q})
    assert hits / (5 * 60) >= 0.9


@pytest.mark.parametrize("block", [5, 2_048])
def test_repeated_rows_are_one_candidate(spark, monkeypatch, block):
    """Rows repeated six times, and one id with several vectors, take one place each."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    random_ = np.random.default_rng(5)
    points = random_.normal(size=(120, 4))
    extra = points[0] * np.arange(3, 11)[:, None] + 0.1 * random_.normal(size=(8, 4))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(7, v.tolist()) for v in extra] + rows[:100] * 5
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole_of = lambda v: np.floor(v * 256)
    unit_of = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    for make, of in ((topk.top_products, whole_of), (lambda d: forest.nearest(d, share=1.0), unit_of)):
        whole, more = of(points), of(extra)
        got = {}
        for r in make(df).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        assert sorted(got) == [0, 50, 100]
        for q, found in got.items():
            scores = whole @ whole[q]
            scores[7] = max(scores[7], (more @ whole[q]).max())
            scores[q] = -np.inf
            want = np.lexsort((np.arange(120), -scores))[:5]
            assert sorted(found) == [1, 2, 3, 4, 5]
            assert [found[r][0] for r in range(1, 6)] == want.tolist()
            assert np.allclose([found[r][1] for r in range(1, 6)], scores[want])


def test_small_tables_are_searched_whole(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(0, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in forest.nearest(df).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    assert topk.top_products(df).count() == 3
    for make in (forest.nearest, topk.top_products):
        assert make(df.limit(0)).count() == 0 and make(df.filter("vec_id = 0")).count() == 0


# Pages

CASES = [
    ("<article><h1>T</h1><p>a  b\n c<p>d<br>e</article><footer>f</footer>", "T\na b c\nd e"),
    ("<body><nav>n</nav><p>text &amp; more&nbsp;x &lt;b&gt;</p><form>q<p>r</form>tail", "text & more x <b>\ntail"),
    ("<html><head><title>t</title><style>p{}</style><p>first</p><script>var t='</p>';</script><p>second", "first\nsecond"),
    ("<main><section class='reader comments'><p>no</p></section><div><p>yes</p><aside>s</aside></div></main><p>out", "yes"),
    ("<article><div class=ad>x</div><ul><li>one<li>two <b>bold</b></ul><pre> a\n b </pre></article>", "one\ntwo bold\na b"),
    ("<p>open <!-- comment <p>not", "open"),
    ("<article><p>a</p><article class='comment'><p>c</p></article></article>", "a"),
    ("<article></article><p>elsewhere</p>", ""),
    ("<div hidden>h</div><div aria-hidden='true'>g</div><div role=navigation>m</div>plain <i>in</i>line", "plain inline"),
    ("<article><p>1 < 2 and a > b</p><p title='x > y'>q</p></article>", "1 < 2 and a > b\nq"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("just text", "just text"), ("<article>" + "<p>w</p>" * 3_000, "\n".join("w" * 3_000)),
]


def test_page_rules():
    for source, want in CASES:
        assert templates.parse(source).text(set()) == want, source and source[:80]


def test_names_that_do_not_make_furniture():
    for source, want in [
        ("<body class='has-sidebar'><p>a</p></body>", "a"),
        ("<main class='no-sidebar'><p>a</p></main>", "a"),
        ("<main class=sidebar><p>a</p></main>", "a"),
        ("<article class='post has-comments'><p>a</p></article>", "a"),
        ("<article id=comments><p>a</p></article>", "a"),
        ("<div class='market-share'>a</div>", "a"),
        ("<div class='text with_banner'>a</div>", "a"),
        ("<h2 id=reply>a</h2>", "a"),
        ("<div class='sidebar-left'>s</div><div class='box ad'>s</div><div id=footer_links>s</div>a", "a"),
    ]:
        assert templates.parse(source).text(set()) == want, source


def test_subjects_and_quoted_words_are_not_furniture():
    page = lambda body: templates.parse(f"<body>{body}</body>").text(set())
    for body in (
        '<p title="a hidden gem">text</p>', "<p title='so hidden = so'>text</p>", '<div class="social-history">text</div>',
        '<section id="notice-of-amendment">text</section>', '<p class="related-work">text</p>', '<table class="menu-prices"><tr><td>text</table>',
    ):
        assert page(body) == "text", body
    for body in (
        "<p hidden>text</p>", '<p class="x" hidden>text</p>', '<div hidden="until-found">text</div>', '<div class="cookie-banner">text</div>',
        '<ul class="share-buttons"><li>text</ul>', '<div class="x sidebar-left">text</div>', '<div id="comments-12">text</div>',
    ):
        assert page(body) == "", body


def test_broken_pages_take_linear_time():
    page = lambda source: templates.parse(source).text(set())
    start = time.time()
    assert page("<div>" * 100_000 + "text") == "text"
    assert page("</p>" * 100_000 + "text") == "text"
    assert page("<p>text</p>" + "<a " * 200_000) == "text\n" + ("<a " * 200_000).strip()
    assert page("<p>one<p>two" + "<li>x" * 50_000).startswith("one\ntwo\nx\nx")
    assert time.time() - start < 30


def test_comments_that_never_end():
    page = lambda source: templates.parse(source).text(set())
    assert page("<p>text</p><!-- gone") == "text"
    assert page("<p>text</p><!-- gone > gone") == "text"
    assert page("<p>text</p><script>gone > gone") == "text"
    assert page("<p>text</p>kept <!-- gone") == "text\nkept"
    assert page("<p>text</p><script>gone</script >kept") == "text\nkept"
    assert page("text") == "text" and page("") == "" and page("1 < 2") == "1 < 2"


def test_site_templates(spark):
    rows = []
    for i in range(40):
        site, menu = ("one.example", "<div><p>Site menu</p><p>every page</p></div>") if i % 2 else ("two.example", "<div><p>Other bar</p></div>")
        rows.append((i, f"https://{site}/{i}", f"<body>{menu}<div><p>page {i} says</p></div><div><p>now and then {i % 25}</p></div></body>"))
    rows += [(100 + i, "https://one.example/copy", rows[1][2]) for i in range(30)]
    rows += [(200 + i, "https://three.example/x", f"<article><p>quoted everywhere</p><p>{i}</p></article><div>bar</div>") for i in range(10)]
    rows += [(300, None, "<p>nowhere</p>"), (301, "no url", None), (302, "https://one.example/x", rows[1][2]), (302, "https://one.example/x", rows[1][2])]
    df = spark.createDataFrame([(*r, "h", "p", 1, 2) for r in rows], PAGES).repartition(3)
    got = sorted((r.page_id, r.text) for r in templates.main_text(df).collect())
    want = []
    for i, _, source in rows:
        if i < 40 or 100 <= i < 200 or i == 302:
            n = i if i < 40 else 1
            want.append((i, f"page {n} says\nnow and then {n % 25}"))
        elif i < 300:
            want.append((i, f"quoted everywhere\n{i - 200}"))
        else:
            want.append((i, "nowhere" if i == 300 else ""))
    assert got == sorted(want)
    assert templates.main_text(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def pages():
    body = "<p>" + "same " * 40 + "é漢🙂</p>"
    rows = [(i, f"https://h/{i}", f"<p>{i} " + "own " * 60) for i in range(20)]
    rows += [(i, "https://h/same", body) for i in range(40, 25, -1)]
    rows += [(50, "https://h/a\r\nb", "tiny"), (51, "u", "tiny"), (52, None, None), (53, "u", ""), (54, "é", "x\r\n\r\nWARC/1.1\r\n\r\n" * 30), (55, "l", "y" * 3_000_000)]
    rows += [(60, "r", "z" * 200), (60, "r", "z" * 200), (61, "r", "z" * 200), (None, "n", "z" * 200)]
    return rows


def test_archives(spark, pages, tmp_path, monkeypatch):
    df = spark.createDataFrame([(*r, "h", "p", 1, 2) for r in pages], PAGES).repartition(3)
    folder = f"{tmp_path}/archives"
    warc.write(df, folder)
    index = warc.index(spark, folder).cache()
    assert index.count() == len(pages)
    for r in index.collect():
        with open(r.file.removeprefix("file:"), "rb") as file:
            file.seek(r.offset)
            record = file.read(r.length)
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and file.read(4) == b"\r\n\r\n"
    monkeypatch.setattr(warc, "READ", 500)
    got = warc.resolve(warc.read(index)).collect()
    first = {}
    for i, _, source in pages:
        if i is not None and len((source or "").encode()) >= 100:
            first[source] = min(first.get(source, i), i)
    want = []
    for i, _, source in pages:
        payload = (source or "").encode()
        refers = None if i is None or len(payload) < 100 or first[source] == i else first[source]
        want.append((i, "response" if refers is None else "revisit", refers, hashlib.sha256(payload).hexdigest(), len(payload)))
    key = lambda r: str(r)
    assert sorted([(r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in got], key=key) == sorted(want, key=key)
    some = warc.read(index.filter("url = 'https://h/3'"), payloads=True).collect()
    assert [bytes(r.payload).decode() for r in some] == [pages[3][2]]


def test_small_windows_find_every_header(tmp_path, monkeypatch):
    records = []
    for i, size in enumerate([0, 5, 300, 70]):
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % size + b"q" * size
        records.append(b"WARC/1.1\r\nWARC-Record-ID: <urn:x-page:%d>\r\nX: %s\r\nContent-Length: %d\r\n\r\n" % (i, b"v" * (90 * i), len(block)) + block)
    path = tmp_path / "a.warc"
    path.write_bytes(b"".join(r + b"\r\n\r\n" for r in records))
    for window in (16, 100, 1 << 20):
        monkeypatch.setattr(warc, "_WINDOW", window)
        with warc._open(f"file:{path}") as file:
            assert [length for _, length, _ in warc._records(file, path.stat().st_size)] == [len(r) for r in records]
    path.write_bytes(b"WARC/1.1\r\nno end")
    with warc._open(f"file:{path}") as file, pytest.raises(ValueError):
        list(warc._records(file, path.stat().st_size))


def test_archives_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], PAGES)
    warc.write(empty, f"{tmp_path}/none")
    assert warc.resolve(warc.read(warc.index(spark, f"{tmp_path}/none"))).count() == 0


# The pipeline


def test_pipeline(spark):
    """Every stage against brute force on what the stage before kept."""
    random_ = random.Random(9)
    vocabulary = ["".join(random_.choice("abcdefgh") for _ in range(random_.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(random_.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    texts = [prose(random_.randint(5, 90)) for _ in range(25)] + [f"{prose(9)} {passage} {prose(3)}" for _ in range(4)]
    texts += [texts[0], texts[1] + " end", None, "", "12 34 %", f"{prose(30)} write to me@mail.example.com or +1 (202) 555-0101 {prose(30)}"]
    more = ["row", "_row", "_key", "_text", "_spans", "score", "lang_pred", "n_words", "fp", "a.b"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in more)
    rows = [(i, t, "en" if i % 3 else None, "s", len(t) if t else 0, *more) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema).repartition(2)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "personal_data", "packing"]
    state = {i: t for i, t, *_ in rows}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *more]
        docs = docs.cache()
        got = {r.doc_id: r for r in docs.collect()}
        if name == "language":
            state = {i: t for i, t in state.items() if t and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            ids = sorted(state)
            label = component_of([plain_fingerprint(state[i]) for i in ids], 2)
            state = {i: state[i] for at, i in enumerate(ids) if label[at] == at}
        elif name == "repeats":
            state = {i: k if g else state[i] for i, _, g, k in removed_words(sorted(state.items()), 20)}
        else:
            for i, text in state.items():
                for s, _, e, kind in reversed(plain_spans(text)):
                    text = text[:s] + f"[{kind.upper()}]" + text[e:]
                state[i] = text
        assert {i: r.text for i, r in got.items()} == state
        assert all(list(r)[5:] == more for r in got.values())
        if name in ("repeats", "personal_data"):
            assert all(r.n_chars == len(r.text) for r in got.values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i, s, len(p)) for i, t in state.items() for s, p in cut_up([*tokenizer.encode(t, add_special_tokens=False).ids, 2], 4_096))
    packed = corpus_pipeline.STAGES[4][1](spark, docs, FOLDER).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in packed) == want
    for n, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), FOLDER).count() == 0, n


def test_language_stage_with_few_or_no_labels(spark):
    schema = "doc_id long, text string, lang string, n_chars long"
    texts = ["the cat and the dog", "the end of the day", "der hund und die katze", "das ende und der tag", "12 %", None]
    bare = spark.createDataFrame([(i, t, None, 0) for i, t in enumerate(texts)], schema)
    got = corpus_pipeline.identify_language(spark, bare, FOLDER).collect()
    assert sorted((r.doc_id, r.lang) for r in got) == [(i, None) for i in range(4)]
    some = spark.createDataFrame([(i, t, {0: "en", 2: "de"}.get(i), 0) for i, t in enumerate(texts)], schema)
    got = corpus_pipeline.identify_language(spark, some, FOLDER).collect()
    assert sorted((r.doc_id, r.lang) for r in got) == [(0, "en"), (1, "en"), (2, "de"), (3, "de")]


def test_language_decides_what_shares_a_sequence(spark, monkeypatch):
    """Unlabelled and wrongly labelled texts are packed with their language, null ones by themselves; unsure predictions leave labels."""
    words = {"de": "der hund und die katze", "en": "the cat and the dog", "fr": "le chat avec la souris"}
    random_ = random.Random(3)
    say = lambda lang, n: " ".join(random_.choice(words[lang].split()) for _ in range(n))
    true = [random_.choice(sorted(words)) for _ in range(90)]
    given = [None if i % 10 == 3 else "de" if i == 50 else lang for i, lang in enumerate(true)]
    true[50] = "en"
    rows = [(i, say(lang, random_.choice([5, 300, 3_000])), given[i], 0) for i, lang in enumerate(true)]
    rows += [(90, "漢字", "zh", 0), (91, None, "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").repartition(3)
    found = corpus_pipeline.identify_language(spark, docs, FOLDER).cache()
    want = {**dict(enumerate(true)), 90: "zh"}
    assert {r.doc_id: r.lang for r in found.collect()} == want
    some = found.withColumn("lang", F.when(F.col("doc_id") >= 9, F.col("lang")))
    want.update(dict.fromkeys(range(9)))
    packed = corpus_pipeline.pack_sequences(spark, some, FOLDER).collect()
    held, used, pieces = {}, {}, {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        held.setdefault(r.sequence_id, set()).add(want[r.doc_id])
        assert r.offset == used.get(r.sequence_id, 0) and r.offset + r.length <= 4_096
        used[r.sequence_id] = r.offset + r.length
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
        assert r.length > 0
    assert all(len(v) == 1 for v in held.values()) and sorted(held) == list(range(len(held)))
    assert set(pieces) == set(want) and all(pieces[r.doc_id] == r.doc_tokens for r in packed)
    for lang in set(want.values()):
        alone = packing.shortest_pack_first(Counter(r.length for r in packed if want[r.doc_id] == lang))
        assert sum(v == {lang} for v in held.values()) == sum(count for count, _ in alone)
    monkeypatch.setattr(corpus_pipeline, "SURE", 1.1)
    unsure = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, FOLDER).collect()}
    assert all(unsure[i] == lang for i, lang in enumerate(given) if lang)


def test_run_reads_the_documents(spark):
    if not Path(FOLDER).exists():
        pytest.skip("no test tables")
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.filter(F.col("offset") + F.col("length") > 4_096).count() == 0 < got.count()


def test_query_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
