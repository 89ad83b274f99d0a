"""Text operators against brute force on small tables with nulls, copies, ties and long texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, language_id, packing, sanitise, simhash, substring_dedup
from tidemark.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, `text ` string, row string, batch int, key string, spans int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): random prose, copies, near copies, shared passages, odd and long texts."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, long = prose(45), prose(6_000)
    texts = [prose(rnd.randint(1, 120)) for _ in range(30)]
    texts += [texts[3]] * 4 + [texts[5] + " tail"] + [f"{prose(7)} {passage} {prose(9)}" for _ in range(6)]
    texts += [long, long.replace(" ", "\n", 50), passage + "  " + passage, prose(19), prose(20)]
    texts += [None, None, "", " \t\n", "one", "two words", "x" * 9_000 + " " + "y" * 9_000, "a b c " * 40, "é" * 50, "12 3.4 ..."]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = list(zip(ids, texts))
    rows += [rows[4], rows[4], (None, texts[3]), (None, prose(30))]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    more = (None, "t", "r", 7, "k", 1)
    return spark.createDataFrame([(i, t, *more) for i, t in corpus], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# Substring dedup


def removed_words(rows, window):
    first, out = {}, []
    place = [(-(1 << 63) if i is None else i, n) for n, (i, _) in enumerate(rows)]
    for at in sorted(place):
        words = words_of(rows[at[1]][1])
        for s in range(len(words) - window + 1):
            content = tuple(words[s : s + window])
            first[content] = min(first.get(content, (at[0], s)), (at[0], s))
    for i, text in rows:
        words, key = words_of(text), -(1 << 63) if i is None else i
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (key, s):
                gone[s : s + window] = [True] * window
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


@pytest.mark.parametrize("window,batch_bytes", [(20, 2 << 20), (20, 700), (7, 3_000), (2, 3_000)])
def test_substring_dedup(docs, corpus, monkeypatch, window, batch_bytes):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", batch_bytes)
    got = substring_dedup.deduplicate(docs, window)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept_sha256"]
    want = removed_words(corpus, window)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    rows = got.collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows], key=key) == sorted(
        [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in want], key=key
    )
    texts = {r.doc_id: r for r in rows if r.doc_id is not None}
    for (i, text), (_, _, gone, kept) in zip(corpus, want):
        if i is not None:
            assert texts[i].text == (kept if gone else text)
            assert (texts[i]["text "], texts[i].batch, texts[i].row) == ("t", 7, "r")


def test_window_hashes_do_not_depend_on_segments(monkeypatch):
    words = substring_dedup.word_hashes([b"w%d" % (i % 97) for i in range(4_000)])[0]
    whole = [substring_dedup._family(1).windows(words, size) for size in (10, 20)]
    monkeypatch.setattr(substring_dedup, "_SEGMENT", 900)
    for size, a in zip((10, 20), whole):
        b = substring_dedup._Family(1).windows(words, size)
        assert (a == b).all()
        assert len(set(a[: 4_000 - size].tolist())) == 97


@pytest.mark.parametrize("batch_bytes", [2 << 20, 10])
def test_windows_that_collide_in_plain_polynomials_stay(spark, monkeypatch, batch_bytes):
    """Thue-Morse words cancel in any polynomial modulo 2^64, over letters or over words."""
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", batch_bytes)
    bits = [bin(i).count("1") % 2 for i in range(1_024)]
    letters = lambda flip: "".join("ab"[b ^ flip] for b in bits)
    rest = [f"word{i}" for i in range(19)]
    rows = [(i, " ".join([letters(i), *rest])) for i in (0, 1)]
    rows += [(2 + flip, " ".join("xy"[b ^ flip] for b in bits[:16]) + " " + " ".join(rest[:4])) for flip in (0, 1)]
    rows += [(9, rows[0][1])]
    got = substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 0), (9, 20)]


@pytest.mark.parametrize("many", [0, 1 << 33])
def test_all_bits_of_a_window_decide(monkeypatch, many):
    """Windows that agree in 64 bits but not in the others are different, in a batch and across two."""
    monkeypatch.setattr(substring_dedup, "_MANY_WORDS", many)
    kind = substring_dedup._entry(1_000)
    texts = pa.compress(b" ".join(b"w%d" % i for i in range(40)), codec="zstd", asbytes=True)
    size = len(b" ".join(b"w%d" % i for i in range(40)))
    batch = substring_dedup._Batch(texts, [5], [size], 20)
    batch.hashes = np.stack([np.full(40, 7, np.uint64), batch.hashes[1]])
    assert not substring_dedup._covered(batch, np.zeros(0, kind)).any()
    own = batch.entries(np.arange(21), kind)
    other = own[3:4].copy()
    other["low"] += 1
    assert not substring_dedup._covered(batch, other).any()
    assert np.flatnonzero(substring_dedup._covered(batch, own[3:4])).tolist() == list(range(3, 23))


def test_gaps_round_trip(rng):
    for top, n in ((1 << 40, 50), (1 << 20, 5_000), (200, 100)):
        values = np.unique(rng.integers(0, top, n).astype(np.uint64))
        assert (substring_dedup._unpack_sorted(substring_dedup._pack_sorted(values)) == values).all()


# SimHash


def plain_fingerprint(text):
    words = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_of(codes, distance):
    """Each code's component, by the index of its first member."""
    codes, label = np.array(codes, np.uint64), list(range(len(codes)))
    near = [np.flatnonzero(np.bitwise_count(codes ^ c) <= distance) for c in codes]
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            least = min(label[j] for j in others)
            if least < label[i]:
                label[i], changed = least, True
    return label


def test_simhash(docs, corpus):
    got = simhash.near_duplicates(docs).collect()
    codes = [plain_fingerprint(t) for _, t in corpus]
    label = component_of(codes, 2)
    first = {}
    for (i, _), l in zip(corpus, label):
        first[l] = min((x for x in (first.get(l), i) if x is not None), default=None)
    want = sorted((str(i), c, str(first[l])) for (i, _), c, l in zip(corpus, codes, label))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("node_rows,distance", [(4_096, 2), (40, 2), (3, 2), (16, 1), (16, 3)])
def test_links_find_every_component(spark, node_rows, distance):
    rnd = random.Random(node_rows)
    codes = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        code = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 2, 6])):
            codes.add(code)
            for _ in range(rnd.randint(1, 3)):
                code ^= 1 << rnd.randrange(64)
    dense = rnd.getrandbits(64)
    codes |= {dense ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}
    codes = sorted(codes)
    frame = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    roots = simhash.components(simhash.links(frame, distance, node_rows)).collect()
    root = {r.fp % (1 << 64): r.root for r in roots}
    groups = {}
    for c, l in zip(codes, component_of(codes, distance)):
        groups.setdefault(l, set()).add(c)
    for group in groups.values():
        assert len({root.get(c, c) for c in group}) == 1
        assert len(group) == 1 or group <= set(root)
    assert len({root[min(g)] for g in groups.values() if len(g) > 1}) == sum(len(g) > 1 for g in groups.values())


def test_keep_one(docs, corpus):
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    codes = [plain_fingerprint(t) for _, t in corpus]
    groups = {}
    for (i, t), l in zip(corpus, component_of(codes, 2)):
        groups.setdefault(l, []).append((i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), i, t))
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(m[3]), str(m[4])) for m in map(min, groups.values()))


# Sanitising

PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(re.sub(r"\D", "", v)) <= 19 and luhn(re.sub(r"\D", "", v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub(r"\D", "", v)) <= 15),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def plain_spans(text):
    found = []
    for k, (kind, (pattern, fine)) in enumerate(PATTERNS.items()):
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "", re.ASCII) if fine(m[0])]
    return sorted(found)


@pytest.fixture(scope="module")
def private(spark):
    rnd = random.Random(11)
    pieces = ["a.b@c.d", "a@b@c.de", "x@y", "@", ".@a.b", "+x@q.rs", "a@b.cd+e@f.gh", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "007.1.1.255", "1..2.3.4",
              "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 5", "378282246310005", "+1 (202) 555-0101", "+49 30 1234", "++1 202.555.0101 9-",
              "+1234567890123456", " ", "\n", "é", "漢字", "🙂", "word", "-", "."]
    texts = ["".join(rnd.choice(pieces) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    texts += [None, "", "no data", "1" * 5_000, "a" * 20_000, "a@b.c " * 700, "." .join("1" * 400), "a@" + "b." * 3_000 + "c"]
    return list(enumerate(texts))


def test_base_spans(spark, private):
    df = spark.createDataFrame(private, "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", sanitise.shown(sanitise.base_spans(F.col("text"))).alias("s")).collect()}
    for i, text in private:
        assert got[i] == ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in plain_spans(text)), text


def test_registered_query_counts_each_kind(spark, private, tmp_path):
    """op2_pii as registered: counts by kind and the digest of the base spans, also where kinds are not in listed order."""
    spark.createDataFrame(private, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op2_pii"](spark, str(tmp_path)).collect()}
    assert len(got) == len(private)
    for i, text in private:
        base = plain_spans(text)
        want = [sum(k == kind for _, k, _, _ in base) for kind in range(4)]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == want, text
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{kind}:{s}:{e}" for s, _, e, kind in base).encode()).hexdigest()


def test_disclosing_terms(spark):
    noise = [f"plain filler words number{chr(97 + i % 26)}{chr(97 + i // 26)} stand here" for i in range(60)]
    held = [f"story {n} told that zyxwvut wrote from who@there.org about filler matters" for n in ("alpha", "beta", "gamma")]
    copies = ["lonely qwertz beside just@once.net today"] * 4
    rows = [(i, t, "c") for i, t in enumerate([*noise, *held, *copies, None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = {r.doc_id: r for r in sanitise.spans(df.drop("key")).collect()}
    clean = {r.doc_id: r for r in sanitise.sanitise(df).collect()}
    for i, text in enumerate(held, len(noise)):
        kinds = {(s.kind, text[s.start : s.end]) for s in got[i].spans}
        assert (0, "who@there.org") in kinds and (5, "zyxwvut") in kinds
        assert not any(v in ("filler", "alpha", "beta", "gamma") for _, v in kinds)
        assert "zyxwvut" not in clean[i].text and "[EMAIL]" in clean[i].text and "filler" in clean[i].text
    for i in range(len(noise) + 3, len(noise) + 7):
        assert [s.kind for s in got[i].spans] == [0] and clean[i].text == "lonely qwertz beside [EMAIL] today"
    assert all(clean[i].text == t and not got[i].spans for i, t, _ in rows[: len(noise)])
    assert clean[len(rows) - 2].text is None and clean[0].key == "c"


def test_terms_far_from_an_entity(spark):
    """Terms of the whole text count, whatever stands between, as do short ones and ones with digits."""
    noise = [f"plain filler words number{i} stand here" for i in range(60)]
    gap = " 77 filler words" * 30
    held = [f"zyxwvut qx9 {n}{gap} to who@there.org or{gap} kq here zyxwvut" for n in ("alpha", "beta", "gamma")]
    df = spark.createDataFrame(list(enumerate([*noise, *held])), "doc_id long, text string")
    got = {r.doc_id: r for r in sanitise.spans(df).collect()}
    for i, text in enumerate(held, len(noise)):
        hidden = [text[s.start : s.end] for s in got[i].spans if s.kind == 5]
        assert hidden.count("zyxwvut") == 2 and {"qx9", "kq"} <= set(hidden)
        assert not {"filler", "words", "alpha", "beta", "gamma", "there", "org"} & set(hidden)
    assert all(not got[i].spans for i in range(len(noise)))


def test_values_seen_once(spark):
    """A term that discloses a domain, network, prefix or kind is hidden beside values that one text holds."""
    noise = [f"plain filler words number{i} stand here" for i in range(60)]
    held = [f"filler {term} {n} wrote {value}" for term, values in {
        "domainword": ["a@firm.example.org", "b@firm.example.org", "c@firm.example.org"],
        "networkword": ["10.20.30.4", "10.20.30.5", "010.20.30.77"],
        "phoneword": ["+1 (202) 555-0101", "+1 202 555 0102", "+12025550103"],
        "cardword": ["4111 1111 1111 1111", "4111-1111-1111-1129", "4111111111111137"],
    }.items() for n, value in zip(("alpha", "beta", "gamma"), values)]
    df = spark.createDataFrame(list(enumerate([*noise, *held])), "doc_id long, text string")
    got = {r.doc_id: r for r in sanitise.spans(df).collect()}
    for i, text in enumerate(held, len(noise)):
        assert [s.kind for s in got[i].base] and plain_spans(text)
        hidden = {text[s.start : s.end] for s in got[i].spans if s.kind >= 4}
        assert text.split()[1] in hidden and "filler" not in hidden, text
    assert all(not got[i].spans for i in range(len(noise)))


def plain_blank(text, spans):
    letters = list(text)
    for s in spans:
        letters[s.start : s.end] = " " * (s.end - s.start)
    return "".join(letters)


def plain_rewrite(text, spans):
    marks, out, at = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", ""], "", 0
    for s in sorted(spans, key=lambda s: (s.start, s.kind)):
        if s.start >= at:
            out += text[at : s.start] + marks[s.kind]
        at = max(at, s.end)
    return out + text[at:]


def test_covering_long_texts(spark):
    """Overlaps, no gaps, gaps over several pieces, wide characters, and more spans than a run holds."""
    rnd, rows = random.Random(9), [(0, "", []), (1, "plain", [])]
    for i in range(2, 30):
        text = "".join(rnd.choice("abé🙂\n ") for _ in range(rnd.choice([1, 50, 1_023, 1_024, 1_025, 9_000])))
        starts = sorted(rnd.randrange(len(text)) for _ in range(rnd.choice([1, 5, 127, 129, 700])))
        rows.append((i, text, sorted((s, rnd.randrange(6), min(s + rnd.randrange(1, 40), len(text)), "v") for s in starts)))
    rows.append((30, "x" * 5_000, [(0, 0, 5_000, "v")]))
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,kind:int,end:int,value:string>>")
    got = df.select("*", sanitise._blank(F.col("text"), F.col("spans")).alias("b"), sanitise._rewrite(F.col("text"), F.col("spans")).alias("r"))
    for row in got.collect():
        assert row.b == plain_blank(row.text, row.spans) and row.r == plain_rewrite(row.text, row.spans), row.doc_id


def test_many_values_in_one_text(spark):
    text = " ".join(f"user{i}@host{i}.example word" for i in range(40_000))
    out = sanitise.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string"), support=2).first().text
    assert out == " ".join(["[EMAIL] word"] * 40_000)


def test_rewrite_covers_overlaps_once(spark):
    text = "tel +4111111111111111 end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert len(plain_spans(text)) >= 1
    assert sanitise.sanitise(df).first().text.endswith(" end") and "4111" not in sanitise.sanitise(df).first().text


# BPE and packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = ["a", "É", "ß", "İ", "Σ", "\x1c", "\x85", "\xa0", "　", " ", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "²", "_", "'s", "'LL", "!!", "漢字", "हिन्दी", "́", "\n", "\t", "\x00", "foo", "Bar-baz", "🙂", "Ⅷ", "ª"]


def test_chunks_agree_with_the_library(tokenizer):
    encoder, rnd = bpe.ChunkEncoder(PATH), random.Random(2)
    shared = " ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 12))) for _ in range(900))
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.choice([3, 40, 1_500]))) for _ in range(150)]
    texts += [rnd.choice(["", "x ", "<|"]) * rnd.randint(0, 40) + shared + " " + str(i) for i in range(12)]
    texts += ["", "q" * 30_000, "ab<|endoftext|>" * 300, shared.replace(" ", "")]
    for text in texts:
        ids = plain_ids(tokenizer, text)
        binary = encoder.encode(text)
        assert encoder.encoder.show(binary) == (" ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False))
        assert binary == encoder.encoder.binary(text)
    assert encoder.reused > 20


def test_cuts_follow_the_content():
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(40_000))
    ends = lambda t: {t[max(0, e - 30) : e] for e in bpe.cuts(t)}
    assert bpe.cuts(text)[-1] == len(text) and len(ends(text) & ends("other words first " * 9 + text)) > 0.8 * len(ends(text))
    assert "".join(text[a:b] for a, b in zip([0, *bpe.cuts(text)], bpe.cuts(text))) == text


def test_a_tokenizer_that_is_not_by_word_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = bpe.ChunkEncoder(path), Tokenizer.from_file(path)
    text = "Some  text,\nwith spaces that matter. " * 100
    ids = plain.encode(text, add_special_tokens=False).ids
    assert encoder.encoder.show(encoder.encode(text)) == (" ".join(map(str, ids)), plain.decode(ids, skip_special_tokens=False))


def test_round_trip(docs, corpus, tokenizer):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in corpus:
        ids = plain_ids(tokenizer, text)
        want.append((str(i), len(ids), digest(" ".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False))))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect()]
    assert sorted(got) == sorted(want)
    decoded = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect() if r.doc_id is not None}
    assert all(decoded[i] == tokenizer.decode(plain_ids(tokenizer, t), skip_special_tokens=False) for i, t in corpus if i is not None)


@pytest.mark.parametrize("size", [4_096, 64, 7])
def test_packing(docs, corpus, tokenizer, size):
    rows = packing.pack(docs, PATH, size, ids=True).collect()
    pieces, sequences = {}, {}
    for r in rows:
        assert r.length == len(r.ids) <= size and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault(str(r.doc_id), []).append((r.start, tuple(r.ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i in {str(i) for i, _ in corpus}:
        want = sorted(p for d, t in corpus if str(d) == i for p in cut_up([*plain_ids(tokenizer, t), 2], size))
        assert sorted(pieces[i]) == want
    used = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        used.append(at)
    assert max(used) <= size and sorted(sequences) == list(range(len(used)))
    assert sum(used) >= 0.8 * size * (len(used) - 1)


def cut_up(ids, size):
    return [(s, tuple(ids[s : s + size])) for s in range(0, len(ids), size)]


def test_shortest_pack_first_places_every_length():
    rnd = random.Random(1)
    histogram = {n: rnd.randint(1, 10_000_000) for n in rnd.sample(range(1, 101), 60)}
    patterns = packing.shortest_pack_first(histogram, 100)
    placed = {}
    for count, lengths in patterns:
        assert count > 0 and sum(lengths) <= 100
        for n in lengths:
            placed[n] = placed.get(n, 0) + count
    assert placed == histogram and len(patterns) < 1_000
    waste = sum(c * (100 - sum(p)) for c, p in patterns) / sum(c * n for n, c in histogram.items())
    assert waste < 0.5


# Language identification


def test_language(spark, docs, nothing):
    rnd = random.Random(8)
    made = {"aa": ["lo", "mi", "ra", "te"], "bb": ["sch", "ung", "der", "ein"], "cc": ["ção", "nh", "lha", "os"]}
    say = lambda l, n: " ".join("".join(rnd.choice(made[l]) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    rows = [(i, say(l, 40), l) for i, l in enumerate(rnd.choice(list(made)) for _ in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = language_id.held_out(F.col("doc_id"))
    got = df.select("doc_id", held.alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    model = language_id.fit(df.filter(~held).select(F.col("doc_id").alias("key"), "text", "lang"), rows_per_language=60)
    tests = [(1000, say("bb", 30)), (1001, "SCHUNGDEREIN"), (1002, None), (1003, ""), (1004, "12 ² ½ _ ..."), (1005, say("cc", 20_000)), (1006, "lhaosnhção!")]
    found = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert [found[i].lang_pred for i in range(1000, 1007)] == ["bb", "bb", "und", "und", "und", "cc", "cc"]
    assert all(0 <= r.score <= 1 for r in found.values()) and found[1002].score == 0
    right = language_id.predict(df.filter(held), model, ("doc_id", "lang")).filter("lang = lang_pred").count()
    assert right >= 0.97 * df.filter(held).count()
    unlearnt = language_id.fit(nothing.select(F.col("doc_id").alias("key"), "text", "lang"))
    assert {r.lang_pred for r in language_id.predict(docs, unlearnt).collect()} == {"und"}


def test_empty_tables(nothing):
    assert substring_dedup.deduplicate(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0
    assert sanitise.spans(nothing).count() == 0 and sanitise.sanitise(nothing).count() == 0
    assert bpe.round_trip(nothing, PATH).count() == 0
    assert packing.pack(nothing, PATH).count() == 0
