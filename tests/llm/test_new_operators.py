"""Conversation repair, sharding and phrase mining against brute force, on small tables with odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from check_oracles import same

from tidemark.llm import conversations, language_id, phrases, queries, sharding

CLASH = "shard int, slot int, k int, fault string, `text ` string"
ODD = (1, 2, 3, "f", "t")


# Conversation repair

SAID = ["Yes.", "No!", "why", "", " \t", "so?\n", "Ein langer Satz. " * 300, "é.", "x" * 50_000]
TURNS = f"conv_id long, turn long, role string, text string, {CLASH}"


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(3)
    rows = []
    for conv in [*range(60), None]:
        roles = rnd.choice([["user", "assistant"], ["system", "user", "assistant", "tool", "", None], ["tool"], ["user"]])
        for i in range(rnd.choice([1, 2, 3, 6, 9, 30])):
            turn = rnd.choice([i, i, i, i + 1, 2 * i, None])
            rows.append((conv, turn, rnd.choice(roles), rnd.choice([*SAID, f"{i}.", None])))
    return rows + rows[:4] + [(999, 8, "user", "gone."), (999, 8, "user", "gone.")]


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def fault_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows, fault):
    """(cost, audit, lines) with whole strings in every state."""
    following = {"": "u", "s": "u", "u": "a", "a": "u"}
    role_of = {"u": "user", "a": "assistant"}

    def offer(best, state, new):
        if state not in best or new[:2] < best[state][:2]:
            best[state] = new

    def insert(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                to = following[state]
                offer(best, to, (cost + 3, audit + "I", (*lines, f"{role_of[to]}:")))
        return best

    best = insert({"": (0, "", ())})
    for (_, role, text), bad in zip(rows, fault):
        new, more = {}, 3 if bad == "truncated" else 0
        for state, (cost, audit, lines) in best.items():
            offer(new, state, (cost + 4, audit + "D", lines))
            if bad not in ("blank", "duplicate"):
                to = following[state]
                offer(new, to, (cost + 3 + more, audit + "R", (*lines, f"{role_of[to]}:{text}")))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    offer(new, role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
        best = insert(new)
    return min(best[s] for s in ("", "a") if s in best)


@pytest.mark.parametrize("pending", [2, 256])
def test_conversation_repair(spark, talks, monkeypatch, pending):
    monkeypatch.setattr(conversations, "PENDING_ROWS", pending)
    df = spark.createDataFrame([(*r, *ODD) for r in talks], TURNS).repartition(3)
    got = {r.conv_id: r for r in conversations.repair(conversations.damaged(df)).collect()}
    want = damage(talks)
    assert set(got) == set(want) and len(got) == 62
    for conv, rows in want.items():
        fault = fault_of(rows)
        cost, audit, lines = plain_repair(rows, fault)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = [fault.count(f) for f in ("blank", "duplicate", "truncated")]
        assert tuple(got[conv]) == (conv, gaps, *counts, illegal, cost, audit, digest)


def test_repair_against_all_edit_strings():
    """Every string of edits of up to two insertions per place, for all short conversations."""
    legal = re.compile("(s?(ua)+)?")
    for roles in itertools.product("suat", repeat=2):
        rows = [(i, r + "x", f"{i}.") for i, r in enumerate(roles)]
        found = []
        inserts = ["", "u", "a", "ua", "au"]
        for gaps in itertools.product(inserts, repeat=3):
            for edits in itertools.product(["K", "Ru", "Ra", "D"], repeat=2):
                initials, audit, cost = gaps[0], "I" * len(gaps[0]), 3 * len(gaps[0])
                for edit, role, gap in zip(edits, roles, gaps[1:]):
                    initials += (role if edit == "K" else edit[1:]) + gap
                    audit += edit[0] + "I" * len(gap)
                    cost += {"K": 0, "R": 3, "D": 4}[edit[0]] + 3 * len(gap)
                if legal.fullmatch(initials):
                    found.append((cost, audit))
        one = conversations._Repair()
        for row in rows:
            one.add(*row, None)
        assert one.result()[5:7] == min(found)


def test_long_conversations_settle_and_hashes_may_collide(monkeypatch):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["user", "assistant"]), f"{i}.") for i in range(3_000)]
    one = conversations._Repair()
    for row in rows:
        one.add(*row, None)
        assert len(one.rows) <= 2 * conversations.PENDING_ROWS
    want = plain_repair(rows, [""] * len(rows))
    assert one.result()[5:7] == want[:2]
    monkeypatch.setattr(conversations, "_PRIME", 3)
    small = conversations._Repair()
    for row in rows[:400]:
        small.add(*row, None)
    assert small.result()[5:7] == plain_repair(rows[:400], [""] * 400)[:2]


# Sharding


@pytest.mark.parametrize("n,shards", [(0, 24), (5, 24), (24, 24), (1_003, 24), (1_003, 7), (60, 1)])
def test_sharding(spark, n, shards):
    rnd = random.Random(n)
    # One source holds a third and more; some rows repeat; a source, a key and a text may be null.
    source = lambda: rnd.choice(["hot", "hot", "hot", "b", "c", None])
    rows = [(rnd.choice([i, i, 7, None]), source(), rnd.choice(["t", "", None, "é" * 9]), *ODD) for i in range(n)]
    df = spark.createDataFrame(rows, f"doc_id long, source string, text string, {CLASH}").repartition(3)
    got = sharding.deal(df, carry=("text", "source"), shards=shards).collect()
    assert Counter((r.doc_id, r.source, r.text) for r in got) == Counter(r[:3] for r in rows)
    sizes = Counter(r.shard for r in got)
    if n:
        assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1 and set(sizes) <= set(range(shards))
    for shard in sizes:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    total = Counter(r[1] for r in rows)
    for (shard, name), held in Counter((r.shard, r.source) for r in got).items():
        assert abs(held - sizes[shard] * total[name] / n) <= len(total)


def test_sharding_is_seeded(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(300)], "doc_id long, source string")
    place = lambda rows, seed: {r.doc_id: (r.shard, r.slot) for r in sharding.deal(rows, seed=seed).collect()}
    assert place(df, 1) == place(df.repartition(5, "doc_id"), 1) != place(df, 2)


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(300)], "doc_id long, source string")
    sharding.write(sharding.deal(df, shards=4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("shard").distinct().count() == 4


# Phrases


def plain_phrases(rows, threshold, best):
    f, n = {}, Counter()
    for lang, text in rows:
        lang, text = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    found, out = {k: v for k, v in f.items() if v >= threshold and len(k[1]) > 1}, []
    hidden = {}
    for (lang, w), v in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, w[i : i + k])
                hidden[part] = max(hidden.get(part, 0), v)
    for (lang, w), a in found.items():
        if 100 * hidden.get((lang, w), 0) < 80 * a:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked = [(lang, i + 1, *r[1:]) for lang, group in itertools.groupby(out, key=lambda r: r[0]) for i, r in enumerate(group)]
    return [r for r in ranked if r[1] <= best]


@pytest.mark.parametrize("threshold,shards,partitions,bits", [(5, 4, 7, 1 << 26), (5, 1, 3, 1 << 12), (8, 3, 2, 64), (5, 5, 1, 1 << 26)])
def test_phrases(spark, monkeypatch, threshold, shards, partitions, bits):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 4_000)
    rnd = random.Random(9)
    vocabulary = [rnd.choice(["", "É", "Z", "-", "日"]) + "abcdefgh"[i % 8] * (1 + i // 8) for i in range(40)]
    say = lambda n: "".join(rnd.choice(vocabulary[: rnd.randint(3, 40)]) + rnd.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) for _ in range(n))
    rows = [(rnd.choice(["en", "en", "en", "fr", None, "und"]), rnd.choice([say(rnd.randint(0, 90)), None, "", " . ", "The Long Phrase Here now"])) for _ in range(150)]
    rows += [("en", "ab ab ab ab " * 400), ("fr", say(3_000))] + rows[:5]
    rows = [(lang, text) for lang, text in rows]
    df = spark.createDataFrame([(*r, *ODD) for r in rows], f"lang string, text string, {CLASH}").repartition(partitions)
    got = [tuple(r) for r in phrases.collocations(df, threshold, best=60, shards=shards, bits=bits).collect()]
    want = plain_phrases(rows, threshold, 60)
    assert sorted(got) == sorted(want)
    assert len(want) > 20


def test_no_phrases(spark):
    for rows in ([], [("en", None)], [(None, "  . ")], [("en", "one two")]):
        df = spark.createDataFrame(rows, "lang string, text string")
        assert phrases.collocations(df).count() == 0


# The registered queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_registered_queries_match_their_sql(spark, name):
    """Each opN_ function as registered, on the smallest tables."""
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    got = pd.DataFrame([r.asDict() for r in queries.QUERIES[name](spark, folder).collect()])
    assert same(got, con.execute(queries.SQL[name]).df()) is None


# Language identification without caps


def test_small_and_many_languages_are_learnt(spark):
    """Language 600 of 600 and the words of a language with few rows can be predicted."""
    code = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:03d}")
    rows = [(n * 600 + i, f"qu{code(i)} zz{code(i)[::-1]}{code(i)} quilt", f"l{i:03d}") for i in range(600) for n in range(3)]
    rows += [(10_000 + i, f"common{i % 7} words here", "l000") for i in range(3_000)]
    model = language_id.fit(spark.createDataFrame(rows, "key long, text string, lang string"))
    assert len(model.languages) == 600
    asked = spark.createDataFrame([(i, f"qu{code(i)} zz{code(i)[::-1]}{code(i)}") for i in range(7, 600, 7)], "doc_id long, text string")
    assert all(r.lang_pred == f"l{r.doc_id:03d}" for r in language_id.predict(asked, model).collect())


def plain_language(text, model):
    """Score every word of a text on its own, from the model's tables."""
    total, any_ = [0.0] * len(model.languages), False
    for run in re.findall(r"[^\W\d_]+", (text or "").lower()):
        word = "".join(c for c in run if c.isalpha())
        if not word:
            continue
        any_ = True
        if word in model.words:
            rows = [model.words[word]]
        else:
            rows, padded = [], f"<{word}>"
            for n, table in zip(range(len(model.grams), 0, -1), model.grams):
                rows = [table[padded[i : i + n]] for i in range(len(padded) - n + 1) if padded[i : i + n] in table]
                if rows:
                    break
        for i in range(len(total)):
            total[i] += sum(model.scores[r][i] for r in rows) / len(rows) if rows else 0.0
    return model.languages[total.index(max(total))] if any_ and model.languages else "und"


def test_language_against_plain_scores(spark):
    rnd = random.Random(2)
    made = {"aa": ["lo", "mi", "ra", "te"], "bb": ["lo", "ung", "der", "mi"], "cc": ["ção", "ra", "lha", "os"]}
    say = lambda l, n: " ".join("".join(rnd.choice(made[l]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    rows = [(i, say(l, 20), l) for i, l in enumerate(rnd.choice(list(made)) for _ in range(150))]
    model = language_id.fit(spark.createDataFrame(rows, "key long, text string, lang string"))
    texts = [say(rnd.choice(list(made)), rnd.randint(1, 6)) + rnd.choice(["", " XY12z", " é_é", "."]) for _ in range(80)] + [None, "", "1 2", "lo" * 9_000]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(asked, model).collect()}
    assert got == {i: plain_language(t, model) for i, t in enumerate(texts)}
