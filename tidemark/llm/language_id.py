"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unseen word falls
back to its longest character n-grams of which any is known, then to shorter
ones. The model is fitted on a bounded, hash-chosen sample of labelled rows and
holds all words and n-grams of that sample; prediction reads every whole text.

Cases: a null text, an empty one and one without a letter are ``und`` with
score 0, and so is every text when no labelled row exists. Rows with a null
language are not learnt from. Equal scores go to the language that sorts first.
Repeated rows are predicted alike. Only the named columns are read, so extra
columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, slices
from tidemark.session import checkpoint

UNDETERMINED = "und"
#: Labelled rows per language that the fit reads (in expectation); nothing else bounds the model.
ROWS_PER_LANGUAGE = 300
LONGEST_GRAM = 5
SMOOTHING = 0.5
#: Scored unseen words that a worker remembers before it starts anew.
MEMORY = 200_000

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    """By length, longest first; values are rows of ``scores``."""
    scores: np.ndarray


def _sample(labelled: DataFrame, rows_per_language: int) -> DataFrame:
    """A share of each language's rows; the shares are literals, so no text is shuffled."""
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    share = F.lit(0.0)
    if sizes:
        pairs = [F.lit(v) for row in sizes for v in (row["lang"], min(1.0, rows_per_language / row["n"]))]
        share = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("lang")), F.lit(0.0))
    spot = F.pmod(F.xxhash64(F.col("_key")), F.lit(1 << 30)) / float(1 << 30)
    return labelled.filter(spot < share).select("lang", "text")


def _grams(word: Column, n: int) -> Column:
    padded = F.concat(F.lit("<"), word, F.lit(">"))
    last = F.length(padded) - n + 1
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(last >= 1, cuts).otherwise(F.array().cast("array<string>"))


def fit(
    docs: DataFrame,
    rows_per_language: int = ROWS_PER_LANGUAGE,
    longest: int = LONGEST_GRAM,
) -> Model:
    """Fit on ``docs`` (key, text, lang). What reaches the driver is what a sample of rows per language holds."""
    labelled = docs.select(F.col("key").alias("_key"), "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    sample = _sample(labelled, rows_per_language)
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    counts = checkpoint(sample.select("lang", word.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    pieces = F.array(
        F.struct(F.lit(0).alias("k"), F.array(F.col("word")).alias("g")),
        *[F.struct(F.lit(n).alias("k"), _grams(F.col("word"), n).alias("g")) for n in range(1, longest + 1)],
    )
    terms = (
        counts.select("lang", "n", F.inline(pieces))
        .select("lang", "n", "k", F.explode("g").alias("term"))
        .groupBy("k", "term", "lang")
        .agg(F.sum("n").alias("n"))
        .groupBy("k", "term")
        .agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    )
    terms = checkpoint(terms)
    kept: list[tuple[list[str], np.ndarray]] = []
    seen: dict[str, int] = {}
    for k in range(longest + 1):
        # Arrow columns instead of rows, one length at a time.
        found = terms.filter(F.col("k") == k).select("term", F.explode("by").alias("lang", "n")).toArrow().combine_chunks()
        term, lang = (pc.dictionary_encode(found[c].combine_chunks()) for c in ("term", "lang"))
        spots = np.array([seen.setdefault(name, len(seen)) for name in lang.dictionary.to_pylist()], dtype=np.int64)
        cells = (term.indices.to_numpy(), spots[lang.indices.to_numpy()], found["n"].to_numpy())
        kept.append((term.dictionary.to_pylist(), np.array(cells, dtype=np.int64).T.reshape(-1, 3)))
        del found, term, lang, cells
    order = sorted(seen)
    place = np.array([order.index(language) for language in seen], dtype=np.int64)
    scores, tables = [np.zeros((1, len(order)))], []
    first = 1
    for names, cells in kept:
        table = np.zeros((len(names), len(order)))
        if len(cells):
            table[cells[:, 0], place[cells[:, 1]]] = cells[:, 2]
        scores.append(np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * (len(names) + 1))))
        tables.append({name: first + i for i, name in enumerate(names)})
        first += len(names)
    return Model(order, tables[0], tables[:0:-1], np.concatenate(scores))


class _Scorer(dict):
    """Word to row of ``scores``; unseen words get rows of their own up to a bound."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.fixed = model, len(model.scores)
        self.scores = np.concatenate([model.scores, np.zeros((MEMORY, len(model.languages)))])
        self.at = self.fixed

    def full(self) -> bool:
        return self.at + 100_000 > len(self.scores)

    def reset(self) -> None:
        self.clear()
        self.update(self.model.words)
        self.at = self.fixed

    def __missing__(self, word: str) -> int:
        if not word.isalpha():
            letters = "".join(filter(str.isalpha, word))
            row = self[letters] if letters else 0
        else:
            if self.at == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros((MEMORY, self.scores.shape[1]))])
            row, self.at = self.at, self.at + 1
            self.scores[row] = self._backoff(word)
        self[word] = row
        return row

    def _backoff(self, word: str) -> np.ndarray | float:
        padded, longest = f"<{word}>", len(self.model.grams)
        for n, known in zip(range(longest, 0, -1), self.model.grams):
            found = [known[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in known]
            if found:
                return self.model.scores[found].mean(axis=0)
        return 0.0


def _guess(scorer: _Scorer, text: str | None) -> tuple[str, float]:
    languages = scorer.model.languages
    if not text or not languages:
        return UNDETERMINED, 0.0
    rows = np.fromiter(map(scorer.__getitem__, _LETTERS.findall(text.lower())), dtype=np.int64)
    if not rows.any():
        return UNDETERMINED, 0.0
    total = scorer.scores[rows].sum(axis=0)
    best = int(total.argmax())
    return languages[best], float(1.0 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score`` of its ``text`` column."""
    sent = list(dict.fromkeys((*keep, text)))
    spot = sent.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in slices(batches):
            found = [_guess(scorer, text) for text in batch.column(spot).to_pylist()]
            if scorer.full():
                scorer.reset()
            columns = batch.columns[: len(keep)]
            columns += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])
        release()

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*sent).mapInArrow(run, schema)


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether crc32 of the key as text falls into the fold that is never learnt from."""
    return F.coalesce(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0, F.lit(True))
