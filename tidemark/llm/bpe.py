"""BPE encoding that reuses content-defined chunks, and decoding.

A rolling hash over the last characters cuts each text where the content says
so, so passages shared by documents are cut alike whatever stands before them.
A worker encodes a chunk once and remembers it, within a bound. A cut may fall
inside a word: the join of two chunks is repaired by encoding the words around
it together, over more and more words, until the ids at both rims agree
exactly with those the chunks already have. Inside a chunk, a word between
white space is encoded once and remembered likewise.

Cases: null and empty texts have no ids. Special tokens written in a text, odd
white space and letters outside Latin go to the library word by word. A
tokenizer that does not work word by word is given each text whole. Very long
words and texts are encoded whole; repeated rows are encoded alike. Only the
named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import slices

#: Mean chunk length in characters (a power of two), and its bounds.
CHUNK = 1_024
SHORTEST = 256
LONGEST = 8_192
#: Characters that the rolling hash sees.
ROLL = 16
#: Words, and characters of chunks, that a worker remembers.
WORDS = 250_000
CHUNK_CHARS = 8_000_000
#: Words beside a cut that a chunk keeps for repairs.
RIM = 4

_SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACE = re.compile(f"[{_SPACES}]+")
#: In texts of these characters alone, str.lower() and str.split() do what the tokenizer does.
_PLAIN = re.compile(f"[\x00-\x1b\x20-\x7f{chr(0xC0)}-{chr(0x12F)}{chr(0x131)}-{chr(0x24F)}]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself, or the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_GEAR = np.array([zlib.crc32(bytes([b, 7])) for b in range(256)], dtype=np.uint32)

_ENDS = frozenset(".,;:!?")


class WordEncoder(dict):
    """Word to its encoding; two generations bound the memory."""

    def __init__(self, path: str, most: int = WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.token = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.decimal = list(map(str, range(len(self.token))))
        self.model = self.tokenizer.model
        self.most, self.old, self.piece = most, {}, {}
        self.by_word = self.tokenizer.decoder is None and self._works_by_word()

    def _works_by_word(self) -> bool:
        probe = "It's a_b  12x!\té-Ñ --we'll #1"
        try:
            here = [i for w in probe.split() for i in self._pieces(w.lower())]
        except (KeyError, ValueError):
            return False
        return here == self.tokenizer.encode(probe, add_special_tokens=False).ids

    def _piece(self, piece: str) -> list[int]:
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_LETTERS)
        return [t.id for t in self.model.tokenize(shown)]

    def _known(self, piece: str) -> list[int]:
        ids = self.piece.get(piece)
        if ids is None:
            if len(self.piece) >= self.most:
                self.piece.clear()
            ids = self.piece[piece] = self._piece(piece)
        return ids

    def _pieces(self, word: str) -> list[int]:
        if word.isalpha():
            return self._piece(word)
        if word[-1] in _ENDS and word[:-1].isalpha():
            return self._known(word[:-1]) + self._known(word[-1])
        out: list[int] = []
        for piece in _PIECES.findall(word):
            out += self._known(piece)
        return out

    def _here(self, word: str) -> bool:
        """Whether the word's pieces are found here as the library finds them."""
        if len(word) > 200 or not (word.isascii() and word.isprintable() or _PLAIN.fullmatch(word)):
            return False
        return word.isalpha() or not any(s in word for s in self.specials)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return array("I", self.ids(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = array("I", self._pieces(word.lower())).tobytes() if self._here(word) else self.whole(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.old, self.piece = {}, {}

    def show(self, binary: bytes) -> tuple[str, str]:
        """The ids as decimal text, and the tokens they stand for."""
        ids = np.frombuffer(binary, "<u4").tolist()
        decoded = " ".join([self.token[i] for i in ids]) if self.by_word else self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join([self.decimal[i] for i in ids]), decoded

    def words(self, text: str) -> list[str]:
        """What white space separates; the encoding of a text is that of its words in a row."""
        if _PLAIN.fullmatch(text):
            return (text if "<|" in text else text.lower()).split()
        return [w for w in _SPACE.split(text) if w]

    def binary(self, text: str | None) -> bytes:
        """The ids alone, without chunks."""
        if not text:
            return b""
        if not self.by_word:
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.words(text)))


def cuts(text: str, mean: int = CHUNK, shortest: int = SHORTEST, longest: int = LONGEST) -> list[int]:
    """Ends of the chunks of ``text`` in characters, from a rolling hash of its characters."""
    if len(text) <= shortest:
        return [len(text)]
    try:
        points = np.frombuffer(text.encode("latin-1"), dtype=np.uint8)
    except UnicodeEncodeError:
        wide = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        points = np.where(wide < 256, wide, wide % 251).astype(np.uint8)
    gear, rolled = _GEAR[points], np.zeros(len(points), dtype=np.uint32)
    for back in range(min(ROLL, len(gear))):
        rolled[back:] += gear[: len(gear) - back] << np.uint32(back)
    marks = np.flatnonzero((rolled >> np.uint32(8)) & np.uint32(mean - 1) == 0) + 1
    found, last = [], 0
    for at in [*marks.tolist(), len(text)]:
        while at - last > longest:
            last += longest
            found.append(last)
        if at - last >= shortest or at == len(text) > last:
            found.append(at)
            last = at
    return found


def _is_space(character: str) -> bool:
    return _SPACE.match(character) is not None


class _Chunk:
    """The ends of a chunk as written, some words beside them, and the encoding of all words between them."""

    __slots__ = ("count", "first", "last", "closing", "after", "before", "open_left", "open_right", "body")

    def __init__(self, encoder: WordEncoder, text: str):
        words = encoder.words(text)
        self.count, self.closing = len(words), words[-1] if words else ""
        self.open_left, self.open_right = not _is_space(text[0]), not _is_space(text[-1])
        written = _SPACE.split(text.strip(_SPACES)) if words else [""]
        self.first, self.last = written[0], written[-1]
        self.after, self.before = words[1:-1][:RIM], words[1:-1][-RIM:]
        self.body = b"".join([encoder[w] for w in words[1:-1]])


class ChunkEncoder:
    """Encode texts chunk by chunk; equal chunks of any documents are encoded once."""

    def __init__(self, path: str, most_chars: int = CHUNK_CHARS):
        self.encoder, self.known, self.held, self.most_chars = WordEncoder(path), {}, 0, most_chars
        self.encoded = self.reused = self.widened = 0

    def _chunk(self, text: str) -> _Chunk:
        found = self.known.get(text)
        if found is None:
            if self.held > self.most_chars:
                self.known.clear()
                self.held = 0
            found = self.known[text] = _Chunk(self.encoder, text)
            self.held += len(text)
            self.encoded += 1
        else:
            self.reused += 1
        return found

    def _repair(self, before: list[str], word: str, after: list[str]) -> bytes | None:
        """The ids of a word that a cut ran through, once its neighbours' ids agree; None if they never do."""
        reach = 1
        while True:
            left, right = before[-reach:], after[:reach]
            rim_left, rim_right = (b"".join([self.encoder[w] for w in side]) for side in (left, right))
            binary = self.encoder.whole(" ".join([*left, word, *right]))
            inner = len(binary) - len(rim_right)
            if inner >= len(rim_left) and binary.startswith(rim_left) and binary.endswith(rim_right):
                return binary[len(rim_left) : inner]
            if reach >= len(before) and reach >= len(after):
                return None
            reach *= 2
            self.widened += 1

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.encoder.by_word:
            return self.encoder.whole(text)
        out: list[bytes] = []
        before: list[str] = []
        pending: list[str] = []
        at = 0
        for end in cuts(text):
            chunk, at = self._chunk(text[at:end]), end
            if not chunk.count:
                if pending:
                    out.append(self.encoder["".join(pending)])
                pending = []
                continue
            through = bool(pending) and chunk.open_left
            if pending and not through:
                out.append(self.encoder["".join(pending)])
                pending = []
            pending.append(chunk.first)
            if chunk.count == 1 and chunk.open_right:
                continue
            word = "".join(pending)
            if through:
                fixed = self._repair(before, word, chunk.after)
                if fixed is None:
                    return self.encoder.whole(text)
                out.append(fixed)
            else:
                out.append(self.encoder[word])
            pending = []
            if chunk.count > 1:
                out.append(chunk.body)
                if chunk.open_right:
                    pending = [chunk.last]
                else:
                    out.append(self.encoder[chunk.closing])
            before = chunk.before
        if pending:
            out.append(self.encoder["".join(pending)])
        return b"".join(out)


_workers: dict[str, ChunkEncoder] = {}


def worker(path: str) -> ChunkEncoder:
    """This process's encoder; it outlives a task, and with it what it remembers."""
    if path not in _workers:
        _workers[path] = ChunkEncoder(path)
    return _workers[path]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker(path)
        for batch in slices(batches):
            binary = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            shown = [encoder.encoder.show(b) for b in binary]
            columns = [
                batch.column(0),
                pa.array([len(b) // 4 for b in binary], pa.int64()),
                pa.array([_digest(s[0]) for s in shown], pa.string()),
                pa.array([_digest(s[1]) for s in shown], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker(path)
        for batch in slices(batches):
            ids = [np.frombuffer(encoder.encode(t), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("ids", T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` from ``ids``, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker(path).encoder.tokenizer
        for batch in slices(batches):
            texts = [tokenizer.decode(i or [], skip_special_tokens=False) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, encoded.select("doc_id").schema.add("text", "string"))
