"""Byte-level BPE encoding and decoding.

Encoding splits a text into pre-tokens and merges each pre-token's symbols: a
priority queue holds merge candidates by rank and place, symbols are a doubly linked
list over arrays, and an entry whose symbols have changed since it was queued is
skipped when it comes up. Decoding concatenates the vocabulary's byte strings.
The vocabulary file is a parameter and is read where the work is done.

Defined results: null and empty texts encode to no ids and decode to an empty text;
ids need no padding or truncation; special strings of the vocabulary that occur in a
text become their ids, as in the file's own library. Rows and other columns are kept; a
column that has the name asked for the result is replaced by it. Texts of any length are whole;
an empty table gives no rows.

Memory: a worker holds the vocabulary, and words already encoded as packed bytes up to
``HELD_BYTES`` in each of two generations; texts are taken in slices bounded by bytes.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kerbside.llm.text import slices
from kerbside.ship import ship

#: The published pre-token pattern of this family of vocabularies. A fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space beside other white space: only then do pre-tokens depend on more than their own word.
_RUN = re.compile(r" (?:(?<=\s\s)|\s)")
#: A line end beside other white space.
_LINE_RUN = re.compile(r"\n(?:(?<=\s\s)|\s)")
#: Bytes of words and their ids held in each of two generations, and what Python takes for an entry besides.
HELD_BYTES, ENTRY_BYTES = 64 << 20, 200


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte, by the published rule: printable Latin-1 bytes stand for themselves."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    out = {chr(b): b for b in own}
    for i, b in enumerate(b for b in range(256) if b not in set(own)):
        out[chr(256 + i)] = b
    return out


def words_with_spaces(text: str) -> list[str]:
    """The text cut before each space, if all its spaces stand between two words; the pieces join to the text.

    Line ends that stand between two words are pieces too: they are pre-tokens of their own.
    """
    if "\x00" in text:
        first, *rest = text.split(" ")
        return [first, *[f" {w}" for w in rest]]
    if not _LINE_RUN.search(text):
        text = text.replace("\n", "\x00\n\x00")
    return text.replace(" ", "\x00 ").split("\x00")


class Held(dict):
    """Texts with their packed ids in two generations: a full young one becomes the old one, from which what is
    still asked for is put back. A generation is bounded in bytes."""

    def __init__(self, most: int = HELD_BYTES):
        super().__init__()
        self.most, self.size, self.old = most, 0, {}

    def put(self, key: str, value: bytes) -> None:
        if self.size >= self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0
        self[key] = value
        self.size += len(key) + len(value) + ENTRY_BYTES


class Vocabulary:
    """The byte strings of all ids: all that decoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self._read(json.load(f))

    def _read(self, spec: dict) -> None:
        symbols = byte_symbols()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(symbols[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        self.bytes_of |= {i: s.encode() for s, i in self.specials.items()}

    def decode(self, ids: bytes) -> str:
        """The text of ids; byte sequences that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.decode("utf-8", "replace")


class ByteBPE(Vocabulary):
    """A vocabulary with its merges; see the module's text."""

    def _read(self, spec: dict) -> None:
        super()._read(spec)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.first = [0] * 256
        for c, b in byte_symbols().items():
            self.first[b] = vocab[c]
        self.merges: dict[int, tuple[int, int]] = {}  # by left << 32 | right: rank, and what the two become
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self._split = regex.compile(PATTERN)
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self._held = Held()

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        n, merges = len(data), self.merges
        ids = [self.first[b] for b in data]
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            m = merges.get(ids[i] << 32 | ids[i + 1])
            if m:
                queue.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapify(queue)
        while queue:
            _, i, left, right, made = heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get(made << 32 | ids[k])
                if m:
                    heappush(queue, (m[0], i, made, ids[k], m[1]))
            h = before[i]
            if h >= 0:
                m = merges.get(ids[h] << 32 | made)
                if m:
                    heappush(queue, (m[0], h, ids[h], made, m[1]))
        return [x for x in ids if x >= 0]

    def _pretoken(self, p: str) -> bytes:
        """The packed ids of one pre-token; short ones are held."""
        out = self._held.get(p)
        if out is None:
            out = self._held.old.get(p)
            if out is None:
                out = array("I", self.merge(p.encode("utf-8", "surrogatepass"))).tobytes()
            if len(p) <= 64:
                self._held.put(p, out)
        return out

    def _word(self, word: str) -> bytes:
        """The packed ids of a word that isn't among those held last."""
        out = self._held.old.get(word)
        if out is None:
            cut = self._split.findall(word)
            if len(cut) == 1:
                return self._pretoken(word)
            out = b"".join(map(self._pretoken, cut))
        if len(word) <= 64:
            self._held.put(word, out)
        return out

    def _encode_plain(self, text: str) -> bytes:
        if _RUN.search(text):
            return b"".join(map(self._pretoken, self._split.findall(text)))
        # no pre-token reaches over the start of a space that stands between two words
        pieces = words_with_spaces(text)
        parts = list(map(self._held.get, pieces))
        if None in parts:
            word = self._word
            parts = [word(w) if x is None else x for w, x in zip(pieces, parts, strict=True)]
        return b"".join(parts)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out, at = [], 0
        if self._special is not None:
            for m in self._special.finditer(text):
                if m.start() > at:
                    out.append(self._encode_plain(text[at : m.start()]))
                out.append(np.array([self.specials[m[0]]], "<u4").tobytes())
                at = m.end()
        if at < len(text):
            out.append(self._encode_plain(text[at:] if at else text))
        return b"".join(out)


_loaded: dict[tuple[type, str], Vocabulary] = {}


def tokenizer(path: str, kind: type[Vocabulary] = ByteBPE) -> Vocabulary:
    """One vocabulary per Python worker; one with merges also serves for decoding."""
    if (ByteBPE, path) in _loaded:
        return _loaded[ByteBPE, path]
    if (kind, path) not in _loaded:
        _loaded.clear()
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def _mapped(docs: DataFrame, taken: str, made: list[tuple[str, T.DataType, pa.DataType]], work, keep: bool) -> DataFrame:
    """``docs`` with the columns that ``work`` makes of the values of ``taken``, which stays if ``keep``."""
    ship(docs.sparkSession)
    names = [n for n, _, _ in made]
    docs = docs.select(*[c for c in docs.columns if c not in names or c == taken])
    at = docs.columns.index(taken)
    stay = [i for i, c in enumerate(docs.columns) if (i != at or keep) and c not in names]
    fields = [docs.schema.fields[i] for i in stay] + [T.StructField(n, t) for n, t, _ in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = list(zip(*[work(x) for x in b.column(at).to_pylist()], strict=True))
            columns = [pa.array(c, kind) for c, (_, _, kind) in zip(out, made, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in stay), *columns], [f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as a binary column of little-endian unsigned 32-bit integers."""
    return _mapped(docs, text, [(ids, T.BinaryType(), pa.binary())], lambda t: (tokenizer(path).encode(t),), keep=True)


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with the text that their ids spell; null ids spell an empty text."""
    made = [(text, T.StringType(), pa.string())]
    return _mapped(tokens, ids, made, lambda x: (tokenizer(path, Vocabulary).decode(x or b""),), keep=True)


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both in one pass, with one Python worker a task: ``docs`` without ``text``, with its ids and what they spell."""

    def work(t: str | None) -> tuple[bytes, str]:
        bpe = tokenizer(path)
        packed = bpe.encode(t)
        return packed, bpe.decode(packed)

    return _mapped(docs, text, [(ids, T.BinaryType(), pa.binary()), (decoded, T.StringType(), pa.string())], work, keep=False)
