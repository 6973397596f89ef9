"""Token-ID output: flat files of unsigned integers with 64-bit document offsets.

Documents are range-partitioned by ``doc_id`` and sorted; a range is written in ascending
order to files of about ``file_bytes`` each, and read back by ranges of bytes that the
offsets name. A file pair is

* ``NNNNN-NNNNN.bin`` (range, number): the ids, little-endian, 16-bit if the vocabulary allows, else 32-bit;
* ``NNNNN-NNNNN.idx``: 64-bit little-endian integers: the number of documents n, then n
  ``doc_id`` values, then n + 1 offsets (in ids) of the documents within the file.

A file's base, the number of ids in the files before it, is the prefix sum of the
files' totals; only one row a file reaches the driver. Files are written under a
name of the attempt's own and renamed, so a repeated task leaves the same files.

Defined results: a null or empty text is the end id alone; an empty table gives no
file; rows that share a ``doc_id`` are documents of their own, in the order of
their texts, and each comes back; texts of any length are whole.
"""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.bpe import _LINE_RUN, _RUN, ENTRY_BYTES, Held
from kerbside.llm.text import slices
from kerbside.ship import ship

MANIFEST = "part int, number int, path string, documents long, ids long"


#: Ids read back at a time.
MOST_IDS = 1 << 20
#: A line end, and what it becomes before a text is cut at its spaces.
_CUT, _SPACED = "\n", " \n"
#: How the tokens of a byte-level vocabulary that begin with a space or a line end are spelled.
_SPACE_TOKEN, _LINE_TOKEN = "\u0120", "\u010a"
#: Marks that often end a word; none is a letter, a number or white space.
_MARKS = ".,;:!?$&%*#)"
#: Words that the library is asked for at a time; what it makes of so few stays in the processor's cache.
_TOGETHER = 100
#: Texts encoded at a time: the more, the fewer words are looked for twice. ``slices`` bounds their bytes besides.
_ROWS = 2000


class LibraryEncoder:
    """The tokenizers library, asked once for each word that is held.

    In a text whose spaces and line ends all stand between two words, no pre-token of a
    byte-level vocabulary reaches over the start of a space or over a line end, so words
    are encoded on their own and joined; any other text goes to the library whole.
    Words are told apart and joined by Arrow, many texts at a time, and only distinct ones are looked for.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words = Held(80 << 20)
        cut = self.library.encode(_CUT, add_special_tokens=False).ids
        self.line = np.array(cut, self.kind).tobytes()
        vocabulary = self.library.get_vocab()
        #: Whether an id begins with a space or is a line end.
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token[:1] == _SPACE_TOKEN or token == _LINE_TOKEN]] = True
        # words that are asked for together must not become one of these
        self.together = cut == [vocabulary.get(_LINE_TOKEN)] and not any(c.isspace() for s in self.specials for c in s)

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of words as they follow others in a text, after a space or the line end they begin with.

        They hold no other white space, so each begins with the only id of its own that begins with a space or is a
        line end: the library is asked for many at once and the answer is cut before those ids.
        """
        out: list[bytes] = []
        for at in range(0, len(words), _TOGETHER):
            some = f" {' '.join(words[at : at + _TOGETHER])}".replace(_SPACED, _CUT)
            ids = np.array(self.library.encode_batch_fast([some], add_special_tokens=False)[0].ids, self.kind)
            ends = np.append(np.flatnonzero(self.begins[ids]), len(ids)) * ids.itemsize
            data, (lo, *rest) = ids.tobytes(), ends.tolist()
            for hi in rest:
                out.append(data[lo:hi])
                lo = hi
        return out

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces of any kind."""
        # printable: no white space
        plain = [w for w in pieces if w and (w[1:] if w[0] == _CUT else w).isprintable() and w != _CUT] if self.together else []
        made = dict(zip(plain, self._word_ids(plain), strict=True))
        rest = [w for w in pieces if w not in made]
        own = self._ids([w[1:] if w[:1] == _CUT else f" {w}" for w in rest]) if rest else []
        made.update((w, self.line + x if w[:1] == _CUT else x) for w, x in zip(rest, own, strict=True))
        return [made[w] for w in pieces]

    def _learn(self, new: list[str]) -> list[bytes]:
        """Hold and return the ids of distinct pieces: a word stands for itself after a space, a line end and a word for the two of them."""
        held, old = self.words, self.words.old
        found: list[bytes | None] = list(map(old.get, new)) if old else [None] * len(new)
        held.update((w, x) for w, x in zip(new, found, strict=True) if x is not None)
        letters = [k for k, x in enumerate(found) if x is None and new[k].isalpha()]
        words = [new[k] for k in letters]
        ids = self._word_ids(words) if self.together else self._piece_ids(words)
        held.update(zip(words, ids, strict=True))
        for k, x in zip(letters, ids, strict=True):
            found[k] = x
        ask: dict[str, bytes] = {}
        tails: dict[str, bytes] = {}
        marked: list[tuple[int, str, str]] = []
        for k, x in enumerate(found):
            if x is not None:
                continue
            # marks after a letter or number are pre-tokens of their own
            w = new[k]
            base = w.rstrip(_MARKS)
            tail = w[len(base) :] if base[-1:].isalnum() else ""
            if not tail:
                base = w
            marked.append((k, base, tail))
            tails[tail] = b""
            if not tail or base not in held:
                ask[base] = b""
        ask = dict(zip(ask, self._piece_ids(list(ask)), strict=True))
        tails = dict(zip(tails, self._ids(list(tails)), strict=True))
        for k, base, tail in marked:
            known = ask.get(base)
            x = held[base] if known is None else known
            found[k] = held[new[k]] = x + tails[tail]
        held.size += sum(map(len, new)) + sum(map(len, found)) + ENTRY_BYTES * len(new)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes of ``kind``."""
        # nothing made here is part of a cycle, and each search for cycles goes through all words that are held
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        cut: list[int] = []
        whole: list[int] = []
        for i, t in enumerate(texts):
            if t:
                (whole if _RUN.search(t) or _LINE_RUN.search(t) or any(s in t for s in self.specials) else cut).append(i)
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = ids
        if cut:
            # the first word is asked for as if a line end stood before it
            lines = pa.array([f"{_CUT}{texts[i].replace(_CUT, _SPACED)}" for i in cut], pa.large_string())
            ids, ends = self._joined(pc.split_pattern(lines, " "))
            skip, lo = len(self.line), 0
            for i, hi in zip(cut, ends, strict=True):
                out[i] = ids[lo + skip : hi]
                lo = hi
        return out

    def _joined(self, pieces: pa.ListArray) -> tuple[bytes, list[int]]:
        """The ids of all lists of pieces, one after another, and where each list ends in them."""
        held = self.words
        if held.size > held.most:
            held.old = dict(held)
            held.clear()
            held.size = 0
        coded = pieces.flatten().dictionary_encode()
        # pieces hold no space; one string to cut is made sooner than many
        all_words = pa.LargeListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int64()), coded.dictionary)
        words = pc.binary_join(all_words, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        found = list(map(held.get, words))
        if None in found:
            at = [k for k, x in enumerate(found) if x is None]
            for k, x in zip(at, self._learn([words[k] for k in at]), strict=True):
                found[k] = x
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, places, data = ids.buffers()
        ends = np.frombuffer(places, "<i8")[pieces.offsets.to_numpy()[1:]]
        return (data.to_pybytes() if data else b""), ends.tolist()


_loaded: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _loaded:
        _loaded[path] = LibraryEncoder(path)
    return _loaded[path]


def _put(folder: str, name: str, write) -> str:
    """Write under a name of our own, then rename."""
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    own, final = f"{base}/.{name}-{uuid.uuid4().hex}", f"{base}/{name}"
    with store.open_output_stream(own) as out:
        write(out)
    store.move(own, final)
    return final


def _writer(folder: str, path: str, end_id: int, file_bytes: int):
    """Sorted rows to files, one after another; a row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = _encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder.kind).tobytes()
        width = len(end)
        rows = slices(batches, rows=_ROWS)
        b = next(rows, None)
        while b is not None:
            docs, lengths = [], []

            def ids(out) -> None:
                nonlocal b
                size = 0
                while b is not None and size < file_bytes:
                    docs.append(b.column(0).to_numpy().copy())  # noqa: B023
                    found = encoder.encode(b.column(1).to_pylist())
                    lengths.extend([len(x) // width + 1 for x in found])  # noqa: B023
                    data = b"".join([y for x in found for y in (x, end)])
                    out.write(data)
                    size, b = size + len(data), next(rows, None)

            name = f"{part:05d}-{number:05d}"
            _put(folder, f"{name}.bin", ids)
            ends, d = np.cumsum(np.array([0, *lengths], "<i8")), np.concatenate(docs)
            index = [np.array([len(d)], "<i8").tobytes(), d.astype("<i8").tobytes(), ends.tobytes()]
            _put(folder, f"{name}.idx", lambda out: out.write(b"".join(index)))  # noqa: B023
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([f"{folder}/{name}"]),
                    pa.array([len(d)]), pa.array([int(ends[-1])]),
                ],
                ["part", "number", "path", "documents", "ids"],
            )
            number += 1

    return run


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, files: int | None = None, file_bytes: int = 1 << 30
) -> DataFrame:
    """Write ``docs(doc_id, text)`` below ``folder``; the manifest ``part, number, path, documents, ids, base``.

    ``files`` ranges of ids are written side by side; a range's file is closed at ``file_bytes`` and the next begun.

    ``folder`` is a URI in a store that all executors reach. The call writes; what it returns is small.
    """
    spark = docs.sparkSession
    ship(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .filter("doc_id is not null")
        .repartitionByRange(files, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    rows = sorted(dealt.mapInArrow(_writer(folder, tokenizer, end_id, file_bytes), MANIFEST).collect(), key=lambda r: (r["part"], r["number"]))
    base, out = 0, []
    for r in rows:
        out.append((*r, base))
        base += r["ids"]
    return spark.createDataFrame(out, MANIFEST + ", base long")


def _open(path: str) -> pa.NativeFile:
    """A file to read ranges of: mapped where the store is a local folder."""
    store, base = fs.FileSystem.from_uri(path)
    return pa.memory_map(base) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(base)


def _reader(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                with _open(f"{path}.idx") as index_file, _open(f"{path}.bin") as id_file:
                    index = np.frombuffer(index_file.read_buffer(), "<i8")
                    n, width = int(index[0]), np.dtype(kind).itemsize
                    docs, ends = index[1 : n + 1], index[n + 1 :]
                    if len(ends) != n + 1 or id_file.size() != ends[-1] * width:
                        raise ValueError(f"{path}: {id_file.size()} bytes, {len(ends)} offsets; the index says {ends[-1]} ids of {width}")
                    at = 0
                    while at < n:
                        # about a million ids at a time, or one longer document
                        stop = int(np.searchsorted(ends, ends[at] + MOST_IDS, side="right")) - 1
                        stop = min(max(stop, at + 1), at + 1000, n)
                        id_file.seek(int(ends[at]) * width)
                        some = np.frombuffer(id_file.read_buffer(int(ends[stop] - ends[at]) * width), kind).astype("<u4")
                        places = ((ends[at : stop + 1] - ends[at]) * 4).astype("<i4")
                        flat = pa.BinaryArray.from_buffers(
                            pa.binary(), stop - at, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(some.tobytes())]
                        )
                        starts = pa.array(ends[at:stop] + base)
                        yield pa.RecordBatch.from_arrays([pa.array(docs[at:stop]), starts, flat], ["doc_id", "start", "ids"])
                        at = stop

    return run


def read_token_files(spark: SparkSession, manifest: DataFrame, vocabulary: int) -> DataFrame:
    """``doc_id, start, ids`` of every document; ids as little-endian unsigned 32-bit integers."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    parts = max(1, manifest.count())
    dealt = manifest.select("path", "base").repartitionByRange(parts, "path")
    return dealt.mapInArrow(_reader(kind), "doc_id long, start long, ids binary")
