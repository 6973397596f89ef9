"""Substring dedup by repeated-phrase automata.

A window is ``window`` consecutive words of one document. Every word covered by a window
whose word sequence also starts anywhere else is removed.

1. Confirm. A window's anchor is the smallest hash among its ``anchor``-word sequences, so equal
   windows have equal anchors at equal places. All documents are read; consecutive windows with
   one anchor are a run, and runs go, packed into arrays, to shards by anchor. A shard compares only
   runs whose anchor others have too, and answers with each repeated window's documents
   and the smallest of them, which keeps the sequence's text for the others. Anchors
   that very many runs have are dealt by window instead, so no shard grows with them.
2. Compile. The kept passages are dealt into shards of at most about ``stream_words`` words of passages to
   search, fewer where that leaves tasks idle. A shard's passages are cut into blocks of ``(window + 1) // 2`` words, one of which
   lies whole in every window, and compiled into one Aho-Corasick automaton over exact words. A
   passage that more text than that has to meet is in as many shards as it needs.
3. Stream. The stretches of all documents that can hold an occurrence (those with a window that
   step 1 saw twice; equal windows have equal hashes, so there are no others) stream through their
   shard's automaton. Each hit is extended word by word, and what agrees on ``window`` words or more is
   an occurrence, whichever document keeps it. A window that lies in none met its
   keeper only by equal hashes; such windows are compared with each other by their exact
   words, so a false match hides no real one.
4. Remove. Occurrences are gathered by document and cut out.

Every shard is bounded: of runs by ``shard_windows`` windows on average, of passages by ``stream_words``. What is
sampled (rows, by a hash of their key) only says which anchors are dealt by window.

Defined results: null and empty texts have no words; documents of fewer words than a
window lose nothing; repeats within one document count; rows that share a ``doc_id``, or have none,
have keys of their own and are compared like all others; words are
joined by one space in what is left. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.scratch import Scratch
from kerbside.llm.text import U64, mix64, slices, window_hashes, words_of

RUN = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("at", "<i4"), ("n", "<i4")])


def runs_of(words: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of each run: anchor, first window, the anchor's place, number of windows; and the windows' 32-bit hashes."""
    whole = window_hashes(words, window)
    if not len(whole):
        empty = np.empty(0, np.int64)
        return np.empty(0, U64), empty, empty, empty, np.empty(0, np.uint32)
    h = window_hashes(words, anchor)
    span = window - anchor + 1
    at = np.empty(len(whole), np.int64)
    for lo in range(0, len(whole), 1 << 15):
        some = h[lo : lo + (1 << 15) + span - 1]
        at[lo : lo + (1 << 15)] = np.lib.stride_tricks.sliding_window_view(some, span).argmin(axis=1)
    at += np.arange(len(whole))
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(start, len(whole)))
    return h[at[start]], start, at[start], n, (whole >> U64(32)).astype(np.uint32)


def _anchors(window: int, anchor: int):
    """The anchor of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(runs_of(words_of(t), window, anchor)[0].view(np.int64))], ["anchor"])

    return run


def _hot_anchors(texts: DataFrame, window: int, anchor: int, runs: float, most: int) -> np.ndarray:
    """Anchors that more than about ``most`` runs have, sorted: at most ``2 * runs / most``, found in a sample of the rows."""
    rate = min(1.0, 80 / most)
    if runs < most:
        return np.empty(0, U64)
    some = texts.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    counts = some.select("text").mapInArrow(_anchors(window, anchor), "anchor long").groupBy("anchor").agg(F.count("*").alias("n"))
    hot = counts.filter(F.col("n") >= max(1, int(most * rate / 2))).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in hot], np.int64).view(U64))


def _single(head: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of hot anchors as runs of one window each, and which of the runs those are."""
    n = np.where(np.isin(head["anchor"], hot), head["n"], 1)
    out = np.repeat(head, n)
    alone = np.repeat(np.isin(head["anchor"], hot), n)
    out["start"] += (np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32) * alone
    out["n"][alone] = 1
    return out, alone


def _find(shards: int, window: int, anchor: int, hot: np.ndarray):
    """One row for each shard and slice of documents: the packed runs and their windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            heads, hashes = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, start, at, n, h = runs_of(words_of(t), window, anchor)
                if len(a):
                    head = np.empty(len(a), RUN)
                    head["anchor"], head["doc"], head["start"], head["at"], head["n"] = a, d, start, at, n
                    heads.append(head)
                    hashes.append(h)
            if not heads:
                continue
            head, h = np.concatenate(heads), np.concatenate(hashes)
            key = head["anchor"]
            first = np.cumsum(head["n"]) - head["n"]
            if len(hot):
                head, alone = _single(head, hot)
                first = np.cumsum(head["n"]) - head["n"]
                key = head["anchor"].copy()
                key[alone] ^= mix64(h[first[alone]].astype(U64) + U64(1))
            shard = (mix64(key) % U64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            head, shard, first = head[order], shard[order], first[order]
            n = head["n"].astype(np.int64)
            h = h[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            cuts = np.flatnonzero(np.diff(shard)) + 1
            lo, hi = np.concatenate([[0], cuts]), np.append(cuts, len(shard))
            ends = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard[lo]),
                    pa.array([head[x:y].tobytes() for x, y in zip(lo, hi, strict=True)], pa.binary()),
                    pa.array([h[ends[x] : ends[y]].tobytes() for x, y in zip(lo, hi, strict=True)], pa.binary()),
                ],
                ["shard", "runs", "hashes"],
            )

    return run


def repeated(head: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """``doc, first, last, keeper`` of the stretches of windows of one run that are repeated and have one keeper."""
    none = tuple(np.empty(0, np.int64) for _ in range(4))
    n = head["n"].astype(np.int64)
    first = np.cumsum(n) - n
    _, code, times = np.unique(head["anchor"], return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times[code] > 1)
    if not len(shared):
        return none
    head, n, first = head[shared], n[shared], first[shared]
    run = np.repeat(np.arange(len(head)), n)
    step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    h = h[first[run] + step]
    place = (head["at"] - head["start"]).astype(np.int64)[run] - step
    # windows are equal if anchor, its place in the window, and hash are
    key = mix64(head["anchor"][run] + place.astype(U64) * U64(0x9E3779B97F4A7C15)) & U64(0xFFFFFFFF00000000)
    key |= h.astype(U64)
    doc = head["doc"][run]
    order = np.lexsort((doc, key))
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    keeper, many = np.empty(len(run), np.int64), np.empty(len(run), bool)
    keeper[order] = doc[order][new][group]
    many[order] = sizes[group] > 1
    follows = np.zeros(len(run), bool)
    follows[1:] = (run[1:] == run[:-1]) & many[:-1] & (keeper[1:] == keeper[:-1])
    heads = np.flatnonzero(many & ~follows)
    if not len(heads):
        return none
    stretch = np.cumsum(many & ~follows)
    last = np.zeros(len(heads), np.int64)
    inside = np.flatnonzero(many)
    last[stretch[inside] - 1] = inside  # the last one written is the largest
    at = head["start"].astype(np.int64)[run] + step
    return doc[heads], at[heads], at[last], keeper[heads]


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by shard."""

    def made(parts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        head = np.concatenate([np.frombuffer(r, RUN) for r, _ in parts])
        h = np.concatenate([np.frombuffer(x, "<u4") for _, x in parts])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in repeated(head, h)], ["doc_id", "first", "last", "keeper"])

    shard, parts = None, []
    for b in batches:
        for k, r, h in zip(*(b.column(c) for c in ("shard", "runs", "hashes")), strict=True):
            if k.as_py() != shard:
                if parts:
                    yield made(parts)
                shard, parts = k.as_py(), []
            parts.append((r.as_py(), h.as_py()))
    if parts:
        yield made(parts)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _passages(window: int):
    """Documents with their repeated windows: the finished row of those without, text and passages of the others."""
    piece = pa.struct([("keeper", pa.int64()), ("first", pa.int64()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            n, texts, sha, pieces = [], [], [], []
            for t, hits in zip(b.column("text").to_pylist(), b.column("hits").to_pylist(), strict=True):
                words = words_of(t)
                n.append(len(words))
                texts.append(t if hits else None)
                sha.append(None if hits else _digest(words))
                own = []
                for x in sorted(hits or [], key=lambda x: (x["keeper"], x["first"])):
                    if own and own[-1][0] == x["keeper"] and x["first"] <= own[-1][2] + 1:
                        own[-1][2] = max(own[-1][2], x["last"])
                    else:
                        own.append([x["keeper"], x["first"], x["last"]])
                pieces.append(
                    [
                        {"keeper": k, "first": lo, "words": b" ".join(words[lo : hi + window]).decode("utf-8", "surrogatepass")}
                        for k, lo, hi in own
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string()), pa.array(pieces, pa.list_(piece))],
                ["doc_id", "id", "n_words", "kept_sha256", "text", "pieces"],
            )

    return run


class Phrases:
    """The automaton of one shard's kept passages."""

    def __init__(self, window: int):
        self.window, self.block = window, (window + 1) // 2
        self.letters: dict[bytes, int] = {}
        self.passages: list[tuple[int, int, np.ndarray]] = []  # keeping document, first word, words
        self.covered: list[np.ndarray] = []
        self.of: dict[int, dict[int, int]] = {}  # by keeping document and first word
        self.automaton = None

    def keep(self, keeper: int, first: int, words: list[bytes]) -> None:
        own = self.of.setdefault(keeper, {})
        if first in own:
            return
        own[first] = len(self.passages)
        letters = self.letters
        self.passages.append((keeper, first, np.array([letters.setdefault(w, len(letters) + 1) for w in words], np.int32)))
        self.covered.append(np.zeros(len(words), bool))

    def compile(self) -> None:
        blocks: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for s, (_, _, p) in enumerate(self.passages):
            for at in range(0, len(p) - self.block + 1, self.block):
                blocks.setdefault(tuple(p[at : at + self.block].tolist()), []).append((s, at))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, places in blocks.items():
            self.automaton.add_word(key, places)
        self.automaton.make_automaton()

    def locate(self, doc: int, keeper: int, first: int, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which words of a stretch of ``doc`` lie in an occurrence, and which windows lie whole in one; marks the kept
        words it agrees with. ``keeper`` is the document that step 1 named for it."""
        out, whole = np.zeros(len(words), bool), np.zeros(max(0, len(words) - self.window + 1), bool)
        if not self.automaton:
            return out, whole
        x = np.array([self.letters.get(w, 0) for w in words], np.int32)
        done: dict[tuple[int, int], int] = {}
        kept = self.of.get(keeper, {}).values()
        for end, places in self.automaton.iter(tuple(x.tolist())):
            start = end - self.block + 1
            for s, at in places:
                owner, base, p = self.passages[s]
                if owner == doc and base + at == first + start:
                    continue  # the stretch met itself
                if done.get((s, at - start), -1) >= end:
                    continue
                n = min(start, at)
                same = x[start - n : start][::-1] == p[at - n : at][::-1]
                left = n if same.all() else int(same.argmin())
                n = min(len(x) - start, len(p) - at)
                same = x[start : start + n] == p[at : at + n]
                right = n if same.all() else int(same.argmin())
                done[s, at - start] = start + right - 1
                if left + right >= self.window:
                    out[start - left : start + right] = True
                    whole[start - left : start + right - self.window + 1] = True
                    self.covered[s][at - left : at + right] = True
            if out.all() and (doc == keeper or whole.all()) and all(self.covered[s].all() for s in kept):
                break
        return out, whole


def _stretches(mask: np.ndarray, first: int) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    yield from ((int(a) + first, int(b) + first) for a, b in zip(edges[::2], edges[1::2], strict=True))


def _locate(window: int):
    """Over rows sorted by (shard, later): the stretches of words that occurrences cover, without ``words``; and
    the windows that lie in none, with theirs. The keeper's own are all kept, so theirs have met all that is equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, phrases, rows = None, None, []

        def close() -> None:
            if phrases is not None:
                for (owner, base, _), mask in zip(phrases.passages, phrases.covered, strict=True):
                    rows.extend((owner, a, z, None) for a, z in _stretches(mask, base))

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "lo", "hi", "words"])

        names = ("shard", "keeper", "later", "doc_id", "first", "words")
        for b in slices(batches):
            for shard, keeper, later, doc, first, text in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if shard != key:
                    close()
                    key, phrases = shard, Phrases(window)
                words = text.encode("utf-8", "surrogatepass").split()
                if not later:
                    phrases.keep(keeper, first, words)
                    continue
                if phrases.automaton is None:
                    phrases.compile()
                mask, whole = phrases.locate(doc, keeper, first, words)
                rows.extend((doc, a, z, None) for a, z in _stretches(mask, first))
                if doc != keeper:
                    for k in np.flatnonzero(~whole).tolist():
                        some = b" ".join(words[k : k + window]).decode("utf-8", "surrogatepass")
                        rows.append((doc, first + k, first + k + window, some))
            yield out()
            rows.clear()
        close()
        yield out()

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        removed, sha, kept = [], [], []
        for t, cuts in zip(b.column("text").to_pylist(), b.column("cuts").to_pylist(), strict=True):
            words = words_of(t)
            gone = np.zeros(len(words), bool)
            for c in cuts or []:
                gone[c["lo"] : c["hi"]] = True
            rest = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            removed.append(int(gone.sum()))
            sha.append(_digest(rest))
            kept.append(b" ".join(rest).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def _keyed(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``texts`` with ``row``, a key of each row's own: its ``doc_id`` where no other row has it."""
    once, none = texts.filter("doc_id is not null"), texts.filter("doc_id is null")
    shared = scratch.table(once.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "shared-ids")
    many = once.join(shared.hint("merge"), "doc_id", "left_semi").unionByName(none)
    once = once.withColumn("row", F.col("doc_id"))
    if shared.isEmpty() and none.isEmpty():
        return once
    once = once.join(shared.hint("merge"), "doc_id", "left_anti")
    many = scratch.table(many.withColumn("row", F.monotonically_increasing_id()), "shared-rows")
    # above or below all ids; ids that leave no room on either side can't be told from keys
    zero = F.lit(0).cast("long")
    ends = texts.agg(F.coalesce(F.min("doc_id"), zero), F.coalesce(F.max("doc_id"), zero)).first()
    most = many.agg(F.max("row")).first()[0]
    if ends[1] < 2**63 - 1 - most:
        many = many.withColumn("row", F.lit(ends[1] + 1) + F.col("row"))
    elif ends[0] > most - 2**63:
        many = many.withColumn("row", F.lit(ends[0] - 1) - F.col("row"))
    else:
        raise ValueError("no keys are left for the rows that share an id")
    return once.unionByName(many)


def remove_repeats(
    docs: DataFrame,
    scratch: Scratch,
    window: int = 35,
    anchor: int = 12,
    shard_windows: int = 1_000_000,
    stream_words: int = 100_000,
    hot_runs: int = 80_000,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept``; ``kept`` is null where nothing is removed."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(parts, math.ceil(size / 6 / shard_windows))
    texts = _keyed(texts, scratch)
    runs = 2 * size / 6 / (window - anchor + 2)  # a window's smallest of that many places changes twice in as many words
    hot = _hot_anchors(texts, window, anchor, runs, max(hot_runs, math.ceil(runs / 1_000_000)))  # at most 2,000,000
    packed = texts.select("row", "text").mapInArrow(_find(shards, window, anchor, hot), "shard long, runs binary, hashes binary")
    hits = (
        packed.repartition(shards, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_answer, "doc_id long, first long, last long, keeper long")
    )
    by_doc = hits.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "keeper")).alias("hits"))
    by_doc = by_doc.withColumnRenamed("doc_id", "of")
    named = texts.withColumnRenamed("doc_id", "id").withColumnRenamed("row", "doc_id")
    joined = named.join(by_doc.hint("merge"), named["doc_id"] == by_doc["of"], "left").drop("of")
    piece = "pieces array<struct<keeper: long, first: long, words: string>>"
    found = scratch.table(
        joined.mapInArrow(_passages(window), f"doc_id long, id long, n_words long, kept_sha256 string, text string, {piece}"), "found"
    )
    pieces = found.filter("text is not null").select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*")
    size_of = F.octet_length("words")
    weighed = scratch.table(
        pieces.groupBy("keeper").agg(F.sum(size_of).alias("bytes"), F.sum(F.when(F.col("doc_id") == F.col("keeper"), size_of)).alias("kept")), "weighed"
    )
    total = weighed.agg(F.sum("bytes")).first()[0] or 0
    # shards a few times as many as tasks, so that what one passage has to meet is spread; its own words are copied to each
    share = min(6 * stream_words, max(1, total // (2 * parts)))
    automata = max(parts, math.ceil(total / share))
    need = F.ceil(F.col("bytes") / F.greatest(F.lit(share), 4 * F.coalesce("kept", F.lit(0))))
    copies = weighed.select("keeper", need.cast("int").alias("copies"))
    dealt = pieces.join(copies.hint("merge"), "keeper")
    kept = dealt.filter("doc_id = keeper").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))))
    )
    streams = dealt.withColumn("copy", F.pmod(F.xxhash64("doc_id", "first"), F.greatest("copies", F.lit(1))).cast("int"))
    shard = F.pmod(F.xxhash64("keeper", "copy"), F.lit(automata)).alias("shard")
    columns = [shard, "keeper", "later", "doc_id", "first", "words"]
    located = (
        kept.withColumn("later", F.lit(0))
        .select(*columns)
        .unionByName(streams.withColumn("later", F.lit(1)).select(*columns))
        .repartition(min(automata, 4 * parts), "shard")
        .sortWithinPartitions("shard", "later")
        .mapInArrow(_locate(window), "doc_id long, lo long, hi long, words string")
    )
    located = scratch.table(located, "located")
    alone = located.filter("words is not null")
    again = alone.groupBy("words").agg(F.count("*").alias("n")).filter("n > 1").select("words")
    cuts = located.filter("words is null").drop("words").unionByName(
        alone.join(again.hint("merge"), "words", "left_semi").drop("words")
    )
    by_doc = cuts.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    by_doc = by_doc.withColumnRenamed("doc_id", "of")
    open_ = found.filter("text is not null").select("doc_id", "id", "n_words", "text")
    changed = (
        open_.join(by_doc.hint("merge"), open_["doc_id"] == by_doc["of"], "left")
        .select(F.col("id").alias("doc_id"), "n_words", "text", "cuts")
        .mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    )
    same = found.filter("text is null").select(
        F.col("id").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept")
    )
    return changed.unionByName(same)
