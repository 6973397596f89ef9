"""The training-data operators against brute force on small tables with the awkward cases in them."""

import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("kerbside.llm")

from kerbside.llm import (  # noqa: E402
    bpe,
    components,
    language,
    line_dedup,
    minhash,
    mixing,
    perfect_hash,
    phrase_automata,
    queries,
    subspace_join,
    token_files,
    vp_tree,
    warc,
)
from kerbside.llm.scratch import Scratch  # noqa: E402

WS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, f long, keeper long"


def corpus(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], len(t or ""), 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéAB") for _ in range(rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(60))
    line = "A shared line that is long enough"
    base = [" ".join(word() for _ in range(rng.randint(1, 200))) for _ in range(30)]
    near = [b + " tail end" for b in base[:6]]
    out = [*base, *near, base[0], base[0], base[1].upper(), None, "", " \t\n ", "x", "one two three", "one two  three"]
    out += [f"{b}\n{line}\n {line.upper()}\t\n{passage}" for b in base[10:16]]
    out += [passage, passage + " " + passage, "p q r s t " * 40, "é" * 20 + "\n" + "é" * 19, "é" * 20, "é" * 20 + " "]
    return out + [" ".join(word() for _ in range(30_000))]


def by_doc(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_line_dedup(spark, texts):
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    lines = {i: (t or "").split("\n") for i, t in enumerate(texts)}
    docs = collections.defaultdict(set)
    for i, ls in lines.items():
        for x in ls:
            if len(key(x)) >= 20:
                docs[key(x)].add(i)
    gone = lambda i, x: len(docs.get(key(x), ())) >= 3 and max(docs[key(x)]) != i
    want = {i: ("\n".join(x for x in ls if not gone(i, x)), len(ls), sum(gone(i, x) for x in ls)) for i, ls in lines.items()}
    out = line_dedup.drop_common_lines(corpus(spark, texts), Scratch(spark, "t"), shard_keys=2)
    assert by_doc(out, "text", "_n_lines", "_n_dropped") == want and sum(v[2] for v in want.values()) > 5


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    h = perfect_hash.PerfectHash.from_bytes(perfect_hash.PerfectHash.build(keys).to_bytes())
    assert sorted(h.lookup(keys).tolist()) == list(range(5000)) and h.lookup(keys + np.uint64(1)).max() < 5000
    assert perfect_hash.PerfectHash.build(keys[:0]).lookup(keys[:3]).tolist() == [-1, -1, -1]


def brute_components(sets, linked):
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


@pytest.mark.parametrize("tile", [512, 4])
def test_minhash(spark, texts, tile):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in enumerate(texts):
        w = WS.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0]
    root = brute_components(sets, linked)
    out = minhash.near_duplicates(corpus(spark, texts), Scratch(spark, "t"), tile_docs=tile)
    assert by_doc(out, "n_shingles", "component_id") == {i: (len(s), root[i]) for i, s in sets.items()} and len(linked) > 5
    kept = {r["doc_id"] for r in minhash.keep_one(corpus(spark, texts), Scratch(spark, "t")).collect()}
    assert kept == {i for i in sets if root[i] == i}


def test_phrases(spark, texts):
    words = {i: WS.findall(t or "") for i, t in enumerate(texts)}
    n = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    want = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if n[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    for settings in ({}, {"stream_words": 20, "shard_windows": 50}, {"hot_runs": 2, "stream_words": 500}):
        out = phrase_automata.remove_repeats(corpus(spark, texts), Scratch(spark, "t"), **settings)
        assert by_doc(out, "n_words", "n_removed", "kept_sha256") == want
    assert sum(v[1] for v in want.values()) > 500


def test_bpe_and_token_files(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.byte_bpe())
    odd = ["a\n \nb", "x<|endoftext|>y", "  two  spaces ", "don't we'll ½ ² 你好 　 x\xa0y \x1c", "\n\n", "﻿😀"]
    texts = [*texts, *odd]
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    flat = lambda x: np.array(x, "<u4").tobytes()
    docs = corpus(spark, texts)
    out = bpe.decode(bpe.encode(docs, queries.byte_bpe()), queries.byte_bpe())
    want = {i: (flat(x), library.decode(x, skip_special_tokens=False)) for i, x in ids.items()}
    assert {i: (bytes(a), b) for i, (a, b) in by_doc(out, "ids", "decoded").items()} == want
    manifest = token_files.write_token_files(docs, Scratch(spark, "t").path("f"), queries.byte_bpe(), 0, files=3)
    got = by_doc(token_files.read_token_files(spark, manifest, 50_257), "start", "ids")
    start = 0
    for i in range(len(texts)):
        assert (got[i][0], bytes(got[i][1])) == (start, flat([*ids[i], 0]))
        start += len(ids[i]) + 1


def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 12))
    near = base[:20] + 0.05 * rng.standard_normal((20, 12))
    rows = [(i * 10, v.tolist()) for i, v in enumerate([*base, *near, base[0], base[0], base[3] * 1e-30, base[4] * 1e30])]
    bad = [None, [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 2.0]]
    rows += [(100_000 + i * 100, v) for i, v in enumerate(bad)]
    return rows, spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, tile int").repartition(3)


def test_subspace_join(spark):
    rows, df = vectors(spark)
    good = [(i, np.array(v)) for i, v in rows if i < 100_000]
    unit = [(i, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())) for i, v in good]
    linked = [(a, b) for a, x in unit for b, y in unit if a != b and x @ y >= 0.9]
    root = brute_components(dict(rows), linked)
    n = collections.Counter(a for a, _ in linked)
    for settings in ({}, {"tile_floats": 100, "block": 5}):
        out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in subspace_join.near_duplicates(df, Scratch(spark, "t"), **settings).collect()}
        assert out == {i: (n[i], root[i]) for i, _ in rows}
    assert len(linked) > 40
    again = subspace_join.near_duplicates(df.union(df.filter("vec_id < 100")), Scratch(spark, "t"), tile_floats=200)
    assert {r["vec_id"]: r["component_id"] for r in again.collect()} == root
    assert subspace_join.near_duplicates(df.limit(0), Scratch(spark, "t")).count() == 0


def test_vp_tree(spark):
    rows, df = vectors(spark)
    good = [(i, np.array(v)) for i, v in rows if i < 100_000]
    want = {}
    for q, x in good:
        if q % 100 == 0:
            near = sorted((float(np.linalg.norm(x - y)), i) for i, y in good if i != q)[:10]
            want[q] = [i for _, i in near]

    def run(relax):
        out = vp_tree.nearest(df.filter("vec_id % 100 = 0"), df, Scratch(spark, "t"), relax=relax, shard_rows=20).collect()
        got = collections.defaultdict(list)
        for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
            got[r["query_id"]].append(r["vec_id"])
        return got

    assert run(1.0) == want
    loose = run(1.3)
    assert sum(len(set(loose[q]) & set(v)) for q, v in want.items()) >= 0.9 * sum(map(len, want.values()))
    assert vp_tree.nearest(df.limit(0), df.limit(0), Scratch(spark, "t")).count() == 0


def test_vp_tree_recall_when_relaxed():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 6))
    ids = np.arange(3000)
    tree = vp_tree.VPTree(ids, x)
    exact, _ = tree.search(ids[:50], x[:50], 10, 1.0)
    loose, _ = tree.search(ids[:50], x[:50], 10, 1.5)
    d = np.linalg.norm(x[:50, None] - x[None], axis=2)
    d[np.arange(50), np.arange(50)] = np.inf
    assert (exact == np.argsort(d, axis=1)[:, :10]).all()
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, loose, strict=True)]) >= 0.9


def test_warc(spark):
    pages = [(3, "u", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "a\r\nb", ""), (5, "u", None), (4, "u", "x" * 300_000), (6, "u", "<p>é</p>"), (None, "u", "z")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, payload string")
    scratch = Scratch(spark, "t")
    archives = warc.write_archives(df, scratch.path("w"), scratch)
    rows = {r["page_id"]: r for r in warc.read_archives(spark, archives).collect()}
    for i, _, html in pages[:-1]:
        data = (html or "").encode()
        first = min(p for p, _, h in pages[:-1] if (h or "") == (html or ""))
        r = rows[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), warc.sha1_base32(data))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", first))
        assert r["payload"] == ((html or "") if first == i else None)
    empty = warc.write_archives(df.limit(0), scratch.path("e"), scratch)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_faults():
    good = warc.record_bytes(1, "u", b"abc", warc.sha1_base32(b"abc"), None)
    assert warc.parse_record(good, "t")[0] == 1
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"abc", b"abd"), good.replace(b"X-Page-Id", b"X-Other")):
        with pytest.raises(ValueError):
            warc.parse_record(bad, "t")
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(b"\x28\xb5\x2f\xfd" * 4), "t"))


def water_levels(sizes, weights, cap):
    target, fixed = {}, set()
    while True:
        spare = sum(sizes.values()) - sum(cap * sizes[s] for s in fixed)
        rest = sum(weights[s] for s in sizes if s not in fixed)
        target = {s: cap * sizes[s] if s in fixed else spare * weights[s] / rest for s in sizes}
        over = {s for s in sizes if target[s] > cap * sizes[s] + 1e-9} - fixed
        if not over:
            return target
        fixed |= over


def test_mixing(spark, texts):
    many = [t for t in texts if t is None or len(t) < 5000] * 30
    sources = ["b", None, "a", "b", "b", "é", "b", "Z"]
    docs = corpus(spark, many, sources)
    size = {i: len(WS.findall(t or "")) for i, t in enumerate(many)}
    of = {i: sources[i % len(sources)] for i in size}
    total = collections.Counter()
    for i, n in size.items():
        total[of[i]] += n
    order = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weights = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    want = water_levels(total, weights, 3)
    rows = mixing.decisions(docs, Scratch(spark, "t")).collect()
    assert len(rows) == len(many)
    taken = collections.Counter()
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[of[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[of[r["doc_id"]]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 20 for s in total)
    again = mixing.decisions(docs.repartition(5), Scratch(spark, "t")).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)
    mixed = mixing.mix(docs, Scratch(spark, "t"))
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.decisions(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op6_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and sum(r["rejected"] for r in out) <= 5
    model = language.fit(docs)
    odd = corpus(spark, [None, "", "123 !!", "你好", "the and of"])
    seen = by_doc(language.predict(odd, model), "lang_pred", "score")
    assert seen[0] == seen[1] == seen[2] == ("und", 0.0) and seen[3][0] in model.languages and 0 <= seen[4][1] <= 1
    none = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert by_doc(language.predict(odd, none), "lang_pred")[4] == ("und",)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(400, 500)]
    root = brute_components({i: i for e in edges for i in e}, edges)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert {r["node"]: r["component"] for r in got.collect()} == root


def test_empty_tables(spark):
    empty = corpus(spark, ["x"]).limit(0)
    s = lambda: Scratch(spark, "t")
    assert line_dedup.drop_common_lines(empty, s()).count() == 0
    assert minhash.near_duplicates(empty, s()).count() == 0
    assert phrase_automata.remove_repeats(empty, s()).count() == 0
    assert bpe.encode(empty, queries.byte_bpe()).count() == 0
    manifest = token_files.write_token_files(empty, s().path("f"), queries.byte_bpe())
    assert token_files.read_token_files(spark, manifest, 50_257).count() == 0
