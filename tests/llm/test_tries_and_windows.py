"""Decontamination, the conversation trie and fill-in-middle against brute force, with the awkward cases in the tables."""

import collections
import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("kerbside.llm")

from pyspark.sql import functions as F  # noqa: E402

from kerbside.llm import conversation_trie, decontaminate, fill_in_middle  # noqa: E402
from kerbside.llm.scratch import Scratch  # noqa: E402

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- decontamination ----


def hits_by_hand(docs, items, window):
    of = collections.defaultdict(set)
    for i, t in items:
        w = PLAIN.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            of[tuple(w[k : k + window])].add(i)
    sizes, out = {len(x) for x in of}, []
    for d, t in docs:
        w, hit, held = PLAIN.findall((t or "").translate(LOWER)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in of:
                    hit |= set(range(k, k + n))
                    held |= of[x]
        out.append((d, len(w), len(hit), sorted(str(i) for i in held if i is not None)))
    return sorted(out, key=repr)


def item_cases():
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "été", "d4", "x", "É", "naïve", "zeta"])
    say = lambda n: " ".join(word() + rng.choice(["", ",", ".", "!"]) for _ in range(n))
    items = [(i, say(rng.randint(12, 25))) for i in range(12)]
    items += [(20, "Alpha"), (21, "x, x"), (22, "beta gamma: été d4"), (23, None), (24, ""), (25, " .,! "), (26, items[0][1]), (27, "p q " * 9), (3, "one of two texts of an item with ten words here"), (None, "no id but eleven words that are found in a document too")]
    docs = [(i, say(rng.randint(0, 120))) for i in range(40)]
    docs += [(100 + i, f"{say(9)} {t} {say(5)}") for i, (_, t) in enumerate(items) if t]
    docs += [(200, " ".join(items[1][1].upper().split()[:-1])), (201, items[2][1].replace(" ", "\n--\t")), (202, None), (203, ""), (204, "..."), (205, "p q " * 300), (206, (items[4][1] + " ") * 4)]
    docs += [(100, docs[3][1]), (100, docs[3][1]), (None, items[5][1]), (None, items[5][1]), (207, "y" * 300 + " " + "é" * 250), (208, "one of two texts of an item with ten words here")]
    return docs, [*items, (28, ("y" * 300 + " " + "é" * 250)), (5, items[5][1])]


@pytest.mark.parametrize(("window", "shingle", "most"), [(10, 5, 500_000), (10, 5, 7), (4, 5, 20), (13, 3, 500_000)])
def test_contamination(spark, window, shingle, most):
    docs, items = item_cases()
    left = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id long, text string, window string, key int").repartition(3)
    right = spark.createDataFrame([(*i, "b") for i in items], "item_id long, text string, words string").repartition(2)
    out = decontaminate.contamination(left, right, Scratch(spark, "t"), window=window, shingle=shingle, most_shingles=most)
    assert out.columns == ["doc_id", "n_words", "n_hit", "item_ids"]
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in out.collect()), key=repr)
    assert got == hits_by_hand(docs, items, window) and sum(x[2] > 0 for x in got) > 20


def test_contamination_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([(1, "some text of a document")], f"{i} long, text string") for i in ("doc_id", "item_id"))
    run = lambda d, i: decontaminate.contamination(d, i, Scratch(spark, "t")).collect()
    assert [tuple(r) for r in run(docs, items.limit(0))] == [(1, 5, 0, [])]
    assert run(docs.limit(0), items) == [] and [tuple(r) for r in run(docs, items)] == [(1, 5, 5, ["1"])]


def test_templates_are_asked_for_once(spark):
    """Items that differ in one word: candidates grow with what documents hold, not with the items of a template."""
    head, tail = "what is the name of the large city in", "and how many people live there"
    items = [(i, f"{head} land{i} {tail}") for i in range(300)]
    docs = [(i, f"{head} land{i * 7} {tail}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t"))
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in out.collect())
    assert got == sorted(hits_by_hand(docs, items, 10))


# ---- the trie ----


def trie_by_hand(rows, share, heads):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        donor = own.get(c - c % share if c >= 0 else c + (-c) % share, [])
        built[c] = tuple(donor[:h] + v[h:])
    members = collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(SPACED.findall(k[-1][1])) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(ends)))
    return sorted(out)


SCHEMA = "conv_id long, turn long, role string, text string, pos long, name string, depth int"


def conversations(n, seed=1, longest=9):
    rng = random.Random(seed)
    say = [f"{'word ' * i}t{i}" for i in range(4)]
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", say[0] if rng.random() < 0.6 else rng.choice(say)))
    return rows


def awkward():
    return [
        (500, None, "user", "no number"), (500, None, None, None), (500, 3, None, "x"), (500, 3, "a", "y"), (500, 3, "a", "y"), (500, 1, "u", ""),
        (501, 1, "u", "only"), (503, 7, "u", ""), (None, 1, "u", "nobody's"), (519, 0, "1", "2:x"), (518, 0, "12", ":x"),
        (10**15 + 7, 0, "user", "t0"), (10**15 + 8, 0, "user", "t0"), (521, -5, "user", "t0"), (521, 5, "user", "t0"), (540, 0, "é", "è à"),
    ]


def test_trie(spark):
    rows = conversations(130) + awkward()
    df = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], SCHEMA).repartition(5)
    out = conversation_trie.trie(df, Scratch(spark, "t"))
    got = sorted(tuple(r) for r in out.collect())
    assert got == trie_by_hand(rows, 20, 4) and len(got) > 300


def test_trie_of_long_conversations(spark, monkeypatch):
    """One conversation with most turns, in blocks of few turns and few ids; copies of it that end early."""
    monkeypatch.setattr(conversation_trie, "BLOCK", 8)
    monkeypatch.setattr(conversation_trie, "IDS", 4)
    long = [(0, t, "user", f"w{t % 3} " * (t % 4)) for t in range(150)]
    rows = long + [(c, t, "user", x) for c in (20, 40, 60) for _, t, _, x in long[: 37 + c]] + [(100 + c, 0, "user", "same") for c in range(60)]
    df = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in conversation_trie.trie(df, Scratch(spark, "t"), share=7, heads=3).collect())
    assert got == trie_by_hand(rows, 7, 3)


def test_trie_without_turns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_trie.trie(none, Scratch(spark, "t")).count() == 0
    nobody = spark.createDataFrame([(None, 1, "a", "b", 1, "n", 2)], SCHEMA)
    assert conversation_trie.trie(nobody, Scratch(spark, "t")).count() == 0
    # the donor has no turns and the conversation loses its only one: a member of the root alone
    left = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)
    one = spark.createDataFrame([(left, 1, "a", "b", 1, "n", 2)], SCHEMA)
    assert [tuple(r) for r in conversation_trie.trie(one, Scratch(spark, "t")).collect()] == [(left, 0, None, 1, 0, 1, 0, sha(str(left)))]


def test_numbers_are_dense(spark):
    keys = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("k"))
    got = [r["n"] for r in conversation_trie.numbered(keys, "n", Scratch(spark, "t")).collect()]
    assert sorted(got) == list(range(1000))


# ---- fill in the middle ----


def fim_by_hand(doc_id, text, rate, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    g = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(g[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), out, text


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 90)])
def test_fill_in_middle(spark, rate, spm):
    rng = random.Random(2)
    line = lambda: "".join(rng.choice(["a", "é", "😀", " ", "\r", "<", "<S", ">", " "]) for _ in range(rng.randint(0, 9)))
    docs = [(i, "\n".join(line() for _ in range(rng.randint(1, 30))).replace("<S>", "")) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "\n"), (103, "\n\n\nx"), (104, "a<P>b\nc"), (105, "x\n<M>"), (106, "<S>"), (107, "no end"), (108, "one\n"), (109, "z\n" * 5000)]
    docs += [(7, "other\ntext\n"), (7, docs[7][1]), (7, docs[7][1]), (None, "a\nb\nc\nd"), (None, "a\nb\nc\nd"), (None, None)]
    df = spark.createDataFrame([(*d, "mine", "own") for d in docs], "doc_id long, text string, n string, key string").repartition(4)
    out = fill_in_middle.transform(df, rate=rate, spm=spm)
    assert out.columns == ["doc_id", "text", "n", "key", "_n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    rows = out.collect()
    assert all(r["n"] == "mine" and r["key"] == "own" for r in rows)
    got = sorted(((r["doc_id"], r["_n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in rows), key=repr)
    assert got == sorted((fim_by_hand(*d, rate, spm) for d in docs), key=repr)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(df.limit(0)).count() == 0
