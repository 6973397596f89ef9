"""Conversation prefix trie by prefix doubling.

Turns get dense numbers; in each round two neighbouring blocks of a conversation become one of twice the size, whose
name is the dense number of the pair of names. After ``log2`` rounds every aligned block of a power of two of turns
has a name. A prefix of ``d`` turns is such blocks in the order of the bits of ``d``: the name of a prefix is the
dense number of (the prefix without its last block, its last block), in as many rounds as a depth has bits. Prefixes
with equal names are one node. Rows halve from round to round, and no step runs along a conversation turn by turn.

A node is known by its depth and its smallest member. Along a conversation, the nodes it is the smallest member of are
the last ones, so a sum over a subtree is the sum, over the members of its top, of what each member's own nodes from
there on hold. Positions and sums within a conversation go over blocks of turns, so that a conversation with a third of all
turns is many tasks' work; digests of member ids are fed in blocks of ids, in order.

Defined results: rows without a ``conv_id`` belong to no conversation and take no part; null roles and texts are empty;
turns of one number, and those without (which come first), are ordered by role and text; repeated rows are as many turns.
A conversation without turns left is a member of the root alone. An empty table gives no node. Extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.functions.order import running
from kerbside.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a conversation, and ids of members, that are handled together.
BLOCK, IDS = 4096, 4096
_LOW = (1 << 33) - 1


def numbered(keys: DataFrame, out: str, scratch: Scratch) -> DataFrame:
    """``keys`` (distinct rows) with dense numbers from 0: places within written parts, after the parts before."""
    dealt = keys.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW)))
    dealt = scratch.table(dealt, "dealt")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    base = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # one row a part
    return dealt.join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def named(rows: DataFrame, keys: list[str], out: str, scratch: Scratch) -> DataFrame:
    """``rows`` with the dense number of their ``keys`` (none null), written."""
    names = scratch.table(numbered(rows.select(*keys).distinct(), out, scratch), "names")
    return scratch.table(rows.join(names.hint("merge"), keys), f"named-{out}")


def turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, pos`` (from 0)``, digest, words``: turns in order, without a task that sorts a whole conversation."""
    text, role = (F.coalesce(c, F.lit("")) for c in ("text", "role"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.lit(1).alias("one")
    )
    # rows alike in all of these are interchangeable; a number keeps them apart
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    rows = running(rows, ["conv_id", "turn", "role", "text", "row"], "one", "before", scratch)
    rows = rows.select(
        "conv_id",
        "before",
        F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words"),
    )
    rows = scratch.table(rows, "ordered")
    first = rows.groupBy("conv_id").agg(F.min("before").alias("first"))
    rows = rows.join(first.hint("merge"), "conv_id").withColumn("pos", (F.col("before") - F.col("first")).cast("long"))
    return scratch.table(rows.select("conv_id", "pos", "digest", "words"), "turns")


def rebuilt(turned: DataFrame, share: int, heads: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``conv_id, at, name, words`` of every rebuilt turn, and ``conv_id, length`` of every conversation.

    The first ``crc32(conv_id) % heads`` turns of a conversation come from the conversation whose id is the next lower
    multiple of ``share``, as far as it has them.
    """
    turned = named(turned, ["digest"], "name", scratch).select("conv_id", "pos", "name", "words")
    own = turned.groupBy("conv_id").agg(F.count("*").alias("turns"))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads))
    own = scratch.table(own.withColumn("head", head).withColumn("donor", F.col("conv_id") - F.col("conv_id") % share), "conversations")
    donors = own.filter(F.col("conv_id") == F.col("donor")).select("donor", F.col("turns").alias("given"))
    convs = own.join(donors, "donor", "left").withColumn("given", F.least(F.coalesce("given", F.lit(0)), "head"))
    kept = F.greatest(F.col("turns") - F.col("head"), F.lit(0))
    convs = scratch.table(convs.withColumn("length", F.col("given") + kept), "lengths")

    block = F.floor(F.col("pos") / BLOCK)
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("turns") - 1) / BLOCK)))
    spread = convs.select("conv_id", "head", "given", blocks.alias("block"))  # a row for each block of turns
    tail = (
        turned.withColumn("block", block)
        .join(spread, ["conv_id", "block"])
        .filter(F.col("pos") >= F.col("head"))
        .select("conv_id", (F.col("pos") - F.col("head") + F.col("given")).alias("at"), "name", "words")
    )
    lent = turned.filter((F.col("pos") < heads) & (F.col("conv_id") % share == 0)).withColumnRenamed("conv_id", "donor")
    front = convs.filter("given > 0").select("conv_id", "donor", F.explode(F.sequence(F.lit(0), F.col("given") - 1)).alias("pos"))
    front = front.join(lent, ["donor", "pos"]).select("conv_id", F.col("pos").alias("at"), "name", "words")
    return scratch.table(tail.unionByName(front), "rebuilt"), convs.select("conv_id", "length")


def _blocks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, level, at, name``: names of all aligned blocks of ``2**level`` turns, by doubling."""
    level, block = 0, rows.select("conv_id", "at", "name")
    out = [block.withColumn("level", F.lit(0))]
    while True:
        odd = F.col("at") % 2 == 1
        pairs = (
            block.groupBy("conv_id", F.floor(F.col("at") / 2).alias("at"))
            .agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b"))
            .filter("b is not null")
        )
        pairs = scratch.table(pairs, "pairs")
        if pairs.isEmpty():
            return reduce(DataFrame.unionByName, out)
        level += 1
        block = named(pairs, ["a", "b"], "name", scratch).select("conv_id", "at", "name")
        out.append(block.withColumn("level", F.lit(level)))


def prefixes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, depth, name``: the node of every prefix of every conversation."""
    size = F.expr("shiftleft(1L, level)")
    # the last block of the prefix that it ends is at an even place among those of its size, and each prefix has one
    last = _blocks(rows, scratch).filter(F.col("at") % 2 == 0)
    last = last.select(
        "conv_id",
        ((F.col("at") + 1) * size).alias("depth"),
        (F.col("at") * size).alias("rest"),
        F.col("name").alias("block"),
        F.bit_count("at").alias("round"),
    )
    last = scratch.table(last, "last-blocks")
    most = last.agg(F.max("round")).first()[0]
    out, done = [], None
    for k in range((-1 if most is None else most) + 1):
        mine = last.filter(F.col("round") == k)
        if done is None:
            pairs = mine.withColumn("before", F.lit(-1).cast("long"))
        else:
            ends = done.select("conv_id", F.col("depth").alias("rest"), F.col("name").alias("before"))
            pairs = mine.join(ends, ["conv_id", "rest"])
        pairs = scratch.table(pairs.select("conv_id", "depth", "before", "block"), "pairs")
        done = named(pairs, ["depth", "before", "block"], "name", scratch).select("conv_id", "depth", "name")
        out.append(done)
    if not out:
        return last.select("conv_id", "depth", F.col("block").alias("name"))
    return reduce(DataFrame.unionByName, out)


def _summed_from(rows: DataFrame, columns: list[str], scratch: Scratch) -> DataFrame:
    """``rows(conv_id, depth, ...)`` with each column replaced by its sum over the conversation's rows from there on."""
    blocked = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    sums = blocked.groupBy("conv_id", "block").agg(*[F.sum(c).alias(f"all_{c}") for c in columns])
    later = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(f"all_{c}").over(later), F.lit(0)).alias(f"all_{c}") for c in columns])
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc())
    run = blocked.select("conv_id", "block", *[c for c in rows.columns if c not in {"conv_id", *columns}], *[F.sum(c).over(inside).alias(c) for c in columns])
    joined = run.join(sums.hint("merge"), ["conv_id", "block"])
    return joined.select(*[(F.col(c) + F.col(f"all_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns])


def _hash_parts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of ids that arrive in blocks, sorted by node and first id; one block is held at a time."""
    node, digest = None, None
    for frame in parts:
        out = []
        for depth, name, ids in zip(frame["depth"], frame["name"], frame["ids"], strict=True):
            if (depth, name) != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (depth, name), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["depth", "name", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=["depth", "name", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """``depth, name, ends_sha256`` of ``ends(depth, name, conv_id)``: ids ascending, joined by commas."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = ends.groupBy("depth", "name", F.floor(F.col("conv_id") / IDS).alias("block")).agg(ids.alias("ids"))
    dealt = blocks.repartition("depth", "name").sortWithinPartitions("depth", "name", "block")
    return dealt.select("depth", "name", "ids").mapInPandas(_hash_parts, "depth long, name long, ends_sha256 string")


def trie(conversations: DataFrame, scratch: Scratch, share: int = 20, heads: int = 4) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations of ``conversations(conv_id, turn, role, text)``.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: a node is its smallest
    member and its depth; ``n_leaves`` and ``saved_tokens`` are sums over its subtree.
    """
    rows, convs = rebuilt(turns(conversations, scratch), share, heads, scratch)
    names = prefixes(rows, scratch)
    words = rows.select("conv_id", (F.col("at") + 1).alias("depth"), "words")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("words"))
    paths = scratch.table(names.join(words, ["conv_id", "depth"]).select("conv_id", "depth", "name", "words").unionByName(root), "paths")

    nodes = paths.groupBy("depth", "name").agg(F.min("conv_id").alias("first"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    nodes = scratch.table(nodes, "nodes")
    above = paths.select(F.col("conv_id").alias("first"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("up"))
    linked = scratch.table(nodes.join(above, ["first", "depth"], "left"), "linked")
    children = linked.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("name")).agg(F.count("*").alias("n_children"))
    linked = scratch.table(linked.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")

    worth = linked.select(
        F.col("first").alias("conv_id"),
        "depth",
        F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    held = paths.select("conv_id", "depth", "name").join(worth, ["conv_id", "depth"], "left").na.fill(0, ["n_leaves", "saved_tokens"])
    summed = _summed_from(held, ["n_leaves", "saved_tokens"], scratch).groupBy("depth", "name")
    summed = scratch.table(summed.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "subtrees")

    ends = convs.select("conv_id", F.col("length").alias("depth")).join(paths.select("conv_id", "depth", "name"), ["conv_id", "depth"])
    ends = scratch.table(_ends(ends), "ends")
    parents = linked.select(F.col("depth") + 1, "name", "first").toDF("depth", "up", "parent_conv_id")
    full = linked.join(summed, ["depth", "name"]).join(ends, ["depth", "name"], "left")
    full = scratch.table(full, "full").join(parents, ["depth", "up"], "left")
    return full.select(
        F.col("first").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


__all__ = ["numbered", "prefixes", "rebuilt", "trie", "turns"]
