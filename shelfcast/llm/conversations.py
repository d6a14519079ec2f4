"""The prefix trie of conversations, by hashes of blocks of turns.

A conversation is cut into blocks of BLOCK turns, and each block has a digest that its place is part of; the digest of
the conversation up to a block is the exclusive or of the digests so far. Conversations are grouped block by block
first: a distinct block is where a group begins, where it ends, and how many conversations pass through it. Only where
more than one block follows the same beginning are the blocks opened and grouped turn by turn; elsewhere the turns of
a block are a chain of nodes as they stand.

Sums over subtrees need no walk. A node belongs to its smallest member, so each conversation owns the end of its own
path, and what lies below a node is all that its members own, less what its owner owns above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import saved, shuffle_parts

#: Turns of a block.
BLOCK = 4
#: Conversation ids whose list is one piece of text; a node with more members has several pieces.
PIECE = 10_000
#: Parents with more than this share of all nodes as children are joined by broadcast; there are fewer than 1000.
HOT = 1000

OWN, NODE, PARENT = ["s1", "s2"], ["k1", "k2"], ["p1", "p2"]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` from 1, the two 64-bit lanes ``a`` and ``b`` of the digest of role and text, and ``size`` in code points.

    Turns are ordered by ``turn``, null first; ties go by role, then by the MD5 of the text, and equal rows are turns of
    their own. Null roles and texts are empty. Rows without ``conv_id`` belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    known = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text).alias("md5"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), F.length(text).cast("long").alias("size"),
    ).where("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "md5")
    return known.select("conv_id", F.row_number().over(order).alias("pos"), "a", "b", "size")


def share_beginnings(own: DataFrame, model: Column, first: Column, most: int) -> DataFrame:
    """Conversations whose first turns are those of another: the first ``first`` (at most ``most``) turns of the
    conversation ``model`` (all if it has fewer, none if it doesn't exist), then the own turns after the first ``first``.

    Both are expressions on ``conv_id``. Rows as of ``numbered_turns``, and for a conversation that is left without
    turns one row with null ``pos``.
    """
    convs = own.groupBy("conv_id").agg(F.count("*").alias("turns")).withColumn("_model", model)
    turn = F.struct(F.col("pos"), "a", "b", "size")
    heads = own.where(F.col("pos") <= most).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_head"))
    plan = convs.join(heads.withColumnRenamed("conv_id", "_model"), "_model", "left").withColumn("_h", first.cast("int"))
    plan = saved(plan.select("conv_id", "turns", "_h", F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.array().cast("array<struct<pos:int,a:long,b:long,size:long>>")).alias("_head")))
    heads = plan.select("conv_id", F.explode("_head").alias("_t")).select("conv_id", "_t.*")
    tails = own.join(plan.select("conv_id", "_h", F.size("_head").alias("_k")), "conv_id").where("pos > _h")
    empty = plan.where("size(_head) = 0 AND turns <= _h").select("conv_id", F.lit(None).cast("int").alias("pos"), *[F.lit(None).cast("long").alias(c) for c in ("a", "b", "size")])
    return heads.unionByName(tails.select("conv_id", (F.col("pos") - F.col("_h") + F.col("_k")).alias("pos"), "a", "b", "size")).unionByName(empty)


def _lanes(block: Column, turns: Column) -> list[Column]:
    return [F.xxhash64(block, turns), F.xxhash64(F.lit(7), block, turns)]


def _blocks(steps: DataFrame) -> DataFrame:
    """One row per conversation and block: digests of the conversation before (``s1``, ``s2``) and after it (``e1``, ``e2``), its turns, and whether it is the last."""
    turn = F.struct(F.col("pos"), "a", "b", "size")
    cut = steps.where("pos IS NOT NULL").groupBy("conv_id", F.expr(f"(pos - 1) div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    x, y = _lanes(F.col("block"), F.col("turns"))
    cut = cut.withColumns({"x": x, "y": y})
    order = Window.partitionBy("conv_id").orderBy("block")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    ended = cut.withColumns({"e1": F.bit_xor("x").over(sofar), "e2": F.bit_xor("y").over(sofar), "last": F.lead("block").over(order).isNull()})
    return ended.select("conv_id", "block", F.col("e1").bitwiseXOR(F.col("x")).alias("s1"), F.col("e2").bitwiseXOR(F.col("y")).alias("s2"), "e1", "e2", "turns", "last")


def _opened(blocks: DataFrame, *carry: str | Column) -> DataFrame:
    """A row for each turn of the blocks: the node's key, its parent's, depth, size of its last text, and ``ending``, if the block ends there."""
    turn = blocks.select("*", F.explode(F.sequence(F.lit(1), F.size("turns"))).alias("j"))

    def key(j: Column) -> list[Column]:
        return [F.when(j == 0, s).otherwise(s.bitwiseXOR(h)) for s, h in zip(map(F.col, OWN), _lanes(F.col("block"), F.slice("turns", F.lit(1), j)))]

    names = dict(zip(NODE, key(F.col("j")))) | dict(zip(PARENT, key(F.col("j") - 1)))
    more = {"depth": (F.col("block") * BLOCK + F.col("j")).cast("long"), "size": F.col("turns")[F.col("j") - 1]["size"], "ending": F.col("j") == F.size("turns")}
    return turn.select(*[c.alias(n) for n, c in (names | more).items()], "divided", *carry)


def _hashed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces joined by commas; the pieces of a node follow one another."""
    now, digest = None, None
    for batch in batches:
        made: list[tuple] = []
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
            if (k1, k2) != now:
                if now is not None:
                    made.append((*now, digest.hexdigest()))
                now, digest = (k1, k2), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], [*NODE, "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([digest.hexdigest()])], [*NODE, "ends_sha256"])


def _ends(convs: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at each node. A list of any length is hashed as a stream."""
    pieces = convs.groupBy(*NODE, F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.sort_array(F.collect_set("conv_id")).alias("ids"))
    told = pieces.select(*NODE, "piece", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    spread = told.repartition(shuffle_parts(convs.sparkSession), *NODE).sortWithinPartitions(*NODE, "piece")
    return spread.select(*NODE, "ids").mapInArrow(_hashed_lists, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(steps: DataFrame) -> DataFrame:
    """The trie of the conversations in ``steps``, as of ``numbered_turns`` or ``share_beginnings``.

    A node is a distinct sequence of first turns, the root that of none. Columns: ``conv_id``, the smallest member;
    ``depth``; ``parent_conv_id`` (root: null); ``n_convs``, conversations that begin so; ``n_children``; ``n_leaves``,
    nodes without children in the subtree, the node itself included; ``saved_tokens``, over the subtree the code points
    of the last text for each member but one; ``ends_sha256``, digest of the ids of the conversations that end here
    (ascending decimals, joined by commas). Without any conversation there are no rows. A conversation may have any
    number of turns and a node any number of members; the turns of one conversation are sorted in one task, which
    spills, and the ids of one node's ends pass through one task as a stream.
    """
    spark = steps.sparkSession
    steps = saved(steps)
    total = steps.agg(F.countDistinct("conv_id"), F.min("conv_id")).first()
    blocks = saved(_blocks(steps))
    distinct = blocks.groupBy("block", *OWN, "e1", "e2").agg(F.count("*").alias("n"), F.min("conv_id").alias("owner"), F.sum(F.col("last").cast("long")).alias("n_end"), F.first("turns").alias("turns"))
    distinct = saved(distinct)
    lone = distinct.groupBy(*OWN).agg(F.count("*").alias("c"), F.first("e1").alias("e1"), F.first("e2").alias("e2")).where("c = 1").drop("c")
    distinct = saved(distinct.join(lone.withColumn("lone", F.lit(True)), [*OWN, "e1", "e2"], "left").withColumn("divided", F.col("lone").isNull()).drop("lone"))

    opened = _opened(distinct, "n", "owner", "n_end").withColumn("n_end", F.when(F.col("ending"), F.col("n_end")).otherwise(0))
    same = ["depth", "size", *PARENT]
    grouped = opened.where("divided").groupBy(*NODE).agg(F.sum("n").alias("n"), F.min("owner").alias("owner"), *[F.first(c).alias(c) for c in same])
    nodes = grouped.unionByName(opened.where("NOT divided").select(*NODE, "n", "owner", *same))
    nodes = saved(nodes.withColumn("own", (F.col("n") - 1) * F.col("size")))
    children = nodes.groupBy(*[F.col(p).alias(k) for p, k in zip(PARENT, NODE)]).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(children, NODE, "left").fillna(0, ["n_children"]))

    # What a conversation owns, and what all members of a node own.
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("own").alias("a"), F.sum((F.col("n_children") == 0).cast("long")).alias("l"))
    passing = blocks.select("conv_id", "e1", "e2").join(owned, "conv_id").groupBy("e1", "e2").agg(F.sum("a").alias("a"), F.sum("l").alias("l"))
    sums = _opened(distinct.join(passing, ["e1", "e2"]), "a", "l")
    below = sums.where("divided").groupBy(*NODE).agg(F.sum("a").alias("a"), F.sum("l").alias("l")).unionByName(sums.where("NOT divided").select(*NODE, "a", "l"))
    above = F.coalesce(F.sum("own").over(Window.partitionBy("owner").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    root = [F.lit(0).cast("long").alias(k) for k in NODE]
    finish = blocks.where("last").select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), "conv_id")
    ends = saved(_ends(finish.unionByName(steps.where("pos IS NULL").select(*root, "conv_id"))))

    counts = nodes.agg(F.count("*"), F.sum((F.col("depth") == 1).cast("long")), F.sum((F.col("n_children") == 0).cast("long")), F.sum("own")).first()
    parents = nodes.where("n_children > 0").select(*[F.col(k).alias(p) for k, p in zip(NODE, PARENT)], F.col("owner").alias("parent"), (F.col("n_children") > max(1, counts[0] // HOT)).alias("hot"))
    inner = nodes.withColumn("above", above).join(F.broadcast(parents.where("hot").select(*PARENT, F.col("parent").alias("hot_parent"))), PARENT, "left")
    inner = inner.withColumn("hot_parent", F.when(F.col("depth") == 1, F.lit(total[1]).cast("long")).otherwise(F.col("hot_parent")))
    cold = inner.where("hot_parent IS NULL").join(parents.where("NOT hot").drop("hot"), PARENT)
    inner = cold.unionByName(inner.where("hot_parent IS NOT NULL").withColumn("parent", F.col("hot_parent")))

    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = inner.join(below, NODE).join(ends, NODE, "left").select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("l").alias("n_leaves"), (F.col("a") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
    if not total[0]:
        return out
    whole = spark.createDataFrame([(0, 0, total[1], 0, None, total[0], counts[1] or 0, counts[2] if counts[0] else 1, counts[3] or 0)], "k1 long, k2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    return out.unionByName(whole.join(ends.where("k1 = 0 AND k2 = 0"), NODE, "left").drop(*NODE).withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)))
