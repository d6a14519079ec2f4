"""Documents whose sets of word n-grams are alike, by a chosen-path join.

Sets get signatures of minima under random orders; equal places of two signatures are shared sampled tokens. In each run
a bucket splits by a few sampled places: records with the same token there go on together, so that a pair as alike as
asked for is expected to share one child. Small buckets are compared by brute force, large ones split on to a bounded
depth and are then compared block by block. Runs are repeated until the chance to miss a pair is as small as wanted.
Candidates are then verified on the n-grams themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import give_back, saved, shuffle_parts, tag, text_slices
from shelfcast.llm.components import components
from shelfcast.llm.packing import pack, runs, unpack
from shelfcast.llm.words import Words, scramble

#: Words in an n-gram, and similarity from which documents are alike.
GRAM, SIMILAR = 5, 0.8
#: Places of a signature, depth of paths, records in a bucket that splits no more, records in a block.
PLACES, DEPTH, SMALL, BLOCK = 128, 3, 256, 1024
#: Chance that a pair just as alike as asked for meets in some bucket.
RECALL = 0.9999
#: Share of equal places from which a pair is verified: 4.5 standard deviations below SIMILAR.
LIKELY = SIMILAR - 4.5 * math.sqrt(SIMILAR * (1 - SIMILAR) / PLACES)

_TURN = scramble(np.arange(1, PLACES + 1, dtype=np.uint64)) | np.uint64(1)


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    """A pair as alike as asked for shares one child on average; the chance that it still does at the last depth follows, and from that the number of runs."""
    meets = 1.0
    for _ in range(depth):
        meets = 1 - math.exp(-meets)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def gram_sets(texts: pa.Array, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the distinct n-grams of a batch of texts, in order. A text of fewer words has one n-gram of all its words."""
    w = Words(texts)
    h, at = w.windows(size)
    owner = w.owner[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    h, owner = np.concatenate([h, w.runs(w.first[short], w.first[short + 1])]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        n = batch.num_rows
        owner, h = gram_sets(batch.column("text"))
        size = np.bincount(owner, minlength=n)
        full = np.flatnonzero(size)
        sign, sets = np.zeros((n, PLACES), np.int32), [None] * n
        if len(full):
            starts = np.searchsorted(owner, full)
            for i, turn in enumerate(_TURN):
                sign[full, i] = np.minimum.reduceat((h * turn) >> np.uint64(32), starts).astype(np.uint32).view(np.int32)
            digest = np.stack([np.add.reduceat(scramble(h), starts), np.bitwise_xor.reduceat(scramble(h + np.uint64(7)), starts)], axis=1)
            for k, x in zip(full.tolist(), digest):
                sets[k] = x.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_tag"), pa.array(sets, pa.binary()), pa.array(size, pa.int32()), pa.array([x.tobytes() for x in sign], pa.binary())], ["_id", "_tag", "grams", "size", "sign"])


def _forest(alike: np.ndarray) -> np.ndarray:
    """The first member of each member's component, of a symmetric table of who is like whom."""
    root = np.full(len(alike), -1)
    for i in range(len(alike)):
        if root[i] < 0:
            root[i], front = i, np.array([i])
            while len(front):
                front = np.flatnonzero(alike[front].any(axis=0) & (root < 0))
                root[front] = i
    return root


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows of equal keys together, from rows sorted by them."""
    left: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([left, table]) if left is not None else table
        marks = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows, bool)
        for m in marks:
            change[1:] |= m[1:] != m[:-1]
        ends = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(ends[:-1], ends[1:]):
            yield table.slice(a, b - a)
        left = table.slice(ends[-1])
    if left is not None:
        yield left


_PAIR = ("path", "first", "second")


def _sides(group: pa.Table) -> tuple[np.ndarray, bool]:
    """Which of both blocks each row is in; whether only pairs across count."""
    first, second = group.column("first")[0].as_py(), group.column("second")[0].as_py()
    return group.column("block").to_numpy() == second, first != second


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from each record of a bucket to the first one of those that are likely alike."""
    a, b = [], []
    for group in _groups(batches, _PAIR):
        if group.num_rows < 2:
            continue
        node = group.column("node").to_numpy()
        sign = np.array([np.frombuffer(x, "<i4") for x in group.column("sign").to_pylist()])
        side, across = _sides(group)
        alike = np.zeros((len(node), len(node)), bool)
        step = max(1, (1 << 22) // (len(node) * PLACES))
        for i in range(0, len(node), step):
            alike[i : i + step] = (sign[i : i + step, None] == sign[None]).mean(axis=2) >= LIKELY
        if across:
            alike &= side[:, None] != side[None]
        root = _forest(alike)
        some = np.flatnonzero(root != np.arange(len(node)))
        a.append(node[some])
        b.append(node[root[some]])
        if sum(map(len, a)) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
    give_back()


def _pack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        owner, h = gram_sets(batch.column("text"))
        ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        packed = [pack(h[x:y]) for x, y in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("node"), batch.column("texts"), batch.column("blocks"), pa.array(packed, pa.binary())], ["path", "node", "texts", "blocks", "set"])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    h, row = np.concatenate(sets)[order], row[order]
    ends = runs(h)
    length = np.diff(ends)
    column = np.repeat(np.cumsum(length > 1) - 1, length)
    held = np.repeat(length > 1, length)
    row, column = row[held], column[held]
    out = np.zeros((n, n), np.float32)
    width = max(64, (1 << 22) // n)
    at = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k in range(len(at) - 1):
        x = np.zeros((n, width), np.float32)
        x[row[at[k] : at[k + 1]], column[at[k] : at[k + 1]] - k * width] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each record the number of different texts that it is alike, and the first record of those linked to it."""
    out: list[tuple] = []
    for group in _groups(batches, _PAIR):
        keep = np.unique(group.column("node").to_numpy(), return_index=True)[1]
        if len(keep) < 2:
            continue
        group = group.take(pa.array(keep))
        node, texts = group.column("node").to_numpy(), group.column("texts").to_numpy()
        sets = [unpack(x, "u8") for x in group.column("set").to_pylist()]
        size = np.array([len(s) for s in sets])
        shared = _shared(sets)
        # Exact in whole numbers: shared / (sum of sizes - shared) >= SIMILAR.
        alike = shared * 10 >= round(SIMILAR * 10) * (size[:, None] + size[None] - shared)
        side, across = _sides(group)
        if across:
            alike &= side[:, None] != side[None]
        np.fill_diagonal(alike, False)
        root = _forest(alike)
        some = np.flatnonzero(alike.any(axis=1))
        out.append((node[some], node[root[some]], (alike @ texts)[some]))
        if len(out) > 2_000:
            yield _linked(out)
            out = []
    if out:
        yield _linked(out)
    give_back()


def _linked(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["a", "b", "links"])


def _in_pairs(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows with ``path`` and ``node`` for each pair of blocks of their group: ``first`` and ``second``, and their own ``block``."""
    placed = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))
    placed = placed.withColumn("other", other)
    return placed.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("other")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_parts(rows.sparkSession), *_PAIR).sortWithinPartitions(*_PAIR)


def _token(place: Column) -> Column:
    """The sampled token at a place of a signature."""
    return F.substring(F.col("sign"), place * 4 + 1, F.lit(4))


def _candidates(reps: DataFrame) -> DataFrame:
    """Links between records that meet in a bucket and have likely signatures."""
    each = 1 / (SIMILAR * PLACES)
    order = np.random.default_rng(1)
    chosen = [(r, i) for r in range(runs_needed()) for i in np.flatnonzero(order.random(PLACES) < each).tolist()]
    start = F.array(*[F.xxhash64(F.lit(r), F.lit(i), _token(F.lit(i))) for r, i in chosen])
    level = reps.select("node", F.explode(start).alias("path"))
    leaves = []
    for depth in range(1, DEPTH + 1):
        level = saved(level)
        counts = level.groupBy("path").agg(F.count("*").alias("held")).where("held > 1")
        met = level.join(counts, "path")
        done = met if depth == DEPTH else met.where(F.col("held") <= SMALL)
        leaves.append(done)
        if depth < DEPTH:
            wide = met.where(F.col("held") > SMALL).join(reps.select("node", "sign"), "node")
            draw = F.filter(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda i: F.pmod(F.xxhash64(F.col("path"), i), F.lit(1 << 30)) < int(each * (1 << 30)))
            level = wide.select("node", F.explode(F.transform(draw, lambda i: F.xxhash64(F.col("path"), i, _token(i)))).alias("path"))
    met = leaves[0]
    for more in leaves[1:]:
        met = met.union(more)
    paired = _in_pairs(met.select("path", "node", "held"), F.ceil(F.col("held") / BLOCK)).drop("held")
    return _dealt(paired.join(reps.select("node", "sign"), "node")).mapInArrow(_compare, "a long, b long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's class and how many different texts it is alike.

    Documents are alike if the Jaccard similarity of their sets of GRAM-word n-grams is SIMILAR or more; classes are the
    components of that. Columns: ``_id``, ``_tag`` (the identity of the row), ``doc_id``, ``class_id``, the smallest id
    in the class (null ids come last), ``first_tag``, telling apart rows of that id, and ``links``. Words are taken as
    they stand. A text of fewer words has one n-gram of all its words. Null texts and texts without words are alike
    nothing: their class is their own id. Copies are one text. Repeated rows get equal results. An empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), tag(text).alias("_tag"), text.alias("text"))
    signed = saved(rows.mapInArrow(_describe, "_id long, _tag long, grams binary, size int, sign binary"))
    who = F.struct(F.col("_id").isNull().alias("none"), "_id", "_tag")
    reps = signed.where("grams IS NOT NULL").groupBy("grams").agg(F.first("sign").alias("sign"), F.count_distinct("_tag").alias("texts"), F.min(who).alias("who"))
    reps = saved(reps.withColumn("node", F.monotonically_increasing_id()))
    groups = saved(components(_candidates(reps)))
    sizes = groups.groupBy("root").agg(F.count("*").alias("held"))
    placed = groups.join(sizes, "root").join(reps.select("node", "texts", "who"), "node")
    placed = placed.select(F.col("root").alias("path"), "node", "texts", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"), F.col("who._id").alias("_rid"), F.col("who._tag").alias("_rtag"))
    full = rows.join(placed, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_tag") == F.col("_rtag"))).select("path", "node", "texts", "blocks", "text")
    sets = full.mapInArrow(_pack_sets, "path long, node long, texts long, blocks int, set binary")
    alike = saved(_dealt(_in_pairs(sets, F.col("blocks"))).mapInArrow(_verify, "a long, b long, links long"))
    links = alike.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(alike.select("a", "b"))
    known = reps.select("grams", "node", "texts", "who").join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = known.groupBy("root").agg(F.min("who").alias("first"))
    known = known.join(firsts, "root").select("grams", "first", (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("links"))
    out = signed.select("_id", "_tag", "grams").join(known, "grams", "left")
    alone = F.col("first").isNull()
    return out.select("_id", "_tag", F.col("_id").alias("doc_id"), F.when(alone, F.col("_id")).otherwise(F.col("first._id")).alias("class_id"), F.when(alone, F.col("_tag")).otherwise(F.col("first._tag")).alias("first_tag"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
