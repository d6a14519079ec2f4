"""Mixing sources to target weights by a flow of least cost.

Documents are summed up by the set of sources they belong to. A flow from these patterns to the sources fills each
source's quota; the second and third use of a word cost more than the first, so repetition is spread out. Whole
documents are then chosen in a seeded order until each pattern has given what the flow takes from it.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import WORD, saved, tag

#: Weights of the sources in order of code points, null last, repeating.
WEIGHTS = (5, 2, 1)
#: Times that a document may be taken.
MOST = 3
#: Documents in a seeded bucket, about: only the bucket at the limit is sorted.
BUCKET_DOCS = 1_000
#: The plan is broadcast up to so many patterns (a row of each) and joined by shuffles beyond, so that no common pattern is in one task.
MOST_SENT = 20_000


def target_sizes(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Shares of all sizes by repeating weights; a source stops at ``most`` times its size and the others share the excess."""
    share = [Fraction(weights[i % len(weights)]) for i in range(len(sizes))]
    out, left, open_ = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), set(range(len(sizes)))
    while open_:
        total = sum(share[i] for i in open_)
        full = [i for i in open_ if left * share[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * share[i] / total
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= set(full)
    return [float(x) for x in out]


def least_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], most: int = MOST) -> list[list[tuple[int, int]]]:
    """For each pattern the (source, amount) that it gives.

    ``supply`` is the size of each pattern, ``members`` its sources. A pattern may give its size ``most`` times; each
    further time costs one more per word. Shortest paths with potentials; sizes of the graph are those of the patterns.
    """
    n, m = len(supply), len(quota)
    start, end = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, capacity: int, price: int) -> None:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)

    for i, size in enumerate(supply):
        for k in range(most):
            arc(start, i, size, k)
        for j in members[i]:
            arc(i, n + j, most * size, 0)
    for j, q in enumerate(quota):
        arc(n + j, end, q, 0)
    high = [0] * (n + m + 2)
    while True:
        far, via = {start: 0}, {}
        queue = [(0, start)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in graph[x]:
                if room[e] and d + cost[e] + high[x] - high[to[e]] < far.get(to[e], 1 << 60):
                    far[to[e]], via[to[e]] = d + cost[e] + high[x] - high[to[e]], e
                    heapq.heappush(queue, (far[to[e]], to[e]))
        if end not in far:
            break
        for x in range(len(high)):
            high[x] += far.get(x, far[end])
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return [[(to[e] - n, room[e ^ 1]) for e in graph[i] if not e & 1 and n <= to[e] < n + m and room[e ^ 1]] for i in range(n)]


def mix(docs: DataFrame, sources: Column, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """What a mix of 100 % of all words takes of each document.

    ``sources`` is an array of the sources of a document; an empty or null array is membership of no source, null
    elements are the null source. Columns: ``_id``, ``_tag`` (the identity of the row), ``doc_id``, ``size``, ``pattern``,
    ``source_size`` and ``target`` (of the first source of the pattern) and ``taken``, a multiple of the size up to
    ``most``. Sizes are counts of words; null and empty texts have size 0 and are not taken. Repeated rows are rows of
    their own with equal chances. Nothing random but the hash of seed, id and text decides, so reruns agree. An empty
    table gives no rows.

    The driver sees one row per pattern of sources, never documents: a mix names its sources, so their number doesn't
    grow with the documents.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    lot = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    pattern = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    sized = saved(docs.select(F.col(id_col).cast("long").alias("_id"), tag(F.col(text_col).cast("string")).alias("_tag"), pattern.alias("pattern"), size.alias("size"), lot.alias("lot")))
    spark = docs.sparkSession
    patterns = sized.groupBy("pattern").agg(F.sum("size").alias("supply"), F.count("*").alias("docs")).collect()
    patterns.sort(key=lambda r: [(s is None, s or "") for s in r.pattern])
    names = sorted({s for r in patterns for s in r.pattern}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in patterns:
        for s in r.pattern:
            sizes[at[s]] += r.supply
    targets = target_sizes(sizes, weights, most)
    flow = least_cost_flow([r.supply for r in patterns], [[at[s] for s in r.pattern] for r in patterns], [round(t) for t in targets], most)
    # A bucket is the head of the lot, so buckets in order are lots in order.
    bits = max(0, (max((r.docs for r in patterns), default=0) // BUCKET_DOCS).bit_length())
    sized = sized.withColumn("bucket", F.shiftright(F.col("lot"), 63 - bits) if bits else F.lit(0).cast("long"))
    plan = {}
    for r, given in zip(patterns, flow):
        amount, first = sum(a for _, a in given), at[r.pattern[0]] if r.pattern else None
        times, rest = divmod(amount, r.supply) if r.supply else (0, 0)
        plan[tuple(r.pattern)] = [r.pattern, times, rest, 0 if first is None else sizes[first], 0.0 if first is None else targets[first], None, 0]
    schema = "pattern array<string>, times long, rest long, source_size long, target double, edge long, within long"
    held = sized.groupBy("pattern", "bucket").agg(F.sum("size").alias("held"))
    before = F.sum("held").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("held")
    small = F.broadcast if len(plan) <= MOST_SENT else (lambda df: df)
    rests = small(spark.createDataFrame([x[0:1] + x[2:3] for x in plan.values()], "pattern array<string>, rest long"))
    edges = held.withColumn("before", before).join(rests, "pattern").where("before <= rest AND rest < before + held")
    for r in edges.select("pattern", "bucket", (F.col("rest") - F.col("before")).alias("within")).collect():
        plan[tuple(r.pattern)][5:] = [r.bucket, r.within]
    placed = sized.join(small(spark.createDataFrame([tuple(x) for x in plan.values()], schema)), "pattern")
    placed = placed.withColumn("at_edge", F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False)))
    clear = placed.where(~F.col("at_edge")).withColumn("more", F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)))
    # At the limit: in the order of lots, what fits into the gap is taken until it would no longer fit; then the same
    # with the smaller gap, and at last the largest document that fits.
    group, lots = Window.partitionBy("pattern"), ("lot", "_id", "_tag")
    last = placed.where("at_edge").withColumn("gap", F.col("within")).withColumn("more", F.lit(False))
    for order in (lots, lots, lots, (F.col("size").desc(), *lots)):
        last = last.withColumn("fits", ~F.col("more") & (F.col("size") <= F.col("gap")))
        last = last.withColumn("seen", F.sum(F.when(F.col("fits"), F.col("size"))).over(group.orderBy(F.col("fits").desc(), *order).rowsBetween(Window.unboundedPreceding, 0)))
        last = last.withColumn("now", F.col("fits") & (F.col("seen") <= F.col("gap")))
        last = last.withColumn("more", F.col("more") | F.col("now")).withColumn("gap", F.col("gap") - F.coalesce(F.sum(F.when(F.col("now"), F.col("size"))).over(group), F.lit(0)))
    last = last.drop("gap", "fits", "seen", "now")
    taken = F.col("size") * (F.col("times") + F.col("more").cast("long"))
    return clear.unionByName(last).select("_id", "_tag", F.col("_id").alias("doc_id"), "size", "pattern", "source_size", "target", taken.alias("taken"))
