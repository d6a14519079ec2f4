"""Exact search for the vectors of largest inner product by M-trees.

Inner product becomes distance by one more coordinate, sqrt(M - |v|^2), that gives all vectors the length sqrt(M) and
queries 0: then d(q, v)^2 = |q|^2 + M - 2 q.v. A tree of pages is built over the vectors of each block of rows. A page
keeps its centre, its covering radius and its distance to the centre of the page above. Queries go through a tree best
page first, many at a time; a page or vector is left out without computing its distance where the stored distances and
the triangle inequality show that it is too far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Components are floor(SCALE * x).
SCALE = 256
#: Rows of a block (one tree), queries of a block, vectors of a page, and children of an inner page.
ROWS, QUERIES, PAGE, FANOUT = 8192, 4096, 512, 8

_NONE = np.iinfo(np.int64).min


class MTree:
    """A tree over vectors ordered by id, so that of equal scores the smaller position wins."""

    def __init__(self, vectors: np.ndarray, page: int = PAGE, fanout: int = FANOUT):
        self.v = vectors.astype(np.float64)
        square = (self.v * self.v).sum(axis=1)
        self.top = float(square.max(initial=0.0))
        self.lift = np.sqrt(self.top - square)
        self.page, self.fanout = page, fanout
        self.center, self.radius, self.to_parent, self.children, self.members, self.member_far = [], [], [], [], [], []
        self.root = self._grow(np.arange(len(self.v)))
        self.computed = 0
        self.center, self.radius, self.to_parent = np.array(self.center), np.array(self.radius), np.array(self.to_parent)

    def _far(self, a: int, rows: np.ndarray) -> np.ndarray:
        dot = self.v[rows] @ self.v[a] + self.lift[rows] * self.lift[a]
        return np.sqrt(np.maximum(2 * self.top - 2 * dot, 0.0))

    def _grow(self, rows: np.ndarray, center: int | None = None) -> int:
        """Adds the page of ``rows`` and those below it."""
        if center is None:
            center = int(rows[0])
        far = self._far(center, rows)
        me = len(self.center)
        self.center.append(center)
        self.radius.append(float(far.max(initial=0.0)))
        self.to_parent.append(0.0)
        self.children.append([])
        order = np.argsort(far, kind="stable")
        self.members.append(rows[order])
        self.member_far.append(far[order])
        if len(rows) <= self.page:
            return me
        centers, nearest, which = [center], far.copy(), np.zeros(len(rows), np.int64)
        for k in range(1, self.fanout):  # each next centre is the vector farthest from the ones before
            pick = int(np.argmax(nearest))
            if nearest[pick] < 1e-6:
                break
            centers.append(int(rows[pick]))
            new = self._far(centers[-1], rows)
            which = np.where(new < nearest, k, which)
            nearest = np.minimum(new, nearest)
        if len(centers) == 1:
            groups = [(center, rows[i : i + self.page]) for i in range(0, len(rows), self.page)]
        else:
            groups = [(c, rows[which == k]) for k, c in enumerate(centers)]
        self.members[me], self.member_far[me] = rows[:0], far[:0]
        for c, group in groups:
            child = self._grow(group, c)
            self.to_parent[child] = float(self._far(center, np.array([c]))[0])
            self.children[me].append(child)
        return me

    def search(self, queries: np.ndarray, k: int) -> np.ndarray:
        """The positions of the ``k`` best vectors of each query, best first, -1 where there are fewer."""
        q = queries.astype(np.float64)
        n, pages = len(q), len(self.center)
        shift = max(1, len(self.v).bit_length())
        best = np.full((n, k), _NONE, np.int64)  # score and position in one number, ascending
        size = (q * q).sum(axis=1) + self.top
        # Rounding must never leave out a vector: distances are compared with some slack.
        slack = 1e-7 * (1.0 + size)
        bound = np.full(n, np.inf)
        lower, known = np.full((n, pages), np.inf), np.full((n, pages), np.nan)

        def distance(who: np.ndarray, rows: np.ndarray) -> np.ndarray:
            self.computed += len(who) * len(rows)
            return np.sqrt(np.maximum(size[who, None] - 2 * (q[who] @ self.v[rows].T), 0.0))

        everyone = np.arange(n)
        known[:, self.root] = distance(everyone, np.array([self.center[self.root]]))[:, 0]
        lower[:, self.root] = 0.0
        while True:
            choice = np.argmin(lower, axis=1)
            at = lower[everyone, choice]
            active = np.flatnonzero((at < np.inf) & (at**2 <= bound + slack))
            if not len(active):
                break
            lower[active, choice[active]] = np.inf
            order = np.argsort(choice[active], kind="stable")
            active = active[order]
            ends = np.flatnonzero(np.diff(choice[active], prepend=-1, append=-1))
            for a, b in zip(ends[:-1], ends[1:]):
                who, page = active[a:b], choice[active[a]]
                reach = np.sqrt(bound[who] + slack[who])
                here = known[who, page]
                if self.children[page]:
                    below = np.array(self.children[page])
                    near = np.abs(here[:, None] - self.to_parent[below]) - self.radius[below] <= reach[:, None]
                    below, near = below[near.any(axis=0)], near[:, near.any(axis=0)]
                    d = distance(who, self.center[below])
                    known[who[:, None], below] = d
                    lower[who[:, None], below] = np.where(near, np.maximum(d - self.radius[below], 0.0), np.inf)
                # Members lie in order of their distance to the centre: those that may be near are one range.
                far = self.member_far[page]
                lo, hi = np.searchsorted(far, (here - reach).min()), np.searchsorted(far, (here + reach).max(), "right")
                rows = self.members[page][lo:hi]
                if len(rows):
                    self.computed += len(who) * len(rows)
                    key = ((q[who] @ self.v[rows].T).astype(np.int64) << shift) + (len(self.v) - 1 - rows)
                    better = key.max(axis=1) > best[who, 0]
                    who, key = who[better], key[better]
                    both = np.concatenate([best[who], np.partition(key, -k, axis=1)[:, -k:] if key.shape[1] > k else key], axis=1)
                    best[who] = np.sort(both, axis=1)[:, -k:]
                    kth = best[who, 0]
                    bound[who] = np.where(kth == _NONE, np.inf, size[who] - 2.0 * (kth >> shift))
        found = np.where(best == _NONE, -1, len(self.v) - 1 - (best & ((1 << shift) - 1)))
        return found[:, ::-1]


def _block_search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and queries.num_rows:
            v_len, q_len = (np.array(t.column("v").combine_chunks().value_lengths()) for t in (rows, queries))
            for width in np.unique(q_len):  # vectors of other lengths have no inner product
                r, q = rows.filter(pa.array(v_len == width)), queries.filter(pa.array(q_len == width))
                if not r.num_rows:
                    continue
                r = r.sort_by("vec_id")
                ids, query_ids = r.column("vec_id").to_numpy(), q.column("vec_id").to_numpy()
                v, w = (np.array(t.column("v").combine_chunks().flatten(), np.int64).reshape(t.num_rows, width) for t in (r, q))
                # The query's own row is no candidate, so one more is looked for.
                found = MTree(v).search(w, k + 1)
                who, place = np.nonzero(found >= 0)
                spot = found[who, place]
                score = (w[who] * v[spot]).sum(axis=1)
                other = ids[spot] != query_ids[who]
                out.append((query_ids[who][other], ids[spot][other], score[other]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query row the ``k`` other rows with the largest inner product of floor(SCALE * x), ties to the smaller id.

    ``is_query`` is a condition on the rows. Columns: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``. Vectors that
    are null, or hold null, NaN or infinite components, take no part, nor do rows with a null id; vectors of different
    lengths have no product, and those without components have score 0 with each other. Rows of one id with equal vectors
    are one row. Products must fit into 53 bits. An empty table gives no rows; a query without any other row has none.

    Rows and queries are dealt into blocks by hash, so equal and common vectors spread evenly; each pair of blocks is one
    tree search. Only the k best of each pair move on.
    """
    x = F.col(vector_col)
    sound = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(sound).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), is_query.alias("asks")).distinct()
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    blocks, lots = max(1, -(-n // ROWS)), max(1, -(-asked // QUERIES))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    lot = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(lots)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "v", block.alias("block"), each(lots).alias("lot"))
    right = rows.where("asks").select("vec_id", "v", each(blocks).alias("block"), lot.alias("lot"))
    found = left.groupBy("block", "lot").cogroup(right.groupBy("block", "lot")).applyInArrow(_block_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
