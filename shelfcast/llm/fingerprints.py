"""Fingerprints of documents that tell how much two versions differ.

A document's paragraphs (lines, cut further where the words themselves say so) are hashed, and their hashes are put into
an invertible Bloom lookup table: each goes to one cell in each of three parts, and a cell holds a count, the sum of its
hashes and the sum of their checks (sums without carry). Cells of two documents subtract; cells that then hold a single
hash are peeled off until nothing is left, which yields the paragraphs that only one of both has. Where too many differ,
the table is built again four times as large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import shuffle_parts
from shelfcast.llm.words import Words, scramble

#: Cells in each of the three parts of a fingerprint.
CELLS = 8
#: A word in so many ends a paragraph, and so many words do at the latest.
CUT, LONGEST = 8, 64
#: Ranges of ids that are worked on apart, at most; it bounds the list of their limits, not the documents in one.
RANGES = 4096
#: Characters of text gathered before a batch of documents is worked on.
FLUSH = 1 << 20

_U = np.uint64
_LAST = np.iinfo(np.int64).max
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def paragraphs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash, and how many each text has, of the distinct paragraphs of a batch of texts; ordered by text."""
    w = Words(texts)
    n = len(w.hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(w.counts), np.int64)
    feeds = np.concatenate([np.zeros(1, np.int64), np.cumsum(w.body == 10)])
    last = np.ones(n, bool)
    last[:-1] = (w.owner[1:] != w.owner[:-1]) | (feeds[w.starts[1:]] > feeds[w.ends[:-1]]) | ((w.hashes[:-1] >> _U(20)) % _U(CUT) == 0)
    at = np.arange(n)
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], last[:-1]]), at, 0))
    last |= (at - begin) % LONGEST == LONGEST - 1
    b = np.flatnonzero(last) + 1
    a = np.concatenate([[0], b[:-1]])
    h, owner = w.runs(a, b), w.owner[a]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new], np.bincount(owner[new], minlength=len(w.counts))


def _spots(h: np.ndarray, cells: int) -> list[np.ndarray]:
    return [(scramble(h + _U(j + 1)) % _U(cells)).astype(np.int64) + j * cells for j in range(3)]


def _check(h: np.ndarray) -> np.ndarray:
    return (scramble(h ^ _U(0x5851F42D4C957F2D)) >> _U(32)).astype(np.uint32)


class Sketches:
    """Tables of ``n`` documents with three parts of ``cells`` cells each."""

    def __init__(self, n: int, cells: int):
        self.cells = cells
        self.count, self.key, self.check = np.zeros((n, 3 * cells), np.int32), np.zeros((n, 3 * cells), np.uint64), np.zeros((n, 3 * cells), np.uint32)

    def put(self, row: np.ndarray, h: np.ndarray, sign: np.ndarray | int = 1) -> None:
        check = _check(h)
        for spot in _spots(h, self.cells):
            at = row * (3 * self.cells) + spot
            np.add.at(self.count.reshape(-1), at, sign)
            np.bitwise_xor.at(self.key.reshape(-1), at, h)
            np.bitwise_xor.at(self.check.reshape(-1), at, check)

    def minus(self, mine: np.ndarray, other: Sketches, theirs: np.ndarray) -> Sketches:
        out = Sketches(0, self.cells)
        out.count, out.key, out.check = self.count[mine] - other.count[theirs], self.key[mine] ^ other.key[theirs], self.check[mine] ^ other.check[theirs]
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, hash and sign of what the tables hold, and the rows that hold more than could be told. Empties the tables."""
        found = []
        for _ in range(10 + 6 * self.cells):
            flat = np.flatnonzero(np.abs(self.count.reshape(-1)) == 1)
            h = self.key.reshape(-1)[flat]
            pure = self.check.reshape(-1)[flat] == _check(h)
            flat, h = flat[pure], h[pure]
            if not len(flat):
                break
            row, sign = flat // (3 * self.cells), self.count.reshape(-1)[flat]
            order = np.lexsort((h, row))
            row, h, sign = row[order], h[order], sign[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            row, h, sign = row[new], h[new], sign[new]
            found.append((row, h, sign))
            self.put(row, h, -sign)
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)]
        return *parts, np.flatnonzero((self.count != 0).any(axis=1) | (self.key != 0).any(axis=1))

    def texts(self, sizes: np.ndarray) -> list[str]:
        return [f"{n:x}:{c.tobytes().hex()}{k.tobytes().hex()}{x.tobytes().hex()}" for n, c, k, x in zip(sizes.tolist(), self.count.astype("<i4"), self.key.astype("<u8"), self.check.astype("<u4"))]


def _sketch_of(texts: np.ndarray, owner: np.ndarray, h: np.ndarray, cells: int) -> Sketches:
    """Tables of some texts; ``owner`` is ascending."""
    out = Sketches(len(texts), cells)
    a, b = np.searchsorted(owner, texts), np.searchsorted(owner, texts, "right")
    n = b - a
    row = np.repeat(np.arange(len(texts)), n)
    out.put(row, h[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)])
    return out


def differing(left: np.ndarray, right: np.ndarray, owner: np.ndarray, h: np.ndarray, small: Sketches) -> np.ndarray:
    """How many paragraphs only one of two texts has, by subtracting and peeling their tables, larger ones where needed."""
    out, todo, cells = np.zeros(len(left), np.int64), np.arange(len(left)), small.cells
    while len(todo):
        if cells == small.cells:
            row, _, _, failed = small.minus(left[todo], small, right[todo]).peel()
        else:
            row, _, _, failed = _sketch_of(left[todo], owner, h, cells).minus(np.arange(len(todo)), _sketch_of(right[todo], owner, h, cells), np.arange(len(todo))).peel()
        out[todo] = np.bincount(row, minlength=len(todo))
        todo, cells = todo[failed], cells * 4
    return out


def _work(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Results for (id, text, text of the next document)."""
    texts = [text for _, text, _ in rows]
    after = []
    for i, (_, _, following) in enumerate(rows):
        if i + 1 < len(rows) and rows[i + 1][1] is following:
            after.append(i + 1)
        else:
            after.append(len(texts))
            texts.append(following)
    edited = [text[: len(text) - len(text) // 4] + following[: len(text) // 4] for _, text, following in rows]
    mine, change = np.arange(len(rows)), len(texts) + np.arange(len(rows))
    owner, h, sizes = paragraphs(pa.array(texts + edited, pa.large_string()))
    small = Sketches(len(sizes), CELLS)
    small.put(owner, h)
    near = []
    for other in (change, np.array(after)):
        apart, both = differing(mine, other, owner, h, small), sizes[mine] + sizes[other]
        near.append(np.where(both > 0, (both - apart) / np.maximum(both + apart, 1), 1.0))
    prints = small.texts(sizes)
    columns = [[r[0] for r in rows], [len(r[1]) for r in rows], [hashlib.sha256(x.encode()).hexdigest() for x in edited], prints[: len(rows)], prints[len(texts) :], *near]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come range by range, each in order and followed by the first document of the next range as a guest."""
    ready, size, before, here = [], 0, None, None
    for batch in batches:
        for place, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("place", "guest", "doc_id", "text"))):
            text = text or ""
            if before is not None and place == here:
                ready.append((*before, text))
                size += len(text)
            before, here = None if guest else (doc_id, text), place
            if size >= FLUSH:
                yield _work(ready)
                ready, size = [], 0
    if ready:
        yield _work(ready)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text, and the likeness of it to that and to the next document's.

    The edited text ends in the start of the next document instead of its own last quarter (rounded down). Next is by
    id, nulls last, then text; after the last comes the first. Likeness is the share of paragraphs in both among those in
    either, 1 if there are none. Null texts are empty. Repeated rows are documents of their own, one after the other.
    Rows of one id stay together in one task, as it is a key. Empty tables give no rows; extra columns are left aside.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = F.coalesce("doc_id", F.lit(_LAST))
    length = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(RANGES, max(2 * shuffle_parts(spark), length >> 22))
    cuts = rows.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if length else []
    limits = sorted({int(x) for x in cuts if abs(x) < 2.0**63})
    place = F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x <= order)) if limits else F.lit(0)
    placed = rows.withColumn("order", order).withColumn("place", place)
    firsts = sorted(placed.groupBy("place").agg(F.min("order").alias("first")).collect())
    # The first document of a range is also a guest of the range before; that of the first one, of the last one.
    guests = [(firsts[i]["first"], firsts[i - 1]["place"]) for i in range(len(firsts))]
    host = spark.createDataFrame(guests, "order long, host int")  # a row for each range
    invited = placed.join(F.broadcast(host), "order").select("doc_id", "text", "order", F.col("host").alias("place"), F.lit(True).alias("guest"))
    both = placed.select("doc_id", "text", "order", "place", F.lit(False).alias("guest")).unionByName(invited)
    both = both.repartition(ranges, "place").sortWithinPartitions("place", "guest", "order", "text")
    return both.select("place", "guest", "doc_id", "text").mapInArrow(_run, SCHEMA)
