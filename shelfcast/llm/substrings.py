"""Removal of passages that an earlier document has already.

A count-min sketch of all windows of words is built per task, merged, and broadcast as one bit per cell (seen more than
once). It overestimates only, so a window that it calls unique is unique and leaves the job there; the others are
grouped exactly by a 128-bit hash of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import shuffle_parts, tag, text_slices
from shelfcast.llm.packing import pack, pack_sorted, runs, unpack, unpack_sorted
from shelfcast.llm.words import Words, scramble

#: Words in a window.
WINDOW = 50
#: Rows of the sketch: hash functions of which the smallest count holds.
DEPTH = 2
#: Bits of the widest row: 2**28 cells are 32 MB when broadcast as bits. A bound on memory: beyond about a billion
#: windows the sketch fills and spares less, but the result and the linear growth stay.
MAX_WIDTH_BITS = 28
#: Bits of a part of a row that one task merges.
PART_BITS = 22
#: Entries gathered in a task before they are packed and sent off.
FLUSH = 2_000_000

_NO_ID = np.iinfo(np.int64).max  # null ids come last


def _cells(h: np.ndarray, width: int) -> list[np.ndarray]:
    """A cell for each row of the sketch."""
    return [(h if j == 0 else scramble(h + np.uint64(j))) & np.uint64(width - 1) for j in range(DEPTH)]


def _sketch(size: int, width: int):
    part_cells = min(width, 1 << PART_BITS)

    def flush(gathered: list[np.ndarray]) -> pa.RecordBatch:
        parts, packed = [], []
        for j, cells in enumerate(_cells(np.concatenate(gathered), width)):
            cells.sort()
            at = np.searchsorted(cells, np.arange(0, width + 1, part_cells, dtype=np.uint64))
            for k in range(len(at) - 1):
                if at[k] < at[k + 1]:
                    parts.append(j * (width // part_cells) + k)
                    packed.append(pack_sorted((cells[at[k] : at[k + 1]] - np.uint64(k * part_cells)).astype(np.uint32)))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], ["part", "cells"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0
        for batch in text_slices(batches, "text"):
            h, _ = Words(batch.column("text")).windows(size)
            gathered.append(h)
            n += len(h)
            if n >= FLUSH:
                yield flush(gathered)
                gathered, n = [], 0
        if n:
            yield flush(gathered)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = np.zeros(part_cells, bool), np.zeros(part_cells, bool)
        for batch in batches:
            for packed in batch.column("cells"):
                cells = unpack_sorted(packed.as_py(), "u4")
                more[cells[1:][cells[1:] == cells[:-1]]] = True
                more[cells[once[cells]]] = True
                once[cells] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([pack(np.packbits(more))], pa.binary())], ["part", "bits"])

    return build, merge, part_cells


def repeated_cells(docs: DataFrame, size: int, width: int) -> np.ndarray:
    """Rows of the merged sketch as bits: whether a cell was counted more than once. ``docs`` has ``text``.

    The driver gets DEPTH * width bits at most, whatever the number of documents.
    """
    build, merge, part_cells = _sketch(size, width)
    merged = docs.select("text").mapInArrow(build, "part int, cells binary").groupBy("part").applyInArrow(merge, "part int, bits binary")
    out = np.zeros(DEPTH * width // 8, np.uint8)
    for row in merged.toLocalIterator():
        out[row.part * part_cells // 8 :][: part_cells // 8] = unpack(bytes(row.bits), "u1")
    return out.reshape(DEPTH, width // 8)


def _covered(size: int, slices: int, parts: int, bits, width: int):
    def suspects(h: np.ndarray) -> np.ndarray:
        hit = np.ones(len(h), bool)
        for row, cells in zip(bits.value, _cells(h, width)):
            hit &= (row[cells >> np.uint64(3)] >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8))) & 1 == 1
        return hit

    def flush(gathered: list[tuple]) -> pa.RecordBatch:
        h, g, doc, mark, at = (np.concatenate(x) for x in zip(*gathered))
        order = np.lexsort((doc, g, h))
        h, g, doc, mark, at = h[order], g[order], doc[order], mark[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        least = doc[new][np.cumsum(new) - 1]
        late = doc > least  # an earlier document of this very batch has the window
        rows = [_row(-1 - k, h[:0], g[:0], doc[x], mark[x], at[x]) for k, x in _split(np.flatnonzero(late), doc, slices)]
        rest = np.flatnonzero(~late)
        target = (h[rest] >> np.uint64(32)) % np.uint64(slices)
        by = np.argsort(target, kind="stable")
        ends = np.searchsorted(target[by], np.arange(slices + 1, dtype=np.uint64))
        for k in range(slices):
            x = rest[by[ends[k] : ends[k + 1]]]
            if len(x):
                rows.append(_row(k, h[x], g[x], doc[x], mark[x], at[x]))
        return pa.RecordBatch.from_pylist(rows, pa.schema([("slice", pa.int32()), *[(c, pa.binary()) for c in ("h", "g", "doc", "mark", "at")]]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0
        for batch in text_slices(batches, "text"):
            words = Words(batch.column("text"))
            h, at = words.windows(size)
            x = np.flatnonzero(suspects(h))
            g = words.windows(size, seed=1)[0][x]
            owner = words.owner[at[x]]
            doc = batch.column("doc_id").fill_null(_NO_ID).to_numpy()[owner]
            mark = batch.column("mark").to_numpy()[owner]
            gathered.append((h[x], g, doc, mark, (at[x] - words.first[owner]).astype(np.int64)))
            n += len(x)
            if n >= FLUSH // 2:
                yield flush(gathered)
                gathered, n = [], 0
        if n:
            yield flush(gathered)

    def compare(table: pa.Table) -> pa.Table:
        """Of one slice: the entries whose window starts in a document with a smaller id too."""
        columns = [[unpack(x.as_py(), kind) for x in table.column(c)] for c, kind in (("h", "u8"), ("g", "u8"), ("doc", "i8"), ("mark", "i8"), ("at", "i8"))]
        known = [i for i, x in enumerate(columns[0]) if not len(x)]
        some = [i for i, x in enumerate(columns[0]) if len(x)]
        done = [[columns[c][i] for i in known] for c in (2, 3, 4)]
        if some:
            h, g, doc, mark, at = (np.concatenate([c[i] for i in some]) for c in columns)
            order = np.lexsort((doc, g, h))
            new = np.ones(len(h), bool)
            hs, gs = h[order], g[order]
            new[1:] = (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])
            late = order[doc[order] > doc[order][new][np.cumsum(new) - 1]]
            late.sort()
            for to, c in zip(done, (doc, mark, at)):
                to.append(c[late])
        doc, mark, at = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in done)
        rows = []
        to = _part(doc, parts)
        order = np.lexsort((at, mark, doc, to))
        ends = runs(to[order])
        for a, b in zip(ends[:-1], ends[1:]):
            x = order[a:b]
            if len(x):
                rows.append({"part": int(to[x[0]]), "doc": pack(doc[x]), "mark": pack(mark[x]), "at": pack(at[x].astype(np.int32))})
        return pa.Table.from_pylist(rows, pa.schema([("part", pa.int32()), ("doc", pa.binary()), ("mark", pa.binary()), ("at", pa.binary())]))

    return find, compare


def _part(doc: np.ndarray, parts: int) -> np.ndarray:
    """The group of documents to which an id belongs; the same as the expression in remove_repeated_passages."""
    u = doc.view(np.uint64)
    return (u ^ (u >> np.uint64(7)) ^ (u >> np.uint64(17))).view(np.int64) % parts


def _split(x: np.ndarray, doc: np.ndarray, slices: int) -> list[tuple[int, np.ndarray]]:
    """Entries in pieces of up to 100,000, each dealt by the hash of a document in it."""
    pieces = np.array_split(x, max(1, -(-len(x) // 100_000)))
    return [(int(scramble(doc[p[:1]].view(np.uint64))[0] % np.uint64(slices)), p) for p in pieces if len(p)]


def _row(k: int, h: np.ndarray, g: np.ndarray, doc: np.ndarray, mark: np.ndarray, at: np.ndarray) -> dict:
    return {"slice": k, "h": pack(h), "g": pack(g), "doc": pack(doc), "mark": pack(mark), "at": pack(at)}


def _clean(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def clean(docs: pa.Table, hits: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for row in hits.select(["doc", "mark", "at"]).to_pylist():
            doc, mark, at = unpack(row["doc"], "i8"), unpack(row["mark"], "i8"), unpack(row["at"], "i4")
            ends = runs(scramble(doc.view(np.uint64)) ^ mark.view(np.uint64))
            for a, b in zip(ends[:-1], ends[1:]):
                if a < b:
                    found.setdefault((int(doc[a]), int(mark[a])), []).append(at[a:b])
        out = []
        for doc_id, mark, text in zip(docs.column("doc_id").to_pylist(), docs.column("mark").to_pylist(), docs.column("text")):
            words = (text.as_py() or "").encode().split()
            at, n = found.get((_NO_ID if doc_id is None else doc_id, mark)), len(words)
            if at:
                change = np.zeros(n + 1, np.int64)
                starts = np.unique(np.concatenate(at))
                change[starts] += 1
                change[starts + size] -= 1
                words = list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))
            kept = b" ".join(words)
            out.append((doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return clean


def remove_repeated_passages(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", max_width_bits: int = MAX_WIDTH_BITS) -> DataFrame:
    """Each document without the words of windows that start in a document with a smaller id too.

    Columns: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept``, the remaining words joined by a space.
    Null texts have no words. A null id is larger than any other; rows of one id don't remove each other's words.
    Repeated rows get equal results. An empty table gives no rows, and extra columns are left aside.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Words are some four bytes or more; two cells for each keep most unique windows apart.
    width = 1 << min(max_width_bits, max(16, int(length // 2).bit_length()))
    bits = spark.sparkContext.broadcast(repeated_cells(docs, size, width))
    slices = max(shuffle_parts(spark), length >> 24)
    parts = max(shuffle_parts(spark), length >> 23)
    find, compare = _covered(size, slices, parts, bits, width)
    binary = "h binary, g binary, doc binary, mark binary, at binary"
    marked = docs.withColumn("mark", tag())
    hits = marked.mapInArrow(find, f"slice int, {binary}").groupBy("slice").applyInArrow(compare, "part int, doc binary, mark binary, at binary")
    here = F.coalesce("doc_id", F.lit(_NO_ID))
    part = F.pmod(here.bitwiseXOR(F.shiftrightunsigned(here, 7)).bitwiseXOR(F.shiftrightunsigned(here, 17)), F.lit(parts)).cast("int")
    grouped = marked.withColumn("part", part).groupBy("part")
    return grouped.cogroup(hits.groupBy("part")).applyInArrow(_clean(size), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
