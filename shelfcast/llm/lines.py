"""Removal of lines that an earlier line equals or nearly equals.

Lines are compared word by word; the bound is one word put in, left out or changed. Each line in question emits its
deletion neighbourhood as hashed keys: the line without word p, once beside p (for changed words) and once alone (for
words left out, to meet whole lines). Lines at distance one or less meet in a key, and lines that meet in such a key
are at distance one or less, because the place of the change is part of the key; so only the earliest of a key has to be
known, and pairs are never made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import frugal, saved, shuffle_parts, tag, text_slices
from shelfcast.llm.packing import bundles, pack, runs, starts_of, unbundle, unpack
from shelfcast.llm.words import Words, pair, scramble

#: Near lines have this many words at least; shorter ones are compared as a whole.
MIN_WORDS = 8
#: Bits of the table that tells which lines have a near line at all (16 MB when broadcast). It may say yes wrongly,
#: which costs work only.
HINT_BITS = 27
#: Words read by a task before it sends what it found.
FLUSH = 120_000
#: Copies of a whole line among its neighbours, so that one line's longer neighbours need not be in one task.
SPREAD = 4

_NO_ID = np.iinfo(np.int64).max
_U = np.uint64
_C, _D = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_PLACE = {"doc": "i8", "mark": "i8", "no": "i4"}


class _Lines:
    """All lines of a batch of documents, with sums by which the hash of any part of a line is known at once."""

    def __init__(self, batch: pa.RecordBatch):
        texts = batch.column("text").fill_null("")
        cut = pc.split_pattern(texts, "\n")
        cut = cut.combine_chunks() if isinstance(cut, pa.ChunkedArray) else cut
        per_doc = cut.value_lengths().to_numpy()
        self.words = Words(cut.flatten())
        owner = np.repeat(np.arange(len(per_doc)), per_doc)
        self.no = (np.arange(len(owner)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)).astype(np.int32)
        self.doc = batch.column("doc_id").fill_null(_NO_ID).to_numpy()[owner]
        self.mark = batch.column("mark").to_numpy()[owner]
        self.first, self.n = self.words.first[:-1], self.words.counts
        total = len(self.words.hashes) + 2
        self.sums, self.down = [], []
        for base in (_C, _D):
            up, down = np.full(total, base, np.uint64), np.full(total, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            up = np.cumprod(up)
            self.down.append(np.cumprod(down))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words.hashes * up[: total - 2])]))

    def part(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash k of words a to b."""
        return (self.sums[k][b] - self.sums[k][a]) * self.down[k][a]

    def without(self, k: int, line: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Hash k of a line without the word at p."""
        a, b = self.first[line], self.first[line] + self.n[line]
        return self.part(k, a, p) + (self.sums[k][b] - self.sums[k][p + 1]) * self.down[k][a + 1]

    def whole(self, k: int, line: np.ndarray) -> np.ndarray:
        return self.part(k, self.first[line], self.first[line] + self.n[line])

    def digest(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[line].astype(np.uint64)
        return scramble(self.whole(0, line) + n), scramble(self.whole(1, line) ^ n)

    def anchors(self, line: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
        """Halves that a line shares with every near line if the shorter of both has ``of`` words."""
        a, n, half = self.first[line], self.n[line], of // 2
        return [pair(self.part(0, x, x + half), (of * 2 + end).astype(np.uint64)) for end, x in enumerate((a, a + n - half))]


def _gathered(batches: Iterator[pa.RecordBatch], take) -> Iterator[dict[str, np.ndarray]]:
    """What ``take`` finds in the lines of batch after batch, about FLUSH words together."""
    kept, n = [], 0
    for batch in text_slices(batches, "text"):
        lines = _Lines(batch)
        kept.append(take(lines))
        n += len(lines.words.hashes)
        if n >= FLUSH:
            yield {c: np.concatenate([x[c] for x in kept]) for c in kept[0]}
            kept, n = [], 0
    if kept:
        yield {c: np.concatenate([x[c] for x in kept]) for c in kept[0]}


def _part(doc: np.ndarray, parts: int) -> np.ndarray:
    """The group of documents to which an id belongs; the same as the expression in drop_near_lines."""
    u = doc.view(np.uint64)
    return (u ^ (u >> _U(7)) ^ (u >> _U(17))).view(np.int64) % parts


def _widened(out: pa.RecordBatch, kinds: dict[str, str]) -> pa.RecordBatch:
    """With empty entries for the columns that it lacks."""
    empty = pa.array([pack(np.zeros(0))] * out.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([out.column(c) if c in out.schema.names else empty for c in ("key", *kinds)], ["key", *kinds])


def _order(x: dict[str, np.ndarray], *keys: str) -> dict[str, np.ndarray]:
    by = np.lexsort((x["no"], x["mark"], x["doc"], *[x[k] for k in reversed(keys)]))
    return {c: v[by] for c, v in x.items()}


def _take(x: dict[str, np.ndarray], at: np.ndarray, *columns: str) -> dict[str, np.ndarray]:
    return {c: x[c][at] for c in columns or x}


_EXACT = {"d": "u8", "e": "u8", **_PLACE, "n": "i4", "a0": "u8", "a1": "u8", "a2": "u8", "a3": "u8"}


def _copies(slices: int, parts: int):
    """Equal lines: scan() finds those of a task, compare() those of all tasks."""

    def take(lines: _Lines) -> dict[str, np.ndarray]:
        line = np.flatnonzero(lines.n > 0)
        d, e = lines.digest(line)
        n = lines.n[line]
        a = [*lines.anchors(line, n), *lines.anchors(line, n - 1)]
        return {"d": d, "e": e, "doc": lines.doc[line], "mark": lines.mark[line], "no": lines.no[line], "n": n.astype(np.int32), **{f"a{i}": x for i, x in enumerate(a)}}

    def firsts(x: dict[str, np.ndarray]) -> tuple[dict, dict]:
        x = _order(x, "d", "e")
        new = starts_of(x["d"], x["e"])
        return _take(x, new), _take(x, ~new, *_PLACE)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _gathered(batches, take):
            first, rest = firsts(x)
            yield bundles((first["d"] >> _U(40)).astype(np.int64) % slices, first)
            # Copies found here need no comparing: they go by with a key below zero.
            out = bundles(-1 - _part(rest["doc"], slices), rest)
            yield _widened(out, _EXACT)

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            gone, near = unbundle(table, _PLACE), None
        else:
            first, gone = firsts(unbundle(table, _EXACT))
            near = _take(first, first["n"] >= MIN_WORDS)
        rows = [_removals(gone, parts)]
        if near is not None:
            long = [near["n"] >= MIN_WORDS + i // 2 for i in range(4)]
            some, owner, start, size = _shared(np.concatenate([near[f"a{i}"][x] for i, x in enumerate(long)]), np.concatenate([near["d"][x] for x in long]))
            met = np.unique(owner[size > 1])
            # One line stands for all of this task's that share a half; the others are known to have company.
            rows.append(_kind(1, bundles((some[start] >> _U(40)).astype(np.int64) % slices, {"doc": some[start], "mark": owner[start]})))
            rows.append(_kind(2, bundles(np.zeros(len(met), np.int64), {"doc": met})))
        return pa.Table.from_batches(rows)

    return scan, compare


_FOUND = ("kind", "key", "doc", "mark", "no")
_FOUND_SCHEMA = "kind int, key int, doc binary, mark binary, no binary"


def _kind(kind: int, out: pa.RecordBatch) -> pa.RecordBatch:
    empty = pa.array([None] * out.num_rows, pa.binary())
    columns = [pa.array([kind] * out.num_rows, pa.int32()), *[out.column(c) if c in out.schema.names else empty for c in _FOUND[1:]]]
    return pa.RecordBatch.from_arrays(columns, list(_FOUND))


def _removals(x: dict[str, np.ndarray], parts: int) -> pa.RecordBatch:
    x = _order({c: x[c] for c in _PLACE})
    return _kind(0, bundles(_part(x["doc"], parts), x))


def _shared(some: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (half, line) in order, where each half starts, and how many lines share it."""
    by = np.lexsort((owner, some))
    some, owner = some[by], owner[by]
    new = starts_of(some, owner)
    some, owner = some[new], owner[new]
    start = starts_of(some)
    return some, owner, start, np.diff(runs(some))[np.cumsum(start) - 1] if len(some) else np.zeros(0, np.int64)


def _company(table: pa.Table) -> pa.Table:
    """Lines that share a half with another line, of one slice of halves."""
    x = unbundle(table, {"doc": "u8", "mark": "u8"})
    _, owner, _, size = _shared(x["doc"], x["mark"])
    met = np.unique(owner[size > 1])
    return pa.Table.from_batches([_kind(2, bundles(np.zeros(len(met), np.int64), {"doc": met}))])


def _hints(met: DataFrame, bits: int) -> np.ndarray:
    """One bit for each hash of a line with company: a table of fixed size."""
    cells, split = 1 << bits, 1 << 22

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.unique(unbundle(batch, {"doc": "u8"})["doc"] & _U(cells - 1)).astype(np.int64)
            yield bundles(x // split, {"doc": (x % split).astype(np.int32)})

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(split, bool)
        for batch in batches:
            seen[unbundle(batch, {"doc": "i4"})["doc"]] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([pack(np.packbits(seen))], pa.binary())], ["key", "bits"])

    out = np.zeros(cells // 8, np.uint8)
    parts = met.select("doc").mapInArrow(cut, "key int, doc binary").groupBy("key").applyInArrow(merge, "key int, bits binary")
    for row in parts.toLocalIterator():
        out[row.key * split // 8 :][: split // 8] = unpack(bytes(row.bits), "u1")
    return out


_VARIANT = {"v": "u8", "w": "u8", "role": "u1", **_PLACE}


def _neighbours(slices: int, parts: int, hints, bits: int):
    """Near lines: emit() makes deletion neighbourhoods, meet() finds the earliest line of each key."""

    def take(lines: _Lines) -> dict[str, np.ndarray]:
        line = np.flatnonzero(lines.n >= MIN_WORDS)
        d, e = lines.digest(line)
        cell = d & _U((1 << bits) - 1)
        hit = (hints.value[cell >> _U(3)] >> (_U(7) - (cell & _U(7))).astype(np.uint8)) & 1 == 1
        x = {"d": d[hit], "e": e[hit], "line": line[hit], "doc": lines.doc[line[hit]], "mark": lines.mark[line[hit]], "no": lines.no[line[hit]]}
        x = _order(x, "d", "e")
        x = _take(x, starts_of(x["d"], x["e"]))  # of equal lines, the earliest here
        line, n = x["line"], lines.n[x["line"]]
        me = np.repeat(np.arange(len(line)), n)
        p = np.arange(len(me)) - np.repeat(np.cumsum(n) - n, n)
        rest = [lines.without(k, line[me], lines.first[line[me]] + p) for k in (0, 1)]
        place, long = (p + 2).astype(np.uint64), n[me] > MIN_WORDS
        size = n[me].astype(np.uint64)
        v = [np.concatenate([pair(rest[k] + size, place), pair(rest[k][long] + size[long] - _U(1), np.ones(long.sum(), np.uint64)), pair(lines.whole(k, line) + n.astype(np.uint64), np.ones(len(line), np.uint64))]) for k in (0, 1)]
        me = np.concatenate([me, me[long], np.arange(len(line))])
        role = np.repeat(np.array([0, 1, 2], np.uint8), [len(place), long.sum(), len(line)])
        return {"v": v[0], "w": v[1], "role": role, **{c: x[c][me] for c in _PLACE}}

    def judge(x: dict[str, np.ndarray]) -> tuple[dict, dict]:
        """Entries that may stay, and those with an earlier line in their key: of the same role for changed words, of the other one for words left out."""
        x["group"] = np.where(x["role"] == 0, 0, 1).astype(np.uint8)
        x = _order(x, "v", "w", "group")
        rank = np.arange(len(x["v"]))
        new = starts_of(x["v"], x["w"], x["group"])
        starts = np.flatnonzero(new)
        late = np.zeros(len(rank), bool)
        if len(starts):
            of = np.cumsum(new) - 1
            far = np.iinfo(np.int64).max
            least = {r: np.minimum.reduceat(np.where(x["role"] == r, rank, far), starts)[of] for r in (0, 1, 2)}
            for r, other in ((0, 0), (1, 2), (2, 1)):
                late |= (x["role"] == r) & (least[other] < rank)
        # A whole line goes on even if it is late: longer lines elsewhere may come after it.
        return _take(x, ~late | (x["role"] == 2)), _take(x, late, *_PLACE)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _gathered(batches, take):
            stay, gone = judge(x)
            stay.pop("group")
            target = (stay["v"] >> _U(40)).astype(np.int64) % slices
            spread = (scramble(stay["doc"].view(np.uint64) + stay["no"].astype(np.uint64)) % _U(SPREAD)).astype(np.int64)
            whole = np.flatnonzero(stay["role"] == 2)
            at = np.concatenate([np.flatnonzero(stay["role"] != 2), np.repeat(whole, SPREAD)])
            spread = np.concatenate([np.where(stay["role"] == 1, spread, 0)[stay["role"] != 2], np.tile(np.arange(SPREAD), len(whole))])
            yield bundles(target[at] * SPREAD + spread, _take(stay, at))
            out = bundles(-1 - _part(gone["doc"], slices), gone)
            yield _widened(out, _VARIANT)

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        gone = unbundle(table, _PLACE) if key[0].as_py() < 0 else judge(unbundle(table, _VARIANT))[1]
        return pa.Table.from_batches([_removals(gone, parts)])

    return emit, meet


def _cleaner(names: list[str]):
    def clean(docs: pa.Table, gone: pa.Table) -> pa.Table:
        drop: dict[tuple[int, int], list[np.ndarray]] = {}
        for row in gone.select(list(_PLACE)).to_pylist():
            doc, mark, no = (unpack(row[c], kind) for c, kind in _PLACE.items())
            ends = runs(scramble(doc.view(np.uint64)) ^ mark.view(np.uint64))
            for a, b in zip(ends[:-1], ends[1:]):
                if a < b:
                    drop.setdefault((int(doc[a]), int(mark[a])), []).append(no[a:b])
        out = []
        for doc_id, mark, text in zip(docs.column("doc_id").to_pylist(), docs.column("mark").to_pylist(), docs.column("text").to_pylist()):
            lines = (text or "").split("\n")
            n, at = len(lines), drop.get((_NO_ID if doc_id is None else doc_id, mark))
            if at:
                stay = np.ones(n, bool)
                stay[np.concatenate(at)] = False
                lines = [x for x, s in zip(lines, stay.tolist()) if s]
                text = "\n".join(lines)
            out.append((n, n - len(lines), hashlib.sha256((text or "").encode()).hexdigest(), text))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        made = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
        return pa.Table.from_arrays([*[docs.column(c) for c in names], *made], names=[*names, "n_lines", "n_removed", "kept_sha256", "kept"])

    return clean


def drop_near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row without the lines that an earlier line equals, or differs from by one word in MIN_WORDS or more.

    Earlier is by document id, then text hash, then line; null ids come last. A line is a part of the text between line
    feeds; lines without words stay. Lines are equal if their words are. An earlier line counts whether it stays or not.
    Columns: ``row``, a struct of all columns of ``docs`` but the text (so extra columns can't clash), ``n_lines``,
    ``n_removed``, ``kept_sha256`` and ``kept``, the remaining lines. A null text stays null and has one line without
    words. Repeated rows are one document and get equal results. An empty table gives no rows.
    """
    spark = docs.sparkSession
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    length = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    slices = max(shuffle_parts(spark), length >> 23)
    parts = max(shuffle_parts(spark), length >> 22)
    marked = docs.select(F.struct(*others).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), tag(F.col(text_col).cast("string")).alias("mark"))
    texts = marked.select("doc_id", "text", "mark")
    binary = lambda kinds: "key int, " + ", ".join(f"{c} binary" for c in kinds)
    scan, compare = _copies(slices, parts)
    exact = saved(texts.mapInArrow(scan, binary(_EXACT)).groupBy("key").applyInArrow(frugal(compare), _FOUND_SCHEMA))
    company = exact.where("kind = 1").groupBy("key").applyInArrow(frugal(_company), _FOUND_SCHEMA)
    hints = spark.sparkContext.broadcast(_hints(exact.where("kind = 2").union(company), HINT_BITS))
    emit, meet = _neighbours(slices, parts, hints, HINT_BITS)
    near = texts.mapInArrow(emit, binary(_VARIANT)).groupBy("key").applyInArrow(frugal(meet), _FOUND_SCHEMA)
    gone = exact.where("kind = 0").union(near).select("key", *_PLACE)
    here = F.coalesce("doc_id", F.lit(_NO_ID))
    part = F.pmod(here.bitwiseXOR(F.shiftrightunsigned(here, 7)).bitwiseXOR(F.shiftrightunsigned(here, 17)), F.lit(parts)).cast("int")
    grouped = marked.withColumn("key", part).groupBy("key")
    schema = T.StructType([marked.schema["row"]]).add("n_lines", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept", "string")
    return grouped.cogroup(gone.groupBy("key")).applyInArrow(frugal(_cleaner(["row"])), schema)
