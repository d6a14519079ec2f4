"""Alignment of two tokenizers, by inverted bitmaps of token pairs.

Both tokenizers cut a text; where tokens of both end at the same byte the text falls into groups, and the tokens of a
group are linked to one another. Neither has a token that goes on beyond a single space between two letters or signs, so
each stretch between such spaces is cut once, however often a slice of the corpus has it. Documents are numbered within chunks. For each linked pair and chunk there is a bitmap
of the documents that hold the pair, and one for each binary digit of how often (less one) they hold it. Bits set in the
first kind, added up over the chunks, are the pair's count; then every posting hands its count back to its documents, as
often as the planes say.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.bpe import PIECES, read_vocabulary
from shelfcast.llm.common import saved, text_slices
from shelfcast.llm.packing import runs

#: Documents of a chunk at most (numbers have 16 bits), and bytes of text after which a chunk is closed. A longer text is a chunk of its own.
CHUNK_DOCS, CHUNK_BYTES = 1 << 16, 8 << 20
#: Bytes of text cut at a time.
SLICE = 2 << 20
#: Spaces at which any text may be cut in two.
APART = re.compile(r"(?<=\S)\x20(?=\S)")
#: Pairs of different tokens of one group that are made at a time.
PAIRS = 1 << 20
#: Bits of a right id in a pair, of a pair, and of a document's number.
RIGHT, PAIR, NUMBER = 20, 40, 16


class Cutter(NamedTuple):
    """One tokenizer: ids of texts, and the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    pieces: list[bytes]


def byte_level(tokens: dict[bytes, int]) -> Cutter:
    """Of a byte-level BPE vocabulary in which ids follow the order of merging. Special tokens are plain text."""
    import tiktoken

    pieces = [b""] * (max(tokens.values()) + 1)
    for t, i in tokens.items():
        pieces[i] = t
    coder = tiktoken.Encoding("pairs", pat_str=PIECES, mergeable_ranks=tokens, special_tokens={})
    return Cutter(lambda texts: [coder.encode_ordinary(" " + t) for t in texts], pieces)


def sentence_pieces(model: bytes) -> Cutter:
    """Of a sentencepiece model, which puts a space before the text."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_proto=model)

    def piece(i: int) -> bytes:
        name = coder.id_to_piece(i)
        return bytes([int(name[3:-1], 16)]) if coder.is_byte(i) else name.replace("\u2581", " ").encode()

    return Cutter(lambda texts: coder.encode(texts, num_threads=1), [piece(i) for i in range(coder.get_piece_size())])


class Groups(NamedTuple):
    """The groups of a batch of texts: tokens of both kinds with the group each is in, and the groups of each text."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    owner: np.ndarray  # text of each group
    n_a: np.ndarray  # tokens of each text
    n_b: np.ndarray


def cut_groups(texts: list[str | None], left: Cutter, right: Cutter) -> Groups:
    """Texts that are null, empty or not given back byte by byte by both tokenizers have no tokens."""
    ids = [[[]] * len(texts), [[]] * len(texts)]
    some = [i for i, t in enumerate(texts) if t]
    for kept, cutter in zip(ids, (left, right)):
        for i, x in zip(some, cutter.encode([texts[i] for i in some])):
            kept[i] = x

    def back(cutter: Cutter, found: Iterable[list[int]]) -> bytes:
        return b"".join(map(cutter.pieces.__getitem__, chain.from_iterable(found)))

    whole = "".join([" " + texts[i] for i in some]).encode()
    if not (whole == back(left, ids[0]) == back(right, ids[1])):
        for i in some:
            if not (b" " + texts[i].encode() == back(left, [ids[0][i]]) == back(right, [ids[1][i]])):
                ids[0][i] = ids[1][i] = []
    flat, ends, counts = [], [], []
    for kept, pieces in zip(ids, (left.pieces, right.pieces)):
        flat.append(np.fromiter(chain.from_iterable(kept), np.int64))
        size = np.array([len(p) for p in pieces], np.int64)
        ends.append(np.cumsum(size[flat[-1]]))  # both kinds cover the same bytes, so ends are comparable over all texts
        counts.append(np.array([len(x) for x in kept], np.int64))
    common = np.intersect1d(*ends)
    group_a, group_b = (np.searchsorted(common, e) for e in ends)
    owner = np.repeat(np.arange(len(texts)), counts[0])
    first = np.searchsorted(group_a, np.arange(len(common)))
    return Groups(*flat, group_a, group_b, owner[first], *counts)


def marked(n: int, end: str) -> list[bytes]:
    """Ids as decimals, each followed by a comma, and by the mark that ends its side of a group."""
    return [f"{i}{mark}".encode() for i in range(n) for mark in (",", end)]


def written(g: Groups, names: list[bytes], n: int) -> list[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3;``. ``names``: those of the ``n`` left ids, then of the right ones."""
    last_a, last_b = (np.append(x[1:] != x[:-1], True) if len(x) else np.zeros(0, bool) for x in (g.group_a, g.group_b))
    order = np.argsort(np.concatenate([g.group_a * 2, g.group_b * 2 + 1]), kind="stable")
    place = np.concatenate([g.a * 2 + last_a, (n + g.b) * 2 + last_b])[order].tolist()
    ends = np.concatenate([[0], np.cumsum(g.n_a + g.n_b)]).tolist()
    return [b"".join(map(names.__getitem__, place[s:e])) for s, e in zip(ends, ends[1:])]


def link_counts(g: Groups) -> tuple[np.ndarray, np.ndarray]:
    """Keys ``text << PAIR | pair`` in order, and the number of links of each.

    Equal tokens of a group are counted, not paired, and the pairs are made a million at a time, so that a group of any
    size fits.
    """
    n = len(g.owner)

    def tokens(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Group and id of the different tokens of each group, how often each is there, and where the groups start."""
        both, times = np.unique(group << 32 | ids, return_counts=True)
        return both >> 32, both & 0xFFFFFFFF, times, np.searchsorted(both >> 32, np.arange(n + 1))

    (of, a, times_a, _), (_, b, times_b, first) = tokens(g.group_a, g.a), tokens(g.group_b, g.b)
    many = np.diff(first)[of]  # partners of each left token
    done = np.cumsum(many)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, "right")))
        at = np.repeat(np.arange(lo, hi), many[lo:hi])
        other = np.arange(len(at)) - np.repeat(done[lo:hi] - many[lo:hi] - (done[lo - 1] if lo else 0), many[lo:hi]) + first[of[at]]
        found.append(added(g.owner[of[at]] << PAIR | a[at] << RIGHT | b[other], times_a[at] * times_b[other]))
        lo = hi
    return added(*(np.concatenate(x) for x in zip(*found)))


def added(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sums of ``times``."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = runs(key)[:-1] if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(times[order], at) if len(at) else times


def bitmaps(group: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """For each run of equal ``group`` its documents, compressed: as 16-bit numbers, or as bits where these are shorter."""
    ends = runs(group)
    n = np.diff(ends)
    wide = (docs + 7) // 8
    dense = n * 2 > wide
    size = np.where(dense, wide, n * 2)
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros(offsets[-1], np.uint8)
    sparse = np.repeat(~dense, n)
    to = np.repeat(offsets[:-1], n)[sparse] + 2 * (np.arange(len(doc)) - np.repeat(ends[:-1], n))[sparse]
    data[to], data[to + 1] = doc[sparse] & 255, doc[sparse] >> 8
    for i in np.flatnonzero(dense):
        bits = np.zeros(wide * 8, np.uint8)
        bits[doc[ends[i] : ends[i + 1]]] = 1
        data[offsets[i] : offsets[i + 1]] = np.packbits(bits)
    made = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    return group[ends[:-1]], made, n


class Aligned(NamedTuple):
    """A batch of texts: keys ``pair << NUMBER | text`` in order with their numbers of links, and what is told of each text."""

    key: np.ndarray
    times: np.ndarray
    told: list[tuple]


def align_texts(texts: list[str | None], left: Cutter, right: Cutter, names: list[bytes]) -> Aligned:
    """Cuts the different stretches of the texts, and puts the texts together again from what was found of each."""
    place: dict[str, int] = {}
    counts, at = [], []
    for t in texts:
        parts = APART.split(t) if t else []
        counts.append(len(parts))
        at.extend([place.setdefault(p, len(place)) for p in parts])
    at, counts = np.array(at, np.int64), np.array(counts, np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    g = cut_groups(list(place), left, right)
    bad = np.bincount(owner, weights=(g.n_a == 0)[at], minlength=len(texts)) > 0
    at, owner = at[~bad[owner]], owner[~bad[owner]]

    key, times = link_counts(g)
    first = np.searchsorted(key, np.arange(len(place) + 1) << PAIR)
    size = np.diff(first)[at]
    entry = np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
    both = added((key[entry] & (1 << PAIR) - 1) << NUMBER | np.repeat(owner, size), times[entry])

    groups = np.bincount(g.owner, minlength=len(place))
    links = np.zeros(len(place), np.int64)
    np.add.at(links, g.owner, np.bincount(g.group_a, minlength=len(g.owner)) * np.bincount(g.group_b, minlength=len(g.owner)))
    numbers = []
    for each in (g.n_a, g.n_b, groups, links):
        total = np.zeros(len(texts), np.int64)
        np.add.at(total, owner, each[at])
        numbers.append(total.tolist())
    pieces, at = written(g, names, len(left.pieces)), at.tolist()
    ends = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    digests = [hashlib.sha256(b"".join([pieces[x] for x in at[s:e]])[:-1]).hexdigest() if e > s else "" for s, e in zip(ends, ends[1:])]
    return Aligned(*both, list(zip(*numbers, digests)))


DOCS = [("no", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
ROWS = [("chunk", pa.int64()), ("docs", pa.int32()), ("pair", pa.int64()), ("plane", pa.int32()), ("n", pa.int64()), ("bitmap", pa.binary()), *DOCS]
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
_RESULT = [*DOCS[1:-1], ("n_best", pa.int64()), ("count_sum", pa.int64()), DOCS[-1]]


def _schema(fields: list[tuple]) -> str:
    return ", ".join(f"{name} {_SQL[kind]}" for name, kind in fields)


def _batch(n: int, columns: dict) -> pa.RecordBatch:
    filled = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in ROWS]
    return pa.RecordBatch.from_arrays(filled, [c for c, _ in ROWS])


def chunk_rows(chunk: int, docs: list[dict], parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """A chunk's documents and its postings, the slices' bitmaps joined: plane 0 for the documents, plane k for digit k - 1 of the links less one."""
    n = len(docs)
    yield _batch(n, {"chunk": np.full(n, chunk), "docs": np.full(n, n), "no": np.arange(n), **{c: [d[c] for d in docs] for c, _ in DOCS[1:]}})
    key, times = added(*(np.concatenate(x) for x in zip(*parts)))
    pair, doc, more = key >> NUMBER, key & (1 << NUMBER) - 1, times - 1
    for plane in range(1 + int(more.max(initial=0)).bit_length()):
        on = more >> plane - 1 & 1 == 1 if plane else np.ones(len(pair), bool)
        pairs, made, size = bitmaps(pair[on], doc[on], n)
        for lo in range(0, len(pairs), 1 << 14):
            k = len(pairs[lo : lo + (1 << 14)])
            yield _batch(k, {"chunk": np.full(k, chunk), "docs": np.full(k, n), "pair": pairs[lo : lo + k], "plane": np.full(k, plane), "n": size[lo : lo + k], "bitmap": made.slice(lo, k)})


_CUTTERS: dict[tuple, tuple] = {}


def _aligner(paths: tuple[str, str], files):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _CUTTERS:  # once for all tasks of a Python worker
            cutters = byte_level(files.value[0]), sentence_pieces(files.value[1])
            _CUTTERS[paths] = *cutters, marked(len(cutters[0].pieces), "|") + marked(len(cutters[1].pieces), ";")
        left, right, names = _CUTTERS[paths]
        chunk, docs, parts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in text_slices(batches, "text", SLICE):
            if docs and (held + batch.nbytes > CHUNK_BYTES or len(docs) + batch.num_rows > CHUNK_DOCS):
                yield from chunk_rows(chunk, docs, parts)
                chunk, docs, parts, held = chunk + 1, [], [], 0
            found = align_texts(batch.column("text").to_pylist(), left, right, names)
            parts.append((found.key + len(docs), found.times))
            docs.extend(dict(zip((c for c, _ in DOCS[1:]), (i, *told))) for i, told in zip(batch.column("doc_id").to_pylist(), found.told))
            held += batch.nbytes
        if docs:
            yield from chunk_rows(chunk, docs, parts)

    return align


def _hand_back(rows: pa.Table) -> pa.Table:
    """Documents of one chunk with what their postings return."""
    rows = rows.combine_chunks()
    docs = rows.filter(rows["no"].is_valid()).sort_by("no")
    postings = rows.filter(rows["no"].is_null())
    size = docs.num_rows
    sums, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    if postings.num_rows:
        n, plane, count = (postings[c].to_numpy() for c in ("n", "plane", "count"))
        times = np.left_shift(1, np.maximum(plane - 1, 0).astype(np.int64))
        top = postings["best"].to_numpy(zero_copy_only=False)
        dense = n * 2 > (size + 7) // 8
        flat = postings["bitmap"].filter(pa.array(~dense)).combine_chunks()
        flat = b"".join(flat.to_pylist()) if len(flat) else b""
        at = np.frombuffer(flat, "<u2").astype(np.int64)
        np.add.at(sums, at, np.repeat((count * times)[~dense], n[~dense]))
        np.add.at(best, at, np.repeat(np.where(top, times, 0)[~dense], n[~dense]))
        for bitmap, i in zip(postings["bitmap"].filter(pa.array(dense)).to_pylist(), np.flatnonzero(dense).tolist()):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8)))
            sums[at] += count[i] * times[i]
            best[at] += times[i] if top[i] else 0
    return pa.table([docs[c] if c in docs.column_names else {"n_best": best, "count_sum": sums}[c] for c, _ in _RESULT], names=[c for c, _ in _RESULT])


def pair_counts(postings: DataFrame) -> DataFrame:
    """``pair``, ``count``, the documents that hold it, and ``best``, whether no pair of its left id has more.

    A pair has one row per chunk at most, and a left id one pair per right id, so no key is hot.
    """
    counts = postings.where("plane = 0").groupBy("pair").agg(F.sum("n").alias("count"))
    left = F.shiftright("pair", RIGHT)
    most = counts.groupBy(left.alias("_a")).agg(F.max("count").alias("_most"))
    return counts.join(most, left == F.col("_a")).select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def align_tokenizers(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How the tokens of two vocabularies meet in each document.

    ``left`` is a byte-level BPE file, ``right`` a sentencepiece model; both see a space and the text, and special
    tokens in a text are plain text. Columns: ``doc_id``, ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links`` (pairs
    of token occurrences of one group), ``n_best`` (links whose pair is held by as many documents as any pair of its
    left id, ties included), ``count_sum`` (of the documents that hold each link's pair) and ``groups_sha256``. Null and
    empty texts, and those that a tokenizer does not give back byte by byte, have zeros and an empty digest. Texts are
    cut whole, whatever their length; repeated rows are documents of their own; null ids and extra columns are no
    matter. An empty table gives no rows. What is gathered in one task is a chunk of some megabytes of text.
    """
    spark = docs.sparkSession
    with open(right, "rb") as f:
        files = spark.sparkContext.broadcast((read_vocabulary(left)["tokens"], f.read()))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = saved(rows.mapInArrow(_aligner((left, right), files), _schema(ROWS)))
    postings = made.where("no IS NULL").select("chunk", "pair", "plane", "n", "bitmap")
    told = postings.join(pair_counts(postings), "pair").drop("pair")
    listed = made.where("no IS NOT NULL").select("chunk", *[c for c, _ in DOCS])
    return listed.unionByName(told, allowMissingColumns=True).groupBy("chunk").applyInArrow(_hand_back, _schema(_RESULT))
