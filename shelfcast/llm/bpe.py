"""BPE encoding and decoding by a depth-first walk over the trie of distinct words.

In a byte-level BPE vocabulary the encoding of every prefix of a word is determined by its last token: the last token of
``p`` is the one suffix ``t`` for which the last token of ``p`` without ``t`` and ``t`` stay apart when merged on their
own. So a trie node needs one token only, and words with a common prefix share the states of that prefix.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import text_slices

#: Fixed value: how vocabularies of this kind cut a text into words before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beside a space: there, words can't be found by cutting at spaces.
AWKWARD = r"\s\x20|\x20\s|\x20\Z"
#: Words, and pairs of tokens, remembered by a worker in each of two generations; a memory bound without influence on results.
REMEMBERED = 200_000
#: Words that a worker keeps after a task.
KEPT = 40_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _byte_letters() -> dict[str, int]:
    """Letters by which vocabulary files write bytes: visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> dict:
    """Tokens as bytes, ranks of merges and special tokens of a tokenizer file. Read on the driver, about 2 MB."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letter = _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = {bytes(letter[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    merges = {}
    for rank, (a, b) in enumerate(pairs):
        left, right = (bytes(letter[c] for c in x) for x in (a, b))
        merges.setdefault((tokens[left], tokens[right]), (rank, tokens[left + right]))
    return {"tokens": tokens, "merges": merges, "special": special}


class Remembered:
    """Values by key in two generations: what is looked up moves to the current one; a full one ousts the one before it."""

    def __init__(self):
        self.now: dict = {}
        self.before: dict = {}

    def rest(self) -> None:
        """Between tasks a worker, which may do other work next, keeps few words."""
        if len(self.now) + len(self.before) > KEPT:
            self.now, self.before = {}, {}

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that are unknown; the known ones are in the current generation afterwards."""
        if len(self.now) > REMEMBERED:
            self.now, self.before = {}, self.now
        new = keys.difference(self.now)
        for key in new.intersection(self.before):
            self.now[key] = self.before[key]
        return new.difference(self.now)


class TrieEncoder:
    def __init__(self, vocabulary: dict):
        import regex

        self.tokens, self.merges, self.special = vocabulary["tokens"], vocabulary["merges"], vocabulary["special"]
        self.text_of = [b""] * (max([*self.tokens.values(), *self.special.values()]) + 1)
        for t, i in self.tokens.items():
            self.text_of[i] = t
        for t, i in self.special.items():
            self.text_of[i] = t.encode()
        self.cut = regex.compile(PIECES).findall
        self.awkward = regex.compile(AWKWARD).search
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.beginnings = {t[:n] for t in self.tokens for n in range(1, len(t) + 1)}
        self.state_of: dict[bytes, int] = {b"": 0}  # states met so far, by the longest end of the word that begins a token
        self.ending: list[bytes] = [b""]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]  # by state: tokens that the word may end with and their sizes, longest first
        self.goes: dict[int, int] = {}  # state after state << 8 | byte
        self.apart, self.spaced, self.plain = {}, Remembered(), Remembered()
        self.bytes_of: pa.Array | None = None

    def merged(self, data: bytes) -> list[int]:
        """Merges by rank, for the few bytes of a pair of tokens."""
        ids = [self.tokens[data[i : i + 1]] for i in range(len(data))]
        while True:
            found = [(self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
            if not found:
                return ids
            at = min(found)[1]
            ids[at : at + 2] = [self.merges[ids[at], ids[at + 1]][1]]

    def stay_apart(self, key: int) -> bool:
        """Whether the tokens ``key >> 32`` and ``key & 0xFFFFFFFF`` side by side are not merged in any way."""
        a, b = key >> 32, key & 0xFFFFFFFF
        if len(self.apart) > 2 * REMEMBERED:
            for old in list(itertools.islice(self.apart, REMEMBERED)):
                del self.apart[old]
        found = self.apart[key] = self.merged(self.text_of[a] + self.text_of[b]) == [a, b]
        return found

    def go(self, state: int, byte: int) -> int:
        """The state one byte on, found once for each state and byte."""
        end = self.ending[state] + bytes([byte])
        while end not in self.beginnings:
            end = end[1:]
        after = self.state_of.setdefault(end, len(self.ending))
        if after == len(self.ending):
            self.ending.append(end)
            self.ends.append(tuple((self.tokens[end[i:]], len(end) - i) for i in range(len(end)) if end[i:] in self.tokens))
        self.goes[state << 8 | byte] = after
        return after

    def walk(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Encodings of distinct words as little-endian 32-bit ids.

        Sorted words are the trie in depth-first order: the states of the common prefix with the word before stay on
        the stack, and only the rest of the word is new. A state knows the tokens that may come last; the shortest is
        a single byte and needs no check, since one of them must be right.
        """
        goes, go, ends, known, apart, text_of = self.goes.get, self.go, self.ends, self.apart, self.stay_apart, self.text_of
        last: list[int] = []  # last[i]: last token of the first i + 1 bytes
        path = [0]  # state after i bytes
        before, out = b"", {}
        for word in sorted(words):
            same = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            del last[same:], path[same + 1 :]
            state = path[-1]
            for end in range(same, len(word)):
                after = goes(state << 8 | word[end])
                state = go(state, word[end]) if after is None else after
                path.append(state)
                for token, size in ends[state]:
                    if size > end or size == 1:
                        break
                    key = last[end - size] << 32 | token
                    good = known.get(key)
                    if apart(key) if good is None else good:
                        break
                last.append(token)
            ids, end = [], len(word)
            while end:
                ids.append(last[end - 1])
                end -= len(text_of[last[end - 1]])
            out[word] = struct.pack(f"<{len(ids)}I", *ids[::-1])
            before = word
        return out

    def learn(self, spaced: set[str], plain: set[str]) -> None:
        """Remember the ids of words that follow a space, and of other words."""
        cuts = {w: self.cut(" " + w) for w in spaced}, {w: self.cut(w) for w in plain}
        ids = self.walk({p.encode() for cut in cuts for pieces in cut.values() for p in pieces})
        for known, cut in zip((self.spaced.now, self.plain.now), cuts):
            known.update((w, b"".join([ids[p.encode()] for p in pieces])) for w, pieces in cut.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit numbers."""
        plans = []  # (special id, first word, spaced words) or (special id, pieces, None)
        for text in texts:
            plan = []
            for part in self.split_special(text or "") if self.split_special else [text or ""]:
                if part in self.special:
                    plan.append((self.special[part], None, None))
                elif self.awkward(part):
                    plan.append((None, self.cut(part), None))
                elif part:
                    first, *rest = part.split(" ")
                    plan.append((None, [first] if first else [], rest))
            plans.append(plan)
        spaced = {w for plan in plans for _, _, rest in plan if rest for w in rest}
        plain = {w for plan in plans for _, first, _ in plan if first for w in first}
        self.learn(self.spaced.missing(spaced), self.plain.missing(plain))
        get_spaced, get_plain = self.spaced.now.__getitem__, self.plain.now.__getitem__
        out = []
        for plan in plans:
            parts = []
            for special, first, rest in plan:
                if special is not None:
                    parts.append(special.to_bytes(4, "little"))
                else:
                    parts.extend(map(get_plain, first))
                    if rest:
                        parts.extend(map(get_spaced, rest))
            out.append(b"".join(parts))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The texts of many documents in UTF-8, from one gathering of their tokens' bytes."""
        if self.bytes_of is None:
            self.bytes_of = pa.array(self.text_of, pa.large_binary())
        joined = self.bytes_of.take(pa.array(np.concatenate([np.zeros(0, "<u4"), *ids])))
        _, at, data = joined.buffers()
        at = np.frombuffer(at, np.int64, len(joined) + 1)
        ends = at[np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])].tolist()
        out = []
        for s, e in zip(ends, ends[1:]):
            raw = data[s:e].to_pybytes() if e > s else b""
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = raw.decode("utf-8", "replace").encode()
            out.append(raw)
        return out


_ENCODERS: dict[str, TrieEncoder] = {}


def _encoder(path: str, vocabulary: dict) -> TrieEncoder:
    """One encoder for all tasks of a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(vocabulary)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document's tokens, and the digest of its ids and of the text decoded from them.

    Columns: ``doc_id``, those of ``carry`` as strings, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked
    for, ``ids``. Null texts are empty: no tokens, and the digests of no bytes. Special tokens of the file are found in
    texts, as the vocabulary's own library does. Repeated rows, null ids and extra columns are no matter, as rows are
    taken one by one: there is no shuffle. The vocabulary is broadcast; its size is that of the file.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, vocabulary.value)
        for batch in text_slices(batches, "text"):
            ids = encoder.encode(batch.column("text").to_pylist())
            numbers = [np.frombuffer(x, "<u4") for x in ids]
            columns = [batch.column("doc_id"), *[batch.column(c) for c in carry], pa.array([len(x) for x in numbers], pa.int64())]
            columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()))
            columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in encoder.decode(numbers)], pa.string()))
            names = ["doc_id", *carry, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                at = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(numbers).astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        encoder.spaced.rest()
        encoder.plain.rest()

    more = "".join(f", {c} string" for c in carry)
    schema = SCHEMA.replace("doc_id long", f"doc_id long{more}") + (", ids array<int>" if with_ids else "")
    columns = [F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in carry], F.col(text_col).cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(run, schema)
