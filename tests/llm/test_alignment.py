"""Token pairs of two tokenizers against a count over all documents at once."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfcast.llm import alignment
from shelfcast.llm.alignment import added, align_tokenizers, bitmaps, chunk_rows
from shelfcast.llm.queries import pieces_path, vocabulary_path

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(rows):
    """The results for rows (doc_id, text), by the vocabularies' own libraries."""
    a_of, b_of = Tokenizer.from_file(vocabulary_path()), sentencepiece.SentencePieceProcessor(model_file=pieces_path())
    a_of.encode_special_tokens = True
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def piece(i):
        p = b_of.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    docs = []
    for i, text in rows:
        groups = []
        if text:
            a = a_of.encode(" " + text, add_special_tokens=False).ids
            b = b_of.encode(text)
            pa_, pb = [bytes(byte[c] for c in a_of.id_to_token(x)) for x in a], [piece(x) for x in b]
            if b"".join(pa_) == (" " + text).encode() == b"".join(pb):
                ends_a, ends_b = np.cumsum([len(x) for x in pa_]), np.cumsum([len(x) for x in pb])
                both = set(ends_a.tolist()) & set(ends_b.tolist())
                for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
                    made = [[]]
                    for x, e in zip(ids, ends.tolist()):
                        made[-1].append(x)
                        if e in both:
                            made.append([])
                    groups.append(made[:-1])
                groups = list(zip(*groups))
        docs.append((i, groups))
    holding = Counter(p for _, groups in docs for p in {(x, y) for a, b in groups for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in holding.items():
        most[x] = max(most[x], n)
    out = []
    for i, groups in docs:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(holding[p] == most[p[0]] for p in links), sum(holding[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def texts(folder):
    rnd = random.Random(7)
    real = pq.read_table(f"{folder}/documents.parquet").column("text").to_pylist()[:150]
    odd = [None, "", " ", "\n\n\t x  ", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "é中文字😀́", "x" * 300, "the the the", "aaaa " * 40, "  ", "\x00\x01", "ab" * 700 + " the" * 3000]
    return real + odd + ["".join(rnd.choices("ab é中.\n▁", k=rnd.randrange(1, 60))) for _ in range(100)]


def test_alignment_is_the_plain_one(spark, make, folder):
    rows = list(enumerate(texts(folder)))
    rows += [(None, "the end"), (3, "the end"), (3, "the end"), *((1000 + i, "of the end, of the end") for i in range(60))]
    key = lambda r: tuple(map(str, r))
    got = align_tokenizers(make(rows).repartition(3), vocabulary_path(), pieces_path()).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_no_documents(make):
    assert align_tokenizers(make([]), vocabulary_path(), pieces_path()).count() == 0


def test_bitmaps_keep_documents_and_times():
    rng = np.random.default_rng(4)
    key, times = added((rng.integers(0, 40, 20_000) ** 2 << alignment.NUMBER) | rng.integers(0, 500, 20_000), rng.integers(1, 4, 20_000))
    docs = [{c: 0 if kind != pa.string() else "" for c, kind in alignment.DOCS[1:]} for _ in range(500)]
    split = rng.random(len(key)) < 0.5  # two slices that share keys
    parts = [(key[split], times[split]), (key[~split], times[~split]), (key[:100], times[:100])]
    want = Counter()
    for k, t in parts:
        for x, y in zip(k.tolist(), t.tolist()):
            want[x] += y
    got = Counter()
    for batch in list(chunk_rows(0, docs, parts))[1:]:
        for r in batch.to_pylist():
            wide = (500 + 7) // 8
            at = np.flatnonzero(np.unpackbits(np.frombuffer(r["bitmap"], np.uint8))) if r["n"] * 2 > wide else np.frombuffer(r["bitmap"], "<u2")
            assert len(at) == r["n"] and len(r["bitmap"]) <= wide
            for d in at.tolist():
                got[r["pair"] << alignment.NUMBER | d] += 1 << max(0, r["plane"] - 1)
    assert got == want
    assert len(bitmaps(np.zeros(0, np.int64), np.zeros(0, np.int64), 5)[1]) == 0


def test_cutting_in_parts_changes_nothing(folder, monkeypatch):
    """Small blocks of pairs, and texts cut at their spaces, give the links of whole texts."""
    with open(pieces_path(), "rb") as f:
        left, right = alignment.byte_level(alignment.read_vocabulary(vocabulary_path())["tokens"]), alignment.sentence_pieces(f.read())
    names = alignment.marked(len(left.pieces), "|") + alignment.marked(len(right.pieces), ";")
    some = [t for t in texts(folder) if "▁" not in (t or "")]
    want = alignment.align_texts(some, left, right, names)
    monkeypatch.setattr(alignment, "PAIRS", 50)
    got = alignment.align_texts(some, left, right, names)
    assert got.told == want.told and (got.key == want.key).all() and (got.times == want.times).all()
    monkeypatch.setattr(alignment, "APART", re.compile("(?!)"))
    got = alignment.align_texts(some, left, right, names)
    assert got.told == want.told and (got.key == want.key).all() and (got.times == want.times).all()
