"""Operators on texts against plain versions of the same contract."""

import math
import random
import re

import numpy as np
import pytest

from shelfcast.llm import privacy, queries
from shelfcast.llm.bpe import TrieEncoder, encode_documents, read_vocabulary
from shelfcast.llm.fingerprints import Sketches, differing, fingerprints, paragraphs
from shelfcast.llm.jaccard import similar_documents
from shelfcast.llm.lines import drop_near_lines
from shelfcast.llm.privacy import CAUTION, GENERALISE, KINDS, REMOVE, find_private
from shelfcast.llm.substrings import remove_repeated_passages

KEY = lambda r: str(r)


# --- BPE


@pytest.fixture(scope="module")
def path():
    return queries.vocabulary_path()


def test_encoder_is_the_library(path):
    from tokenizers import Tokenizer

    theirs, mine = Tokenizer.from_file(path), TrieEncoder(read_vocabulary(path))
    rnd = random.Random(3)
    bits = [" ", "  ", "\n", "\t", " \n", "\r\n", "the", "'s", "'", "'ll", "é", "中文", "😀", "1", "23", "½", "...", "<|endoftext|>", "<|", "\x1c", "\x85", "​", "x" * 300, " " * 90]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(30))) for _ in range(3000)] + ["", "a" * 5000]
    for text, a, b in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), mine.encode(texts)):
        ids = np.frombuffer(b, "<u4").tolist()
        assert a.ids == ids, text
        assert mine.decode([np.array(ids, "<u4")])[0].decode() == theirs.decode(ids, skip_special_tokens=False) == text


def test_encode_documents(make, odd_rows, sha, path):
    rows = encode_documents(make(odd_rows), path, with_ids=True, carry=("source",)).collect()
    assert len(rows) == len(odd_rows)
    texts = {(r[0], sha(r[1] or "")) for r in odd_rows}
    assert {(r.doc_id, r.decoded_sha256) for r in rows} == texts
    assert all(r.n_tokens == len(r.ids) and sha(np.array(r.ids, "<u4").tobytes()) == r.ids_sha256 and r.source == "a" for r in rows)
    assert encode_documents(make([]), path).count() == 0


# --- Repeated passages


def plain_passages(rows, words, size=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            first[key] = min(first.get(key, (2, 0)), (i is None, i or 0))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {q for p in range(len(w) - size + 1) if first[tuple(w[p : p + size])] < (i is None, i or 0) for q in range(p, p + size)}
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return sorted(out, key=KEY)


def test_passages(make, odd_rows, words, sha):
    rnd = random.Random(5)
    shared = [[f"s{k}_{i}" for i in range(60 + k)] for k in range(4)]
    rows = list(odd_rows)
    for i in range(60):
        parts = [[f"d{i}_{rnd.randrange(40)}" for _ in range(rnd.randrange(30))]]
        for _ in range(rnd.randrange(3)):
            s = rnd.choice(shared)
            cut = rnd.randrange(15)
            parts += [s[cut:], [f"x{rnd.randrange(9)}"]]
        rows.append((100 + rnd.randrange(50), "\n".join(" ".join(p) for p in parts)))
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeated_passages(make(rows)).collect()], key=KEY)
    assert got == plain_passages(rows, words)
    assert any(r[2] for r in got)
    # A sketch that is far too small takes nearly every window for repeated, and the result is the same.
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeated_passages(make(rows), max_width_bits=8).collect()], key=KEY) == got
    assert all(r.kept_sha256 == sha(r.kept) for r in remove_repeated_passages(make(rows[:5])).collect())
    assert remove_repeated_passages(make([])).count() == 0


# --- Near lines


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a == b[:p] + b[p + 1 :] for p in range(len(b)))


def test_near_lines(make, odd_rows, words):
    rnd = random.Random(7)
    rows = list(odd_rows)
    base = [[f"b{k}{i}" for i in range(7 + k)] for k in range(5)]
    for i in range(40):
        lines = []
        for _ in range(rnd.randrange(1, 6)):
            line = list(rnd.choice(base))
            for _ in range(rnd.randrange(3)):
                p = rnd.randrange(len(line))
                rnd.choice([lambda: line.insert(p, "new" + str(rnd.randrange(3))), lambda: line.pop(p), lambda: line.__setitem__(p, "z" + str(rnd.randrange(3)))])()
            lines.append("  ".join(line))
        rows.append((100 + i, "\n".join([*lines, ""])))
    got = drop_near_lines(make(rows)).select("row.doc_id", "row.row", "n_lines", "n_removed", "kept").collect()
    assert len(got) == len(rows) and all(r.row == "r" for r in got)
    # Rows of one id with different texts are ordered by a hash, so id 4 is left out of the comparison; its lines count as one.
    ordered = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1]))
    seen, expected = [], {}
    for none, i, t in ordered:
        kept, mine = [], []
        for line in t.split("\n"):
            w = words(line)
            if not (w and any(w == x or (min(len(w), len(x)) >= 8 and one_apart(w, x)) for x in seen + mine)):
                kept.append(line)
            if w:
                mine.append(w)
        seen += mine
        if not (i == 4 or none):
            expected[i] = "\n".join(kept)
    for r in got:
        if r.doc_id in expected:
            assert r.kept == expected[r.doc_id], r.doc_id
        if r.kept is None:
            assert (r.n_lines, r.n_removed) == (1, 0)
    assert sum(r.n_removed for r in got) > 30
    fours = [r for r in got if r.doc_id == 4]
    assert len(fours) == 3 and len({(r.n_lines, r.n_removed, r.kept) for r in fours}) == 2
    assert drop_near_lines(make([])).count() == 0


# --- Fingerprints


def test_sketches_tell_differences():
    rng = np.random.default_rng(1)
    left = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (0, 1, 30, 400)]
    right = [np.concatenate([x[len(x) // 3 :], rng.integers(0, 1 << 62, len(x) // 5 + 1).astype(np.uint64)]) for x in left]
    sets = [np.unique(x) for x in left + right]
    owner = np.repeat(np.arange(8), [len(s) for s in sets])
    h = np.concatenate(sets)
    small = Sketches(8, 8)
    small.put(owner, h)
    got = differing(np.arange(4), np.arange(4, 8), owner, h, small)
    assert got.tolist() == [len(np.setxor1d(sets[i], sets[i + 4])) for i in range(4)]


def test_fingerprints(make, odd_rows, sha):
    got = sorted(fingerprints(make(odd_rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    ordered = sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected = set()
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        t, n = t or "", n or ""
        expected.add((i, len(t), sha(t[: len(t) - len(t) // 4] + n[: len(t) // 4])))
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in got} == expected and len(got) == len(odd_rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = {}
    import pyarrow as pa

    for (_, t), r in zip(ordered, got):
        if [x for x, _ in ordered].count(r.doc_id) == 1:
            assert by_text.setdefault(t or "", r.fingerprint) == r.fingerprint
    one = fingerprints(make([(1, "a b c")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints(make([])).count() == 0
    # Likeness is the share of common paragraphs, whatever the tables' sizes.
    texts = [f"line {i % 7} x\n" * 3 + "\n".join(f"p{i} {j}" for j in range(i * 9)) for i in range(12)]
    owner, h, sizes = paragraphs(pa.array(texts))
    sets = [set(h[owner == i].tolist()) for i in range(len(texts))]
    rows = {r.doc_id: r.near_next for r in fingerprints(make(list(enumerate(texts)))).collect()}
    for i in range(12):
        a, b = sets[i], sets[(i + 1) % 12]
        assert rows[i] == pytest.approx(len(a & b) / len(a | b))


# --- Near copies


def test_similar_documents(make, odd_rows, words):
    rnd = random.Random(11)
    rows = list(odd_rows)
    for i in range(25):
        base = [f"t{i}_{rnd.randrange(500)}" for _ in range(rnd.randrange(3, 200))]
        for _ in range(rnd.randrange(1, 9)):
            w = list(base)
            for _ in range(rnd.randrange(6)):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(1000)}"
            rows.append((1000 + len(rows), " ".join(w)))
    got = similar_documents(make(rows)).collect()
    assert len(got) == len(rows)
    grams = {t: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in rows if t is not None}
    alike = {t: {u for u, b in grams.items() if u != t and a and b and 10 * len(a & b) >= 8 * len(a | b)} for t, a in grams.items()}
    ids = {}
    for i, t in rows:
        ids.setdefault(t, []).append(i)
    for r in got:
        texts = [t for i, t in rows if i == r.doc_id]
        assert r.links in {len(alike.get(t, ())) for t in texts}
        if len(set(texts)) == 1 and texts[0] in alike and grams[texts[0]]:
            group, todo = set(), [texts[0]]
            while todo:
                t = todo.pop()
                if t not in group:
                    group.add(t)
                    todo += alike[t]
            known = [i for t in group for i in ids[t] if i is not None]
            assert r.class_id == min(known, default=None)
        elif len(set(texts)) == 1:
            assert r.class_id == r.doc_id
    assert similar_documents(make([])).count() == 0


# --- Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base_spans(t):
    found = [(m.start(), i, k, m.end()) for i, k in enumerate(KINDS) for m in re.finditer(PATTERNS[k], t) if holds(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_base_spans(make, odd_rows, sha):
    rnd = random.Random(13)
    bits = ["a", "b.c", "@", ".", "x@y.z", "1.2.3.4", "999.1.1.1", "0000012.1.1.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111", "+1 (415) 555-0100", "+", "-", " ", "  ", "7", "12", "é", "😀", "\n", "%", "_", "(", ")", "+49 30 1234567", "79927398713", "378282246310005"]
    rows = odd_rows + [(100 + i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25)))) for i in range(400)]
    rows += [(900, "a" * 60_000 + " 5" * 30_000), (901, "1." * 30_000 + "+" * 5_000), (902, ("a@" * 20_000)), (903, "+1" + " ." * 30_000)]
    for r in find_private(make(rows), generalise=2.0, remove=2.0).collect():
        texts = [t or "" for i, t in rows if i == r.doc_id]
        spans = {base_spans(t) for t in texts}
        assert r.spans in spans and r.base_sha256 in {sha(s) for s in spans}, texts
        assert [getattr(r, f"n_{k}") for k in KINDS] in [[s.count(k + ":") for k in KINDS] for s in spans]
    assert find_private(make([])).count() == 0


def disclosed(texts, generalise=GENERALISE, remove=REMOVE):
    """Actions of the terms of each different text, by counting all pairs."""
    texts = sorted(set(texts))
    parts = {"email": lambda v: v.split("@")[1], "ip": lambda v: ".".join(v.split(".")[:2]), "card": lambda v: v[:6], "phone": lambda v: v[:5]}
    held, has = {}, {}
    for t in texts:
        for k in KINDS:
            for m in re.finditer(PATTERNS[k], t):
                if holds(k, m[0]):
                    v = re.sub("[^0-9]", "", m[0]) if k in ("card", "phone") else m[0].lower()
                    for name in ((k, 0, v), (k, 1, parts[k](v))):
                        held.setdefault(name, set()).add(t)
        for w in set(re.findall(r"[^\x20\x09-\x0D]+", t)):
            has.setdefault(w, set()).add(t)
    out, n = {t: {} for t in texts}, len(texts)
    for inside in held.values():
        for w, where in has.items():
            both = inside & where
            if both and len(inside) < n:
                share = math.log(n * len(both) / (len(inside) * len(where))) / math.log(n / len(inside)) * len(both) / (len(both) + CAUTION)
                for t in both:
                    out[t][w] = max(share, out[t].get(w, -9))
    return {t: {w: "removed" if x >= remove else "general" for w, x in ws.items() if x >= generalise} for t, ws in out.items()}


def term_spans(text, actions):
    base = [tuple(map(int, x.split(":")[1:])) for x in base_spans(text).split(",") if x]
    words = [(m.start(), m.end(), actions[m[0]]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if m[0] in actions]
    return {f"{act}:{a}:{b}" for a, b, act in words if not any(x < b and a < y for x, y in base)}


def test_disclosing_terms(make, odd_rows):
    rnd = random.Random(21)
    common = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(160):
        words = rnd.choices(common, k=rnd.randrange(5, 30))
        group = i % 8
        if group < 3:  # a shared domain, with a club that is met hardly anywhere else, and a number of one's own
            words += [f"club{group}", f"Member{i}", f"x{i % 23}@club{group}.org", f"+49 30 12345{i % 7}", rnd.choice(["4111 1111 1111 1111", "10.0.3.4", ""])]
        if rnd.random() < 0.1:
            words += [f"club{rnd.randrange(3)}"]
        rnd.shuffle(words)
        rows.append((100 + i, " ".join(words)))
    rows += [(900 + i, rows[0][1]) for i in range(40)] + rows[3:6] + odd_rows
    expected = disclosed([t or "" for _, t in rows])
    found = {"removed": 0, "general": 0}
    for r in find_private(make(rows)).collect():
        texts = [t or "" for i, t in rows if i == r.doc_id]
        mine = {s for s in r.spans.split(",") if s.split(":")[0] in found}
        assert mine in [term_spans(t, expected[t]) for t in texts], texts
        for s in mine:
            found[s.split(":")[0]] += 1
        general = [s for s in r.spans.split(",") if s.startswith("general")]
        assert [f.rsplit(":", 1)[0] for f in r.forms.split(",") if f] == [s[8:] for s in general]
    assert found["removed"] > 20 and found["general"] > 20


def test_terms_move_once(make, monkeypatch):
    plans, saved = [], privacy.saved
    monkeypatch.setattr(privacy, "saved", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df))
    rows = [(1, "ann@x.org a  a\tb " + "again " * 50), (2, ""), (3, " a\n"), (4, None), (5, "ann@x.org c a")]
    assert {r.doc_id: r.n_email for r in find_private(make(rows)).collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}
    assert any("array_join(array_distinct(regexp_extract_all(" in p for p in plans)  # no text with its repeats is dealt out for the counts


def test_terms_of_a_value_met_once(make):
    rows = [(i, f"common filler text number {i % 7}") for i in range(60)] + [(100, "common filler text of Zebulon at zeb@corner.net number")]
    got = {r.doc_id: r for r in find_private(make(rows)).collect()}
    at = rows[-1][1].index("Zebulon")
    assert f"general:{at}:{at + 7}" in got[100].spans and f"{at}:{at + 7}:<name>" in got[100].forms
    assert all(not got[i].spans for i in range(60))
    # Copies say no more than one text.
    copies = {r.doc_id: r for r in find_private(make(rows + [(200 + i, rows[-1][1]) for i in range(9)])).collect()}
    assert all(copies[200 + i].spans == copies[100].spans == got[100].spans for i in range(9))
