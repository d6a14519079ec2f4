"""Licence scans against plain regular expressions and against templates laid on every place of a text."""

import random
import re

import numpy as np
import pyarrow as pa

from shelfcast.llm.licenses import PHRASES, TEMPLATES, build_index, find_notices, license_words, scan_licenses, vocabulary

SPLIT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(SPLIT, low)
    hits = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in hits}))


def texts():
    rnd = random.Random(3)
    filler = "the of and to a in is under version license permission software free any copy é中 İx K".split()
    out = [None, "", " \n", "GNU general-public LICENSE", "cc by cc by", "MIT\x00License mit license", "CC BY-NC 4.0", "KK apache license", "apachelicense apache, license", "mit license", "cc", "x" * 90_000 + " mit license"]
    for _ in range(200):
        parts = [" ".join(rnd.choices(filler, k=rnd.randrange(60)))]
        for _ in range(rnd.randrange(3)):
            parts += [rnd.choice(TEMPLATES)[1], " ".join(rnd.choices(filler, k=rnd.randrange(50)))]
        out.append(rnd.choice((" ", "\n", " * ")).join(parts))
    return out


def test_phrases_are_all_found(spark, make):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "mit license"), (3, "mit license"), (3, "mit license")]
    got = scan_licenses(make(rows).repartition(5)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(((r.doc_id, *r[1:6]) for r in got), key=key) == sorted(((i, *plain(t)) for i, t in rows), key=key)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        assert r.score == max((m.score for m in r.matches), default=0) and all(0 <= m.start < m.end <= r.n_words for m in r.matches)
    assert scan_licenses(make([])).count() == 0
    assert {r.labels for r in scan_licenses(make(rows), templates=()).collect()} == {plain(t)[4] for _, t in rows}


def test_notices_where_they_stand(spark, make):
    """Each template within other text, whole, or with words put in and left out; none where only its words are strewn about."""
    rnd = random.Random(5)
    filler = [f"w{i}" for i in range(400)] + "the of and to is any".split()
    rows, wanted = [], {}
    for i in range(300):
        label, text, _ = TEMPLATES[i % len(TEMPLATES)]
        words = text.split()
        if i % 3 == 1 and len(words) > 12:  # changed in two places beside the key phrases
            words.insert(len(words) - 2, "hereby")
        before = rnd.choices(filler, k=rnd.randrange(900))
        rows.append((i, " ".join(before + words + rnd.choices(filler, k=rnd.randrange(300)))))
        wanted[i] = label, len(before)
    strewn = sorted({w for _, t, _ in TEMPLATES for w in re.findall(SPLIT, t.lower())})
    rows += [(1000 + i, " ".join(rnd.sample(strewn * 2, 150))) for i in range(60)]
    got = {r.doc_id: r for r in scan_licenses(make(rows)).collect()}
    for i, (label, at) in wanted.items():
        assert any(m.label == label and abs(m.start - at) <= 5 for m in got[i].matches), (i, label, got[i].matches)
        assert got[i].score > 0.6
    assert sum(bool(got[1000 + i].matches) for i in range(60)) <= 3


def test_candidates_are_those_of_every_place():
    """Laying each template on every place of a text finds no whole notice that the index lacks."""
    known = vocabulary(TEMPLATES)
    index = build_index(TEMPLATES, np.random.default_rng(1).random(len(known)) + 0.1)
    w = license_words(pa.array(texts()))
    found = find_notices(index, w)
    for o in range(len(w.counts)):
        mine = w.hashes[w.first[o] : w.first[o + 1]]
        for t, text in enumerate(index.texts):
            want = index.known[text]
            for s in range(len(mine) - len(want) + 1):
                if (mine[s : s + len(want)] == want).all():
                    assert any(m["label"] == index.labels[t] and m["start"] < s + len(want) and s < m["end"] for m in found[o]), (o, t, s)
