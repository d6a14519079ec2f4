"""Licence notices, by a positional index of rare words.

The words of the templates are counted over all documents. The index has, of each template, the words that the fewest
documents have, with their places in it. Every such word of a document is looked up; words that agree on where a
template would have to begin make a candidate. It counts if the template's key phrases stand there and enough of its
words, weighted by rarity, do. A whole notice has all its rare words, so none is missed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import raw_text, text_slices
from shelfcast.llm.words import Words

#: Different words of a template that the index has, the rarest ones; all but the commonest of a shorter template.
RARE = 6
#: Places by which words may be off and still agree, words that must agree (or all of a shorter template), and the
#: weighted share of a template's words that must stand there.
SLACK, AGREE, SHARE = 4, 3, 0.6

#: Phrases and the labels they stand for.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Label, opening words of the usual notice, and phrases without which it is another one.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu general public license", "free software foundation")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("gnu lesser general public license",)),
    ("apache", "Licensed under the Apache License, Version 2.0.", ("apache license",)),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', ("apache license", "in compliance with the license")),
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', ("permission is hereby granted", "without restriction")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("with or without fee",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla public license",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived all copyright",)),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software",)),
)

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20

MATCHES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,end:long,score:double>>"


def license_words(texts: pa.Array) -> Words:
    """Words of letters, digits and all beyond ASCII; A-Z as a-z."""
    body, offsets = raw_text(texts)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(_PLAIN[body].tobytes()))
    return Words(plain)


def _hashes(text: str) -> np.ndarray:
    return license_words(pa.array([text])).hashes


def places(w: Words, phrase: np.ndarray) -> np.ndarray:
    """Words of the batch at which the words of ``phrase`` stand one after another in one text."""
    last = len(w.hashes) - len(phrase) + 1
    if last <= 0 or not len(phrase):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(w.hashes[:last] == phrase[0])
    for i in range(1, len(phrase)):
        at = at[w.hashes[at + i] == phrase[i]]
    return at[w.owner[at] == w.owner[at + len(phrase) - 1]]


class Index(NamedTuple):
    """The templates' words and where the rare ones stand; its size is that of the templates."""

    labels: tuple[str, ...]
    known: np.ndarray  # sorted hashes of the words of all templates
    weight: np.ndarray  # rarity of each word
    texts: tuple[np.ndarray, ...]  # each template as places in ``known``
    keys: tuple[tuple[np.ndarray, ...], ...]  # hashes of the key phrases of each template
    rare: tuple[np.ndarray, ...]  # indexed words of each template
    first: np.ndarray  # word i has the entries first[i] to first[i + 1] of:
    template: np.ndarray
    place: np.ndarray


def vocabulary(templates: Sequence[tuple[str, str, Sequence[str]]]) -> np.ndarray:
    return np.unique(np.concatenate([*[_hashes(text) for _, text, _ in templates], np.zeros(0, np.uint64)]))


def build_index(templates: Sequence[tuple[str, str, Sequence[str]]], weight: np.ndarray) -> Index:
    known = vocabulary(templates)
    texts = tuple(np.searchsorted(known, _hashes(text)) for _, text, _ in templates)
    rare = []
    for text in texts:
        words = np.unique(text)
        words = words[np.argsort(-weight[words], kind="stable")]
        rare.append(words[: min(RARE, max(AGREE, len(words) - 1))])
    entries = sorted((int(x), t, i) for t, text in enumerate(texts) for i, x in enumerate(text) if x in rare[t])
    word, template, place = (np.array([e[i] for e in entries], np.int64) for i in range(3))
    keys = tuple(tuple(_hashes(k) for k in keys) for _, _, keys in templates)
    return Index(tuple(label for label, _, _ in templates), known, weight, texts, keys, tuple(rare), np.searchsorted(word, np.arange(len(known) + 1)), template, place)


def _met(known: np.ndarray, w: Words) -> np.ndarray:
    """Place of each word in ``known``, or -1."""
    if not len(known):
        return np.full(len(w.hashes), -1)
    at = np.minimum(np.searchsorted(known, w.hashes), len(known) - 1)
    return np.where(known[at] == w.hashes, at, -1)


def _counter(known: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, having = 0, np.zeros(len(known), np.int64)
        for batch in text_slices(batches, "text"):
            w = license_words(batch.column("text"))
            met = _met(known, w)
            docs += batch.num_rows
            each = np.unique(w.owner[met >= 0] * len(known) + met[met >= 0])
            having += np.bincount(each % max(len(known), 1), minlength=len(known))
        some = np.flatnonzero(having)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(having[some], docs))], ["word", "docs"])

    return count


def candidates(index: Index, w: Words, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, template and presumed first word (counted from the start of the text) for which enough rare words agree."""
    none = np.zeros(0, np.int64)
    at = np.flatnonzero(met >= 0)
    size = np.diff(index.first)[met[at]]
    at, size = at[size > 0], size[size > 0]
    if not len(at):
        return none, none, none
    entry = np.repeat(index.first[met[at]] - np.cumsum(size) + size, size) + np.arange(size.sum())
    at = np.repeat(at, size)
    owner, template, start = w.owner[at], index.template[entry], at - w.first[w.owner[at]] - index.place[entry]
    # One sortable number for text, template and first word, far enough apart that neighbours are of one text and template.
    span = 1 << 40
    line = (owner * len(index.texts) + template) * span + (start + (span >> 1))
    once = np.unique(np.stack([line, met[at]]), axis=1)[0]
    votes = np.searchsorted(once, once + SLACK, "right") - np.searchsorted(once, once - SLACK, "left")
    need = np.array([min(AGREE, len(x)) for x in index.rare], np.int64)
    good = np.unique(once[votes >= need[once // span % len(index.texts)]])
    return good // span // len(index.texts), good // span % len(index.texts), good % span - (span >> 1)


def find_notices(index: Index, w: Words) -> list[list[dict]]:
    """The notices of each text, by place."""
    met = _met(index.known, w)
    owner, template, start = candidates(index, w, met)
    out: list[list[dict]] = [[] for _ in range(len(w.counts))]
    phrase_at = {}
    for t in np.unique(template).tolist():
        phrase_at[t] = [(places(w, k), len(k)) for k in index.keys[t]]
    for o, t, s in zip(owner.tolist(), template.tolist(), start.tolist()):
        lo = w.first[o] + max(0, s - SLACK)
        hi = min(w.first[o + 1], w.first[o] + s + len(index.texts[t]) + SLACK)
        if all((found := at[np.searchsorted(at, lo) :]).size and found[0] + n <= hi for at, n in phrase_at[t]):
            wanted, here = Counter(index.texts[t].tolist()), Counter(met[lo:hi].tolist())
            whole = sum(index.weight[x] * n for x, n in wanted.items())
            score = float(sum(index.weight[x] * min(n, here[x]) for x, n in wanted.items()) / whole) if whole else 1.0
            if score >= SHARE:
                out[o].append({"label": index.labels[t], "start": max(0, s), "end": int(min(w.counts[o], s + len(index.texts[t]))), "score": min(1.0, score)})
    return [_apart(found) for found in out]


def _apart(found: list[dict]) -> list[dict]:
    """Of notices of one label that lie over one another the best, by place."""
    kept: list[dict] = []
    for m in sorted(found, key=lambda m: (-m["score"], m["start"], m["end"])):
        if not any(k["label"] == m["label"] and k["start"] < m["end"] and m["start"] < k["end"] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m["start"], m["end"], m["label"]))


def _scanner(index: Index, phrases: Sequence[tuple[np.ndarray, str]]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            w = license_words(batch.column("text"))
            n = batch.num_rows
            count, least, most = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[set] = [set() for _ in range(n)]
            for phrase, label in phrases:
                at = places(w, phrase)
                owner = w.owner[at]
                place = at - w.first[owner]
                count += np.bincount(owner, minlength=n)
                np.minimum.at(least, owner, place)
                np.maximum.at(most, owner, place)
                for o in np.unique(owner).tolist():
                    labels[o].add(label)
            found = find_notices(index, w)
            none = most < 0
            base = [",".join(sorted(x)) for x in labels]
            both = [",".join(sorted(x.union(m["label"] for m in f))) for x, f in zip(labels, found)]
            score = [max((m["score"] for m in f), default=0.0) for f in found]
            columns = [batch.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(count), pa.array(least, mask=none), pa.array(most, mask=none), pa.array(base, pa.string()), pa.array(both, pa.string()), pa.array(score, pa.float64()), pa.array(found, MATCHES)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return scan


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str, Sequence[str]]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences that each document names or carries.

    ``phrases`` are looked for word by word: ``n_base`` places in all, ``first_word`` and ``last_word`` (words from 0,
    null if there is none) and ``base_labels``. ``labels`` are these and those of the ``templates`` found; ``matches``
    tells where (words from ``start`` to before ``end``) and how much of the template, weighted by rarity, stands there;
    ``score`` is the best share, 0 without a notice. Texts are read whole. Null and empty texts have no words; null ids
    and repeated rows, which count as documents of their own, come back as they are; ties in rarity go by the word's
    hash. An empty table gives no rows, no templates give the phrases alone. There is no shuffle of texts; what is
    broadcast, and counted on the driver, has the size of the templates.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = vocabulary(templates)
    counts = rows.select("text").mapInArrow(_counter(known), "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    having = {r.word: r.docs for r in counts.collect()}
    weight = np.array([np.log((having.get(-1, 0) + 1) / (having.get(i, 0) + 0.5)) for i in range(len(known))])
    index = build_index(templates, np.maximum(weight, 1e-9))
    return rows.mapInArrow(_scanner(index, [(_hashes(p), label) for p, label in phrases]), SCHEMA)
