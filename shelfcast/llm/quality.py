"""Quality by the text's own features and by where it comes from.

A logistic classifier on features of the text gives each document its evidence. Its probabilities, summed up by site and
by section of a site, are shrunk by empirical Bayes: a section with few documents is taken for its site, a site with few
for the whole. How much is shrunk follows from how much sites differ at all. The section's posterior then stands in for
the base rate of the labels in the document's odds.

A second target, toxic, goes the same way with other features: which words and beginnings of words a text has, hashed
into a fixed number of cells. One pass counts the labelled texts that have each cell; the cells whose share of toxic
texts is furthest from the usual one, in standard errors, are the features of the fit. A document stays if it is good
and not toxic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import saved, tag, text_slices
from shelfcast.llm.lines import _hints
from shelfcast.llm.packing import bundles
from shelfcast.llm.words import Words, scramble

FEATURES = ("words_log", "word_bytes", "upper", "lower", "digits", "marks", "signs", "high", "repeats", "distinct", "triples", "lines", "short_lines", "signed_words", "capital_words")
#: Rounds and penalty of the fit.
ROUNDS, PENALTY = 50, 1e-4
#: Documents at or above this probability stay.
THRESHOLD = 0.5
#: Cells of the hashed words, beginnings of words (bytes) that count beside the whole, and penalty of their fit.
CELLS, BEGINNINGS, WORD_PENALTY = 1 << 16, (4, 5, 6, 7), 1e-4
#: Cells that the fit takes: the most telling ones by the counts over all labelled texts.
TELLING = 512
#: Bits of the table that tells which ids may have a label (4 MB when broadcast), and bytes of text that are hashed at once.
LABEL_BITS, SLICE = 25, 1 << 17

_CLASS = np.zeros(256, np.int64)  # 0 white space and control, 1 A-Z, 2 a-z, 3 digits, 4 marks of sentences, 5 other signs, 6 bytes of other letters
_CLASS[33:128] = 5
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4
_CLASS[128:] = 6


def _per_text(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[new], minlength=n)


def text_features(texts: pa.Array) -> list[np.ndarray]:
    """The FEATURES of a batch of texts, from all of each text; a text without words has zeros."""
    w = Words(texts)
    n, count = len(w.counts), np.maximum(w.counts, 1)
    kind = _CLASS[w.body]
    size = np.maximum(_per_text(w.offsets, kind > 0), 1)
    upper, lower, digits, marks, signs, high = (_per_text(w.offsets, kind == k) / size for k in range(1, 7))
    again = np.zeros(len(w.hashes))
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.owner[1:] == w.owner[:-1])
    triple, at = w.windows(3)
    triples = _distinct(w.owner[at], triple, n) / np.maximum(np.bincount(w.owner[at], minlength=n), 1)
    feeds = np.concatenate([np.zeros(1, np.int64), np.cumsum(w.body == 10)])
    lines = feeds[w.offsets[1:]] - feeds[w.offsets[:-1]] + 1
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(kind == 5)])
    signed = sums[w.ends] - sums[w.starts] > 0
    capitals = np.concatenate([np.zeros(1, np.int64), np.cumsum(kind == 1)])
    capital = capitals[w.ends] - capitals[w.starts] > 1
    some = w.counts > 0
    out = [np.log1p(w.counts), _per_text(w.first, w.ends - w.starts) / count, upper, lower, digits, marks, signs, high, _per_text(w.first, again) / count, _distinct(w.owner, w.hashes, n) / np.sqrt(count), triples, np.log1p(lines), lines / count, _per_text(w.first, signed) / count, _per_text(w.first, capital) / count]
    return [np.where(some, x, 0.0) for x in out]


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, cell and count (65535 at most) of the words of each text and of their beginnings, in lower case and without signs at either end."""
    w = Words(pc.utf8_lower(texts.fill_null("")))
    core = np.flatnonzero(np.isin(_CLASS[w.body], (1, 2, 3, 6)))
    a, b = np.searchsorted(core, w.starts), np.searchsorted(core, w.ends)
    some = b > a
    start, end, owner = core[a[some]], core[b[some] - 1] + 1, w.owner[some]
    hashes, owners = [w.bytes_hashes(start, end)], [owner]
    for k in BEGINNINGS:
        long = end - start >= k
        hashes.append(scramble(w.bytes_hashes(start[long], start[long] + k) + np.uint64(k)))
        owners.append(owner[long])
    cell = (np.concatenate(hashes) % np.uint64(CELLS)).astype(np.int64)
    both, count = np.unique(np.concatenate(owners) * CELLS + cell, return_counts=True)
    return both // CELLS, both % CELLS, np.minimum(count, 65535)


def _describe(weights):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            made = text_features(batch.column("text"))
            if weights is None:
                made.append(np.zeros(batch.num_rows))
            else:
                owner, cell, x = word_features(batch.column("text"))
                made.append(np.bincount(owner, weights.value[cell] * np.log1p(x), batch.num_rows))
            columns = [batch.column(c) for c in ("_id", "_tag", "site", "section")]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.float64()) for x in made]], ["_id", "_tag", "site", "section", *FEATURES, "told"])

    return describe


_SPARSE = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


_CELL = np.dtype([("cell", "<u2"), ("count", "<u2")])


def _hashed(hints, bits: int):
    """Cells and counts, packed, of the texts that may have a label."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            cell = scramble(batch.column("_id").to_numpy().view(np.uint64)) & np.uint64((1 << bits) - 1)
            hit = (hints.value[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1
            part = batch.filter(pa.array(hit))
            owner, cell, count = word_features(part.column("text"))
            made = np.empty(len(owner), _CELL)
            made["cell"], made["count"] = cell, count
            ends = (np.searchsorted(owner, np.arange(part.num_rows + 1)) * _CELL.itemsize).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(made.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("_id"), packed], ["_id", "cells"])

    return hashed


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each cell in a task, and how many of them have the label."""
    n, n1 = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
    for batch in batches:
        for cells, y in zip(batch.column("cells").to_pylist(), batch.column("_y").to_pylist()):
            at = np.frombuffer(cells, _CELL)["cell"]  # each cell once
            n[at] += 1
            if y == 1:
                n1[at] += 1
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, n[at], n1[at])], ["cell", "n", "n1"])


def _vectors(place: np.ndarray):
    """Counts of the telling cells as sparse vectors; ``place`` is the place of each cell in them, or -1."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            rows = [np.frombuffer(x, _CELL) for x in batch.column("cells").to_pylist()]
            rows = [r[place[r["cell"]] >= 0] for r in rows]
            rows = [r[np.argsort(place[r["cell"]])] for r in rows]
            ends, made = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), np.concatenate(rows)
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(place[made["cell"]].astype(np.int32)), pa.array(np.log1p(made["count"].astype(float))))]
            fixed = [pa.array(np.full(len(rows), v), kind) for v, kind in ((0, pa.int8()), (place.max() + 1, pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([*fixed, *lists], fields=list(_SPARSE)), batch.column("_y")], ["_x", "_y"])

    return vectors


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield bundles(np.zeros(batch.num_rows, np.int64), {"doc": scramble(batch.column("_lid").to_numpy().view(np.uint64))}).select(["doc"])


def _fit_words(rows: DataFrame, marks: DataFrame) -> tuple[np.ndarray, float, float] | None:
    """Weights of the cells, intercept and rate of the labels; None if there are no labels of both kinds."""
    spark = rows.sparkSession
    # Tables that grow with the input (labels here, places below) are merged at every size: a broadcast of small ones
    # would give way to a shuffle of all rows at some size, which runs on less would not show.
    hints = spark.sparkContext.broadcast(_hints(marks.select("_lid").mapInArrow(_ids, "doc binary"), LABEL_BITS))
    made = rows.where("_id IS NOT NULL").select("_id", "text").mapInArrow(_hashed(hints, LABEL_BITS), "_id long, cells binary")
    met = saved(made.join(marks.hint("merge"), F.col("_id") == F.col("_lid")).where("octet_length(cells) > 0").select("cells", "_y"))
    rate = met.agg(F.avg("_y")).first()[0]
    if rate is None or not 0 < rate < 1:
        return None
    usual = F.col("n") * rate
    surprise = F.abs(F.col("n1") - usual) / F.sqrt(usual * (1 - rate) + 1)
    counts = met.mapInArrow(_counted, "cell long, n long, n1 long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    telling = [r.cell for r in counts.orderBy(surprise.desc(), "cell").limit(TELLING).select("cell").collect()]
    place = np.full(CELLS, -1)
    place[telling] = np.arange(len(telling))
    known = saved(met.mapInArrow(_vectors(place), T.StructType().add("_x", VectorUDT.sqlType()).add("_y", "double")))
    # Written as structs, read as vectors: nothing turns one into the other in place.
    fit_on = spark.read.schema(T.StructType().add("_x", VectorUDT()).add("_y", "double")).parquet(*known.inputFiles())
    model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=ROUNDS, regParam=WORD_PENALTY, standardization=False).fit(fit_on)
    weights = np.zeros(CELLS)
    weights[telling] = model.coefficients.toArray()
    return weights, float(model.intercept), rate


def _strength(groups: int, n: float, squares: float, between: float, within: float, mean: float) -> float:
    """Weight of a prior, in documents, from the spread of groups around their means (method of moments)."""
    spare = n - squares / n if n else 0.0
    if groups < 2 or spare <= 0 or n <= groups:
        return 1.0
    noise = within / (n - groups)
    spread = (between - (groups - 1) * noise) / spare
    if spread <= 0:
        return n  # groups don't differ: all of them are taken for their parent
    return min(n, max(1.0, mean * (1 - mean) / spread - 1))


def _marks(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    return labels.select(F.col(id_col).cast("long").alias("_lid"), F.col(label).cast("double").alias("_y")).where("_lid IS NOT NULL AND _y IN (0, 1)")


def _places(scored: DataFrame, p: str) -> DataFrame:
    """``p`` of each site and section, shrunk: ``_site``, ``_section``, ``p_site``, ``p_section``."""
    sections = saved(scored.groupBy("site", "section").agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("k"), F.sum(F.col(p) ** 2).alias("kk")))
    sites = sections.groupBy("site").agg(F.sum("n").alias("sn"), F.sum("k").alias("sk"), F.sum("kk").alias("skk"))
    total = sites.agg(F.sum("sn").alias("n"), F.sum("sk").alias("k")).first()
    mean = min(1 - 1e-6, max(1e-6, total.k / total.n)) if total.n else 0.5
    spread = sites.agg(F.count("*").alias("g"), F.sum("sn").alias("n"), F.sum(F.col("sn") ** 2).alias("nn"), F.sum(F.col("sn") * (F.col("sk") / F.col("sn") - mean) ** 2).alias("b"), F.sum(F.col("skk") - F.col("sk") ** 2 / F.col("sn")).alias("w")).first()
    strong = _strength(spread.g, spread.n or 0, spread.nn or 0, spread.b or 0, spread.w or 0, mean)
    p_site = (F.col("sk") + strong * mean) / (F.col("sn") + strong)
    both = sections.join(sites.withColumnRenamed("site", "_site"), F.col("site").eqNullSafe(F.col("_site"))).withColumn("p_site", p_site)
    inner = both.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") ** 2 / F.col("sn")).alias("nn"), F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col("sk") / F.col("sn")) ** 2).alias("b"), F.sum(F.col("kk") - F.col("k") ** 2 / F.col("n")).alias("w")).first()
    strong = _strength(inner.g, inner.n or 0, inner.nn or 0, inner.b or 0, inner.w or 0, mean)
    p_section = (F.col("k") + strong * F.col("p_site")) / (F.col("n") + strong)
    # Probabilities are kept off 0 and 1 so that odds stay finite.
    tame = lambda p: F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return both.select(F.col("site").alias("_site"), F.col("section").alias("_section"), tame(F.col("p_site")).alias("p_site"), tame(p_section).alias("p_section"))


def score_quality(docs: DataFrame, labels: DataFrame, site: Column, section: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", toxic: str | None = None, places: DataFrame | None = None) -> DataFrame:
    """The probabilities that a document is good and that it is toxic, and whether it stays.

    ``labels`` has the id column, ``label``, 1 for good and 0 for bad, and ``toxic``, 1 for toxic and 0 for clean (None,
    or a column that isn't there: only quality is judged); other values and null ids or labels are left aside. ``site``
    and ``section`` are string expressions on ``docs``; null is a site and a section like any other. ``places`` has a row
    for each id whose site and section are known better (the id column, ``site``, ``section``), as those of a web page
    are. Columns: ``_id``, ``_tag`` (the identity of the row), ``doc_id``, ``p_text``, ``p_site``, ``p_section``, ``score``, ``p_toxic`` (by the text alone), ``toxic`` (with site
    and section) and ``keep``. Null and empty texts have no evidence: their scores are those of their section. If labels
    of a target are missing or of one kind only, no text has evidence of it and nothing is rejected by it. Repeated rows
    and texts of any length, all of which are read whole, get scores alike. An empty table gives no rows. All labelled documents take part in the fits, and all documents in
    the counts.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), tag(text).alias("_tag"), site.cast("string").alias("site"), section.cast("string").alias("section"), text.alias("text"))
    words = _fit_words(rows, _marks(labels, id_col, toxic)) if toxic in labels.columns else None
    schema = "_id long, _tag long, site string, section string, " + ", ".join(f"{c} double" for c in (*FEATURES, "told"))
    known = rows.mapInArrow(_describe(docs.sparkSession.sparkContext.broadcast(words[0]) if words else None), schema)
    if places is not None:
        better = places.select(F.col(id_col).cast("long").alias("_pid"), F.struct("site", "section").alias("_place"))
        spot = lambda c: F.when(F.col("_pid").isNotNull(), F.col(f"_place.{c}").cast("string")).otherwise(F.col(c))
        known = known.join(better.hint("merge"), F.col("_id") == F.col("_pid"), "left").withColumns({c: spot(c) for c in ("site", "section")}).drop("_pid", "_place")
    known = saved(known)
    marks = _marks(labels, id_col, label)
    fit_on = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(known.join(marks.hint("merge"), F.col("_id") == F.col("_lid")).where("words_log > 0")).select("_x", "_y").persist()
    try:
        rate = fit_on.agg(F.avg("_y")).first()[0]
        if rate is None or not 0 < rate < 1:
            weights, start, rate = [0.0] * len(FEATURES), 0.0, 0.5
        else:
            model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=ROUNDS, regParam=PENALTY).fit(fit_on)
            weights, start = model.coefficients.toArray().tolist(), float(model.intercept)
    finally:
        fit_on.unpersist()
    base = math.log(rate / (1 - rate))
    odds = F.lit(start - base)
    for c, x in zip(FEATURES, weights):
        odds = odds + F.col(c) * x
    shown = lambda odds: F.when(F.col("words_log") > 0, F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))).otherwise(0.0)
    chance = lambda odds: 1 / (1 + F.exp(-odds))
    scored = known.select("_id", "_tag", "site", "section", shown(odds).alias("evidence"), "words_log", "told").withColumn("p_text", chance(F.col("evidence") + base))
    if words:
        usual = math.log(words[2] / (1 - words[2]))
        scored = scored.withColumn("against", shown(F.col("told") + (words[1] - usual))).withColumn("p_toxic", chance(F.col("against") + usual))
    else:
        scored = scored.withColumn("p_toxic", F.lit(0.0))
    here = F.col("site").eqNullSafe(F.col("_site")) & F.col("section").eqNullSafe(F.col("_section"))
    of = lambda p: F.log(F.col(p) / (1 - F.col(p)))
    out = scored.join(_places(scored, "p_text"), here).withColumn("score", chance(F.col("evidence") + of("p_section"))).drop("_site", "_section")
    if words:
        out = out.join(_places(scored, "p_toxic").select("_site", "_section", F.col("p_section").alias("toxic_section")), here).withColumn("toxic", chance(F.col("against") + of("toxic_section")))
    else:
        out = out.withColumn("toxic", F.lit(0.0))
    return out.select("_id", "_tag", F.col("_id").alias("doc_id"), "p_text", "p_site", "p_section", "score", "p_toxic", "toxic").withColumn("keep", (F.col("score") >= THRESHOLD) & (F.col("toxic") < THRESHOLD))
