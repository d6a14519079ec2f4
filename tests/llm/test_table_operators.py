"""Search, URL rules, mixing, quality, components and the pipeline."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfcast.llm import queries
from shelfcast.llm.common import table
from shelfcast.llm.components import components
from shelfcast.llm.mixing import least_cost_flow, mix, target_sizes
from shelfcast.llm.mtree import MTree, top_k
from shelfcast.llm.quality import score_quality
from shelfcast.llm.urls import RULES, filter_urls


def best(vectors, k, asks):
    sound = {i: [math.floor(256 * x) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in filter(asks, sound):
        scores = sorted((-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def test_tree_is_exact():
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 300, (20, 8))
    v = np.floor(centers[rng.integers(0, 20, 3000)] + rng.normal(0, 9, (3000, 8))).astype(np.int64)
    v[500:1400] = v[500]  # many equal vectors
    q = v[::37]
    tree = MTree(v, page=32)
    got = tree.search(q, 7)
    assert (got == np.argsort(-(q @ v.T), axis=1, kind="stable")[:, :7]).all()
    assert tree.computed < 0.7 * len(q) * len(v)  # stored distances save computing


def test_top_k(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(40)]
    rows += [(400, None), (401, [None] * 6), (402, [math.nan] * 6), (403, [math.inf] * 6), (410, [0.1, 0.2]), (411, [0.3, 0.2]), (420, []), (430, []), (None, [0.1] * 6), (440, [-1e-9, 0.0, -0.0, 1.0, -1.0, 0.999])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = {tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0).collect()}
    assert got == best(rows, 5, lambda i: i % 10 == 0)
    assert {tuple(r) for r in top_k(df.union(df), F.col("vec_id") % 10 == 0).collect()} == got
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/x?a=1", "https://a.example.com/en/", "https://example.com/EN/", "http://x.net/es/1#f", "http://net/fr/", "http://mynet/fr/", "http://com", "http://a.com/", "no scheme /en/", "", None, "http://é.com/ü?q://b", "a://b://c/d", "http://h.net?x=/es/", "x\ny://h.com/a\nb"]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(3, urls[3], "x"), (None, "http://a.com/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    none = spark.createDataFrame([(1, None), (None, True)], "page_id long, bad boolean")
    got = filter_urls(pages, none).collect()
    assert len(got) == len(rows)

    def plain(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:][: min([rest[cut:].find(c) for c in "?#" if c in rest[cut:]] or [len(rest)])]
        fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        return host, path, rule and rule[1] + rule[2], rule[0] if rule else "allow"

    by_id = {r[0]: r[1] for r in rows}
    assert all((r.host, r.path, r.rule, r.verdict) == plain(by_id[r.page_id]) for r in got)
    assert filter_urls(pages.limit(0), none.limit(0)).count() == 0


def test_mined_rules_block(spark):
    pages = spark.createDataFrame([(i, f"http://{'spam' if i % 3 == 0 else 'good'}.org/{'win' if i % 2 else 'read'}/{i}?id=1") for i in range(600)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 3 == 0 and i % 2 == 1) for i in range(300)], "page_id long, bad boolean")
    got = filter_urls(pages, labels).collect()
    assert all((r.verdict == "block") == (r.page_id % 3 == 0 and r.page_id % 2 == 1) for r in got)
    assert all("host:spam.org" in r.because and "path:win" in r.because for r in got if r.verdict == "block")


def test_targets():
    assert target_sizes([10, 10, 10], (5, 2, 1)) == [18.75, 7.5, 3.75]
    sizes = [1, 100, 50, 2, 7]
    got = target_sizes(sizes)
    assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s for t, s in zip(got, sizes))
    assert got[0] == 3 and got[3] == 6
    open_ = [i for i in range(5) if got[i] < 3 * sizes[i]]
    assert len({Fraction(got[i] / (5, 2, 1)[i % 3]).limit_denominator(10**6) for i in open_}) == 1
    assert target_sizes([]) == [] and target_sizes([0, 5]) == [0.0, 5.0]


def test_flow_is_cheapest():
    # One pattern in both sources: what it gives to one isn't there for the other, and a second use costs.
    flow = least_cost_flow([10, 10, 4], [[0], [0, 1], [1]], [16, 8])
    given = [sum(a for _, a in f) for f in flow]
    assert sum(a for f in flow for j, a in f if j == 0) == 16 and sum(a for f in flow for j, a in f if j == 1) == 8
    assert given == [10, 10, 4]  # no word twice
    assert least_cost_flow([3], [[0]], [100]) == [[(0, 9)]]
    assert least_cost_flow([5], [[]], []) == [[]]


def test_mix(make, odd_rows, words):
    rnd = random.Random(6)
    rows = [(i, t, "en", rnd.choice(["a", "b", None])) for i, t in odd_rows]
    rows += [(100 + i, " ".join(["w"] * rnd.randrange(1, 40)), "en", rnd.choices(["a", "b", "c", "é", None], (50, 20, 9, 3, 1))[0]) for i in range(900)]
    got = mix(make(rows), F.array("source")).collect()
    again = mix(make(rows[::-1]).repartition(7), F.array("source")).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(words(r[1])) for r in rows if r[3] == s) for s in names]
    for s, size, target in zip(names, sizes, target_sizes(sizes)):
        mine = [r for r in got if r.pattern == [s]]
        assert {(r.source_size, r.target) for r in mine} == {(size, target)}
        longest = max(r.size for r in mine)  # a document is taken whole or not at all
        assert abs(sum(r.taken for r in mine) - target) <= max(5, 0.02 * target, longest if longest > target else 0)
    assert all(r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size for r in got)
    assert mix(make([]), F.array("source")).count() == 0
    both = mix(make(rows), F.when(F.col("source") == "a", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source"))).collect()
    assert len(both) == len(rows) and sum(r.taken for r in both) > 0


def test_quality_on_held_out_labels(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    half = labels.where(F.col("doc_id") % 2 == 0)
    got = score_quality(docs, half, F.col("source"), F.col("lang")).join(labels.where(F.col("doc_id") % 2 == 1), "doc_id").select("keep", "quality").collect()
    right = sum(r.keep == (r.quality == 1) for r in got) / len(got)
    good = [r.keep for r in got if r.quality == 1]
    assert len(got) > 100 and right > 0.97 and sum(good) / len(good) > 0.98


def test_toxic_on_held_out_labels(spark, folder):
    folder = folder.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    half = labels.where(F.col("doc_id") % 2 == 0)
    got = score_quality(docs, half, F.col("source"), F.col("lang"), toxic="toxic").join(labels.where(F.col("doc_id") % 2 == 1), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").select("keep", "quality", labels.toxic.alias("bad"), "lang").collect()
    caught = [not r.keep for r in got if r.bad == 1 and r.quality == 1 and r.lang == "en"]
    clean = [r.keep for r in got if r.bad == 0 and r.quality == 1]
    assert len(caught) > 80 and sum(caught) / len(caught) > 0.9 and sum(clean) / len(clean) > 0.97


def test_toxic_words_reject_good_documents(make):
    good = "plain words of a sentence that goes on for a while"
    docs = make([(i, good + (f" you, MORON! {i}" if i % 5 == 0 else f" {i}"), "en", "a") for i in range(300)] + [(300, None, "en", "a")])
    labels = docs.where("doc_id < 200").select("doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0).alias("toxic"))
    got = {r.doc_id: r for r in score_quality(docs, labels, F.col("source"), F.col("lang"), toxic="toxic").collect()}
    assert all(got[i].keep == bool(i % 5) for i in range(300)) and got[300].keep
    assert all(r.keep for r in score_quality(docs, labels.withColumn("toxic", F.lit(1)), F.col("source"), F.col("lang"), toxic="toxic").collect())


def test_quality_shrinks_sparse_sites(make):
    good, bad = "plain words of a sentence that goes on for a while", "BUY!! BUY!! BUY!! NOW!! NOW!!"
    rows = [(i, (good if i % 4 else bad) + f" {i}", "en", "big") for i in range(200)] + [(200 + i, bad + f" {i}", "en", "bad site") for i in range(60)] + [(300, good, "en", "lone"), (301, None, "en", "bad site"), (302, "", None, None), (None, good, "en", "big"), (300, good, "en", "lone")]
    docs = make(rows)
    labels = docs.where("doc_id < 260").select("doc_id", F.when(F.col("text").contains("BUY"), 0).otherwise(1).alias("quality"))
    got = {r.doc_id: r for r in score_quality(docs, labels, F.col("source"), F.col("lang")).collect()}
    assert all(got[i].keep == bool(i % 4) for i in range(200)) and not got[201].keep
    assert got[201].p_section < 0.3 < got[300].p_section < 1 and got[300].keep  # one document says little about its site
    assert got[301].score == pytest.approx(got[301].p_section) and got[302].keep
    assert score_quality(make([]), labels, F.col("source"), F.col("lang")).count() == 0
    assert all(r.keep for r in score_quality(docs, labels.limit(0), F.col("source"), F.col("lang")).collect())


def test_components(spark):
    rnd = random.Random(8)
    links = [(i, i + 1) for i in range(0, 200)] + [(1000 + rnd.randrange(300), 1000 + rnd.randrange(300)) for _ in range(200)] + [(5000, 5000 + i) for i in range(1, 300)]
    parent = {x: x for l in links for x in l}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    alone = {x for a, b in links for x in (a, b)} - {x for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == {x: root(x) for x in parent if x not in alone}


def test_pipeline_stages(spark, tmp_path, make, odd_rows):
    docs = make(odd_rows).select("doc_id", "text", "lang", "source", "n_chars", "row", "kept")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_copies", "mix", "bpe"]
    folder = str(tmp_path)
    spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    for empty, marks in ((False, "quality"), (True, "quality"), (False, "toxic")):
        if marks == "toxic":
            folder = str(tmp_path / "toxic")
            spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        now = docs.limit(0) if empty else docs
        counts = []
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, now, folder)
            now = spark.createDataFrame(made.collect(), made.schema)
            counts.append(now.count())
            if name != "bpe":
                assert now.columns == docs.columns
        assert counts == [0] * 5 if empty else counts[0] == counts[1] == docs.count() and counts[2] < counts[1] and counts[4] == counts[3]


def test_pipeline_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens").collect()
    assert rows and all(r.n_tokens > 0 for r in rows) and len({r.doc_id for r in rows}) > 50


@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_equal_sql(spark, folder, name):
    from check import compare, connect

    got = queries.QUERIES[name](spark, folder).toArrow()
    assert compare(got, connect(folder).sql(queries.SQL[name]).to_arrow_table()) == "ok"


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_queries_run(spark, folder, name):
    whole = {"op4_url_rules": "pages"}.get(name, "documents")
    assert queries.QUERIES[name](spark, folder).count() == table(spark, folder, whole).count()


def test_places_of_pages(make):
    good, bad = "plain words of a sentence that goes on for a while", "BUY!! BUY!! BUY!! NOW!! NOW!!"
    docs = make([(i, (bad if i % 2 else good) + f" {i}", "en", "a") for i in range(80)] + [(200, None, "en", "a"), (201, None, "en", "a"), (None, None, "en", "a")])
    labels = docs.where("doc_id < 80").select("doc_id", (1 - F.col("doc_id") % 2).alias("quality"))
    # Pages of bad documents and of 200 are on one host; 201 has no page.
    places = docs.where("doc_id % 2 = 1 AND doc_id < 80 OR doc_id = 200").select("doc_id", F.lit("bad.com").alias("site"), F.lit(None).cast("string").alias("section"))
    scores = score_quality(docs, labels, F.col("source"), F.col("lang"), places=places)
    got = {r.doc_id: r for r in scores.collect()}
    assert len(got) == 83 and got[200].p_section < 0.2 and not got[200].keep
    assert got[201].p_section > 0.8 and got[201].keep and got[None].keep
    assert score_quality(docs, labels, F.col("source"), F.col("lang"), places=places.limit(0)).count() == 83
