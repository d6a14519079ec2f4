"""Allowing and blocking pages by their urls: fixed rules first, then association rules mined from labelled pages.

DataFrame operations and pyspark.ml's FP-growth only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import saved, shuffle_parts

#: Fixed values, given: verdict, host and path of each rule.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Share of the labelled pages that a combination of tokens must have, and share of bad pages among those with it.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: Pages that a combination must have at least, however few are labelled.
MIN_PAGES = 25
BAD = "=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a later, longer one overrides
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Scheme, host and each domain above it, path segments with numbers masked, ending, query keys and whether there is a fragment."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -i, i), ".")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda s: F.element_at(F.split(s, "="), 1)), lambda s: s != "")
    ending, scheme = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    parts = F.concat(
        F.when(host != "", domains).otherwise(F.array().cast("array<string>")),
        F.transform(segments, lambda s: F.concat(F.lit("path:"), F.regexp_replace(s, "[0-9]+", "#"))),
        F.transform(keys, lambda s: F.concat(F.lit("query:"), s)),
        F.when(ending != "", F.array(F.concat(F.lit("ending:"), F.lower(ending)))).otherwise(F.array().cast("array<string>")),
        F.when(scheme != "", F.array(F.concat(F.lit("scheme:"), F.lower(scheme)))).otherwise(F.array().cast("array<string>")),
        F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(parts)))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """Combinations of tokens that make a page bad, from ``tokens`` and ``bad``: ``needs``, ``key`` (its rarest token), ``confidence``, ``support``.

    How many there are is bounded by the support, not by the number of pages.
    """
    items = F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens"))
    baskets = labelled.where("bad IS NOT NULL AND size(tokens) > 0").select(items.alias("items"))
    min_support = min(1.0, max(min_support, min_pages / max(1, baskets.count())))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=shuffle_parts(labelled.sparkSession)).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.col("antecedent").alias("needs"), "confidence", "support")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    ways = rules.select("*", F.explode("needs").alias("token")).join(single, "token")
    return ways.groupBy("needs", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))


def filter_urls(pages: DataFrame, labels: DataFrame, page: str = "page_id", url: str = "url", rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """A verdict for each page: that of the longest fixed rule, else block if a mined rule fits, else allow.

    ``labels`` has ``page`` (the page's id) and ``bad`` (boolean); null ids and labels are left aside, and a page with
    several labels counts once for each. Columns: the id under the name of ``page``, ``host``, ``path``, ``rule``,
    ``verdict``, ``confidence`` and ``because`` (of the surest mined rule that fits, tokens in order, else null). Null
    urls and urls without ``://`` have an empty host and path. Repeated rows get equal verdicts; without labels there
    are no mined rules; an empty table gives no rows.
    """
    where, at = host_of(F.col(url)), path_of(F.col(url))
    parsed = pages.select(F.col(page).alias("page"), F.col(url).cast("string").alias("url"), where.alias("host"), at.alias("path"))
    parsed = parsed.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path"))).drop("url")
    known = parsed.select("page", "tokens").join(labels.select(F.col(page).alias("page"), "bad"), "page")
    mined = saved(mine_rules(known.select("tokens", "bad"), min_support, min_confidence, min_pages))
    # Many pages have equal tokens, so rules are matched once for each set of tokens; a rule is looked up by its rarest token.
    sets = parsed.select("tokens").distinct()
    tried = sets.select("tokens", F.explode("tokens").alias("key")).join(mined, "key").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = tried.groupBy("tokens").agg(F.max(F.struct("confidence", "support", F.array_sort("needs").alias("because"))).alias("best"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.join(best, "tokens", "left").withColumn("rule", rule)
    verdict = F.coalesce(verdict, F.when(F.col("best").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(F.col("page").alias(page), "host", "path", "rule", verdict.alias("verdict"), F.col("best.confidence").alias("confidence"), F.array_join("best.because", " ").alias("because"))
