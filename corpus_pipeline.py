"""From raw documents to token ids: a chain of corpus operators, each stage on all that the stage before it kept.

Every stage takes and returns the columns of the documents table (the last one: ids), whatever other columns there are
and whatever their names. Texts are read whole, however long. Null and empty texts pass through as such, null ids are
kept, an empty table gives an empty one. Repeated rows count as one document where copies are sought, and as rows
elsewhere. Ties are settled by the smaller id, then by the hash of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.bpe import encode_documents
from shelfcast.llm.common import saved, table, with_decisions
from shelfcast.llm.jaccard import similar_documents
from shelfcast.llm.lines import drop_near_lines
from shelfcast.llm.mixing import mix
from shelfcast.llm.quality import score_quality
from shelfcast.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects neither as bad nor as toxic.

    Labels without a ``toxic`` column judge quality only. Null and empty texts are judged by their source and language.
    """
    scores = score_quality(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), toxic="toxic").select("_id", "_tag", "keep").distinct()
    return with_decisions(docs, scores, ["keep"]).where("keep").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line has; ``n_chars`` follows the text."""
    cleaned = drop_near_lines(docs)
    new = {"text": F.col("kept").alias("text"), "n_chars": F.coalesce(F.length("kept"), F.lit(0)).cast("long").alias("n_chars")}
    return cleaned.select(*[new.get(c, F.col("row")[c].alias(c)) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id."""
    first = F.col("class_id").eqNullSafe(F.col("_id")) & (F.col("first_tag") == F.col("_tag"))
    firsts = similar_documents(docs).where(first).select("_id", "_tag", F.lit(True).alias("keep")).distinct()
    kept = with_decisions(docs, firsts, ["keep"], how="inner").select("_row", F.col("_row.doc_id").alias("_id"), F.xxhash64("_row.text").alias("_tag"))
    return kept.dropDuplicates(["_id", "_tag"]).select("_row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mix(docs, F.array("source")).where("taken > 0").select("_id", "_tag", F.expr("taken div size").alias("times")).distinct()
    often = with_decisions(docs, taken, ["times"], how="inner")
    return often.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_documents(docs, vocabulary_path(), with_ids=True, carry=("source",))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mixed), ("bpe", encode)]

#: Trained weights, sampled paths and merges of a vocabulary can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
