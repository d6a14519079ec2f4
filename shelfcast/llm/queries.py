"""One query per operator on its whole table, and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.alignment import align_tokenizers
from shelfcast.llm.bpe import encode_documents
from shelfcast.llm.common import saved, table
from shelfcast.llm.conversations import numbered_turns, prefix_trie, share_beginnings
from shelfcast.llm.fingerprints import fingerprints
from shelfcast.llm.jaccard import similar_documents
from shelfcast.llm.licenses import scan_licenses
from shelfcast.llm.lines import drop_near_lines
from shelfcast.llm.mixing import mix
from shelfcast.llm.mtree import top_k
from shelfcast.llm.privacy import find_private
from shelfcast.llm.quality import score_quality
from shelfcast.llm.substrings import remove_repeated_passages
from shelfcast.llm.urls import filter_urls, host_of, path_of

#: Vocabulary files; None: byte_bpe_50k.json and piece_bpe_32k.model of the installed public_tokenizers.
VOCABULARY: str | None = None
PIECES: str | None = None


def vocabulary_path() -> str:
    if VOCABULARY:
        return VOCABULARY
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_path() -> str:
    if PIECES:
        return PIECES
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SEARCH = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def op2_near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_near_lines(table(spark, sf_dir, "documents")).select("row.doc_id", "n_lines", "n_removed", "kept_sha256")


LINES = """
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS no FROM texts),
worded AS (SELECT *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS words FROM lines),
ranked AS (SELECT doc_id, no, words, array_to_string(words, ' ') AS body, row_number() OVER (ORDER BY doc_id, no) AS pos
  FROM worded WHERE len(words) > 0),
firsts AS (SELECT body, min(pos) AS pos, any_value(words) AS words FROM ranked GROUP BY body),
variants AS (
  SELECT pos, len(words) AS n, p, array_to_string(list_concat(words[1:p - 1], words[p + 1:]), ' ') AS rest
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS p FROM firsts WHERE len(words) >= 8)),
near AS (
  SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY n, p, rest) AS least FROM variants) WHERE least < pos
  UNION
  SELECT greatest(v.pos, f.pos) FROM variants v JOIN firsts f ON f.body = v.rest WHERE v.n > 8),
gone AS (
  SELECT r.doc_id, r.no FROM ranked r JOIN firsts f ON f.body = r.body WHERE r.pos > f.pos
  UNION SELECT doc_id, no FROM ranked WHERE pos IN (SELECT pos FROM near)),
kept AS (SELECT l.doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY l.no) AS body
  FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.no = l.no GROUP BY l.doc_id)
SELECT t.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id"""


def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


#: A page shows the document whose id is the last number in its url.
SHOWN = "try_cast(regexp_extract(url, '([0-9]+)[^0-9/?#]*/?(?:[?#]|$)', 1) AS BIGINT)"


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page has the labels of the document that it shows."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    shown = pages.select("page_id", F.expr(SHOWN).alias("doc_id"))
    bad = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return filter_urls(pages, shown.join(bad, "doc_id").select("page_id", "bad"))


def op5_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_substring_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(table(spark, sf_dir, "documents")).drop("kept")


SUBSTRINGS = """
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM texts WHERE len(words) >= 50),
windows AS (SELECT doc_id, p, md5(array_to_string(words[p:p + 49], ' ')) AS h FROM places),
firsts AS (SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT w.doc_id, w.p FROM windows w JOIN firsts f ON f.h = w.h WHERE f.first_id < w.doc_id),
removed AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM hits)),
numbered AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS q FROM texts),
kept AS (SELECT n.doc_id, n.q, n.word FROM numbered n ANTI JOIN removed r ON r.doc_id = n.doc_id AND r.q = n.q),
joined AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS body FROM kept GROUP BY doc_id)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM texts t LEFT JOIN joined j ON j.doc_id = t.doc_id"""


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), F.array("source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))


def op9_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site and section of a document are host and first path segment of the first page that shows it; ``source`` and
    ``lang`` stand in where no page does."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(SHOWN).alias("doc_id"), host_of(F.col("url")).alias("site"), F.split(path_of(F.col("url")), "/").alias("steps"))
    first = F.min(F.struct("page_id", "site", F.try_element_at("steps", F.lit(2)).alias("section")))
    places = pages.where("doc_id IS NOT NULL").groupBy("doc_id").agg(first.alias("page")).select("doc_id", "page.site", "page.section")
    scores = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), toxic="toxic", places=places)
    return scores.drop("_id", "_tag")


def op11_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), vocabulary_path(), pieces_path())


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations take over the first turns of the one that opens their hundred."""
    own = saved(numbered_turns(table(spark, sf_dir, "conversations")))
    conv = F.col("conv_id")
    return prefix_trie(share_beginnings(own, conv - conv % 100, F.crc32(conv.cast("string")) % 6, most=5))


TRIE = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
bytes AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(0, 256)) AS i)),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS model, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda x, y: xor(t[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own), bytes),
turns AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.model AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
paths AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS size,
    string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
members AS (
  SELECT conv_id, depth, size, md5(path) AS node, md5(left(path, length(path) - 32)) AS parent FROM paths
  UNION ALL SELECT conv_id, 0, 0, md5(''), NULL FROM convs),
nodes AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n, min(size) AS size FROM members GROUP BY node),
children AS (SELECT parent, count(*) AS n_children FROM nodes GROUP BY parent),
full_nodes AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.parent = n.node),
below AS (
  SELECT m.node, sum((n.n - 1) * n.size) AS saved, count(*) FILTER (WHERE n.n_children = 0) AS leaves
  FROM full_nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.node),
ends AS (
  SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) AS back FROM members) WHERE back = 1 GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, n.n_children, b.leaves AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_nodes n JOIN below b ON b.node = n.node LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN ends e ON e.node = n.node"""



def op13_rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mtree_search, op2_near_lines, op3_chosen_path, op4_url_rules, op5_bpe_trie, op6_substring_sketch, op7_source_mix, op8_disclosure, op9_lookup_sketch, op10_site_quality, op11_pair_bitmaps, op12_prefix_trie, op13_rare_words)}
SQL: dict[str, str] = {"op1_mtree_search": SEARCH, "op2_near_lines": LINES, "op6_substring_sketch": SUBSTRINGS, "op12_prefix_trie": TRIE}
