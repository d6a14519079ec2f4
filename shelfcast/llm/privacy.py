"""Personal data, and terms that give away whose it is.

Patterns find e-mail addresses, IP addresses, card and phone numbers. The entities to protect are these values and the
parts that values share (the domain of an address, the first numbers of the others). How often terms stand in texts with
an entity tells how much they disclose of it: the pointwise mutual information of term and entity, as a share of the
entity's own information, lowered the more the fewer texts speak for it. Terms above one threshold are to be
generalised, above a higher one to be removed, in the documents that have the entity. Copies of a text count once.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import WORD, saved, tag

KINDS = ("email", "ip", "card", "phone")
#: Share of a value's information from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.7, 0.9
#: Lowers the share of a pair met in n texts to n / (n + CAUTION) of it: met once it is 0.71 at most, which is generalised;
#: four texts at least must speak for a removal. The same at every size of the corpus.
CAUTION = 0.4

# Each pattern starts where the last match ended, steps over what can't be a match without looking back, and takes the
# match, so that time grows with the text whatever it holds. Group 1 is what is stepped over, group 2 the match.
_L, _D = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_OTHER = "[^A-Za-z0-9._%+-]"
_DIGITS = "[0-9]++(?:[ -][0-9]++)*+"
PATTERNS = {
    "email": rf"\G((?:{_OTHER}++|{_L}++(?!@{_D}++\.{_D}))*+)({_L}++@{_D}++(?:\.{_D}++)++)",
    "ip": r"\G((?:[^0-9]++|[0-9]++(?!\.[0-9]++\.[0-9]++\.[0-9]))*+)([0-9]++\.[0-9]++\.[0-9]++\.[0-9]++)",
    "card": rf"\G((?:[^0-9]++|(?![0-9](?:[ -]?[0-9]){{13}}){_DIGITS})*+)({_DIGITS})",
    "phone": r"\G((?:[^+]++|\+(?![0-9][ ().0-9-]+[0-9]))*+)(\+[0-9][ ().0-9-]+[0-9])",
}
_WORDS = r"\G([\x20\x09-\x0D]*+)([^\x20\x09-\x0D]++)"


def _worth_a_look(kind: str, text: Column) -> Column:
    return {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": text.rlike("[0-9](?:[ -]?[0-9]){13}")}[kind]


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, 2 * F.substring(digits, i, F.lit(1)).cast("int")).otherwise(F.substring(digits, i, F.lit(1)).cast("int")))
    return F.aggregate(F.transform(each, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: Column, hit: Column) -> Column:
    """Whether a match is what it looks like."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    card = F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(False)
    return F.when(kind == 1, small).when(kind == 2, card).when(kind == 3, (n >= 10) & (n <= 15)).otherwise(True)


def _spans(rows: DataFrame, keys: list[str], pieces: str) -> DataFrame:
    """Start and end of each match, from pairs of what was stepped over and matched in ``pieces``."""
    each = rows.select(*keys, F.posexplode(pieces).alias("i", "x")).select(*keys, "i", F.col("x.0").alias("gap"), F.col("x.1").alias("hit"))
    so_far = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("gap") + F.length("hit")).over(so_far).cast("long")
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))


def _pieces(text: Column, pattern: str) -> Column:
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("0"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("1"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entities(kind: Column, hit: Column) -> tuple[Column, Column]:
    """The value of a match, and the part of it that other values may share."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    value = F.when(kind >= 2, digits).otherwise(F.lower(hit))
    part = F.when(kind == 0, F.substring_index(F.lower(hit), "@", -1)).when(kind == 1, F.substring_index(hit, ".", 2)).when(kind == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 5))
    return value, part


def _form(term: Column) -> Column:
    """What stands in for a generalised term."""
    return F.when(term.rlike("[0-9]"), "<number>").when(term.rlike(r"^[^\p{L}]*\p{Lu}"), "<name>").otherwise("<word>")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, caution: float = CAUTION) -> DataFrame:
    """Spans of personal data and of disclosing terms in each whole text.

    Columns: ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256`` (digest of the pattern spans as
    kind:start:end), ``spans`` (those and the terms' as ``general`` or ``removed``), in order of start and kind, and
    ``forms``, start:end:form of each general term, where the form is <number>, <name> or <word>. Positions are code
    points, ends exclusive. Null texts are empty. Repeated rows are one document and get equal rows of results. An empty
    table gives no rows; extra columns are left aside. Terms are words as they stand, and none that touch a pattern span
    are marked. Counts are of different texts, so copies of a text disclose no more than it does; an entity that all
    texts have discloses nothing.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), tag(text).alias("tag"), text.alias("text"))
    looks = [_worth_a_look(k, F.col("text")) for k in KINDS]
    some = rows.where(looks[0] | looks[1] | looks[2] | looks[3])
    sides = F.array(*[F.struct(F.lit(i).alias("kind"), F.when(look, _pieces(F.col("text"), PATTERNS[k])).alias("pieces")) for i, (k, look) in enumerate(zip(KINDS, looks))])
    cut = some.select("doc_id", "tag", F.explode(sides).alias("side")).select("doc_id", "tag", "side.kind", "side.pieces").where("size(pieces) > 0").dropDuplicates(["doc_id", "tag", "kind"])
    found = _spans(cut, ["doc_id", "tag", "kind"], "pieces").where(_holds(F.col("kind"), F.col("hit")))
    value, part = _entities(F.col("kind"), F.col("hit"))
    found = saved(found.select("doc_id", "tag", "kind", "start", "end", value.alias("value"), part.alias("part")))
    names = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct("start", F.col("kind").alias("rank"), names.alias("kind"), "end")
    counts = [F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    base = found.groupBy("doc_id", "tag").agg(*counts, F.collect_list(span).alias("base"))
    marked = _disclosing(rows, some, found, generalise, remove, caution).withColumnRenamed("tag", "_mark")
    every = F.concat("base", F.coalesce("terms", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")))
    told = base.join(marked, F.col("tag") == F.col("_mark"), "left").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), *[f"n_{k}" for k in KINDS], _listed(F.col("base")).alias("base"), _listed(every).alias("spans"), "forms")
    out = rows.select("doc_id", "tag").join(told, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *zero, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("forms", F.lit("")).alias("forms"))


def _disclosing(rows: DataFrame, some: DataFrame, found: DataFrame, generalise: float, remove: float, caution: float) -> DataFrame:
    """Terms that disclose an entity of their text, once per different text: ``tag``, ``terms`` (spans) and ``forms``.

    ``some`` holds all rows in which anything was found. Entities that stand in the same texts disclose alike and are one
    class; all that stand in one text only are a single class of it.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))  # of rows with one text, the smallest id stands for all
    firsts = saved(rows.groupBy("tag").agg(F.min(key).alias("_key")))
    total = firsts.count()
    firsts = firsts.withColumnRenamed("tag", "_tag")
    first_of = lambda docs, of: docs.withColumn("key", key).join(of, (F.col("key") == F.col("_key")) & (F.col("tag") == F.col("_tag")), "left_semi").dropDuplicates(["key", "tag"]).select("tag", "text")
    distinct = lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))
    named = F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("value").alias("name")), F.struct(F.lit(1).alias("level"), F.col("part").alias("name")))).alias("entity")
    held = found.select("tag", "kind", named).select("tag", "kind", "entity.*").distinct()
    entities = held.groupBy("kind", "level", "name").agg(F.count("*").alias("n_entity"), *[F.bit_xor(F.xxhash64("tag", F.lit(i))).alias(f"class{i}") for i in (1, 2)])
    classes = held.join(entities, ["kind", "level", "name"]).where(F.col("n_entity") < total).select("tag", "class1", "class2", "n_entity").distinct()
    texts = saved(first_of(some, firsts.join(found.select(F.col("tag").alias("_tag")).distinct(), "_tag", "left_semi")))
    # All texts count for how common a term is. Only their different terms move, joined by a space, which none holds.
    lists = rows.withColumn("text", F.array_join(distinct("text"), " "))
    common = first_of(lists, firsts).select(F.explode(F.split("text", " ")).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n_term"))
    here = texts.select("tag", F.explode(distinct("text")).alias("term")).join(common, "term")
    # A pair in more texts than this can't reach the threshold even if every text of the entity has it, so leaving it out loses nothing.
    most = F.col("n_entity") * F.pow(F.lit(float(total)) / F.col("n_entity"), F.lit(1 - generalise))
    pairs = saved(classes.join(here, "tag").where(F.col("n_term") <= most))
    ways = ["class1", "class2", "term"]
    mutual = F.log(F.lit(float(total)) * F.col("n_pair") / (F.col("n_entity") * F.col("n_term")))
    share = mutual / F.log(F.lit(float(total)) / F.col("n_entity")) * F.col("n_pair") / (F.col("n_pair") + caution)
    telling = pairs.groupBy(*ways, "n_entity", "n_term").agg(F.count("*").alias("n_pair")).select(*ways, share.alias("share")).where(F.col("share") >= generalise)
    chosen = saved(pairs.join(telling, ways).groupBy("tag", "term").agg(F.max("share").alias("share")))
    told = texts.join(chosen.select("tag").distinct(), "tag", "left_semi").select("tag", _pieces(F.col("text"), _WORDS).alias("pieces"))
    spots = _spans(told, ["tag"], "pieces").withColumnRenamed("hit", "term").join(chosen, ["tag", "term"])
    taken = found.select("tag", "start", "end").distinct().groupBy("tag").agg(F.collect_list(F.struct("start", "end")).alias("base"))
    beside = spots.join(taken, "tag").where(~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"])))
    action = F.when(F.col("share") >= remove, "removed").otherwise("general")
    span = F.struct("start", F.lit(9).alias("rank"), action.alias("kind"), "end")
    form = F.struct("start", "end", F.when(F.col("share") < remove, _form(F.col("term"))).alias("form"))
    marked = beside.groupBy("tag").agg(F.collect_list(span).alias("terms"), F.array_sort(F.collect_list(form)).alias("forms"))
    shown = F.transform(F.filter("forms", lambda f: f["form"].isNotNull()), lambda f: F.concat_ws(":", f["start"].cast("string"), f["end"].cast("string"), f["form"]))
    return marked.select("tag", "terms", F.array_join(shown, ",").alias("forms"))
