"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index holds a posting (term, document, position, the words around it) for every place of a looked-up
term.  It is sharded by document and sorted by term in every shard; nothing is shuffled to build it.  A
phrase is looked up by its two rarest terms: their lists are shifted by the terms' offsets and intersected,
and what remains is compared with the words around the posting.  Document frequencies come from all
documents.  Rare terms first keep the lists short, whatever the frequent words of the corpus are.

Words are maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z taken as a-z.

Defined results: null text has no words and no hits; items without words have no window; equal items and
equal windows count for each item; rows that repeat a doc_id must be copies and are one document in the
hits, each row kept; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dunlin.llm.common import materialise, read

#: Words of a window; looked-up terms up to which their table is sent to every task (beyond: a shuffled join).
WINDOW, BROADCAST_TERMS = 13, 100_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    """The words of a text, in order.  ASCII text takes the quick way to lower case."""
    text = F.col(text) if isinstance(text, str) else text
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(low, _APART), "")


def _small(terms: DataFrame) -> DataFrame:
    """The table, to be sent to every task if its size has been checked."""
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, i, size, q, term: the places of every window of every item."""
    return (items.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
            .select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("i"))
            .select("item_id", "i", F.slice("w", F.col("i") + 1, window).alias("part"))
            .select("item_id", "i", F.size("part").alias("size"), F.concat_ws(" ", "part").alias("phrase"), F.posexplode("part").alias("o", "term"))
            .withColumn("q", F.col("i") + F.col("o")))


def document_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: occurrences of each looked-up term over all documents."""
    return (docs.select(F.explode(words("text")).alias("term")).join(_small(terms), "term").groupBy("term").agg(F.count("*").alias("n")))


def rarest_two(places: DataFrame, frequency: DataFrame) -> DataFrame:
    """item_id, i, size, phrase, t1, q1, t2, q2: the two rarest places of every window that can occur at all."""
    rated = places.join(frequency, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = W.partitionBy("item_id", "i").orderBy("n", "term", "o")
    first = (rated.withColumn("k", F.row_number().over(order)).where("k <= 2").groupBy("item_id", "i", "size", "phrase")
             .agg(F.min("n").alias("least"), *[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{x}{k}") for k in (1, 2) for c, x in (("term", "t"), ("q", "q"))]))
    return first.where("least > 0").drop("least")


def build_index(docs: DataFrame, terms: DataFrame, around: int = WINDOW - 1) -> DataFrame:
    """Postings of the looked-up terms: doc_id, n_words, pos, term, and from where and which words stand around.

    The first place of every document is always kept (with a null term if it is not looked up), so that
    the index also tells the length of each document."""
    every = (docs.select("doc_id", words("text").alias("w")).select("doc_id", "w", F.posexplode_outer("w").alias("pos", "word"))
             .join(_small(terms.select(F.col("term").alias("word"), "wide")), "word", "left")
             .where("wide is not null or pos is null or pos = 0"))
    begin = F.greatest(F.col("pos") - around, F.lit(0))
    return every.select("doc_id", F.size("w").alias("n_words"), "pos", F.when(F.col("wide").isNotNull(), F.col("word")).alias("term"),
                        F.when(F.col("wide"), begin).alias("begin"),
                        F.when(F.col("wide"), F.concat_ws(" ", F.slice("w", begin + 1, 2 * around + 1))).alias("around")).sortWithinPartitions("term")


def phrase_hits(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """item_id, doc_id, start, size of every exact occurrence of every window."""
    post = index.where("term is not null")
    first = _small(phrases.select("item_id", F.col("t1").alias("term"), "q1").distinct())
    second = _small(phrases.where("t2 is not null").select("item_id", F.col("t2").alias("term"), "q2").distinct())
    one = post.join(first, "term").select("item_id", "q1", "doc_id", (F.col("pos") - F.col("q1")).alias("shift"), "pos", "begin", "around")
    two = post.join(second, "term").select("item_id", "doc_id", (F.col("pos") - F.col("q2")).alias("shift")).distinct()
    single = phrases.where("t2 is null").select("item_id").distinct()
    both = one.join(two, ["item_id", "doc_id", "shift"], "left_semi").union(one.join(single, "item_id", "left_semi").select(one.columns))
    found = both.join(_small(phrases.select("item_id", "q1", "i", "size", "phrase")), ["item_id", "q1"])
    start = F.col("shift") + F.col("i")
    cut = F.concat_ws(" ", F.slice(F.split("around", " "), start - F.col("begin") + 1, F.col("size")))
    return found.where((start >= F.col("begin")) & (cut == F.col("phrase"))).select("item_id", "doc_id", start.alias("start"), "size").distinct()


def proximity_hits(index: DataFrame, terms: list[str], slop: int) -> DataFrame:
    """doc_id, start, end: places of the first term with every other term at most `slop` words away (nearest taken)."""
    post = index.where(F.col("term").isin(terms)).select("doc_id", "term", "pos")
    at = post.where(F.col("term") == terms[0]).select("doc_id", F.col("pos").alias("p"))
    out = at.withColumn("start", F.col("p")).withColumn("end", F.col("p"))
    cell = F.floor(F.col("pos") / (slop + 1))
    for t in terms[1:]:      # a place and its two neighbours hold all partners: an equi-join, never a document's places in pairs
        near = (post.where(F.col("term") == t).withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).select("doc_id", "cell", "pos"))
        out = (out.withColumn("cell", F.floor(F.col("p") / (slop + 1))).join(near, ["doc_id", "cell"])
               .where(F.abs(F.col("pos") - F.col("p")) <= slop).groupBy("doc_id", "p", "start", "end")
               .agg(F.min(F.struct(F.abs(F.col("pos") - F.col("p")).alias("d"), "pos")).alias("n"))
               .select("doc_id", "p", F.least("start", "n.pos").alias("start"), F.greatest("end", "n.pos").alias("end")))
    return out.select("doc_id", "start", "end").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings) of every document row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    places = materialise(windows(items, window), "windows")
    frequency = materialise(document_frequencies(docs, places.select("term").distinct()), "frequencies")
    phrases = materialise(rarest_two(places, frequency), "phrases")
    lookup = (phrases.select(F.col("t1").alias("term"), F.lit(True).alias("wide")).union(phrases.where("t2 is not null").select("t2", F.lit(False)))
              .groupBy("term").agg(F.max("wide").alias("wide")))
    index = materialise(build_index(docs, lookup, window - 1), "index")
    hits = phrase_hits(index, phrases)
    place = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))
    by_doc = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    covered = hits.select("doc_id", "start", "size").distinct().select("doc_id", place.alias("p")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    rows = index.where("pos is null or pos = 0").select("doc_id", F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"))
    return (rows.join(by_doc.join(covered, "doc_id"), "doc_id", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold 13-word windows of `benchmark` items, and how much of them they are."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


_SQL_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents), b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT len(g) AS z FROM q),
p AS (SELECT doc_id, z, i, list_slice(w, i, i + z - 1) AS g FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM d, z WHERE len(w) >= z)),
h AS (SELECT doc_id, i, z, item_id FROM p JOIN q USING (g)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + z)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
