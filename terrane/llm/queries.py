"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.llm import mixing, sentences, termstats, tokens, topitems
from terrane.session import load, materialize


def p3_found(spark, d):
    return topitems.frequent(load(spark, d, "tags"), ["k", "v"], 6).select("field", "item")


def p3_bounds(spark, d):
    return topitems.heavy_hitters(load(spark, d, "tags"), ["k", "v"])


def p3_held(spark, d):
    """What the summaries promise, counted against the table: items held whose true count lies outside their bounds, and
    items above n / (m + 1) that aren't held."""
    tags = load(spark, d, "tags")
    held = topitems.heavy_hitters(tags, ["k", "v"])
    entries = tags.select(F.explode(F.array(F.struct(F.lit("k").alias("field"), F.col("k").alias("item")), F.struct(F.lit("v").alias("field"), F.col("v").alias("item")))).alias("e")).select("e.*").filter("item IS NOT NULL")
    true = entries.groupBy("field", "item").agg(F.count(F.lit(1)).alias("true"))
    n = true.groupBy("field").agg(F.sum("true").alias("entries"))
    both = true.join(held, ["field", "item"], "full_outer").join(n, "field")
    outside = F.col("lower_count").isNotNull() & ~F.coalesce(F.col("true").between(F.col("lower_count"), F.col("upper_count")), F.lit(False))
    lost = F.col("lower_count").isNull() & (F.col("true") * (topitems.COUNTERS + 1) > F.col("entries"))
    return both.groupBy("field").agg(F.max("entries").alias("entries"), F.count(F.when(outside, 1)).alias("outside"), F.count(F.when(lost, 1)).alias("lost"))


def p6_found(spark, d):
    out = termstats.marked_terms(load(spark, d, "tags"), "k", ["kind", "id"])
    return out.filter(F.col("mark").isNotNull()).select(F.col("term").alias("k"), "mark")


def p6_counts(spark, d):
    return termstats.marked_terms(load(spark, d, "tags"), "k", ["kind", "id"]).withColumnRenamed("term", "k")


def p6_split(spark, d):
    """The counts again, with radix partitions so small that they are split over and over."""
    return termstats.marked_terms(load(spark, d, "tags"), "k", ["kind", "id"], max_bytes=1 << 16).withColumnRenamed("term", "k")


def p7_ids(spark, d):
    return tokens.encode_documents(load(spark, d, "documents"))


def _counted(spark, d):
    docs = load(spark, d, "documents").withColumn("source", mixing.source_name(F.col("source"))).filter(F.col("source").isNotNull())
    return materialize(tokens.count_tokens(docs, ["doc_id", "source"]))


def p8_mix(spark, d):
    """The documents to use and how often."""
    counted = _counted(spark, d)
    return mixing.select(counted, materialize(mixing.plan(counted, load(spark, d, "mix_targets"))))


def p8_shares(spark, d):
    """Wanted and actual shares."""
    counted = _counted(spark, d)
    return mixing.report(counted, mixing.plan(counted, load(spark, d, "mix_targets")), load(spark, d, "mix_targets"))


def p9_found(spark, d):
    docs = load(spark, d, "documents")
    return sentences.sentences(docs, sentences.learn(docs))


def p9_languages(spark, d):
    """Sentences and their characters by the stated language."""
    docs = load(spark, d, "documents")
    found = sentences.sentences(docs, sentences.learn(docs)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("sent_end") - F.col("sent_start")).alias("chars"))
    return docs.select("doc_id", "lang").join(found, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("m").alias("n_sentences"), F.sum("chars").alias("n_chars"))


QUERIES = {f.__name__: f for f in (p3_found, p3_bounds, p3_held, p6_found, p6_counts, p6_split, p7_ids, p8_mix, p8_shares, p9_found, p9_languages)}

_P6 = """WITH total AS (SELECT count(*) AS n FROM (SELECT DISTINCT kind, id FROM tags)),
c AS (SELECT k, count(*) AS row_count, count(DISTINCT (kind, id)) AS record_count FROM tags WHERE k IS NOT NULL GROUP BY k),
m AS (SELECT k, row_count, record_count, CASE WHEN record_count < 3 THEN 'rare' WHEN record_count * 100 > n * 12 THEN 'common' END AS mark FROM c, total) """

SQL = {
    "p3_held": "SELECT field, count(item) AS entries, 0::BIGINT AS outside, 0::BIGINT AS lost FROM (SELECT 'k' AS field, k AS item FROM tags UNION ALL SELECT 'v', v FROM tags) GROUP BY field",
    "p3_found": """WITH e AS (SELECT 'k' AS field, k AS item FROM tags UNION ALL SELECT 'v', v FROM tags),
n AS (SELECT field, count(item) AS n FROM e GROUP BY field)
SELECT field, item FROM e JOIN n USING (field) WHERE item IS NOT NULL GROUP BY field, item, n.n HAVING count(*) * 1000 >= n.n * 6""",
    "p6_found": _P6 + "SELECT k, mark FROM m WHERE mark IS NOT NULL",
    "p6_counts": _P6 + "SELECT k, row_count, record_count, mark FROM m",
    "p6_split": _P6 + "SELECT k, row_count, record_count, mark FROM m",
}
