"""Queries over the corpus, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import packing, pii, tokens
from auditlake.sources.tables import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return tokens.token_ids(docs, F.col("doc_id"), F.col("text")).select(F.col("row").alias("doc_id"), "ids")


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every text, encoded and decoded again."""
    ids = p6_ids(spark, folder)
    return tokens.decode(ids, F.col("doc_id"), F.col("ids")).select(F.col("row").alias("doc_id"), "text")


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    counted = tokens.token_ids(docs.filter("text IS NOT NULL"), F.col("doc_id"), F.col("text"), lengths_only=True).select("row", F.col("ids").alias("length"))
    none = docs.filter("text IS NULL").select(F.col("doc_id").alias("row"), F.lit(None).cast("long").alias("length"))
    return packing.written(counted.unionByName(none), "lengths")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_lengths(spark, folder)).select(F.col("row").alias("doc_id"), "piece", F.col("first").alias("first_token"), F.col("tokens").alias("n_tokens"), "container")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """One row: containers used, tokens in them, the share of space used, and the fewest containers that could do."""
    return (
        p7_containers(spark, folder).groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).filter("t > 0")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
        .selectExpr("containers", "pieces", "tokens", "fullest", f"tokens / (containers * {packing.CAPACITY}D) AS used", f"cast(ceil(tokens / {packing.CAPACITY}D) AS bigint) AS least_containers")
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    docs, lexicon = table(spark, folder, "documents"), pii.lexicon_rows(table(spark, folder, "name_lexicon"))
    return pii.find(docs, F.col("doc_id"), F.col("text"), lexicon).select(F.col("row").alias("doc_id"), "kind", "start_pos")


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with its items replaced by placeholders."""
    docs, lexicon = table(spark, folder, "documents"), pii.lexicon_rows(table(spark, folder, "name_lexicon"))
    return pii.find(docs, F.col("doc_id"), F.col("text"), lexicon, replace=True).select(F.col("row").alias("doc_id"), "text")


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """One row: rows that came out, different documents, documents with no ids, and those whose ids do not decode to their text."""
    ids, docs = p6_ids(spark, folder), table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("want"))
    back = tokens.decode(ids, F.col("doc_id"), F.col("ids")).select(F.col("row").alias("doc_id"), F.col("text").alias("got"))
    both = docs.join(back, "doc_id", "full_outer")
    return both.agg(F.count("got").alias("rows"), F.countDistinct("doc_id").alias("documents"), F.count_if(F.col("got") == "").alias("without_ids"), F.count_if(~F.col("got").eqNullSafe(F.col("want"))).alias("changed"))


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """One row: documents placed, tokens lost or doubled, documents split though they fit, containers above their capacity."""
    lengths = _lengths(spark, folder)
    pieces = packing.written(packing.pack(lengths), "pieces")
    per = pieces.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("sum"))
    docs = lengths.select("row", F.coalesce("length", F.lit(0)).alias("length")).join(per, "row", "full_outer")
    full = pieces.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > packing.CAPACITY).alias("overfull"))
    return docs.agg(F.count("n").alias("documents"), F.count_if(~F.col("length").eqNullSafe(F.coalesce("sum", F.lit(0)))).alias("miscounted"), F.count_if((F.col("n") > 1) & (F.col("length") <= packing.CAPACITY)).alias("needless_splits")).crossJoin(F.broadcast(full))  # one row each


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """One row: texts, and those whose redacted form is not the text with just the found spans replaced."""
    docs, lexicon = table(spark, folder, "documents"), pii.lexicon_rows(table(spark, folder, "name_lexicon"))
    spans = pii.find(docs, F.col("doc_id"), F.col("text"), lexicon).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("spans"))
    both = docs.select(F.col("doc_id").alias("row"), F.col("text").alias("want")).join(pii.find(docs, F.col("doc_id"), F.col("text"), lexicon, replace=True), "row").join(spans, "row", "left")
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substr("want", (acc["at"] + 1).cast("int"), (x["start_pos"] - acc["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"), x["end_pos"].alias("at"))
    made = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda acc: F.concat(acc["out"], F.substr("want", (acc["at"] + 1).cast("int"))))
    return both.agg(F.count(F.lit(1)).alias("texts"), F.count_if(~F.col("text").eqNullSafe(F.when(F.col("spans").isNull(), F.col("want")).otherwise(made))).alias("altered_elsewhere"))


QUERIES = {f.__name__: f for f in (p6_ids, p6_roundtrip, p6_check, p7_containers, p7_fill, p7_check, p8_found, p8_redacted, p8_check)}

SQL = {
    "p6_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p6_check": "SELECT count(*) AS rows, count(DISTINCT doc_id) AS documents, count(*) FILTER (WHERE coalesce(text, '') = '') AS without_ids, 0::bigint AS changed FROM documents",
    "p7_check": "SELECT count(*) AS documents, 0::bigint AS miscounted, 0::bigint AS needless_splits, 0::bigint AS overfull FROM documents",
    "p8_check": "SELECT count(*) AS texts, 0::bigint AS altered_elsewhere FROM documents",
}
