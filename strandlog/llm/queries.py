"""The queries p3_ and p6_ to p8_, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import leakage, names, packing, spam
from strandlog.session import materialize, read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_pairs(names.entities(read_table(spark, sf_dir, "submitted_names")))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name with its class and the number of other names linked to it."""
    e = materialize(names.entities(read_table(spark, sf_dir, "submitted_names")))
    sizes = e.groupBy("entity").agg(F.min("name_id").alias("class_id"), (F.count(F.lit(1)) - 1).alias("links"))
    return e.join(sizes, "entity").select("name_id", "kind", "class_id", "links")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each container with its number of parts and its unused tokens."""
    parts = packing.pack(read_table(spark, sf_dir, "documents"))
    used = parts.groupBy("container").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n_tokens").alias("n_tokens"))
    return used.withColumn("unused", F.lit(packing.CAPACITY) - F.col("n_tokens"))


def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing must keep: texts packed, containers too full, texts split though they fit one, and texts of which a token is missing or twice."""
    parts = materialize(packing.pack(read_table(spark, sf_dir, "documents")))
    ends = F.col("first_token") + F.col("n_tokens")
    texts = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.max(ends).alias("end"), F.count_distinct("first_token").alias("starts"), F.max("piece").alias("last"))
    whole = (F.col("n") == F.col("end")) & (F.col("starts") == F.col("pieces")) & (F.col("last") == F.col("pieces") - 1)
    by_text = texts.agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("end") <= packing.CAPACITY) & (F.col("pieces") > 1)).alias("split"), F.count_if(~whole).alias("incomplete"))
    full = parts.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > packing.CAPACITY).alias("overfull"))
    return by_text.select("texts", full.scalar().alias("overfull"), "split", "incomplete")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.removal_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(read_table(spark, sf_dir, "documents"))


def p8_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host with its pages and the rate of spam among them."""
    scored = materialize(spam.page_scores(read_table(spark, sf_dir, "documents")))
    return scored.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"), F.first("host_rate").alias("spam_rate"))


QUERIES = {f.__name__: f for f in (p3_found, p3_entities, p6_packed, p6_containers, p6_coverage, p7_found, p7_spans, p8_found, p8_hosts)}
#: ids of texts are unique in the tables
ORACLE: dict[str, str] = {"p6_coverage": "select count(distinct doc_id) as texts, 0::bigint as overfull, 0::bigint as split, 0::bigint as incomplete from documents where text <> ''"}
