"""The queries p1_, p2_, p4_ and p5_: preparation of general data, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators import drift, nested, packed, profile
from strandlog.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = nested.all_children(read_table(spark, sf_dir, "vector_docs"))
    return children.select("file_id", "entry_pos", "accession", "child", "gene", "item_pos")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.record_table(read_table(spark, sf_dir, "vector_docs"))


def p1_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.child_table(read_table(spark, sf_dir, "vector_docs"), "alignedAminoAcidSequences")
    return rows.select("file_id", "entry_pos", "accession", "gene", F.col("value").alias("sequence"))


def p1_insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.child_table(read_table(spark, sf_dir, "vector_docs"), "aminoAcidInsertions")
    return rows.select("file_id", "entry_pos", "accession", "gene", "item_pos", F.col("value").alias("insertion"))


def zika_rules(spark: SparkSession, sf_dir: str) -> list[profile.ColumnRule]:
    return [
        profile.ColumnRule("geoloccountry", accepted=read_table(spark, sf_dir, "geo_countries").select("name")),
        profile.ColumnRule("breadthofcoverage", profile.DECIMAL_FORM, 0, 100),
        profile.ColumnRule("ampliconsize", profile.INTEGER_FORM, 50, 15000),
    ]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    zika, rules = read_table(spark, sf_dir, "zika_metadata"), zika_rules(spark, sf_dir)
    rows = profile.row_findings(zika, rules)
    return rows.unionByName(profile.load_findings(profile.profile(zika, rules)))


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.profile(read_table(spark, sf_dir, "zika_metadata"), zika_rules(spark, sf_dir))
    return p.select("mirror", "load_no", "load_id", "column_name", "n_rows", "n_null", "n_placeholder", "n_pattern", "n_range", "n_good", "n_distinct", "low", "high", F.round("median", 6).alias("median"), F.round("ks", 9).alias("ks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    zika = packed.explode_packed(read_table(spark, sf_dir, "zika_metadata"), "authors", "person", ["row_id"])
    andv = packed.explode_packed(read_table(spark, sf_dir, "andv_metadata"), "authoraffiliations", "organisation", ["row_id"])
    tagged = [d.select(F.lit(name).alias("dataset"), "row_id", F.col("pos").cast("bigint").alias("pos"), "item") for name, d in (("zika_metadata", zika), ("andv_metadata", andv))]
    return tagged[0].unionByName(tagged[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(read_table(spark, sf_dir, "feed_lines")).select("mirror", "organism", F.col("file_no").cast("bigint").alias("file_no"), "field", "change", "new_field")


def p5_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.united(read_table(spark, sf_dir, "feed_lines"))


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_sequences, p1_insertions, p2_found, p2_profile, p4_found, p5_found, p5_united)}
