"""The registered queries run over the smallest tables and agree with each other."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries(spark):
    from strandlog.llm.queries import QUERIES

    got = {name: query(spark, SF).toPandas() for name, query in QUERIES.items()}
    texts = spark.read.parquet(f"{SF}/documents.parquet")
    assert list(got["p3_found"].columns) == ["name_id_a", "name_id_b"] and (got["p3_found"].name_id_a < got["p3_found"].name_id_b).all()
    # a class of n names has n - 1 links a name, and every pair of it is found
    assert got["p3_entities"].links.sum() == 2 * len(got["p3_found"]) > 0
    assert got["p6_containers"].n_tokens.sum() == got["p6_packed"].n_tokens.sum() > 0 and (got["p6_containers"].unused >= 0).all()
    assert got["p6_coverage"].values.tolist() == [[texts.filter("text != ''").count(), 0, 0, 0]]
    assert list(got["p7_found"].columns) == ["doc_id", "item_id"] and set(map(tuple, got["p7_found"].values)) == set(map(tuple, got["p7_spans"][["doc_id", "item_id"]].values)) != set()
    assert (got["p7_spans"].last_word - got["p7_spans"].first_word >= 14).all()
    assert list(got["p8_found"].columns) == ["doc_id"] and 0 < len(got["p8_found"]) < got["p8_hosts"].n_pages.sum() == texts.count()
    assert got["p8_hosts"].spam_rate.between(0, 1).all() and texts.select(F.count_distinct(F.coalesce(F.split("repo", "/")[0], F.lit("")))).first()[0] == len(got["p8_hosts"])
