"""Nested records as flat tables."""

import json
from datetime import datetime

from strandlog.operators import nested

T0, T1 = datetime(2026, 1, 1), datetime(2026, 1, 2)


def table(spark, docs):
    rows = [(f, t, d, "x", 1) for f, t, d in docs]
    return spark.createDataFrame(rows, "file_id long, received_at timestamp, doc string, gene string, entry_pos int")


def record(acc="A", seqs=None, ins=None, **more):
    r = {"metadata": {"accession": acc, "version": 2}, "organism": "zika", **more}
    if seqs is not None:
        r["alignedAminoAcidSequences"] = seqs
    if ins is not None:
        r["aminoAcidInsertions"] = ins
    return r


def test_all_places_and_shapes(spark):
    docs = [
        (1, T0, json.dumps({"samples": [{"input": {"a": 1}}, {"input": record("A", {"E": "MK", "M": None}, {"E": ["1:A", None, "2:B"]})}, {"input": "text"}]})),
        (2, T0, json.dumps({"input": {"entries": [record(None, [{"gene": "E", "sequence": "MM"}, {"gene": "N"}], [{"gene": "N", "insertions": ["3:C"]}]), {"no": 1}]}})),
        (3, T0, json.dumps({"input": {"batches": [{"entries": [record("B", {"E": "X"})]}, {}, {"entries": [record("C", {"E": "Y"})]}]}})),
        (4, T0, '{"samples": [{"input"'),
        (5, T0, None),
        (6, T0, ""),
        (7, T0, json.dumps({"samples": [{"input": record("Z", {"E": "Q"})}]}) + " trailing"),
        (8, T0, json.dumps([1, 2])),
        (None, T0, json.dumps({"samples": []})),
    ]
    got = sorted((r.file_id, r.entry_pos, r.accession, r.child[:8], r.gene, r.item_pos, r.value) for r in nested.all_children(table(spark, docs)).collect())
    assert got == [
        (1, 0, "A", "alignedA", "E", 0, "MK"), (1, 0, "A", "aminoAci", "E", 0, "1:A"), (1, 0, "A", "aminoAci", "E", 2, "2:B"),
        (2, 0, "", "alignedA", "E", 0, "MM"), (2, 0, "", "aminoAci", "N", 0, "3:C"), (3, 0, "B", "alignedA", "E", 0, "X"), (3, 1, "C", "alignedA", "E", 0, "Y"),
    ]
    recs = sorted(map(tuple, nested.record_table(table(spark, docs)).collect()))
    assert recs == [(1, 0, "A", 2, "zika"), (2, 0, "", 2, "zika"), (3, 0, "B", 2, "zika"), (3, 1, "C", 2, "zika")]


def test_each_file_once(spark):
    good = json.dumps({"samples": [{"input": record("A", {"E": "MK"})}]})
    late = json.dumps({"samples": [{"input": record("L", {"E": "MK"})}]})
    got = nested.all_children(table(spark, [(1, T0, good), (1, T0, good), (1, T1, late), (1, datetime(2026, 1, 3), "{broken")])).collect()
    assert [r.accession for r in got] == ["L"]


def test_empty_and_long(spark):
    assert nested.all_children(table(spark, [(1, T0, "{}")]).limit(0)).count() == 0
    big = json.dumps({"samples": [{"input": record("A", {f"g{i}": "M" * 1000 for i in range(500)})}]})
    assert nested.child_table(table(spark, [(1, T0, big)]), "alignedAminoAcidSequences").count() == 500


def test_one_shuffle(spark):
    plan = nested.all_children(table(spark, [(1, T0, "{}")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
