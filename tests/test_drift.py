"""Schema drift between files of a feed."""

import json

from strandlog.operators import drift


def lines(spark, files, mirror="m", organism="zika"):
    rows, i = [], 0
    for no, recs in files.items():
        for r in recs:
            i += 1
            rows.append((i, mirror, organism, no, json.dumps({"metadata": r}) if isinstance(r, dict) else r, "x"))
    return spark.createDataFrame(rows, "line_id long, mirror string, organism string, file_no int, line string, field string")


def changes(df):
    return sorted(tuple(r)[2:] for r in drift.schema_changes(df).collect())


def test_every_kind_of_change(spark):
    files = {
        1: [{"accession": f"A{i}", "clade": f"c{i}", "age": i, "gone": "g", "flag": None} for i in range(10)],
        2: [{"accession": f"A{i}", "cladeName": f"c{i}", "age": i, "flag": True, "fresh": i % 2} for i in range(11)],
        3: [{"accession": f"A{i}", "CladeName": f"c{i}" if i else None, "age": str(i), "flag": None, "fresh": i % 2} for i in range(11)],
        4: [{"accession": f"A{i}", "CladeName": [f"c{i}"], "age": i if i % 2 else str(i), "flag": 1, "fresh": None} for i in range(11)],
    }
    files[3][0]["CladeName"] = "c0"
    assert changes(lines(spark, files)) == [
        (2, "clade", "renamed", "cladeName"), (2, "fresh", "added", "fresh"), (2, "gone", "removed", "gone"), (3, "age", "type_changed", "age"), (3, "cladeName", "renamed", "CladeName"),
        (4, "CladeName", "type_changed", "CladeName"), (4, "age", "type_changed", "age"), (4, "flag", "type_changed", "flag"),
    ]


def test_alike_fields_are_not_confused(spark):
    """Two fields go and two come; values decide, not names alone."""
    files = {
        1: [{"accession": f"A{i}", "hostAge": i, "hostSize": 100 + i} for i in range(12)],
        2: [{"accession": f"A{i}", "host_size": i, "host_age": 500 + i} for i in range(12)],
    }
    assert changes(lines(spark, files)) == [(2, "hostAge", "renamed", "host_size"), (2, "hostSize", "removed", "hostSize"), (2, "host_age", "added", "host_age")]


def test_added_again_forgets_the_old_type(spark):
    files = {1: [{"accession": "A", "x": 1}], 2: [{"accession": "A"}], 3: [{"accession": "A", "x": "s"}]}
    assert changes(lines(spark, files)) == [(2, "x", "removed", "x"), (3, "x", "added", "x")]


def test_broken_lines_gaps_and_repeats(spark):
    files = {1: [{"accession": "A", "x": 1}, {"accession": "A", "x": 1}, None, "{", "[]", '{"metadata": 3}'], 3: [{"accession": "A", "y": 1}]}
    assert changes(lines(spark, files)) == []
    assert changes(lines(spark, {1: [{"accession": None, "x": 1}], 2: [{"x": 1, "z": {"k": 1}}]})) == [(2, "accession", "removed", "accession"), (2, "z", "added", "z")]
    assert drift.schema_changes(lines(spark, {1: [{"a": 1}]}).limit(0)).count() == 0
    stray = lines(spark, {1: [{"a": 1}], None: [{"b": 2}]}).unionByName(lines(spark, {2: [{"c": 1}]}, mirror=None))
    assert changes(stray) == []


def test_united_table_follows_renames(spark):
    files = {1: [{"accession": "A", "clade": "c1", "n": None}], 2: [{"accession": "A", "lineage": "c1", "n": {"k": 2}}]}
    got = sorted((r.file_no, r.field, r.value) for r in drift.united(lines(spark, files)).collect())
    assert got == [(1, "accession", "A"), (1, "clade", "c1"), (2, "accession", "A"), (2, "clade", "c1"), (2, "n", '{"k":2}')]


def plain_schema(**more):
    return {f"k{i}Name": ("string",) for i in range(8)} | more


def test_flooding_prefers_structure_over_chance():
    old = plain_schema(authorList=("string",), hostAge=("number",))
    new = plain_schema(authors=("string",), age=("number",))
    pairs = [("authorList", "authors"), ("hostAge", "age"), ("authorList", "age"), ("hostAge", "authors")]
    # all four pairs carry equal values: names and types decide
    assert drift.renames(old, new, dict.fromkeys(pairs, 1.0)) == {"authors": "authorList", "age": "hostAge"}
    assert drift.renames(old, new, {}) == {} and drift.flood({}, {}, {}) == {} and max(drift.flood(old, new, {}).values()) <= 1.0


def test_scores_flow_until_they_decide():
    """Without flooding a pair of fields knows only its names; neither the share of equal values nor likeness decides alone."""
    old, new = plain_schema(clade=("string",)), plain_schema(lineage=("string",))
    pair = ("clade", "lineage")
    assert drift.renames(old, new, {pair: 1.0}) == {"lineage": "clade"} and drift.renames(old, new, {pair: 0.6}) == {}
    still = drift.flood(old, new, {pair: 1.0}, rounds=0)
    assert still[pair] < 0.05 and (pair in drift.select_matches(drift.flood(old, new, {pair: 1.0})))
    alike, other = plain_schema(subclade=("string",)), plain_schema(subclade=("number",))
    assert drift.renames(old, alike, {("clade", "subclade"): 0.8}) == {"subclade": "clade"} and drift.renames(old, new, {pair: 0.8}) == {}
    assert drift.renames(old, other, {("clade", "subclade"): 0.8}) == {}  # the types do not support it


def test_inner_keys_support_their_objects(spark):
    """An object whose inner keys drift is equal nowhere as a whole, yet its inner values flow up to it."""
    files = {
        1: [{"accession": f"A{i}", "place": {"name": f"n{i}", "code": i, "by": "x"}} for i in range(10)],
        2: [{"accession": f"A{i}", "site": {"title": f"n{i}", "code": i, "by": "x"}} for i in range(10)],
        3: [{"accession": f"A{i}", "other": {"title": f"z{i}", "code": -i, "by": "x"}} for i in range(10)],
    }
    files[3][0]["other"]["code"] = 77
    assert changes(lines(spark, files)) == [(2, "place", "renamed", "site"), (3, "other", "added", "other"), (3, "site", "removed", "site")]


def test_renamed_and_retyped_at_once(spark):
    files = {1: [{"accession": f"A{i}", "hostAge": i, "k": "x"} for i in range(10)], 2: [{"accession": f"A{i}", "age": str(i), "k": "x"} for i in range(10)]}
    assert changes(lines(spark, files)) == [(2, "hostAge", "renamed", "age"), (2, "hostAge", "type_changed", "age")]


def test_feeds_across_batches(spark):
    """A feed whose rows reach the task in several batches is one feed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        files = {n: [{"accession": "A", f"f{n}": f"v{n}", "x": n}] for n in range(1, 9)}
        got = changes(lines(spark, files).unionByName(lines(spark, {1: [{"a": 1}], 2: [{"b": 1}]}, mirror="other")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len([c for c in got if c[1].startswith("f") and c[2] == "added"]) == 7 and (2, "b", "added", "b") in got
