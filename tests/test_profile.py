"""Load profiles against brute force."""

import random

import numpy as np
import pytest

from strandlog.operators import profile as P

SCHEMA = "mirror string, load_no int, load_id long, row_id long, country string, share string, size string, class string"


def rules(spark):
    return [
        P.ColumnRule("country", accepted=spark.createDataFrame([("Peru",), ("Fiji",), (None,), ("Fiji",)], "name string")),
        P.ColumnRule("share", P.DECIMAL_FORM, 0, 100),
        P.ColumnRule("size", P.INTEGER_FORM, 50, 15000),
    ]


def test_row_findings(spark):
    rows = [
        ("m", 0, 1, 1, "Peru", "5", "100", "x"), ("m", 0, 1, 2, " Peru", "5.", "100.0", "x"), ("m", 0, 1, 3, "N/A", "", "  ", "x"), ("m", 0, 1, 4, None, None, None, None),
        ("m", 0, 1, 5, "peru", "-3", "49", "x"), ("m", 0, 1, 6, "--", "100.01", "15001", "x"), ("m", 0, 1, 7, "Fiji", "1e2", "7O", "x"), ("m", 0, 1, 8, "?", "not  provided", "Unknown", "x"), ("m", 0, 1, 9, "Fiji", "5\n", "١٢٣", "x"), ("m", 0, 1, 10, "[Missing]", '"unknown"', "not_collected", None),
    ]
    got = {(r.row_id, r.column_name): r.finding for r in P.row_findings(spark.createDataFrame(rows, SCHEMA), rules(spark)).collect()}
    assert got == {
        (2, "country"): "pattern", (2, "share"): "pattern", (2, "size"): "pattern", (3, "country"): "placeholder", (3, "share"): "placeholder", (3, "size"): "placeholder", (5, "country"): "pattern",
        (5, "share"): "range", (5, "size"): "range", (6, "country"): "placeholder", (6, "share"): "range", (6, "size"): "range", (7, "share"): "pattern", (7, "size"): "pattern", (8, "country"): "placeholder",
        (8, "share"): "placeholder", (8, "size"): "placeholder", (9, "share"): "pattern", (9, "size"): "pattern", (10, "country"): "placeholder", (10, "share"): "placeholder", (10, "size"): "placeholder",
    }


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_distribution_matches_brute_force(spark, partitions):
    rng = random.Random(partitions)
    rows, rid = [], 0
    for load in range(5):
        n = 900 if load == 2 else rng.choice([1, 2, 60, 61])  # one load holds most rows
        for _ in range(n):
            rid += 1
            rows.append(("m", load, 10 + load, rid, rng.choice(["Peru", "Fiji", None, "?"]), str(rng.choice([1, 2, 2.5, 90, 90.0, 99])), str(rng.randint(60, 60 + 40 * (load + 1))), None))
    got = {(r.load_id, r.column_name): r for r in P.profile(spark.createDataFrame(rows, SCHEMA), rules(spark), partitions).collect()}
    assert len(got) == 15
    for load in range(5):
        for c, i in (("share", 5), ("size", 6)):
            cur = np.array([float(r[i]) for r in rows if r[1] == load])
            prev = np.array([float(r[i]) for r in rows if r[1] == load - 1])
            g = got[10 + load, c]
            assert g.n_good == len(cur) and g.n_distinct == len(set(cur)) and (g.low, g.high) == (cur.min(), cur.max())
            assert g["median"] == pytest.approx(np.median(cur))
            if len(prev):
                xs = np.unique(np.concatenate((cur, prev)))
                ks = np.abs(np.searchsorted(np.sort(cur), xs, "right") / len(cur) - np.searchsorted(np.sort(prev), xs, "right") / len(prev)).max()
                assert g.ks == pytest.approx(ks)
                assert g.median_prev == pytest.approx(np.median(prev)) and g.n_distinct_prev == len(set(prev))
            else:
                assert g.ks is None and g.prev_id is None


def test_load_findings(spark):
    def load(no, countries, shares, sizes):
        return [("m", no, no, 100 * no + i, c, s, z, None) for i, (c, s, z) in enumerate(zip(countries, shares, sizes, strict=True))]

    rows = load(1, ["Peru"] * 10, ["10"] * 8 + [None, None], [str(100 + i) for i in range(10)]) + load(2, ["Peru"] * 5 + ["Fiji"] * 5, ["15"] * 6 + [None] * 4, ["100"] * 10)
    rows += load(4, ["Fiji"] * 10, ["99"] * 10, ["100"] * 10)  # load 3 is absent: nothing to compare with
    got = sorted(map(tuple, P.load_findings(P.profile(spark.createDataFrame(rows, SCHEMA), rules(spark))).collect()))
    assert got == [(2, "country", "shift", 0), (2, "share", "missing", 0), (2, "share", "shift", 0), (2, "size", "distinct", 0)]


def test_loads_without_good_values_and_empty(spark):
    rows = [("m", 1, 1, 1, None, "?", "x", None), ("m", 2, 2, 2, "Peru", "5", "100", None)]
    got = P.load_findings(P.profile(spark.createDataFrame(rows, SCHEMA), rules(spark))).collect()
    assert {(r.column_name, r.finding) for r in got} == {("country", "missing"), ("share", "missing")}
    empty = spark.createDataFrame([], SCHEMA)
    assert P.profile(empty, rules(spark)).count() == 0 and P.row_findings(empty, rules(spark)).count() == 0
