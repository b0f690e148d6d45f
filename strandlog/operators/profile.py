"""Column-level quality profile of loads, with exact quantiles, distinct counts and drift between loads.

Values are unpivoted to (column, load, value), counted per distinct value, paired with the previous
load of the same source and sorted by range of (column, pair, value). Each range partition yields
running counts of both loads; the totals of the partitions before it are added, which gives for every
value its place on both cumulative curves. Medians and quantiles are read off the curves, distinct
counts are the numbers of values on each, and the largest vertical distance is the exact two-sample
Kolmogorov-Smirnov distance. No task ever holds a load, however large: a load that makes up a third of
all rows is spread over as many range partitions as its distinct values fill.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.session import materialize

# fixed values: texts that say there is no value, compared without case and surrounding space
PLACEHOLDERS = (
    "not provided", "not collected", "not applicable", "not available", "not reported", "not recorded", "not determined", "not known", "not specified", "not given", "not stated", "not tested", "not assigned",
    "missing", "unknown", "unspecified", "undetermined", "undefined", "unassigned", "unavailable", "none", "no data", "no value", "no information", "empty", "blank", "restricted access", "restricted", "withheld", "confidential",
    "n/a", "na", "n.a.", "n.a", "#n/a", "nan", "null", "nil", "void", "nd", "n.d.", "n.d", "n/d", "s/d", "s.d.", "sd", "tbd", "tba", "tbc", "to be determined", "to be confirmed", "to be announced", "pending",
    "missing: not provided", "missing: not collected", "missing: restricted access", "missing: control sample", "missing: third party data",
    "(blank)", "unk", "undef", "not yet known", "not recorded yet", "no record", "#value!", "#ref!", "nulo", "vacío", "vazio",
    "sin información", "sin especificar", "no reportado", "no determinado", "no se conoce", "por confirmar", "pendiente", "não disponível", "não se aplica", "não coletado", "non précisé", "nicht erhoben", "nicht bekannt", "ohne angabe", "entfällt",
    "sin dato", "sin datos", "no disponible", "desconocido", "no aplica", "nao informado", "não informado", "sem dados", "desconhecido", "unbekannt", "keine angabe", "k.a.", "k. a.", "nicht verfügbar", "inconnu", "non disponible", "non renseigné", "sans objet", "non disponibile", "sconosciuto", "onbekend",
)
_NO_TEXT = r"\A[\s\p{Z}\-‐-―_.?*/\\#~]*\z"
_AROUND = r"^[\s\[(<{\"']+|[\s\])>}\"']+$"
DECIMAL_FORM = r"\A-?[0-9]+(\.[0-9]+)?\z"
INTEGER_FORM = r"\A-?[0-9]+\z"


@dataclass(frozen=True)
class ColumnRule:
    """What a good value of a column is: a pattern with a range of numbers, or membership in a list."""

    name: str
    pattern: str | None = None
    low: float | None = None
    high: float | None = None
    accepted: DataFrame | None = None  # one string column

    @property
    def numeric(self) -> bool:
        return self.accepted is None


def is_placeholder(value: Column) -> Column:
    """True for blank text, text of dashes, dots and the like, and the texts of ``PLACEHOLDERS``.

    Case, brackets and quotes around the text, and the number of spaces do not matter; an underscore counts as a space.
    """
    bare = F.regexp_replace(F.lower(value), _AROUND, "")
    return value.rlike(_NO_TEXT) | F.lower(F.trim(value)).isin(*PLACEHOLDERS) | F.regexp_replace(bare, r"[\s_]+", " ").isin(*PLACEHOLDERS)


def classify(df: DataFrame, rules: list[ColumnRule], keep: list[str]) -> DataFrame:
    """``keep``, column_name, value, class (null, placeholder, pattern, range, good), num, txt: one row per row and rule.

    num is the number of a good value of a numeric column, txt the text of a good value of a listed one.
    The accepted lists join without a hint: the optimizer broadcasts one only when its size is known to be small.
    """
    cells = F.array(*(F.struct(F.lit(r.name).alias("column_name"), F.col(r.name).cast("string").alias("value")) for r in rules))
    long = df.select(*keep, F.inline(cells))
    listed = [r for r in rules if not r.numeric]
    accepted = None
    for r in listed:
        one = r.accepted.select(F.lit(r.name).alias("column_name"), F.col(r.accepted.columns[0]).alias("value")).filter("value is not null").distinct()
        accepted = one if accepted is None else accepted.unionByName(one)
    if accepted is None:
        long = long.withColumn("__listed", F.lit(None).cast("boolean"))
    else:
        # nulls and values of other columns match nothing: their keys are spread, as equal ones would fill one partition of a shuffled join
        matters = F.col("column_name").isin(*(r.name for r in listed)) & F.col("value").isNotNull()
        spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*keep), F.lit(4096)).cast("string"))
        marked = accepted.select("column_name", F.col("value").alias("__key"), F.lit(True).alias("__listed"))
        long = long.withColumn("__key", F.when(matters, F.col("value")).otherwise(spread)).join(marked, ["column_name", "__key"], "left").drop("__key")
    num = F.col("value").try_cast("double")
    verdict = F.when(F.col("value").isNull(), "null").when(is_placeholder(F.col("value")), "placeholder")
    for r in rules:
        mine = F.col("column_name") == r.name
        if r.numeric:
            within = F.lit(True)
            if r.low is not None:
                within = within & (num >= r.low)
            if r.high is not None:
                within = within & (num <= r.high)
            verdict = verdict.when(mine & ~F.col("value").rlike(r.pattern), "pattern").when(mine & ~within, "range").when(mine, "good")
        else:
            verdict = verdict.when(mine & F.col("__listed").isNull(), "pattern").when(mine, "good")
    names = [r.name for r in rules if r.numeric]
    good_number = (F.col("class") == "good") & F.col("column_name").isin(*names) if names else F.lit(False)
    out = long.withColumn("class", verdict)
    return out.select(
        *keep, "column_name", "value", "class",
        F.when(good_number, num + F.lit(0.0)).alias("num"), F.when((F.col("class") == "good") & ~good_number, F.col("value")).alias("txt"),
    )


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge equal values of one sorted range partition and add running counts per (column, pair)."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    key, value, sums, held = None, None, np.zeros(2, dtype="int64"), None
    names = ["column_name", "pair", "num", "txt", "n_cur", "n_prev"]

    def walk(b: pd.DataFrame, last: bool) -> pd.DataFrame:
        """Running counts of complete values; the last value of a batch waits for the next batch."""
        nonlocal key, sums, held
        if held is not None:
            b = pd.concat([held, b], ignore_index=True)
        if b.empty:
            return b
        num, txt = b["num"].fillna(-np.inf), b["txt"].fillna("")
        new_group = (b["column_name"] != b["column_name"].shift()) | (b["pair"] != b["pair"].shift())
        value_id = (new_group | (num != num.shift()) | (txt != txt.shift())).cumsum()
        cut = len(b) if last else int((value_id < value_id.iloc[-1]).sum())
        held = None if last else b.iloc[cut:]
        b, value_id = b.iloc[:cut], value_id.iloc[:cut]
        if b.empty:
            return b
        g = b.groupby(value_id, sort=False)
        out = g[["column_name", "pair", "num", "txt"]].first()
        out[["n_cur", "n_prev"]] = g[["n_cur", "n_prev"]].sum()
        group = [out["column_name"], out["pair"]]
        run = out.groupby(group, sort=False)[["n_cur", "n_prev"]].cumsum().to_numpy()
        if key == (out["column_name"].iloc[0], out["pair"].iloc[0]):
            first = ((out["column_name"] == key[0]) & (out["pair"] == key[1])).to_numpy()
            run[first] += sums
        key, sums = (out["column_name"].iloc[-1], out["pair"].iloc[-1]), run[-1].copy()
        return out.assign(run_cur=run[:, 0], run_prev=run[:, 1], pid=pid)

    columns = [*names, "run_cur", "run_prev", "pid"]
    for b in batches:
        out = walk(b, False)
        if len(out):
            yield out[columns]
    out = walk(pd.DataFrame(columns=names).astype({"num": "float64", "n_cur": "int64", "n_prev": "int64", "pair": "int64"}), True)
    if len(out):
        yield out[columns]


def curves(good: DataFrame, loads: DataFrame, partitions: int | None = None) -> DataFrame:
    """Merged cumulative curves: column_name, pair, num, txt, n_cur, n_prev, cum_cur, cum_prev, all_cur, all_prev.

    good: load_id, column_name, num, txt, n (counted values); loads: load_id, next_id. ``pair`` is the
    load_id of the later load. The range-sorted values are written once, as the bounds of a range
    shuffle must not be drawn again between reading a partition's total and its values.
    """
    both = good.join(loads, "load_id").select(
        "column_name", "num", "txt",
        F.inline(F.array(F.struct(F.col("load_id").alias("pair"), F.col("n").alias("n_cur"), F.lit(0).cast("bigint").alias("n_prev")), F.struct(F.col("next_id").alias("pair"), F.lit(0).cast("bigint").alias("n_cur"), F.col("n").alias("n_prev")))),
    ).filter("pair is not null")
    order = ["column_name", "pair", "num", "txt"]
    n = partitions or int(good.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = both.select(*order, "n_cur", "n_prev").repartitionByRange(n, *order).sortWithinPartitions(*order)
    run = materialize(ranged.mapInPandas(_running, "column_name string, pair bigint, num double, txt string, n_cur bigint, n_prev bigint, run_cur bigint, run_prev bigint, pid int"))
    totals = run.groupBy("column_name", "pair", "pid").agg(F.max("run_cur").alias("t_cur"), F.max("run_prev").alias("t_prev"))
    before = Window.partitionBy("column_name", "pair").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("column_name", "pair")
    offsets = totals.select(
        "column_name", "pair", "pid",
        F.coalesce(F.sum("t_cur").over(before), F.lit(0)).alias("o_cur"), F.coalesce(F.sum("t_prev").over(before), F.lit(0)).alias("o_prev"),
        F.sum("t_cur").over(whole).alias("all_cur"), F.sum("t_prev").over(whole).alias("all_prev"),
    )
    return run.join(offsets, ["column_name", "pair", "pid"]).select(
        *order, "n_cur", "n_prev", (F.col("o_cur") + F.col("run_cur")).alias("cum_cur"), (F.col("o_prev") + F.col("run_prev")).alias("cum_prev"), "all_cur", "all_prev"
    )


def _at(side: str, rank: Column) -> Column:
    """The number at a rank (from 1) of one load's curve."""
    return F.min(F.when(F.col(f"cum_{side}") >= rank, F.col("num")))


def _median(side: str) -> Column:
    n = F.col(f"all_{side}")
    lower, upper = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    return (_at(side, lower) + _at(side, upper)) / 2


def compare_loads(good: DataFrame, loads: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per (column_name, pair): medians, quartiles, ranges, distinct counts, KS distance and largest change of one value's share."""
    c = curves(good, loads, partitions)
    share = F.abs(F.col("n_cur") * F.col("all_prev") - F.col("n_prev") * F.col("all_cur"))
    gap = F.abs(F.col("cum_cur") / F.col("all_cur") - F.col("cum_prev") / F.col("all_prev"))
    present = F.col("n_cur") > 0
    return c.groupBy("column_name", "pair").agg(
        F.first("all_cur").alias("n_good"), F.first("all_prev").alias("n_good_prev"),
        F.sum(present.cast("bigint")).alias("n_distinct"), F.sum((F.col("n_prev") > 0).cast("bigint")).alias("n_distinct_prev"),
        _median("cur").alias("median"), _median("prev").alias("median_prev"),
        _at("cur", F.ceil(F.col("all_cur") * 0.25)).alias("q1"), _at("cur", F.ceil(F.col("all_cur") * 0.75)).alias("q3"),
        F.min(F.when(present, F.col("num"))).alias("low"), F.max(F.when(present, F.col("num"))).alias("high"),
        F.max(F.when((F.col("all_cur") > 0) & (F.col("all_prev") > 0), gap)).alias("ks"),
        F.max(F.when(F.col("txt").isNotNull(), share)).alias("share_change"),
    )


def load_order(df: DataFrame) -> DataFrame:
    """mirror, load_no, load_id, prev_id, next_id: each load with the mirror's loads numbered one lower and one higher."""
    loads = df.select("mirror", "load_no", "load_id").filter("load_id is not null").distinct()
    near = loads.filter("mirror is not null and load_no is not null").groupBy("mirror", "load_no").agg(F.min("load_id").alias("id"))
    prev = near.select("mirror", (F.col("load_no") + 1).alias("load_no"), F.col("id").alias("prev_id"))
    nxt = near.select("mirror", (F.col("load_no") - 1).alias("load_no"), F.col("id").alias("next_id"))
    return loads.join(prev, ["mirror", "load_no"], "left").join(nxt, ["mirror", "load_no"], "left")


def profile(df: DataFrame, rules: list[ColumnRule], partitions: int | None = None) -> DataFrame:
    """One row per load and column: counts by class, shares, distribution, and the previous load's figures beside them.

    df has mirror, load_no, load_id and the columns of the rules; other columns are ignored. All delivered
    rows count, repeated ones too. A load without good values has null statistics; the first load of a
    mirror has null previous figures. An empty table gives no rows.
    """
    keep = ["mirror", "load_no", "load_id"]
    classified = classify(df.filter("load_id is not null"), rules, keep)
    counted = materialize(classified.groupBy("load_id", "column_name", "class", "num", "txt").agg(F.count(F.lit(1)).alias("n")))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("class") == k, F.col("n"))), F.lit(0))
    classes = counted.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("n_rows"), of("null").alias("n_null"), of("placeholder").alias("n_placeholder"), of("pattern").alias("n_pattern"), of("range").alias("n_range")
    )
    order = load_order(df)
    cmp = compare_loads(counted.filter("class = 'good'").select("load_id", "column_name", "num", "txt", "n"), order.select("load_id", "next_id"), partitions)
    cmp = cmp.withColumnRenamed("pair", "load_id")
    prev = classes.select(F.col("load_id").alias("prev_id"), "column_name", F.col("n_rows").alias("n_rows_prev"), (F.col("n_null") + F.col("n_placeholder")).alias("n_missing_prev"))
    return (
        classes.join(order, "load_id").join(prev, ["prev_id", "column_name"], "left").join(cmp, ["load_id", "column_name"], "left")
        .select(
            "mirror", "load_no", "load_id", "prev_id", "column_name", "n_rows", "n_null", "n_placeholder", "n_pattern", "n_range", "n_rows_prev", "n_missing_prev",
            F.coalesce("n_good", F.lit(0)).alias("n_good"), F.when(F.col("prev_id").isNotNull(), F.coalesce("n_good_prev", F.lit(0))).alias("n_good_prev"),
            F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), F.when(F.col("prev_id").isNotNull(), F.coalesce("n_distinct_prev", F.lit(0))).alias("n_distinct_prev"),
            "median", "median_prev", "q1", "q3", "low", "high", "ks", "share_change",
        )
    )


def load_findings(profiled: DataFrame, missing: float = 0.2, shift: float = 1.5, share: float = 0.25, distinct: float = 4.0) -> DataFrame:
    """load_id, column_name, finding, row_id = 0 for the loads that differ from the previous one.

    Shares are compared without rounding errors of their own (products of counts); a load without good
    values, or after one, has no shift and no distinct finding, as there is nothing to compare.
    """
    n, m = F.col("n_rows"), F.col("n_rows_prev")
    part = F.abs((F.col("n_null") + F.col("n_placeholder")) * m - F.col("n_missing_prev") * n)
    eps = 1e-9
    both = (F.col("n_good") > 0) & (F.col("n_good_prev") > 0)
    a, b = F.col("median"), F.col("median_prev")
    moved = (a != b) & ((F.abs(a) >= shift * F.abs(b) - eps) | (F.abs(b) >= shift * F.abs(a) - eps))
    tilted = F.col("share_change") >= (share - eps) * F.col("n_good") * F.col("n_good_prev")
    d, e = F.col("n_distinct"), F.col("n_distinct_prev")
    found = F.array_compact(
        F.array(
            F.when(part >= (missing - eps) * n * m, "missing"),
            F.when(both & (F.coalesce(moved, F.lit(False)) | F.coalesce(tilted, F.lit(False))), "shift"),
            F.when(both & (d != e) & ((d >= distinct * e) | (e >= distinct * d)), "distinct"),
        )
    )
    return profiled.filter("prev_id is not null").select("load_id", "column_name", F.explode(found).alias("finding"), F.lit(0).cast("bigint").alias("row_id"))


def row_findings(df: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """load_id, column_name, finding, row_id for every row whose value is a placeholder, of the wrong form or out of range."""
    return classify(df, rules, ["load_id", "row_id"]).filter("class in ('placeholder', 'pattern', 'range')").select("load_id", "column_name", F.col("class").alias("finding"), "row_id")
