"""From released lines to classified candidates: shape checks, selection, projection and counts.

Column pruning and filters stay with the optimizer; the checks that guard against loss of data are plain
boolean columns, which :func:`require` turns into a failing job before anything is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandlog.schema import DROPPED_FIELDS, LINE_KEYS, REQUIRED_FIELDS

OPEN = "OPEN"


def json_keys(text: Column) -> Column:
    """The sorted keys of a JSON object; null for anything else."""
    return F.array_sort(F.json_object_keys(text))


def line_shape(line: Column) -> Column:
    """Why a released line is refused: 'keys', 'metadata' or 'identity'; null if its shape is right.

    A line needs exactly the six keys, its metadata the required fields, and accessionVersion must be
    accession and version joined by a dot. Null and broken lines are refused for their keys.
    """
    v = F.try_parse_json(line)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    keys = F.coalesce(json_keys(line) == F.array(*(F.lit(k) for k in sorted(LINE_KEYS))), F.lit(False))
    fields = [get(f"$.metadata.{f}", "variant").isNotNull() for f in REQUIRED_FIELDS]
    has_fields = fields[0] & fields[1] & fields[2] & fields[3]
    whole = F.schema_of_variant(get("$.metadata.version", "variant")).isin("BIGINT")
    identity = F.coalesce(F.concat_ws(".", get("$.metadata.accession", "string"), get("$.metadata.version", "string")) == get("$.metadata.accessionVersion", "string"), F.lit(False))
    return F.when(~keys, "keys").when(~F.coalesce(has_fields, F.lit(False)), "metadata").when(~(F.coalesce(whole, F.lit(False)) & identity), "identity")


def read_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The input's columns with accession, version, terms and submitted_at (epoch seconds) read from each well-shaped line."""
    v = F.try_parse_json(F.col(line))
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    good = lines.filter(line_shape(F.col(line)).isNull())
    return good.select(
        *(c for c in lines.columns if c != line), get("$.metadata.accession", "string").alias("accession"), get("$.metadata.version", "bigint").alias("version"),
        get("$.metadata.dataUseTerms", "string").alias("terms"), get("$.metadata.submittedAtTimestamp", "bigint").alias("submitted_at"),
    )


def nonblank_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of a text scan without the empty ones."""
    return lines.filter(F.col(column) != "")


def is_open(terms: Column) -> Column:
    """Exactly the open terms; null and other spellings are not eligible."""
    return terms.eqNullSafe(F.lit(OPEN))


def old_enough(submitted_at: Column, cutoff: int) -> Column:
    """Submitted at or before the cutoff, one clock reading per run. A missing time raises, as a wrong guess would publish."""
    return F.when(submitted_at.isNull(), F.raise_error(F.lit("an open record has no time of submission"))).otherwise(submitted_at <= F.lit(cutoff))


def classify(feed: DataFrame, published: DataFrame, key: list[str], cutoff: int) -> DataFrame:
    """The feed with ``class``: restricted, held_back, already_published or new. feed has terms and submitted_at.

    The time is looked at only for open rows. Published counts whether or not withdrawn since.
    """
    known = published.select(*key).distinct().withColumn("__known", F.lit(True))
    joined = feed.join(known, key, "left")
    verdict = (
        F.when(~is_open(F.col("terms")), "restricted").when(~old_enough(F.col("submitted_at"), cutoff), "held_back").when(F.col("__known").isNotNull(), "already_published").otherwise("new")
    )
    return joined.withColumn("class", verdict).drop("__known")


def sync_stats(classified: DataFrame, by: str) -> DataFrame:
    """Per group: total, open, restricted, held_back, already_published, new."""
    of = lambda *k: F.count_if(F.col("class").isin(*k))
    return classified.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), of("held_back", "already_published", "new").alias("open"), of("restricted").alias("restricted"), of("held_back").alias("held_back"),
        of("already_published").alias("already_published"), of("new").alias("new"),
    )


def published_metadata(metadata: Column) -> Column:
    """The metadata without the fields that are not published."""
    return F.map_filter(metadata, lambda k, _: ~k.isin(*DROPPED_FIELDS))


def entry_problem(organism: Column, accession: Column, version: Column, accession_version: Column) -> Column:
    """Why an entry must not be written: a missing organism or accession, a version below 1, or an identity that differs."""
    empty = lambda c: c.isNull() | (c == "")
    return (
        F.when(empty(organism), "organism").when(empty(accession), "accession").when(version.isNull() | (version < 1), "version")
        .when(~F.concat_ws(".", accession, version.cast("string")).eqNullSafe(accession_version), "identity")
    )


def incomplete(files: DataFrame, lines: DataFrame, file: str = "file_id") -> DataFrame:
    """Files whose number of lines differs from the declared total: file, total, n_lines. An unknown total is not checked.

    A short feed would withdraw what it lacks, so this must be empty before anything is written.
    """
    counted = lines.groupBy(file).agg(F.count(F.lit(1)).alias("n_lines"))
    joined = files.select(file, "total").filter("total is not null").join(counted, file, "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    return joined.filter("total != n_lines").select(file, "total", "n_lines")


def require_empty(problems: DataFrame, what: str) -> None:
    """Fail if there is any problem row; names up to ten of them."""
    some = problems.limit(10).collect()
    if some:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in some))


def observed(classified: DataFrame, name: str = "sync") -> tuple[DataFrame, Observation]:
    """The rows unchanged, and counters that fill while a job runs over them: total, new, held_back."""
    watch = Observation(name)
    return classified.observe(watch, F.count(F.lit(1)).alias("total"), F.count_if(F.col("class") == "new").alias("new"), F.count_if(F.col("class") == "held_back").alias("held_back")), watch
