"""What a run adds, withdraws and reinstates so that the visible record equals the eligible feed.

All sets are semi and anti joins on the key; duplicates of a key in an input count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_entries(eligible: DataFrame, published: DataFrame, key: list[str]) -> DataFrame:
    """Eligible keys never published. Content of a published key never changes, so later edits are not new."""
    return eligible.select(*key).distinct().join(published.select(*key), key, "left_anti")


def already_published(eligible: DataFrame, published: DataFrame, key: list[str]) -> DataFrame:
    """Eligible keys that are in the log, withdrawn or not."""
    return eligible.select(*key).distinct().join(published.select(*key), key, "left_semi")


def to_withdraw(published: DataFrame, withdrawn: DataFrame, eligible: DataFrame, key: list[str]) -> DataFrame:
    """Published keys that are visible and no longer eligible, those of groups that are not served any more included."""
    return published.select(*key).distinct().join(withdrawn.select(*key), key, "left_anti").join(eligible.select(*key), key, "left_anti")


def to_reinstate(withdrawn: DataFrame, eligible: DataFrame, key: list[str]) -> DataFrame:
    """Withdrawn keys that are eligible again; one that was never published is then also new."""
    return withdrawn.select(*key).distinct().join(eligible.select(*key), key, "left_semi")


def unserved_groups(published: DataFrame, served: DataFrame, group: str = "organism") -> DataFrame:
    """Groups with published entries that the feed does not serve."""
    return published.select(group).distinct().join(served.select(group).distinct(), group, "left_anti")


def change_lists(keys: DataFrame, group: str = "organism") -> DataFrame:
    """One row per group with the sorted, distinct texts of its keys, sorted as texts (A.10 before A.2).

    The list is the payload of one record of the log and as large as that record.
    """
    return keys.groupBy(group).agg(F.array_sort(F.collect_set(F.concat_ws(".", "accession", F.col("version").cast("string")))).alias("accession_versions"))


def apply_changes(visible: DataFrame, new: DataFrame, withdraw: DataFrame, reinstate: DataFrame, key: list[str]) -> DataFrame:
    """The visible keys after a batch with these changes."""
    added = new.select(*key).unionByName(reinstate.select(*key))
    return visible.select(*key).unionByName(added).distinct().join(withdraw.select(*key), key, "left_anti")
