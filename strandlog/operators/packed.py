"""Several values packed into one field: one row per value, with its position."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.functions.tokenizer import split_packed


def packed_values(kind: str):
    """An Arrow-batched UDF string -> array<string> that runs the tokenizer; only this column crosses to Python."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokenize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([split_packed(t, kind) for t in texts], dtype=object)

    return tokenize


def explode_packed(df: DataFrame, field: str | Column, kind: str, keep: list[str], pos: str = "pos", item: str = "item") -> DataFrame:
    """``keep`` columns with one row per value of ``field``: its position from 0 and its text.

    A null or blank field gives no row; a field with one value gives one. Repeated rows are kept, each
    with its own values. Columns named like ``pos`` or ``item`` in the input are not carried unless
    named in ``keep``, where a clash raises. The plan has no shuffle.
    """
    clash = {pos, item} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would appear twice")
    column = F.col(f"`{field}`") if isinstance(field, str) else field
    picked = df.select(*(F.col(f"`{c}`") for c in keep), column.alias("__packed")).filter("__packed is not null")
    return picked.select(*(F.col(f"`{c}`") for c in keep), F.posexplode(packed_values(kind)("__packed")).alias(pos, item))
