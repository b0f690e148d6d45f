"""Shapes of the tables a versioned log is made of, and the columns that name a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: what names a published record
KEY = ["organism", "accession", "version"]
SEQUENCES = T.MapType(T.StringType(), T.StringType(), True)
INSERTIONS = T.MapType(T.StringType(), T.ArrayType(T.StringType()), True)

#: the six keys of a released line; ``metadata`` stays open, as its fields differ by organism
LINE_KEYS = ("alignedAminoAcidSequences", "alignedNucleotideSequences", "aminoAcidInsertions", "metadata", "nucleotideInsertions", "unalignedNucleotideSequences")
#: metadata fields that every released line has
REQUIRED_FIELDS = ("accession", "version", "accessionVersion", "dataUseTerms")
#: metadata fields that are not published
DROPPED_FIELDS = ("versionStatus", "dataUseTerms", "dataUseTermsRestrictedUntil", "dataUseTermsUrl")

ENTRIES = T.StructType(
    [
        T.StructField("batch", T.LongType()), T.StructField("ordinal", T.LongType()), T.StructField("organism", T.StringType()), T.StructField("accession", T.StringType()), T.StructField("version", T.LongType()),
        T.StructField("metadata", SEQUENCES), T.StructField("unalignednucleotidesequences", SEQUENCES), T.StructField("alignednucleotidesequences", SEQUENCES),
        T.StructField("nucleotideinsertions", INSERTIONS), T.StructField("alignedaminoacidsequences", SEQUENCES), T.StructField("aminoacidinsertions", INSERTIONS),
    ]
)
TOMBSTONES = T.StructType(
    [T.StructField("batch", T.LongType()), T.StructField("organism", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("accessionversions", T.ArrayType(T.StringType())), T.StructField("note", T.StringType())]
)


def accession_version(accession: str = "accession", version: str = "version") -> Column:
    """``<accession>.<version>``."""
    return F.concat_ws(".", F.col(accession), F.col(version).cast("string"))


def split_accession(text: Column) -> Column:
    """The part before the last dot; null without a dot."""
    part = F.regexp_extract(text, r"(?s)^(.*)\.([^.]*)$", 1)
    return F.when(F.instr(text, ".") > 0, part)


def split_version(text: Column) -> Column:
    """The digits after the last dot as a number (01 is 1); null if there is anything else."""
    digits = F.regexp_extract(text, r"\.([0-9]+)$", 1)
    return F.when(digits != "", digits).try_cast("bigint")
