"""Deeply nested JSON records as related flat tables that keep parent-child links.

Nested ``transform`` calls walk each document once, attaching the keys and indices of all ancestors to
every descendant; ``flatten`` brings the arrays of one level together, and one ``inline`` per target
table emits its rows. Everything stays in the JVM, and after the delivery of each file is chosen there
is no shuffle.

Defined results: a document that is null, blank, no valid JSON or holds no record gives no row; of a
file delivered several times the last valid delivery counts (ties: the greater text); a gene
collection that is absent, null or of another shape gives no child; an absent or null accession is
the empty string; further columns of the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: where records stand, in reading order
RECORD_PLACES = ("$.samples[].input", "$.input.entries[]", "$.input.batches[].entries[]")
#: gene collections: name -> (value key when written as an array of objects, whether values are lists)
GENE_COLLECTIONS = {"alignedAminoAcidSequences": ("sequence", False), "aminoAcidInsertions": ("insertions", True)}


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _items(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def parse_documents(files: DataFrame, file_id: str = "file_id", doc: str = "doc", received_at: str = "received_at") -> DataFrame:
    """(file_id, doc variant): each file once, broken documents dropped.

    The text is parsed inside a one-element array, so that anything after the document makes it
    invalid instead of being ignored. A document with a repeated key is not accepted.
    """
    v = files.select(F.col(file_id).alias("file_id"), F.col(received_at).alias("r"), F.col(doc).alias("d")).filter("file_id is not null and d is not null")
    once = v.groupBy("file_id").agg(F.max_by("d", F.struct(F.try_parse_json("d").isNotNull(), "r", "d")).alias("d"))
    parsed = once.select("file_id", F.try_parse_json(F.concat(F.lit("["), "d", F.lit("]"))).alias("v"))
    array = parsed.select("file_id", _get(F.col("v"), "$", "array<variant>").alias("a"))
    return array.filter("size(a) = 1").select("file_id", F.col("a")[0].alias("doc"))


def with_records(docs: DataFrame) -> DataFrame:
    """(file_id, records): the record objects of each document, in reading order, numbered from 0."""
    d = F.col("doc")
    samples = F.transform(_items(d, "$.samples"), lambda s: _get(s, "$.input", "variant"))
    entries = _items(d, "$.input.entries")
    batches = F.flatten(F.transform(_items(d, "$.input.batches"), lambda b: _items(b, "$.entries")))
    held = docs.select("file_id", F.filter(F.concat(samples, entries, batches), lambda r: _get(r, "$.metadata", "variant").isNotNull()).alias("held"))
    numbered = F.transform(
        "held",
        lambda r, i: F.struct(i.cast("bigint").alias("entry_pos"), F.coalesce(_get(r, "$.metadata.accession", "string"), F.lit("")).alias("accession"), r.alias("record")),
    )
    return held.select("file_id", numbered.alias("records"))


def _genes(record: Column, collection: str) -> Column:
    """array<struct<gene, value variant>> of a collection written as an object or as an array of objects."""
    key, _ = GENE_COLLECTIONS[collection]
    as_object = F.transform(F.map_entries(_get(record, f"$.{collection}", "map<string,variant>")), lambda e: F.struct(e["key"].alias("gene"), e["value"].alias("value")))
    as_array = F.transform(_get(record, f"$.{collection}", "array<variant>"), lambda o: F.struct(_get(o, "$.gene", "string").alias("gene"), _get(o, f"$.{key}", "variant").alias("value")))
    empty = F.array().cast("array<struct<gene:string,value:variant>>")
    return F.filter(F.coalesce(as_object, as_array, empty), lambda g: g["gene"].isNotNull())


def _children(collection: str) -> Column:
    """array<struct<entry_pos, accession, child, gene, item_pos, value>> over all records of a document."""
    _, is_list = GENE_COLLECTIONS[collection]

    def row(r: Column, g: Column, pos: Column, value: Column) -> Column:
        return F.struct(
            r["entry_pos"].alias("entry_pos"), r["accession"].alias("accession"), F.lit(collection).alias("child"), g["gene"].alias("gene"), pos.cast("bigint").alias("item_pos"), value.alias("value")
        )

    def of_gene(r: Column, g: Column) -> Column:
        if is_list:
            return F.transform(_items(g["value"], "$"), lambda x, k: row(r, g, k, _get(x, "$", "string")))
        return F.array(row(r, g, F.lit(0), _get(g["value"], "$", "string")))

    per_record = F.transform("records", lambda r: F.flatten(F.transform(_genes(r["record"], collection), lambda g: of_gene(r, g))))
    return F.filter(F.flatten(per_record), lambda c: c["value"].isNotNull())


def record_table(files: DataFrame) -> DataFrame:
    """file_id, entry_pos, accession, version, organism: one row per record."""
    rows = F.transform(
        "records",
        lambda r: F.struct(
            r["entry_pos"].alias("entry_pos"), r["accession"].alias("accession"), _get(r["record"], "$.metadata.version", "bigint").alias("version"), _get(r["record"], "$.organism", "string").alias("organism")
        ),
    )
    return with_records(parse_documents(files)).select("file_id", F.inline(rows))


def child_table(files: DataFrame, collection: str) -> DataFrame:
    """file_id, entry_pos, accession, child, gene, item_pos, value: one row per sequence or insertion."""
    return with_records(parse_documents(files)).select("file_id", F.inline(_children(collection)))


def all_children(files: DataFrame) -> DataFrame:
    """Both gene collections in one pass over the documents; columns as of :func:`child_table`."""
    both = F.concat(*(_children(c) for c in GENE_COLLECTIONS))
    return with_records(parse_documents(files)).select("file_id", F.inline(both))
