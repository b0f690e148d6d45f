"""Reports of a run as JSON, and the snapshot folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from strandlog.sources.files import Folder


def recovery_report(structure, compared: DataFrame, withdrawn: DataFrame, missing: DataFrame, tooling: DataFrame, attempts: list[dict] | None = None) -> dict:
    """What a rebuild found: header, batches with their places, torn ranges, tooling files, comparison with the last manifest per group, pieces not found.

    structure: a walked :class:`strandlog.sources.container.Structure`; compared (group, status) has a row per group;
    tooling (path, size, sha256) a row per file; of withdrawn keys and missing pieces only counts come to the driver.
    """
    rows = {r[0]: r["status"] for r in compared.collect()}
    header = structure.header
    return {
        "header": None if header is None else {"magic": header.magic.decode("ascii", "replace"), "schemaId": header.schema_id, "version": f"{header.major}.{header.minor}", "chainId": header.chain_id, "contract": header.contract.hex()},
        "batches": [{"batch": b.begin.batch, "firstBlob": b.begin.first_blob, "blobCountAfter": b.blob_count_after, "compressedBytes": b.begin.body_length, "rawBytes": b.begin.raw_length, "hasIndex": bool(b.index_length), "manifestDigest": b.manifest_digest.hex()} for b in structure.batches],
        "torn": [{"expectedBatch": t.expected_batch, "firstBlob": t.first_blob, "lastBlob": t.last_blob, "reason": t.reason} for t in structure.torn],
        "deadBlobs": sorted(structure.dead), "tooling": [r.asDict() for r in tooling.orderBy("path").collect()],
        "groups": rows, "allMatch": all(s == "match" for s in rows.values()), "withdrawn": withdrawn.count(), "missing": missing.count(), "attempts": attempts or [],
    }


def upload_report(stats: DataFrame, withdrawn: int, reinstated: int, outcome: str, seconds: float) -> dict:
    """What a run published; stats has a row per group."""
    return {"groups": [r.asDict() for r in stats.orderBy(stats.columns[0]).collect()], "withdrawn": withdrawn, "reinstated": reinstated, "outcome": outcome, "seconds": round(seconds, 3)}


def to_json(report: dict) -> bytes:
    return (json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()


def snapshot(lines: DataFrame, group: str, order: list[str], payload: str, path: str, digests: DataFrame, compression: str = "gzip") -> dict:
    """One compressed text file per group under ``path`` and a manifest of their digests and counts beside them."""
    from strandlog.operators.digest import write_groups

    folder = Folder(lines.sparkSession, path)
    write_groups(lines, group, order, payload, folder.at("groups"), compression=compression)
    listed = {r[group]: {"sha256": r["sha256"], "lines": r["n_lines"]} for r in digests.collect()}
    folder.put("manifest.json", to_json({"groups": listed}))
    return listed
