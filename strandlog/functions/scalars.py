"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOB_ELEMENTS, CHUNK = 4096, 31
BLOB_BYTES = BLOB_ELEMENTS * CHUNK


def sha256_hex(x: Column) -> Column:
    """SHA-256 as 64 hexadecimal digits."""
    return F.sha2(x, 256)


def to_hex(x: Column) -> Column:
    """0x and lower-case hexadecimal digits of bytes."""
    return F.concat(F.lit("0x"), F.lower(F.hex(x)))


def from_hex(x: Column) -> Column:
    """Bytes of a text with or without 0x; null for anything that is not hexadecimal."""
    return F.unhex(F.regexp_replace(x, "^0x", ""))


def safe_dirname(name: Column) -> Column:
    """A name that cannot leave a folder: other characters than [A-Za-z0-9._-] become % and the hexadecimal code point, at least
    two digits; the empty name, . and .. and names with a leading - get an underscore in front."""
    code = lambda c: F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), F.greatest(F.length(F.hex(F.ascii(c))), F.lit(2)), F.lit("0")))
    each = F.transform(F.split(name, ""), lambda c: F.when(c == "", "").when(c.rlike("^[A-Za-z0-9._-]$"), c).otherwise(code(c)))
    body = F.array_join(each, "")
    return F.when(name.isin("", ".", "..") | name.startswith("-"), F.concat(F.lit("_"), body)).otherwise(body)


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def human_size(n: Column) -> Column:
    """Bytes in decimal units, rounded half up; the unit is chosen after rounding: 1 byte, 999 bytes, 1 kB, 1 MB, 1.0 GB."""
    kb, mb, tenth = _half_up(n / 1e3), _half_up(n / 1e6), _half_up(n / 1e8)
    gb = F.concat(F.floor(tenth / 10).cast("string"), F.lit("."), F.pmod(tenth, F.lit(10)).cast("string"), F.lit(" GB"))
    return (
        F.when(n == 1, "1 byte").when(n < 1000, F.concat(n.cast("string"), F.lit(" bytes"))).when(kb < 1000, F.concat(kb.cast("string"), F.lit(" kB")))
        .when(mb < 1000, F.concat(mb.cast("string"), F.lit(" MB"))).otherwise(gb)
    )


def human_duration(seconds: Column) -> Column:
    """Seconds below two minutes, minutes below two hours, then hours and minutes; negative spans count as 0."""
    s = F.greatest(_half_up(seconds), F.lit(0).cast("bigint"))
    minutes = _half_up(s / 60)
    return (
        F.when(s < 120, F.concat(s.cast("string"), F.lit(" s"))).when(minutes < 120, F.concat(minutes.cast("string"), F.lit(" min")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), F.pmod(minutes, F.lit(60)).cast("string"), F.lit(" min")))
    )


def relative_age(seconds: Column) -> Column:
    """s below 90 s, min below 5,400 s, h below 172,800 s, then days, rounded half up; a dash for null."""
    unit = lambda d, name: F.concat(_half_up(seconds / d).cast("string"), F.lit(name))
    return F.when(seconds.isNull(), "–").when(seconds < 90, unit(1, " s")).when(seconds < 5400, unit(60, " min")).when(seconds < 172_800, unit(3600, " h")).otherwise(unit(86_400, " days"))


def public_url(url: Column) -> Column:
    """Scheme and host of a URL, with the port unless it is the scheme's own; user, path, query and key are left out. Null if it is no URL."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:@]+:([0-9]+)", 1)
    own = (port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    base = F.concat(scheme, F.lit("://"), host)
    return F.when(host != "", F.when(own, base).otherwise(F.concat(base, F.lit(":"), port)))


def redact(text: Column, endpoints: list[str], public: list[str]) -> Column:
    """A text with every endpoint replaced by its public form, the longest first."""
    for full, short in sorted(zip(endpoints, public, strict=True), key=lambda p: -len(p[0])):
        text = F.replace(text, F.lit(full), F.lit(short))
    return text


def slot_of(ts: Column, genesis: int, seconds: int = 12) -> Column:
    """The slot of an epoch second; null for null."""
    return F.floor((ts - genesis) / seconds)


def iso_day(ts: Column) -> Column:
    """The UTC day of an epoch second, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / 86_400).cast("int")).cast("string")


def estimated_seconds(transactions: Column, slot: int = 12) -> Column:
    """One slot per transaction and two and a half epochs of 32 slots to finality."""
    return transactions * slot + int(2.5 * 32 * slot)


def blobs_needed(stream_bytes: Column) -> Column:
    """How many blobs a stream of so many bytes fills; an empty stream raises."""
    return F.when(stream_bytes <= 0, F.raise_error(F.lit("an empty stream has no blobs"))).otherwise(F.ceil(stream_bytes / BLOB_BYTES))


def last_chunk_count(stream_bytes: Column) -> Column:
    """How many elements of the last blob carry data."""
    chunks = F.ceil(stream_bytes / CHUNK)
    return chunks - (F.ceil(chunks / BLOB_ELEMENTS) - 1) * BLOB_ELEMENTS


def chunk_place(chunk: Column) -> tuple[Column, Column]:
    """The blob and the element of a chunk of the stream."""
    return F.floor(chunk / BLOB_ELEMENTS), F.pmod(chunk, F.lit(BLOB_ELEMENTS))


def b32_lower(data: bytes) -> str:
    """Base 32 in lower case without padding."""
    return base64.b32encode(data).decode().lower().rstrip("=")


def b32_decode(text: str) -> bytes:
    """The bytes of :func:`b32_lower`."""
    return base64.b32decode(text.upper() + "=" * (-len(text) % 8))


def content_id(digest: bytes, codec: int = 0x55) -> str:
    """A version 1 content identifier of a SHA-256 digest: multibase b, version, codec, hash function 0x12, length."""
    return "b" + b32_lower(bytes([1, codec, 0x12, len(digest)]) + digest)


def content_id_udf(codec: int = 0x55):
    """UDF bytes -> content identifier of their SHA-256."""

    @F.pandas_udf(T.StringType())
    def cid(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else content_id(hashlib.sha256(b).digest(), codec))

    return cid
