"""Bytes of the container: integers, records, headers, blobs. Every reader here refuses what it cannot trust."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard

# fixed values: record types of the format
HEADER, BATCH_BEGIN, BODY, MANIFEST, INDEX = 0x01, 0x02, 0x03, 0x04, 0x05
ENTRY, SCHEMA, TOOLING, WITHDRAW, REINSTATE = 0x10, 0x11, 0x12, 0x15, 0x16
RAW, ZSTD = 0, 1
BLOB_ELEMENTS, ELEMENT, CHUNK = 4096, 32, 31
BLOB_SIZE, BLOB_DATA = BLOB_ELEMENTS * ELEMENT, BLOB_ELEMENTS * CHUNK
ZSTD_LEVEL = 19
MAX_MANIFEST = 64 * 1024 * 1024
_BEGIN = struct.Struct(">QQ32sBQQ32s")
_U64 = struct.Struct(">Q")


class Malformed(ValueError):
    """The bytes break a rule of the format."""


class Truncated(Malformed):
    """The bytes end too early."""


def uvarint(n: int) -> bytes:
    """Minimal LEB128 of an unsigned 64-bit integer."""
    if not 0 <= n < 1 << 64:
        raise ValueError("not an unsigned 64-bit integer")
    groups = [n >> s & 0x7F for s in range(0, max(n.bit_length(), 1), 7)]
    return bytes([g | 0x80 for g in groups[:-1]] + groups[-1:])


def read_uvarint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The integer at a place and the place after it."""
    value = 0
    for k in range(10):
        if at + k >= len(data):
            raise Truncated("an integer is cut off")
        b = data[at + k]
        value |= (b & 0x7F) << (7 * k)
        if b < 0x80:
            if k and not b:
                raise Malformed("an integer is longer than needed")
            if value >= 1 << 64:
                raise Malformed("an integer exceeds 64 bits")
            return value, at + k + 1
    raise Malformed("an integer is longer than ten bytes")


def record(kind: int, payload: bytes) -> bytes:
    """A record: length of what follows, type, payload."""
    return uvarint(len(payload) + 1) + bytes([kind]) + payload


def read_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, payload) of the records that fill ``data`` exactly."""
    at = 0
    while at < len(data):
        n, at = read_uvarint(data, at)
        if n < 1:
            raise Malformed("a record has no type")
        if at + n > len(data):
            raise Truncated("a record is cut off")
        yield data[at], data[at + 1 : at + n]
        at += n


def compress(data: bytes, codec: int) -> bytes:
    if codec == RAW:
        return data
    if codec == ZSTD:
        return zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress(data)
    raise Malformed(f"unknown codec {codec}")


def decompress(data: bytes, codec: int, length: int | None = None, limit: int = 1 << 40) -> bytes:
    """The decoded bytes, never more than the declared length (or ``limit``)."""
    if codec == RAW:
        out = data
    elif codec == ZSTD:
        most = limit if length is None else length
        parts, size = [], 0
        try:
            with zstandard.ZstdDecompressor().stream_reader(data) as r:
                while chunk := r.read(1 << 20):
                    size += len(chunk)
                    if size > most:
                        raise Malformed("the content is longer than declared")
                    parts.append(chunk)
        except zstandard.ZstdError as e:
            raise Malformed(f"the content cannot be decoded: {e}") from None
        out = b"".join(parts)
    else:
        raise Malformed(f"unknown codec {codec}")
    if length is not None and len(out) != length:
        raise Malformed("the content's length is not the declared one")
    return out


@dataclass(frozen=True)
class Format:
    """What a stream says of itself: magic, dataset and the deployment it belongs to."""

    magic: bytes = b"STRANDLOG-BATCH"
    schema_id: str = "records"
    chain_id: int = 0
    contract: bytes = bytes(20)
    major: int = 1
    minor: int = 0

    def header(self) -> bytes:
        name = self.schema_id.encode()
        return self.magic + bytes([self.major, self.minor]) + _U64.pack(self.chain_id) + self.contract + uvarint(len(name)) + name

    def read_header(self, payload: bytes) -> Format:
        """The header of a stream with this magic and major version; any minor version is accepted."""
        n = len(self.magic)
        if payload[:n] != self.magic:
            raise Malformed("another magic")
        if len(payload) < n + 30:
            raise Truncated("the header is cut off")
        if payload[n] != self.major:
            raise Malformed(f"major version {payload[n]}")
        length, at = read_uvarint(payload, n + 30)
        if at + length != len(payload):
            raise Malformed("the header's length is wrong")
        return Format(self.magic, payload[at:].decode(), _U64.unpack(payload[n + 2 : n + 10])[0], payload[n + 10 : n + 30], payload[n], payload[n + 1])


@dataclass(frozen=True)
class BatchBegin:
    """The first record of a batch."""

    batch: int
    first_blob: int
    previous: bytes
    codec: int
    raw_length: int
    body_length: int
    body_digest: bytes

    def pack(self) -> bytes:
        return _BEGIN.pack(self.batch, self.first_blob, self.previous, self.codec, self.raw_length, self.body_length, self.body_digest)

    @classmethod
    def unpack(cls, payload: bytes) -> BatchBegin:
        if len(payload) != _BEGIN.size:
            raise Malformed("a batch begins with a record of another size")
        return cls(*_BEGIN.unpack(payload))


def pack_tooling(path: str, content: bytes) -> bytes:
    name = path.encode()
    return uvarint(len(name)) + name + content


def unpack_tooling(payload: bytes) -> tuple[str, bytes]:
    n, at = read_uvarint(payload)
    if at + n > len(payload):
        raise Truncated("a path is cut off")
    return payload[at : at + n].decode(), payload[at + n :]


def pack_blobs(data: bytes) -> list[bytes]:
    """Blobs of 4,096 elements, each a zero byte and 31 bytes of the stream; the rest of the last blob is zero."""
    if not data:
        raise ValueError("an empty stream has no blobs")
    n = -(-len(data) // BLOB_DATA)
    flat = np.zeros(n * BLOB_DATA, dtype=np.uint8)
    flat[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    elements = np.zeros((n, BLOB_ELEMENTS, ELEMENT), dtype=np.uint8)
    elements[:, :, 1:] = flat.reshape(n, BLOB_ELEMENTS, CHUNK)
    return [e.tobytes() for e in elements]


def unpack_blob(blob: bytes) -> bytes:
    """The stream bytes of a blob; refuses another size and elements whose first byte is not zero."""
    if len(blob) != BLOB_SIZE:
        raise Malformed("a blob has another size")
    elements = np.frombuffer(blob, dtype=np.uint8).reshape(BLOB_ELEMENTS, ELEMENT)
    if elements[:, 0].any():
        raise Malformed("an element is too large")
    return elements[:, 1:].tobytes()


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()
