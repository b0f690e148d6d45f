"""What archives and gateways answer, read into pieces: one reader per shape, without any network.

A caller passes ``get``, a function from a URL to a :class:`Response`; the sources here turn wanted names into
URLs, read the answers and tell apart a piece that is absent, one that is there but empty, and a request that failed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

#: seconds waited for a throttling server that names none, and at most
USUAL_WAIT, LONGEST_WAIT = 5.0, 60.0


@dataclass(frozen=True)
class Response:
    status: int
    body: bytes = b""
    headers: Mapping[str, str] = field(default_factory=dict)


Get = Callable[[str], Response]


class Failed(OSError):
    """No answer that says anything about the pieces."""


def throttle_wait(headers: Mapping[str, str], now: float) -> float:
    """Seconds a throttled caller waits: ``Retry-After`` (seconds or a date), else ``X-RateLimit-Reset`` (milliseconds), within bounds."""
    low = {k.lower(): v for k, v in headers.items()}
    seconds = None
    if (after := low.get("retry-after")) is not None:
        try:
            seconds = float(after)
        except ValueError:
            try:
                seconds = parsedate_to_datetime(after).timestamp() - now
            except (TypeError, ValueError):
                seconds = None
    if seconds is None and (reset := low.get("x-ratelimit-reset")) is not None:
        seconds = int(reset) / 1000 if reset.isdigit() else None
    return min(max(USUAL_WAIT if seconds is None else seconds, 0.0), LONGEST_WAIT)


def hex_bytes(text: str) -> bytes:
    return bytes.fromhex(text.removeprefix("0x"))


def listed_pieces(body: bytes) -> list[bytes]:
    """Pieces of a slot: ``data`` lists hex texts or objects with a ``blob``."""
    try:
        return [hex_bytes(x["blob"] if isinstance(x, dict) else x) for x in json.loads(body)["data"]]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise Failed(f"malformed answer ({e})") from None


def single_piece(body: bytes, path: tuple[str, ...]) -> bytes | None:
    """The piece of a record by its name: hex under ``path``; ``None`` where the record holds no bytes yet."""
    try:
        at = json.loads(body)
        for key in path:
            at = at[key] if at is not None else None
        return hex_bytes(at) or None if at else None
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise Failed(f"malformed answer ({e})") from None


@dataclass
class SlotSource:
    """Everything a slot holds, from the first endpoint and path that has it (beacon nodes and their archives)."""

    name: str
    get: Get
    endpoints: list[str]
    slot: int
    paths: tuple[str, ...] = ("/eth/v1/beacon/blobs/{slot}",)

    def candidates(self) -> list[bytes]:
        problems = []
        for endpoint in self.endpoints:
            for path in self.paths:
                answer = self.get(endpoint.rstrip("/") + path.format(slot=self.slot))
                if answer.status == 200:
                    return listed_pieces(answer.body)
                if answer.status != 404:
                    problems.append(f"{endpoint}: HTTP {answer.status}")
                    break
        if problems:
            raise Failed("; ".join(problems))
        return []


@dataclass
class NamedSource:
    """One request per wanted name (archives keyed by hash, gateways keyed by content).

    A 404 and a record without bytes are absent pieces, any other answer but 200 is an error of that name; only if all
    names fail does the call. One throttled answer is waited for and asked again; a second one in a row ends the asking.
    """

    name: str
    get: Get
    url: Callable[[str], str | None]
    read: Callable[[bytes], bytes | None]
    wait: Callable[[float], None]
    now: Callable[[], float]
    errors: dict[str, str] = field(default_factory=dict)

    def fetch(self, wanted: Iterable[str]) -> dict[str, bytes]:
        self.errors, found, asked, refused = {}, {}, 0, False
        for name in wanted:
            url = self.url(name)
            if url is None:
                continue  # this place never had it
            asked += 1
            if refused:
                self.errors[name] = "throttled"
                continue
            answer = self.get(url)
            if answer.status == 429:
                self.wait(throttle_wait(answer.headers, self.now()))
                answer = self.get(url)
                refused = answer.status == 429
            if answer.status == 200:
                try:
                    piece = self.read(answer.body)
                except Failed as e:
                    self.errors[name] = str(e)
                    continue
                if piece is not None:
                    found[name] = piece
            elif answer.status != 404:
                self.errors[name] = "throttled" if refused else f"HTTP {answer.status}"
        if asked and len(self.errors) == asked:
            raise Failed("; ".join(f"{k[:12]}: {v}" for k, v in self.errors.items()))
        return found


def record_reader(*path: str) -> Callable[[bytes], bytes | None]:
    """A reader of answers that hold the hex of a piece under ``path``."""
    return lambda body: single_piece(body, path)


def raw_reader(body: bytes) -> bytes | None:
    """A reader of answers that are the piece itself (content gateways)."""
    return body or None


def snapshot_names(manifest: bytes) -> dict[str, str]:
    """Content address by piece name, from a snapshot's manifest; pieces that were never had have none."""
    return {b["versionedHash"].removeprefix("0x"): b["cid"] for b in json.loads(manifest)["blobs"] if b.get("cid")}
