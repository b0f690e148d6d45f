"""Canonical JSON (RFC 8785): keys by UTF-16 code units, no white space, numbers in ECMAScript's shortest form."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_INTEGER = 2**53 - 1
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def number_text(x: float) -> str:
    """ECMAScript's text of a double: plain digits from 1e-6 up to below 1e21, exponents otherwise; -0 is 0."""
    if not math.isfinite(x):
        raise ValueError("JSON has no such number")
    if x == 0:
        return "0"
    sign = "-" if x < 0 else ""
    mantissa, _, exponent = repr(abs(x)).partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + fraction) - len(digits))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e = point - 1
    head = digits[0] + (f".{digits[1:]}" if n > 1 else "")
    return f"{sign}{head}e{'+' if e > 0 else '-'}{abs(e)}"


def _string(s: str) -> str:
    out = []
    for c in s:
        if c in _ESCAPES:
            out.append(_ESCAPES[c])
        elif c < " ":
            out.append(f"\\u{ord(c):04x}")
        else:
            out.append(c)
    return '"' + "".join(out) + '"'


def dumps(value: object) -> str:
    """The canonical text of a JSON value. Integers beyond 2**53 - 1 are refused, as doubles cannot hold them."""
    if value is None:
        return "null"
    if value is True:
        return "true"
    if value is False:
        return "false"
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, int):
        if abs(value) > MAX_INTEGER:
            raise ValueError("an integer beyond 2**53 - 1")
        return str(value)
    if isinstance(value, float):
        text = number_text(value)
        if "." not in text and "e" not in text and abs(value) > MAX_INTEGER:
            raise ValueError("an integer beyond 2**53 - 1")
        return text
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(dumps, value)) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_string(k)}:{dumps(value[k])}" for k in keys) + "}"
    raise TypeError(f"{type(value).__name__} is no JSON value")


def is_canonical(text: str) -> bool:
    """Whether a text is the canonical form of what it says."""
    try:
        return dumps(json.loads(text)) == text
    except (ValueError, TypeError, RecursionError):
        return False


def canonical_json_udf():
    """UDF JSON text -> canonical text; null for null, broken or uncanonisable text. Of repeated keys the last counts."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return dumps(json.loads(text))
        except (ValueError, TypeError, RecursionError):
            return None

    @F.pandas_udf(T.StringType())
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return canonical


def is_canonical_udf():
    """UDF text -> whether it survives parsing and writing unchanged; null for null."""

    @F.pandas_udf(T.BooleanType())
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else is_canonical(t))

    return check
