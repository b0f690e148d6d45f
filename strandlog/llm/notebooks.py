"""Cells of computational notebooks kept as text, in three layouts.

``ipynb`` is the JSON file itself, ``percent`` a script whose cells begin with ``# %%``, ``console`` a
transcript with ``In [n]:`` and ``Out[n]:``. Cells come out in reading order as (kind, text); a text of
another or broken layout is one cell of kind ``text``. Nothing is cut, however long.
"""

from __future__ import annotations

import json
import re

_PERCENT = re.compile(r"^# %%(.*)$", re.MULTILINE)
_PERCENT_OUT = re.compile(r"^# \[(out|image|err|error|display)\] ?", re.MULTILINE)
_COMMENT = re.compile(r"^# ?", re.MULTILINE)
_PROMPT = re.compile(r"^(In|Out) ?\[[ \d*]*\]: ?\n?")
_IMAGE = re.compile(r"^\s*data:image/")
_TRACE = re.compile(r"^\s*Traceback \(most recent call last\)")


def _joined(value: object) -> str:
    if isinstance(value, list):
        return "".join(x for x in value if isinstance(x, str))
    return value if isinstance(value, str) else ""


def _output_kind(text: str) -> str:
    return "image" if _IMAGE.match(text) else "error" if _TRACE.match(text) else "output"


def _ipynb(text: str) -> list[tuple[str, str]] | None:
    try:
        parsed = json.loads(text)
        listed = parsed["cells"]
    except (ValueError, KeyError, TypeError, RecursionError):
        return None
    out: list[tuple[str, str]] = []
    for cell in listed if isinstance(listed, list) else []:
        if not isinstance(cell, dict):
            continue
        kind = cell.get("cell_type")
        out.append((kind if kind in ("markdown", "code") else "text", _joined(cell.get("source"))))
        for o in cell.get("outputs") or []:
            if not isinstance(o, dict):
                continue
            if o.get("text") is not None:
                t = _joined(o.get("text"))
                out.append((_output_kind(t), t))
            elif isinstance(o.get("traceback"), list):
                out.append(("error", "\n".join(map(str, o["traceback"]))))
            data = o.get("data")
            if isinstance(data, dict):
                out += [("image" if mime.startswith("image/") else "output", _joined(d)) for mime, d in data.items()]
            elif data is not None:
                out.append(("image" if o.get("output_type") == "image" else _output_kind(_joined(data)), _joined(data)))
    return out


def _percent(text: str) -> list[tuple[str, str]]:
    marks = list(_PERCENT.finditer(text))
    out = [("text", text[: marks[0].start()] if marks else text)]
    for k, m in enumerate(marks):
        body = text[m.end() : marks[k + 1].start() if k + 1 < len(marks) else len(text)].strip("\n")
        if "[markdown]" in m.group(1):
            out.append(("markdown", _COMMENT.sub("", body)))
            continue
        outs = list(_PERCENT_OUT.finditer(body))
        out.append(("code", body[: outs[0].start()].rstrip("\n") if outs else body))
        for j, o in enumerate(outs):
            t = body[o.end() : outs[j + 1].start() if j + 1 < len(outs) else len(body)].strip("\n")
            t = _COMMENT.sub("", t)
            out.append(("image" if o.group(1) == "image" else _output_kind(t), t))
    return out


def _console(text: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for block in text.split("\n\n"):
        m = _PROMPT.match(block.lstrip("\n"))
        if m:
            t = block.lstrip("\n")[m.end() :]
            out.append(("code" if m.group(1) == "In" else _output_kind(t), t))
        elif block.strip():
            out.append(("markdown", block))
    return out


def cells(text: str | None, layout: str | None) -> list[tuple[str, str]]:
    """(kind, text) of the cells that hold anything; kinds: markdown, code, output, error, image, text."""
    if not text:
        return []
    found: list[tuple[str, str]] | None = None
    if layout == "ipynb" or (layout is None and text.lstrip().startswith("{")):
        found = _ipynb(text)
    elif layout == "percent":
        found = _percent(text)
    elif layout == "console":
        found = _console(text)
    if found is None:
        found = [("text", text)]
    return [(k, t) for k, t in found if t and not t.isspace()]
