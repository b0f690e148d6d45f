"""A quote-aware finite-state tokenizer for fields that pack several values into one string.

The automaton reads a field once and keeps three things: whether it stands inside quotes, whether the
last character inside quotes may be the first half of a doubled quote, and the nesting depth of
brackets. Delimiters count only outside quotes and at depth 0. What a comma or a conjunction means
depends on the field as a whole, so the automaton reports them as weak delimiters and the second step
(:func:`_weak_person`, :func:`_weak_organisation`) decides.
"""

from __future__ import annotations

import re

#: characters that always separate values (a run of them is one separator or encloses empty pieces)
STRONG = ";|\n\r\t/"
_OPEN, _CLOSE = {"(": ")", "[": "]"}, {")", "]"}
_QUOTES = {'"': '"', "“": "”", "«": "»"}
_SPECIAL = re.compile("[;|\n\r\t/,()\\[\\]\"“”«»\\\\]")
_INLINE_NUMBER = re.compile(r"\(\d{1,3}\)\s")
_LIST_NUMBER = re.compile(r"^\s*(?:\d{1,3}[.)]\s+|\(\d{1,3}\)\s*)")
_INITIALS = re.compile(r"^(?:[^\W\d_]\.[\s-]?)+[^\W\d_]?\.?$|^[A-Z]{1,3}$")
_ACRONYM = re.compile(r"^[A-Z]{2,}(?:-[A-Z]{2,})+$")
_CONJUNCTION = re.compile(r"(?:,\s*|\s+)(?:and|&)\s+")
_SUFFIX = re.compile(r"^(?:Jr|Sr|II|III|IV)\.?$")
# fixed values: the last words by which the name of an organisation, not of a person, is known
_ORGANISATION_END = re.compile(
    r"(?:^surveillance\b.*|.*\b(?:network|netw|consortium|group|team|programme|program|initiative|alliance|agency|service|services|society|centre|center|institute|laboratory|laboratories|hospital|university|college))\.?$",
    re.IGNORECASE,
)


def _scan(text: str, nesting: bool) -> tuple[list[tuple[str, bool]], list[str], int]:
    """Pieces as (value, was quoted), the delimiter after each but the last, and the depth at the end."""
    pieces: list[tuple[str, bool]] = []
    delimiters: list[str] = []
    start, depth, at, end = 0, 0, 0, len(text)
    numbered = bool(_INLINE_NUMBER.match(text.lstrip()))

    def close(until: int, delimiter: str | None) -> None:
        pieces.append((text[start:until], False))
        if delimiter is not None:
            delimiters.append(delimiter)

    while at < end:
        found = _SPECIAL.search(text, at)
        if found is None:
            break
        here, c = found.start(), found.group()
        if c in _QUOTES and depth == 0 and not _LIST_NUMBER.sub("", text[start:here]).strip():
            closing, value, k = _QUOTES[c], [], here + 1
            while k < end:
                d = text[k]
                if d == "\\" and k + 1 < end and text[k + 1] in (closing, "\\"):
                    value.append(text[k + 1])
                    k += 2
                elif d == closing:
                    if k + 1 < end and text[k + 1] == closing:
                        value.append(closing)
                        k += 2
                    else:
                        break
                else:
                    value.append(d)
                    k += 1
            after = k + 1
            while after < end and text[after] == " ":
                after += 1
            if k < end and (after >= end or text[after] in STRONG or text[after] == ","):
                pieces.append(("".join(value), True))
                if after < end:
                    delimiters.append("Q" if text[after] == "," else text[after])
                    at = start = after + 1
                    if at >= end:
                        pieces.append(("", False))
                    continue
                return pieces, delimiters, depth
            at = here + 1  # no enclosing quote: an ordinary character
        elif c in _OPEN:
            if numbered and depth == 0 and _INLINE_NUMBER.match(text, here) and (here == 0 or text[here - 1].isspace()):
                if text[start:here].strip():
                    close(here, "(")
                start = at = here + text[here:].index(")") + 1
            else:
                depth, at = depth + nesting, here + 1
        elif c in _CLOSE:
            depth, at = max(0, depth - nesting), here + 1
        elif depth == 0 and (c in STRONG or c == ","):
            close(here, c)
            start = at = here + 1
        else:
            at = here + 1
    pieces.append((text[start:], False))
    return pieces, delimiters, depth


def _join_weak(pieces: list[tuple[str, bool]], delimiters: list[str]) -> list[tuple[str, bool]]:
    """Put pieces that only a comma parted together again."""
    out = [pieces[0]]
    for delimiter, piece in zip(delimiters, pieces[1:], strict=True):
        if delimiter == ",":
            out[-1] = (f"{out[-1][0]},{piece[0]}", out[-1][1] and not piece[0].strip())
        else:
            out.append(piece)
    return out


def _weak_person(text: str) -> list[str]:
    """Names of people parted by commas and conjunctions; "Surname, Initials" stays one name."""
    parts, begin, hold = [], 0, 0
    for m in _CONJUNCTION.finditer(text):
        nxt = _CONJUNCTION.search(text, m.end())
        right = re.split(",", text[m.end() : nxt.start() if nxt else len(text)])[0].strip()
        if _ORGANISATION_END.match(right) and len(right.split()) <= 3 and not right.startswith("The "):
            continue
        parts.append(text[begin : m.start()])
        begin = hold = m.end()
    parts.append(text[begin:])
    out: list[str] = []
    for part in parts:
        p = [x.strip() for x in part.split(",")]
        p = [x for x in p if x]
        k = 0
        while k < len(p):
            single = len(p[k].split()) == 1
            nxt = p[k + 1] if k + 1 < len(p) else None
            if nxt is None:
                out.append(p[k])
                k += 1
            elif _SUFFIX.match(nxt):
                out.append(f"{p[k]}, {nxt}")
                k += 2
            elif single or _INITIALS.match(nxt) or (len(nxt.split()) == 1 and not (k + 2 < len(p) and _INITIALS.match(p[k + 2]))):
                out.append(f"{p[k]}, {nxt}")
                k += 2
            else:
                out.append(p[k])
                k += 1
    return out


def _weak_organisation(text: str) -> list[str]:
    """Addresses hold commas; only a list of nothing but acronyms is parted by them."""
    p = [x.strip() for x in text.split(",")]
    kept = [x for x in p if x]
    return kept if len(kept) > 1 and all(_ACRONYM.match(x) for x in kept) else [text]


def _clean(value: str, quoted: bool) -> str:
    value = value.strip()
    return value if quoted else _LIST_NUMBER.sub("", value).strip()


def split_packed(text: str | None, kind: str) -> list[str] | None:
    """The values packed into ``text``, in order, without empty pieces; ``None`` for ``None``.

    ``kind`` is ``person`` (commas and conjunctions may part names) or ``organisation`` (commas belong
    to addresses). Delimiters within quotes or brackets do not count; a bracket that never closes does
    not nest. Doubled and backslash-escaped quotes inside quotes come out single, list numbers and
    enclosing quotes are dropped. Blank text gives no value.
    """
    if text is None:
        return None
    pieces, delimiters, depth = _scan(text, True)
    if depth:
        pieces, delimiters, _ = _scan(text, False)
    if any(d in STRONG or d == "(" for d in delimiters):
        return [v for v in (_clean(*p) for p in _join_weak(pieces, delimiters)) if v]
    if any(quoted for _, quoted in pieces):
        return [v for v in (_clean(*p) for p in pieces) if v]
    whole = _LIST_NUMBER.sub("", text.strip()).strip() if len(pieces) == 1 else text.strip()
    weak = _weak_person if kind == "person" else _weak_organisation
    return [v for v in (_clean(x, False) for x in weak(whole)) if v]
