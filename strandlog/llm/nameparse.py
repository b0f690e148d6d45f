"""Reading names of people and institutions: what identifies the entity, and what only narrows it."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from strandlog.llm.namelex import BODY_WORDS, BUILDING_PARTS, FILLERS, INSTITUTION_WORDS, NICKNAMES, SAME_UNITS, TITLES
from strandlog.llm.similarity import within_one_edit

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CHUNK = re.compile(r"(?:[^\W\d_](?:\.|\b)[\s-]?)+|\S+")
_LETTERS = {"ß": "ss", "ø": "o", "æ": "a", "œ": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
_CANON = {v: k for k, vs in INSTITUTION_WORDS.items() for v in (*vs, k)}
_NICKNAMES: dict[str, str] = {}
_ACRONYMS = re.compile(r"^([A-Z]{2,})-([A-Z]{2,})\b")


def fold(text: str, transliterated: bool = True) -> str:
    """Lower case without accents; the transliterations ae, oe, ue count as a, o, u unless told otherwise."""
    low = unicodedata.normalize("NFC", text.lower())
    if transliterated:
        low = re.sub(r"([aou])e", r"\1", low)  # before accents go, as ö before e is no transliteration
    low = "".join(_LETTERS.get(c, c) for c in low)
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def _shortened(word: str) -> list[str]:
    """The word and what is left without one of its letters; words one edit or swap apart share one of these."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


@lru_cache(maxsize=65536)
def _institution_word(word: str) -> str | None:
    """The canonical form of a word of institutions, also abbreviated, translated or with one typo."""
    if word in _CANON:
        return _CANON[word]
    if len(word) >= 5:
        near = [w for part in _shortened(word) for w in _NEAR.get(part, ()) if within_one_edit(word, w)]
        if near:
            return _CANON[min(near)]
    return None


_NICKNAMES.update({fold(k): fold(v) for k, v in NICKNAMES.items()})
#: full given names that are known as such
GIVEN_NAMES = frozenset(_NICKNAMES.values())
_CANON_FOLDED = {fold(k): v for k, v in _CANON.items()}
_CANON.update(_CANON_FOLDED)
_NEAR: dict[str, list[str]] = {}
for _w in _CANON:
    for _part in _shortened(_w) if len(_w) >= 6 else ():
        _NEAR.setdefault(_part, []).append(_w)


def _code(words: set[str]) -> str:
    return "".join(sorted(w[0] for w in words))


def parse_organisation(name: str) -> dict | None:
    """core: the proper names in it (raw: the same with ae, oe, ue as written); gate: codes of unit and kind of body; tokens: the words known of both."""
    acronym = _ACRONYMS.match(name.strip())
    written = _WORD.findall(name)
    tokens = [fold(t) for t in written]
    raw = {fold(t): fold(t, False) for t in written}
    for i, t in enumerate(tokens):
        if t in BUILDING_PARTS and re.search(rf"\b{t}\W+\d", name, re.IGNORECASE):
            tokens[i] = "of"
    if acronym:
        unit, body = acronym.groups()
        rest = sorted({t for t in tokens[2:] if t not in FILLERS})
        core = " ".join(rest) or body[-1].lower()
        return {"cls": "organisation", "core": core, "raw": " ".join(raw[t] for t in rest) or core, "gate": f"{''.join(sorted(unit.lower()))}|{''.join(sorted(body[:-1].lower()))}", "tokens": []}
    known, proper = set(), []
    for t in tokens:
        if t in FILLERS or len(t) == 1:
            continue
        w = _institution_word(t)
        if w:
            known.add(w)
        elif t not in proper:
            proper.append(t)
    for other, usual in SAME_UNITS:
        if other <= known and not usual <= known:
            known = (known - other) | usual
    if not known and not proper:
        return None
    unit, body = known - BODY_WORDS, known & BODY_WORDS
    places = _one_spelling(proper)
    return {"cls": "organisation", "core": " ".join(places), "raw": " ".join(raw[t] for t in places), "gate": f"{_code(unit)}|{_code(body)}", "tokens": sorted(known)}


def _one_spelling(proper: list[str]) -> list[str]:
    """The sorted proper names, a place named twice with one typo between counting once."""
    out: list[str] = []
    for t in proper:
        if not any(len(t) >= 5 and within_one_edit(t, o) for o in out):
            out.append(t)
    return sorted(out)


def _is_initials(token: str) -> bool:
    bare = re.sub(r"[.\s-]", "", token)
    return bare.isalpha() and (len(bare) == 1 or (bare.isupper() and (len(bare) <= 2 or token.count(".") >= len(bare) - 1)))


def _given(words: list[str]) -> tuple[str | None, str | None, str | None]:
    """(full given name, first initial, middle initial) of the given names of a person."""
    full, letters = None, []
    for k, w in enumerate(words):
        if _is_initials(w):
            letters += [fold(c) for c in w if c.isalpha()]
        else:
            g = fold("".join(c for c in w if c.isalpha() or c == "-")).replace("-", "")
            g = _NICKNAMES.get(g, g)
            if k == 0:
                full = g
            letters.append(g[:1])
    return full, (letters[0] if letters else None), (letters[1] if len(letters) > 1 else None)


def _person(surname: list[str], given: list[str]) -> dict:
    full, first, middle = _given(given)
    parts = [w for x in surname for w in re.split(r"[-\s]", x)]
    tokens, written = ([t for t in ("".join(filter(str.isalpha, fold(w, same))) for w in parts) if t] for same in (True, False))
    return {"core": "".join(tokens), "raw": " ".join(written), "given": full, "gate": first or "", "middle": middle, "tokens": tokens}


def parse_person(name: str) -> tuple[dict | None, dict | None]:
    """The reading of a name and, for "A, B" of two words, the reading with the order turned round."""
    words = [t for t in (fold(x) for x in _WORD.findall(name))]
    kinds = [_institution_word(w) for w in words]
    if sum(k in ("network", "surveillance", "sequencing", "group") for k in kinds) >= 2:
        proper = _one_spelling([w for w, k in zip(words, kinds, strict=True) if not k and w not in FILLERS])
        raw = {fold(x): fold(x, False) for x in _WORD.findall(name)}
        return {"cls": "group", "core": " ".join(proper), "raw": " ".join(raw[w] for w in proper), "gate": "", "given": None, "middle": None, "tokens": sorted({k for k in kinds if k})}, None
    text = re.sub(r"\s+", " ", name.replace(" ", " ")).strip(" ,;")
    while (m := re.match(r"^([^\W\d_]+)\.?\s+", text)) and m.group(1).lower() in TITLES:
        text = text[m.end() :]
    text = re.sub(r",?\s+(?:Jr|Sr|II|III|IV)\.?$", "", text)
    if not words or not text:
        return None, None
    alt = None
    if "," in text:
        left, right = (x.strip() for x in text.split(",", 1))
        lw, rw = left.split(), [t.strip() for t in _CHUNK.findall(right)]
        if not lw or not rw:
            first = _person(lw or rw, [])
        else:
            first = _person(lw, rw)
            if not all(_is_initials(t) for t in rw) and not _is_initials(lw[-1]):
                alt = _person([rw[-1]], lw + rw[:-1]) if len(lw) == 1 else None
    else:
        w = [t.strip() for t in _CHUNK.findall(text)]
        if len(w) == 1:
            first = _person(w, [])
        elif _is_initials(w[-1]):
            k = len(w) - 1
            while k > 1 and _is_initials(w[k - 1]):
                k -= 1
            first = _person(w[:k], w[k:])
        elif _is_initials(w[0]):
            k = 1
            while k < len(w) - 1 and _is_initials(w[k]):
                k += 1
            first = _person(w[k:], w[:k])
        else:
            first = _person(w[-1:], w[:-1])
    return first | {"cls": "person"}, (alt | {"cls": "person"} if alt else None)
