"""Test items that leaked into training text: an FM-index per shard of the corpus, searched for phrases of the items.

A document is read cell by cell into words (:func:`words_of`), so that case, accents, punctuation,
markup, comment marks, escapes and cell boundaries play no part. All words of a shard are its symbols, and the index is
built over the whole shard, whatever the items are. Of 15 consecutive words with at most one altered, the first
seven or the last seven are intact; every run of seven words of every item is therefore searched backwards in the
index of each shard, and occurrences are located from sampled suffix positions. Of the other eight words four in a row are
intact too, the nearer or the farther ones: only items that hold these beside the phrase are compared with the words around
an occurrence, so a phrase that very many items share costs no more than the items that go on like the document.
Passages of one item that overlap in a document are merged into removal spans.

A shard is a stretch of a partition, so no row is shuffled and memory is bounded by the shard's words. The items are
collected in blocks of about ``BLOCK_CHARS`` characters and sent to the tasks; each block is searched in a pass of its own.

Defined results: documents or items that are null, empty or shorter than the window have no passage;
repeated documents are each reported; ties do not arise, as every passage counts.
"""

from __future__ import annotations

import html
import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.fmindex import FMIndex
from strandlog.llm.notebooks import cells
from strandlog.session import materialize

WINDOW, ALTERED, SEED = 15, 1, 7
#: words of a shard beyond which its index is built and searched
SHARD_WORDS = 600_000
#: characters of the held-out items that are searched in one pass over the corpus
BLOCK_CHARS = 4_000_000

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.DOTALL)
_UNICODE = re.compile(r"\\u([0-9a-fA-F]{4})")
_ESCAPE = re.compile(r"\\[nrt\"'\\/]")
_INNER = re.compile(r"(?<=[^\W_])[\u2010-\u2015'’ʼ`´\u00ad\u200b-](?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c)) + "]+")


def words_of(text: str) -> list[str]:
    """The words of a piece of text, in lower case without accents; hyphens and apostrophes inside a word vanish."""
    if "\\" in text:
        text = _UNICODE.sub(lambda m: chr(int(m.group(1), 16)), text)
        text = _ESCAPE.sub(" ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(_INNER.sub("", text.lower()))


def _junctions(words: list[str], at: list[int]) -> Iterator[tuple[int, list[str]]]:
    """The stretches of words within a window of any of the places ``at``, each with the number of its first word."""
    reach = WINDOW - 1
    k = 0
    while k < len(at):
        first, last = max(0, at[k] - reach), at[k] + reach
        while k + 1 < len(at) and at[k + 1] - reach <= last:
            k += 1
            last = at[k] + reach
        yield first, words[first:last]
        k += 1


def streams(text: str | None, layout: str | None) -> list[tuple[int, int, list[str]]]:
    """(stream, number of the first word, words) in which a passage may run on.

    Stream 0 is all cells in order. Streams 1 (prose cells) and 2 (code cells) leave out what stands between cells of
    their kind; only where something is left out they can hold a passage that stream 0 lacks, so only the words around
    these places come out. Images hold no words.
    """
    whole: list[str] = []
    kinds: dict[int, tuple[list[str], list[int]]] = {1: ([], []), 2: ([], [])}
    ends = {1: 0, 2: 0}  # how long stream 0 was behind the last cell of the kind
    for kind, t in cells(text, layout):
        if kind == "image":
            continue
        w = words_of(t)
        k = 1 if kind in ("markdown", "text") else 2 if kind == "code" else 0
        if k and w:
            mine, gaps = kinds[k]
            if mine and ends[k] < len(whole):
                gaps.append(len(mine))
            mine += w
            ends[k] = len(whole) + len(w)
        whole += w
    out = [(0, 0, whole)]
    for k, (mine, gaps) in kinds.items():
        out += [(k, first, w) for first, w in _junctions(mine, gaps)]
    return out


class Vocabulary(dict):
    """Symbols of words, numbered from 1 as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        return n


class ItemPhrases:
    """The words of items as numbers, their distinct phrases of ``SEED`` words, and what stands around each use of a phrase."""

    def __init__(self, texts: list[tuple[int, str | None]]) -> None:
        self.code: dict[str, int] = {}
        self.items: list[int] = []
        self.pairs: dict[tuple[str, str], str] = {}
        words: list[np.ndarray] = []
        for item, text in texts:
            w = words_of(text or "")
            if len(w) < WINDOW:
                continue
            self.items.append(item)
            words.append(np.array([self.code.setdefault(x, len(self.code)) for x in w], dtype=np.int32))
            for c in re.findall(r"[^\W_]+(?:[-'’][^\W_]+)+", text or ""):
                parts = words_of(c.replace("-", " ").replace("'", " ").replace("’", " "))
                if len(parts) == 2:
                    self.pairs[(parts[0], parts[1])] = "".join(parts)
        self.heads = {a for a, _ in self.pairs}
        if not words:
            return
        sizes = np.array([len(w) for w in words])
        self.begins = np.concatenate(([0], np.cumsum(sizes)))
        self.words = np.concatenate(words)
        runs = np.concatenate([np.arange(n - SEED + 1) for n in sizes])
        owner = np.repeat(np.arange(len(words)), sizes - SEED + 1)
        at = self.begins[owner] + runs
        self.phrases, phrase = np.unique(self.words[at[:, None] + np.arange(SEED)], axis=0, return_inverse=True)
        phrase = phrase.ravel()
        # a use is found by its phrase and any of the four words in a row that a passage beginning or ending with it has
        keys, uses = [], []
        for k, shift in enumerate(_BESIDE):
            fits = (runs + shift >= 0) & (runs + shift + BESIDE <= sizes[owner])
            fits &= (runs + WINDOW <= sizes[owner]) if shift > 0 else (runs >= WINDOW - SEED)
            keys.append(_mix(phrase[fits], k, self.words[(at[fits] + shift)[:, None] + np.arange(BESIDE)]))
            uses.append(np.flatnonzero(fits))
        key, use = np.concatenate(keys), np.concatenate(uses)
        order = np.argsort(key, kind="stable")
        self.keys, self.owner, self.offset = key[order], owner[use[order]], runs[use[order]]

    def symbols(self, words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray | None]:
        """Symbols of a document's words, from 1 on, and where each stands among its words (None: at its own number).

        A compound written apart counts as the one word it is in the items.
        """
        n = len(words)
        at = None
        if not self.heads.isdisjoint(words):
            out, places, k = [], [], 0
            while k < n:
                w = words[k]
                joined = self.pairs.get((w, words[k + 1])) if w in self.heads and k + 1 < n else None
                out.append(joined or w)
                places.append(k)
                k += 2 if joined else 1
            if len(out) < n:
                words, at = out, np.array(places, dtype=np.int64)
        return np.array(list(map(vocabulary.__getitem__, words)), dtype=np.int32), at


#: where four words in a row stand from the first word of an intact phrase, when it begins the passage and when it ends it
BESIDE = 4
_BESIDE = (SEED, SEED + BESIDE, -2 * BESIDE, -BESIDE)


def _mix(phrase: np.ndarray, kind: int, words: np.ndarray) -> np.ndarray:
    """64-bit keys of a phrase and words beside it; equal keys of different words only cost a comparison."""
    m = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = phrase.astype(np.uint64) * np.uint64(4) + np.uint64(kind)
        for c in words.T:
            h = (h ^ (h >> np.uint64(29))) * m + c.astype(np.int64).view(np.uint64)
    return h


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For intervals: the number of the interval and the member, for every member of each."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def _passages(seq: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary, items: ItemPhrases) -> Iterator[tuple[int, int, int, int]]:
    """(document, item text, first word, last word) of every passage in a shard; documents end before ``ends``, where a 0 stands."""
    known = np.array([vocabulary.get(w, 0) for w in items.code], dtype=np.int64)
    phrases = known[items.phrases]
    possible = np.flatnonzero((phrases > 0).all(axis=1))
    if not len(possible):
        return
    index = FMIndex(seq, len(vocabulary) + 1)
    lo, hi = index.search(phrases[possible])
    which, rows = _spread(lo, hi)
    if not len(which):
        return
    where, phrase = index.locate(rows), possible[which]
    # from here on words are numbered as in the items: -1 is any other word, -2 the end of a document
    number = np.full(len(vocabulary) + 1, -1, dtype=np.int64)
    number[known[known > 0]] = np.flatnonzero(known > 0)
    number[0] = -2
    margin = WINDOW
    text = np.concatenate((np.full(margin, -2), number[seq], np.full(margin, -2)))
    met = []
    for k, shift in enumerate(_BESIDE):
        key = _mix(phrase, k, text[(where + margin + shift)[:, None] + np.arange(BESIDE)])
        at, use = _spread(np.searchsorted(items.keys, key, side="left"), np.searchsorted(items.keys, key, side="right"))
        met.append(np.stack((items.owner[use], where[at] - items.offset[use]), axis=1))
    pairs = np.unique(np.concatenate(met), axis=0)
    # the stretch of an item that lies in the document is where the phrase itself lies
    size = items.begins[pairs[:, 0] + 1] - items.begins[pairs[:, 0]]
    for (t, begin), n in zip(pairs, size, strict=True):
        w = items.words[items.begins[t] : items.begins[t] + n]
        a, b = max(int(begin), 0), min(int(begin) + int(n), len(seq))
        if b - a < WINDOW:
            continue
        here = text[margin + a : margin + b]
        wrong = np.concatenate(([0], np.cumsum((here != w[a - begin : b - begin]) + (here == -2) * WINDOW)))
        good = np.flatnonzero(wrong[WINDOW:] - wrong[:-WINDOW] <= ALTERED)
        # an item may reach over several documents; windows of one document that touch are one passage
        docs = np.searchsorted(ends, a + good, side="right")
        for mine in np.split(np.arange(len(good)), np.flatnonzero((docs[1:] != docs[:-1]) | (good[1:] - good[:-1] > WINDOW)) + 1 if len(good) else []):
            if len(mine):
                d = int(docs[mine[0]])
                first = int(ends[d - 1]) if d else 0
                yield d, int(t), a + int(good[mine[0]]) - first, a + int(good[mine[-1]]) + WINDOW - 1 - first


def _search(items: ItemPhrases, layout: bool):
    """mapInPandas function: documents in, (doc_id, item_id, stream, first_word, last_word) out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs: list[tuple[int, int, int, np.ndarray | None]] = []
        parts: list[np.ndarray] = []
        vocabulary = Vocabulary()
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal docs, parts, size, vocabulary
            end = np.zeros(1, dtype=np.int32)
            seq = np.concatenate([x for p in parts for x in (p, end)])
            ends = np.cumsum([len(p) + 1 for p in parts])
            rows = []
            for d, t, a, b in _passages(seq, ends, vocabulary, items):
                doc_id, stream, before, places = docs[d]
                rows.append((doc_id, items.items[t], stream, before + (a if places is None else places[a]), before + (b if places is None else places[b])))
            docs, parts, size, vocabulary = [], [], 0, Vocabulary()
            return pd.DataFrame(rows, columns=["doc_id", "item_id", "stream", "first_word", "last_word"])

        for batch in batches:
            layouts = batch["layout"] if layout else [None] * len(batch)
            for doc_id, text, lay in zip(batch["doc_id"], batch["text"], layouts, strict=True):
                if doc_id is None or text is None or doc_id != doc_id:
                    continue
                for k, before, words in streams(text, lay):
                    if len(words) < WINDOW:
                        continue
                    codes, places = items.symbols(words, vocabulary)
                    docs.append((doc_id, k, before, places))
                    parts.append(codes)
                    size += len(codes) + 1
                if size >= SHARD_WORDS:
                    yield flush()
        if parts:
            yield flush()

    return run


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, stream, first_word, last_word: merged spans of leaked passages.

    documents: doc_id, text, layout (optional); items: item_id and text columns question and answer. Word numbers
    count the words of the document's stream (0: all cells, 1: prose cells, 2: code cells) from 0.
    """
    schema = "doc_id bigint, item_id bigint, stream int, first_word bigint, last_word bigint"
    texts = items.filter("item_id is not null").select("item_id", F.explode(F.array("question", "answer")).alias("text")).filter("text is not null")
    chars = texts.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    if blocks > 1:
        texts = materialize(texts.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), ["block"])
    has_layout = "layout" in documents.columns
    read = documents.select("doc_id", "text", *(["layout"] if has_layout else []))
    found = None
    for k in range(blocks):
        rows = (texts.filter(F.col("block") == k) if blocks > 1 else texts).select("item_id", "text").collect()
        phrases = ItemPhrases([(r.item_id, r.text) for r in rows])
        if phrases.items:
            passages = read.mapInPandas(_search(phrases, has_layout), schema)
            found = passages if found is None else found.unionByName(passages)
    if found is None:
        return documents.sparkSession.createDataFrame([], schema)
    # a document has few passages; of one item, those that touch become one span
    sorted_spans = F.array_sort(F.collect_list(F.struct("first_word", "last_word")))
    merged = F.aggregate(
        sorted_spans,
        F.array().cast("array<struct<first_word:bigint,last_word:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["last_word"] + 1 >= s["first_word"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["first_word"].alias("first_word"), F.greatest(F.element_at(acc, -1)["last_word"], s["last_word"]).alias("last_word")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return found.groupBy("doc_id", "item_id", "stream").agg(merged.alias("spans")).select("doc_id", "item_id", "stream", F.inline("spans"))


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: each document with each item of which it holds a passage."""
    return removal_spans(documents, items).select("doc_id", "item_id").distinct()
