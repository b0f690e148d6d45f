"""Keyword-stuffed and link-list pages among notebooks.

The cells of a page are cut into segments (paragraphs; in code, runs of comments and of statements).
Content and link features of each segment go to bagged decision trees, which are trained from weak
labels: a few rules that are sure of a segment label it; what no rule names, and all doubtful segments, are judged by the trees. A
page's own prediction is the share of its characters in segments that the trees call lists. Host-level spam rates
then smooth the predictions: the logit of each segment is shifted by the logit of the spam rate of the other pages of its
host (the owner of its repository), by a weight that is fitted on labelled segments which the trees in question
have not seen. A segment that is sure stays as it is, whatever its host; pages above one half come out.

The features of all segments are computed once, over whole texts and without a shuffle, and written down. The
trees and the weight are fitted on at most ``SAMPLE_LISTS`` segments labelled as lists and ``SAMPLE_OTHERS`` labelled
otherwise, those with the lowest hashes among all pages; then every page is scored. Pages are counted by host with
partial sums, and meet their host's rate in a salted join, so a host with a third of all pages is no large group.

Defined results: a page that is null, empty or holds no cell text is no spam; null hosts are one host;
repeated pages are scored each; where all labels are of one kind there is nothing to learn, so the labels themselves decide, with a warning.
"""

from __future__ import annotations

import math
import re
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.llm.notebooks import cells
from strandlog.llm.trees import BaggedTrees
from strandlog.session import materialize

#: labelled segments that the trees are fitted on, of either label
SAMPLE_LISTS, SAMPLE_OTHERS = 6000, 24_000
#: trees of a forest, and the share of features that a split tries
TREES, TRIED = 25, 0.7
#: pages of the corpus's mean rate that are counted beside a host's own
PRIOR_PAGES = 10
#: logits of the trees lie within this
SURE = 4.0
#: parts of a host in the join of its pages with its rate
SALTS = 16

# fixed values: the most frequent function words of five languages
FUNCTION_WORDS = frozenset(
    """the of and to in is that it for was on are as with be this have from or by not but what all were when we there can an your which their if do will each how them then these so has more than into only its after before
    de la que el en los se del las por un para con no una su al lo como pero sus le ya este cuando todo esta son entre sin sobre es hay si o y a aun
    do da em um os ao dos das na nos uma pelo pela ou mas foi ser tem se com não seu sua depois antes ainda
    le les des et est une du dans qui pas sur au ce il plus par ne sont avec cette mais où ou on puis après comme
    der die und das ist nicht von zu den mit sich des auf für eine dem als auch es an werden aus er hat dass wird bei oder wenn nach noch über muss wie wir zuerst""".split()
)
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+")
_LINK = re.compile(r"\]\(|<a\s+href|https?://|www\.", re.IGNORECASE)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_ANCHOR = re.compile(r"\]\(#[^()\s]*\)")
_WORD = re.compile(r"[^\W\d_]+")
_HASHTAG = re.compile(r"#[^\W_]\w+")
_SENTENCE = re.compile(r"(?<=\w)(?<!^\d)(?<!^\d\d)[.?!](?=\s|$)", re.MULTILINE)

FEATURES = (
    "log_chars", "url_share", "links_per_word", "sentences_per_word", "function_share", "hashtag_share", "distinct_share", "bigram_repeat", "line_alike", "line_repeat", "capital_share",
    "digit_share", "code_share", "separators_per_word", "words_per_line", "word_length", "prose", "code", "anchors_per_line", "longest_share",
)

_PROSE = FEATURES.index("prose")


def segments(text: str | None, layout: str | None) -> list[tuple[str, str]]:
    """(kind, text) of the parts of a page's cells; images are one part."""
    out: list[tuple[str, str]] = []
    for kind, t in cells(text, layout):
        if kind == "image":
            out.append((kind, t))
            continue
        for block in t.split("\n\n"):
            if not block.strip():
                continue
            if kind != "code":
                out.append((kind, block))
                continue
            run: list[str] = []
            comment = None
            for line in block.split("\n"):
                is_comment = line.lstrip().startswith("#")
                if comment is not None and is_comment != comment:
                    out.append((kind, "\n".join(run)))
                    run = []
                comment = is_comment
                run.append(line)
            out.append((kind, "\n".join(run)))
    return out


def features(kind: str, text: str) -> list[float]:
    """The features of a segment, in the order of ``FEATURES``."""
    n = max(1, len(text))
    rows = text.split("\n")
    lines = len(rows)
    links, url_chars, anchors, plain = 0, 0, 0, text
    if "](" in text or "://" in text or "www." in text:
        links, anchors = len(_LINK.findall(text)), text.count("](#")
        plain = _URL.sub(" ", text)
        url_chars = n - len(plain)
        plain = _ANCHOR.sub("]", plain)  # where a link leads is no text
    if "<" in plain:
        plain = _TAG.sub(" ", plain)
    written = _WORD.findall(plain)
    words = [w.lower() for w in written]
    m = max(1, len(words))
    distinct = set(words)
    p = max(1, len(plain))
    letters = sum(map(len, words))
    pairs = set(zip(words, words[1:], strict=False))
    widths = [len(r.split()) for r in rows] if lines >= 3 else []
    return [
        math.log(n), url_chars / n, links / m, len(_SENTENCE.findall(plain)) / m if "." in plain or "?" in plain or "!" in plain else 0.0, sum(map(FUNCTION_WORDS.__contains__, words)) / m,
        len(_HASHTAG.findall(plain)) / m if "#" in plain else 0.0, len(distinct) / m, 1.0 - len(pairs) / (m - 1) if m > 1 else 0.0, max(map(widths.count, set(widths))) / lines if widths else 0.0, 1.0 - len(set(rows)) / lines,
        sum(w[0].isupper() for w in written) / m, sum(map(plain.count, "0123456789")) / p, sum(map(plain.count, "=(){}[]_:;+*%\\")) / p,
        (plain.count(",") + plain.count("|") + plain.count(";") + plain.count(">>") + plain.count("<<") + plain.count(" - ")) / m, m / lines, letters / m,
        float(kind in ("markdown", "text")), float(kind == "code"), anchors / lines, max(map(len, distinct), default=0) / p,
    ]


def weak_label(kind: str, text: str, f: list[float]) -> int:
    """1 for a segment that is surely a list of links, of hashtags, of rows made alike or of repeated keywords, 0 for one that surely is no list, -1 otherwise."""
    v = dict(zip(FEATURES, f, strict=True))
    if kind == "image":
        return 0
    if v["anchors_per_line"] >= 0.5 and v["url_share"] == 0:
        return 0  # a table of contents stays on its page
    if (v["sentences_per_word"] >= 0.03 and v["function_share"] >= 0.2) or (v["sentences_per_word"] >= (0.015 if v["function_share"] >= 0.1 else 0.04) and v["url_share"] < 0.2):
        return 0
    if kind == "output" and v["line_repeat"] >= 0.9 and v["words_per_line"] >= 4:
        return 0  # a message printed again and again
    if v["sentences_per_word"] < 0.02:
        if v["url_share"] >= 0.4 and text.count("://") >= 3:
            return 1
        if v["hashtag_share"] >= 0.4 and text.count("#") >= 6:
            return 1
        if kind in ("markdown", "text") and text.count("\n") >= 4 and v["line_alike"] >= 0.5 and v["words_per_line"] >= 4 and v["function_share"] < 0.12 and v["code_share"] < 0.02:
            return 1
        if kind != "error" and text.count(" ") + text.count("\n") >= 15 and v["bigram_repeat"] >= 0.1 and v["function_share"] < 0.12 and v["code_share"] < 0.02 and v["digit_share"] < 0.05:
            return 1
    if kind in ("code", "output", "error") and (v["code_share"] >= 0.04 or v["digit_share"] >= (0.15 if v["bigram_repeat"] < 0.15 else 0.3)):
        return 0
    if kind in ("markdown", "text") and v["function_share"] >= 0.2 and v["url_share"] < 0.2:
        return 0
    return -1


def _host(repo: pd.Series) -> list[str | None]:
    return [None if r is None or r != r else r.split("/", 1)[0] for r in repo]


_MEASURED = "doc_id bigint, host string, image_chars bigint, sizes array<int>, labels array<tinyint>, f array<float>"


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages to sizes, weak labels and features of their segments, features one after the other; images are no text and only counted."""
    for b in batches:
        out: dict[str, list] = {"sizes": [], "labels": [], "f": []}
        images = []
        for text, layout in zip(b["text"], b["layout"], strict=True):
            sizes, labels, rows, image = [], [], [], 0
            for kind, t in segments(text, layout):
                if kind == "image":
                    image += len(t)
                    continue
                f = features(kind, t)
                sizes.append(len(t))
                labels.append(weak_label(kind, t, f))
                rows += f
            out["sizes"].append(np.array(sizes, dtype=np.int32))
            out["labels"].append(np.array(labels, dtype=np.int8))
            out["f"].append(np.array(rows, dtype=np.float32))
            images.append(image)
        yield pd.DataFrame({"doc_id": b["doc_id"], "host": _host(b["repo"]), "image_chars": images, **{k: pd.Series(v, dtype=object) for k, v in out.items()}})


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, host, sizes, labels, f: one row per page with an id; columns layout and repo may be absent."""
    have = set(documents.columns)
    pages = documents.select("doc_id", "text", *(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("layout", "repo")))
    return pages.filter("doc_id is not null").mapInPandas(_measure, _MEASURED)


def labelled_sample(pages: DataFrame, lists: int = SAMPLE_LISTS, others: int = SAMPLE_OTHERS) -> DataFrame:
    """doc_id, host, k, label, f: a bounded sample of the weakly labelled segments of all pages."""
    n = len(FEATURES)
    each = pages.select("doc_id", "host", "f", F.posexplode("labels").alias("k", "label"))
    flag = lambda name: F.element_at("f", F.col("k") * n + 1 + FEATURES.index(name)) == 1

    def lowest(label: int, limit: int, kind: Column) -> DataFrame:
        mine = each.filter((F.col("label") == label) & kind).select(F.xxhash64("doc_id", "k").alias("h"), "doc_id", "host", "k", "label", F.slice("f", F.col("k") * n + 1, n).alias("f"))
        return mine.orderBy("h", "doc_id", "k").limit(limit)

    # what is no list is drawn in equal parts from prose, code and output
    rows = lowest(1, lists, F.lit(True))
    for kind in (flag("prose"), flag("code"), ~flag("prose") & ~flag("code")):
        rows = rows.unionByName(lowest(0, others // 3, kind))
    return rows


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["f"].tolist(), dtype=np.float32).reshape(-1, len(FEATURES))


class Forests:
    """Bagged trees for prose cells and for all others, as what sets lists apart is not the same in both."""

    def __init__(self, x: np.ndarray, label: np.ndarray) -> None:
        prose = x[:, _PROSE] == 1
        self.trees = {k: BaggedTrees.fit(x[mine], label[mine], n_trees=TREES, share=TRIED) for k, mine in ((True, prose), (False, ~prose)) if mine.any()}

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        prose = x[:, _PROSE] == 1
        for k, mine in ((True, prose), (False, ~prose)):
            if k in self.trees:
                out[mine] = self.trees[k].predict(x[mine])
        return out


def fit(rows: pd.DataFrame) -> Forests | None:
    """Trees fitted on labelled segments; None, with a warning, if all are of one kind."""
    if rows["label"].nunique() < 2:
        warnings.warn("all weak labels of the sample are of one kind: they decide, as nothing can be learnt from them", stacklevel=2)
        return None
    return Forests(_matrix(rows), rows["label"].to_numpy())


def _logits(trees: Forests, x: np.ndarray) -> np.ndarray:
    p = np.clip(trees.predict(x), 1e-9, 1 - 1e-9)
    return np.clip(np.log(p / (1 - p)), -SURE, SURE)


def fit_host_weight(logit: np.ndarray, shift: np.ndarray, label: np.ndarray, ridge: float = 0.02) -> float:
    """The weight, from 0 to 1, by which the host's shift is added to the logits of segments: ridged logistic regression by Newton steps."""
    w, n = 0.0, len(label)
    for _ in range(25 if n else 0):
        p = 1.0 / (1.0 + np.exp(-(logit + w * shift)))
        step = (((label - p) * shift).sum() - ridge * n * w) / ((p * (1 - p) * shift**2).sum() + ridge * n)
        w += step
        if abs(step) < 1e-6:
            break
    return float(min(max(w, 0.0), 1.0))


def held_out_logits(rows: pd.DataFrame) -> np.ndarray:
    """The logit of each labelled segment by trees fitted on the hosts of the other half; NaN where that half has one kind of labels only."""
    half = np.array([zlib.crc32((h or "").encode()) & 1 for h in rows["host"]], dtype=np.int64)
    out = np.full(len(rows), np.nan)
    for k in (0, 1):
        seen = rows[half != k]
        if seen["label"].nunique() == 2 and (half == k).any():
            out[half == k] = _logits(Forests(_matrix(seen), seen["label"].to_numpy()), _matrix(rows[half == k]))
    return out


def _score(trees: Forests | None):
    """mapInPandas function: measured pages to the characters and logits of their segments, and to the characters of those that are lists by themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = b["sizes"].map(len).to_numpy()
            at = np.repeat(np.arange(len(b)), counts)
            size = np.concatenate([np.asarray(x, dtype=np.int64) for x in b["sizes"]] or [np.zeros(0, dtype=np.int64)])
            label = np.concatenate([np.asarray(x) for x in b["labels"]] or [np.zeros(0)])
            logit = np.where(label == 1, SURE, -SURE)
            if trees is not None:
                x = np.concatenate([np.asarray(x, dtype=np.float32) for x in b["f"]] or [np.zeros(0, dtype=np.float32)]).reshape(-1, len(FEATURES))
                logit[label < 0] = _logits(trees, x[label < 0])
            chars = np.bincount(at, weights=size, minlength=len(b)).astype(np.int64) + b["image_chars"].to_numpy(dtype=np.int64)
            spam = np.bincount(at, weights=size * (logit >= 0), minlength=len(b)).astype(np.int64)
            parts = pd.Series(np.split(logit.astype(np.float32), np.cumsum(counts)[:-1]) if len(b) else [], dtype=object)
            yield pd.DataFrame({"doc_id": b["doc_id"], "host": b["host"], "n_chars": chars, "list_chars": spam, "sizes": b["sizes"], "logits": parts.to_numpy()})

    return run


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def host_shifts(pages: DataFrame) -> DataFrame:
    """Pages (host, own) with host_rate, the share of spam pages of their host, and shift, how far the logit of the rate of its other pages is from the corpus's."""
    spam = (F.col("own") > 0.5).cast("long")
    total = pages.agg(F.count(F.lit(1)).alias("all_pages"), F.sum(spam).alias("all_spam"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    rates = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum(spam).alias("spam")).select("host", "pages", "spam", salts)
    one = total.first()
    # a corpus without any spam, or with nothing else, has no logit
    mean = F.lit(min(max((one.all_spam or 0) / max(one.all_pages, 1), 1e-3), 1 - 1e-3))
    joined = pages.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(rates, ["host", "salt"])
    others = (F.col("spam") - spam + PRIOR_PAGES * mean) / (F.col("pages") - 1 + PRIOR_PAGES)
    return joined.withColumn("host_rate", F.col("spam") / F.col("pages")).withColumn("shift", _logit(others) - _logit(mean)).drop("salt", "pages", "spam")


def _share(chars: Column) -> Column:
    return F.when(F.col("n_chars") > 0, chars / F.col("n_chars")).otherwise(0.0)


def smoothed(pages: DataFrame, weight: float) -> DataFrame:
    """Pages (n_chars, sizes, logits, shift) with score: the share of characters in segments that are lists once the host's shift is added by its weight."""
    chars = F.aggregate(F.arrays_zip("sizes", "logits"), F.lit(0).cast("bigint"), lambda acc, s: acc + F.when(s["logits"] + F.lit(weight) * F.col("shift") >= 0, s["sizes"]).otherwise(0).cast("bigint"))
    return pages.withColumn("weight", F.lit(weight)).withColumn("score", _share(chars)).drop("sizes", "logits")


def page_scores(documents: DataFrame) -> DataFrame:
    """doc_id, host, n_chars, list_chars, own (share of list characters), host_rate, shift, weight, score (the share once smoothed)."""
    segments_of = materialize(measured(documents))
    sample = materialize(labelled_sample(segments_of))
    rows = sample.toPandas()
    trees = fit(rows)
    pages = materialize(segments_of.mapInPandas(_score(trees), "doc_id bigint, host string, n_chars bigint, list_chars bigint, sizes array<int>, logits array<float>"))
    scored = host_shifts(pages.withColumn("own", _share(F.col("list_chars"))).withColumn("host", F.coalesce("host", F.lit(""))))
    weight = 0.0
    if trees is not None:
        # the sampled segments with the shifts of their pages: as many rows as the sample has
        known = sample.select("doc_id", "k").join(scored.groupBy("doc_id").agg(F.min("shift").alias("shift")), "doc_id").toPandas().drop_duplicates(["doc_id", "k"])
        rows["logit"] = held_out_logits(rows)
        fitted = rows.merge(known, on=["doc_id", "k"]).dropna(subset=["logit", "shift"])
        weight = fit_host_weight(fitted["logit"].to_numpy(), fitted["shift"].to_numpy(), fitted["label"].to_numpy())
    return smoothed(scored, weight)


def spam_pages(documents: DataFrame) -> DataFrame:
    """doc_id of the pages most of whose characters are keyword, link or product lists."""
    return page_scores(documents).filter("score > 0.5").select("doc_id").distinct()
