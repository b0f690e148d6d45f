"""Fixed-capacity containers filled with texts that belong together: lexical retrieval packing.

Texts are measured in tokens of a public tokenizer, whose vocabulary file is a parameter. A text longer
than a container fills whole containers of its own with its first tokens; only its rest is packed. The
others are never split.

Texts are sorted by MinHash sketches of their rarer tokens, so that those which share terms stand together, and cut
into shards of ``SHARD_TEXTS`` by their rank; the order depends on the rows alone, not on files or partitions. Each shard holds an inverted index over token ids with BM25
weights (document frequencies and mean length are counted over all texts). The longest unused text
opens a container and is the query, with all its distinct terms. Of all unused texts that share a term with it,
the best match goes in that hardly any longer text would outdo in filling the space, again and again until the
container is full; a text that shares none goes in only where no match fits. Long texts open containers first,
so short ones remain for the gaps. Containers that still have space are emptied: the texts of all shards' poor
containers are packed again by length, in groups of bounded size. At scale 0.1 seven of ten texts stay where retrieval put them.

Defined results: null and empty texts have no tokens and are in no container; repeated rows are packed each;
ties are broken by rank; a text of exactly the capacity is alone in its container.
"""

from __future__ import annotations

import base64
import hashlib
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.session import materialize

CAPACITY = 2048
#: texts of a shard; a shard is one task's group
SHARD_TEXTS = 4000
#: token ids below this are frequent pieces of words, as ranks follow frequency; sketches leave them out
COMMON_TOKENS = 4000
#: folder of the tokenizers' files, and the file of byte-pair ranks
TOKENIZERS = os.environ.get("STRANDLOG_TOKENIZERS", "/opt/tokenizers")
RANKS_FILE = "byte_bpe_50k.tiktoken"
BM25_K1, BM25_B = 1.2, 0.75
#: containers with more unused tokens than this are emptied and filled again by length alone
TOLERANCE = 24
#: a match must be at least so long, as a share of the longest unused text that fits; nearer 1 wastes less space
KEEP_SHORT = 0.6
# fixed value: how byte-pair encoders of this kind cut a text into words
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_encoder(path: str):
    """A tiktoken encoder from a file of base64 tokens with their ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


_SKETCH = np.random.default_rng(6).integers(1, 2**32, (2, 3), dtype=np.uint64)


def sketch(terms: np.ndarray) -> list[int]:
    """Three minima of the hashed rarer terms (of all terms where none is rare); texts share each with the chance of their Jaccard likeness."""
    rare = terms[terms >= COMMON_TOKENS]
    t = (rare if len(rare) else terms).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (t[:, None] * (_SKETCH[0] | np.uint64(1)) + _SKETCH[1]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    return h.min(axis=0).astype(np.int64).tolist() if len(t) else [0, 0, 0]


_MEASURED = "doc_id bigint, tie bigint, n_tokens bigint, k1 bigint, k2 bigint, k3 bigint, terms array<int>, counts array<smallint>"


def _measure(path: str, capacity: int):
    """mapInPandas: (doc_id, text) to ``_MEASURED``: a hash of the text, token counts, and the sketch and the distinct token ids with their counts of the part that is packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder(path)
        for b in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in _MEASURED.split(", ")}
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.array(encoder.encode_ordinary(text), dtype=np.int32) if text else np.zeros(0, dtype=np.int32)
                if not len(ids):
                    continue
                rest = ids[len(ids) // capacity * capacity :]
                terms, counts = np.unique(rest, return_counts=True)
                tie = int.from_bytes(hashlib.blake2b(ids.tobytes(), digest_size=8).digest(), "little", signed=True)
                for c, v in zip(out, (doc_id, tie, len(ids), *sketch(terms), terms, counts.astype(np.int16)), strict=True):
                    out[c].append(v)
            yield pd.DataFrame({c: pd.Series(v, dtype=object) if c in ("terms", "counts") else pd.array(v, dtype="Int64") for c, v in out.items()})

    return run


def _parts(shards: int) -> int:
    """Partitions for shards: one each, of very many some together."""
    return min(shards, 400 + shards // 8)


def ranked(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Rows with row, their rank by keys from 0. Equal rows are interchangeable, so the ranks do not depend on how rows are partitioned."""
    placed = materialize(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    # one row per partition of the sort
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return placed.withColumn("__part", part).join(before, "__part").withColumn("row", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


class _Gaps:
    """The unused texts of a shard by length; a big integer has a bit for every length at hand."""

    def __init__(self, order: np.ndarray, lengths: np.ndarray, capacity: int) -> None:
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        for t in order[::-1]:
            self.stacks[lengths[t]].append(int(t))
        self.left = [len(s) for s in self.stacks]
        self.used = np.zeros(len(lengths), dtype=bool)
        self.mask = sum(1 << k for k, n in enumerate(self.left) if n)

    def take(self, t: int, length: int) -> None:
        self.used[t] = True
        self.left[length] -= 1
        if not self.left[length]:
            self.mask &= ~(1 << length)

    def any_of(self, length: int) -> int:
        """An unused text of a length at hand."""
        stack = self.stacks[length]
        while self.used[stack[-1]]:
            stack.pop()
        return stack[-1]

    def longest(self, room: int) -> int:
        """The greatest length at hand of at most ``room``, 0 if none."""
        return (self.mask & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 and self.mask & ((1 << (room + 1)) - 1) else 0


def pack_shard(lengths: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, mean_length: float, capacity: int) -> np.ndarray:
    """The container (from 0) of each text of a shard, in the order of filling; lengths are from 1 to capacity - 1."""
    n = len(lengths)
    # texts by length, so that those of a range of lengths and their terms stand together
    rising = np.lexsort((np.arange(n), lengths))
    place = np.empty(n, dtype=np.int64)
    place[rising] = np.arange(n)
    sizes = np.array([len(terms[t]) for t in rising], dtype=np.int64)
    flat = np.concatenate([terms[t] for t in rising]).astype(np.int64) if n else np.zeros(0, dtype=np.int64)
    tf = np.concatenate([counts[t] for t in rising]).astype(np.float64) if n else np.zeros(0)
    weight = idf[flat] * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * np.repeat(lengths[rising], sizes) / max(mean_length, 1.0)))
    start = np.concatenate(([0], np.cumsum(sizes)))
    by_size = lengths[rising]
    asked = np.zeros(len(idf))  # 1 at the terms of the seed
    order = np.lexsort((np.arange(n), -lengths))
    gaps = _Gaps(order, lengths, capacity)
    used, container, opened = gaps.used, np.full(n, -1, dtype=np.int64), 0
    shortest = int(lengths.min()) if n else 0

    def put(t: int) -> int:
        container[t] = opened
        gaps.take(t, int(lengths[t]))
        return int(lengths[t])

    for seed in order:
        if used[seed]:
            continue
        room = capacity - put(int(seed))
        mine = flat[start[place[seed]] : start[place[seed] + 1]]
        asked[mine] = 1.0
        while room >= shortest and (length := gaps.longest(room)):
            # short texts are kept for the last gaps: a match goes in if few longer texts would fit
            a, b = np.searchsorted(by_size, KEEP_SHORT * length), np.searchsorted(by_size, room, side="right")
            scores = np.add.reduceat(weight[start[a] : start[b]] * asked[flat[start[a] : start[b]]], start[a:b] - start[a])
            scores[used[rising[a:b]]] = 0.0
            best = scores.max()
            room -= put(int(rising[a:b][scores == best].min()) if best > 0.0 else gaps.any_of(length))
        asked[mine] = 0.0
        opened += 1
    return container


def by_length(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best fit by falling length: the longest unused text opens a container, the longest that fits comes next."""
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    gaps = _Gaps(order, lengths, capacity)
    container, opened = np.full(len(lengths), -1, dtype=np.int64), 0
    for seed in order:
        if gaps.used[seed]:
            continue
        t, room = int(seed), capacity
        while True:
            gaps.take(t, int(lengths[t]))
            container[t] = opened
            room -= int(lengths[t])
            length = gaps.longest(room)
            if not length:
                break
            t = gaps.any_of(length)
        opened += 1
    return container


def poor(lengths: np.ndarray, container: np.ndarray, capacity: int) -> np.ndarray:
    """Whether each text is in a container with more than ``TOLERANCE`` unused tokens."""
    return (capacity - np.bincount(container, weights=lengths) > TOLERANCE)[container] if len(lengths) else np.zeros(0, dtype=bool)


_PACKED = "shard bigint, slot bigint, poor boolean, doc_id bigint, row bigint, first_token bigint, n_tokens bigint"


def _pack(idf: np.ndarray, mean_length: float, capacity: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", kind="stable").reset_index(drop=True)
        lengths = (group["n_tokens"] % capacity).to_numpy(dtype=np.int64)
        got = pack_shard(lengths, [np.asarray(t) for t in group["terms"]], [np.asarray(c) for c in group["counts"]], idf, mean_length, capacity)
        return pd.DataFrame({
            "shard": int(key[0]), "slot": got, "poor": poor(lengths, got, capacity), "doc_id": group["doc_id"].astype("Int64"), "row": group["row"],
            "first_token": group["n_tokens"].to_numpy() - lengths, "n_tokens": lengths,
        })

    return run


def _fill(capacity: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", kind="stable").reset_index(drop=True)
        return group.assign(shard=int(key[0]), slot=by_length(group["n_tokens"].to_numpy(dtype=np.int64), capacity), doc_id=group["doc_id"].astype("Int64"))[[c.split()[0] for c in _PACKED.split(", ")]]

    return run


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizers: str = TOKENIZERS, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """container, doc_id, piece, first_token, n_tokens: every token of every text in exactly one container.

    piece numbers the parts of one text from 0; only texts longer than the capacity have more than one.
    """
    if capacity > 1 << 15:
        raise ValueError("a container holds at most 32,768 tokens, as counts of a term are kept in 16 bits")
    path = os.path.join(tokenizers, RANKS_FILE)
    measured = materialize(documents.select("doc_id", "text").mapInPandas(_measure(path, capacity), _MEASURED))
    rows = ranked(measured, ["k1", "k2", "k3", "tie", "doc_id"], _parts(max(1, math.ceil(measured.count() / shard_texts)))).drop("k1", "k2", "k3", "tie")
    rest = rows.filter(F.col("n_tokens") % capacity > 0)
    packable = measured.filter(F.col("n_tokens") % capacity > 0)
    total = packable.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("n_tokens") % capacity).alias("mean")).first()
    frequency = packable.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    df = frequency.toPandas()  # at most one row per id of the tokenizer's fixed vocabulary
    top = int(df["t"].max()) + 1 if len(df) else 1
    seen = np.zeros(top)
    seen[df["t"].to_numpy(dtype=np.int64)] = df["df"].to_numpy()
    idf = np.log(1.0 + (total.n - seen + 0.5) / (seen + 0.5))
    shards = max(1, math.ceil(total.n / shard_texts))
    packed = rest.withColumn("shard", F.floor(F.col("row") / shard_texts)).repartition(_parts(shards), "shard").groupBy("shard").applyInPandas(_pack(idf, float(total.mean or 1.0), capacity), _PACKED)
    packed = materialize(packed)
    groups = max(1, math.ceil(packed.filter("poor").count() / shard_texts))
    refilled = packed.filter("poor").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("shard").applyInPandas(_fill(capacity), _PACKED)
    named = lambda df, mark: df.select(F.concat_ws("-", F.lit(mark), "shard", "slot").alias("container"), "doc_id", F.floor(F.col("first_token") / capacity).alias("piece"), "first_token", "n_tokens")
    shared = named(packed.filter("not poor"), "s").unionByName(named(refilled, "f"))
    whole = rows.filter(F.col("n_tokens") >= capacity).select(
        "row", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n_tokens") / capacity) - 1)).alias("piece")
    )
    own = whole.select(F.concat_ws("-", F.lit("w"), "row", "piece").alias("container"), "doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n_tokens"))
    return own.unionByName(shared)
