"""Packing: every token in one container, none too full, little space left."""

import random

import numpy as np
import pytest

from strandlog.llm import packing


def check(rows, lengths, capacity):
    """rows: container, doc_id, piece, first_token, n_tokens."""
    use, covered = {}, {}
    for c, d, piece, first, n in rows:
        use[c] = use.get(c, 0) + n
        covered.setdefault(d, []).append((first, n, piece))
    assert all(0 < v <= capacity for v in use.values())
    for d, total in lengths.items():
        parts = sorted(covered.get(d, []))
        assert sum(n for _, n, _ in parts) == total and [p for *_, p in parts] == list(range(len(parts)))
        at = 0
        for first, n, _ in parts:
            assert first == at and (n == capacity or len(parts) == 1 or at + n == total)
            at += n
        if total <= capacity:
            assert len(parts) <= 1
    return use


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, container string, n_tokens int")


def test_pack_whole_corpus(spark):
    rng = random.Random(1)
    vocabulary = ["apple", "river", "stone", "cloud", "table", "glass", "night", "field"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice((3, 20, 150, 700, 2100, 5000)))) for _ in range(300)] + [None, "", "same text"] + ["same text"]
    encoder = packing.load_encoder(f"{packing.TOKENIZERS}/{packing.RANKS_FILE}")
    lengths = {i: len(encoder.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    rows = [tuple(r) for r in packing.pack(documents(spark, texts), shard_texts=120).collect()]
    use = check(rows, lengths, packing.CAPACITY)
    assert 1 - sum(use.values()) / (len(use) * packing.CAPACITY) < 0.05


def test_exact_capacity_and_empty(spark):
    encoder = packing.load_encoder(f"{packing.TOKENIZERS}/{packing.RANKS_FILE}")
    t = encoder.decode([464] * 64)
    n = len(encoder.encode_ordinary(t))
    rows = [tuple(r) for r in packing.pack(documents(spark, [t, t, t + t]), capacity=n).collect()]
    check(rows, {0: n, 1: n, 2: len(encoder.encode_ordinary(t + t))}, n)
    assert packing.pack(documents(spark, [t]).limit(0)).count() == 0 and packing.pack(documents(spark, [None, ""])).count() == 0


def test_repeated_ids(spark):
    df = documents(spark, ["one two three"]).unionByName(documents(spark, ["one two three"]))
    assert packing.pack(df).count() == 2


@pytest.mark.parametrize("seed", range(4))
def test_shards(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    lengths = rng.integers(1, 2048, n)
    terms = [np.unique(rng.integers(0, 50, rng.integers(1, 20))).astype(np.int32) for _ in range(n)]
    counts = [np.ones(len(t), dtype=np.int16) for t in terms]
    got = packing.pack_shard(lengths, terms, counts, np.ones(50), float(lengths.mean()), 2048)
    fill = np.bincount(got, weights=lengths)
    assert (got >= 0).all() and fill.max() <= 2048 and (fill > 0).all()
    again = packing.by_length(lengths, 2048)
    assert np.bincount(again, weights=lengths).max() <= 2048 and (packing.poor(lengths, got, 2048) == (2048 - fill > packing.TOLERANCE)[got]).all()


def test_neighbours_share_a_container():
    """Two topics, each of texts that fill half a container: a container holds one topic."""
    lengths = np.full(40, 1024)
    terms = [np.array([1, 2, 3], dtype=np.int32) if k % 2 else np.array([7, 8, 9], dtype=np.int32) for k in range(40)]
    got = packing.pack_shard(lengths, terms, [np.ones(3, dtype=np.int16)] * 40, np.ones(10), 1024.0, 2048)
    for c in range(20):
        assert len({int(k) % 2 for k in np.flatnonzero(got == c)}) == 1


def test_gaps():
    lengths = np.array([5, 5, 9, 3])
    g = packing._Gaps(np.array([2, 0, 1, 3]), lengths, 10)
    assert g.longest(10) == 9 and g.longest(8) == 5 and g.longest(2) == 0 and g.longest(0) == 0
    g.take(2, 9)
    assert g.longest(10) == 5
    g.take(g.any_of(5), 5)
    g.take(g.any_of(5), 5)
    assert g.longest(10) == 3


def test_every_neighbour_and_every_term_is_seen():
    """Sixty copies too short for the gap rank before the only neighbour that fills it; in the other half it shares the seed's weakest term."""
    lengths = np.array([60, 40, *[10] * 60, 40])
    terms = [np.arange(30), np.array([60]), *[np.arange(20)] * 60, np.array([29])]
    terms, counts = [t.astype(np.int32) for t in terms], [np.ones(len(t), dtype=np.int16) for t in terms]
    idf = np.concatenate((np.full(20, 5.0), np.linspace(2.0, 1.0, 10), np.ones(31)))
    got = packing.pack_shard(lengths, terms, counts, idf, 12.0, 100)
    assert got[0] == got[62] != got[1]
    few = [0, 1, 62]
    got = packing.pack_shard(lengths[few], [terms[k] for k in few], [counts[k] for k in few], idf, 40.0, 100)
    assert got[0] == got[2] != got[1]


def test_order_of_rows_and_files_does_not_matter(spark):
    """Containers hold the same texts however the input is split; sketches bring copies into one shard."""
    rng = random.Random(8)
    words = [f"word{i}" for i in range(500)]
    topics = [rng.sample(words, 60) for _ in range(12)]
    texts = [" ".join(rng.choices(topics[k % 12], k=rng.choice((40, 90, 200)))) for k in range(240)]
    one = documents(spark, texts)
    other = one.orderBy("text").repartition(7)
    held = []
    for df in (one.coalesce(1), other):
        groups = {}
        for r in packing.pack(df, shard_texts=40).collect():
            groups.setdefault(r.container, set()).add((r.doc_id, r.piece))
        held.append(sorted(map(sorted, groups.values())))
    assert held[0] == held[1]


def test_sketches_agree_with_likeness():
    rng = np.random.default_rng(2)
    same = total = 0
    for _ in range(300):
        a = np.unique(rng.integers(5000, 9000, 80))
        b = np.unique(np.concatenate((a[: len(a) * 3 // 4], rng.integers(5000, 9000, 20))))
        same += sum(x == y for x, y in zip(packing.sketch(a), packing.sketch(b), strict=True))
        total += 3 * len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(same / total - 1) < 0.15 and packing.sketch(np.zeros(0, dtype=np.int32)) == [0, 0, 0] and packing.sketch(np.array([3, 7]))


def test_containers_hold_neighbours(spark):
    """Texts of a container share more rarer terms with its longest than texts drawn at random do, or than packing by length gives."""
    rng = random.Random(9)
    encoder = packing.load_encoder(f"{packing.TOKENIZERS}/{packing.RANKS_FILE}")
    words = [w for w in (encoder.decode([i]) for i in range(8000, 14_000)) if w.startswith(" ") and w[1:].isalpha() and w.isascii()]
    topics = [rng.sample(words, 120) for _ in range(20)]
    texts = ["".join(rng.choices(topics[k % 20], k=rng.randint(200, 900))) for k in range(400)]
    rows = packing.pack(documents(spark, texts), shard_texts=200).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.container, []).append(r.doc_id)
    alike = [x % 20 == y % 20 for g in groups.values() for x in g for y in g if x < y]
    assert sum(alike) / len(alike) > 0.15  # 0.05 by chance
    used = sum(r.n_tokens for r in rows)
    assert 1 - used / (len(groups) * packing.CAPACITY) < 0.03
