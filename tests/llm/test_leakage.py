"""The FM-index against plain search, and leaked items against brute force."""

import json
import random

import numpy as np
import pytest

from strandlog.llm import leakage
from strandlog.llm.fmindex import FMIndex, WaveletMatrix, suffix_array


@pytest.mark.parametrize("sigma", [1, 2, 5, 300])
def test_index_equals_plain_search(sigma):
    rng = np.random.default_rng(sigma)
    for n in (1, 2, 7, 64, 900):
        s = rng.integers(0, sigma, n).astype(np.int32)
        if n == 900:
            s[300:600] = s[:300]  # a long repeat
        assert list(suffix_array(s)) == sorted(range(n), key=lambda i: tuple(s[i:]))
        w = WaveletMatrix(s, sigma)
        at = rng.integers(0, n + 1, 50)
        c = rng.integers(0, sigma, 50)
        assert list(w.rank(c, at)) == [int((s[:a] == x).sum()) for a, x in zip(at, c, strict=True)]
        assert list(w.access(np.arange(n))) == list(s)
        f = FMIndex(s, sigma, sample=4)
        for length in (1, 3):
            pats = rng.integers(0, sigma, (20, length))
            lo, hi = f.search(pats)
            for p, a, b in zip(pats, lo, hi, strict=True):
                assert sorted(f.locate(np.arange(a, b))) == [i for i in range(n - length + 1) if tuple(s[i : i + length]) == tuple(p)]


def test_empty_sequence():
    f = FMIndex(np.zeros(0, dtype=np.int32), 3)
    lo, hi = f.search(np.array([[1, 2]]))
    assert list(hi - lo) == [0]


WORDS = [f"w{i}" for i in range(400)]


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, question string, answer string")


def docs_table(spark, docs):
    return spark.createDataFrame([(i, t, lay, "r") for i, (t, lay) in enumerate(docs)], "doc_id long, text string, layout string, item_id string")


def found(spark, docs, items):
    return {tuple(r) for r in leakage.leaked_items(docs_table(spark, docs), items_table(spark, items)).collect()}


def test_forms_that_do_not_matter(spark):
    q = "The clockmaker's apprentice of Vedruka labels 26 left-handed silver buttons, and stacks 93 of them on day 947 for Élise"
    plain = q.split()
    quoted = "> " + "\n> ".join(" ".join(plain[i : i + 5]) for i in range(0, len(plain), 5))
    comment = "\n".join("# " + " ".join(plain[i : i + 6]) for i in range(0, len(plain), 6))
    prompt = 'ask("' + "\\n".join(" ".join(plain[i : i + 6]) for i in range(0, len(plain), 6)) + '")'
    split = json.dumps({"cells": [{"cell_type": "markdown", "source": " ".join(plain[:9])}, {"cell_type": "code", "source": "pass", "outputs": []}, {"cell_type": "markdown", "source": " ".join(plain[9:])}]})
    apart = json.dumps({"cells": [{"cell_type": "markdown", "source": " ".join(plain[:9])}, {"cell_type": "code", "source": "frame = read()", "outputs": []}, {"cell_type": "markdown", "source": " ".join(plain[9:])}]})
    docs = [
        (q, None), (q.upper(), "console"), (q.lower().replace(",", "").replace("é", "e"), "console"), (quoted, "console"), ("# %%\n" + comment, "percent"), (json.dumps({"cells": [{"cell_type": "code", "source": prompt}]}), "ipynb"),
        ("<div>" + q.replace(" ", "<br/>", 3) + "</div>", "console"), (split, "ipynb"), (apart, "ipynb"), (q.replace("left-handed", "left handed").replace("clockmaker's", "clockmaker’s"), "console"), ("nothing of it", "console"), (None, None), ("", "ipynb"),
    ]
    assert found(spark, docs, [(5, q, None), (6, "too short", ""), (None, q, q)]) == {(i, 5) for i in range(10)}


def test_windows_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(10, 60))), " ".join(rng.choices(WORDS, k=30))) for i in range(25)]
    docs, expected = [], set()
    for d in range(300):
        i, q, a = rng.choice(items)
        w = rng.choice((q, a)).split()
        k = rng.randint(0, max(0, len(w) - 5))
        part = w[k : k + rng.randint(5, 30)]
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            part[rng.randrange(len(part))] = rng.choice(("zzz", "w7", "Zz"))
        docs.append((" ".join(rng.choices(WORDS + ["other"] * 50, k=10) + part + rng.choices(WORDS, k=10)), None))
    for d, (t, _) in enumerate(docs):
        words = t.lower().split()
        for i, q, a in items:
            for text in (q.split(), a.split()):
                hit = any(sum(x != y for x, y in zip(words[p : p + 15], text[o : o + 15], strict=True)) <= 1 for p in range(len(words) - 14) for o in range(len(text) - 14))
                if hit:
                    expected.add((d, i))
    got = found(spark, docs, items)
    assert got == expected and 50 < len(got) < 300


def test_spans_merge(spark):
    q = " ".join(WORDS[:40])
    docs = [(f"x y {q} z", None), (q + " " + q, None)]
    rows = sorted(tuple(r) for r in leakage.removal_spans(docs_table(spark, docs), items_table(spark, [(1, q, q)])).collect())
    assert rows == [(0, 1, 0, 2, 41), (1, 1, 0, 0, 79)] or rows == [(0, 1, 0, 2, 41), (1, 1, 0, 0, 39), (1, 1, 0, 40, 79)]


def test_long_document_and_small_shards(spark, monkeypatch):
    q = " ".join(WORDS[100:130])
    docs = [("filler words here " * 60_000 + q, None), (q, None), ("w1 " * 50_000, None)]
    assert found(spark, docs, [(1, q, None)]) == {(0, 1), (1, 1)}


def test_bounds_and_empty_tables(spark, monkeypatch):
    assert found(spark, [("a", None)], [(1, "short", None)]) == set()
    one = docs_table(spark, [("a", None)])
    assert leakage.leaked_items(one.limit(0), items_table(spark, [(1, " ".join(WORDS), None)])).count() == 0
    assert leakage.leaked_items(one.drop("layout"), items_table(spark, [(1, " ".join(WORDS), None)])).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(WORDS, k=30)), None) for i in range(40)]
    docs = [(" ".join(rng.choices(WORDS, k=8)) + " " + q + " tail", None) for _, q, _ in items]
    whole = found(spark, docs, items)
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 1000)
    assert found(spark, docs, items) == whole == {(i, i) for i in range(40)}


def test_many_distinct_words_of_items_and_documents():
    """More words than 16 bits hold, in the items and in a shard."""
    import pandas as pd

    words = [f"x{i}y" for i in range(160_000)]
    items = leakage.ItemPhrases([(i, " ".join(words[20 * i : 20 * i + 20])) for i in range(4000)])
    assert len(items.code) == 80_000
    texts = [" ".join(words[20 * i : 20 * i + 20]) for i in (0, 1777, 3999, 5000)] + [" ".join(words)]
    got = pd.concat(leakage._search(items, False)(iter([pd.DataFrame({"doc_id": range(5), "text": texts})])))
    assert {(r.doc_id, r.item_id) for r in got.itertuples()} == {(0, 0), (1, 1777), (2, 3999)} | {(4, i) for i in range(4000)}


def test_items_that_share_an_opening():
    """A phrase of 5,000 items costs an occurrence only the items that go on like it."""
    import time

    import pandas as pd

    rng = random.Random(4)
    opening = WORDS[:9]
    tails = [[f"t{rng.randrange(300)}" for _ in range(20)] for _ in range(5000)]
    items = leakage.ItemPhrases([(i, " ".join(opening + t)) for i, t in enumerate(tails)])
    texts = [" ".join(opening + tails[i]) if i % 10 == 0 else " ".join(opening + rng.choices(WORDS, k=20)) for i in range(2000)]
    began = time.time()
    got = pd.concat(leakage._search(items, False)(iter([pd.DataFrame({"doc_id": range(2000), "text": texts})])))
    assert {(r.doc_id, r.item_id) for r in got.itertuples()} == {(i, i) for i in range(0, 2000, 10)} and time.time() - began < 20


def test_passages_across_cells_left_out(spark):
    """Code between prose cells, and output between code cells, part no passage, however many there are."""
    q = " ".join(WORDS[10:40])
    w = q.split()
    code = {"cell_type": "code", "source": "frame = read(path)", "outputs": [{"text": "12 rows were read"}]}
    prose = json.dumps({"cells": [c for k in range(0, 30, 5) for c in ({"cell_type": "markdown", "source": " ".join(w[k : k + 5])}, code)]})
    comments = json.dumps({"cells": [{"cell_type": "code", "source": "# " + " ".join(w[k : k + 10]), "outputs": [{"text": "12"}]} for k in (0, 10, 20)]})
    assert found(spark, [(prose, "ipynb"), (comments, "ipynb"), (json.dumps({"cells": [code] * 3}), "ipynb")], [(1, q, None)]) == {(0, 1), (1, 1)}
    spans = sorted(tuple(r) for r in leakage.removal_spans(docs_table(spark, [(prose, "ipynb"), (comments, "ipynb")]), items_table(spark, [(1, q, None)])).collect())
    assert spans == [(0, 1, 1, 0, 29), (1, 1, 2, 0, 29)]
