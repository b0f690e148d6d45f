"""Trees, features, and pages of lists against pages of prose."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlog.llm import spam
from strandlog.llm.trees import BaggedTrees

PROSE = "The model was fitted to the data before the season ended. We start with the first part of the table, and then we take logs. It is not the same as what was read in the other file."
KEYS = ["cheap lamp", "buy lamp online", "best lamp deal", "lamp sale", "free lamp shipping", "discount chair", "chair review", "online chair offer"]


def keyword_text(rng, n=60):
    return ", ".join(rng.choices(KEYS, k=n))


def link_text(rng, n=20):
    return "\n".join(f"https://{rng.choice('abc')}-shop{rng.randint(1, 99)}.example/{rng.choice(KEYS).replace(' ', '-')}" for _ in range(n))


def product_text(rng, n=15):
    return "\n".join(f"Lamp Deal ZX-{rng.randint(100, 999)} colour red SKU {rng.randint(10**4, 10**6)} {rng.randint(9, 99)}.99" for _ in range(n))


def corpus(rng):
    rows, spam_ids = [], set()
    code = "for i in range(10):\n    df.step(lr=0.1)\n    print(i, df.loss())"
    table = "\n".join(f"{i}  {rng.random() * 900:.3f}  {rng.random() * 900:.3f}" for i in range(30))
    for i in range(240):
        kind = i % 8
        if kind == 0:
            body, is_spam = rng.choice((keyword_text, link_text, product_text))(rng), True
        elif kind == 1:
            part = keyword_text(rng, 30)
            body, is_spam = part + "\n\n" + (PROSE + " ") * (2 + len(part) // len(PROSE)), False
        elif kind == 2:
            body, is_spam = f"{PROSE}\n\nIn [1]:\n{code}\n\nOut[1]:\n{table}", False
        elif kind == 3:
            body, is_spam = "* " + PROSE + " <https://docs.example/a>\n* " + PROSE + " <https://docs.example/b>", False
        elif kind == 4:
            body, is_spam = "In [1]:\n" + "\n".join("# " + k for k in rng.choices(KEYS, k=25)), True
        else:
            body, is_spam = "\n\n".join([PROSE] * rng.randint(1, 4)), False
        rows.append((i, body, "console", f"own{i % 17}/r{i}", True))
        if is_spam:
            spam_ids.add(i)
    return rows, spam_ids


COLUMNS = "doc_id long, text string, layout string, repo string, host boolean"


def test_pages(spark):
    rows, expected = corpus(random.Random(2))
    got = {r.doc_id for r in spam.spam_pages(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == expected


def test_nulls_empty_repeats(spark):
    rng = random.Random(3)
    rows, _ = corpus(rng)
    k = keyword_text(rng, 200)
    rows += [(900, None, None, None, None), (901, "", "ipynb", None, None), (902, k, None, None, None), (902, k, None, None, None), (903, k * 50, "other", "a/b", None), (None, k, None, None, None)]
    got = [r.doc_id for r in spam.spam_pages(spark.createDataFrame(rows, COLUMNS)).collect()]
    assert {902, 903} <= set(got) and not {900, 901, None} & set(got) and len(got) == len(set(got))
    assert spam.spam_pages(spark.createDataFrame(rows, COLUMNS).limit(0)).count() == 0


def test_without_both_labels_the_weak_ones_decide(spark):
    df = spark.createDataFrame([(1, link_text(random.Random(1)), None, None, None)], COLUMNS)
    with pytest.warns(UserWarning, match="one kind"):
        assert spam.fit(spam.labelled_sample(spam.measured(df)).toPandas()) is None
    with pytest.warns(UserWarning, match="one kind"):
        assert [r.doc_id for r in spam.spam_pages(df).collect()] == [1]
    assert spam.spam_pages(df.select("doc_id", "text")).count() == 1


def test_trees_find_a_kind_of_list_that_no_rule_names(spark, monkeypatch):
    """Keywords that never repeat have no rule: the trees find the pages, the rules alone none."""
    rng = random.Random(6)
    rows, expected = corpus(rng)
    letters = "bcdfghklmnprstv"
    word = lambda: "".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    for i in range(1000, 1012):
        text = ", ".join(f"{word()} {word()}" for _ in range(50))
        assert spam.weak_label("markdown", text, spam.features("markdown", text)) == -1
        rows.append((i, text, "console", f"own{i % 17}/r{i}", True))
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r.doc_id for r in spam.spam_pages(df).collect()}
    assert {i for i in got if i < 1000} == expected and len([i for i in got if i >= 1000]) >= 10
    monkeypatch.setattr(spam, "fit", lambda rows: None)
    assert {r.doc_id for r in spam.spam_pages(df).collect()} == expected


def test_host_rates_turn_doubtful_pages_only(spark):
    """Doubtful pages follow their host by a weight that labelled segments teach; sure pages stay."""
    rows = [(i, "bad", 100, 100, [100], [4.0]) for i in range(30)] + [(100 + i, "good", 100, 0, [100], [-4.0]) for i in range(300)]
    rows += [(500, "bad", 100, 0, [100], [-0.5]), (501, "good", 100, 100, [100], [0.5]), (502, "bad", 100, 0, [100], [-4.0]), (503, "good", 100, 100, [100], [4.0])]
    df = spark.createDataFrame(rows, "doc_id long, host string, n_chars long, list_chars long, sizes array<int>, logits array<float>").withColumn("own", F.col("list_chars") / F.col("n_chars"))
    shifted = spam.host_shifts(df)
    rng = np.random.default_rng(1)
    shift = np.where(rng.random(4000) < 0.5, 4.0, -1.5)
    label = (rng.random(4000) < 1 / (1 + np.exp(-0.7 * shift))).astype(int)
    weight = spam.fit_host_weight(np.zeros(4000), shift, label)
    assert 0.5 < weight < 0.8 and spam.fit_host_weight(np.zeros(4000), rng.permutation(shift), label) < 0.1
    score = {r.doc_id: r.score for r in spam.smoothed(shifted, weight).collect()}
    assert (score[500], score[501], score[502], score[503]) == (1.0, 0.0, 0.0, 1.0)
    none = {r.doc_id: r.score for r in spam.smoothed(shifted, 0.0).collect()}
    assert (none[500], none[501]) == (0.0, 1.0) and len(score) == len(rows)


def test_trees_learn_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 1] > 0.3) & (x[:, 3] < 0.5)).astype(int)
    t = BaggedTrees.fit(x[:2000], y[:2000])
    assert ((t.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert len(t.predict(np.zeros((0, 5)))) == 0
    same = BaggedTrees.fit(x[:2000], y[:2000])
    assert np.array_equal(t.predict(x), same.predict(x))


def test_segments_split_comments_from_code():
    text = "# %%\n# a b\n# c\nx = 1\n# d"
    assert spam.segments(text, "percent") == [("code", "# a b\n# c"), ("code", "x = 1"), ("code", "# d")]
