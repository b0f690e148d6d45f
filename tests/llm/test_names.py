"""Spellings of one entity."""

import itertools

import pytest

from strandlog.llm import names, nameparse, similarity

PEOPLE = [
    ["Gobézuhart, M. C.", "Gobezuhart, M. C.", "Gobezuhart, M.", "Dr. Michael Gobézuhart", "Mike Gobezuhart", "Gobézuhart MC", "GOBÉZUHART, M. C.", "Michael, Gobézuhart", "Gobzéuhart, Michael", "M. C. Gobézuhart"],
    ["Gobézuhart, R.", "Robert Gobézuhart", "Bob Gobezuhart"],
    ["Kledörulli-Vamitez, E.", "Elizabeth Kledörulli-Vamitez", "Kledoerulli Vamitez, Beth", "Kledörulli, E."],
    ["The Fosivaburg Sequencing and Surveillance Network", "Fosivaburg Seq. & Surveillance Network", "Fosivaburg Sequencing and Surveillance Netwrok"],
    ["Tabrolund, A. B."],
    ["Tabrolund, A. C."],
]
UNITS = [
    ["Institute of Virology, University of Vedrukaport, Vedrukaport", "Inst. of Virology, Univ. Vedrukaport", "IV-UV, Vedrukaport", "Instituto de Virología, Universidad de Vedrukaport", "INSTITUTE OF VIROLOGY, UNIVERSITY OF VEDRUKAPORT", "University of Vedrukaport - Institute of Virology - Vedrukaport", "Institute of Virlogy (University of Vedrukaport)", "Institute of Virology, University of Vedrukport"],
    ["Department of Microbiology, University of Vedrukaport, Vedrukaport 12345", "Dept. Microbiology, Univ. Vedrukaport"],
    ["Institute of Virology, Vedrukaport General Hospital", "Inst. of Virology, Vedrukaport Gen. Hosp., Vedrukaport"],
]


def table(spark):
    rows, truth, i = [], set(), 0
    for kind, groups in (("author", PEOPLE), ("affiliation", UNITS)):
        for g in groups:
            ids = []
            for n in g:
                i += 1
                rows.append((i, kind, n, "PP_1", 5))
                ids.append(i)
            truth |= set(itertools.combinations(ids, 2))
    # given names are known from names without a comma
    for g in ("Michael Sorenel", "Robert Tavinor", "Elizabeth Hanumond"):
        i += 1
        rows.append((i, "author", g, "PP_2", 5))
    return spark.createDataFrame(rows, "name_id long, kind string, name string, accession string, entity int"), truth


def test_links_every_spelling_and_no_other(spark):
    df, truth = table(spark)
    got = set(map(tuple, names.linked_pairs(names.entities(df)).collect()))
    assert got == truth


def test_nulls_blanks_repeats_and_empty(spark):
    rows = [(1, "author", None), (2, "author", " "), (3, "author", "Berg, A."), (4, "author", "Berg, A."), (5, None, "Berg, A."), (6, "affiliation", "??"), (7, "author", "X"), (8, "author", "Holm, B. " + "x" * 20_000)]
    df = spark.createDataFrame(rows, "name_id long, kind string, name string")
    assert set(map(tuple, names.linked_pairs(names.entities(df)).collect())) == {(3, 4)}
    assert names.entities(df.limit(0)).count() == 0


def test_order_of_given_and_surname():
    one, turned = nameparse.parse_person("Michael, Gobézuhart")
    assert one["core"] == nameparse.fold("Michael") and turned["core"] == "gobezuhart" and turned["gate"] == "m"
    assert nameparse.parse_person("Berg, A. B.")[1] is None
    assert nameparse.parse_person("Dr. Ann B. Berg")[0]["middle"] == "b"


def test_collision_curve():
    j = similarity.typo_jaccard(names.CORE_LENGTH)
    bands = similarity.bands_for(names.RECALL, j, names.ROWS)
    assert similarity.collision_probability(j, names.ROWS, bands) >= names.RECALL > similarity.collision_probability(j, names.ROWS, bands - 1)


def test_recall_of_banding_against_brute_force():
    """Single edits of names as long as the curve is tuned for share a band."""
    import random

    rng = random.Random(3)
    hasher = similarity.MinHash(names.ROWS, names.bands_at(names.CORE_LENGTH))
    keys = lambda t: set(hasher.keys(t, "", names.bands_at(max(len(t), names.CORE_LENGTH))))
    assert names.bands_at(8) > names.bands_at(12) > names.bands_at(20)
    found = total = 0
    for _ in range(400):
        w = "".join(rng.choice("abdefgiklmnoprstuvz") for _ in range(rng.randint(names.CORE_LENGTH, 20)))
        k = rng.randrange(len(w) - 1)
        edits = [w[:k] + w[k + 1 :], w[:k] + rng.choice("aeiou") + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + "x" + w[k + 1 :]]
        for e in edits:
            assert similarity.within_one_edit(w, e) == (similarity.edit_distance(w, e) <= 1)
            total += 1
            found += bool(keys(w) & keys(e)) or len(e) < names.CORE_LENGTH
    assert found / total >= 0.998


@pytest.mark.parametrize(("a", "b", "d"), [("", "", 0), ("abc", "acb", 1), ("abcd", "acbe", 2), ("a", "", 1), ("kitten", "sitting", 3)])
def test_edit_distance(a, b, d):
    assert similarity.edit_distance(a, b) == d and similarity.within_one_edit(a, b) == (d <= 1)


def test_star_clusters(spark):
    v = spark.createDataFrame([(i, w) for i, w in ((1, 9), (2, 1), (3, 1), (4, 5), (5, 1), (6, 1), (7, 2), (8, 2))], "id long, weight long")
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (7, 8)], "a long, b long")
    got = {r.id: r.centre for r in names.star_clusters(v, e).collect()}
    assert got == {1: 1, 2: 1, 4: 4, 3: 4, 5: 4, 7: 7, 8: 7}


def test_long_chains_end_in_few_rounds(spark, monkeypatch):
    """A chain of falling ranks as long as it may be: every vertex is placed once, by its own star."""
    from strandlog.llm import names as module

    n, written = 400, []
    monkeypatch.setattr(module, "RANKED_ROUNDS", 3)
    keep = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: written.append(1) or keep(df))
    v = spark.createDataFrame([(i, 10_000 - i) for i in range(n)], "id long, weight long")
    e = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    got = {r.id: r.centre for r in names.star_clusters(v, e).collect()}
    assert set(got) == set(range(n)) and all(abs(i - c) <= 1 and got[c] == c for i, c in got.items()) and len(written) < 40


def test_recall_of_linking_at_every_length(spark):
    """Single edits of cores from 3 letters up link; two edits do not."""
    import random

    rng = random.Random(5)
    rows, lengths = [], []
    for _ in range(300):
        w = "".join(rng.choice("abdefgiklmnoprstuvz") for _ in range(rng.randint(names.LEAST_LENGTH, 12)))
        k = rng.randrange(len(w) - 1)
        edits = [w[:k] + rng.choice("aeiou") + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + "x" + w[k + 1 :], w[:k] + w[k + 1 :]]
        for e in edits[: 3 + (len(w) > names.LEAST_LENGTH)]:
            lengths.append(min(len(w), len(e)))
            rows += [(len(rows) + j, "author", "person", t, f"g{len(lengths)}", [t], [t]) for j, t in enumerate((w, e, "xx" + w + "xx"))]
    assert min(lengths) == 3
    got = {(r.a, r.b) for r in names.link_forms(spark.createDataFrame(rows, "id long, kind string, cls string, core string, gate string, tokens array<string>, raws array<string>")).collect()}
    same = {i for i in range(len(lengths)) if rows[3 * i][3] == rows[3 * i + 1][3]}
    missed = [n for i, n in enumerate(lengths) if (3 * i, 3 * i + 1) not in got and i not in same]
    assert all(n >= names.CORE_LENGTH for n in missed) and len(missed) <= len(lengths) // 100
    assert all((a % 3, b - a) == (0, 1) for a, b in got)


def test_typos_that_make_or_break_a_transliteration(spark):
    """An edit beside ae, oe or ue is one edit in the text as written, though two in the folded one."""
    pairs = [("Ravuruque, O.", "Ravuruuqe, O."), ("Dogiduwen, Y.", "Dogiduen Y"), ("Kefivüque, Q.", "Kefivüqye, Q."), ("Bepukevey, T.", "Bepkuevey, T."), ("Baguratez, F.", "Baguraez F")]
    rows = [(2 * i + k, "author", n) for i, p in enumerate(pairs) for k, n in enumerate(p)]
    got = set(map(tuple, names.linked_pairs(names.entities(spark.createDataFrame(rows, "name_id long, kind string, name string"))).collect()))
    assert got == {(2 * i, 2 * i + 1) for i in range(len(pairs))}


def test_large_entities_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(names, "PAIRS_OF", 10)
    rows = [(i, "author", "big") for i in range(95)] + [(100 + i, "author", "small") for i in range(3)] + [(200, "affiliation", "big")]
    got = sorted(map(tuple, names.linked_pairs(spark.createDataFrame(rows, "name_id long, kind string, entity string")).collect()))
    assert got == sorted([*itertools.combinations(range(95), 2), *itertools.combinations(range(100, 103), 2)])


def test_typos_of_short_surnames(spark):
    rows = [(1, "author", "Santos, M."), (2, "author", "Snatos, M."), (3, "author", "Lee, K."), (4, "author", "Leee, K."), (5, "author", "van Berg, T."), (6, "author", "vna Berg, T."), (7, "author", "Santos, R."), (8, "author", "Soares, M."), (9, "author", "Li, W."), (10, "author", "W. Li"), (11, "author", "Lu, W.")]
    got = set(map(tuple, names.linked_pairs(names.entities(spark.createDataFrame(rows, "name_id long, kind string, name string"))).collect()))
    assert got == {(1, 2), (3, 4), (5, 6), (9, 10)}


def test_misspelt_given_names_part_no_entity(spark):
    """A typo in a given name stays with its name; clearly different given names, also listed ones an edit apart, part the entity."""
    same = ["Maria Gobezuhart", "Maria Gobezuhart", "Mraia Gobezuhart", "Gobezuhart, M."]
    other = ["Daniel Tabrolund", "Daneil Tabrolund", "Dolores Tabrolund"]
    listed = ["Francisco Kledoruli", "Francis Kledoruli", "Daniela Vamitez", "Daniel Vamitez"]
    rows = [(i, "author", n) for i, n in enumerate(same + other + listed)]
    got = set(map(tuple, names.linked_pairs(names.entities(spark.createDataFrame(rows, "name_id long, kind string, name string"))).collect()))
    assert got == set(itertools.combinations(range(4), 2)) | {(4, 5)}
