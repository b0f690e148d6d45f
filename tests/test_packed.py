"""The quote-aware tokenizer and the operator around it."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlog.functions.tokenizer import split_packed
from strandlog.operators.packed import explode_packed


@pytest.mark.parametrize(
    ("text", "items"),
    [
        (None, None),
        ("", []),
        ("  ;;  ", []),
        ("Berg, A.", ["Berg, A."]),
        ("Berg, A.; Holm, B. C.;", ["Berg, A.", "Holm, B. C."]),
        ("Berg, A.; ; Holm, B.", ["Berg, A.", "Holm, B."]),
        ("Berg, A. || Holm B|Vik C", ["Berg, A.", "Holm B", "Vik C"]),
        ("Berg, A.\r\nHolm, B.\tVik C", ["Berg, A.", "Holm, B.", "Vik C"]),
        ("Berg, A. / Holm, B.", ["Berg, A.", "Holm, B."]),
        ('"Berg, A.","Holm, B."', ["Berg, A.", "Holm, B."]),
        ('"Berg, A."; "Holm; B."', ["Berg, A.", "Holm; B."]),
        ('"A ""x"" B"; C', ['A "x" B', "C"]),
        (r'"A \"x\" B"; C', ['A "x" B', "C"]),
        ("“Berg; A.”; C", ["Berg; A.", "C"]),
        ('Robert "Bob; y" X', ['Robert "Bob', 'y" X']),
        ('"never closed; B', ['"never closed', "B"]),
        ("(1) Berg, A. (2) Holm, B.", ["Berg, A.", "Holm, B."]),
        ("1. Berg, A.; 2. Holm, B.", ["Berg, A.", "Holm, B."]),
        ("1. Berg, A.\n2. Holm, B.", ["Berg, A.", "Holm, B."]),
        ("Berg, A., Holm, B. C., Vik, D.", ["Berg, A.", "Holm, B. C.", "Vik, D."]),
        ("Ann Berg, Bo Holm & Cy Vik", ["Ann Berg", "Bo Holm", "Cy Vik"]),
        ("Ann Berg, and Bo Holm", ["Ann Berg", "Bo Holm"]),
        ("Bo Holm & The Oslo Sequencing and Surveillance Network", ["Bo Holm", "The Oslo Sequencing and Surveillance Network"]),
        ("Oslo Seq. & Surveillance Network", ["Oslo Seq. & Surveillance Network"]),
        ("Berg, Ann", ["Berg, Ann"]),
        ("Berg Holm, Ann", ["Berg Holm, Ann"]),
        ("Lab (Oslo; Bergen); B", ["Lab (Oslo; Bergen)", "B"]),
        ("Lab (Oslo; B", ["Lab (Oslo", "B"]),
    ],
)
def test_people(text, items):
    assert split_packed(text, "person") == items


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("Institute of X, University of Y, Y 1234", ["Institute of X, University of Y, Y 1234"]),
        ("IV-NAF,IEPH-UV", ["IV-NAF", "IEPH-UV"]),
        ("IV-NAF, Oslo", ["IV-NAF, Oslo"]),
        ('"Lab, Y; Unit 6"; "Lab, Z; ""Block 1"""', ["Lab, Y; Unit 6", 'Lab, Z; "Block 1"']),
        ("A // B / C/D", ["A", "B", "C", "D"]),
    ],
)
def test_organisations(text, items):
    assert split_packed(text, "organisation") == items


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_characters='\r\n\x00“”«»', blacklist_categories=("Cs",)), min_size=1).map(str.strip).filter(bool), min_size=2, max_size=6))
def test_quoted_values_survive(items):
    packed = "; ".join('"' + i.replace('"', '""') + '"' for i in items if "\\" not in i)
    assert split_packed(packed, "person") == [i for i in items if "\\" not in i]


def test_very_long_field():
    assert len(split_packed("Berg, A.; " * 50_000, "person")) == 50_000


def test_explode(spark):
    rows = [(1, "Berg, A.; Holm, B.", 7), (2, None, 7), (3, "", 7), (1, "Berg, A.; Holm, B.", 7), (4, "Vik C", None)]
    df = spark.createDataFrame(rows, "row_id long, authors string, pos long")
    got = sorted(map(tuple, explode_packed(df, "authors", "person", ["row_id"]).collect()))
    assert got == [(1, 0, "Berg, A."), (1, 0, "Berg, A."), (1, 1, "Holm, B."), (1, 1, "Holm, B."), (4, 0, "Vik C")]
    with pytest.raises(ValueError):
        explode_packed(df, "authors", "person", ["row_id", "pos"])
    assert explode_packed(df.limit(0), "authors", "person", ["row_id"]).count() == 0
    plan = explode_packed(df, "authors", "person", ["row_id"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan
