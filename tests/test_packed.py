"""Packed fields: splitting, quoting, protection, inference, odd input."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.packed import PackedOptions, explode_packed, score_delimiters, split_packed

OPEN = PackedOptions(threshold=0.0, protected=("Rain/Noise", "Brass, Bells & Choir"))


def split(spark, values, options=OPEN, listed=("Folk", "Jazz", "Rain/Noise")):
    rows = spark.createDataFrame([(i, v, "s") for i, v in enumerate(values)], "id int, genre string, src string")
    names = spark.createDataFrame([(x,) for x in listed], "name string")
    out = split_packed(rows, "genre", "src", names, options)
    return [list(r["pieces"]) if r["pieces"] is not None else None for r in out.orderBy("id").collect()]


@pytest.mark.parametrize(
    "value, pieces",
    [
        ("Folk; Jazz", ["Folk", "Jazz"]),
        ("Folk ;; Jazz;", ["Folk", "Jazz"]),
        ('"Folk, old"|Jazz', ["Folk, old", "Jazz"]),
        ('"12"" Mixes", Jazz', ['12" Mixes', "Jazz"]),
        ("'Folk' // 'Jazz'", ["Folk", "Jazz"]),
        ('["Folk", "Jazz"]', ["Folk", "Jazz"]),
        ("rain/noise/Jazz", ["rain/noise", "Jazz"]),
        ("BRASS, BELLS & CHOIR, Jazz", ["BRASS, BELLS & CHOIR", "Jazz"]),
        ("Folk\\\\Jazz", ["Folk", "Jazz"]),
        ("Folk\x00Jazz\nBlues", ["Folk", "Jazz", "Blues"]),
        ("Hip-Hop & Soul. Live", ["Hip-Hop & Soul. Live"]),
        ("mum's records; dad's", ["mum's records", "dad's"]),
        ('12" Mixes; 7" Singles', ['12" Mixes', '7" Singles']),
        ("\xa0Folk　;Jazz", ["Folk", "Jazz"]),
        ("Folk; Folk", ["Folk", "Folk"]),
        (" ; , ", []),
        ("", []),
        (None, None),
    ],
)
def test_pieces(spark, value, pieces):
    every = ["Folk; Jazz", "Folk, Jazz", "Folk|Jazz", "Folk / Jazz", "Folk\\\\Jazz", "Folk\x00Jazz", "Folk\nJazz"]
    assert split(spark, [value, *every])[0] == pieces


def test_delimiter_must_earn_its_place(spark):
    # the plus sign joins words here, the semicolon separates values
    rows = [(f"{a} + friends", "s") for a in ("abc", "bcd", "cde", "def")] * 20 + [("Folk; Jazz", "s")] * 20 + [("Folk", "s"), ("Jazz", "s")]
    df = spark.createDataFrame(rows, "genre string, src string")
    scores = {r["delimiter"]: r["active"] for r in score_delimiters(df, "genre", "src").collect()}
    assert scores == {";": True, "+": False}


def test_sources_differ_and_lend_evidence(spark):
    rows = [("Folk; Jazz", "a")] * 50 + [("Folk", "a"), ("Jazz", "a"), ("Folk; Blues", "small")]
    df = spark.createDataFrame(rows, "genre string, src string")
    scores = {(r["source"], r["delimiter"]): r["active"] for r in score_delimiters(df, "genre", "src").collect()}
    assert scores == {("a", ";"): True, ("small", ";"): True}


def test_empty_table_null_source_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "genre string, src string, pattern string, source string")
    assert split_packed(empty, "genre", "src").count() == 0
    rows = spark.createDataFrame([("Folk; Jazz", None, "p", "x"), ("Folk", None, "p", "x"), ("Jazz", None, None, None)], empty.schema)
    out = split_packed(rows, "genre", "src")
    assert out.columns == [*empty.columns, "pieces"]
    assert out.where("genre = 'Folk; Jazz'").first()["pieces"] == ["Folk", "Jazz"]
    with pytest.raises(ValueError):
        split_packed(rows, "genre", "src", out="pattern")


def test_very_long_values(spark):
    rows = spark.createDataFrame([("Folk;" * 100_000, "s"), ('"' * 50_001, "s"), ("Folk; Jazz", "s"), ("Folk", "s"), ("Jazz", "s")], "genre string, src string")
    sizes = {r[0] for r in split_packed(rows, "genre", "src").select(F.size("pieces")).collect()}
    assert 100_000 in sizes


def test_positions_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "Folk; ; Jazz", "s"), (1, "Folk; ; Jazz", "s"), (2, "Folk", "s"), (3, "Jazz", "s")], "id int, genre string, src string")
    out = explode_packed(rows, "genre", "src", ["id"])
    assert sorted(map(tuple, out.collect())) == [(1, 1, "Folk"), (1, 1, "Folk"), (1, 2, "Jazz"), (1, 2, "Jazz")]
