"""Matching free values to a list."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.llm.genres import match_values, normalised

LIST = [(1, ["Hollow Folk", "ghost ballads"]), (2, ["Satin R&B"]), (3, ["Tin Whistle Punk"]), (4, ["Écho Musette"]), (5, ["Porcelain Pop"]), (6, ["Velvet Ambient"]), (7, ["Railway Country"]), (8, ["Mudstep"]), (9, ["Ghost Ballads"])]


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame(LIST, "id int, names array<string>")


def matched(spark, listed, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r["value"]: r["entry"] for r in match_values(df, "v", listed, "id", "names").collect()}


def test_kinds_of_free_spelling(spark, listed):
    want = {
        "hollow folk": 1, "HOLLOW-FOLK!": 1, "Folk Hollow": 1, "Holow Folk": 1, "Hllw Flk": 1, "ghost ballads": 1, "Satin RandB": 2, "satin r & b": 2, "TinWhistlePunk": 3, "genre: Tin Whistle Punk": 3,
        "echo musette": 4, "Écho Musette": 4, "P0rcelain Pop": 5, "Porc. Pop": 5, "Ｖｅｌｖｅｔ Ambient": 6, "Ralway Country": 7, "mostly Railway Country": 7, "Mudsetp": 8,
        "podcast": None, "unknown": None, "???": None, "": None, "  ": None, "1998": None, "東京": None, "x" * 20_000: None,
    }
    assert matched(spark, listed, [*want, None, "podcast"]) == want


def test_empty_list_and_empty_values(spark, listed):
    empty = spark.createDataFrame([], "id int, names array<string>")
    assert matched(spark, empty, ["Mudstep"]) == {"Mudstep": None}
    assert matched(spark, listed, []) == {}


def test_normalised(spark):
    row = spark.createDataFrame([("Über_P0lka & 80s\xa0 ", None)], "a string, b string").select(normalised(F.col("a")), normalised(F.col("b"))).first()
    assert tuple(row) == ("uber polka and 80s", None)


def test_held_out_typos(spark, listed):
    r = random.Random(3)
    truth = {}
    for entry, names in LIST[:8]:
        for _ in range(20):
            s = list(names[0])
            at = r.randrange(1, len(s))
            kind = r.randrange(3)
            if kind == 0:
                s[at] = r.choice("aeiourstn")
            elif kind == 1:
                del s[at]
            else:
                s.insert(at, r.choice("aeiourstn"))
            truth["".join(s)] = entry
    got = matched(spark, listed, list(truth))
    assert sum(got[v] == e for v, e in truth.items()) / len(truth) >= 0.95
