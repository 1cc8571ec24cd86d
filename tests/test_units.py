"""Units: the graph of conversions, and ratings against a plain reader."""

import re
from fractions import Fraction

import pytest
from oracle import DATA

from shelfmark.operators.units import Conversion, InconsistentUnits, compose, convert, composed_table, ratings_as_stars
from shelfmark.plans.training import p3_found

TAGGERS = [("plain", "rating", 0.0, 5.0, None), ("grades", "grade", 6.0, 1.0, None), ("bytes", "popm", None, None, [1.0, 64.0, 128.0, 196.0, 255.0]), ("guess", "rating", None, None, None), ("bare", "x", None, None, None), ("flat", "x", 3.0, 3.0, None)]


def test_compositions_are_shortest_and_exact():
    edges = [Conversion("c", "k", Fraction(1), Fraction("273.15")), Conversion("c", "f", Fraction(9, 5), Fraction(32)), Conversion("f", "r", Fraction(1), Fraction("459.67"))]
    known = compose(edges)
    assert known["k", "r"][:2] == (Fraction(9, 5), Fraction(0)) and known["k", "r"][2] == 3
    assert known["r", "c"][:2] == (Fraction(5, 9), Fraction("-273.15"))


def test_inconsistent_cycle_is_refused():
    edges = [Conversion("a", "b", Fraction(2)), Conversion("b", "c", Fraction(3)), Conversion("a", "c", Fraction(7))]
    with pytest.raises(InconsistentUnits):
        compose(edges)
    assert compose([*edges[:2], Conversion("a", "c", Fraction(6))])["a", "c"] == (Fraction(6), 0, 1)


def test_one_search_from_the_target_checks_every_cycle():
    edges = [Conversion(f"t{i}", "share", Fraction(1, i + 1)) for i in range(20_000)] + [Conversion("share", "stars", Fraction(5))]
    known = compose(edges, ["stars"])
    assert len(known) == 20_002 and known["t9", "stars"] == (Fraction(1, 2), 0, 2)
    apart = [Conversion("x", "y", Fraction(2)), Conversion("y", "z", Fraction(2)), Conversion("x", "z", Fraction(5))]
    with pytest.raises(InconsistentUnits):
        compose([*edges[-1:], *apart], ["stars"])


def test_any_number_of_taggers_and_contradicting_ones(spark):
    readings = spark.range(0, 300_000, 1, 4).selectExpr("id", "cast(id % 11 as string) as rating", "concat('t', id % 100000) as tagger")
    taggers = spark.range(100_000).selectExpr("concat('t', id) as tagger", "'k' as tag_key", "0D as lo", "10D as hi", "cast(null as array<double>) as steps")
    got = ratings_as_stars(readings, taggers).where("stars is distinct from cast(rating as double) / 2").count()
    assert got == 0
    with pytest.raises(InconsistentUnits):
        ratings_as_stars(readings, taggers.union(taggers.limit(1).withColumn("hi", taggers["hi"] * 2)))


def test_convert_keeps_rows_and_respects_ranges(spark):
    table = composed_table(spark, [Conversion("pct", "share", Fraction(1, 100))], {"pct": (0.0, 100.0)})
    rows = spark.createDataFrame([(50.0, "pct", 1), (150.0, "pct", 2), (0.5, "share", 3), (1.0, "mile", 4), (None, "pct", 5), (1.0, None, 6)], "amount double, unit string, id int")
    got = {r["id"]: r["converted"] for r in convert(rows, "amount", "unit", "share", table).collect()}
    assert got == {1: 0.5, 2: None, 3: 0.5, 4: None, 5: None, 6: None}


@pytest.mark.parametrize(
    "text, tagger, stars",
    [
        ("4", "plain", 4.0), ("４，５", "plain", 4.5), (" 4.5 ", "plain", 4.5), ("6", "plain", None), ("-1", "plain", None), ("1", "grades", 5.0), ("6", "grades", 0.0), ("7", "grades", None),
        ("196", "bytes", 4.0), ("0xC4", "bytes", 4.0), ("197", "bytes", None), ("60", "guess", 3.0), ("999", "guess", None), ("3", "bare", 3.0), ("999", "bare", None), ("3", "flat", None), ("3", None, None),
        ("3/5", "bare", 3.0), ("rating: 7/10", "grades", 3.5), ("3 von 10", None, 1.5), ("0,5 of 1", "bare", 2.5), ("5 out of 0", "bare", None), ("9/5", "bare", None),
        ("(40 %)", "bare", 2.0), ("40 per cent", "bare", 2.0), ("101%", "bare", None), ("40pts", "bare", 2.0), ("3 stars", "bytes", 3.0), ("3½ stars", "bytes", 3.5), ("3 1/2 stars", "bytes", 3.5),
        ("4½★", "bare", 4.5), ("★★★½☆", "bare", 3.5), ("☆☆☆☆☆", "bare", 0.0), ("***", "bare", 3.0), ("⭐⭐", "bare", 2.0), ("******", "bare", None), ("2*", "bare", 2.0), ("FIVE STARS", "bare", 5.0),
        ("Two out of five", "bare", 2.0), ("", "plain", None), (None, "plain", None), ("clean", "plain", None), ("½", "plain", 0.5), ("x" * 100_000, "plain", None), ("4" * 100_000, "plain", None),
    ],
)
def test_ratings(spark, text, tagger, stars):
    fill = [(100 + i, str(10 * i), "guess") for i in range(11)]
    rows = spark.createDataFrame([(1, text, tagger), *fill], "id int, rating string, tagger string")
    taggers = spark.createDataFrame(TAGGERS, "tagger string, tag_key string, lo double, hi double, steps array<double>")
    got = ratings_as_stars(rows, taggers).where("id = 1").collect()
    assert len(got) == 1 and (got[0]["stars"] is None) == (stars is None)
    assert stars is None or got[0]["stars"] == pytest.approx(stars)


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "id int, rating string, tagger string, stars2 int")
    taggers = spark.createDataFrame([], "tagger string, tag_key string, lo double, hi double, steps array<double>")
    assert ratings_as_stars(rows, taggers).count() == 0


def slow_reading(text, scale, steps):
    """A plain reader of the common spellings, for comparison."""
    if text is None:
        return None
    t = text.strip().lower().translate(str.maketrans("０１２３４５６７８９．，", "0123456789.,")).replace(",", ".")
    number = r"(\d+(?:\.\d+)?)"
    if m := re.fullmatch(rf"(?:rating:\s*)?{number}\s*(?:/|of|out of|von)\s*{number}", t):
        return float(m[1]) / float(m[2]) * 500 if float(m[1]) <= float(m[2]) else None
    if m := re.fullmatch(rf"\(?{number}\s*(?:%|percent|per cent|pct|points?|pts?)\)?", t):
        return float(m[1]) * 5 if float(m[1]) <= 100 else None
    if m := re.fullmatch(number, t):
        x = float(m[1])
        if steps:
            return (steps.index(x) + 1) * 100 if x in steps else None
        if scale and min(scale) <= x <= max(scale):
            return (x - scale[0]) / (scale[1] - scale[0]) * 500
        return None
    return "other"


def test_against_a_plain_reader(spark):
    from shelfmark.session import table

    known = {r["tagger"]: ((r["lo"], r["hi"]) if r["lo"] is not None else None, r["steps"]) for r in table(spark, str(DATA), "taggers").collect()}
    known |= {"echodesk": ((0, 100), None), "nightrack": ((0, 10), None), "ledgerbox": ((0, 255), None)}
    got = {r["reading_id"]: r["centistars"] for r in p3_found(spark, str(DATA)).collect()}
    checked = 0
    for r in table(spark, str(DATA), "rating_tags").collect():
        want = slow_reading(r["rating"], *known.get(r["tagger"], (None, None)))
        if want != "other":
            checked += 1
            assert got.get(r["reading_id"]) == (None if want is None else round(want)), r
    assert checked > 100
