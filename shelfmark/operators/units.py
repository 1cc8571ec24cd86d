"""Quantities recorded in different units.

Conversions are the edges of a graph of units, each an affine function. The shortest composition between every two
units is worked out once, every cycle is checked for consistency, and the rows are then converted by one equi-join on
source unit and target unit. Units whose numbers are only labels of steps are a second, enumerated table joined on unit
and number. Ratings are the quantity at hand: the unit is read from the text if it is written there, else it is that of
the tagger, and where nobody documented it, it is inferred from the numbers which that tagger wrote.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import trim_all
from shelfmark.session import checkpoint

COMPOSED = T.StructType(
    [
        T.StructField("source_unit", T.StringType()),
        T.StructField("target_unit", T.StringType()),
        T.StructField("mul", T.DoubleType()),
        T.StructField("add", T.DoubleType()),
        T.StructField("least", T.DoubleType()),
        T.StructField("most", T.DoubleType()),
        T.StructField("steps", T.IntegerType()),
    ]
)


class InconsistentUnits(ValueError):
    """Two ways from one unit to another give different functions."""


@dataclass(frozen=True)
class Conversion:
    """target = mul * source + add."""

    source: str
    target: str
    mul: Fraction
    add: Fraction = Fraction(0)

    def inverse(self) -> Conversion:
        return Conversion(self.target, self.source, 1 / self.mul, -self.add / self.mul)


def compose(edges: list[Conversion], targets: list[str] | None = None) -> dict[tuple[str, str], tuple[Fraction, Fraction, int]]:
    """The shortest composition from every unit to each target it is connected to, as (mul, add, number of edges).

    Without targets every unit is one, which makes as many rows as there are pairs of units; with them one search is
    made for each. Every edge can be walked both ways. Raises InconsistentUnits if any cycle fails to give the identity,
    whether or not it has to do with a target, and ZeroDivisionError for an edge that cannot be walked back. Exact: the
    arithmetic is that of fractions.
    """
    into: dict[str, list[Conversion]] = {}
    for edge in edges:
        for way in (edge, edge.inverse()):
            into.setdefault(way.target, []).append(way)
    for ways in into.values():
        ways.sort(key=lambda way: way.source)
    known: dict[tuple[str, str], tuple[Fraction, Fraction, int]] = {}
    reached: set[str] = set()

    def search(target: str) -> dict[str, tuple[Fraction, Fraction, int]]:
        found = {target: (Fraction(1), Fraction(0), 0)}
        queue = deque([target])
        while queue:
            here = queue.popleft()
            mul, add, steps = found[here]
            for way in into.get(here, ()):
                through = (mul * way.mul, mul * way.add + add)
                before = found.get(way.source)
                if before is None:
                    found[way.source] = (*through, steps + 1)
                    queue.append(way.source)
                elif before[:2] != through:
                    raise InconsistentUnits(f"{way.source} -> {target}: {before[:2]} or {through}, by way of {here}")
        reached.update(found)
        return found

    for target in list(into) if targets is None else targets:
        known |= {(source, target): way for source, way in search(target).items()}
    for unit in into:
        if unit not in reached:  # no way to a target; its cycles must be sound all the same
            search(unit)
    return known


def composed_table(spark: SparkSession, edges: list[Conversion], ranges: dict[str, tuple[float, float]], targets: list[str] | None = None) -> DataFrame:
    """`compose` as a table of COMPOSED rows, with the range of numbers that a source unit allows (null: any)."""
    rows = [
        (source, target, float(mul), float(add), *(ranges.get(source) or (None, None)), steps)
        for (source, target), (mul, add, steps) in compose(edges, targets).items()
    ]
    return spark.createDataFrame(rows, COMPOSED)


def convert(df: DataFrame, amount: str, unit: str, target_unit: str, conversions: DataFrame, out: str = "converted") -> DataFrame:
    """Add `out`: the amount of each row in the target unit, by an equi-join on (unit, target unit).

    Null where the amount or its unit is null, the unit has no way to the target, or the amount lies outside the range
    of its unit. No row is dropped. The conversions are one row per unit; Spark broadcasts them only if they are small.
    """
    if out in df.columns:
        raise ValueError(f"the table already has a column {out!r}")
    wanted = conversions.where(F.col("target_unit") == target_unit).select(
        F.col("source_unit").alias("_u"), F.col("mul").alias("_m"), F.col("add").alias("_a"), F.col("least").alias("_lo"), F.col("most").alias("_hi")
    )
    x = F.col(amount)
    inside = (F.col("_lo").isNull() | (x >= F.col("_lo"))) & (F.col("_hi").isNull() | (x <= F.col("_hi")))
    joined = df.join(wanted, df[unit] == F.col("_u"), "left")
    return joined.withColumn(out, F.when(inside, x * F.col("_m") + F.col("_a"))).drop("_u", "_m", "_a", "_lo", "_hi")


# --- ratings -------------------------------------------------------------------------------------------------------

# Number words, the customary scales and the ways in which a unit is written.
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
CUSTOMARY = (1, 5, 10, 20, 100, 255)
FULL_WIDTH = "０１２３４５６７８９．，／％（）＊－＋：", "0123456789.,/%()*-+:"
NUMBER = r"([0-9]+(?:[.,][0-9]+)?)"
HALF = r"(½|\s1/2)?"
OF = r"(?:/|of|out of|von)"
STARS = r"(?:stars?|star\(s\)|★|⭐|\*)"
PERCENT = r"(?:%|percent|per cent|pct)"
POINTS = r"(?:points?|pts?)"
#: Stars, and so every scale, range from 0 to this.
TOP = 5
COVERED = 0.9


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def read_rating(rating: Column, own_unit: Column) -> Column:
    """The struct (unit, amount) that a rating text tells; null if it tells none.

    `own_unit` is the unit of a bare number. A text may be of any length; white space around it, letter case, full-width
    digits, decimal commas, brackets around a percentage and the word "rating:" before it make no difference.
    """
    text = F.lower(trim_all(F.translate(rating, *FULL_WIDTH)))
    text = trim_all(F.regexp_replace(text, r"^rating\s*[:=]", ""))
    # bound to a lambda's variable, so that the plan holds and a row computes the cleaned text once
    return F.element_at(F.transform(F.array(text), lambda t: _told_by(t, own_unit)), 1)


def _told_by(text: Column, own_unit: Column) -> Column:
    words = "|".join(NUMBER_WORDS)
    value_of = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    part = lambda pattern, group: F.regexp_extract(text, pattern, group)
    told = lambda unit, amount: F.struct(F.lit(unit).alias("unit"), amount.cast("double").alias("amount"))
    half = lambda pattern, group: F.when(part(pattern, group) != "", 0.5).otherwise(0.0)

    share = rf"^{NUMBER}\s*{OF}\s*{NUMBER}$"
    stars = rf"^([0-9]+(?:[.,][0-9]+)?){HALF}\s*{STARS}$"
    word_stars = rf"^({words})\s+stars?$"
    word_share = rf"^({words})\s+out\s+of\s+({words})$"
    glyphs = r"^(?=.)([★⭐*]{0,9})(½?)(☆{0,9})$"
    percent = rf"^\(?\s*{NUMBER}\s*{PERCENT}\s*\)?$"
    points = rf"^{NUMBER}\s*{POINTS}\.?$"
    full = F.length(part(glyphs, 1)) + half(glyphs, 2)
    places = F.length(part(glyphs, 1)) + F.length(part(glyphs, 2)) + F.length(part(glyphs, 3))
    return (
        F.when(text.rlike(r"^0x[0-9a-f]{1,8}$"), F.struct(own_unit.alias("unit"), F.conv(F.substring(text, 3, 8), 16, 10).try_cast("double").alias("amount")))
        .when(text.rlike(share), told("share", F.try_divide(_number(part(share, 1)), _number(part(share, 2)))))
        .when(text.rlike(word_share), told("share", F.try_divide(value_of[part(word_share, 1)], value_of[part(word_share, 2)])))
        .when(text.rlike(word_stars), told("stars", value_of[part(word_stars, 1)]))
        .when(text.rlike(glyphs), F.when(places <= TOP, told("stars", full)))
        .when(text.rlike(stars), told("stars", _number(part(stars, 1)) + half(stars, 2)))
        .when(text.rlike(percent), told("percent", _number(part(percent, 1))))
        .when(text.rlike(points), told("points", _number(part(points, 1))))
        .when(text.rlike(rf"^{NUMBER}$"), F.struct(own_unit.alias("unit"), _number(text).alias("amount")))
    )


def infer_scales(bare: DataFrame, tagger: str, amount: str) -> DataFrame:
    """For each tagger the customary scale, starting at 0, that its bare numbers fill: tagger, hi.

    It is the smallest scale that covers nine tenths of the numbers, so that stray ones beyond any scale do not count;
    hi is null where no customary scale covers that many. One aggregation, combined before the shuffle.
    """
    counts = [F.sum((F.col(amount) <= s).cast("long")).alias(f"_n{s}") for s in CUSTOMARY]
    fits = F.coalesce(*(F.when(F.col(f"_n{s}") >= COVERED * F.col("_n"), F.lit(float(s))) for s in CUSTOMARY))
    return bare.where(F.col(tagger).isNotNull() & F.col(amount).isNotNull()).groupBy(F.col(tagger).alias("tagger")).agg(F.count("*").alias("_n"), *counts).select("tagger", fits.alias("hi"))


def attached(scales: DataFrame, unit: str, conversions: DataFrame, target: str) -> DataFrame:
    """Scales that hang on one unit of the graph by a single edge each, composed with that unit's way to the target.

    scales: source_unit, lo, hi; lo is 0 of `unit` and hi is 1 of it, whichever of them is greater. A scale is a leaf,
    so it adds no cycle and needs no search: its composition is an expression, whatever the number of scales. A source
    unit with two different scales raises InconsistentUnits, one with lo equal to hi has no row.
    """
    distinct = scales.where("lo <> hi").distinct()
    twice = distinct.groupBy("source_unit").count().where("count > 1").limit(1).collect()
    if twice:
        raise InconsistentUnits(f"{twice[0][0]} has more than one scale")
    way = conversions.where((F.col("source_unit") == unit) & (F.col("target_unit") == target)).first()
    if way is None:
        raise InconsistentUnits(f"{unit} has no way to {target}")
    mul = F.lit(way["mul"]) / (F.col("hi") - F.col("lo"))
    add = F.lit(way["add"]) - F.col("lo") * F.lit(way["mul"]) / (F.col("hi") - F.col("lo"))
    return distinct.select(
        "source_unit", F.lit(target).alias("target_unit"), mul.alias("mul"), add.alias("add"), F.least("lo", "hi").alias("least"), F.greatest("lo", "hi").alias("most"), F.lit(way["steps"] + 1).alias("steps")
    )


def rating_conversions(spark: SparkSession, taggers: DataFrame, inferred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The composed conversions of all units of ratings into stars, and the table of enumerated steps (unit, amount, stars).

    taggers: tagger, lo, hi, steps as documented. inferred: tagger, hi for those whose scale nobody documented. Both
    stay tables, however many taggers there are. A tagger with lo equal to hi has no scale; steps go before a scale.
    """
    edges = [Conversion("percent", "share", Fraction(1, 100)), Conversion("points", "percent", Fraction(1)), Conversion("share", "stars", Fraction(TOP)), Conversion("points", "stars", Fraction(TOP, 100))]
    ranges = {"stars": (0.0, float(TOP)), "share": (0.0, 1.0), "percent": (0.0, 100.0), "points": (0.0, 100.0)}
    written = composed_table(spark, edges, ranges, ["stars"])
    unit = F.concat(F.lit("tagger:"), F.col("tagger")).alias("source_unit")
    named = taggers.where("tagger is not null").withColumn("_stepped", F.coalesce(F.size("steps") > 0, F.lit(False)))
    documented = named.where("_stepped or (lo is not null and hi is not null)").select(F.col("tagger").alias("_t")).distinct()
    guessed = inferred.where("hi is not null").join(documented, F.col("tagger") == F.col("_t"), "left_anti").select(unit, F.lit(0.0).alias("lo"), F.col("hi").cast("double").alias("hi"))
    scales = named.where("not _stepped and lo is not null and hi is not null").select(unit, F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")).unionByName(guessed)
    steps = named.where("_stepped").select(unit.alias("step_unit"), F.posexplode("steps").alias("_i", "step_amount")).where("step_amount is not null")
    steps = steps.select("step_unit", "step_amount", (F.col("_i") + 1).cast("double").alias("step_stars")).distinct()
    return written.unionByName(attached(scales, "share", written, "stars")), steps


def ratings_as_stars(readings: DataFrame, taggers: DataFrame, rating: str = "rating", tagger: str = "tagger") -> DataFrame:
    """Add stars (double, 0 to 5) to every reading; null where the text tells no rating or one outside its scale.

    Nulls, empty texts and texts that are no rating give null, a tagger of unknown scale gives null for bare numbers
    but not for texts that write a unit. Rows are neither dropped nor repeated, and keep all their columns.
    """
    told = read_rating(F.col(rating), F.concat(F.lit("tagger:"), F.col(tagger)))
    read = readings.withColumn("_told", told).withColumns({"_unit": F.col("_told.unit"), "_amount": F.col("_told.amount")}).drop("_told")
    bare = read.where(F.startswith("_unit", F.lit("tagger:")))
    # one row per tagger: written once, so that the readings are not read again for every use of it
    inferred = checkpoint(infer_scales(bare, tagger, "_amount"))
    conversions, steps = rating_conversions(readings.sparkSession, taggers, inferred)
    done = convert(read, "_amount", "_unit", "stars", conversions, "_stars")
    done = done.join(steps, (F.col("_unit") == F.col("step_unit")) & (F.col("_amount") == F.col("step_amount")), "left")
    return done.withColumn("stars", F.coalesce("_stars", "step_stars")).drop("_unit", "_amount", "_stars", "step_unit", "step_amount", "step_stars")
