"""Queries of the training-data operators that belong to the core: units and packed fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.packed import PackedOptions, explode_packed, protected_phrases, score_delimiters
from shelfmark.operators.units import ratings_as_stars
from shelfmark.plans import training_sql
from shelfmark.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    stars = ratings_as_stars(table(spark, d, "rating_tags").select("reading_id", "tagger", "rating"), table(spark, d, "taggers"))
    # the tenth digit takes the noise of binary fractions away before the tie is decided
    return stars.where("stars is not null").select("reading_id", F.round(F.round(F.col("stars") * 100, 8)).cast("bigint").alias("centistars"))


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, PackedOptions]:
    listed = table(spark, d, "genre_list")
    return table(spark, d, "tracks"), listed.select("canonical"), PackedOptions(protected=protected_phrases(listed, "canonical", PackedOptions()))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    tracks, names, options = _packed(spark, d)
    return explode_packed(tracks, "genre", "root", ["track_id"], names, options).select("track_id", "pos", F.col("piece").alias("genre_value")).distinct()


def p5_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """The evidence for each delimiter in each source."""
    tracks, names, options = _packed(spark, d)
    return score_delimiters(tracks, "genre", "root", names, options)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p5_found": p5_found, "p5_delimiters": p5_delimiters}
SQL: dict[str, str] = {"p3_found": training_sql.units(), "p5_found": training_sql.packed()}
