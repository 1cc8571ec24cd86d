"""Statistics of a library: totals, breakdowns, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.layout import DEFAULT_LAYOUT, slot
from shelfmark.schema import MUSIC, Roles

LABELS = ("1", "2", "3", "4", "5", "unrated")


def filled(c: Column) -> Column:
    """Whether a tag holds something: neither null nor empty."""
    return F.coalesce(c.cast("string") != "", F.lit(False))


def fully_tagged(roles: Roles = MUSIC) -> Column:
    return filled(F.col(roles.title)) & filled(F.col(roles.artist)) & F.col(roles.trackno).isNotNull() & filled(F.col(roles.genre))


def rating_label(rating: Column) -> Column:
    """1 to 5 or unrated: whole stars cut off, zero counted as one star."""
    return F.when(rating.isNull(), "unrated").otherwise(F.least(F.greatest(rating.cast("int"), F.lit(1)), F.lit(5)).cast("string"))


def overview(tracks: DataFrame, layout: str = DEFAULT_LAYOUT, roles: Roles = MUSIC) -> DataFrame:
    """One row of totals. An empty table gives zeros."""
    directory = F.col(roles.dir)
    album = F.when(slot(directory, "album", layout).isNotNull(), F.struct(roles.root, roles.dir))
    number = lambda c: F.coalesce(c, F.lit(0))
    return tracks.agg(
        F.count("*").alias("n_files"),
        number(F.sum(roles.size)).alias("total_bytes"),
        F.round(number(F.sum(roles.duration)), 3).alias("total_duration_s"),
        F.count_distinct(slot(directory, "artist", layout)).alias("n_artist_dirs"),
        F.count_distinct(album).alias("n_album_dirs"),
        F.count_if(fully_tagged(roles)).alias("n_fully_tagged"),
    )


def by_format(tracks: DataFrame, roles: Roles = MUSIC) -> DataFrame:
    return tracks.groupBy(F.col(roles.ext).alias("ext")).agg(F.count("*").alias("n_files"), F.sum(roles.size).alias("total_bytes"))


def rating_histogram(tracks: DataFrame, roles: Roles = MUSIC) -> DataFrame:
    """All six labels, those without a track at zero."""
    labels = tracks.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    counted = tracks.groupBy(rating_label(F.col(roles.rating)).alias("label")).agg(F.count("*").alias("n"))
    return labels.join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n_tracks"))


def rating_by_genre(tracks: DataFrame, roles: Roles = MUSIC) -> DataFrame:
    """One row per genre, one column per label."""
    rated = tracks.where(filled(F.col(roles.genre))).select(F.col(roles.genre).alias("genre"), rating_label(F.col(roles.rating)).alias("label"))
    counts = [F.count_if(F.col("label") == x).alias(f"r_{x}") for x in LABELS]
    return rated.groupBy("genre").agg(*counts)


def bitrates(tracks: DataFrame, floor: int = 192, roles: Roles = MUSIC) -> DataFrame:
    b = F.col(roles.bitrate)
    return tracks.where(b != 0).agg(F.count("*").alias("n"), F.min(b).alias("least"), F.max(b).alias("most"), F.round(F.avg(b), 6).alias("mean"), F.count_if(b < floor).alias("n_below_floor"))


def top_values(tracks: DataFrame, value: Column, n: int, roles: Roles = MUSIC) -> DataFrame:
    """The most frequent values, of equals the one met first in scanning order. The limit is what a top list is."""
    order = F.struct(roles.root, roles.dir, roles.filename)
    counted = tracks.where(filled(value)).groupBy(value.alias("value")).agg(F.count("*").alias("n_tracks"), F.min(order).alias("first"))
    return counted.orderBy(F.desc("n_tracks"), "first").limit(n).select("value", "n_tracks")
