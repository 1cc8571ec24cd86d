"""The authority map from artist to genres: building it, what is new, what complies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.normalize import name_key
from shelfmark.operators.dominant import dominant
from shelfmark.operators.stats import filled

# Artists of compilations, for which no genre is enforced.
EXCLUDED = ("various artists", "various", "va")
WRITABLE = (".mp3", ".flac", ".ogg", ".opus", ".m4a", ".wma")


def build_map(albums: DataFrame, artist: str = "artist", genre: str = "genre", order: Column | None = None) -> DataFrame:
    """One row per artist: artist_norm, display (the usual spelling), genres (text, the most frequent first), n_genres, excluded.

    albums: one row per album. order decides between equal counts; the album's place if not given.
    """
    place = order if order is not None else F.struct("root", "dir")
    rows = albums.where(filled(F.col(artist))).select(name_key(F.col(artist)).alias("artist_norm"), F.col(artist).alias("display"), F.col(genre).alias("genre"), place.alias("_place")).where("artist_norm <> ''")
    names = dominant(rows, ["artist_norm"], ["display"], F.col("_place"))
    counted = rows.where(filled(F.col("genre"))).groupBy("artist_norm", "genre").agg(F.count("*").alias("n"), F.min("_place").alias("first"))
    lists = counted.groupBy("artist_norm").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "first", "genre"))).alias("g"))
    joined = names.join(lists, "artist_norm", "left")
    genres = F.coalesce(F.transform("g", lambda x: x["genre"]), F.array().cast("array<string>"))
    return joined.select("artist_norm", "display", F.array_join(genres, "\t").alias("genres"), F.size(genres).cast("bigint").alias("n_genres"), F.col("artist_norm").isin(*EXCLUDED).alias("excluded"))


def effective_map(entries: DataFrame, line: str = "entry_id") -> DataFrame:
    """The map as it holds: one row per artist_norm, of several the later line. display, canonical, allowed_norm."""
    keyed = entries.select(name_key(F.col("display")).alias("artist_norm"), F.struct(line, "display", F.coalesce("canonical", F.lit("")).alias("canonical"), "allowed_norm").alias("e")).where("artist_norm <> ''")
    return keyed.groupBy("artist_norm").agg(F.max_by("e", F.col(f"e.{line}")).alias("e")).select("artist_norm", "e.display", "e.canonical", "e.allowed_norm")


def new_artists(albums: DataFrame, entries: DataFrame, artist: str = "artist") -> DataFrame:
    """Artists of the library that the map lacks, compilations aside: artist_norm, n_albums."""
    seen = albums.where(filled(F.col(artist))).groupBy(name_key(F.col(artist)).alias("artist_norm")).agg(F.count("*").alias("n_albums")).where("artist_norm <> ''")
    known = entries.select(name_key(F.col("display")).alias("artist_norm")).distinct()
    return seen.where(~F.col("artist_norm").isin(*EXCLUDED)).join(known, "artist_norm", "left_anti")


def compliance(albums: DataFrame, entries: DataFrame, artist: str = "artist", genre: str = "genre", writable: Column | None = None) -> DataFrame:
    """Every album with outcome (excluded, unmapped, skipped_blank, ok, unsupported, retag) and target genre, in that
    precedence. A missing genre never complies. The map joins by artist; Spark broadcasts it only if it is small."""
    chart = effective_map(entries)
    key = name_key(F.col(artist))
    joined = albums.withColumn("_key", key).join(chart, F.col("_key") == F.col("artist_norm"), "left")
    outcome = (
        F.when(F.col("_key").isin(*EXCLUDED), "excluded")
        .when(F.col("artist_norm").isNull(), "unmapped")
        .when(F.col("canonical") == "", "skipped_blank")
        .when(F.coalesce(F.array_contains("allowed_norm", name_key(F.col(genre))), F.lit(False)) & filled(F.col(genre)), "ok")
        .when(~(writable if writable is not None else F.lit(True)), "unsupported")
        .otherwise("retag")
    )
    kept = joined.withColumn("outcome", outcome).withColumn("target", F.when(F.col("outcome") == "retag", F.col("canonical")))
    return kept.drop("_key", "artist_norm", "display", "canonical", "allowed_norm")
