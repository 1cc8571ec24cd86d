"""Cover art: which picture a folder has, where one is missing, too small or at odds with the embedded one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.schema import ART_PRIORITY, COVER_NAMES


def best_art(pictures: DataFrame, place: list[str] = ("root", "dir")) -> DataFrame:
    """The embedded picture that stands for each folder: place, filename, picture.

    pictures: place, filename, ext, picture (null where a file has none). Formats are asked in a fixed order, and of each
    format only the first file by name; others of it are not looked into.
    """
    rank = F.array_position(F.array(*(F.lit(e) for e in ART_PRIORITY)), F.col("ext"))
    first = pictures.where(rank > 0).groupBy(*place, "ext").agg(F.min_by(F.struct("filename", "picture"), "filename").alias("f"))
    held = first.where(F.col("f.picture").isNotNull()).select(*place, rank.alias("rank"), "f.*")
    return held.groupBy(*place).agg(F.min_by(F.struct("filename", "picture"), "rank").alias("b")).select(*place, "b.filename", "b.picture")


def missing_art(folders: DataFrame, files: DataFrame, embedded: DataFrame, place: list[str] = ("root", "dir")) -> DataFrame:
    """Folders without a cover file: place, bucket (embedded_only or none)."""
    covers = files.where(F.lower("filename").isin(*COVER_NAMES)).select(*place).distinct()
    bare = folders.select(*place).distinct().join(covers, list(place), "left_anti")
    inside = embedded.select(*place).distinct().withColumn("_e", F.lit(True))
    return bare.join(inside, list(place), "left").select(*place, F.when(F.col("_e"), "embedded_only").otherwise("none").alias("bucket"))


def small_art(sizes: DataFrame, least: int = 500) -> DataFrame:
    """Pictures (width, height) with a side below the least; unknown sizes are none."""
    return sizes.where((F.col("width") < least) | (F.col("height") < least))


def art_verdict(embedded: Column, cover: Column, embedded_size: Column, cover_size: Column) -> Column:
    """How an embedded picture and a cover file agree: IRRELEVANT, MATCH, UNREADABLE, SAME PIXELS or DIFFERENT IMAGE.

    The pictures are given by their bytes or digests, the sizes as structs of width and height, null if unknown.
    """
    return (
        F.when(embedded.isNull() | cover.isNull(), "IRRELEVANT")
        .when(embedded == cover, "MATCH")
        .when(embedded_size.isNull() | cover_size.isNull(), "UNREADABLE")
        .when(embedded_size == cover_size, "SAME PIXELS")
        .otherwise("DIFFERENT IMAGE")
    )


def to_embed(files: DataFrame, covers: DataFrame, place: list[str] = ("root", "dir")) -> DataFrame:
    """Files without a picture in folders that have a cover: place, filename, cover. files: place, filename, has_art."""
    return files.where(~F.coalesce("has_art", F.lit(False))).join(covers.select(*place, "cover"), list(place)).select(*place, "filename", "cover")
