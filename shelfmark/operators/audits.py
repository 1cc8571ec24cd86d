"""Audits: what is missing, inconsistent or out of place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.functions.layout import DEFAULT_LAYOUT, is_unknown_sidecar, layout_depths, stray_class
from shelfmark.operators.stats import filled
from shelfmark.schema import MUSIC, Roles, is_audio


def missing_fields(roles: Roles = MUSIC) -> Column:
    """The array of core tags that a track lacks."""
    lacks = (("title", ~filled(F.col(roles.title))), ("artist", ~filled(F.col(roles.artist))), ("tracknumber", F.col(roles.trackno).isNull()), ("genre", ~filled(F.col(roles.genre))))
    return F.array_compact(F.array(*(F.when(lacking, F.lit(name)) for name, lacking in lacks)))


def incomplete_tags(tracks: DataFrame, keep: list[str], roles: Roles = MUSIC) -> DataFrame:
    return tracks.withColumn("_missing", missing_fields(roles)).where(F.size("_missing") > 0).select(*keep, F.array_join("_missing", ", ").alias("missing"))


def missing_breakdown(tracks: DataFrame, roles: Roles = MUSIC) -> DataFrame:
    return tracks.select(F.explode(missing_fields(roles)).alias("field")).groupBy("field").agg(F.count("*").alias("n_tracks"))


def below_bitrate(roles: Roles = MUSIC, floor: int = 192) -> Column:
    return F.coalesce(F.col(roles.bitrate).between(1, floor - 1), F.lit(False))


def gain_bucket(n_track: Column, n_album: Column, n: Column) -> Column:
    """MISSING, PARTIAL, NO_ALBUM_GAIN or OK for an album's numbers of tracks with gains."""
    return F.when(n_track == 0, "MISSING").when(n_track < n, "PARTIAL").when(n_album < n, "NO_ALBUM_GAIN").otherwise("OK")


def gain_coverage(tracks: DataFrame, roles: Roles = MUSIC) -> DataFrame:
    """One row per folder: n_track_gain, n_album_gain, n_tracks, bucket. An unknown flag counts as no gain."""
    counted = tracks.groupBy(*roles.folder).agg(F.count_if(F.col(roles.track_gain)).alias("n_track_gain"), F.count_if(F.col(roles.album_gain)).alias("n_album_gain"), F.count("*").alias("n_tracks"))
    return counted.withColumn("bucket", gain_bucket(F.col("n_track_gain"), F.col("n_album_gain"), F.col("n_tracks")))


def track_numbers(tracks: DataFrame, roles: Roles = MUSIC) -> DataFrame:
    """Folders whose track numbers have gaps, repetitions or are missing: gaps, dupes (texts), n_untagged, n_tracks.

    Numbers are counted per folder first; gaps run from 1 to the greatest number and are read off neighbouring numbers,
    one number or a range ("4-9") each, so that a mistyped number costs no more than any other.
    """
    counted = tracks.groupBy(*roles.folder, F.col(roles.trackno).cast("int").alias("no")).agg(F.count("*").alias("n"))
    numbers = F.array_sort(F.collect_list("no"))
    folder = counted.groupBy(*roles.folder).agg(
        numbers.alias("nos"),
        F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("no")))).alias("twice"),
        F.coalesce(F.sum(F.when(F.col("no").isNull(), F.col("n"))), F.lit(0)).alias("n_untagged"),
        F.sum("n").alias("n_tracks"),
    )
    counted_from = F.concat(F.array(F.lit(0).cast("int")), F.filter("nos", lambda x: x >= 1))

    def between(before: Column, after: Column) -> Column:
        one, last = (before + 1).cast("string"), (after - 1).cast("string")
        return F.when(after - before == 2, one).when(after - before > 2, F.concat_ws("-", one, last))

    gaps = F.filter(F.zip_with(counted_from, F.slice(counted_from, 2, 1 << 30), between), lambda g: g.isNotNull())
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
    found = folder.withColumn("_gaps", gaps)
    return found.where((F.size("_gaps") > 0) | (F.size("twice") > 0) | (F.col("n_untagged") > 0)).select(*roles.folder, text(F.col("_gaps")).alias("gaps"), text(F.col("twice")).alias("dupes"), "n_untagged", "n_tracks")


def year_findings(tracks: DataFrame, roles: Roles = MUSIC) -> DataFrame:
    """Folders with no year, divergent years or a year on some files only: finding, years, n_with_year, n_tracks."""
    folder = tracks.groupBy(*roles.folder).agg(F.array_sort(F.collect_set(roles.year)).alias("ys"), F.count(roles.year).alias("n_with_year"), F.count("*").alias("n_tracks"))
    finding = F.when(F.size("ys") == 0, "none").when(F.size("ys") > 1, "divergent").when(F.col("n_with_year") < F.col("n_tracks"), "partial")
    return folder.withColumn("finding", finding).where("finding is not null").select(*roles.folder, "finding", F.array_join(F.transform("ys", lambda y: y.cast("string")), ", ").alias("years"), "n_with_year", "n_tracks")


def mixed_codecs(tracks: DataFrame, roles: Roles = MUSIC) -> DataFrame:
    folder = tracks.groupBy(*roles.folder).agg(F.array_sort(F.collect_set(roles.ext)).alias("exts"))
    return folder.where(F.size("exts") > 1).select(*roles.folder, F.array_join("exts", " + ").alias("codecs"))


def strays(tracks: DataFrame, layout: str = DEFAULT_LAYOUT, roles: Roles = MUSIC) -> DataFrame:
    """Numbers of files by how they sit in the tree."""
    artist, album = layout_depths(layout)
    path = F.concat_ws("/", roles.dir, roles.filename)
    return tracks.groupBy(stray_class(path, artist, album).alias("bucket")).agg(F.count("*").alias("n_files"))


def unknown_files(listing: DataFrame) -> DataFrame:
    """Files that are neither sound nor anything routine in an album folder, by extension: ext, n_files, first_path."""
    odd = listing.where(~is_audio(F.col("filename")) & is_unknown_sidecar(F.lower("ext")))
    return odd.groupBy(F.lower("ext").alias("ext")).agg(F.count("*").alias("n_files"), F.min(F.concat_ws("/", "root", "dir", "filename")).alias("first_path"))


def whole_albums(tracks: DataFrame, rule: Column, roles: Roles = MUSIC) -> DataFrame:
    """All tracks of the folders in which any track satisfies a rule."""
    hit = tracks.where(rule).select(*(F.col(c).alias(f"_{c}") for c in roles.folder)).distinct()
    return tracks.join(hit, [tracks[c].eqNullSafe(hit[f"_{c}"]) for c in roles.folder], "left_semi")


def nested_folders(tracks: DataFrame, roles: Roles = MUSIC) -> DataFrame:
    """Album folders that lie below another album folder: root, parent, child. Every ancestor is looked up by an equi-join."""
    from shelfmark.functions.layout import ancestors

    dirs = tracks.select(*roles.folder).distinct()
    below = dirs.select(F.col(roles.root).alias("root"), F.col(roles.dir).alias("child"), F.explode(F.array_compact(ancestors(F.col(roles.dir)))).alias("parent"))
    return below.join(dirs.select(F.col(roles.root).alias("root"), F.col(roles.dir).alias("parent")), ["root", "parent"]).select("root", "parent", "child")


def last_of_folder(roles: Roles = MUSIC) -> Column:
    """Whether a row is the last of its folder in the order of file names."""
    return F.row_number().over(W.partitionBy(*roles.folder).orderBy(F.desc(roles.filename))) == 1
