"""Planned changes of tags, as rows: migrating, stripping and setting them, and looking up what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.decode import ape_action, ape_frame, is_rating_key, stars_of_tag
from shelfmark.functions.layout import ancestors
from shelfmark.operators.stats import filled


def plan_ape(fields: DataFrame, present: DataFrame, keep: bool = True) -> DataFrame:
    """What becomes of each field of files' APE tags: path, key, action, outcome.

    fields: path, key, value, binary (whether the value is bytes), mime (of a picture, null if none). present: path and
    frame of what the newer tag has already; comments, pictures, lyrics and free texts appear there as COMM, APIC, USLT
    and TXXX:key in lower case. Outcomes: genre and rating are reported and dropped, pictures that are none and other
    bytes are skipped, what is there already is redundant, the rest migrates; without `keep` it is dropped.
    """
    action = ape_action(F.col("key"))
    frame = (
        F.when(action == "frame", ape_frame(F.col("key"))).when(action == "comment", "COMM").when(action == "cover", "APIC").when(action == "lyrics", "USLT").when(action == "txxx", F.concat(F.lit("TXXX:"), F.lower(F.trim("key"))))
    )
    there = present.select(F.col("path").alias("_p"), F.col("frame").alias("_f")).distinct()
    joined = fields.withColumns({"action": action, "frame": frame}).join(there, (F.col("path") == F.col("_p")) & (F.col("frame") == F.col("_f")), "left")
    binary = F.coalesce("binary", F.lit(False))
    outcome = (
        F.when(F.col("action") == "genre", "genre dropped")
        .when(F.col("action") == "rating", "rating dropped")
        .when(F.lit(not keep), "dropped")
        .when((F.col("action") == "cover") & (~binary | F.col("mime").isNull()), "skipped")
        .when((F.col("action") != "cover") & binary, "skipped")
        .when(F.col("_f").isNotNull(), "redundant")
        .otherwise("migrated")
    )
    return joined.select("path", "key", "action", outcome.alias("outcome"))


def plan_rating_strip(tags: DataFrame, container: Column | None = None) -> DataFrame:
    """The tags (path, container, key, value) that hold a rating of more than no stars, with their stars."""
    held = F.lit(False)
    for kind in ("id3", "vorbis", "mp4", "asf"):
        held = held | ((F.col("container") == kind) & is_rating_key(F.col("key"), kind))
    stars = stars_of_tag(F.lower("key"), F.col("value"))
    return tags.where(held).withColumn("stars", stars).where("stars > 0")


def plan_retag(files: DataFrame, genres: list[str]) -> DataFrame:
    """Whether setting the genres of files (path, genres array, plain: nothing but the wanted form is there) changes
    anything: path, action (keep or retag). A null array is a file without genres."""
    wanted = F.array(*(F.lit(g) for g in genres)).cast("array<string>")
    same = F.coalesce(F.col("genres") == wanted, F.lit(False)) & F.coalesce("plain", F.lit(True))
    return files.select("path", F.when(same, "keep").otherwise("retag").alias("action"))


def lyrics_status(tracks: DataFrame, found: DataFrame, key: str = "track_id") -> DataFrame:
    """The outcome of looking up lyrics: untagged, error, not-found, instrumental, plain-only, exists or would-write.

    tracks: key, artist, title, has_sidecar. found: key, error, instrumental, synced; a key that is missing was not found.
    """
    joined = tracks.join(found.withColumn("_found", F.lit(True)), key, "left")
    status = (
        F.when(F.coalesce("has_sidecar", F.lit(False)), "exists")
        .when(~filled(F.col("artist")) | ~filled(F.col("title")), "untagged")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("_found").isNull(), "not-found")
        .when(F.coalesce("instrumental", F.lit(False)), "instrumental")
        .when(F.trim(F.coalesce("synced", F.lit(""))) == "", "plain-only")
        .otherwise("would-write")
    )
    return joined.select(key, status.alias("status"))


def conversions_to_drop(pairs: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Converted files (source, target, source_s, target_s) whose source may go: lengths known and nearly equal."""
    return pairs.where(F.coalesce(F.abs(F.col("source_s") - F.col("target_s")) <= tolerance, F.lit(False)))


def subtree_counts(files: DataFrame, directory: str = "dir", root: str = "root") -> DataFrame:
    """Files in and below each folder: root, folder, n_files. Folders are counted before they are spelled out."""
    counted = files.groupBy(F.col(root).alias("root"), F.col(directory).alias("dir")).agg(F.count("*").alias("n")).where("dir <> ''")
    each = F.explode(F.array_append(F.array_compact(ancestors(F.col("dir"))), F.col("dir"))).alias("folder")
    return counted.select("root", each, "n").groupBy("root", "folder").agg(F.sum("n").alias("n_files"))


def looks_like_library(albums: DataFrame) -> bool:
    """Whether any folder of audio lies two levels below the root at least: a guard before plans are applied."""
    return bool(albums.where(F.size(F.filter(F.split("dir", "/"), lambda p: p != "")) >= 2).limit(1).count())


def migration_label(action: Column, key: Column, frame: Column) -> Column:
    """How a report names the migration of an APE field: the field and where it goes."""
    target = F.when(action == "frame", frame).when(action == "txxx", F.concat(F.lit("TXXX:"), key)).when(action == "cover", "APIC").when(action == "lyrics", "USLT").when(action == "comment", "COMM")
    return F.concat(key, F.lit(" -> "), F.coalesce(target, F.lit("(not migrated)")))
