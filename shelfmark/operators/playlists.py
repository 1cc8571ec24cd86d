"""Playlists: making them by a rule, and checking what they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.layout import DEFAULT_LAYOUT, slot
from shelfmark.rules import compile_rule
from shelfmark.schema import MUSIC, Roles


def path_fallback(layout: str = DEFAULT_LAYOUT, roles: Roles = MUSIC) -> dict[str, Column]:
    """What stands in for missing tags in a playlist rule: the parts of the path, and the file name as the title."""
    stem = F.regexp_replace(F.col(roles.filename), r"(?<=[^.])\.[^.]*$", "")
    return {"artist": slot(F.col(roles.dir), "artist", layout), "album": slot(F.col(roles.dir), "album", layout), "title": stem}


def m3u_lines(tracks: DataFrame, rule: str | None = None, layout: str = DEFAULT_LAYOUT, roles: Roles = MUSIC) -> DataFrame:
    """The lines of a playlist: path, line_no (1 or 2 within a track), line. The header is the writer's."""
    other = path_fallback(layout, roles)
    held = tracks.where(compile_rule(rule, fallback=other))
    path = F.concat_ws("/", roles.root, roles.dir, roles.filename)
    seconds = F.coalesce(F.col(roles.duration).cast("bigint"), F.lit(-1))
    info = F.concat(F.lit("#EXTINF:"), seconds.cast("string"), F.lit(","), F.coalesce(F.col(roles.artist), other["artist"], F.lit("")), F.lit(" - "), F.coalesce(F.col(roles.title), other["title"]))
    return held.select(path.alias("path"), F.posexplode(F.array(info, path)).alias("i", "line")).select("path", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")


def playlist_entries(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The entries of playlists: playlist, line_no, entry, resolved. Comments and blank lines are none; a relative entry
    is resolved to the playlist's folder."""
    lines = texts.select(F.col(path).alias("playlist"), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("i", "line")).select("playlist", (F.col("i") + 1).cast("bigint").alias("line_no"), F.trim(F.regexp_replace("line", "﻿", "")).alias("entry"))
    entries = lines.where("entry <> '' and not startswith(entry, '#')")
    folder = F.regexp_replace("playlist", r"/[^/]*$", "")
    return entries.withColumn("resolved", F.when(F.startswith("entry", F.lit("/")), F.col("entry")).otherwise(F.concat_ws("/", folder, F.col("entry"))))


def check_playlists(texts: DataFrame, listing: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per playlist: has_header, n_entries, n_missing. listing: a column path of what exists."""
    entries = playlist_entries(texts, path, text)
    there = listing.select(F.col("path").alias("resolved")).distinct().withColumn("there", F.lit(True))
    counted = entries.join(there, "resolved", "left").groupBy("playlist").agg(F.count("*").alias("n_entries"), F.count_if(F.col("there").isNull()).alias("n_missing"))
    heads = texts.select(F.col(path).alias("playlist"), F.coalesce(F.contains(F.col(text), F.lit("#EXTM3U")), F.lit(False)).alias("has_header"))
    zero = F.lit(0).cast("bigint")
    return heads.join(counted, "playlist", "left").select("playlist", "has_header", F.coalesce("n_entries", zero).alias("n_entries"), F.coalesce("n_missing", zero).alias("n_missing"))
