"""Reports and exports: envelopes, trees, wings, playlists, snapshots. These collect or coalesce; they are for readers."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.functions.normalize import wing_name
from shelfmark.functions.render import song_title, stars_text
from shelfmark.functions.text import trim_all
from shelfmark.operators.playlists import m3u_lines
from shelfmark.schema import MUSIC, Roles
from shelfmark.sources.texts import SNAPSHOT_HEADER, SNAPSHOT_VERSION, map_lines, snapshot_lines, write_lines


def json_report(mode: str, roots: Iterable[str], findings: int, payload: dict[str, Any]) -> str:
    """The envelope of a report."""
    return json.dumps({"mode": mode, "root": list(roots), "findings": findings, "payload": payload}, ensure_ascii=False, indent=2)


def json_summary(mode: str, roots: Iterable[str], dry_run: bool, counts: dict[str, int]) -> str:
    """The envelope of a run that plans or makes changes."""
    return json.dumps({"mode": mode, "root": list(roots), "dry_run": dry_run, "counts": counts}, ensure_ascii=False, indent=2)


def write_report(text: str, output: str | None = None) -> None:
    """A report to a file, or to standard output for none and for a dash."""
    if output in (None, "-"):
        sys.stdout.write(text if text.endswith("\n") else text + "\n")
    else:
        with open(output, "w", encoding="utf-8") as file:
            file.write(text if text.endswith("\n") else text + "\n")


def tree_lines(tracks: DataFrame, albums: DataFrame, roles: Roles = MUSIC) -> DataFrame:
    """The library as a tree of artists, albums and songs: artist, album, place, line, in the order of the tree.

    Each level is marked as the last of its parent by a window over its siblings only.
    """
    song = F.concat(song_title(F.col(roles.filename)), stars_text(F.col(roles.rating)))
    joined = tracks.select(*roles.folder, F.col(roles.filename).alias("file"), song.alias("song")).join(albums.select(F.col("root").alias("_r"), F.col("dir").alias("_d"), "artist", "album"), (F.col(roles.root) == F.col("_r")) & (F.col(roles.dir) == F.col("_d")))
    songs = joined.select("artist", "album", "file", "song")
    last_song = F.row_number().over(W.partitionBy("artist", "album").orderBy(F.desc("file"))) == 1
    named = songs.select("artist", "album").distinct()
    last_album = F.row_number().over(W.partitionBy("artist").orderBy(F.desc("album"))) == 1
    marks = named.withColumn("last_album", last_album)
    glyph = lambda last: F.when(last, "└── ").otherwise("├── ")
    stem = lambda last: F.when(last, "    ").otherwise("│   ")
    of_songs = songs.withColumn("last", last_song).join(marks, ["artist", "album"]).select("artist", "album", F.concat(F.lit("2"), "file").alias("place"), F.concat(stem(F.col("last_album")), glyph(F.col("last")), "song").alias("line"))
    of_albums = marks.select("artist", "album", F.lit("1").alias("place"), F.concat(glyph(F.col("last_album")), "album").alias("line"))
    of_artists = named.select("artist").distinct().select("artist", F.lit("").alias("album"), F.lit("0").alias("place"), F.col("artist").alias("line"))
    return of_artists.unionByName(of_albums).unionByName(of_songs).orderBy("artist", "album", "place")


def wings(albums: DataFrame) -> DataFrame:
    """Each album once per genre of its own: wing, stem (a safe file name) and the album's columns."""
    each = albums.withColumn("wing", F.explode(F.split(F.coalesce("genre", F.lit("Uncategorized")), "/"))).withColumn("wing", trim_all(F.col("wing"))).where("wing <> ''")
    return each.withColumn("stem", wing_name(F.col("wing")))


def write_wings(albums: DataFrame, path: str) -> None:
    """One folder per genre with a line per album. Partitioned by the genre itself, so that equal stems do not collide."""
    rating = F.coalesce(F.bround("mean_rating", 1).cast("string"), F.lit(""))
    line = F.concat_ws(" | ", "artist", "album", F.coalesce("genre", F.lit("")), rating, F.col("n_tracks").cast("string"))
    wings(albums).select("wing", line.alias("line")).repartition("wing").sortWithinPartitions("wing", "line").write.mode("overwrite").partitionBy("wing").text(path)


def write_playlist(tracks: DataFrame, path: str, rule: str | None = None) -> None:
    """A playlist file of the tracks that a rule selects."""
    write_lines(m3u_lines(tracks, rule), path, ["path", "line_no"], ["#EXTM3U"])


def write_snapshot(rows: DataFrame, path: str) -> None:
    """SNAPSHOT rows as a snapshot file."""
    write_lines(snapshot_lines(rows), path, ["path"], [SNAPSHOT_VERSION, SNAPSHOT_HEADER])


def write_map(built: DataFrame, path: str) -> None:
    """`build_map` rows as a genre map."""
    write_lines(map_lines(built).withColumn("folded", F.lower("display")), path, ["folded", "display"], ["# genre authority map: artist, then allowed genres, separated by tabs"])
