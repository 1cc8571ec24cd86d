"""The command line: reports over a table of tracks or over folders of files, and plans that are dry unless applied.

With --scan the tracks are read from the files below one or more roots. Exit codes: 0 done, 1 findings where they are
asked to fail, 2 misuse.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.decode import frame_class
from shelfmark.operators import art, audits, authority, dominant, duplicates, health, places, playlists, snapshot, stats
from shelfmark.operators.playlists import m3u_lines
from shelfmark.operators.tracks import decoded_tracks
from shelfmark.rules import RuleError, compile_rule
from shelfmark.session import local_session, ship
from shelfmark.schema import is_audio
from shelfmark.sinks.reports import json_report, tree_lines, wings, write_report
from shelfmark.sources.binary import fingerprints, read_files
from shelfmark.sources.listing import cover_files, files_of, list_files
from shelfmark.sources.texts import snapshot_lines

def full_path() -> Column:
    return F.concat_ws("/", F.col("root"), F.when(F.col("dir") != "", F.col("dir")), "filename")


def scanned(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The tracks below some roots, read from their files: TRACK columns, with path, frames, facts and art."""
    files = list_files(spark, roots).where(is_audio(F.col("filename"))).withColumn("path", full_path())
    read = decoded_tracks(files.join(read_files(files), "path"))
    number = lambda fact: F.try_element_at("facts", F.lit(fact)).try_cast("double")
    return read.withColumns({"bitrate_kbps": number("bitrate_kbps").cast("int"), "duration_s": F.try_divide(number("samples"), number("sample_rate"))})


def album_art(t: DataFrame, a: argparse.Namespace) -> DataFrame | None:
    """What is known of the art of each folder: of files that were scanned, or of a table given by --art."""
    if a.art:
        return t.sparkSession.read.parquet(a.art)
    if not a.scan:
        return None
    covers = cover_files(list_files(t.sparkSession, [a.tracks, *a.root])).select("root", "dir", F.lit(True).alias("has_cover"))
    inside = t.groupBy("root", "dir").agg(F.bool_or(F.col("art").isNotNull()).alias("has_embedded"))
    unknown = F.lit(None).cast("int")
    return inside.join(covers, ["root", "dir"], "left").withColumns({"cover_width": unknown, "cover_height": unknown})


def _scan_only(t: DataFrame, column: str) -> DataFrame:
    if column not in t.columns:
        raise RuleError("this mode reads files: give folders and --scan")
    return t


def audio_duplicates(t: DataFrame, a: argparse.Namespace) -> DataFrame:
    return duplicates.content_tiers(fingerprints(_scan_only(t, "path").select("path"))).orderBy("tier", "key")


def junk_frames(t: DataFrame, a: argparse.Namespace) -> DataFrame:
    frames = _scan_only(t, "frames").select("path", F.explode("frames").alias("frame")).withColumn("class", frame_class(F.col("frame")))
    return frames.where("class <> 'standard'").groupBy("class", "frame").agg(F.count("*").alias("n_files")).orderBy("class", "frame")


def missing_art(t: DataFrame, a: argparse.Namespace) -> DataFrame:
    listing = list_files(t.sparkSession, [a.tracks, *a.root])
    return art.missing_art(t, listing, _scan_only(t, "art").where("art is not null")).orderBy("root", "dir")


def checked_playlists(t: DataFrame, a: argparse.Namespace) -> DataFrame:
    listing = list_files(t.sparkSession, [a.tracks, *a.root]).withColumn("path", full_path())
    lists = [r["path"] for r in files_of(listing, ".m3u", ".m3u8").select("path").toLocalIterator()]
    texts = t.sparkSession.read.text(lists, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:(?://)?", "").alias("path"), F.col("value").alias("text")) if lists else t.sparkSession.createDataFrame([], "path string, text string")
    return playlists.check_playlists(texts, listing.select("path"))


def snapshot_rows(t: DataFrame) -> DataFrame:
    flags = F.concat(*(F.coalesce(F.col(c).cast("int"), F.lit(0)).cast("string") for c in ("has_track_gain", "has_album_gain")))
    path = F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), "filename")
    return t.select(path.alias("path"), "size", "mtime", F.col("trackno").alias("track"), "rating", "genre", "year", flags.alias("rg"))


#: Mode -> (takes a rule: track, album or none; counts as findings; report).
MODES = {
    "stats": ("track", False, lambda t, a: stats.overview(t)),
    "formats": ("track", False, lambda t, a: stats.by_format(t).orderBy(F.desc("n_files"))),
    "ratings": ("track", False, lambda t, a: stats.rating_histogram(t)),
    "top-genres": ("track", False, lambda t, a: stats.top_values(t, F.col("genre"), 15)),
    "ai-library": ("track", False, lambda t, a: dominant.album_folders(t).orderBy(F.lower("artist"), F.lower("album"))),
    "audit-tags": ("track", True, lambda t, a: audits.incomplete_tags(t, ["root", "dir", "filename"]).orderBy("root", "dir", "filename")),
    "audit-bitrate": ("track", True, lambda t, a: t.where(audits.below_bitrate(floor=a.min_bitrate)).select("root", "dir", "filename", "bitrate_kbps").orderBy("root", "dir", "filename")),
    "audit-replaygain": ("album", True, lambda t, a: audits.gain_coverage(t).where("bucket <> 'OK'").orderBy("root", "dir")),
    "audit-albums": ("album", True, lambda t, a: audits.track_numbers(t).orderBy("root", "dir")),
    "audit-years": ("album", True, lambda t, a: audits.year_findings(t).orderBy("root", "dir")),
    "audit-strays": (None, True, lambda t, a: audits.strays(t, a.layout)),
    "health-score": ("album", True, lambda t, a: health.album_scores(t, album_art(t, a), a.min_bitrate, a.min_art_res).where("score < 100").orderBy("score", "root", "dir")),
    "health": (None, False, lambda t, a: health.digest(t, album_art(t, a), a.layout, a.min_bitrate)),
    "library": ("track", False, lambda t, a: tree_lines(t, dominant.album_folders(t, a.layout)).select("line")),
    "wings": ("track", False, lambda t, a: wings(dominant.album_folders(t, a.layout)).select("wing", "artist", "album", "genre", "mean_rating", "n_tracks").orderBy("wing", "artist", "album")),
    "unknown-files": (None, True, lambda t, a: audits.unknown_files(list_files(_scan_only(t, "path").sparkSession, [a.tracks, *a.root], include_hidden=True)).orderBy("ext")),
    "codecs": ("album", True, lambda t, a: audits.mixed_codecs(t).orderBy("root", "dir")),
    "missing-art": (None, True, missing_art),
    "junk-frames": (None, True, junk_frames),
    "audio-duplicates": (None, True, audio_duplicates),
    "similar-albums": ("album", True, lambda t, a: duplicates.similar_albums(dominant.folder_info(t).withColumn("dir_id", F.xxhash64("root", "dir"))).orderBy(F.desc("ratio"), "id_a", "id_b")),
    "check-playlists": (None, True, checked_playlists),
    "snapshot": (None, False, lambda t, a: snapshot_lines(snapshot_rows(t)).orderBy("path").select("line")),
    "genre-compliance": ("track", True, lambda t, a: authority.compliance(dominant.album_folders(t, a.layout), t.sparkSession.read.parquet(a.map)).orderBy("root", "dir")),
    "duplicates": ("album", True, lambda t, a: duplicates.exact_albums(dominant.folder_info(t)).orderBy("norm_artist", "norm_album")),
    "multi-format": ("album", True, lambda t, a: duplicates.several_formats(t)),
    "track-duplicates": ("album", True, lambda t, a: duplicates.track_clusters(t).orderBy("norm_artist", "norm_title")),
    "playlist": ("playlist", False, lambda t, a: m3u_lines(t, a.rule, a.layout).orderBy("path", "line_no").select("line")),
    "genre-map": ("track", False, lambda t, a: authority.build_map(dominant.album_folders(t)).orderBy(F.lower("display"))),
    "folder-plan": ("track", False, lambda t, a: places.plan_moves(dominant.album_folders(t), allow_new_genre=a.allow_new_genre, staging=a.staging).orderBy("src")),
    "diff": (None, True, lambda t, a: snapshot.diff(t.sparkSession.read.parquet(a.baseline), t).orderBy("kind", "path")),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shelfmark", description=__doc__)
    p.add_argument("mode", choices=sorted(MODES))
    p.add_argument("tracks", help="a Parquet table of tracks (of snapshot rows for diff), or with --scan a folder of files")
    p.add_argument("--scan", action="store_true", help="read the tracks from the files below the given folder")
    p.add_argument("--root", action="append", default=[], help="a further folder to scan")
    p.add_argument("--art", help="a Parquet table of art by folder, for health-score and health")
    p.add_argument("--map", help="a Parquet table of the genre map, for genre-compliance")
    p.add_argument("--where", help="a rule that rows or albums must satisfy")
    p.add_argument("--rule", help="the rule of a playlist")
    p.add_argument("--layout", default="{artist}/{album}")
    p.add_argument("--min-bitrate", type=int, default=192)
    p.add_argument("--min-art-res", type=int, default=500)
    p.add_argument("--allow-new-genre", action="store_true")
    p.add_argument("--staging")
    p.add_argument("--baseline", help="the earlier state for diff")
    p.add_argument("--json", action="store_true")
    p.add_argument("--fail-on-findings", action="store_true")
    p.add_argument("--output", help="a file; standard output if not given")
    return p


def scoped(tracks: DataFrame, where: str | None, scope: str | None) -> DataFrame:
    if where is None:
        return tracks
    if scope not in ("track", "album"):
        raise RuleError("this mode takes no --where")
    held = compile_rule(where)
    return tracks.where(held) if scope == "track" else audits.whole_albums(tracks, held)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    session = spark or SparkSession.getActiveSession() or local_session()
    ship(session)
    scope, finds, report = MODES[args.mode]
    if args.fail_on_findings and not finds:
        print(f"{args.mode} has no findings to fail on", file=sys.stderr)
        return 2
    try:
        tracks = scanned(session, [args.tracks, *args.root]) if args.scan else session.read.parquet(args.tracks)
        rows = report(scoped(tracks, args.where, scope), args)
        lines = [r.asDict(recursive=True) for r in rows.toLocalIterator()]
    except RuleError as error:
        print(f"rule: {error}", file=sys.stderr)
        return 2
    if args.json:
        write_report(json_report(args.mode, [args.tracks], len(lines) if finds else 0, {"items": [{k: v if isinstance(v, (int, float, str, bool, type(None))) else str(v) for k, v in x.items()} for x in lines]}), args.output)
    else:
        write_report("\n".join("\t".join("" if v is None else str(v) for v in x.values()) for x in lines) + "\n", args.output)
    return int(bool(args.fail_on_findings and lines))


if __name__ == "__main__":
    sys.exit(main())
