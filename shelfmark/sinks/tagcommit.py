"""Committing changes of tags and pictures: dry by default, file by file, each replaced in one step."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.schema import COVER_NAMES
from shelfmark.sinks.commit import Unsafe, protected
from shelfmark.sinks.tagbytes import replace_file, with_comments, with_id3
from shelfmark.sources.containers import read_contents


def extract_art(contents: DataFrame, dry_run: bool = True, name: str = "cover.jpg") -> dict[str, int]:
    """Write the cover of every folder that has none: of its files the first by name with a picture (path, art).

    A folder that has any customary cover file stays as it is. Gives the number of folders by outcome.
    """
    first = contents.where("art is not null").withColumn("folder", F.regexp_replace("path", r"/[^/]*$", "")).groupBy("folder").agg(F.min_by("art", "path").alias("art"))
    counts: dict[str, int] = {}
    for row in first.orderBy("folder").toLocalIterator():
        there = {n.lower() for n in os.listdir(row["folder"])} & set(COVER_NAMES)
        outcome = "exists" if there else "would write" if dry_run else "written"
        if outcome == "written":
            replace_file(os.path.join(row["folder"], name), bytes(row["art"]))
        counts[outcome] = counts.get(outcome, 0) + 1
    return counts


def write_tags(plan: DataFrame, roots: list[str] = (), dry_run: bool = True, log: str | None = None) -> dict[str, int]:
    """Apply a plan (path, tags: map of field to value, null to remove; drop: array of ID3 frames to remove).

    MP3 files get an ID3v2.4 tag, FLAC files their comments with the fields changed; others are `unsupported`, files that
    hold the values already `ok`. A path in a protected root raises Unsafe before anything is changed. Each change is a
    line of the log.
    """
    counts: dict[str, int] = {}
    rows = plan.where(F.col("path").isNotNull()).orderBy("path")
    for row in rows.select("path").toLocalIterator():
        if protected(row["path"], roots):
            raise Unsafe(row["path"])
    for row in rows.toLocalIterator():
        outcome, fields = _changed(row["path"], dict(row["tags"] or {}), tuple(row["drop"] or ()), dry_run)
        counts[outcome] = counts.get(outcome, 0) + 1
        if log and outcome == "written":
            with open(log, "a", encoding="utf-8") as file:
                file.write(f"{row['path']}\t{' '.join(sorted(fields))}\n")
    return counts


def _changed(path: str, fields: dict[str, str | None], drop: tuple[str, ...], dry_run: bool) -> tuple[str, set[str]]:
    ext = os.path.splitext(path)[1].lower()
    if ext not in (".mp3", ".flac"):
        return "unsupported", set()
    try:
        with open(path, "rb") as file:
            data = file.read()
    except OSError:
        return "error", set()
    held = read_contents(data, ext)
    differing = {k for k, v in fields.items() if held.tags.get(k) != (None if v is None else [v])}
    if not differing and not set(drop) & set(held.frames):
        return "ok", set()
    if dry_run:
        return "would write", differing
    if ext == ".mp3":
        made = with_id3(data, fields, drop=drop)
    else:
        merged = {k: "/".join(v) for k, v in held.tags.items()} | fields
        made = with_comments(data, merged)
    replace_file(path, made)
    return "written", differing
