"""Art and tag plans: precedence of outcomes, nulls, empty tables."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import art, tagplans


def test_best_art_asks_formats_in_order_and_first_files_only(spark):
    rows = [("r", "a", "1.flac", ".flac", None), ("r", "a", "2.flac", ".flac", "x"), ("r", "a", "3.mp3", ".mp3", "y"), ("r", "b", "1.mp3", ".mp3", None), ("r", "c", "1.wav", ".wav", "z"), ("r", "d", "1.mp3", ".mp3", "m"), ("r", "d", "2.ogg", ".ogg", "o")]
    df = spark.createDataFrame(rows, "root string, dir string, filename string, ext string, picture string")
    assert sorted((r["dir"], r["picture"]) for r in art.best_art(df).collect()) == [("a", "y"), ("d", "o")]
    assert art.best_art(df.limit(0)).count() == 0


def test_missing_and_small_art(spark):
    folders = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c"), ("r", "a")], "root string, dir string")
    files = spark.createDataFrame([("r", "a", "COVER.JPG"), ("r", "b", "back.jpg")], "root string, dir string, filename string")
    got = {r["dir"]: r["bucket"] for r in art.missing_art(folders, files, folders.where("dir = 'b'")).collect()}
    assert got == {"b": "embedded_only", "c": "none"}
    sizes = spark.createDataFrame([(1, 500, 499), (2, 500, 500), (3, None, None)], "i int, width int, height int")
    assert [r["i"] for r in art.small_art(sizes).collect()] == [1]


@pytest.mark.parametrize(
    "e, c, es, cs, verdict",
    [("x", None, (1, 1), None, "IRRELEVANT"), (None, "x", None, (1, 1), "IRRELEVANT"), ("x", "x", None, None, "MATCH"), ("x", "y", None, (1, 1), "UNREADABLE"), ("x", "y", (1, 1), (1, 1), "SAME PIXELS"), ("x", "y", (1, 2), (1, 1), "DIFFERENT IMAGE")],
)
def test_art_verdict(spark, e, c, es, cs, verdict):
    df = spark.createDataFrame([(e, c, es, cs)], "e string, c string, es struct<w:int,h:int>, cs struct<w:int,h:int>")
    assert df.select(art.art_verdict(*(F.col(x) for x in ("e", "c", "es", "cs")))).first()[0] == verdict


def test_plan_ape(spark):
    fields = [("f", "Title", "x", False, None), ("f", "Artist", "x", None, None), ("f", "GENRE", "x", False, None), ("f", "Rating", "5", False, None), ("f", "Cover Art (Front)", "x", True, "image/png"), ("f", "cover", "x", False, None), ("f", "Odd", "x", True, None), ("f", "Mine", "x", False, None), ("g", "Comment", "x", False, None)]
    df = spark.createDataFrame(fields, "path string, key string, value string, binary boolean, mime string")
    present = spark.createDataFrame([("f", "TIT2"), ("f", "TXXX:mine"), ("g", "COMM"), ("f", "TIT2")], "path string, frame string")
    got = {r["key"]: r["outcome"] for r in tagplans.plan_ape(df, present).collect()}
    assert got == {"Title": "redundant", "Artist": "migrated", "GENRE": "genre dropped", "Rating": "rating dropped", "Cover Art (Front)": "migrated", "cover": "skipped", "Odd": "skipped", "Mine": "redundant", "Comment": "redundant"}
    assert {r["outcome"] for r in tagplans.plan_ape(df, present, keep=False).collect()} == {"genre dropped", "rating dropped", "dropped"}


def test_rating_strip_retag_and_lyrics(spark):
    tags = spark.createDataFrame([(1, "id3", "score", "3"), (2, "id3", "my score", "3"), (3, "vorbis", "my score", "3"), (4, "mp4", "Content Rating", "1"), (5, "asf", "WM/Rating", "0"), (6, "vorbis", "fmps_rating", "0.5"), (7, "vorbis", "rating", None)], "i int, container string, key string, value string")
    assert {r["i"]: r["stars"] for r in tagplans.plan_rating_strip(tags).collect()} == {1: 3.0, 3: 3.0, 6: 2.5}
    files = spark.createDataFrame([("a", ["Rock"], True), ("b", ["Rock"], False), ("c", None, None), ("d", ["Rock", "Pop"], True)], "path string, genres array<string>, plain boolean")
    assert {r["path"]: r["action"] for r in tagplans.plan_retag(files, ["Rock"]).collect()} == {"a": "keep", "b": "retag", "c": "retag", "d": "retag"}
    tracks = spark.createDataFrame([(1, "a", "t", True), (2, None, "t", False), (3, "a", "t", None), (4, "a", "t", False), (5, "a", "t", False), (6, "a", "t", False), (7, "a", "t", False)], "track_id int, artist string, title string, has_sidecar boolean")
    found = spark.createDataFrame([(4, "timeout", None, None), (5, None, True, None), (6, None, False, " "), (7, None, None, "[00:01] la")], "track_id int, error string, instrumental boolean, synced string")
    assert {r["track_id"]: r["status"] for r in tagplans.lyrics_status(tracks, found).collect()} == {1: "exists", 2: "untagged", 3: "not-found", 4: "error", 5: "instrumental", 6: "plain-only", 7: "would-write"}


def test_conversions_subtrees_and_guard(spark):
    pairs = spark.createDataFrame([("a", "b", 10.0, 10.4), ("c", "d", 10.0, 11.0), ("e", "f", None, 1.0)], "source string, target string, source_s double, target_s double")
    assert [r["source"] for r in tagplans.conversions_to_drop(pairs).collect()] == ["a"]
    files = spark.createDataFrame([("r", "a/b"), ("r", "a/b"), ("r", "a"), ("r", "")], "root string, dir string")
    assert {r["folder"]: r["n_files"] for r in tagplans.subtree_counts(files).collect()} == {"a": 3, "a/b": 2}
    assert tagplans.looks_like_library(files) and not tagplans.looks_like_library(files.where("dir = 'a'"))
