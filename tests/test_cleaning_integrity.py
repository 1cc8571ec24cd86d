"""Cleaning plans on small trees, integrity scans that go on where they stopped, committers of tags and art."""

import pytest

from shelfmark.operators import integrity
from shelfmark.operators.cleaning import after, clean_plan, merge_folders
from shelfmark.operators.dominant import sidecar_genre
from shelfmark.operators.tagplans import migration_label
from shelfmark.sinks.commit import Unsafe
from shelfmark.sinks.tagbytes import with_id3
from shelfmark.sinks.tagcommit import extract_art, write_tags
from shelfmark.sources.binary import read_files
from shelfmark.sources.containers import read_contents

SCHEMA = "root string, dir string, filename string, ext string, size bigint, digest string, pixels bigint"
FILES = [
    ("r", "The Kernels/One", "1.mp3", ".mp3", 10, "a", None), ("r", "The Kernels/One", "2.mp3", ".mp3", 10, "b", None), ("r", "The Kernels/One", "cover.jpg", ".jpg", 5, "c", 100), ("r", "The Kernels/One", "3.mp3", ".mp3", 10, "k", None), ("r", "The Kernels/One", "4.mp3", ".mp3", 10, "l", None),
    ("r", "the kernels/One", "1.mp3", ".mp3", 10, "a", None), ("r", "the kernels/One", "2.mp3", ".mp3", 11, "x", None), ("r", "the kernels/One", "cover.jpg", ".jpg", 6, "d", 400), ("r", "the kernels/Two", "1.mp3", ".mp3", 9, "e", None),
    ("r", "the kernels/One", "notes.txt", ".txt", 1, "f", None), ("r", "The Kernels/One", "notes.txt", ".txt", 2, "g", None), ("r", "Other/Don’t", "a‐b.mp3", ".mp3", 3, "h", None), ("r", ".x/y", "‐.mp3", ".mp3", 3, "i", None),
]


def test_merge_and_names(spark):
    listing = spark.createDataFrame(FILES, SCHEMA)
    got = {(r["dir"], r["filename"]): (r["action"], r["to_dir"], r["to_name"]) for r in merge_folders(listing, 1).collect()}
    assert got == {
        ("the kernels/One", "1.mp3"): ("DROP DUPE", None, None), ("the kernels/One", "2.mp3"): ("KEEP BOTH", "The Kernels/One", "2.from-fragment.mp3"), ("the kernels/One", "cover.jpg"): ("REPLACE IMAGE", "The Kernels/One", "cover.jpg"),
        ("the kernels/Two", "1.mp3"): ("MOVE", "The Kernels/Two", "1.mp3"), ("the kernels/One", "notes.txt"): ("DROP NON-AUDIO", None, None),
    }
    plan = clean_plan(listing)
    names = {(r["dir"], r["filename"]): (r["to_dir"], r["to_name"], r["action"]) for r in plan.where("pass = 3").collect()}
    assert names == {("Other/Don’t", "a‐b.mp3"): ("Other/Don't", "a-b.mp3", "RENAME")}
    state = listing
    for i in (1, 2, 3):
        state = after(state, plan.where(f"pass = {i}"))
    assert clean_plan(state).count() == 0 and state.count() == len(FILES) - 3
    assert clean_plan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scan_goes_on(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    folder = str(seen)

    def decoder(path):
        with open(f"{folder}/{path}", "a") as file:
            file.write("x")
        return {"a": (0, ""), "b": (1, "bad frame\nmore"), "c": (0, "strange"), "d": (0, "LOST_SYNC after processing 5 samples")}[path]

    files = spark.createDataFrame([(p, 1) for p in "abcd"], "path string, size bigint")
    state = str(tmp_path / "state")
    first = integrity.scan(files.where("path < 'c'"), decoder, state, 2)
    assert {(r["path"], r["tier"], r["reason"]) for r in first.collect()} == {("a", "OK", "decode ok"), ("b", "CORRUPT", "bad frame")}
    whole = {r["path"]: (r["tier"], r["reason"]) for r in integrity.scan(files, decoder, state, 2).collect()}
    assert whole["c"] == ("SUSPECT", "1 decoder warning; decoded to end") and whole["d"][0] == "SUSPECT" and len(whole) == 4
    assert all((seen / p).read_text() == "x" for p in "abcd")  # nothing was decoded twice
    assert integrity.command("no-such-program")("x")[0] == 127


def test_tags_and_art_are_committed_once(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4) + b"IHDR" + b"\x00" * 8
    song = tmp_path / "a.mp3"
    song.write_bytes(with_id3(b"sound", {"title": "Old", "genre": "Pop"}, [(png, "image/png")]))
    (tmp_path / "b.wav").write_bytes(b"RIFF")
    contents = read_files(spark.createDataFrame([(str(song),)], "path string"))
    assert extract_art(contents) == {"would write": 1} and extract_art(contents, dry_run=False) == {"written": 1} and extract_art(contents, dry_run=False) == {"exists": 1}
    assert (tmp_path / "cover.jpg").read_bytes() == png
    plan = spark.createDataFrame([(str(song), {"genre": "Jazz"}, None), (str(tmp_path / "b.wav"), {"genre": "Jazz"}, None)], "path string, tags map<string,string>, drop array<string>")
    assert write_tags(plan) == {"would write": 1, "unsupported": 1}
    log = tmp_path / "log"
    assert write_tags(plan, dry_run=False, log=str(log)) == {"written": 1, "unsupported": 1} and "genre" in log.read_text()
    assert write_tags(plan, dry_run=False) == {"ok": 1, "unsupported": 1}
    assert read_contents(song.read_bytes(), ".mp3").tags == {"title": ["Old"], "genre": ["Jazz"]}
    with pytest.raises(Unsafe):
        write_tags(plan, roots=[str(tmp_path)], dry_run=False)


def test_small_ones(spark):
    albums = spark.createDataFrame([("r", "A/1", "Jazz"), ("r", "A/2", "Rock"), ("r", "A/3", "Rock"), ("r", "B", "Pop"), ("r", "C/1", None)], "root string, dir string, genre string")
    assert [tuple(r) for r in sidecar_genre(albums).collect()] == [("r", "A", "Rock")]
    fields = spark.createDataFrame([("frame", "title", "TIT2"), ("txxx", "mood", None), ("genre", "genre", None)], "action string, key string, frame string")
    assert [r[0] for r in fields.select(migration_label(fields["action"], fields["key"], fields["frame"])).collect()] == ["title -> TIT2", "mood -> TXXX:mood", "genre -> (not migrated)"]
