"""Files and formats, there and back; plans and their commits; the stream; the command line."""

import hashlib
import json
import os

import pytest
from oracle import DATA

from shelfmark import cli
from shelfmark.sinks import commit, reports
from shelfmark.sources import binary, listing, texts
from shelfmark.schema import SNAPSHOT
from shelfmark.streaming import deliveries


def touch(path, data=b"x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_listing(spark, tmp_path):
    for name in ("A/B/1.mp3", "A/B/.h.mp3", "A/.x/2.mp3", "A/B/Cover.JPG", "A/B/folder.png", "top.flac", "_under/3.ogg"):
        touch(tmp_path / name)
    found = listing.list_files(spark, [str(tmp_path), str(tmp_path)])
    assert sorted((r["dir"], r["filename"]) for r in listing.audio_files(found).collect()) == [("", "top.flac"), ("A/B", ".h.mp3"), ("A/B", "1.mp3"), ("_under", "3.ogg")]
    assert listing.audio_files(listing.list_files(spark, str(tmp_path), include_hidden=True)).count() == 5
    assert [r["cover"] for r in listing.cover_files(found).collect()] == ["Cover.JPG"]


def test_snapshot_round_trip(spark, tmp_path):
    rows = [("b\tx\\t\n", 1, 2, 3, 4.5, "Folk", 1999, "10"), ("a", 9, 8, None, None, None, None, "00")]
    df = spark.createDataFrame(rows, SNAPSHOT)
    reports.write_snapshot(df, str(tmp_path / "s"))
    assert sorted(map(tuple, texts.read_snapshot(spark, str(tmp_path / "s")).collect())) == sorted(rows)
    spark.createDataFrame([("nothing",)], "line string").coalesce(1).write.text(str(tmp_path / "bad"))
    with pytest.raises(texts.NotASnapshot):
        texts.read_snapshot(spark, str(tmp_path / "bad"))


def test_maps_manifests_and_scan_tables(spark):
    lines = spark.createDataFrame(list(enumerate(["# comment", "#1 Dad\tFolk", "", "Jay-Z\tRap\t Pop ", "jay‐z\tJazz", "Solo", "#-- x"], 1)), "line_no int, line string")
    got = {r["display"]: (r["canonical"], r["allowed_norm"]) for r in texts.parse_map(lines).collect()}
    assert got == {"#1 Dad": ("Folk", ["folk"]), "Jay-Z": ("Rap", ["rap", "pop"]), "jay‐z": ("Jazz", ["jazz"]), "Solo": ("", [])}
    manifest = spark.createDataFrame([(1, "# x"), (2, "a\tb\tnow"), (3, "broken")], "line_no int, line string")
    assert [(r["src"], r["dst"]) for r in texts.parse_manifest(manifest).collect()] == [("a", "b")]
    scan = spark.createDataFrame([("d", 1, "Filename\tLoudness (LUFS)\tClipping"), ("d", 2, "a.mp3\t-9.5\tY"), ("d", 3, "Album\t-10\tN")], "dir string, line_no int, line string")
    assert sorted((r["filename"], r["loudness"], r["clipping"], r["is_album"]) for r in texts.parse_loudness(scan, ["dir"]).collect()) == [("Album", -10.0, False, True), ("a.mp3", -9.5, True, False)]


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + w.to_bytes(4) + h.to_bytes(4) + b"\0" * 5


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xff\xc0\x00\x11\x08" + h.to_bytes(2) + w.to_bytes(2) + b"\0" * 10


def test_images():
    assert binary.image_size(png(600, 400)) == (600, 400) and binary.image_size(jpeg(30, 20)) == (30, 20)
    for broken in (b"", None, b"GIF89a", png(1, 1)[:20], b"\xff\xd8\xff\xe0\x00\x01", b"\xff\xd8" + b"\0" * 20):
        assert binary.image_size(broken) is None


def ape(items):
    body = b"".join(len(v).to_bytes(4, "little") + b"\0\0\0\0" + k + b"\0" + v for k, v in items)
    return body + b"APETAGEX" + (2000).to_bytes(4, "little") + (len(body) + 32).to_bytes(4, "little") + len(items).to_bytes(4, "little") + b"\0" * 12


def test_regions_and_tags():
    id3 = b"ID3\x04\x00\x00" + bytes([0, 0, 0, 10]) + b"t" * 10
    tag = ape([(b"Title", b"x"), (b"Rating", b"5")])
    assert binary.audio_regions(id3 + b"sound" + tag + b"TAG" + b"\0" * 125, ".mp3") == [(20, 25)]
    assert binary.audio_regions(b"sound", ".mp3") is None and binary.audio_regions(b"ID3\x04\x00\x00\xff\0\0\0", ".mp3") is None
    assert binary.audio_regions(b"fLaC\x80\x00\x00\x02ab" + b"sound", ".flac") == [(10, 15)] and binary.audio_regions(b"fLaC\x00\x00\x00\xff", ".flac") is None
    box = lambda kind, body: (len(body) + 8).to_bytes(4) + kind + body
    assert binary.audio_regions(box(b"ftyp", b"abcd") + box(b"mdat", b"sound"), ".m4a") == [(20, 25)] and binary.audio_regions(b"\0\0\0\xffmdat", ".m4a") is None
    assert binary.ape_items(b"sound" + tag) == {"Title": b"x", "Rating": b"5"} and binary.ape_items(b"sound") is None and binary.ape_items(tag[5:]) is None


def test_fingerprints(spark, tmp_path):
    touch(tmp_path / "a.mp3", b"ID3\x04\x00\x00" + bytes([0, 0, 0, 2]) + b"tt" + b"sound")
    touch(tmp_path / "b.mp3", b"ID3\x04\x00\x00" + bytes([0, 0, 0, 3]) + b"ttt" + b"sound")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.mp3", "b.mp3", "gone.mp3")], "path string")
    got = {os.path.basename(r["path"]): r for r in binary.fingerprints(paths).collect()}
    assert got["a.mp3"]["stream"] == got["b.mp3"]["stream"] == hashlib.sha256(b"sound").hexdigest()
    assert got["a.mp3"]["full"] != got["b.mp3"]["full"] and got["gone.mp3"]["error"]
    assert binary.read_tags(paths).count() == 3


def test_moves_dry_applied_again_and_reverted(spark, tmp_path):
    touch(tmp_path / "Band/New/1.mp3")
    touch(tmp_path / "Taken/X/1.mp3")
    touch(tmp_path / "Rock/Taken/X/1.mp3")
    plan = spark.createDataFrame([("Band/New", "Rock/Band/New", None), ("Taken/X", "Rock/Taken/X", None), ("Gone/Y", "Rock/Gone/Y", None), ("Skip/Z", None, "NO GENRE")], "src string, dst string, issue string")
    manifest = str(tmp_path / "manifest.tsv")
    assert commit.apply_moves(plan, str(tmp_path), manifest) == {"would move": 1, "dest exists": 1, "missing": 1}
    assert (tmp_path / "Band/New/1.mp3").exists() and not os.path.exists(manifest)
    assert commit.apply_moves(plan, str(tmp_path), manifest, dry_run=False) == {"moved": 1, "dest exists": 1, "missing": 1}
    assert (tmp_path / "Rock/Band/New/1.mp3").exists() and not (tmp_path / "Band").exists()
    assert commit.apply_moves(plan, str(tmp_path), manifest, dry_run=False)["done already"] == 1
    assert commit.revert_moves(manifest) == {"would move": 1}
    assert commit.revert_moves(manifest, dry_run=False) == {"moved": 1} and (tmp_path / "Band/New/1.mp3").exists()


def test_guards_and_sidecars(spark, tmp_path):
    assert commit.protected("/m/a/b", ["/m"]) and not commit.protected("/m/Inbox/b", ["/m"], "Inbox") and not commit.protected("/mm", ["/m"])
    path = str(tmp_path / "x.lrc")
    assert commit.write_sidecar(path, "la") == "written" and commit.write_sidecar(path, "lo") == "exists" and open(path).read() == "la"
    plan = spark.createDataFrame([("a",), ("b",)], "path string")
    assert commit.apply_actions(plan, lambda a: "done", ["path"]) == {"would change": 2}
    assert commit.apply_actions(plan, lambda a: "done", ["path"], dry_run=False) == {"done": 2}
    with pytest.raises(commit.Unsafe):
        commit.apply_actions(plan, lambda a: "done", ["path"], guard=lambda a: a["path"] != "b")
    after = commit.virtual_listing(plan, spark.createDataFrame([("a", "c"), ("x", "y"), ("b", None)], "src string, dst string"))
    assert sorted(r["path"] for r in after.collect()) == ["b", "c"]


def test_wings_tree_and_playlists(spark, tmp_path):
    from shelfmark.operators.dominant import album_folders
    from shelfmark.schema import TRACK

    rows = [("/m", "A/B", f"0{i} - s.mp3", ".mp3", 1, 1, f"s{i}", "A", "B", "Rock/Folk", i, 1999, 320, 4.0, 61.0, True, True) for i in (1, 2)]
    tracks = spark.createDataFrame(rows, TRACK)
    albums = album_folders(tracks)
    reports.write_wings(albums, str(tmp_path / "w"))
    assert sorted(p.name for p in (tmp_path / "w").iterdir() if p.is_dir()) == ["wing=Folk", "wing=Rock"]
    lines = [r["line"] for r in reports.tree_lines(tracks, albums).collect()]
    assert lines == ["A", "└── B", "    ├── 01. s [★★★★☆ 4.0/5]", "    └── 02. s [★★★★☆ 4.0/5]"]
    reports.write_playlist(tracks, str(tmp_path / "p"), "bitrate == 320")
    text = next((tmp_path / "p").glob("part-*")).read_text().splitlines()
    assert text[0] == "#EXTM3U" and len(text) == 5


def test_stream_of_deliveries(spark, tmp_path):
    schema = spark.read.parquet(f"{DATA}/tracks.parquet").schema
    whole = spark.read.parquet(f"{DATA}/tracks.parquet")
    whole.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = deliveries.once(deliveries.deliveries(spark, str(tmp_path / "in"), schema), ["track_id"], "loaded_at", "4000 days")
    deliveries.into_table(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == whole.select("track_id").distinct().count()


def test_stream_of_differences(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1, None, None, None, None, "00")], SNAPSHOT)
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = deliveries.deliveries(spark, str(tmp_path / "in"), SNAPSHOT)
        deliveries.differences(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        spark.createDataFrame([("b", 1, 1, None, None, None, None, "00")], SNAPSHOT).write.mode("append").parquet(str(tmp_path / "in"))
    got = sorted((r["batch"], r["kind"], r["path"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "ADDED", "a"), (1, "MOVED", "a")]


def test_command_line(spark, tmp_path, capsys):
    tracks = f"{DATA}/tracks.parquet"
    assert cli.main(["stats", tracks, "--where", "bitrate >= 320", "--json"], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["mode"] == "stats" and report["payload"]["items"][0]["n_files"] > 0
    out = str(tmp_path / "r.txt")
    assert cli.main(["audit-tags", tracks, "--fail-on-findings", "--output", out], spark) == 1 and open(out).read()
    assert cli.main(["stats", tracks, "--where", "genre.x"], spark) == 2
    assert cli.main(["audit-strays", tracks, "--where", "rating > 1"], spark) == 2
    assert cli.main(["stats", tracks, "--fail-on-findings"], spark) == 2


def test_reports_over_scanned_files(spark, tmp_path):
    from shelfmark.sinks.tagbytes import with_id3

    for name, fields in (("A/One/1.mp3", {"title": "T1", "artist": "A", "album": "One", "genre": "Jazz", "tracknumber": "1"}), ("A/One/2.mp3", {"title": "T2", "TYER": "1999"}), ("A/Two/x.mp3", {"title": "T3"})):
        path = tmp_path / "lib" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(with_id3(b"same sound", fields))
    (tmp_path / "lib/A/One/cover.jpg").write_bytes(b"x")
    (tmp_path / "lib/list.m3u").write_text("#EXTM3U\nA/One/1.mp3\nA/gone.mp3\n")
    lib, out = str(tmp_path / "lib"), str(tmp_path / "out")

    def report(mode, *more):
        assert cli.main([mode, lib, "--scan", "--output", out, *more], spark) == 0, mode
        return [line.split("\t") for line in open(out).read().splitlines()]

    assert len(report("audit-tags")) == 2
    assert report("junk-frames") == [["obsolete", "TYER", "1"]]
    assert [r[0] for r in report("audio-duplicates")] == ["stream"]
    assert [r[1:] for r in report("missing-art")] == [["A/Two", "none"]]
    assert report("check-playlists")[0][0].endswith("list.m3u")
    (tmp_path / "lib/A/One/odd.xyz").write_text("?")
    assert [r[:2] for r in report("unknown-files")] == [[".xyz", "1"]]
    assert len(report("snapshot")) == 3 and len(report("library")) >= 4
    assert {r[1] for r in report("health-score")} == {"A/One", "A/Two"} and report("health")
    tracks = str(tmp_path / "t.parquet")
    spark.createDataFrame([("r", "d", "f.mp3")], "root string, dir string, filename string").write.parquet(tracks)
    assert cli.main(["junk-frames", tracks], spark) == 2
