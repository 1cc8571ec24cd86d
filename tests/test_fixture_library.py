"""Nine files whose totals are known, and small cases of single operators."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import decode, layout, normalize, render
from shelfmark.functions.normalize import casefolded
from shelfmark.operators import audits, authority, dominant, duplicates, health, matching, places, playlists, snapshot, stats
from shelfmark.plans import catalogue
from shelfmark.rules import compile_rule
from shelfmark.schema import TRACK, extension

A, B, C, D = "Aphex Twin/Selected Ambient Works", "Compilations/Aphex Twin/Selected Ambient Works", "Cursive/Domestica", "Modern Baseball/Sports"
FILES = [
    (A, "01 - Xtal.flac", "Xtal", "Aphex Twin", "Selected Ambient Works", "Electronic", 1, 5.0, 1.1, 900), (A, "02 - Tha.flac", "Tha", "Aphex Twin", "Selected Ambient Works", "Electronic", 2, 5.0, 1.2, 900),
    (A, "03 - Pulsewidth.flac", "Pulsewidth", "Aphex Twin", "Selected Ambient Works", "Electronic", 3, 4.0, 1.3, 900), (B, "01 - Xtal.flac", "Xtal", "Aphex Twin", "Selected Ambient Works", "Electronic", 1, None, 1.1, 900),
    (B, "02 - Tha.flac", "Tha", "Aphex Twin", "Selected Ambient Works", "Electronic", 2, None, 1.2, 900), (C, "01 - The Casualty.mp3", "The Casualty", "Cursive", "Domestica", "Rock", 1, 5.0, 1.1, 320),
    (C, "02 - The Martyr.mp3", "The Martyr", "Cursive", "Domestica", None, 2, None, 1.2, 96), (D, "01 - Re-do.flac", "Re-do", "Modern Baseball", "Sports", "Indie", 1, None, 1.2, 900),
    (D, "01 - Re-do.mp3", "Re-do", "Modern Baseball", "Sports", "Indie", 1, None, 1.2, 256),
]


@pytest.fixture(scope="module")
def tracks(spark):
    rows = [("/m", d, f, "." + f.rsplit(".")[-1], 1000, 7, t, a, al, g, n, None, b, r, s, False, False) for d, f, t, a, al, g, n, r, s, b in FILES]
    return spark.createDataFrame(rows, TRACK)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], TRACK)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_totals(tracks):
    total = stats.overview(tracks).first()
    assert (total["n_files"], total["total_bytes"], total["n_fully_tagged"]) == (9, 9000, 8)
    assert rows(stats.by_format(tracks), "ext", "n_files") == [(".flac", 6), (".mp3", 3)]
    assert dict(rows(stats.rating_histogram(tracks), "label", "n_tracks")) == {"1": 0, "2": 0, "3": 0, "4": 1, "5": 3, "unrated": 5}
    assert tracks.where(compile_rule("rating >= 5")).count() == 3
    assert stats.top_values(tracks, F.col("genre"), 2).collect()[0]["value"] == "Electronic"
    low = stats.bitrates(tracks).first()
    assert (low["least"], low["n_below_floor"]) == (96, 1)


def test_duplicates(tracks):
    info = dominant.folder_info(tracks)
    assert rows(duplicates.exact_albums(info), "norm_artist", "norm_album", "n_dirs") == [("aphex twin", "selected ambient works", 2)]
    assert rows(duplicates.several_formats(tracks), "dir", "formats") == [(D, ".flac .mp3")]
    assert rows(duplicates.track_clusters(tracks), "norm_title", "n_copies") == [("tha", 2), ("xtal", 2)]
    assert rows(audits.incomplete_tags(tracks, ["filename"]), "filename", "missing") == [("02 - The Martyr.mp3", "genre")]
    assert rows(audits.missing_breakdown(tracks), "field", "n_tracks") == [("genre", 1)]


@pytest.mark.parametrize("lengths, clusters", [([100, 101], [100]), ([100, 200], []), ([100, 101, 240, 241], [100, 240]), ([None, None], [None]), ([100, 101.5, 103], [100]), ([0, 2, 4, 6], [0, 4])])
def test_clusters_by_duration(spark, lengths, clusters):
    rows_ = [("/m", f"d{i}", "f", ".mp3", 1, 1, "T", "A", None, None, None, None, None, None, float(x) if x is not None else None, None, None) for i, x in enumerate(lengths)]
    got = duplicates.track_clusters(spark.createDataFrame(rows_, TRACK)).collect()
    assert sorted((r["anchor"] for r in got), key=str) == sorted((None if c is None else float(c) for c in clusters), key=str)
    same = spark.createDataFrame([(*r[:1], "one", *r[2:]) for r in rows_], TRACK)
    assert duplicates.track_clusters(same).count() == 0


def test_audits(tracks):
    assert {r["bucket"] for r in audits.gain_coverage(tracks).collect()} == {"MISSING"}
    assert rows(audits.mixed_codecs(tracks), "dir", "codecs") == [(D, ".flac + .mp3")]
    assert rows(audits.track_numbers(tracks), "dir", "dupes") == [(D, "1")]
    assert len(audits.year_findings(tracks).collect()) == 4
    assert dict(rows(audits.strays(tracks), "bucket", "n_files")) == {"placed": 9}
    assert audits.whole_albums(tracks, compile_rule("rating == 4")).count() == 3
    nested = tracks.select("root", "dir").distinct().union(tracks.select("root", F.lit("Cursive")).distinct())
    assert rows(audits.nested_folders(nested), "parent", "child") == [("Cursive", C)]


@pytest.mark.parametrize("n, bucket", [((0, 0, 3), "MISSING"), ((1, 0, 3), "PARTIAL"), ((3, 2, 3), "NO_ALBUM_GAIN"), ((3, 3, 3), "OK")])
def test_gain_bucket(spark, n, bucket):
    assert spark.createDataFrame([n], "t int, a int, n int").select(audits.gain_bucket(F.col("t"), F.col("a"), F.col("n"))).first()[0] == bucket


def test_dominant_ties_go_to_the_first(spark):
    rows_ = [("/m", "d", f"{i}", ".mp3", 1, 1, None, a, "", None, None, None, None, None, None, None, None) for i, a in enumerate(["x", "b", "b", "x", None, ""])]
    got = dominant.album_folders(spark.createDataFrame(rows_, TRACK)).first()
    assert (got["artist"], got["album"], got["genre"], got["n_tracks"]) == ("x", None, None, 6)


def test_health(tracks, spark):
    art = spark.createDataFrame([("/m", A, True, 600, 400, False), ("/m", C, False, None, None, True)], "root string, dir string, has_cover boolean, cover_width int, cover_height int, has_embedded boolean")
    score = {r["dir"]: r for r in health.album_scores(tracks, art).collect()}
    assert (score[A]["score"], score[A]["art_cost"], score[A]["gain_cost"]) == (62, 8, 30)
    assert (score[C]["tags_cost"], score[C]["art_cost"], score[C]["bitrate_cost"], score[C]["score"], score[C]["grade"]) == (4, 12, 2, 52, "C")
    assert score[B]["art_cost"] == 20
    assert health.grades(health.album_scores(tracks, art)).first()["n_albums"] == 4
    assert dict(rows(health.digest(tracks, art), "finding", "n"))["duplicate_albums"] == 1


def test_gain_cost_rounds_to_even(spark):
    rows_ = [("/m", "d", f"{i}", ".mp3", 1, 1, "t", "a", "b", "g", 1, 2000, 320, 1.0, 1.0, i == 0, False) for i in range(4)]
    none = spark.createDataFrame([], "root string, dir string, has_cover boolean, cover_width int, cover_height int, has_embedded boolean")
    assert health.album_scores(spark.createDataFrame(rows_, TRACK), none).first()["gain_cost"] == 22


def test_snapshots(spark):
    schema = "path string, size long, mtime long, track int, rating double, genre string, year int, rg string"
    old = spark.createDataFrame([("a", 1, 1, 1, None, "x", 1, "11"), ("b", 2, 2, 1, None, None, 1, "11"), ("c", 3, 3, 1, 1.0, "x", 1, "11"), ("d", 4, 4, 1, None, "x", 1, "11"), ("e", 9, 9, 1, None, "x", 1, "11"), ("f", 9, 9, 1, None, "x", 1, "11")], schema)
    new = spark.createDataFrame([("z", 1, 1, 2, None, "y", 1, "11"), ("b", 5, 2, 1, None, "n", 1, "11"), ("c", 4, 3, 1, 1.0, "x", 1, "11"), ("d", 4, 8, 1, None, "x", 1, "11"), ("q", 9, 9, 1, None, "x", 1, "11"), ("new", 7, 7, 1, None, "x", 1, "11")], schema)
    assert rows(snapshot.diff(old, new), "kind", "path", "detail") == [("ADDED", "new", ""), ("MOVED", "a", "z"), ("MOVED", "e", "q"), ("REMOVED", "f", ""), ("RESIZED", "c", "3 -> 4"), ("RETAGGED", "b", "genre (none) -> n")]
    assert snapshot.diff(old.limit(0), new.limit(0)).count() == 0


def test_authority(spark):
    albums = spark.createDataFrame([("/m", "1", "Jay-Z", "Rap"), ("/m", "2", "JAY‐Z", "Rap"), ("/m", "3", "Jay-Z", "Pop"), ("/m", "4", "Various Artists", "Rap"), ("/m", "5", None, "Rap"), ("/m", "6", "New", None)], "root string, dir string, artist string, genre string")
    built = {r["artist_norm"]: r for r in authority.build_map(albums).collect()}
    assert (built["jay-z"]["display"], built["jay-z"]["genres"], built["various artists"]["excluded"], built["new"]["n_genres"]) == ("Jay-Z", "Rap\tPop", True, 0)
    entries = spark.createDataFrame([(1, "Jay-Z", "Folk", ["folk"]), (2, "jay‐z", "Rap", ["rap"]), (3, "Blank", "", [])], "entry_id int, display string, canonical string, allowed_norm array<string>")
    got = {r["dir"]: (r["outcome"], r["target"]) for r in authority.compliance(albums, entries).collect()}
    assert got == {"1": ("ok", None), "2": ("ok", None), "3": ("retag", "Rap"), "4": ("excluded", None), "5": ("unmapped", None), "6": ("unmapped", None)}
    assert rows(authority.new_artists(albums, entries), "artist_norm", "n_albums") == [("new", 1)]


def test_folder_plans(spark):
    albums = spark.createDataFrame(
        [("Rock/Band/Old", "Rock"), ("Band/New", "rock; Pop"), ("Band/New/CD2", "Rock"), ("Other/X", "Jazz"), ("Solo", "Rock"), ("a/b/c/d/e", "Rock"), ("Inbox/Band/New", "Rock"), ("Inbox/a/b/c", "Rock"), ("", "Rock"), ("Band/None", None), ("Rock/Band/Wrong", "Jazz")],
        "dir string, genre string",
    )
    got = {r["path"]: (r["src"], r["dst"], r["issue"]) for r in places.plan_moves(albums, staging="Inbox").collect()}
    assert got["Rock/Band/Old"][2] == "IN PLACE" and got["Rock/Band/Wrong"][2] == "NOTE"
    assert got["Band/New"] == ("Band/New", "Rock/Band/New", None) and got["Band/New/CD2"][2] == "SAME UNIT"
    assert got["Other/X"][2] == "UNKNOWN GENRE" and got["Solo"][:2] == ("Solo", "Rock/Solo/Singles")
    assert got["a/b/c/d/e"][2] == "TOO DEEP" and got["Inbox/a/b/c"][2] == "STAGED TOO DEEP" and got[""][2] == "SKIP" and got["Band/None"][2] == "NO GENRE"
    assert got["Inbox/Band/New"][2] == "COLLISION"
    free = {r["path"]: r["issue"] for r in places.plan_moves(albums, spark.createDataFrame([("Jazz/Other/X",)], "dst string"), allow_new_genre=True, refile=True).collect()}
    assert free["Other/X"] == "DEST EXISTS" and free["Rock/Band/Wrong"] is None


def test_playlists(spark, tracks):
    lines = [r["line"] for r in playlists.m3u_lines(tracks, "rating >= 4 AND artist == 'Cursive'").orderBy("path", "line_no").collect()]
    assert lines == ["#EXTINF:1,Cursive - The Casualty", f"/m/{C}/01 - The Casualty.mp3"]
    texts = spark.createDataFrame([("/m/lists/a.m3u", "#EXTM3U\n#EXTINF:1,x\n/m/x.mp3\n\ny.mp3\r\n/gone.mp3"), ("/m/lists/b.m3u", ""), ("/m/lists/c.m3u", None)], "path string, text string")
    there = spark.createDataFrame([("/m/x.mp3",), ("/m/lists/y.mp3",)], "path string")
    assert rows(playlists.check_playlists(texts, there), "playlist", "has_header", "n_entries", "n_missing") == [("/m/lists/a.m3u", True, 3, 1), ("/m/lists/b.m3u", False, 0, 0), ("/m/lists/c.m3u", False, 0, 0)]


def value(spark, column, *args):
    names = "abcdef"[: len(args)]
    kinds = {str: "string", int: "int", float: "double", type(None): "string", list: "array<string>", bytes: "binary"}
    df = spark.createDataFrame([args], ", ".join(f"{n} {kinds[type(a)]}" for n, a in zip(names, args)))
    return df.select(column(*(F.col(n) for n in names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, args, want",
    [
        (normalize.name_key, ("  Director’s   CUT ",), "director's cut"), (normalize.folder_key, ("Director’s Cut",), "directors cut"), (normalize.name_key, ("Ｆｕｌｌ–Width…",), "full-width..."), (normalize.name_key, (None,), ""),
        (normalize.loose_key, ("Album (Deluxe) [2010]",), "album"), (normalize.loose_key, ("Song feat. Somebody",), "song"), (normalize.loose_key, ("Left (x) side",), "left (x) side"), (normalize.rendered, ("a‐b  “c” 85–92",), "a-b “c” 85–92"),
        (normalize.tag_text, ("Tim O\x92Brien  \x93x\x94 85–92",), "Tim O'Brien \"x\" 85–92"), (normalize.base_artist, ("Bonnie feat. Tim",), "Bonnie"), (normalize.base_artist, ("Left Swift",), "Left Swift"),
        (normalize.deduplicated_tag, ("A / a / A feat. B",), "A feat. B"), (normalize.deduplicated_tag, ("A / A",), "A"), (normalize.deduplicated_tag, ("Ab ; Cde",), "Cde ; Ab"), (normalize.deduplicated_tag, ("plain",), "plain"),
        (normalize.legal_name, ("AC/DC",), False), (normalize.legal_name, ("x.",), False), (normalize.legal_name, ("fine",), True), (normalize.path_component, ("AC/DC: Live?.",), "AC DC Live"), (normalize.path_component, ("...",), "Unknown"), (normalize.wing_name, ("Rock & Roll",), "Rock___Roll"),
        (decode.stars_of_number, ("3",), 3.0), (decode.stars_of_number, ("8",), 4.0), (decode.stars_of_number, ("80",), 4.0), (decode.stars_of_number, ("255",), 5.0), (decode.stars_of_number, ("256",), None), (decode.stars_of_number, ("L",), None), (decode.stars_of_number, ("-2",), -2.0),
        (decode.stars_of_byte, (196,), 4.0), (decode.stars_of_byte, (1,), 1.0), (decode.looks_numeric, ("4.5",), True), (decode.looks_numeric, ("",), False), (decode.looks_numeric, ("-1",), False), (decode.looks_numeric, (None,), False),
        (decode.track_number, ("3/12",), 3), (decode.track_number, ("0",), None), (decode.track_number, ("x",), None), (decode.year_of, ("1985-03-01",), 1985), (decode.year_of, ("19851",), None), (decode.year_of, ("0999",), None), (decode.year_of, (None,), None),
        (decode.gain_db, ("r128_track_gain", "-512"), -2.0), (decode.gain_db, ("replaygain_track_gain", "-7.5 dB"), -7.5), (decode.gain_db, ("replaygain_track_gain", "loud"), None), (decode.gain_convention, ("TXXX:replaygain_album_gain",), "rg"),
        (decode.tag_value, (["a", "b\x00c"],), "a/b/c"), (decode.tag_value, ([" "],), None), (decode.ape_action, ("Cover Art (Front)",), "cover"), (decode.ape_action, ("Title",), "frame"), (decode.ape_frame, ("YEAR",), "TDRC"), (decode.ape_action, ("Odd",), "txxx"),
        (render.duration_text, (61.9,), "1:01"), (render.duration_text, (0.0,), "--:--"), (render.size_text, (2048,), "2.0 KB"), (render.stars_text, (3.5,), " [★★★☆☆ 3.5/5]"), (render.song_title, ("01 - Xtal.flac",), "01. Xtal"), (render.song_title, ("Band - 3 Song.mp3",), "03. Song"), (render.song_title, ("Plain.mp3",), "Plain"),
        (extension, ("a.b.FLAC",), ".flac"), (extension, (".hidden",), ""), (extension, ("none",), ""), (extension, (".h.mp3",), ".mp3"),
    ],
)
def test_values(spark, f, args, want):
    assert value(spark, f, *args) == want


def test_credited_artist(spark):
    both = lambda raw: value(spark, normalize.credited_artist, raw, "Will Oldham")
    assert both("x feat. Tim") == "Will Oldham feat. Tim" and both("x (feat. Tim)") == "Will Oldham feat. Tim" and both("Swift") == "Will Oldham"


def test_best_rating_and_year_of_tags(spark):
    tags = [("album rating", "5"), ("RATING", "L"), ("Score", "900"), ("stars", "4")], {"TDRC": "1999-01-01", "originaldate": "2001", "musicbrainz_date": "1234"}
    df = spark.createDataFrame([tags], "c array<struct<key:string,value:string>>, m map<string,string>")
    assert df.select(decode.best_rating(F.col("c"))).first()[0] is None  # the score comes first and tells nothing
    assert df.select(decode.best_rating(F.slice("c", 4, 1))).first()[0] == 4.0
    assert df.select(decode.year_of_tags(F.col("m"))).first()[0] == 2001


@pytest.mark.parametrize(
    "code, said, declared, tier",
    [(0, "", None, "OK"), (0, None, None, "OK"), (1, "", None, "CORRUPT"), (0, "[png @ 0] odd\nHeader missing", None, "METADATA"), (0, "strange", None, "SUSPECT"), (1, "LOST_SYNC after processing 10 samples", 20, "CORRUPT"), (1, "LOST_SYNC after processing 20 samples", 20, "SUSPECT"), (1, "LOST_SYNC after processing 20 samples", None, "SUSPECT")],
)
def test_decode_tiers(spark, code, said, declared, tier):
    df = spark.createDataFrame([(code, said, declared)], "c int, s string, d long")
    assert df.select(decode.decode_tier(F.col("c"), F.col("s"), F.col("d"))).first()[0] == tier


@pytest.mark.parametrize("path, kind", [("A/B/s.mp3", "placed"), ("A/B/CD1/s.mp3", "placed"), ("A/s.mp3", "loose"), ("s.mp3", "wrong-depth"), ("A/.B/s.mp3", "hidden"), (".s.mp3", "hidden")])
def test_strays(spark, path, kind):
    assert value(spark, lambda c: layout.stray_class(c, 1, 2), path) == kind


def test_layouts():
    assert layout.layout_depths("{genre}/{artist}/{album}") == (2, 3)
    with pytest.raises(ValueError):
        layout.layout_depths("{genre}/{artist}")


def test_nearest_of_all_others(spark):
    rows_ = [(1, "k", 100.0), (2, "k", 100.0), (3, "k", 101.5), (4, "k", 103.5), (5, "k", 400.0), (6, "k", None), (7, "n", 9.0), (8, None, 9.0), (9, None, 9.0), (10, "m", 5.0), (11, "m", 3.9999), (12, "m", 6.0), (13, "m", 7.1)]
    wanted = spark.createDataFrame(rows_, "id int, k string, duration double")
    got = matching.nearest_duration(wanted, wanted.withColumnRenamed("id", "offer_id"), ["k"], itself=False)
    assert rows(got, "id", F.coalesce("offer_id", F.lit(-1)), "how") == [
        (1, 2, "near"), (2, 1, "near"), (3, 1, "near"), (4, 3, "near"), (5, 1, "first"), (6, 1, "first"), (7, -1, "none"), (8, -1, "none"), (9, -1, "none"), (10, 12, "near"), (11, 10, "near"), (12, 10, "near"), (13, 12, "near"),
    ]


def test_nearest_of_many_equal_durations(spark):
    wanted = spark.range(3000).select(F.col("id").cast("int").alias("id"), F.lit("k").alias("k"), (100 + F.col("id") % 3 * 0.5).alias("duration"))
    got = matching.nearest_duration(wanted, wanted.withColumnRenamed("id", "offer_id"), ["k"], itself=False)
    assert got.where("how = 'near' and offer_id = (case when id < 3 then id + 3 else id % 3 end)").count() == 3000


def test_content_tiers_read_to_the_end(spark, tmp_path):
    long, ends = "one opening that all of these texts share, longer than any prefix " * 9, ["first", "other"]
    texts = [f"{long}\nbody {e}" for e in ends] + ["Title A\nthe same body", "Title B\nthe same body"] + [long + e for e in ends] + [f"{long} {m} {long}" for m in ends]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.dupes_content_tiers_whole(spark, str(tmp_path)).select("tier", "n_files").collect()
    assert sorted(map(tuple, got)) == [("sampled", 2), ("stream", 2)]


def test_casefolded(spark):
    texts = ["Straße", "ΝΎΧΤΑΣ", "νύχτας", "ﬁN", "İ", "Ðé", "plain", "", "ᾳ", "ẞ"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    assert [r[0] for r in df.select(casefolded(F.col("c"))).collect()] == [t.casefold() for t in texts]


def test_exact_name_before_first(spark):
    wanted = spark.createDataFrame([(1, "k", "STRASSE", 100.0), (2, "k", "Straße", None), (3, "k", "Street", 900.0), (4, "k", "strasse", 50.0)], "id int, k string, title string, duration double")
    offers = spark.createDataFrame([(5, "k", "Other", 49.0), (6, "k", None, 500.0), (7, "k", "Strasse", 300.0), (8, "k", "Strasse", 700.0)], "offer_id int, k string, title string, duration double")
    got = matching.nearest_duration(wanted, offers, ["k"], names=("title",))
    assert rows(got, "id", "offer_id", "how") == [(1, 7, "exact"), (2, 7, "exact"), (3, 5, "first"), (4, 5, "near")]
    library = spark.createDataFrame([(1, "k", "A", 10.0), (2, "k", "B", 20.0), (3, "k", "b", 40.0)], "id int, k string, title string, duration double")
    got = matching.nearest_duration(library, library.withColumnRenamed("id", "offer_id"), ["k"], itself=False, names=("title",))
    assert rows(got, "id", "offer_id", "how") == [(1, 2, "first"), (2, 3, "exact"), (3, 2, "exact")]


def test_matching(spark):
    wanted = spark.createDataFrame([(1, "k", 100.0), (2, "k", 500.0), (3, "n", 1.0), (4, "k", None)], "id int, k string, duration double")
    offers = spark.createDataFrame([(7, "k", 101.9), (8, "k", 99.0), (9, "k", None)], "offer_id int, k string, duration double")
    assert rows(matching.nearest_duration(wanted, offers, ["k"]), "id", F.coalesce("offer_id", F.lit(-1)), "how") == [(1, 8, "near"), (2, 7, "first"), (3, -1, "none"), (4, 7, "first")]
    marked = spark.createDataFrame([("a", "A"), ("a/b", "B")], "folder string, name string")
    files = spark.createDataFrame([("a/b/c",), ("a/x",), ("z",), (None,)], "dir string")
    assert {r["dir"]: r["authority"] for r in matching.nearest_ancestor(files, "dir", marked, "folder", "name").collect()} == {"a/b/c": "B", "a/x": "A", "z": None, None: None}
    folders = spark.createDataFrame([("p", "The Band", 3), ("p", "the  band", 5), ("p", "Other", 1), ("q", "The Band", 1), ("p", ".the band", 9)], "parent string, name string, n int")
    assert rows(matching.same_name_folders(folders, "parent", "name", "n"), "canonical", "source") == [("the  band", "The Band")]
    source = spark.createDataFrame([("a.mp3", 1, "x", ".mp3", None), ("b.mp3", 1, "x", ".mp3", None), ("c.jpg", 9, "x", ".jpg", 100), ("d.jpg", 9, "x", ".jpg", None), ("e.txt", 1, "y", ".txt", None), ("n.mp3", 1, "x", ".mp3", None)], "rel string, size int, digest string, ext string, pixels int")
    target = spark.createDataFrame([("a.mp3", 1, "x", ".mp3", None), ("b.mp3", 1, "y", ".mp3", None), ("c.jpg", 1, "z", ".jpg", 50), ("d.jpg", 1, "z", ".jpg", 50), ("e.txt", 2, "z", ".txt", None)], source.schema)
    assert dict(rows(matching.merge_plan(source, target), "rel", "action")) == {"a.mp3": "DROP DUPE", "b.mp3": "KEEP BOTH", "c.jpg": "REPLACE IMAGE", "d.jpg": "DROP IMAGE", "e.txt": "DROP NON-AUDIO", "n.mp3": "MOVE"}


def test_empty_tables(empty):
    assert stats.overview(empty).first()["n_files"] == 0 and stats.rating_histogram(empty).count() == 6
    for df in (dominant.album_folders(empty), dominant.folder_info(empty), audits.track_numbers(empty), audits.year_findings(empty), audits.gain_coverage(empty), duplicates.several_formats(empty), duplicates.track_clusters(empty)):
        assert df.count() == 0
