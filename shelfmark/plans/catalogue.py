"""Queries of the catalogue operators over the music tables, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import decode, layout, normalize, render
from shelfmark.functions.normalize import SQL_FEATURING, sql_deduplicated_tag, sql_loose_key, sql_name_key, sql_tag_text
from shelfmark.functions.text import trim_all
from shelfmark.operators import art, audits, authority, dominant, duplicates, health, matching, places, playlists, snapshot, stats, tagplans
from shelfmark.rules import compile_rule
from shelfmark.schema import latest_delivery
from shelfmark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The tracks, each once: a second delivery repeats a row.
T = "WITH t AS (SELECT * FROM tracks QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY loaded_at DESC) = 1)"
ALBUM_SQL = """
, counted AS (
  SELECT root, dir, i, v, count(*) AS n, min(filename) AS first FROM (
    SELECT root, dir, filename, unnest([0, 1, 2]) AS i, unnest([artist, album, genre]) AS v FROM t
  ) WHERE coalesce(v, '') <> '' GROUP BY ALL
), best AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY root, dir, i ORDER BY n DESC, first) = 1
), sums AS (SELECT root, dir, count(*) AS n_tracks, round(avg(rating), 6) AS mean_rating FROM t GROUP BY ALL
), albums AS (
  SELECT s.root, s.dir, coalesce(a.v, nullif(split_part(s.dir, '/', 1), '')) AS artist, coalesce(b.v, nullif(split_part(s.dir, '/', 2), '')) AS album, g.v AS genre, s.n_tracks, s.mean_rating
  FROM sums s LEFT JOIN best a ON a.root = s.root AND a.dir = s.dir AND a.i = 0
  LEFT JOIN best b ON b.root = s.root AND b.dir = s.dir AND b.i = 1
  LEFT JOIN best g ON g.root = s.root AND g.dir = s.dir AND g.i = 2
)"""
MISSING = "(CASE WHEN coalesce(title, '') = '' THEN 1 ELSE 0 END + CASE WHEN coalesce(artist, '') = '' THEN 1 ELSE 0 END + CASE WHEN trackno IS NULL THEN 1 ELSE 0 END + CASE WHEN coalesce(genre, '') = '' THEN 1 ELSE 0 END)"


def query(name: str, sql: str | None = None):
    """Register a function of (session, folder) under a name, with its SQL if there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def current(spark: SparkSession, d: str) -> DataFrame:
    return latest_delivery(table(spark, d, "tracks"), "track_id")


# --- statistics -------------------------------------------------------------------------------------------------------


@query(
    "stats_overview",
    T + """
SELECT count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_bytes, round(sum(duration_s), 3) AS total_duration_s,
  count(DISTINCT nullif(split_part(dir, '/', 1), '')) AS n_artist_dirs,
  count(DISTINCT CASE WHEN split_part(dir, '/', 2) <> '' THEN root || chr(9) || dir END) AS n_album_dirs,
  count(*) FILTER (WHERE coalesce(title, '') <> '' AND coalesce(artist, '') <> '' AND trackno IS NOT NULL AND coalesce(genre, '') <> '') AS n_fully_tagged FROM t""",
)
def stats_overview(spark, d):
    return stats.overview(current(spark, d))


@query("stats_format_breakdown", T + " SELECT ext, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_bytes FROM t GROUP BY ext")
def stats_format_breakdown(spark, d):
    return stats.by_format(current(spark, d))


_LABEL = "CASE WHEN rating IS NULL THEN 'unrated' ELSE CAST(least(greatest(CAST(trunc(rating) AS BIGINT), 1), 5) AS VARCHAR) END"


@query("stats_rating_histogram", T + f" SELECT l.label, count(t.track_id) AS n_tracks FROM (SELECT unnest(['1','2','3','4','5','unrated']) AS label) l LEFT JOIN t ON {_LABEL} = l.label GROUP BY l.label")
def stats_rating_histogram(spark, d):
    return stats.rating_histogram(current(spark, d))


@query(
    "stats_rating_by_genre",
    T + " SELECT genre, " + ", ".join(f"count(*) FILTER (WHERE {_LABEL} = '{x}') AS r_{x}" for x in stats.LABELS) + " FROM t WHERE coalesce(genre, '') <> '' GROUP BY genre",
)
def stats_rating_by_genre(spark, d):
    return stats.rating_by_genre(current(spark, d))


@query("stats_bitrate_summary", T + " SELECT count(*) AS n, min(bitrate_kbps) AS least, max(bitrate_kbps) AS most, round(avg(bitrate_kbps), 6) AS mean, count(*) FILTER (WHERE bitrate_kbps < 192) AS n_below_floor FROM t WHERE bitrate_kbps <> 0")
def stats_bitrate_summary(spark, d):
    return stats.bitrates(current(spark, d))


def _top_sql(value: str) -> str:
    return T + f" SELECT value, n_tracks FROM (SELECT {value} AS value, count(*) AS n_tracks, min((root, dir, filename)) AS first FROM t WHERE coalesce({value}, '') <> '' GROUP BY 1) ORDER BY n_tracks DESC, first LIMIT 15"


@query("stats_top_genres", _top_sql("genre"))
def stats_top_genres(spark, d):
    return stats.top_values(current(spark, d), F.col("genre"), 15)


@query("stats_top_artists", _top_sql("coalesce(artist, nullif(split_part(dir, '/', 1), ''))"))
def stats_top_artists(spark, d):
    return stats.top_values(current(spark, d), F.coalesce("artist", layout.slot(F.col("dir"), "artist")), 15)


@query("stats_where_scoped", T + " SELECT count(*) AS n_matched, (SELECT count(*) FROM t) AS n_scanned, count(DISTINCT genre) AS n_genres FROM t WHERE coalesce(bitrate_kbps, 0) >= 192 AND contains(coalesce(genre, ''), 'Metal')")
def stats_where_scoped(spark, d):
    held = compile_rule("bitrate >= 192 AND 'Metal' in genre")
    return current(spark, d).agg(F.count_if(held).alias("n_matched"), F.count("*").alias("n_scanned"), F.count_distinct(F.when(held, F.col("genre"))).alias("n_genres"))


# --- the rule language ------------------------------------------------------------------------------------------------

_RULES = {
    "rule_numeric": ("rating >= 4 and bitrate < 320", "coalesce(rating, 0) >= 4 AND coalesce(bitrate_kbps, 0) < 320"),
    "rule_string_in": ("'Folk' in genre or artist == 'Various Artists'", "contains(coalesce(genre, ''), 'Folk') OR coalesce(artist, '') = 'Various Artists'"),
    "rule_chained": ("60 < duration <= 240 and not genre == ''", "coalesce(duration_s, 0) > 60 AND coalesce(duration_s, 0) <= 240 AND coalesce(genre, '') <> ''"),
    "rule_arith_mod": ("(bitrate - 400) % 7 == 3 or bitrate * 2 + 1 == 641", "(coalesce(bitrate_kbps, 0) - 400) - 7 * floor((coalesce(bitrate_kbps, 0) - 400) / 7.0) = 3 OR coalesce(bitrate_kbps, 0) * 2 + 1 = 641"),
    "rule_error_poison": ("1000 / rating > 100 or bitrate > 0", "coalesce(rating, 0) <> 0 AND (1000 / coalesce(rating, 0) > 100 OR coalesce(bitrate_kbps, 0) > 0)"),
    "rule_null_defaults": ("rating < 3 AND genre == \"\"", "coalesce(rating, 0) < 3 AND coalesce(genre, '') = ''"),
    "rule_mixed_types": ("genre != 5 and (title == artist or rating == True)", "coalesce(title, '') = coalesce(artist, '') OR coalesce(rating, 0) = 1"),
    "rule_truth": ("title * 2 and not bitrate - 320", "coalesce(title, '') <> '' AND coalesce(bitrate_kbps, 0) = 320"),
}


def _rule_query(rule: str):
    return lambda spark, d: current(spark, d).where(compile_rule(rule)).select("track_id")


for _name, (_rule, _where) in _RULES.items():
    query(_name, T + f" SELECT track_id FROM t WHERE {_where}")(_rule_query(_rule))


@query("where_album_granular", T + " SELECT track_id FROM t WHERE (root, dir) IN (SELECT (root, dir) FROM t WHERE coalesce(rating, 0) >= 4)")
def where_album_granular(spark, d):
    return audits.whole_albums(current(spark, d), compile_rule("rating >= 4")).select("track_id")


# --- folders ----------------------------------------------------------------------------------------------------------


@query("dominant_album_dirs", T + ALBUM_SQL + " SELECT root, dir, artist, album, genre, n_tracks, mean_rating FROM albums")
def dominant_album_dirs(spark, d):
    return dominant.album_folders(current(spark, d))


@query("dominant_folder_info", T + ALBUM_SQL + """
, kinds AS (SELECT root, dir, ext, count(*) AS n, sum(size) AS b, floor(avg(CASE WHEN bitrate_kbps <> 0 THEN bitrate_kbps END)) AS k FROM t GROUP BY ALL)
SELECT root, dir, CAST(sum(b) AS BIGINT) AS total_bytes, string_agg(ext || '=' || n, ' ' ORDER BY ext) AS formats, string_agg(CASE WHEN k IS NOT NULL THEN ext || '=' || CAST(k AS BIGINT) END, ' ' ORDER BY ext) AS kbps FROM kinds GROUP BY root, dir""")
def dominant_folder_info(spark, d):
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    info = dominant.folder_info(current(spark, d))
    return info.select("root", "dir", "total_bytes", text("formats").alias("formats"), F.when(F.size("fmt_bitrate") > 0, text("fmt_bitrate")).alias("kbps"))


@query("ai_library", T + ALBUM_SQL + " SELECT concat_ws(' | ', artist, album, coalesce(genre, ''), coalesce(CAST(round(mean_rating, 1) AS VARCHAR), ''), CAST(n_tracks AS VARCHAR)) AS line FROM albums")
def ai_library(spark, d):
    albums = dominant.album_folders(current(spark, d))
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    line = F.concat_ws(" | ", "artist", "album", blank(F.col("genre")), blank(F.round("mean_rating", 1)), F.col("n_tracks").cast("string"))
    return albums.orderBy(F.lower("artist"), F.lower("album"), "root", "dir").select(line.alias("line"))


@query("genre_wings", T + ALBUM_SQL + r"""
SELECT wing, replace(trim(regexp_replace(wing, '[^\p{L}\p{N}\p{M}_\s\p{Z}-]', '_', 'g')), ' ', '_') AS stem, count(*) AS n_albums, CAST(sum(n_tracks) AS BIGINT) AS n_tracks FROM (
  SELECT trim(unnest(string_split(coalesce(genre, 'Uncategorized'), '/'))) AS wing, n_tracks FROM albums) WHERE wing <> '' GROUP BY wing""")
def genre_wings(spark, d):
    albums = dominant.album_folders(current(spark, d))
    wings = albums.select(F.explode(F.split(F.coalesce("genre", F.lit("Uncategorized")), "/")).alias("w"), "n_tracks").select(trim_all(F.col("w")).alias("wing"), "n_tracks").where("wing <> ''")
    return wings.groupBy("wing").agg(F.count("*").alias("n_albums"), F.sum("n_tracks").alias("n_tracks")).select("wing", normalize.wing_name(F.col("wing")).alias("stem"), "n_albums", "n_tracks")


@query("library_tree", T + " SELECT root, dir, filename, CASE WHEN row_number() OVER (PARTITION BY root, dir ORDER BY filename DESC) = 1 THEN '└── ' ELSE '├── ' END || filename AS line FROM t")
def library_tree(spark, d):
    return current(spark, d).select("root", "dir", "filename", F.concat(F.when(audits.last_of_folder(), "└── ").otherwise("├── "), F.col("filename")).alias("line"))


@query("nested_dirs", """
WITH dirs AS (SELECT DISTINCT root, path FROM album_dirs), parts AS (SELECT root, path, string_split(path, '/') AS p FROM dirs), above AS (SELECT root, path AS child, unnest([list_aggregate(p[1:i], 'string_agg', '/') FOR i IN range(1, len(p))]) AS parent FROM parts)
SELECT a.root, a.parent, a.child FROM above a JOIN dirs d ON d.root = a.root AND d.path = a.parent""")
def nested_dirs(spark, d):
    # absolute paths: the leading slash makes an empty first component, which paths below a root don't have
    dirs = table(spark, d, "album_dirs").select("root", F.substring("path", 2, 1 << 30).alias("dir"))
    slash = lambda c: F.concat(F.lit("/"), F.col(c)).alias(c)
    return audits.nested_folders(dirs).select("root", slash("parent"), slash("child"))


# --- audits -----------------------------------------------------------------------------------------------------------


@query("audit_tags", T + """
SELECT track_id, array_to_string([x FOR x IN [CASE WHEN coalesce(title, '') = '' THEN 'title' END, CASE WHEN coalesce(artist, '') = '' THEN 'artist' END, CASE WHEN trackno IS NULL THEN 'tracknumber' END, CASE WHEN coalesce(genre, '') = '' THEN 'genre' END] IF x IS NOT NULL], ', ') AS missing
FROM t WHERE """ + MISSING + " > 0")
def audit_tags(spark, d):
    return audits.incomplete_tags(current(spark, d), ["track_id"])


@query("audit_tags_breakdown", T + """
SELECT field, count(*) AS n_tracks FROM (SELECT unnest([CASE WHEN coalesce(title, '') = '' THEN 'title' END, CASE WHEN coalesce(artist, '') = '' THEN 'artist' END, CASE WHEN trackno IS NULL THEN 'tracknumber' END, CASE WHEN coalesce(genre, '') = '' THEN 'genre' END]) AS field FROM t) WHERE field IS NOT NULL GROUP BY field""")
def audit_tags_breakdown(spark, d):
    return audits.missing_breakdown(current(spark, d))


@query("audit_bitrate", T + " SELECT track_id, bitrate_kbps FROM t WHERE bitrate_kbps BETWEEN 1 AND 191")
def audit_bitrate(spark, d):
    return current(spark, d).where(audits.below_bitrate()).select("track_id", "bitrate_kbps")


_GAIN = "SELECT root, dir, count(*) FILTER (WHERE has_track_gain) AS n_track_gain, count(*) FILTER (WHERE has_album_gain) AS n_album_gain, count(*) AS n_tracks FROM t GROUP BY root, dir"
_BUCKET = "CASE WHEN n_track_gain = 0 THEN 'MISSING' WHEN n_track_gain < n_tracks THEN 'PARTIAL' WHEN n_album_gain < n_tracks THEN 'NO_ALBUM_GAIN' ELSE 'OK' END"


@query("audit_replaygain_buckets", T + f" SELECT *, {_BUCKET} AS bucket FROM ({_GAIN})")
def audit_replaygain_buckets(spark, d):
    return audits.gain_coverage(current(spark, d))


@query("audit_albums_numbers", T + """
, f AS (SELECT root, dir, list_sort(list(DISTINCT trackno) FILTER (WHERE trackno IS NOT NULL)) AS nos, count(*) FILTER (WHERE trackno IS NULL) AS n_untagged, count(*) AS n_tracks FROM t GROUP BY root, dir
), twice AS (SELECT root, dir, string_agg(CAST(trackno AS VARCHAR), ', ' ORDER BY trackno) AS dupes FROM (SELECT root, dir, trackno FROM t WHERE trackno IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY root, dir
), absent AS (SELECT root, dir, x, x - row_number() OVER (PARTITION BY root, dir ORDER BY x) AS run FROM (SELECT root, dir, nos, unnest(range(1, coalesce(nos[-1], 0) + 1)) AS x FROM f) WHERE NOT list_contains(nos, CAST(x AS INTEGER))
), missing AS (SELECT root, dir, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS gap FROM (SELECT root, dir, min(x) AS a, max(x) AS b FROM absent GROUP BY root, dir, run) GROUP BY root, dir
), g AS (SELECT f.*, coalesce(dupes, '') AS dupes, coalesce(gap, '') AS gaps FROM f LEFT JOIN twice USING (root, dir) LEFT JOIN missing USING (root, dir))
SELECT root, dir, gaps, dupes, n_untagged, n_tracks FROM g WHERE gaps <> '' OR dupes <> '' OR n_untagged > 0""")
def audit_albums_numbers(spark, d):
    return audits.track_numbers(current(spark, d))


@query("audit_albums_years", T + """
, f AS (SELECT root, dir, list_sort(list(DISTINCT year) FILTER (WHERE year IS NOT NULL)) AS ys, count(year) AS n_with_year, count(*) AS n_tracks FROM t GROUP BY root, dir
), g AS (SELECT *, CASE WHEN coalesce(len(ys), 0) = 0 THEN 'none' WHEN len(ys) > 1 THEN 'divergent' WHEN n_with_year < n_tracks THEN 'partial' END AS finding FROM f)
SELECT root, dir, finding, coalesce(array_to_string(ys, ', '), '') AS years, n_with_year, n_tracks FROM g WHERE finding IS NOT NULL""")
def audit_albums_years(spark, d):
    return audits.year_findings(current(spark, d))


@query("audit_albums_codecs", T + " SELECT root, dir, string_agg(ext, ' + ' ORDER BY ext) AS codecs FROM (SELECT DISTINCT root, dir, ext FROM t) GROUP BY root, dir HAVING count(*) > 1")
def audit_albums_codecs(spark, d):
    return audits.mixed_codecs(current(spark, d))


_STRAY = "CASE WHEN dir LIKE '.%' OR dir LIKE '%/.%' OR filename LIKE '.%' THEN 'hidden' WHEN len([p FOR p IN string_split(dir, '/') IF p <> '']) = 1 THEN 'loose' WHEN len([p FOR p IN string_split(dir, '/') IF p <> '']) >= 2 THEN 'placed' ELSE 'wrong-depth' END"


@query("audit_strays", T + f" SELECT {_STRAY} AS bucket, count(*) AS n_files FROM t GROUP BY 1")
def audit_strays(spark, d):
    return audits.strays(current(spark, d))


@query("verify_replaygain", """
SELECT r.reading_id, CASE WHEN g.gain IS NULL THEN 'UNGAUGED' WHEN abs(g.gain - ((CASE WHEN g.reading_id % 4 = 0 THEN -23.0 ELSE -18.0 END) - (-10.0 - r.reading_id % 12))) <= 0.5 THEN 'OK' ELSE 'OFF' END AS verdict
FROM rating_tags r LEFT JOIN (SELECT reading_id, try_cast(rating AS DOUBLE) - 10 AS gain FROM rating_tags) g ON g.reading_id = r.reading_id""")
def verify_replaygain(spark, d):
    # readings stand for scans: the number they hold, less ten, for a stored gain; their id for a measured loudness
    readings = table(spark, d, "rating_tags")
    plain = F.when(F.col("rating").rlike(r"^\s*[-+]?[0-9]+(?:\.[0-9]*)?\s*$"), F.col("rating")).try_cast("double")
    stored = readings.select("reading_id", (plain - 10).alias("gain_db"), F.when(F.col("reading_id") % 4 == 0, "r128").otherwise("rg").alias("convention"))
    measured = readings.select("reading_id", (-10.0 - F.col("reading_id") % 12).alias("loudness"))
    return matching.verify_gain(stored, measured, ["reading_id"]).select("reading_id", "verdict")


_TIER = """CASE WHEN code <> 0 THEN 'CORRUPT' WHEN lines = 0 THEN 'OK' WHEN harmless THEN 'METADATA' ELSE 'SUSPECT' END"""


@query("integrity_tiers", f"""
SELECT {_TIER} AS tier, count(*) AS n_files FROM (
  SELECT CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS code, len(l) AS lines, len([x FOR x IN l IF NOT (contains(x, 'Header missing') OR contains(x, '[png'))]) = 0 AS harmless FROM (
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ['Header missing'] WHEN doc_id % 5 = 1 THEN ['[png @ 1] odd', 'unknown line'] ELSE [] END AS l FROM documents)) GROUP BY 1""")
def integrity_tiers(spark, d):
    # documents stand for files: what a decoder said follows from the id
    files = table(spark, d, "documents").select("doc_id")
    said = F.when(F.col("doc_id") % 5 == 0, " Header missing\n\n").when(F.col("doc_id") % 5 == 1, "[png @ 1] odd\r\nunknown line").otherwise("")
    tier = decode.decode_tier(F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0), said, F.lit(None).cast("bigint"))
    return files.select(tier.alias("tier")).groupBy("tier").agg(F.count("*").alias("n_files"))


@query("resume_remaining", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT track_id FROM rating_tags WHERE track_id IS NOT NULL)")
def resume_remaining(spark, d):
    return matching.remaining(table(spark, d, "documents").select("doc_id"), table(spark, d, "rating_tags").select(F.col("track_id").alias("doc_id")), "doc_id")


# --- duplicates -------------------------------------------------------------------------------------------------------

_EXACT = f"SELECT norm_artist, norm_album, count(*) AS n_dirs, min(place) AS first_place, max(place) AS last_place FROM (SELECT {sql_name_key('artist')} AS norm_artist, {sql_name_key('album')} AS norm_album, path AS place FROM album_dirs) WHERE norm_artist <> '' AND norm_album <> '' GROUP BY 1, 2 HAVING count(*) > 1"


@query("dupes_exact", _EXACT)
def dupes_exact(spark, d):
    return duplicates.exact_albums(table(spark, d, "album_dirs"), place=["path"])


@query("dupes_multiformat", T + f"""
, k AS (SELECT DISTINCT root, dir, trackno, {sql_name_key("coalesce(nullif(title, ''), regexp_replace(filename, '([^.])\\.[^.]*$', '\\1'))")} AS title_key, ext FROM t)
SELECT root, dir, trackno, title_key, count(*) AS n_formats, string_agg(ext, ' ' ORDER BY ext) AS formats FROM k GROUP BY root, dir, trackno, title_key HAVING count(*) > 1""")
def dupes_multiformat(spark, d):
    return duplicates.several_formats(current(spark, d))


@query("dupes_track_clusters", "WITH RECURSIVE " + T[5:] + f"""
, k AS (SELECT {sql_name_key('artist')} AS norm_artist, {sql_name_key('title')} AS norm_title, duration_s AS v, root || chr(9) || dir AS place FROM t WHERE coalesce(artist, '') <> '' AND coalesce(title, '') <> ''
), held AS (SELECT * FROM k WHERE norm_artist <> '' AND norm_title <> '' AND (norm_artist, norm_title) IN (SELECT (norm_artist, norm_title) FROM k GROUP BY norm_artist, norm_title HAVING count(DISTINCT place) > 1)
), o AS (SELECT *, row_number() OVER (PARTITION BY norm_artist, norm_title ORDER BY v) AS rn FROM (SELECT DISTINCT norm_artist, norm_title, v FROM held WHERE v IS NOT NULL)
), r AS (SELECT norm_artist, norm_title, v, rn, v AS anchor FROM o WHERE rn = 1
  UNION ALL SELECT o.norm_artist, o.norm_title, o.v, o.rn, CASE WHEN o.v - r.anchor <= 2.0 THEN r.anchor ELSE o.v END FROM r JOIN o ON o.norm_artist = r.norm_artist AND o.norm_title = r.norm_title AND o.rn = r.rn + 1)
SELECT h.norm_artist, h.norm_title, r.anchor, count(*) AS n_copies, count(DISTINCT h.place) AS n_dirs FROM held h LEFT JOIN r ON r.norm_artist = h.norm_artist AND r.norm_title = h.norm_title AND r.v = h.v
GROUP BY h.norm_artist, h.norm_title, r.anchor HAVING count(DISTINCT h.place) > 1""")
def dupes_track_clusters(spark, d):
    return duplicates.track_clusters(current(spark, d))


@query("dupes_similar")
def dupes_similar(spark, d):
    return duplicates.similar_albums(table(spark, d, "album_dirs"))


@query("dupes_content_hash", "SELECT sha256(text) AS digest, count(*) AS n_files, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dupes_content_hash(spark, d):
    return duplicates.content_duplicates(table(spark, d, "documents"), "text", "doc_id")


@query("dupes_content_tiers", """
WITH p AS (SELECT sha256(text) AS full_, CASE WHEN length(text) % 3 > 0 THEN sha256(substr(text, 1, 40)) END AS stream, sha256(substr(text, 1, 20)) || ':' || sha256(substr(text, 1, 30)) AS sampled FROM documents WHERE text IS NOT NULL
), c AS (SELECT *, count(*) OVER (PARTITION BY full_) AS same FROM p)
SELECT 'exact' AS tier, full_ AS key, count(*) AS n_files FROM c WHERE same > 1 GROUP BY full_
UNION ALL SELECT 'stream', stream, count(*) FROM c WHERE same = 1 AND stream IS NOT NULL GROUP BY stream HAVING count(*) > 1
UNION ALL SELECT 'sampled', sampled, count(*) FROM c WHERE same = 1 AND stream IS NULL GROUP BY sampled HAVING count(*) > 1""")
def dupes_content_tiers(spark, d):
    # documents stand for files: their beginnings for the sound, the head and the tail
    text = F.col("text")
    prints = table(spark, d, "documents").where(text.isNotNull()).select(
        F.lit(None).cast("string").alias("error"), F.sha2(text, 256).alias("full"), F.when(F.length(text) % 3 > 0, F.sha2(F.substring(text, 1, 40), 256)).alias("stream"),
        F.sha2(F.substring(text, 1, 20), 256).alias("head"), F.sha2(F.substring(text, 1, 30), 256).alias("tail"),
    )
    return duplicates.content_tiers(prints)


#: Characters at either end of a text that stand for the sampled ends of a file.
_EDGE = 256


@query("dupes_content_tiers_whole", f"""
WITH p AS (SELECT sha256(text) AS full_, CASE WHEN strpos(text, chr(10)) BETWEEN 1 AND length(text) - 1 THEN sha256(substr(text, strpos(text, chr(10)) + 1)) END AS stream, sha256(left(text, {_EDGE})) || ':' || sha256(right(text, {_EDGE})) AS sampled FROM documents WHERE text IS NOT NULL
), c AS (SELECT *, count(*) OVER (PARTITION BY full_) AS same FROM p)
SELECT 'exact' AS tier, full_ AS key, count(*) AS n_files FROM c WHERE same > 1 GROUP BY full_
UNION ALL SELECT 'stream', stream, count(*) FROM c WHERE same = 1 AND stream IS NOT NULL GROUP BY stream HAVING count(*) > 1
UNION ALL SELECT 'sampled', sampled, count(*) FROM c WHERE same = 1 AND stream IS NULL GROUP BY sampled HAVING count(*) > 1""")
def dupes_content_tiers_whole(spark, d):
    # documents stand for files: all after the first line for the sound, both ends of a text without one for the samples
    text = F.col("text")
    body = F.expr("substring(text, instr(text, '\n') + 1)")
    prints = table(spark, d, "documents").where(text.isNotNull()).select(
        F.lit(None).cast("string").alias("error"), F.sha2(text, 256).alias("full"), F.when((F.instr(text, "\n") > 0) & (body != ""), F.sha2(body, 256)).alias("stream"),
        F.sha2(F.left(text, F.lit(_EDGE)), 256).alias("head"), F.sha2(F.right(text, F.lit(_EDGE)), 256).alias("tail"),
    )
    return duplicates.content_tiers(prints)


# --- health -----------------------------------------------------------------------------------------------------------


def _art(tracks: DataFrame) -> DataFrame:
    """Art of folders, as follows from their names: the tables hold no pictures."""
    n = F.length("dir")
    dirs = tracks.select("root", "dir").distinct()
    return dirs.select("root", "dir", (n % 3 > 0).alias("has_cover"), (n * 20).alias("cover_width"), (n * 21).alias("cover_height"), (n % 2 == 0).alias("has_embedded"))


_HEALTH = T + f"""
, f AS (SELECT root, dir, count(*) AS n_files, sum({MISSING}) AS n_missing, count(*) FILTER (WHERE has_track_gain) AS n_gain, count(*) FILTER (WHERE bitrate_kbps BETWEEN 1 AND 191) AS n_low FROM t GROUP BY root, dir
), c AS (SELECT root, dir, n_files, CAST(least(n_missing * 4, 40) AS BIGINT) AS tags_cost, CAST(round_even(30.0 * (n_files - n_gain) / n_files, 0) AS BIGINT) AS gain_cost,
  CAST(CASE WHEN length(dir) % 3 > 0 AND length(dir) * 20 < 500 THEN 8 WHEN length(dir) % 3 > 0 THEN 0 WHEN length(dir) % 2 = 0 THEN 12 ELSE 20 END AS BIGINT) AS art_cost, CAST(least(n_low * 2, 10) AS BIGINT) AS bitrate_cost FROM f
), s AS (SELECT *, greatest(0, 100 - tags_cost - gain_cost - art_cost - bitrate_cost) AS score FROM c
), scored AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade FROM s)"""


@query("health_score", _HEALTH + " SELECT * FROM scored")
def health_score(spark, d):
    tracks = current(spark, d)
    return health.album_scores(tracks, _art(tracks))


@query("health_grades", _HEALTH + " SELECT count(*) AS n_albums, " + ", ".join(f"count(*) FILTER (WHERE grade = '{g}') AS n_{g.lower()}" for g in "ABCD") + ", count(*) FILTER (WHERE score < 100) AS n_flagged, round_even(avg(score), 1) AS mean FROM scored")
def health_grades(spark, d):
    return health.grades(health_score(spark, d))


@query("health_worst5", _HEALTH + " SELECT root, dir, score, n_files FROM scored ORDER BY score, root, dir LIMIT 5")
def health_worst5(spark, d):
    return health.worst(health_score(spark, d))


@query("health_digest", T + ALBUM_SQL + f"""
, g AS (SELECT *, {_BUCKET} AS bucket FROM ({_GAIN})), e AS (SELECT root, dir, count(DISTINCT ext) AS exts FROM t GROUP BY root, dir)
, own AS (SELECT a.v AS artist, b.v AS album FROM best a JOIN best b ON a.root = b.root AND a.dir = b.dir AND a.i = 0 AND b.i = 1)
, art AS (SELECT DISTINCT root, dir FROM t)
SELECT 'files' AS finding, count(*) AS n FROM t UNION ALL SELECT 'incomplete_tags', count(*) FROM t WHERE {MISSING} > 0 UNION ALL SELECT 'below_bitrate', count(*) FROM t WHERE bitrate_kbps BETWEEN 1 AND 191
UNION ALL SELECT 'stray_hidden', count(*) FROM t WHERE {_STRAY} = 'hidden' UNION ALL SELECT 'stray_loose', count(*) FROM t WHERE {_STRAY} = 'loose' UNION ALL SELECT 'stray_wrong_depth', count(*) FROM t WHERE {_STRAY} = 'wrong-depth'
UNION ALL SELECT 'albums', count(*) FROM g UNION ALL SELECT 'gain_missing', count(*) FROM g WHERE bucket = 'MISSING' UNION ALL SELECT 'gain_partial', count(*) FROM g WHERE bucket = 'PARTIAL' UNION ALL SELECT 'gain_no_album_gain', count(*) FROM g WHERE bucket = 'NO_ALBUM_GAIN'
UNION ALL SELECT 'no_art', count(*) FROM art WHERE length(dir) % 3 = 0 AND length(dir) % 2 = 1 UNION ALL SELECT 'several_formats', count(*) FROM e WHERE exts > 1
UNION ALL SELECT 'duplicate_albums', count(*) FROM (SELECT {sql_name_key('artist')} AS x, {sql_name_key('album')} AS y FROM own GROUP BY 1, 2 HAVING count(*) > 1)""")
def health_digest(spark, d):
    tracks = current(spark, d)
    return health.digest(tracks, _art(tracks))


# --- snapshots --------------------------------------------------------------------------------------------------------


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A baseline and a current state made of the tracks: some gone, some renamed, some resized, some retagged."""
    i, path = F.col("track_id"), F.concat_ws("/", "root", "dir", "filename")
    base = current(spark, d).select(
        "track_id", F.concat_ws("#", path, i.cast("string")).alias("path"), "size", "mtime", F.col("trackno").alias("track"), "rating", "genre", "year", F.concat(F.col("has_track_gain").cast("int"), F.col("has_album_gain").cast("int")).alias("rg")
    )
    old = base.where(i % 19 != 0)
    new = base.where(i % 17 != 0).select(
        F.when(i % 13 == 0, F.concat(F.lit("/moved"), F.col("path"))).otherwise(F.col("path")).alias("path"), F.when(i % 11 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        "mtime", "track", "rating", F.when(i % 7 == 0, F.lit("Other")).otherwise(F.col("genre")).alias("genre"), "year", "rg",
    )
    return old.drop("track_id"), new


_STATES = T + """
, base AS (SELECT track_id, concat_ws('/', root, dir, filename) || '#' || track_id AS path, size, mtime, trackno AS track, rating, genre, year, CAST(has_track_gain::INT AS VARCHAR) || CAST(has_album_gain::INT AS VARCHAR) AS rg FROM t
), o AS (SELECT * FROM base WHERE track_id % 19 <> 0
), n AS (SELECT CASE WHEN track_id % 13 = 0 THEN '/moved' || path ELSE path END AS path, CASE WHEN track_id % 11 = 0 THEN size + 1 ELSE size END AS size, mtime, track, rating, CASE WHEN track_id % 7 = 0 THEN 'Other' ELSE genre END AS genre, year, rg FROM base WHERE track_id % 17 <> 0
), gone AS (SELECT path, size, mtime, row_number() OVER (PARTITION BY size, mtime ORDER BY path) AS k FROM o WHERE path NOT IN (SELECT path FROM n)
), fresh AS (SELECT path, size, mtime, row_number() OVER (PARTITION BY size, mtime ORDER BY path) AS k FROM n WHERE path NOT IN (SELECT path FROM o)
), moved AS (SELECT g.path AS old_path, f.path AS new_path FROM gone g JOIN fresh f ON g.size = f.size AND g.mtime = f.mtime AND g.k = f.k)"""


@query("snapshot_moves", _STATES + " SELECT old_path, new_path FROM moved")
def snapshot_moves(spark, d):
    return snapshot.moves(*_states(spark, d))


@query("snapshot_diff", _STATES + """
SELECT 'MOVED' AS kind, old_path AS path FROM moved
UNION ALL SELECT 'REMOVED', path FROM gone WHERE path NOT IN (SELECT old_path FROM moved) UNION ALL SELECT 'ADDED', path FROM fresh WHERE path NOT IN (SELECT new_path FROM moved)
UNION ALL SELECT CASE WHEN o.genre IS DISTINCT FROM n.genre THEN 'RETAGGED' ELSE 'RESIZED' END, o.path FROM o JOIN n ON o.path = n.path WHERE o.genre IS DISTINCT FROM n.genre OR o.size <> n.size""")
def snapshot_diff(spark, d):
    return snapshot.diff(*_states(spark, d)).select("kind", "path")


@query("snapshot_diff_details", _STATES + """
SELECT 'MOVED' AS kind, old_path AS path, new_path AS detail FROM moved
UNION ALL SELECT 'REMOVED', path, '' FROM gone WHERE path NOT IN (SELECT old_path FROM moved) UNION ALL SELECT 'ADDED', path, '' FROM fresh WHERE path NOT IN (SELECT new_path FROM moved)
UNION ALL SELECT CASE WHEN o.genre IS DISTINCT FROM n.genre THEN 'RETAGGED' ELSE 'RESIZED' END, o.path,
  CASE WHEN o.genre IS DISTINCT FROM n.genre THEN 'genre ' || coalesce(o.genre, '(none)') || ' -> ' || coalesce(n.genre, '(none)') ELSE o.size || ' -> ' || n.size END
  FROM o JOIN n ON o.path = n.path WHERE o.genre IS DISTINCT FROM n.genre OR o.size <> n.size""")
def snapshot_diff_details(spark, d):
    return snapshot.diff(*_states(spark, d))


# --- authority --------------------------------------------------------------------------------------------------------


@query("genre_map_build", T + ALBUM_SQL + f"""
, k AS (SELECT {sql_name_key('artist')} AS artist_norm, artist AS display, genre, (root, dir) AS place FROM albums WHERE coalesce(artist, '') <> ''
), names AS (SELECT artist_norm, display FROM (SELECT artist_norm, display, count(*) AS n, min(place) AS f FROM k GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY artist_norm ORDER BY n DESC, f) = 1
), g AS (SELECT artist_norm, genre, count(*) AS n, min(place) AS f FROM k WHERE coalesce(genre, '') <> '' GROUP BY 1, 2
), l AS (SELECT artist_norm, string_agg(genre, chr(9) ORDER BY n DESC, f) AS genres, count(*) AS n_genres FROM g GROUP BY 1)
SELECT artist_norm, display, coalesce(genres, '') AS genres, coalesce(n_genres, 0) AS n_genres, artist_norm IN ('various artists', 'various', 'va') AS excluded FROM names LEFT JOIN l USING (artist_norm) WHERE artist_norm <> ''""")
def genre_map_build(spark, d):
    return authority.build_map(dominant.album_folders(current(spark, d)))


@query("genre_map_new_artists", f"SELECT {sql_name_key('artist')} AS artist_norm, count(*) AS n_albums FROM album_dirs WHERE coalesce(artist, '') <> '' AND {sql_name_key('artist')} NOT IN ('various artists', 'various', 'va', '') AND {sql_name_key('artist')} NOT IN (SELECT {sql_name_key('display')} FROM genre_map) GROUP BY 1")
def genre_map_new_artists(spark, d):
    return authority.new_artists(table(spark, d, "album_dirs"), table(spark, d, "genre_map"))


@query("genre_map_compliance", T + ALBUM_SQL + f"""
, m AS (SELECT {sql_name_key('display')} AS artist_norm, coalesce(canonical, '') AS canonical, allowed_norm FROM genre_map QUALIFY row_number() OVER (PARTITION BY {sql_name_key('display')} ORDER BY entry_id DESC) = 1
), j AS (SELECT a.root, a.dir, a.genre, {sql_name_key('a.artist')} AS key, m.* FROM albums a LEFT JOIN m ON {sql_name_key('a.artist')} = m.artist_norm)
, o AS (SELECT root, dir, canonical, CASE WHEN key IN ('various artists', 'various', 'va') THEN 'excluded' WHEN artist_norm IS NULL THEN 'unmapped' WHEN canonical = '' THEN 'skipped_blank' WHEN coalesce(genre, '') <> '' AND list_contains(allowed_norm, {sql_name_key('genre')}) THEN 'ok' ELSE 'retag' END AS outcome FROM j)
SELECT root, dir, outcome, CASE WHEN outcome = 'retag' THEN canonical END AS target FROM o""")
def genre_map_compliance(spark, d):
    return authority.compliance(dominant.album_folders(current(spark, d)), table(spark, d, "genre_map")).select("root", "dir", "outcome", "target")


# --- folder plans -----------------------------------------------------------------------------------------------------


#: Folders of one disc, as SQL finds them.
DISC_NAMES = r"(?i)^(?:" + "|".join(layout.DISC_WORDS) + r")[\s._-]*[0-9]+$"


def _albums_to_place(spark: SparkSession, d: str) -> DataFrame:
    """Album folders at several depths: of some, the genre folder is there already; some hold discs, some lie too deep."""
    albums = dominant.album_folders(current(spark, d)).where("genre is not null")
    n = F.length("dir") % 5
    first = F.element_at(F.split("genre", "[;/]"), 1)
    moved = F.when(n == 0, F.concat_ws("/", F.trim(first), "dir")).when(n == 1, F.concat_ws("/", "dir", F.lit("CD1"))).when(n == 2, F.concat_ws("/", F.lit("a/b/c"), "dir")).otherwise(F.col("dir"))
    return albums.select(moved.alias("dir"), "genre")


@query("folder_plan_classify", T + ALBUM_SQL + r"""
, p AS (SELECT CASE length(dir) % 5 WHEN 0 THEN trim(regexp_split_to_array(genre, '[;/]')[1], ' ') || '/' || dir WHEN 1 THEN dir || '/CD1' WHEN 2 THEN 'a/b/c/' || dir ELSE dir END AS dir FROM albums WHERE genre IS NOT NULL
), q AS (SELECT dir, [x FOR x IN string_split(dir, '/') IF x <> ''] AS w FROM p)
SELECT CASE WHEN len(w) = 0 THEN 'skip' WHEN len(w) = 1 THEN 'loose' WHEN len(w) = 2 OR (len(w) = 3 AND regexp_matches(w[3], 'DISC_NAMES')) THEN 'album'
  WHEN len(w) = 3 OR (len(w) = 4 AND regexp_matches(w[4], 'DISC_NAMES')) THEN 'organized' ELSE 'toodeep' END AS kind, count(*) AS n_dirs FROM q GROUP BY 1""".replace("DISC_NAMES", DISC_NAMES))
def folder_plan_classify(spark, d):
    return _albums_to_place(spark, d).select(layout.place(F.col("dir"))["kind"].alias("kind")).groupBy("kind").agg(F.count("*").alias("n_dirs"))


def _plan_sql(allow_new_genre: bool, refile: bool) -> str:
    gated = "false" if allow_new_genre else "EXISTS (SELECT 1 FROM vocabulary)"
    return T + ALBUM_SQL + rf"""
, p AS (SELECT CASE length(dir) % 5 WHEN 0 THEN trim(regexp_split_to_array(genre, '[;/]')[1], ' ') || '/' || dir WHEN 1 THEN dir || '/CD1' WHEN 2 THEN 'a/b/c/' || dir ELSE dir END AS path, genre FROM albums WHERE genre IS NOT NULL
), q AS (SELECT path, [x FOR x IN string_split(path, '/') IF x <> ''] AS w, [trim(x, ' ') FOR x IN regexp_split_to_array(genre, '[;/]') IF trim(x, ' ') <> ''] AS gs FROM p
), r AS (SELECT *, len(w) = 2 OR (len(w) = 3 AND regexp_matches(w[3], 'DISC_NAMES')) AS flat, coalesce(gs[1], '') AS tag, array_to_string(gs[2:], '; ') AS ignored FROM q
), s AS (SELECT *, NOT flat AND (len(w) = 3 OR (len(w) = 4 AND regexp_matches(w[4], 'DISC_NAMES'))) AS organized,
  regexp_replace(trim(regexp_replace(translate(tag, '<>:"/\|?*', '         '), '[\s\p{{Z}}]+', ' ', 'g')), '[. ]+$', '') AS legal FROM r
), u AS (SELECT path, ignored, tag, CASE WHEN legal = '' THEN 'Unknown' ELSE legal END AS safe, CASE WHEN len(w) = 0 THEN 'skip' WHEN len(w) = 1 THEN 'loose' WHEN flat THEN 'album' WHEN organized THEN 'organized' ELSE 'toodeep' END AS kind,
  CASE WHEN organized THEN w[1] END AS current, CASE WHEN organized THEN w[2] WHEN flat OR len(w) = 1 THEN w[1] END AS artist, CASE WHEN organized THEN w[3] WHEN flat THEN w[2] END AS album,
  CASE WHEN (flat AND len(w) = 3) OR (organized AND len(w) = 4) THEN array_to_string(w[:-2], '/') ELSE array_to_string(w, '/') END AS unit FROM s
), vocabulary AS (SELECT lower(current) AS folded, max(current) AS known FROM u WHERE kind = 'organized' GROUP BY 1
), v AS (SELECT *, CASE WHEN kind = 'skip' THEN 'SKIP' WHEN kind = 'toodeep' THEN 'TOO DEEP' WHEN tag = '' THEN 'NO GENRE' WHEN kind = 'organized' AND lower(safe) = lower(current) THEN 'IN PLACE'
  WHEN kind = 'organized' AND {"false" if refile else "true"} THEN 'NOTE' WHEN known IS NULL AND {gated} THEN 'UNKNOWN GENRE' END AS issue FROM u LEFT JOIN vocabulary ON lower(safe) = folded
), x AS (SELECT * REPLACE (CASE WHEN issue IS NULL AND regexp_matches(unit || concat_ws('/', coalesce(known, safe), artist, CASE WHEN kind = 'loose' THEN 'Singles' ELSE album END), '[\t\n]') THEN 'UNSAFE NAME' ELSE issue END AS issue),
  CASE WHEN issue IS NULL THEN concat_ws('/', coalesce(known, safe), artist, CASE WHEN kind = 'loose' THEN 'Singles' ELSE album END) END AS dst FROM v
), y AS (SELECT * REPLACE (CASE WHEN issue IS NULL AND row_number() OVER (PARTITION BY unit, issue IS NULL ORDER BY path, dst) > 1 THEN CASE WHEN dst = first_value(dst) OVER (PARTITION BY unit, issue IS NULL ORDER BY path, dst) THEN 'SAME UNIT' ELSE 'DISC GENRE MISMATCH' END ELSE issue END AS issue) FROM x
), z AS (SELECT * REPLACE (CASE WHEN issue IS NULL AND row_number() OVER (PARTITION BY dst, issue IS NULL ORDER BY path, ignored) > 1 THEN 'COLLISION' ELSE issue END AS issue) FROM y)
""".replace("DISC_NAMES", DISC_NAMES)


@query("folder_plan_moves", _plan_sql(False, False) + " SELECT unit AS src, dst, kind, issue, path, ignored FROM z")
def folder_plan_moves(spark, d):
    return places.plan_moves(_albums_to_place(spark, d))


@query("folder_plan_issues", _plan_sql(True, True) + " SELECT coalesce(issue, 'MOVE') AS issue, count(*) AS n_dirs FROM z GROUP BY 1")
def folder_plan_issues(spark, d):
    plan = places.plan_moves(_albums_to_place(spark, d), allow_new_genre=True, refile=True)
    return plan.groupBy(F.coalesce("issue", F.lit("MOVE")).alias("issue")).agg(F.count("*").alias("n_dirs"))


# --- playlists --------------------------------------------------------------------------------------------------------


@query("playlist_m3u", T + """
, h AS (SELECT concat_ws('/', root, dir, filename) AS path, '#EXTINF:' || coalesce(CAST(trunc(duration_s) AS BIGINT), -1) || ',' || coalesce(artist, nullif(split_part(dir, '/', 1), ''), '') || ' - ' || coalesce(title, regexp_replace(filename, '([^.])\\.[^.]*$', '\\1')) AS info FROM t WHERE coalesce(bitrate_kbps, 0) >= 320)
SELECT path, CAST(1 AS BIGINT) AS line_no, info AS line FROM h UNION ALL SELECT path, 2, path FROM h""".replace("\\\\", "\\"))
def playlist_m3u(spark, d):
    return playlists.m3u_lines(current(spark, d), "bitrate >= 320")


@query("playlist_missing_targets", T + """
SELECT root || '/lists/' || ext || '.m3u' AS playlist, true AS has_header, count(*) AS n_entries, count(*) FILTER (WHERE track_id % 9 = 0) AS n_missing FROM t GROUP BY root, ext""")
def playlist_missing_targets(spark, d):
    tracks = current(spark, d)
    path = F.concat(F.col("root"), F.lit("/"), F.col("dir"), F.lit("/"), F.col("filename"), F.lit("#"), F.col("track_id").cast("string"))
    entry = F.when(F.col("track_id") % 2 == 0, path).otherwise(F.regexp_replace(path, r"^(.*)$", "$1"))
    texts = tracks.groupBy("root", "ext").agg(F.array_join(F.collect_list(entry), "\n").alias("t")).select(F.concat(F.col("root"), F.lit("/lists/"), F.col("ext"), F.lit(".m3u")).alias("path"), F.concat(F.lit("#EXTM3U\n# made here\n"), F.col("t"), F.lit("\n")).alias("text"))
    return playlists.check_playlists(texts, tracks.where("track_id % 9 <> 0").select(path.alias("path")))


# --- cleaning and matching --------------------------------------------------------------------------------------------


@query("clean_groups_canonical", r"""
WITH n AS (SELECT root, artist AS name, count(*) AS n FROM album_dirs WHERE artist IS NOT NULL GROUP BY 1, 2
), k AS (SELECT root AS parent, name, n, lower(trim(regexp_replace(replace(replace(translate(name, '‘’ʼ“”‐‑‒–—―', '''''''""------'), '''', ''), '"', ''), '[\s\p{Z}]+', ' ', 'g'))) AS key FROM n
), c AS (SELECT *, first_value(name) OVER (PARTITION BY parent, key ORDER BY n DESC, name) AS canonical, count(*) OVER (PARTITION BY parent, key) AS k FROM k)
SELECT parent, key, canonical, name AS source, n AS n_files FROM c WHERE k > 1 AND name <> canonical""")
def clean_groups_canonical(spark, d):
    folders = table(spark, d, "album_dirs").where("artist is not null").groupBy("root", "artist").agg(F.count("*").alias("n"))
    return matching.same_name_folders(folders, "root", "artist", "n")


_PLAIN_SIGNS = normalize.TAG_SIGNS[1].replace("'", "''")
_SIGNS = "||".join(f"chr({ord(c)})" for c in normalize.TAG_SIGNS[0])


@query("tag_normalize_text", T + rf" SELECT track_id, trim(regexp_replace(translate(title, {_SIGNS}, '{_PLAIN_SIGNS}'), '[\s\p{{Z}}]+', ' ', 'g')) AS clean FROM t WHERE title IS NOT NULL")
def tag_normalize_text(spark, d):
    return current(spark, d).where("title is not null").select("track_id", normalize.tag_text(F.col("title")).alias("clean"))


@query("tag_dedupe_genres", T + sql_deduplicated_tag("t", "track_id", "genre"))
def tag_dedupe_genres(spark, d):
    return current(spark, d).where("genre is not null").select("track_id", normalize.deduplicated_tag(F.col("genre")).alias("deduplicated"))


@query("tag_restamp_artists", T + rf"""
, spelled AS (SELECT {sql_name_key("display", "'" + '"')} AS key, min(display) AS spelling FROM genre_map GROUP BY 1
), tagged AS (SELECT track_id, artist, {sql_tag_text("artist")} AS tt FROM t WHERE artist IS NOT NULL
), based AS (SELECT *, trim(regexp_replace(tt, '{SQL_FEATURING}(?s:.*)$', '\1')) AS base, regexp_matches(tt, '{SQL_FEATURING}') AS credits, trim(regexp_extract(tt, '{SQL_FEATURING}(.*)$', 2)) AS guest FROM tagged
), clean AS (SELECT *, CASE WHEN ends_with(guest, ')') AND length(guest) - length(replace(guest, ')', '')) > length(guest) - length(replace(guest, '(', '')) THEN rtrim(guest[:-2]) ELSE guest END AS g, {sql_name_key("base", "'" + '"')} AS key FROM based)
SELECT track_id, artist, CASE WHEN spelling IS NULL THEN artist WHEN credits THEN spelling || ' feat. ' || g ELSE spelling END AS planned_artist FROM clean LEFT JOIN spelled USING (key)""")
def tag_restamp_artists(spark, d):
    spelled = table(spark, d, "genre_map").groupBy(normalize.folder_key(F.col("display")).alias("key")).agg(F.min("display").alias("spelling"))
    return matching.restamped_artists(current(spark, d).where("artist is not null").select("track_id", "artist"), "artist", spelled)


@query("norm_keys", f"SELECT dir_id, {sql_name_key('album')} AS name_key, {sql_loose_key('album')} AS loose_key FROM album_dirs")
def norm_keys(spark, d):
    return table(spark, d, "album_dirs").select("dir_id", normalize.name_key(F.col("album")).alias("name_key"), normalize.loose_key(F.col("album")).alias("loose_key"))


@query("safe_names", r"""
SELECT dir_id, CASE WHEN s = '' THEN 'Unknown' ELSE s END AS component, album <> '' AND NOT regexp_matches(album, '[<>:"/\\|?*]') AND NOT regexp_matches(album, '[. ]$') AS legal FROM (
  SELECT dir_id, album, regexp_replace(trim(regexp_replace(translate(album, '<>:"/\|?*', '         '), '[\s\p{Z}]+', ' ', 'g')), '[. ]+$', '') AS s FROM album_dirs WHERE album IS NOT NULL)""")
def safe_names(spark, d):
    album = F.col("album")
    return table(spark, d, "album_dirs").where(album.isNotNull()).select("dir_id", normalize.path_component(album).alias("component"), normalize.legal_name(album).alias("legal"))


@query("parse_layout", T + " SELECT track_id, nullif(split_part(dir, '/', 1), '') AS artist_slot, nullif(split_part(dir, '/', 2), '') AS album_slot FROM t")
def parse_layout(spark, d):
    directory = F.col("dir")
    return current(spark, d).select("track_id", layout.slot(directory, "artist").alias("artist_slot"), layout.slot(directory, "album").alias("album_slot"))


_NUM = "try_cast(CASE WHEN regexp_matches(rating, '^\\s*[-+]?[0-9]*\\.?[0-9]+\\s*$') THEN trim(rating) END AS DOUBLE)"


@query("rating_normalize", f"""
SELECT reading_id, round(CASE WHEN v <= 5 THEN v WHEN v <= 10 THEN v / 2 WHEN v <= 100 THEN v / 20 WHEN v <= 255 THEN v * 5 / 255 END, 9) AS stars,
  coalesce(regexp_matches(replace(rating, '.', ''), '^[0-9]+$'), false) AS numeric_looking FROM (SELECT *, {_NUM} AS v FROM rating_tags)""")
def rating_normalize(spark, d):
    plain = F.when(F.col("rating").rlike(r"^\s*[-+]?[0-9]*\.?[0-9]+\s*$"), F.trim("rating"))
    return table(spark, d, "rating_tags").select("reading_id", F.round(decode.stars_of_number(plain), 9).alias("stars"), decode.looks_numeric(F.col("rating")).alias("numeric_looking"))


@query("rating_best", """
WITH c AS (SELECT track_id, lower(tag_key) AS k, rating AS v FROM rating_tags WHERE rating IS NOT NULL
), r AS (SELECT *, CASE WHEN k IN ('rating', 'fmps_rating', 'score', 'stars', 'rate') THEN 0 WHEN k LIKE '%album%' THEN 2 ELSE 1 END AS tier, CASE k WHEN 'rating' THEN '00' WHEN 'fmps_rating' THEN '01' WHEN 'score' THEN '02' WHEN 'stars' THEN '03' WHEN 'rate' THEN '04' ELSE k END AS name FROM c
), b AS (SELECT track_id, k, try_cast(v AS DOUBLE) AS v FROM r WHERE regexp_matches(replace(v, '.', ''), '^[0-9]+$') QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY tier, name, k, r.v) = 1
), s AS (SELECT track_id, CASE WHEN k LIKE '%fmps_%' AND v BETWEEN 0 AND 1 THEN v * 5 WHEN v <= 5 THEN v WHEN v <= 10 THEN v / 2 WHEN v <= 100 THEN v / 20 WHEN v <= 255 THEN v * 5 / 255 END AS stars FROM b)
SELECT t.track_id, round(s.stars, 9) AS stars FROM (SELECT DISTINCT track_id FROM c) t LEFT JOIN s USING (track_id)""")
def rating_best(spark, d):
    rows = table(spark, d, "rating_tags").where("rating is not null")
    return rows.groupBy("track_id").agg(F.collect_list(F.struct(F.col("tag_key").alias("key"), F.col("rating").alias("value"))).alias("c")).select("track_id", F.round(decode.best_rating(F.col("c")), 9).alias("stars"))


@query("rating_keys", """
SELECT tag_key, regexp_matches(lower(tag_key), 'rating|score|stars') AS vorbis, lower(tag_key) LIKE '%rating%' OR lower(tag_key) IN ('rate', 'score', 'stars') AS id3, regexp_matches(lower(tag_key), 'rate|rating') AS mp4, lower(tag_key) LIKE '%rating%' AS asf FROM (SELECT DISTINCT tag_key FROM rating_tags WHERE tag_key IS NOT NULL)""")
def rating_keys(spark, d):
    key = F.col("tag_key")
    return table(spark, d, "rating_tags").select("tag_key").where(key.isNotNull()).distinct().select("tag_key", *(decode.is_rating_key(key, c).alias(c) for c in ("vorbis", "id3", "mp4", "asf")))


@query("track_year_parse", """
SELECT track_id, CASE WHEN n > 0 THEN n END AS number, CASE WHEN y BETWEEN 1200 AND 2100 THEN y END AS parsed_year FROM (
  SELECT track_id, try_cast(split_part(coalesce(CAST(trackno AS VARCHAR), 'x') || '/12', '/', 1) AS INTEGER) AS n, year AS y FROM tracks QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY loaded_at DESC) = 1)""")
def track_year_parse(spark, d):
    number = F.concat(F.coalesce(F.col("trackno").cast("string"), F.lit("x")), F.lit("/12"))
    date = F.concat(F.col("year").cast("string"), F.lit("-03-01T12:00:00"))
    return current(spark, d).select("track_id", decode.track_number(number).alias("number"), decode.year_of(date).alias("parsed_year"))


@query("render_values", T + """
SELECT track_id, CASE WHEN coalesce(duration_s, 0) = 0 THEN '--:--' ELSE (CAST(trunc(duration_s) AS BIGINT) // 60) || ':' || lpad(CAST(CAST(trunc(duration_s) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS length FROM t""")
def render_values(spark, d):
    return current(spark, d).select("track_id", render.duration_text(F.col("duration_s")).alias("length"))


@query("song_titles", T + r"""
, s AS (SELECT track_id, size, trim(regexp_replace(regexp_replace(filename, '([^.])\.[^.]*$', '\1'), '^[^\-0-9]*-\s*', '')) AS stem FROM t
), p AS (SELECT *, regexp_extract(stem, '^(?:[0-9]+\s*[-–—]\s*)?([0-9]+)\.?\s*[-–—]?\s*(.+)$', ['n', 'x']) AS a, regexp_extract(stem, '^[Tt]rack\s*([0-9]+)\.?\s*[-–—]?\s*(.+)$', ['n', 'x']) AS b FROM s
), q AS (SELECT *, CASE WHEN a.n <> '' THEN a.n ELSE b.n END AS n, CASE WHEN a.n <> '' THEN a.x ELSE b.x END AS x FROM p)
SELECT track_id, CASE WHEN n <> '' THEN (CASE WHEN length(n) < 2 THEN '0' ELSE '' END) || n || '. ' || trim(x) ELSE stem END AS song FROM q""")
def song_titles(spark, d):
    return current(spark, d).select("track_id", render.song_title(F.col("filename")).alias("song"))


@query("nearest_duration_match", T + """
, w AS (SELECT DISTINCT track_id AS id, trackno AS no, ext, CASE WHEN duration_s > 0 THEN duration_s END AS want FROM t WHERE year = 1999
), o AS (SELECT DISTINCT track_id AS offer_id, trackno AS no, ext, CASE WHEN duration_s > 0 THEN duration_s END AS have FROM t WHERE year = 2001
), near AS (SELECT id, offer_id FROM w JOIN o USING (no, ext) WHERE abs(want - have) <= 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(abs(want - have), 6), offer_id) = 1
), f AS (SELECT id, min(offer_id) AS first_id FROM w LEFT JOIN o USING (no, ext) GROUP BY id)
SELECT f.id, coalesce(near.offer_id, first_id) AS offer_id, CASE WHEN near.offer_id IS NOT NULL THEN 'near' WHEN first_id IS NOT NULL THEN 'first' ELSE 'none' END AS how FROM f LEFT JOIN near USING (id)""")
def nearest_duration_match(spark, d):
    rows = current(spark, d).select("track_id", F.col("trackno").alias("no"), "ext", F.col("duration_s").alias("duration"), "year")
    return matching.nearest_duration(rows.where("year = 1999").withColumnRenamed("track_id", "id"), rows.where("year = 2001").withColumnRenamed("track_id", "offer_id"), ["no", "ext"])


def _song(c: str):
    """The loose key of a name, or its plain key where nothing else is left; null for an untagged one."""
    loose, plain = normalize.loose_key(F.col(c)), normalize.name_key(F.col(c))
    return F.when(loose != "", loose).when(plain != "", plain)


def _sql_song(c: str) -> str:
    return f"coalesce(nullif({sql_loose_key(c)}, ''), nullif({sql_name_key(c)}, ''))"


@query("nearest_duration_tracks", T + f"""
, o AS (SELECT track_id AS id, {_sql_song('artist')} AS a, {_sql_song('title')} AS b, lower(upper(coalesce(artist, ''))) AS x, lower(upper(coalesce(title, ''))) AS y, CASE WHEN duration_s > 0 THEN duration_s END AS s FROM t
), near AS (SELECT w.id, o.id AS offer_id FROM o w JOIN o USING (a, b) WHERE w.id <> o.id AND abs(w.s - o.s) <= 2 QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY round(abs(w.s - o.s), 6), o.id) = 1
), f AS (SELECT w.id, min(o.id) AS first_id, min(o.id) FILTER (WHERE o.x = w.x AND o.y = w.y) AS exact_id FROM o w LEFT JOIN o ON w.a = o.a AND w.b = o.b AND w.id <> o.id GROUP BY w.id)
SELECT f.id, coalesce(near.offer_id, exact_id, first_id) AS offer_id, CASE WHEN near.offer_id IS NOT NULL THEN 'near' WHEN exact_id IS NOT NULL THEN 'exact' WHEN first_id IS NOT NULL THEN 'first' ELSE 'none' END AS how FROM f LEFT JOIN near USING (id)""")
def nearest_duration_tracks(spark, d):
    # every track against all others of its artist and title; nearest_duration_match is held to two years by its SQL
    rows = current(spark, d).select(F.col("track_id").alias("id"), _song("artist").alias("artist_key"), _song("title").alias("title_key"), "artist", "title", F.col("duration_s").alias("duration"))
    return matching.nearest_duration(rows, rows.withColumnRenamed("id", "offer_id"), ["artist_key", "title_key"], itself=False, names=("artist", "title"))


@query("ancestor_authority", T + """
SELECT track_id, nullif(split_part(dir, '/', 1), '') AS authority FROM t""")
def ancestor_authority(spark, d):
    tracks = current(spark, d)
    artist = F.split("dir", "/")[0]
    marked = tracks.select(artist.alias("folder"), artist.alias("name")).where("folder <> ''").distinct()
    return matching.nearest_ancestor(tracks.select("track_id", "dir"), "dir", marked, "folder", "name").select("track_id", "authority")


@query("ape_actions", """
SELECT tag_key, CASE WHEN lower(trim(tag_key)) IN ('genre', 'rating', 'comment') THEN lower(trim(tag_key)) WHEN lower(trim(tag_key)) IN ('title', 'artist', 'album', 'year', 'track', 'disc') THEN 'frame' ELSE 'txxx' END AS action FROM (SELECT DISTINCT tag_key FROM rating_tags WHERE tag_key IS NOT NULL)""")
def ape_actions(spark, d):
    return table(spark, d, "rating_tags").select("tag_key").where("tag_key is not null").distinct().select("tag_key", decode.ape_action(F.col("tag_key")).alias("action"))


@query("popm_remap", "SELECT old, new, count(*) AS n FROM (SELECT try_cast(rating AS INTEGER) AS old, CASE try_cast(rating AS INTEGER) WHEN 127 THEN 64 WHEN 254 THEN 196 ELSE try_cast(rating AS INTEGER) END AS new FROM rating_tags WHERE regexp_matches(rating, '^[0-9]{1,3}$')) GROUP BY 1, 2")
def popm_remap(spark, d):
    rows = table(spark, d, "rating_tags").where(F.col("rating").rlike("^[0-9]{1,3}$")).select(F.col("rating").cast("int").alias("old"))
    return rows.select("old", decode.remapped_byte(F.col("old")).alias("new")).groupBy("old", "new").agg(F.count("*").alias("n"))


@query("frame_classes", "SELECT CASE WHEN f IN ('TYER', 'TSIZ') THEN 'obsolete' WHEN f = 'TCMP' THEN 'nonstandard' WHEN regexp_matches(f, '^[A-Z][A-Z0-9]{3}$') THEN 'standard' ELSE 'garbage' END AS class, count(*) AS n FROM (SELECT ['TYER', 'TIT2', 'tit2', 'TCMP', 'TSIZ', 'NCON!'][CAST(1 + reading_id % 6 AS INTEGER)] AS f FROM rating_tags) GROUP BY 1")
def frame_classes(spark, d):
    frames = F.array(*(F.lit(x) for x in ("TYER", "TIT2", "tit2", "TCMP", "TSIZ", "NCON!")))
    rows = table(spark, d, "rating_tags").select(F.element_at(frames, (F.col("reading_id") % 6 + 1).cast("int")).alias("f"))
    return rows.groupBy(decode.frame_class(F.col("f")).alias("class")).agg(F.count("*").alias("n"))


# --- art and tag plans ------------------------------------------------------------------------------------------------


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    """Tracks as files with pictures, as follows from their ids: the tables hold none."""
    return current(spark, d).select("root", "dir", "filename", "ext", F.when(F.col("track_id") % 3 > 0, F.col("track_id") % 50).alias("picture"))


@query("art_best", T + """
, f AS (SELECT root, dir, ext, filename, CASE WHEN track_id % 3 > 0 THEN track_id % 50 END AS picture, list_position(['.flac', '.opus', '.ogg', '.m4a', '.mp3'], ext) AS rank FROM t WHERE ext IN ('.flac', '.opus', '.ogg', '.m4a', '.mp3')
  QUALIFY row_number() OVER (PARTITION BY root, dir, ext ORDER BY filename) = 1)
SELECT root, dir, filename, picture FROM f WHERE picture IS NOT NULL QUALIFY row_number() OVER (PARTITION BY root, dir ORDER BY rank) = 1""")
def art_best(spark, d):
    return art.best_art(_pictures(spark, d))


@query("art_missing", T + """
SELECT f.root, f.dir, CASE WHEN bool_or(f.track_id % 3 > 0) THEN 'embedded_only' ELSE 'none' END AS bucket FROM t f GROUP BY f.root, f.dir HAVING NOT bool_or(f.track_id % 40 = 0)""")
def art_missing(spark, d):
    tracks = current(spark, d)
    covers = tracks.where("track_id % 40 = 0").select("root", "dir", F.lit("Cover.jpg").alias("filename"))
    return art.missing_art(tracks, covers, tracks.where("track_id % 3 > 0"))


@query("art_mismatch", T + """
, v AS (SELECT CASE WHEN track_id % 5 = 0 THEN NULL ELSE track_id % 7 END AS e, track_id % 6 AS c, CASE WHEN track_id % 11 > 0 THEN track_id % 4 END AS es, track_id % 3 AS cs FROM t)
SELECT CASE WHEN e IS NULL THEN 'IRRELEVANT' WHEN e = c THEN 'MATCH' WHEN es IS NULL THEN 'UNREADABLE' WHEN es = cs THEN 'SAME PIXELS' ELSE 'DIFFERENT IMAGE' END AS verdict, count(*) AS n FROM v GROUP BY 1""")
def art_mismatch(spark, d):
    i = F.col("track_id")
    size = lambda c: F.struct(c.alias("width"), c.alias("height"))
    verdict = art.art_verdict(F.when(i % 5 > 0, i % 7), i % 6, F.when(i % 11 > 0, size(i % 4)), size(i % 3))
    return current(spark, d).select(verdict.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("art_to_embed", T + """
, c AS (SELECT root, dir, min(filename) AS cover FROM t WHERE track_id % 40 = 0 GROUP BY root, dir)
SELECT t.root, t.dir, t.filename, c.cover FROM t JOIN c ON t.root = c.root AND t.dir = c.dir WHERE t.track_id % 3 = 0""")
def art_to_embed(spark, d):
    tracks = current(spark, d)
    covers = tracks.where("track_id % 40 = 0").groupBy("root", "dir").agg(F.min("filename").alias("cover"))
    return art.to_embed(tracks.withColumn("has_art", F.col("track_id") % 3 > 0), covers)


_ACTION = "CASE WHEN lower(trim(tag_key)) IN ('genre', 'rating', 'comment') THEN lower(trim(tag_key)) ELSE 'txxx' END"


@query("ape_plan", f"""
SELECT reading_id, {_ACTION} AS action, CASE WHEN {_ACTION} = 'rating' THEN 'rating dropped' WHEN reading_id % 10 = 0 THEN 'skipped' WHEN reading_id % 4 = 0 THEN 'redundant' ELSE 'migrated' END AS outcome
FROM rating_tags WHERE tag_key IS NOT NULL""")
def ape_plan(spark, d):
    readings = table(spark, d, "rating_tags").where("tag_key is not null")
    path = F.col("reading_id").alias("path")
    fields = readings.select(path, F.col("tag_key").alias("key"), F.col("rating").alias("value"), (F.col("reading_id") % 10 == 0).alias("binary"), F.lit(None).cast("string").alias("mime"))
    present = readings.where("reading_id % 4 = 0").select(path, F.concat(F.lit("TXXX:"), F.lower("tag_key")).alias("frame"))
    return tagplans.plan_ape(fields, present).select(F.col("path").alias("reading_id"), "action", "outcome")


@query("rating_strip_plan", f"""
SELECT reading_id, round(s, 9) AS stars FROM (SELECT reading_id, CASE WHEN lower(tag_key) LIKE '%fmps_%' AND v BETWEEN 0 AND 1 THEN v * 5 WHEN v <= 5 THEN v WHEN v <= 10 THEN v / 2 WHEN v <= 100 THEN v / 20 WHEN v <= 255 THEN v * 5 / 255 END AS s
  FROM (SELECT *, {_NUM} AS v FROM rating_tags) WHERE regexp_matches(lower(tag_key), 'rating|score|stars')) WHERE s > 0""")
def rating_strip_plan(spark, d):
    plain = F.when(F.col("rating").rlike(r"^\s*[-+]?[0-9]*\.?[0-9]+\s*$"), F.trim("rating"))
    tags = table(spark, d, "rating_tags").select("reading_id", F.lit("vorbis").alias("container"), F.col("tag_key").alias("key"), plain.alias("value"))
    return tagplans.plan_rating_strip(tags).select("reading_id", F.round("stars", 9).alias("stars"))


@query("retag_plan", T + " SELECT track_id AS path, CASE WHEN coalesce(genre, '') = 'Paperpop' AND track_id % 2 = 0 THEN 'keep' ELSE 'retag' END AS action FROM t")
def retag_plan(spark, d):
    files = current(spark, d).select(F.col("track_id").alias("path"), F.when(F.col("genre").isNotNull(), F.array("genre")).alias("genres"), (F.col("track_id") % 2 == 0).alias("plain"))
    return tagplans.plan_retag(files, ["Paperpop"])


@query("lyrics_statuses", T + """
SELECT CASE WHEN track_id % 13 = 0 THEN 'exists' WHEN coalesce(artist, '') = '' OR coalesce(title, '') = '' THEN 'untagged' WHEN track_id % 2 = 1 THEN 'not-found' WHEN track_id % 11 = 0 THEN 'error' WHEN track_id % 7 = 0 THEN 'instrumental' WHEN track_id % 5 = 0 THEN 'plain-only' ELSE 'would-write' END AS status, count(*) AS n FROM t GROUP BY 1""")
def lyrics_statuses(spark, d):
    tracks, i = current(spark, d), F.col("track_id")
    found = tracks.where(i % 2 == 0).select("track_id", F.when(i % 11 == 0, "timeout").alias("error"), (i % 7 == 0).alias("instrumental"), F.when(i % 5 > 0, "[00:01] la").otherwise(" ").alias("synced"))
    return tagplans.lyrics_status(tracks.withColumn("has_sidecar", i % 13 == 0), found).groupBy("status").agg(F.count("*").alias("n"))


@query("folder_subtrees", T + """
, p AS (SELECT root, string_split(dir, '/') AS w FROM t WHERE dir <> '')
SELECT root, folder, count(*) AS n_files FROM (SELECT root, unnest([list_aggregate(w[1:i], 'string_agg', '/') FOR i IN range(1, len(w) + 1)]) AS folder FROM p) GROUP BY root, folder""")
def folder_subtrees(spark, d):
    return tagplans.subtree_counts(current(spark, d))
