"""Queries over the bytes of files: tables are written as audio files' bytes and read back by the readers of containers.

The SQL gives what went in, so a row that matches went through the writer, the reader and the decoder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.decode import frame_class
from shelfmark.operators.duplicates import content_tiers
from shelfmark.operators.tracks import decoded_tracks
from shelfmark.plans.catalogue import T, current
from shelfmark.session import table
from shelfmark.sources.binary import fingerprints_of, image_size, read_bytes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FIELDS = ("title", "artist", "album", "genre")


def query(name: str, sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def _written(rows: DataFrame, write: Callable[[dict], bytes], ext: str) -> DataFrame:
    """Each row of a column `id` as the bytes of a file: path, content, ext."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [write({k: None if v is None or v != v else v for k, v in row.items()}) for row in batch.to_dict("records")]
            yield pd.DataFrame({"path": batch["id"].astype(str), "content": made, "ext": ext})

    return rows.mapInPandas(run, "path string, content binary, ext string")


def _fields(row: dict) -> dict[str, str | None]:
    texts = {k: row[k] for k in FIELDS}
    return texts | {"tracknumber": None if row["trackno"] is None else f"{int(row['trackno'])}/99", "date": None if row["year"] is None else f"{int(row['year'])}-01-01"}


def _mp3(row: dict) -> bytes:
    from shelfmark.sinks.tagbytes import with_id3

    old = with_id3(b"sound", {"title": "before", "comment": None})
    return with_id3(old, _fields(row))


def _flac(row: dict) -> bytes:
    from shelfmark.sinks.tagbytes import with_comments

    info = b"\x00" * 10 + ((44100 << 44) + 441_000).to_bytes(8) + b"\x00" * 16
    return with_comments(b"fLaC\x80" + len(info).to_bytes(3) + info + b"sound", _fields(row))


def _back(nulls: str) -> str:
    """What comes back of the tags: nulls as slashes, no white space at the ends, nothing for nothing."""
    clean = ", ".join(rf"nullif(regexp_replace({nulls.format(c=c)}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '') AS {c}" for c in FIELDS)
    return T + f" SELECT track_id, {clean}, CASE WHEN trackno > 0 THEN trackno END AS trackno, CASE WHEN year BETWEEN 1200 AND 2100 THEN year END AS year FROM t"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d).select(F.col("track_id").alias("id"), *FIELDS, "trackno", "year")


def _read_back(files: DataFrame) -> DataFrame:
    rows = decoded_tracks(read_bytes(files, "path", "content", "ext"))
    return rows.select(F.col("path").cast("bigint").alias("track_id"), *FIELDS, "trackno", "year")


# an ID3 frame is cut at its nulls, and empty values are none
@query("files_id3_tags", _back("regexp_replace(trim({c}, chr(0)), '\\x00+', '/', 'g')"))
def files_id3_tags(spark, d):
    return _read_back(_written(_tagged(spark, d), _mp3, ".mp3"))


@query("files_flac_tags", _back("replace({c}, chr(0), '/')"))
def files_flac_tags(spark, d):
    return _read_back(_written(_tagged(spark, d), _flac, ".flac"))


def _with_odd_frames(row: dict) -> bytes:
    from shelfmark.sinks.tagbytes import with_id3

    return with_id3(b"", {"TIT2": row["title"], "TYER": None if row["year"] is None else str(int(row["year"])), "TCMP": "1" if row["trackno"] == 1 else None})


@query("files_junk_frames", T + """
SELECT 'obsolete' AS class, 'TYER' AS frame, count(*) AS n_files FROM t WHERE year IS NOT NULL HAVING count(*) > 0
UNION ALL SELECT 'nonstandard', 'TCMP', count(*) FROM t WHERE trackno = 1 HAVING count(*) > 0""")
def files_junk_frames(spark, d):
    read = read_bytes(_written(_tagged(spark, d), _with_odd_frames, ".mp3"), "path", "content", "ext")
    frames = read.select("path", F.explode("frames").alias("frame")).withColumn("class", frame_class(F.col("frame")))
    return frames.where("class is not null and class <> 'standard'").groupBy("class", "frame").agg(F.count("*").alias("n_files"))


def _with_cover(row: dict) -> bytes:
    from shelfmark.sinks.tagbytes import with_id3

    png = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4) + b"IHDR" + int(row["w"]).to_bytes(4) + int(row["h"]).to_bytes(4)
    return with_id3(b"", {"title": "x"}, [(png, "image/png")])


@query("files_art_sizes", T + " SELECT track_id, coalesce(bitrate_kbps, 0) AS width, coalesce(trackno, 0) AS height FROM t")
def files_art_sizes(spark, d):
    rows = current(spark, d).select(F.col("track_id").alias("id"), F.coalesce("bitrate_kbps", F.lit(0)).alias("w"), F.coalesce("trackno", F.lit(0)).alias("h"))
    read = read_bytes(_written(rows, _with_cover, ".mp3"), "path", "content", "ext")

    @F.pandas_udf("width int, height int")
    def sizes(art: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_size(a) or (None, None) for a in art], columns=["width", "height"])

    return read.select(F.col("path").cast("bigint").alias("track_id"), sizes("art").alias("s")).select("track_id", "s.width", "s.height")


def _sounding(row: dict) -> bytes:
    from shelfmark.sinks.tagbytes import with_id3

    return with_id3(row["text"].encode(), {"title": row["source"] or "none"})


@query("files_content_tiers", """
WITH f AS (SELECT coalesce(source, 'none') AS s, text FROM documents WHERE text <> ''
), exact AS (SELECT s, text, count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 1
), rest AS (SELECT text, count(*) AS n FROM f ANTI JOIN exact USING (s, text) GROUP BY text HAVING count(*) > 1)
SELECT 'exact' AS tier, n AS n_files, count(*) AS n_groups FROM exact GROUP BY n UNION ALL SELECT 'stream', n, count(*) FROM rest GROUP BY n""")
def files_content_tiers(spark, d):
    rows = table(spark, d, "documents").where("text <> ''").select(F.col("doc_id").alias("id"), "text", F.when(F.col("source") != "", F.col("source")).alias("source"))
    prints = fingerprints_of(_written(rows, _sounding, ".mp3"), "path", "content", "ext")
    return content_tiers(prints).groupBy("tier", "n_files").agg(F.count("*").alias("n_groups"))
