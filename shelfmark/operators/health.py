"""A health score for every album, grades and a digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.layout import DEFAULT_LAYOUT, layout_depths, stray_class
from shelfmark.functions.normalize import name_key
from shelfmark.operators.audits import below_bitrate, gain_bucket, missing_fields
from shelfmark.operators.dominant import dominant
from shelfmark.schema import MUSIC, Roles, order_key

# What each shortcoming costs of the hundred points.
PER_FIELD, FIELDS_AT_MOST = 4, 40
GAIN = 30
SMALL_COVER, ONLY_EMBEDDED, NO_ART = 8, 12, 20
PER_LOW_FILE, LOW_FILES_AT_MOST = 2, 10
GRADES = ((90, "A"), (75, "B"), (50, "C"))


def grade(score: Column) -> Column:
    out = F.lit("D")
    for least, letter in reversed(GRADES):
        out = F.when(score >= least, letter).otherwise(out)
    return out


def album_scores(tracks: DataFrame, art: DataFrame | None, min_kbps: int = 192, min_res: int = 500, roles: Roles = MUSIC) -> DataFrame:
    """One row per folder: score, grade, n_files, and what each lens costs.

    art: root, dir, has_cover, cover_width, cover_height, has_embedded; a folder that is missing there has no art, and
    an unknown size of the cover costs nothing. Without a table of art nothing is known of it and the lens costs
    nothing. One aggregation of the tracks, joined once.
    """
    folder = tracks.groupBy(*roles.folder).agg(
        F.count("*").alias("n_files"),
        F.sum(F.size(missing_fields(roles))).alias("n_missing"),
        F.count_if(F.col(roles.track_gain)).alias("n_gain"),
        F.count_if(below_bitrate(roles, min_kbps)).alias("n_low"),
    )
    if art is None:
        unknown = {"has_cover": F.lit(True), "has_embedded": F.lit(False), "cover_width": F.lit(None).cast("int"), "cover_height": F.lit(None).cast("int")}
    joined = folder.withColumns(unknown) if art is None else folder.join(art, [*roles.folder], "left")
    covered, embedded = F.coalesce("has_cover", F.lit(False)), F.coalesce("has_embedded", F.lit(False))
    small = F.coalesce(F.least("cover_width", "cover_height") < min_res, F.lit(False))
    costs = {
        "tags_cost": F.least(F.col("n_missing") * PER_FIELD, F.lit(FIELDS_AT_MOST)),
        "gain_cost": F.bround(F.lit(float(GAIN)) * (F.col("n_files") - F.col("n_gain")) / F.col("n_files")),
        "art_cost": F.when(covered & small, SMALL_COVER).when(covered, 0).when(embedded, ONLY_EMBEDDED).otherwise(NO_ART),
        "bitrate_cost": F.least(F.col("n_low") * PER_LOW_FILE, F.lit(LOW_FILES_AT_MOST)),
    }
    costed = joined.select(*roles.folder, "n_files", *(c.cast("bigint").alias(name) for name, c in costs.items()))
    score = F.greatest(F.lit(0), 100 - F.col("tags_cost") - F.col("gain_cost") - F.col("art_cost") - F.col("bitrate_cost"))
    return costed.withColumn("score", score).withColumn("grade", grade(F.col("score")))


def grades(scores: DataFrame) -> DataFrame:
    """One row: albums of each grade, of all, flagged ones, and the mean score with one decimal."""
    counts = [F.count_if(F.col("grade") == g).alias(f"n_{g.lower()}") for g in "ABCD"]
    return scores.agg(F.count("*").alias("n_albums"), *counts, F.count_if(F.col("score") < 100).alias("n_flagged"), F.bround(F.coalesce(F.avg("score"), F.lit(0.0)), 1).alias("mean"))


def worst(scores: DataFrame, n: int = 5, roles: Roles = MUSIC) -> DataFrame:
    """The albums with the fewest points; the limit is what the report is."""
    return scores.orderBy("score", *roles.folder).limit(n).select(*roles.folder, "score", "n_files")


def digest(tracks: DataFrame, art: DataFrame | None, layout: str = DEFAULT_LAYOUT, min_kbps: int = 192, roles: Roles = MUSIC) -> DataFrame:
    """Rows (finding, n) of all lenses from few passes: over tracks once, over folders once, over album keys once.

    Without a table of art no folder counts as one without art.
    """
    artist_depth, album_depth = layout_depths(layout)
    stray = stray_class(F.concat_ws("/", roles.dir, roles.filename), artist_depth, album_depth)
    per_track = tracks.agg(
        F.count("*").alias("files"),
        F.count_if(F.size(missing_fields(roles)) > 0).alias("incomplete_tags"),
        F.count_if(below_bitrate(roles, min_kbps)).alias("below_bitrate"),
        *(F.count_if(stray == s).alias(f"stray_{s.replace('-', '_')}") for s in ("hidden", "loose", "wrong-depth")),
    )
    folder = tracks.groupBy(*roles.folder).agg(
        F.count("*").alias("n"), F.count_if(F.col(roles.track_gain)).alias("t"), F.count_if(F.col(roles.album_gain)).alias("a"), F.count_distinct(roles.ext).alias("exts")
    )
    bucket = gain_bucket(F.col("t"), F.col("a"), F.col("n"))
    covered = F.coalesce("has_cover", F.lit(False)) | F.coalesce("has_embedded", F.lit(False))
    seen = folder.withColumns({"has_cover": F.lit(True), "has_embedded": F.lit(False)}) if art is None else folder.join(art, [*roles.folder], "left")
    per_folder = seen.agg(
        F.count("*").alias("albums"),
        *(F.count_if(bucket == b).alias(f"gain_{b.lower()}") for b in ("MISSING", "PARTIAL", "NO_ALBUM_GAIN")),
        F.count_if(~covered).alias("no_art"),
        F.count_if(F.col("exts") > 1).alias("several_formats"),
    )
    keys = dominant(tracks, roles.folder, [roles.artist, roles.album], order_key(roles)).where(F.col(roles.artist).isNotNull() & F.col(roles.album).isNotNull())
    per_key = keys.groupBy(name_key(F.col(roles.artist)).alias("x"), name_key(F.col(roles.album)).alias("y")).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicate_albums"))

    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("finding"), F.col(c).cast("bigint").alias("n")) for c in df.columns))).alias("f")).select("f.*")

    return rows(per_track).unionByName(rows(per_folder)).unionByName(rows(per_key))
