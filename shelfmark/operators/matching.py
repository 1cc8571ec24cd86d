"""Lookups that are no plain equality: nearest duration, nearest ancestor, measured against stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.decode import R128_BASE, gain_verdict
from shelfmark.functions.layout import ancestors
from shelfmark.functions.normalize import base_artist, casefolded, credited_artist, folder_key
from shelfmark.session import checkpoint


def _digest(columns: list[Column]) -> Column:
    """16 bytes for the values of some columns; null if one of them is null."""
    texts = [c.cast("string") for c in columns]
    return F.substring(F.unhex(F.sha2(F.concat(*(part for t in texts for part in (F.length(t).cast("string"), F.lit(":"), t))), 256)), 1, 16)


def _two_first(rows: DataFrame, keys: list[str], second: bool) -> DataFrame:
    """The smallest offer_id of each key as id_1 and, where wanted, the next one as id_2 (null if there is none)."""
    one = rows.groupBy(*keys).agg(F.min("offer_id").alias("id_1"))
    if not second:
        return one.withColumn("id_2", F.lit(None).cast(one.schema["id_1"].dataType))
    two = rows.join(one, keys).where("offer_id > id_1").groupBy(*keys).agg(F.min("offer_id").alias("id_2"))
    return one.join(two, keys, "left")


def nearest_duration(wanted: DataFrame, offers: DataFrame, keys: list[str], tolerance: float = 2.0, itself: bool = True, names: tuple[str, ...] = ()) -> DataFrame:
    """For each wanted row (id, keys, duration) the best offer (offer_id, keys, duration): id, offer_id, how.

    Of offers with equal keys the nearest duration within the tolerance (near), else the first by id whose `names` are
    the wanted ones without case (exact; null is as empty), else the first by id (first); of equally near ones the first
    by id. Without `names` there is no exact step. Durations count to the microsecond; null or zero ones are near nothing. With itself=False
    both are one table and no row is offered to itself.

    Only distinct durations of a key meet: they are cut into cells as wide as the tolerance, each wanted duration stands
    in three of them, and in each the neighbours below and above it are read off the sorted cell. No pairs are made. Keys and names go as
    digests of 16 bytes; if no row is offered to itself, rows that are alone with their key are settled at once.
    """
    key = _digest([F.col(k) for k in keys]).alias("key")
    at = F.when(F.col("duration") > 0, F.round("duration", 6)).alias("at")
    said = [_digest([casefolded(F.coalesce(n, F.lit(""))) for n in names]).alias("said")] if names else []
    cell = F.floor(F.col("at") / tolerance)
    w = checkpoint(wanted.select("id", key, at, *said))
    if itself:
        o = checkpoint(offers.select("offer_id", key, at, *said).where("key is not null"))
        open_ = w
    else:
        several = w.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        open_ = checkpoint(w.join(several, "key"))
        o = open_.withColumnRenamed("id", "offer_id")
    held = _two_first(o.where("at is not null"), ["key", "at"], not itself).select("key", cell.alias("cell"), "at", "id_1", "id_2", F.lit(False).alias("asked"))
    asked = open_.where("at is not null and key is not null").select("key", "at").distinct().select("key", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"), "at")
    kind = o.schema["offer_id"].dataType
    marks = held.unionByName(asked.withColumns({"id_1": F.lit(None).cast(kind), "id_2": F.lit(None).cast(kind), "asked": F.lit(True)}))
    marks = marks.groupBy("key", "cell", "at").agg(F.min("id_1").alias("id_1"), F.min("id_2").alias("id_2"), F.max("asked").alias("asked"))
    there = F.when(F.col("id_1").isNotNull(), F.struct("at", "id_1"))
    beside = lambda order: F.last(there, True).over(W.partitionBy("key", "cell").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    both = marks.withColumns({"below": beside(F.asc("at")), "above": beside(F.desc("at"))}).where("asked")
    gap = lambda c: F.abs(F.col("at") - F.col(f"{c}.at"))
    off = lambda c: F.when(gap(c) <= tolerance, F.struct(F.round(gap(c), 6).alias("d"), F.col(f"{c}.id_1").alias("off_id")))
    best = both.groupBy("key", "at").agg(F.min("id_1").alias("at_1"), F.min("id_2").alias("at_2"), F.min(F.least(off("below"), off("above"))).alias("off")).select("key", "at", "at_1", "at_2", "off.off_id")
    other = lambda one, two: F.col(one) if itself else F.when(F.col(one) == F.col("id"), F.col(two)).otherwise(F.col(one))
    joined = open_.join(_two_first(o, ["key"], not itself), "key", "left").join(best, ["key", "at"], "left")
    near_id, exact_id, first_id = F.coalesce(other("at_1", "at_2"), F.col("off_id")), F.lit(None).cast(kind), other("id_1", "id_2")
    if names:
        exact = _two_first(o, ["key", "said"], not itself).withColumnsRenamed({"id_1": "exact_1", "id_2": "exact_2"})
        joined, exact_id = joined.join(exact, ["key", "said"], "left"), other("exact_1", "exact_2")
    how = F.when(near_id.isNotNull(), "near").when(exact_id.isNotNull(), "exact").when(first_id.isNotNull(), "first").otherwise("none")
    found = joined.select("id", F.coalesce(near_id, exact_id, first_id).alias("offer_id"), how.alias("how"))
    if itself:
        return found
    alone = w.join(several, "key", "left_anti").select("id", F.lit(None).cast(kind).alias("offer_id"), F.lit("none").alias("how"))
    return found.unionByName(alone)


def nearest_ancestor(rows: DataFrame, directory: str, marked: DataFrame, folder: str, value: str) -> DataFrame:
    """`rows` with `authority`: the value of the nearest folder above (or at) each row's that is marked; null if none is.

    Each distinct folder is spelled out into its ancestors, which meet the marked ones by an equi-join.
    """
    dirs = rows.select(F.col(directory).alias("_d")).where("_d is not null").distinct()
    above = dirs.select("_d", F.explode(F.array_append(F.array_compact(ancestors(F.col("_d"))), F.col("_d"))).alias("_a"))
    met = above.join(marked.select(F.col(folder).alias("_a"), F.col(value).alias("_v")), "_a").groupBy("_d").agg(F.max_by("_v", F.struct(F.length("_a"), "_v")).alias("authority"))
    return rows.join(met, rows[directory] == met["_d"], "left").drop("_d")


def verify_gain(stored: DataFrame, measured: DataFrame, keys: list[str], target: float = -18.0, tolerance: float = 0.5) -> DataFrame:
    """Each measured row (keys, loudness) with the verdict on the stored gain (keys, gain_db, convention).

    Gains of the R128 convention are held against its own base.
    """
    joined = measured.join(stored, keys, "left")
    base = F.when(F.col("convention") == "r128", F.lit(R128_BASE)).otherwise(F.lit(target))
    return joined.select(*keys, "gain_db", "loudness", gain_verdict(F.col("gain_db"), F.col("loudness"), base, tolerance).alias("verdict"))


def same_name_folders(folders: DataFrame, parent: str, name: str, n_files: str) -> DataFrame:
    """Folders of one parent whose names differ by form only: parent, key, canonical, source, in the order of merging.

    The canonical one has most files, of equals the first by name; hidden folders are left alone. One row per source.
    """
    keyed = folders.where(~F.startswith(F.col(name), F.lit("."))).select(F.col(parent).alias("parent"), folder_key(F.col(name)).alias("key"), F.col(name).alias("name"), F.col(n_files).alias("n"))
    canonical = keyed.groupBy("parent", "key").agg(F.min(F.struct((-F.col("n")).alias("minus"), "name")).alias("c"), F.count("*").alias("k")).where("k > 1").select("parent", "key", F.col("c.name").alias("canonical"))
    return keyed.join(canonical, ["parent", "key"]).where("name <> canonical").select("parent", "key", "canonical", F.col("name").alias("source"), F.col("n").alias("n_files"))


def restamped_artists(tracks: DataFrame, artist: str, marked: DataFrame) -> DataFrame:
    """Tracks with `planned_artist`: the library's spelling of the artist's name, a guest's credit kept.

    marked: key (folder_key of the name) and spelling; where the artist has none, the tag stays as it is.
    """
    spelled = marked.groupBy(F.col("key").alias("_k")).agg(F.min("spelling").alias("_spelling"))
    joined = tracks.withColumn("_key", folder_key(base_artist(F.col(artist)))).join(spelled, F.col("_key") == F.col("_k"), "left")
    return joined.withColumn("planned_artist", F.when(F.col("_spelling").isNotNull(), credited_artist(F.col(artist), F.col("_spelling"))).otherwise(F.col(artist))).drop("_key", "_k", "_spelling")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left of a scan that was broken off: rows without a verdict yet. Null keys were never judged."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def merge_plan(source: DataFrame, target: DataFrame, keys: list[str] = ("rel",), on: list[str] | None = None) -> DataFrame:
    """What merging one listing (keys, size, digest, ext, pixels) into another does with each file: keys, action.

    The two meet by `on`, which is all keys unless told otherwise.

    MOVE where the target has no such path; DROP DUPE for equal bytes; KEEP BOTH for sound; of two images the one of
    more pixels stays, of equals the larger, and one that cannot be read gives way; any other file is dropped.
    """
    from shelfmark.functions.layout import IMAGES
    from shelfmark.schema import AUDIO_EXTENSIONS

    on = list(on or keys)
    there = target.select(*on, F.col("size").alias("t_size"), F.col("digest").alias("t_digest"), F.col("pixels").alias("t_pixels"), F.lit(True).alias("there"))
    joined = source.join(there, on, "left")
    readable, t_readable = F.col("pixels").isNotNull(), F.col("t_pixels").isNotNull()
    wins = F.when(readable & t_readable, F.struct("pixels", "size") > F.struct(F.col("t_pixels"), F.col("t_size"))).when(readable != t_readable, readable).otherwise(F.col("size") > F.col("t_size"))
    action = (
        F.when(F.col("there").isNull(), "MOVE")
        .when((F.col("size") == F.col("t_size")) & (F.col("digest") == F.col("t_digest")), "DROP DUPE")
        .when(F.col("ext").isin(*AUDIO_EXTENSIONS), "KEEP BOTH")
        .when(F.col("ext").isin(*IMAGES), F.when(wins, "REPLACE IMAGE").otherwise("DROP IMAGE"))
        .otherwise("DROP NON-AUDIO")
    )
    return joined.select(*keys, action.alias("action"))


def free_suffixes(plan: DataFrame, directory: str, stem: str) -> DataFrame:
    """`plan` with `suffix`: `.from-fragment` for the first row of a name, then with a number from 2 on."""
    k = F.row_number().over(W.partitionBy(directory, stem).orderBy("rel"))
    return plan.withColumn("suffix", F.when(k == 1, ".from-fragment").otherwise(F.concat(F.lit(".from-fragment-"), k.cast("string"))))


def settled(df: DataFrame) -> DataFrame:
    """A plan as it stands, written to the shared folder, so that a committer that is retried sees the same one."""
    return checkpoint(df)
