"""Duplicates in a catalogue: exact keys, several formats, near names, equal durations, equal content."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.functions.alike import alike
from shelfmark.functions.normalize import loosened, name_key
from shelfmark.operators.stats import filled
from shelfmark.schema import MUSIC, Roles
from shelfmark.session import checkpoint


def exact_albums(dirs: DataFrame, artist: str = "artist", album: str = "album", place: list[str] = ("root", "dir")) -> DataFrame:
    """Albums that lie in several folders: norm_artist, norm_album, n_dirs, total places. Folders without a key count not."""
    keyed = dirs.select(name_key(F.col(artist)).alias("norm_artist"), name_key(F.col(album)).alias("norm_album"), F.concat_ws("/", *place).alias("place")).where("norm_artist <> '' and norm_album <> ''")
    return keyed.groupBy("norm_artist", "norm_album").agg(F.count("*").alias("n_dirs"), F.min("place").alias("first_place"), F.max("place").alias("last_place")).where("n_dirs > 1")


def several_formats(tracks: DataFrame, roles: Roles = MUSIC) -> DataFrame:
    """Tracks that a folder holds in two or more formats: root, dir, trackno, title_key, n_formats, formats.

    The title, or the file name without it, is the key together with the track number.
    """
    stem = F.regexp_replace(F.col(roles.filename), r"(?<=[^.])\.[^.]*$", "")
    title = F.when(filled(F.col(roles.title)), F.col(roles.title)).otherwise(stem)
    keyed = tracks.select(*roles.folder, F.col(roles.trackno).alias("trackno"), name_key(title).alias("title_key"), F.col(roles.ext).alias("ext"))
    counted = keyed.groupBy(*roles.folder, "trackno", "title_key").agg(F.array_sort(F.collect_set("ext")).alias("exts"))
    return counted.where(F.size("exts") > 1).select(*roles.folder, "trackno", "title_key", F.size("exts").cast("bigint").alias("n_formats"), F.array_join("exts", " ").alias("formats"))


def greedy_anchors(values: list[float], delta: float) -> list[float]:
    """Of sorted numbers the first one of each one's cluster: a new cluster begins with a value that exceeds the first
    one of the cluster by more than `delta`. One pass."""
    out: list[float] = []
    for value in values:
        out.append(value if not out or value - out[-1] > delta else out[-1])
    return out


def anchored(durations: DataFrame, keys: list[str], values: str, delta: float) -> DataFrame:
    """The distinct known numbers in the array `values` of each key, with the anchor of their cluster: keys, value, anchor."""

    @F.pandas_udf("array<double>")
    def anchors(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: greedy_anchors(list(a), delta))

    sorted_values = durations.select(*keys, F.array_sort(F.col(values)).alias("_v"))
    pairs = sorted_values.withColumn("_a", anchors("_v")).select(*keys, F.explode(F.arrays_zip("_v", "_a")).alias("_p"))
    return pairs.select(*keys, F.col("_p._v").alias("value"), F.col("_p._a").alias("anchor"))


def track_clusters(tracks: DataFrame, delta: float = 2.0, roles: Roles = MUSIC) -> DataFrame:
    """Copies of a track in several folders, by artist and title, cut into clusters of nearly equal duration.

    norm_artist, norm_title, anchor (the least duration of the cluster, null for copies without one), n_copies, n_dirs.
    Only keys that occur in two folders are gathered, and of those only the distinct durations with their numbers, so a
    key that very many rows share stays small.
    """
    keyed = tracks.where(filled(F.col(roles.artist)) & filled(F.col(roles.title))).select(
        name_key(F.col(roles.artist)).alias("norm_artist"), name_key(F.col(roles.title)).alias("norm_title"), F.col(roles.duration).cast("double").alias("value"), F.struct(*roles.folder).alias("place")
    )
    keyed = keyed.where("norm_artist <> '' and norm_title <> ''")
    counted = keyed.groupBy("norm_artist", "norm_title", "value", "place").agg(F.count("*").alias("n"))
    several = counted.groupBy("norm_artist", "norm_title").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("norm_artist", "norm_title")
    held = counted.join(several, ["norm_artist", "norm_title"], "left_semi")
    durations = held.where("value is not null").groupBy("norm_artist", "norm_title").agg(F.collect_set("value").alias("values"))
    clusters = anchored(durations.withColumnsRenamed({"norm_artist": "_a1", "norm_title": "_t1"}), ["_a1", "_t1"], "values", delta).withColumnRenamed("value", "_v1")
    met = held.join(clusters, (F.col("norm_artist") == F.col("_a1")) & (F.col("norm_title") == F.col("_t1")) & (F.col("value") == F.col("_v1")), "left")
    return met.groupBy("norm_artist", "norm_title", "anchor").agg(F.sum("n").alias("n_copies"), F.count_distinct("place").alias("n_dirs")).where("n_dirs > 1")


def comparisons(names: DataFrame, group: str, text: str, most: int) -> DataFrame:
    """`names` as rows of units of work, (group, i, j): in a unit the names with `h` = i meet those with `h` = j.

    A group of up to `most` names is one unit. A larger one is dealt into parts by the hash of the text, every two parts
    are a unit and each part is one with itself, so any two names meet in one unit and no unit is much over two parts.
    """
    parts = names.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / most).alias("_k")).where("_k > 1")
    dealt = names.join(parts, F.col(group) == F.col("_g"), "left").withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("h", F.pmod(F.xxhash64(text), "_k").cast("int"))
    met = dealt.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_k").cast("int") - 1)))
    units = parts.agg(F.sum(F.col("_k") * (F.col("_k") + 1) / 2)).first()[0] or 0
    # large units, of which there are few, shall not often share a task
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")) + min(2 * int(units), 4000)
    rows = met.select(*names.columns, "h", F.least("h", "_x").alias("i"), F.greatest("h", "_x").alias("j"))
    return rows.repartition(tasks, group, "i", "j")


def similar_albums(dirs: DataFrame, threshold: float = 0.85, artist: str = "artist", album: str = "album", id_column: str = "dir_id", most: int = 1 << 14) -> DataFrame:
    """Pairs of folders of one artist whose albums have nearly the same name: id_a, id_b, ratio.

    Albums that are exact duplicates are left out first. Distinct names of an artist are compared, not folders. Names are
    what is shuffled, never pairs: those of an artist of up to `most` names once, of a larger one once for each part that
    they meet (`comparisons`). The pairs of a unit are found in memory (`functions.alike`): all of fitting lengths by the
    letters they share, which costs some nanoseconds each, those that pass by their common subsequence, and then by the
    ratio. The ratio is that of matching blocks, which depends on the order; the name of the smaller first id comes first.
    Pairs are those between the first folders of each name.
    """
    keyed = dirs.select(name_key(F.col(artist)).alias("norm_artist"), name_key(F.col(album)).alias("norm_album"), F.col(id_column).alias("id")).where("norm_artist <> '' and norm_album <> ''")
    single = keyed.groupBy("norm_artist", "norm_album").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("norm_artist", loosened(F.col("norm_album")).alias("loose"), "id")
    # folders of one loose name: each is paired with the first one of the name
    place = W.partitionBy("norm_artist", "loose").orderBy(F.col("id").asc_nulls_last())
    placed = checkpoint(single.where("loose <> ''").withColumn("place", F.row_number().over(place)).withColumn("first", F.first("id").over(place)))
    equal = placed.where("id <> first").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("ratio"))
    units = comparisons(placed.where("place = 1 and first is not null").select("norm_artist", "loose", "first"), "norm_artist", "loose", most)

    def pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for found in alike(rows["loose"].tolist(), rows["unit"].to_numpy(), (rows["h"] == rows["i"]).to_numpy(), (rows["h"] == rows["j"]).to_numpy(), rows["first"].tolist(), threshold):
            yield pd.DataFrame(found, columns=["id_a", "id_b", "ratio"])

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # whole units, several small ones together
        held: list[pd.DataFrame] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                if sum(map(len, held)) < most:
                    continue
            if held:
                rows = pd.concat(held, ignore_index=True)
                key = rows[["norm_artist", "i", "j"]]
                rows["unit"] = (key != key.shift()).any(axis=1).cumsum()
                open_still = rows["unit"] == (rows["unit"].iloc[-1] if batch is not None else -1)
                held = [rows[open_still].drop(columns="unit")]
                if not open_still.all():
                    yield from pairs(rows[~open_still])

    kind = dict(dirs.dtypes)[id_column]
    ordered = units.sortWithinPartitions("norm_artist", "i", "j", F.length("loose"))
    return equal.unionByName(ordered.mapInPandas(ratios, f"id_a {kind}, id_b {kind}, ratio double"))


def content_duplicates(files: DataFrame, content: str, id_column: str) -> DataFrame:
    """Groups of files of equal content: digest, n_files, first_id. Null contents are no files, empty ones are all alike.

    Only the digest is shuffled, and combined before it is.
    """
    digest = F.sha2(F.col(content), 256)
    return files.where(F.col(content).isNotNull()).select(digest.alias("digest"), F.col(id_column).alias("id")).groupBy("digest").agg(F.count("*").alias("n_files"), F.min("id").alias("first_id")).where("n_files > 1")


def content_tiers(prints: DataFrame) -> DataFrame:
    """Duplicates by fingerprints (FINGERPRINT rows): tier, key, n_files. Files of equal content drop out of the lower
    tiers; then equal sound, then equal head and tail for files whose sound could not be located. Unreadable files none."""
    good = prints.where("error is null")
    exact = good.groupBy(F.col("full").alias("key")).agg(F.count("*").alias("n_files")).where("n_files > 1")
    rest = good.join(exact.select(F.col("key").alias("full")), "full", "left_anti")
    stream = rest.where("stream is not null").groupBy(F.col("stream").alias("key")).agg(F.count("*").alias("n_files")).where("n_files > 1").select(F.lit("stream").alias("tier"), "key", "n_files")
    sampled = rest.where("stream is null").groupBy(F.concat_ws(":", "head", "tail").alias("key")).agg(F.count("*").alias("n_files")).where("n_files > 1").select(F.lit("sampled").alias("tier"), "key", "n_files")
    return exact.select(F.lit("exact").alias("tier"), "key", "n_files").unionByName(stream).unionByName(sampled)
