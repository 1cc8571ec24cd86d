"""The dominant value of each group: the most frequent, of equals the one met first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.layout import DEFAULT_LAYOUT, folders, slot
from shelfmark.operators.stats import filled
from shelfmark.schema import MUSIC, Roles, order_key


def dominant(df: DataFrame, keys: list[str], values: list[str], order: Column) -> DataFrame:
    """One row per group of `keys` with the dominant value of each of `values`; null where a group has none.

    Two levels of counting, both combined before their shuffle, so that a group of any size is never gathered: first by
    group and value, then the best value of the group. All values are counted in one pass over the rows, as pairs of
    the value's number and the value.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(v).cast("string").alias("v")) for i, v in enumerate(values)))).alias("p")
    rows = df.select(*keys, order.alias("_order"), pairs).select(*keys, "_order", "p.i", F.when(filled(F.col("p.v")), F.col("p.v")).alias("v"))
    counted = rows.groupBy(*keys, "i", "v").agg(F.count("*").alias("n"), F.min("_order").alias("first"))
    # the least of (minus count, order of first meeting)
    rank = F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("minus"), F.col("first"), F.col("v")))
    best = counted.groupBy(*keys).agg(*(F.min(F.when(F.col("i") == i, rank)).getField("v").alias(v) for i, v in enumerate(values)))
    return best


def album_folders(tracks: DataFrame, layout: str = DEFAULT_LAYOUT, roles: Roles = MUSIC) -> DataFrame:
    """One row per folder: root, dir, artist, album, genre (dominant), n_tracks, mean_rating.

    A folder without an artist or album in its tags takes them from the layout's slots.
    """
    best = dominant(tracks, roles.folder, [roles.artist, roles.album, roles.genre], order_key(roles))
    totals = tracks.groupBy(*roles.folder).agg(F.count("*").alias("n_tracks"), F.round(F.avg(roles.rating), 6).alias("mean_rating"))
    directory = F.col(roles.dir)
    return best.join(totals, roles.folder).select(
        F.col(roles.root).alias("root"),
        directory.alias("dir"),
        F.coalesce(F.col(roles.artist), slot(directory, "artist", layout)).alias("artist"),
        F.coalesce(F.col(roles.album), slot(directory, "album", layout)).alias("album"),
        F.col(roles.genre).alias("genre"),
        "n_tracks",
        "mean_rating",
    )


def folder_info(tracks: DataFrame, roles: Roles = MUSIC) -> DataFrame:
    """One row per folder as the duplicate reports need it: artist, album, total_bytes, formats, fmt_bitrate.

    A folder without an artist or album in its tags takes the names of the folder above it and of itself.
    """
    best = dominant(tracks, roles.folder, [roles.artist, roles.album], order_key(roles))
    by_ext = tracks.groupBy(*roles.folder, roles.ext).agg(
        F.count("*").alias("n"), F.sum(roles.size).alias("bytes"), F.floor(F.avg(F.when(F.col(roles.bitrate) != 0, F.col(roles.bitrate)))).alias("kbps")
    )
    kinds = by_ext.groupBy(*roles.folder).agg(
        F.sum("bytes").alias("total_bytes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(roles.ext), "n")))).alias("formats"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kbps").isNotNull(), F.struct(F.col(roles.ext), "kbps"))))).alias("fmt_bitrate"),
    )
    parts = folders(F.col(roles.dir))
    return best.join(kinds, roles.folder).select(
        F.col(roles.root).alias("root"),
        F.col(roles.dir).alias("dir"),
        F.coalesce(F.col(roles.artist), F.try_element_at(parts, F.lit(-2)), F.element_at(F.split(F.col(roles.root), "/"), -1)).alias("artist"),
        F.coalesce(F.col(roles.album), F.try_element_at(parts, F.lit(-1))).alias("album"),
        "total_bytes",
        "formats",
        "fmt_bitrate",
    )


def sidecar_genre(albums: DataFrame, artist_folder: str = "artist_dir") -> DataFrame:
    """The genre under which an artist's loose files go: the one that most albums of the artist's folder have.

    albums: root, dir and genre of album folders. One row per folder above them: root, artist_dir, genre; of equally
    frequent genres the one met first by path.
    """
    above = F.regexp_replace("dir", r"/?[^/]*$", "")
    placed = albums.where(F.col("genre").isNotNull() & F.contains("dir", F.lit("/"))).select("root", above.alias(artist_folder), "dir", "genre")
    return dominant(placed, ["root", artist_folder], ["genre"], F.col("dir"))
