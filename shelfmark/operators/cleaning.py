"""Cleaning a tree: folders whose names differ by form only are merged, names brought to their display form.

Each pass is a table of planned actions over the listing as the pass before it leaves it, so a preview and what is
applied agree. Nothing is decided row by row on the driver; each pass is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.functions.layout import folders
from shelfmark.functions.normalize import legal_name, rendered
from shelfmark.operators.matching import free_suffixes, merge_plan, same_name_folders
from shelfmark.schema import is_audio
from shelfmark.session import checkpoint

#: What a listing must tell of each file; digest and pixels may be null where they are not known.
COLUMNS = ("root", "dir", "filename", "ext", "size", "digest", "pixels")
MOVING = ("MOVE", "KEEP BOTH", "REPLACE IMAGE", "RENAME")


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), "/")


def merge_folders(listing: DataFrame, depth: int) -> DataFrame:
    """The actions that merge folders of one depth and one parent whose names differ by form only.

    root, dir, filename (the file), to_dir, to_name (where it goes, null if it is dropped), action: MOVE, KEEP BOTH (under a
    free name), REPLACE IMAGE, DROP DUPE, DROP IMAGE or DROP NON-AUDIO. The folder with most files stays.
    """
    parts = folders(F.col("dir"))
    placed = listing.select(*COLUMNS).withColumns(
        {
            "parent": F.array_join(F.slice(parts, 1, depth - 1), "/") if depth > 1 else F.lit(""),
            "name": F.try_element_at(parts, F.lit(depth)),
            "below": F.array_join(F.slice(parts, depth + 1, 1 << 30), "/"),
        }
    ).where("name is not null")
    placed = placed.withColumns({"place": F.concat_ws("\x1f", "root", "parent"), "rel": _joined(F.col("below"), F.col("filename"))})
    counted = placed.groupBy("place", "name").agg(F.count("*").alias("n"))
    groups = same_name_folders(counted, "place", "name", "n").withColumnRenamed("parent", "place")
    sources = placed.join(groups.select("place", F.col("source").alias("name"), "canonical"), ["place", "name"])
    targets = placed.join(groups.select("place", F.col("canonical").alias("name")).distinct(), ["place", "name"]).withColumnRenamed("name", "canonical")
    # of several sources with one path the first by name comes first, as if they were merged one after the other
    first = F.row_number().over(W.partitionBy("place", "canonical", "rel").orderBy("name"))
    ranked = sources.withColumn("turn", first)
    keys = ["place", "canonical", "rel"]
    earlier = ranked.where("turn = 1").select(*keys, "size", "digest", "pixels")
    there = targets.select(*keys, "size", "digest", "pixels")
    held = there.unionByName(earlier.join(there, keys, "left_anti"))
    now = merge_plan(ranked.where("turn = 1"), there, keys).select(*keys, "action").join(ranked.where("turn = 1"), keys)
    then = merge_plan(ranked.where("turn > 1"), held, [*keys, "turn"], keys).select(*keys, "turn", "action").join(ranked.where("turn > 1"), [*keys, "turn"])
    planned = now.unionByName(then)
    both = free_suffixes(planned.where("action = 'KEEP BOTH'").withColumn("stem", F.concat_ws("/", "place", "canonical", "below", "filename")), "root", "stem")
    stem, ext = F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 2)
    renamed = both.withColumn("to_name", F.concat(stem, "suffix", ext)).drop("suffix", "stem")
    out = planned.where("action <> 'KEEP BOTH'").withColumn("to_name", F.when(F.col("action").isin(*MOVING), F.col("filename"))).unionByName(renamed)
    to_dir = F.when(F.col("to_name").isNotNull(), _joined(F.col("parent"), F.col("canonical"), F.col("below")))
    return out.select("root", "dir", "filename", to_dir.alias("to_dir"), "to_name", "action")


def display_names(listing: DataFrame) -> DataFrame:
    """The actions that give sound files and the folders on their way their display forms, in the columns of `merge_folders`.

    RENAME where the form differs and is free; RETAIN where another file has that name, or would get it first by name;
    SKIP where the form is no legal name. Extensions stay as they are; hidden files and folders are left alone.
    """
    stem, ext = F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 2)
    parts = folders(F.col("dir"))
    hidden = F.startswith("filename", F.lit(".")) | F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    formed = listing.where(is_audio(F.col("filename")) & ~hidden).select(
        "root", "dir", "filename", F.array_join(F.transform(parts, rendered), "/").alias("to_dir"), F.concat(rendered(stem), ext).alias("to_name"), F.forall(F.transform(parts, rendered), legal_name).alias("sound")
    )
    changed = formed.where("dir <> to_dir or filename <> to_name")
    turn = F.row_number().over(W.partitionBy("root", "to_dir", "to_name").orderBy("dir", "filename"))
    there = listing.select("root", F.col("dir").alias("to_dir"), F.col("filename").alias("to_name"), F.lit(True).alias("taken"))
    met = changed.withColumn("turn", turn).join(there, ["root", "to_dir", "to_name"], "left")
    action = F.when(~(F.col("sound") & legal_name(F.col("to_name"))), "SKIP").when(F.col("taken") | (F.col("turn") > 1), "RETAIN").otherwise("RENAME")
    return met.withColumn("action", action).select("root", "dir", "filename", "to_dir", "to_name", "action")


def after(listing: DataFrame, actions: DataFrame) -> DataFrame:
    """The listing as the actions leave it."""
    path = ["root", "dir", "filename"]
    told = actions.where(~F.col("action").isin("RETAIN", "SKIP"))
    stays = listing.join(told.select(*path), path, "left_anti")
    moved = listing.join(told.where("to_name is not null"), path)
    replaced = moved.where("action = 'REPLACE IMAGE'").select("root", F.col("to_dir").alias("dir"), F.col("to_name").alias("filename"))
    columns = [F.col("to_dir").alias("dir") if c == "dir" else F.col("to_name").alias("filename") if c == "filename" else F.col(c) for c in COLUMNS]
    return stays.select(*COLUMNS).join(replaced, path, "left_anti").unionByName(moved.select(*columns))


def clean_plan(listing: DataFrame) -> DataFrame:
    """All actions that clean a tree, with their pass: 1 artists' folders, 2 albums' folders, 3 names.

    listing: one row per file, of the columns in COLUMNS. Planning again after the actions gives none.
    """
    start = checkpoint(listing.select(*COLUMNS))
    one = checkpoint(merge_folders(start, 1))
    between = checkpoint(after(start, one))
    two = checkpoint(merge_folders(between, 2))
    three = checkpoint(display_names(checkpoint(after(between, two))))
    return one.withColumn("pass", F.lit(1)).unionByName(two.withColumn("pass", F.lit(2))).unionByName(three.withColumn("pass", F.lit(3)))
