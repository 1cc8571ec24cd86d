"""Planning moves of album folders into a genre/artist/album tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.functions.layout import place
from shelfmark.functions.normalize import path_component


def primary_genre(genre: str):
    """The first of several genres joined by semicolons or slashes, and the others: a struct of primary and ignored."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(genre), F.lit("")), "[;/]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.struct(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")).alias("primary"), F.array_join(F.slice(parts, 2, 1 << 30), "; ").alias("ignored"))


def plan_moves(albums: DataFrame, existing: DataFrame | None = None, allow_new_genre: bool = False, refile: bool = False, staging: str | None = None) -> DataFrame:
    """One row per album folder: src, dst, kind, issue. issue is null for a move that can be made; dst is null where
    nothing is planned.

    albums: dir (below the root) and genre. existing: a column dst of paths that are there already. Genres that name
    folders of the tree are its vocabulary; without any, every genre may make a folder. Of several sources with one
    destination the first by path moves; of several folders of one unit the first decides.
    """
    read = albums.select(F.col("dir").alias("path"), place(F.col("dir"), staging).alias("p"), primary_genre("genre").alias("g")).select("path", "p.*", F.col("g.primary").alias("tag"), F.col("g.ignored").alias("ignored"), path_component(F.col("g.primary")).alias("safe"))
    read = read.select("path", "kind", F.col("genre").alias("current"), "artist", "album", "depth", "unit", "tag", "ignored", "safe")
    vocabulary = read.where("kind = 'organized'").groupBy(F.lower("current").alias("folded")).agg(F.max("current").alias("known"))
    gated = F.lit(False) if allow_new_genre else F.lit(bool(vocabulary.limit(1).count()))
    joined = read.join(vocabulary, F.lower(read["safe"]) == vocabulary["folded"], "left")
    target = F.coalesce("known", "safe")
    same = (F.col("kind") == "organized") & (F.lower("safe") == F.lower("current"))
    issue = (
        F.when(F.col("kind") == "skip", "SKIP")
        .when(F.col("kind") == "toodeep", "TOO DEEP")
        .when(F.col("kind") == "staged-toodeep", "STAGED TOO DEEP")
        .when(F.col("tag") == "", "NO GENRE")
        .when(same, "IN PLACE")
        .when((F.col("kind") == "organized") & F.lit(not refile), "NOTE")
        .when(F.col("known").isNull() & gated, "UNKNOWN GENRE")
    )
    last = F.when(F.col("kind") == "loose", F.lit("Singles")).otherwise(F.col("album"))
    planned = joined.withColumn("issue", issue).withColumn("dst", F.when(F.col("issue").isNull(), F.concat_ws("/", target, "artist", last)))
    unsafe = F.concat(F.coalesce("unit", F.lit("")), F.coalesce("dst", F.lit(""))).rlike(r"[\t\n]")
    planned = planned.withColumn("issue", F.when(F.col("dst").isNotNull() & unsafe, "UNSAFE NAME").otherwise(F.col("issue")))
    # only folders that are to move compete for a unit or a destination; those that stay, most of them, meet no window
    settled, moving = planned.where("issue is not null"), planned.where("issue is null")
    of_unit = W.partitionBy("unit").orderBy("path", "dst")
    later = F.when(F.col("dst") == F.first("dst").over(of_unit), "SAME UNIT").otherwise("DISC GENRE MISMATCH")
    ranked = moving.withColumn("issue", F.when(F.row_number().over(of_unit) > 1, later))
    of_dst = W.partitionBy("dst").orderBy("path", "ignored")
    first = ranked.where("issue is null").withColumn("issue", F.when(F.row_number().over(of_dst) > 1, F.lit("COLLISION")))
    if existing is not None:
        there = existing.select(F.col("dst").alias("_there")).distinct()
        first = first.join(there, F.col("dst") == F.col("_there"), "left").withColumn("issue", F.when(F.col("issue").isNull() & F.col("_there").isNotNull(), "DEST EXISTS").otherwise(F.col("issue"))).drop("_there")
    planned = settled.unionByName(ranked.where("issue is not null")).unionByName(first)
    return planned.select(F.coalesce("unit", "path").alias("src"), "dst", "kind", "issue", "path", "ignored")


def revert(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """What undoing a manifest (line, src, dst) would do, given what exists (path): line, src, dst, outcome, in reverse
    order of lines: MISSING if the moved thing is gone, SRC EXISTS if its old place is taken, else MOVE BACK."""
    there = listing.select("path").distinct()
    joined = manifest.join(there.withColumnRenamed("path", "_d"), F.col("dst") == F.col("_d"), "left").join(there.withColumnRenamed("path", "_s"), F.col("src") == F.col("_s"), "left")
    outcome = F.when(F.col("_d").isNull(), "MISSING").when(F.col("_s").isNotNull(), "SRC EXISTS").otherwise("MOVE BACK")
    return joined.select("line", "src", "dst", outcome.alias("outcome")).orderBy(F.desc("line"))
