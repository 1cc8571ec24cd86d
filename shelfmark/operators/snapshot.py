"""The difference of two states of a library, renames recognised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TAGS = ("track", "rating", "genre", "year", "rg")


def moves(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Files that vanished at one path and appeared at another with the same size and time: old_path, new_path.

    Equal signatures are paired one to one, both sides in the order of their paths; the order needs one number per row
    within its signature.
    """
    signature = ["size", "mtime"]
    number = F.row_number().over(W.partitionBy(*signature).orderBy("path"))
    gone = baseline.join(current.select("path"), "path", "left_anti").select("path", *signature, number.alias("k"))
    fresh = current.join(baseline.select("path"), "path", "left_anti").select("path", *signature, number.alias("k"))
    return gone.select(F.col("path").alias("old_path"), *signature, "k").join(fresh.select(F.col("path").alias("new_path"), *signature, "k"), [*signature, "k"]).select("old_path", "new_path")


def diff(baseline: DataFrame, current: DataFrame, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """kind (MOVED, RETAGGED, RESIZED, ADDED, REMOVED), path, detail; one row per change, paths unique in each state.

    A changed tag wins over a changed size; a changed time alone is no change, and a moved file is not looked into.
    """
    old = baseline.select("path", F.col("size").alias("old_size"), *(F.col(t).alias(f"old_{t}") for t in tags), F.lit(True).alias("was"))
    new = current.select("path", F.col("size").alias("new_size"), *(F.col(t).alias(f"new_{t}") for t in tags), F.lit(True).alias("is"))
    both = old.join(new, "path", "full_outer")
    moved = moves(baseline, current)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"old_{t}").eqNullSafe(F.col(f"new_{t}")), F.concat(F.lit(f"{t} "), shown(f"old_{t}"), F.lit(" -> "), shown(f"new_{t}"))) for t in tags)))
    kind = (
        F.when(F.col("is").isNull(), "REMOVED").when(F.col("was").isNull(), "ADDED").when(F.size(changed) > 0, "RETAGGED").when(~F.col("old_size").eqNullSafe(F.col("new_size")), "RESIZED")
    )
    detail = F.when(F.col("was") & F.col("is"), F.when(F.size(changed) > 0, F.array_join(changed, "; ")).otherwise(F.concat(shown("old_size"), F.lit(" -> "), shown("new_size")))).otherwise("")
    left = both.select(kind.alias("kind"), "path", detail.alias("detail")).where("kind is not null")
    paired = moved.select(F.col("old_path").alias("path"), F.lit("REMOVED").alias("kind")).unionByName(moved.select(F.col("new_path").alias("path"), F.lit("ADDED").alias("kind")))
    rest = left.join(paired, ["kind", "path"], "left_anti").select("kind", "path", "detail")
    return moved.select(F.lit("MOVED").alias("kind"), F.col("old_path").alias("path"), F.col("new_path").alias("detail")).unionByName(rest)
