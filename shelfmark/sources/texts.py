"""Text formats of the catalogue: snapshots, genre maps, manifests, scan tables; read to and written from rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.normalize import name_key, tsv_field
from shelfmark.functions.render import escaped_cell, unescaped_cell

# The first lines of a snapshot, whoever wrote it, and what makes a line of a genre map a comment.
SNAPSHOT_VERSION = "# shelfmark snapshot v1"
ANY_VERSION = r"^# \S+ snapshot v1$"
SNAPSHOT_HEADER = "path\tsize\tmtime\ttrack\trating\tgenre\tyear\trg"
MAP_COMMENT = r"^\s*#(?:\s|-|$)"


class NotASnapshot(ValueError):
    """A text without the header of a snapshot."""


def snapshot_lines(rows: DataFrame) -> DataFrame:
    """SNAPSHOT rows as lines: path, line."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rating = F.coalesce(F.format_string("%.2f", "rating"), F.lit(""))
    rating = F.when(F.col("rating").isNull(), "").otherwise(rating)
    line = F.concat_ws("\t", escaped_cell(F.col("path")), cell("size"), cell("mtime"), cell("track"), rating, escaped_cell(cell("genre")), cell("year"), cell("rg"))
    return rows.select("path", line.alias("line"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a snapshot file. NotASnapshot if the header is missing; lines of another number of cells are skipped."""
    lines = spark.read.text(path)
    head = [r[0] for r in lines.limit(2).collect()]
    if len(head) < 2 or not re.match(ANY_VERSION, head[0]) or head[1] != SNAPSHOT_HEADER:
        raise NotASnapshot(path)
    cells = F.split("value", "\t", -1)
    rows = lines.where((F.col("value") != SNAPSHOT_HEADER) & ~F.col("value").rlike(ANY_VERSION)).select(cells.alias("c")).where(F.size("c") == 8)
    blank = lambda i: F.when(F.col("c")[i] != "", unescaped_cell(F.col("c")[i]))
    return rows.select(
        unescaped_cell(F.col("c")[0]).alias("path"), blank(1).try_cast("bigint").alias("size"), blank(2).try_cast("bigint").alias("mtime"), blank(3).try_cast("int").alias("track"),
        blank(4).try_cast("double").alias("rating"), blank(5).alias("genre"), blank(6).try_cast("int").alias("year"), blank(7).alias("rg"),
    )


def parse_map(lines: DataFrame) -> DataFrame:
    """A genre map's lines (line_no, line) as entry_id, display, canonical, allowed_norm. Comments and blanks are none."""
    cells = F.transform(F.split("line", "\t"), lambda x: F.trim(x))
    data = lines.where(~F.col("line").rlike(MAP_COMMENT) & (F.trim("line") != "")).select("line_no", cells.alias("c")).where(F.col("c")[0] != "")
    genres = F.filter(F.slice("c", 2, 1 << 30), lambda g: g != "")
    return data.select(F.col("line_no").alias("entry_id"), F.col("c")[0].alias("display"), F.coalesce(F.try_element_at(genres, F.lit(1)), F.lit("")).alias("canonical"), F.transform(genres, name_key).alias("allowed_norm"))


def map_lines(built: DataFrame) -> DataFrame:
    """The lines of a genre map from `build_map` rows: display, line. Compilations are comments."""
    genres = F.split("genres", "\t")
    line = F.when(F.col("excluded"), F.concat(F.lit("# "), tsv_field(F.col("display")), F.lit(": EXCLUDED (compilation)"))).otherwise(
        F.concat_ws("\t", tsv_field(F.col("display")), F.when(F.col("n_genres") > 0, F.array_join(F.transform(genres, tsv_field), "\t")))
    )
    return built.select("display", line.alias("line"))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """A manifest's lines (line_no, line) as line, src, dst, at."""
    cells = F.split("line", "\t")
    data = lines.where(~F.startswith("line", F.lit("#")) & (F.trim("line") != "")).select(F.col("line_no").alias("line"), cells.alias("c")).where(F.size("c") >= 2)
    return data.select("line", F.col("c")[0].alias("src"), F.col("c")[1].alias("dst"), F.try_element_at("c", F.lit(3)).alias("at"))


def parse_loudness(lines: DataFrame, group: list[str]) -> DataFrame:
    """A scan table (group, line_no, line) as group, filename, loudness, clipping, is_album; columns go by the header."""
    cells = F.split("line", "\t")
    rows = lines.where(F.trim("line") != "").select(*group, "line_no", cells.alias("c"))
    first = rows.groupBy(*group).agg(F.min_by("c", "line_no").alias("h"), F.min("line_no").alias("head_no"))
    at = lambda name: F.array_position(F.transform("h", lambda x: F.contains(F.lower(x), F.lit(name))), F.lit(True))
    cell = lambda name: F.when(at(name) > 0, F.try_element_at("c", at(name).cast("int")))
    body = rows.join(first, group).where("line_no <> head_no")
    return body.select(*group, cell("filename").alias("filename"), cell("loudness").try_cast("double").alias("loudness"), F.coalesce(F.upper(cell("clipping")).isin("Y", "YES", "1"), F.lit(False)).alias("clipping"), (cell("filename") == "Album").alias("is_album"))


def write_lines(df: DataFrame, path: str, order: list[str], header: list[str] | None = None) -> None:
    """Write the column `line` as text in the order of some columns, the header first.

    The lines are sorted by range, so that every task writes one numbered part; the parts in the order of their names
    are the report. A small report is a single part.
    """
    body = df.select(F.lit(len(header or [])).alias("_k"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), "line")
    heads = df.sparkSession.createDataFrame(list(enumerate(header or [])), "_k int, line string")
    out = body.unionByName(heads, allowMissingColumns=True)
    out.orderBy("_k", *(f"_o{i}" for i in range(len(order)))).select("line").write.mode("overwrite").text(path)
