"""Values as reports show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_decimal(value: Column) -> Column:
    """A number with one decimal, ties to even."""
    return F.format_string("%.1f", F.bround(value, 1))


def stars_text(rating: Column) -> Column:
    """A rating as five glyphs and a number, with a space before; the empty text for none."""
    full = rating.cast("int")
    half = F.when(rating - full >= 0.5, 1).otherwise(0)
    return F.when(rating.isNull(), "").otherwise(F.concat(F.lit(" ["), F.repeat(F.lit("★"), full), F.repeat(F.lit("☆"), half), F.repeat(F.lit("☆"), 5 - full - half), F.lit(" "), one_decimal(rating), F.lit("/5]")))


def size_text(size: Column) -> Column:
    """A number of bytes, one decimal from KB on."""
    f = size.cast("double")
    return F.when(f < 1024, F.format_string("%d B", size.cast("bigint"))).when(f < 1024**2, F.format_string("%.1f KB", f / 1024)).when(f < 1024**3, F.format_string("%.1f MB", f / 1024**2)).otherwise(F.format_string("%.1f GB", f / 1024**3))


def total_size_text(size: Column) -> Column:
    """A number of bytes as the statistics show it: two decimals for GB."""
    f = size.cast("double")
    return F.when(f < 1024, F.format_string("%d B", size.cast("bigint"))).when(f < 1024**2, F.format_string("%.1f KB", f / 1024)).when(f < 1024**3, F.format_string("%.1f MB", f / 1024**2)).otherwise(F.format_string("%.2f GB", f / 1024**3))


def duration_text(seconds: Column) -> Column:
    """Minutes and seconds; dashes for none."""
    s = seconds.cast("bigint")
    return F.when(F.coalesce(seconds, F.lit(0.0)) == 0, "--:--").otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def song_title(filename: Column) -> Column:
    """A file name as a song's name: `NN. title` if it holds a number, without extension and prefix."""
    stem = F.trim(F.regexp_replace(F.regexp_replace(filename, r"(?<=[^.])\.[^.]*$", ""), r"^[^\-0-9]*-\s*", ""))
    numbered = r"^(?:[0-9]+\s*[-–—]\s*)?([0-9]+)\.?\s*[-–—]?\s*(.+)$"
    track = r"^[Tt]rack\s*([0-9]+)\.?\s*[-–—]?\s*(.+)$"
    shown = lambda p: F.concat(F.lpad(F.regexp_extract(stem, p, 1), F.greatest(F.length(F.regexp_extract(stem, p, 1)), F.lit(2)), F.lit("0")), F.lit(". "), F.trim(F.regexp_extract(stem, p, 2)))
    return F.when(stem.rlike(numbered), shown(numbered)).when(stem.rlike(track), shown(track)).otherwise(stem)


def escaped_cell(value: Column) -> Column:
    """A value in a tab-separated line: backslash, tab and line feed written as escapes."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def unescaped_cell(value: Column) -> Column:
    """The inverse of `escaped_cell`, escapes read from the left so that it is one."""
    held = F.replace(value, F.lit("\\\\"), F.lit("﷐"))
    return F.replace(F.replace(F.replace(held, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("﷐"), F.lit("\\"))
