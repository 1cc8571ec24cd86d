"""Paths and what they tell: slots of a layout, strays, places of album folders."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_LAYOUT = "{artist}/{album}"
# What folders that hold one disc of an album are called, before its number.
DISC_WORDS = ("cd", "disc", "disk", "dvd", "side", "vinyl")
# Extensions that are routine in an album folder.
SIDECARS = (".log", ".lrc", ".m3u", ".m3u8", ".pls", ".wpl", ".asx", ".cue", ".txt", ".nfo", ".url", ".csv", ".accurip", ".md5", ".sfv", ".xml", ".json", ".ini", ".db")
IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp")


def layout_slots(layout: str = DEFAULT_LAYOUT) -> dict[str, int]:
    """The place, from 1, of each slot of a layout."""
    levels = PurePosixPath(layout.replace("\\", "/")).relative_to("/" if layout[:1] in ("/", "\\") else "").parts
    return {level.casefold().removeprefix("{").removesuffix("}"): depth for depth, level in enumerate(levels, 1)}


def layout_depths(layout: str = DEFAULT_LAYOUT) -> tuple[int, int]:
    """The depth of artist and album folders. ValueError if the layout has no such slot."""
    slots = layout_slots(layout)
    if "artist" not in slots or "album" not in slots:
        raise ValueError(f"layout {layout!r} must name {{artist}} and {{album}}")
    return slots["artist"], slots["album"]


def folders(directory: Column) -> Column:
    """The components of a relative folder, empty ones left out."""
    return F.filter(F.split(directory, "/"), lambda p: p != "")


def slot(directory: Column, name: str, layout: str = DEFAULT_LAYOUT) -> Column:
    """The part of a relative folder that fills a slot; null if the path is too short or the layout has no such slot."""
    place = layout_slots(layout).get(name)
    return F.lit(None).cast("string") if place is None else F.try_element_at(folders(directory), F.lit(place))


def stray_class(path: Column, artist_depth: int, album_depth: int) -> Column:
    """How a file sits in the tree, by its path below the root: hidden, loose, placed or wrong-depth."""
    parts = folders(path)
    depth = F.size(parts) - 1
    return (
        F.when(F.exists(parts, lambda p: F.startswith(p, F.lit("."))), "hidden").when(depth == artist_depth, "loose").when(depth >= album_depth, "placed").otherwise("wrong-depth")
    )


def is_unknown_sidecar(ext: Column) -> Column:
    """Whether a file that is no audio has an extension nobody expects in an album folder."""
    return ~ext.isin(*SIDECARS, *IMAGES)


def is_disc(name: Column) -> Column:
    """Whether a folder's name is one of DISC_WORDS and a number, white space, dots, dashes and lines between aside."""
    word = F.rtrim(F.translate(F.regexp_extract(F.lower(name), r"^(.*?)[0-9]+$", 1), "\t\n\u000b\f\r._-", " " * 8))
    return F.coalesce(word.isin(*DISC_WORDS), F.lit(False))


def place(directory: Column, staging: str | None = None) -> Column:
    """How a folder of audio maps to the genre/artist/album tree, by its path below the root.

    A struct of kind (album, organized, loose, toodeep, staged-toodeep, skip), genre, artist, album, depth, unit. Disc
    folders belong to the album above them, which is the unit that moves; a leading staging folder does not count.
    """
    whole = folders(directory)
    staged = (F.try_element_at(whole, F.lit(1)) == F.lit(staging)) if staging else F.lit(False)
    staged = F.coalesce(staged, F.lit(False))
    parts = F.when(staged, F.slice(whole, 2, 1 << 30)).otherwise(whole)
    n = F.size(parts)
    at = lambda i: F.try_element_at(parts, F.lit(i))
    disc = lambda i: is_disc(at(i))
    flat = (n == 2) | ((n == 3) & disc(3))
    organized = ~staged & ((n == 3) | ((n == 4) & disc(4))) & ~flat
    kind = F.when(n == 0, "skip").when(n == 1, "loose").when(flat, "album").when(staged, "staged-toodeep").when(organized, "organized").otherwise("toodeep")
    above = F.array_join(F.slice(whole, F.lit(1), F.greatest(F.size(whole) - 1, F.lit(0))), "/")
    return F.struct(
        kind.alias("kind"),
        F.when(organized, at(1)).alias("genre"),
        F.when(organized, at(2)).when(flat | (n == 1), at(1)).alias("artist"),
        F.when(organized, at(3)).when(flat, at(2)).alias("album"),
        n.alias("depth"),
        F.when((flat & (n == 3)) | (organized & (n == 4)), above).otherwise(F.array_join(whole, "/")).alias("unit"),
    )


def ancestors(directory: Column) -> Column:
    """Every folder above a relative folder, the nearest last."""
    parts = folders(directory)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(i < F.size(parts), F.array_join(F.slice(parts, F.lit(1), i), "/")))
