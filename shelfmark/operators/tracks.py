"""Rows of tracks from what files hold: raw tags decoded into the columns that every report works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import decode

# Fixed value: the owner of the rating that one player writes, which goes before all others.
FIRST_RATER = "popm:windows media player 9 series"


def _first(tags: Column, *keys: str) -> Column:
    return F.coalesce(*(decode.tag_value(F.try_element_at(tags, F.lit(k))) for k in keys))


def rating_of(tags: Column) -> Column:
    """Stars of a map of tags: the first rater's byte even if it is nought, else the first byte above nought, else the
    best of the other rating tags."""
    entries = F.transform(F.map_entries(tags), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.try_element_at(e["value"], F.lit(1)).alias("value")))
    bytes_ = F.filter(entries, lambda e: F.startswith(e["key"], F.lit("popm:")))
    first = F.try_element_at(F.filter(bytes_, lambda e: e["key"] == FIRST_RATER), F.lit(1))["value"]
    other = F.try_element_at(F.filter(bytes_, lambda e: e["value"].try_cast("int") > 0), F.lit(1))["value"]
    named = F.filter(entries, lambda e: decode.is_rating_key(e["key"], "vorbis") & ~F.startswith(e["key"], F.lit("popm:")))
    return F.coalesce(decode.stars_of_byte(first), decode.stars_of_byte(other), decode.best_rating(named))


def decoded_tracks(contents: DataFrame) -> DataFrame:
    """`contents` (with raw_tags, null for a file without tags) and its columns title, artist, album, genre, trackno,
    year, rating, has_track_gain, has_album_gain."""
    tags = F.col("raw_tags")
    keys = F.coalesce(F.map_keys(tags), F.array().cast("array<string>"))
    columns = {
        "title": _first(tags, "title"),
        "artist": _first(tags, "artist"),
        "album": _first(tags, "album"),
        "genre": _first(tags, "genre"),
        "trackno": decode.track_number(_first(tags, "tracknumber", "track")),
        "year": decode.year_of(_first(tags, "date", "year")),
        "rating": rating_of(tags),
        "has_track_gain": decode.has_gain(keys, "track"),
        "has_album_gain": decode.has_gain(keys, "album"),
    }
    return contents.withColumns(columns)
