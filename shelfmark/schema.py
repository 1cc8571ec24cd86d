"""Schemas of the rows that the engine works on, and the roles that a table's columns play."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


#: One row per audio file: where it lies, and its tags.
TRACK = _struct(
    ("root", _S), ("dir", _S), ("filename", _S), ("ext", _S), ("size", _L), ("mtime", _L), ("title", _S), ("artist", _S), ("album", _S), ("genre", _S),
    ("trackno", _I), ("year", _I), ("bitrate_kbps", _I), ("rating", _D), ("duration_s", _D), ("has_track_gain", _B), ("has_album_gain", _B),
)
#: One row per file of any kind, as a listing finds it.
LISTED = _struct(("root", _S), ("dir", _S), ("filename", _S), ("ext", _S), ("size", _L), ("mtime", _L))
#: Tags as their container spells them.
RAW_TAGS = T.MapType(_S, T.ArrayType(_S))
#: A row of a snapshot.
SNAPSHOT = _struct(("path", _S), ("size", _L), ("mtime", _L), ("track", _I), ("rating", _D), ("genre", _S), ("year", _I), ("rg", _S))
#: The genre authority map.
AUTHORITY = _struct(("artist_norm", _S), ("display", _S), ("canonical", _S), ("allowed_norm", T.ArrayType(_S)))
#: A planned change of files.
ACTION = _struct(("src", _S), ("dst", _S), ("kind", _S), ("issue", _S))
#: Digests of a file's content.
FINGERPRINT = _struct(("path", _S), ("size", _L), ("full", _S), ("stream", _S), ("head", _S), ("tail", _S), ("error", _S))
#: What a decoder said about a file.
VERDICT = _struct(("path", _S), ("size", _L), ("tier", _S), ("reason", _S))
#: A lyrics lookup.
LYRICS = _struct(("path", _S), ("status", _S), ("detail", _S), ("content", _S))

AUDIO_EXTENSIONS = (".mp3", ".flac", ".ogg", ".opus", ".m4a", ".wav", ".wma", ".aac")
COVER_NAMES = tuple(f"{stem}.{ext}" for stem in ("cover", "folder", "front", "album") for ext in ("jpg", "jpeg", "png"))
#: The order in which formats are asked for embedded art.
ART_PRIORITY = (".flac", ".opus", ".ogg", ".m4a", ".mp3")


@dataclass(frozen=True)
class Roles:
    """Which column of a table plays which role; operators name columns only through this."""

    root: str = "root"
    dir: str = "dir"
    filename: str = "filename"
    ext: str = "ext"
    size: str = "size"
    title: str = "title"
    artist: str = "artist"
    album: str = "album"
    genre: str = "genre"
    trackno: str = "trackno"
    year: str = "year"
    bitrate: str = "bitrate_kbps"
    rating: str = "rating"
    duration: str = "duration_s"
    track_gain: str = "has_track_gain"
    album_gain: str = "has_album_gain"

    def but(self, **names: str) -> Roles:
        return replace(self, **names)

    @property
    def folder(self) -> list[str]:
        """The columns that name an album folder."""
        return [self.root, self.dir]


MUSIC = Roles()


def order_key(roles: Roles = MUSIC) -> Column:
    """The order of scanning: by root, folder and file name. It decides all ties."""
    return F.struct(roles.root, roles.dir, roles.filename)


def is_audio(filename: Column) -> Column:
    """Whether a file name has an audio extension; a leading dot begins no extension."""
    return extension(filename).isin(*AUDIO_EXTENSIONS)


def extension(filename: Column) -> Column:
    """The lower-case extension with its dot, or the empty string."""
    return F.lower(F.regexp_extract(filename, r"^\.*[^/]*?[^/.][^/]*?(\.[^./]*)$", 1))


def latest_delivery(df: DataFrame, key: str) -> DataFrame:
    """The latest delivery of every key, by `loaded_at`; null keys are one key, of equally late rows any one stays.

    The window keeps one row per key and task before it is shuffled.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("loaded_at")))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")
