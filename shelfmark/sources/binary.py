"""What the bytes of audio and image files tell: image sizes, the region of sound, fingerprints, raw tags, tags."""

from __future__ import annotations

import hashlib
import mmap
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.schema import FINGERPRINT

EDGE = 64 << 10
CHUNK = 1 << 20


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height of a PNG or JPEG image; None for anything else or a broken header."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return (int.from_bytes(data[16:20]), int.from_bytes(data[20:24])) if data[12:16] == b"IHDR" and len(data) >= 24 else None
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while (at := data.find(b"\xff", at)) >= 0 and at + 9 <= len(data):
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind in (0x00, 0x01, *range(0xD0, 0xD9)):  # a stuffed byte, or a marker without a length
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
        else:
            length = int.from_bytes(data[at + 2 : at + 4])
            if length < 2:
                return None
            at += 2 + length
    return None


def syncsafe(data: bytes) -> int | None:
    """A number of seven bits per byte; None if a byte has its eighth."""
    return None if any(b & 0x80 for b in data) else sum(b << 7 * i for i, b in enumerate(reversed(data)))


def trailing_tags(tail: bytes) -> int:
    """How many bytes at the end are ID3v1 and APEv2 tags, one of each at most."""
    end, size = len(tail), 0
    if end >= 128 and tail[end - 128 : end - 125] == b"TAG":
        size = 128
    at = end - size
    if at >= 32 and tail[at - 32 : at - 24] == b"APETAGEX":
        length = int.from_bytes(tail[at - 20 : at - 16], "little")
        header = 32 if int.from_bytes(tail[at - 12 : at - 8], "little") & 0x80000000 else 0
        if 32 <= length <= at:
            size += length + header
    return size


def audio_regions(data: bytes, ext: str) -> list[tuple[int, int]] | None:
    """Where the sound lies: start and end of each region; None where it cannot be told.

    MP3: after an ID3v2 tag, before trailing tags. FLAC: after the metadata blocks. M4A: the media boxes.
    """
    if ext == ".mp3":
        if data[:3] != b"ID3" or len(data) < 10:
            return None
        size = syncsafe(data[6:10])
        start = None if size is None else 10 + size + (10 if data[5] & 0x10 else 0)
        end = len(data) - trailing_tags(data)
        return [(start, end)] if start is not None and start < end else None
    if ext == ".flac":
        at = 4
        if data[:4] != b"fLaC":
            return None
        while at + 4 <= len(data):
            head, at = data[at : at + 4], at + 4 + int.from_bytes(data[at + 1 : at + 4])
            if head[0] & 0x80:
                return [(at, len(data))] if at < len(data) else None
        return None
    if ext == ".m4a":
        out, at = [], 0
        while at + 8 <= len(data):
            size, kind, head = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8], 8
            if size == 1:
                size, head = int.from_bytes(data[at + 8 : at + 16]), 16
            elif size == 0:
                size = len(data) - at
            if size < head or at + size > len(data):
                return None
            if kind == b"mdat":
                out.append((at + head, at + size))
            at += size
        return out or None
    return None


def ape_items(data: bytes) -> dict[str, bytes] | None:
    """The items of an APEv2 tag at the end of a file; None without one, or if its structure does not add up."""
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    foot = data[end - 32 : end]
    if end < 32 or foot[:8] != b"APETAGEX":
        return None
    length, count = int.from_bytes(foot[12:16], "little"), int.from_bytes(foot[16:20], "little")
    at, stop, out = end - length, end - 32, {}
    if at < 0 or length < 32:
        return None
    for _ in range(count):
        size = int.from_bytes(data[at : at + 4], "little")
        key, nul, _ = data[at + 8 : stop].partition(b"\x00")
        begin = at + 8 + len(key) + 1
        if not nul or begin + size > stop:
            return None
        out[key.decode("ascii", "replace")] = data[begin : begin + size]
        at = begin + size
    return out if at == stop else None


def _digest(view, *spans: tuple[int, int]) -> str:
    """The digest of some spans of a file, read in chunks."""
    made = hashlib.sha256()
    for start, end in spans:
        for at in range(start, end, CHUNK):
            made.update(view[at : min(at + CHUNK, end)])
    return made.hexdigest()


def prints(view, size: int, ext: str) -> dict:
    """Digests of the bytes of a file: of all, of the sound, of the first and last 64 KiB (trailing tags aside)."""
    regions = audio_regions(view, ext)
    body = size - trailing_tags(view)
    return {
        "size": size, "full": _digest(view, (0, size)), "head": _digest(view, (0, min(EDGE, size))), "tail": _digest(view, (max(0, body - EDGE), body)),
        "stream": _digest(view, *regions) if regions else None, "error": None,
    }


def mapped(path: str):
    """A view of a file's bytes that is read as it is used. OSError if the file cannot be opened."""
    with open(path, "rb") as file:
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(file.fileno()).st_size else b""


def fingerprint(path: str) -> dict:
    """FINGERPRINT of a file, which is mapped and read in chunks, so that its size does not matter to the memory."""
    try:
        view = mapped(path)
    except OSError as error:
        return {"path": path, "size": None, "full": None, "stream": None, "head": None, "tail": None, "error": str(error)}
    return {"path": path} | prints(view, len(view), os.path.splitext(path)[1].lower())


def fingerprints_of(files: DataFrame, path: str, content: str, ext: str) -> DataFrame:
    """FINGERPRINT rows of contents at hand, as a table of files that were read whole; null contents give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p} | prints(c, len(c), e) for p, c, e in zip(batch["p"], batch["c"], batch["e"])]
            yield pd.DataFrame(rows, columns=[f.name for f in FINGERPRINT])

    held = files.select(F.col(path).cast("string").alias("p"), F.col(content).alias("c"), F.col(ext).alias("e")).where("c is not null")
    return held.mapInPandas(run, FINGERPRINT)


def head_tail_equal(one: str, other: str) -> bool:
    """Whether two files agree in size and in their first and last 64 KiB; False if one cannot be read."""
    try:
        sizes = os.path.getsize(one), os.path.getsize(other)
        if sizes[0] != sizes[1]:
            return False
        with open(one, "rb") as a, open(other, "rb") as b:
            for at in (0, max(0, sizes[0] - EDGE)):
                a.seek(at)
                b.seek(at)
                if a.read(EDGE) != b.read(EDGE):
                    return False
        return True
    except OSError:
        return False


def image_pixels(data: bytes | None) -> int | None:
    """Width times height of an image; None for what is none."""
    size = image_size(data)
    return size and size[0] * size[1]


def decoded(data: bytes) -> str:
    """What a tool printed: UTF-8, or Latin-1 where it is not."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def fingerprints(paths: DataFrame) -> DataFrame:
    """FINGERPRINT rows of a column `path`; each file is read where its task runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([fingerprint(p) for p in batch["path"]], columns=[f.name for f in FINGERPRINT])

    return paths.select("path").mapInPandas(run, FINGERPRINT)


CONTENTS = "path string, raw_tags map<string,array<string>>, frames array<string>, facts map<string,string>, art binary, art_mime string"


def _contents_row(path: str, view, ext: str) -> tuple:
    from shelfmark.sources.containers import front_cover, read_contents

    found = read_contents(view, ext)
    cover = front_cover(found.pictures)
    return path, found.tags, found.frames, found.facts, cover.data if cover else None, cover.mime if cover else None


def read_files(paths: DataFrame) -> DataFrame:
    """CONTENTS rows of a column `path`: tags, identifiers of ID3 frames, facts of the stream and the front cover.

    A file that cannot be read has nulls: it is a file without tags, not a failure. Each file is mapped where its task
    runs, so that only the parts that hold tags are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    rows.append(_contents_row(path, mapped(path), os.path.splitext(path)[1].lower()))
                except OSError:
                    rows.append((path, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "raw_tags", "frames", "facts", "art", "art_mime"])

    return paths.select("path").mapInPandas(run, CONTENTS)


def read_bytes(files: DataFrame, path: str, content: str, ext: str) -> DataFrame:
    """`read_files` of contents at hand; null contents give nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_contents_row(p, c, e) if c is not None else (p, None, None, None, None, None) for p, c, e in zip(batch["p"], batch["c"], batch["e"])]
            yield pd.DataFrame(rows, columns=["path", "raw_tags", "frames", "facts", "art", "art_mime"])

    return files.select(F.col(path).cast("string").alias("p"), F.col(content).alias("c"), F.col(ext).alias("e")).mapInPandas(run, CONTENTS)


def read_tags(paths: DataFrame) -> DataFrame:
    """path and raw_tags (key to values) of audio files; a file that cannot be read has a null map."""
    return read_files(paths).select("path", "raw_tags")
