"""Tags, pictures and stream facts read from the bytes of audio files: ID3, FLAC and Ogg comments, MP4, ASF, APE.

Every reader takes a view of the bytes (bytes or a mapped file), touches the parts it needs and gives what it could read
until something did not add up; broken files have fewer tags, they are no failures. Keys are lower case.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterator
from dataclasses import dataclass, field

from shelfmark.sources.binary import ape_items, syncsafe

# The keys of MP4 boxes and of ASF attributes under which tags are known elsewhere.
MP4_NAMES = {"\xa9nam": "title", "\xa9art": "artist", "\xa9alb": "album", "\xa9gen": "genre", "\xa9day": "date", "aart": "albumartist", "\xa9wrt": "composer", "rtng": "advisory", "rate": "rating"}
ASF_NAMES = {"wm/albumtitle": "album", "wm/genre": "genre", "wm/tracknumber": "tracknumber", "wm/year": "date", "wm/shareduserrating": "rating", "wm/albumartist": "albumartist", "author": "artist"}
ID3_NAMES = {"tit2": "title", "tpe1": "artist", "talb": "album", "tcon": "genre", "trck": "tracknumber", "tdrc": "date", "tyer": "date", "tpe2": "albumartist", "tt2": "title", "tp1": "artist", "tal": "album", "tco": "genre", "trk": "tracknumber", "tye": "date"}
# Text encodings of ID3 frames, by their first byte.
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
ASF_HEADER = bytes.fromhex("3026b2758e66cf11a6d900aa0062ce6c")
ASF_PLAIN = bytes.fromhex("3326b2758e66cf11a6d900aa0062ce6c")
ASF_EXTENDED = bytes.fromhex("40a4d0d207e3d21197f000a0c95ea850")
# Bit rates (kbit/s) of layer III by version, sample rates by version, and channel modes.
MP3_KBPS = {1: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MP3_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
MP3_MODES = ("stereo", "joint stereo", "dual channel", "mono")
FRONT_COVER = 3


@dataclass
class Picture:
    kind: int
    mime: str
    data: bytes


@dataclass
class Contents:
    """tags: key to values; frames: the identifiers of ID3 frames as they stand; pictures; facts: numbers of the stream."""

    tags: dict[str, list[str]] = field(default_factory=dict)
    frames: list[str] = field(default_factory=list)
    pictures: list[Picture] = field(default_factory=list)
    facts: dict[str, str] = field(default_factory=dict)

    def add(self, key: str, *values: str) -> None:
        kept = [v for v in values if v != ""]
        if kept:
            self.tags.setdefault(key.lower(), []).extend(kept)


def _texts(body: bytes) -> list[str]:
    """The values of a text frame: parts between nulls."""
    if not body or body[0] >= len(ENCODINGS):
        return []
    values = body[1:].decode(ENCODINGS[body[0]], "replace").rstrip("\x00").split("\x00")
    return [v.removeprefix("\ufeff") for v in values] if body[0] == 1 else values


def _until_null(body: bytes, encoding: int) -> tuple[bytes, bytes]:
    """A string up to its null, and what follows."""
    if encoding in (1, 2):
        at = next((i for i in range(0, len(body) - 1, 2) if body[i : i + 2] == b"\x00\x00"), len(body))
        return body[:at], body[at + 2 :]
    head, _, rest = body.partition(b"\x00")
    return head, rest


def id3_frames(view) -> Iterator[tuple[str, bytes]]:
    """The frames of an ID3v2 tag at the start, as (identifier, body)."""
    if view[:3] != b"ID3" or (size := syncsafe(view[6:10])) is None:
        return
    version, flags = view[3], view[5]
    body = bytes(view[10 : 10 + size])
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and version >= 3:  # an extended header
        at = (syncsafe(body[:4]) or 0) if version == 4 else 4 + int.from_bytes(body[:4])
    head = 6 if version == 2 else 10
    while at + head <= len(body):
        name = body[at : at + (3 if version == 2 else 4)]
        if not name.strip(b"\x00") or not name.isalnum():
            return
        raw = body[at + 3 : at + 6] if version == 2 else body[at + 4 : at + 8]
        length = syncsafe(raw) if version == 4 else int.from_bytes(raw)
        if length is None or at + head + length > len(body):
            return
        frame = body[at + head : at + head + length]
        if version == 4 and body[at + 9] & 0x02:
            frame = frame.replace(b"\xff\x00", b"\xff")
        if version == 4 and body[at + 9] & 0x01:
            frame = frame[4:]
        yield name.decode("ascii"), frame
        at += head + length


def _read_id3(view, out: Contents) -> None:
    for name, body in id3_frames(view):
        out.frames.append(name)
        key = name.lower()
        if name in ("TXXX", "TXX") and body:
            label, value = _until_null(body[1:], body[0])
            out.add(_texts(body[:1] + label)[0] if label else "txxx", *_texts(body[:1] + value))
        elif key.startswith("t"):
            out.add(ID3_NAMES.get(key, key), *_texts(body))
        elif name in ("POPM", "POP"):
            who, rest = _until_null(body, 0)
            if rest:
                out.add(f"popm:{who.decode('latin-1')}", str(rest[0]))
        elif name == "APIC" and body:
            mime, rest = _until_null(body[1:], 0)
            _, data = _until_null(rest[1:], body[0])
            if rest:
                out.pictures.append(Picture(rest[0], mime.decode("latin-1"), data))
        elif name == "PIC" and len(body) > 5:
            _, data = _until_null(body[5:], body[0])
            out.pictures.append(Picture(body[4], f"image/{body[1:4].decode('latin-1').lower()}", data))


def _read_comments(block: bytes, out: Contents) -> None:
    """A block of Vorbis comments."""
    at = 4 + int.from_bytes(block[:4], "little")
    count, at = int.from_bytes(block[at : at + 4], "little"), at + 4
    for _ in range(count):
        size = int.from_bytes(block[at : at + 4], "little")
        if at + 4 + size > len(block):
            return
        key, equals, value = block[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        at += 4 + size
        if key.upper() == "METADATA_BLOCK_PICTURE":
            try:
                _read_picture(base64.b64decode(value), out)
            except (binascii.Error, ValueError):
                continue
        elif equals:
            out.add(key, value)


def _read_picture(block: bytes, out: Contents) -> None:
    """A picture block, as FLAC has them."""
    mime_at = 8
    mime = block[mime_at : mime_at + int.from_bytes(block[4:8])]
    at = mime_at + len(mime)
    at += 4 + int.from_bytes(block[at : at + 4]) + 16
    size = int.from_bytes(block[at : at + 4])
    data = block[at + 4 : at + 4 + size]
    if size and len(data) == size:
        out.pictures.append(Picture(int.from_bytes(block[:4]), mime.decode("latin-1"), data))


def _read_flac(view, out: Contents) -> None:
    at = 4
    while at + 4 <= len(view):
        kind, size = view[at], int.from_bytes(view[at + 1 : at + 4])
        block = bytes(view[at + 4 : at + 4 + size])
        if kind & 0x7F == 0 and size >= 18:
            packed = int.from_bytes(block[10:18])
            out.facts |= {"sample_rate": str(packed >> 44), "samples": str(packed & (1 << 36) - 1)}
        elif kind & 0x7F == 4:
            _read_comments(block, out)
        elif kind & 0x7F == 6:
            _read_picture(block, out)
        at += 4 + size
        if kind & 0x80:
            return


def _read_ogg(view, out: Contents, most: int = 32 << 20) -> None:
    """The second packet of an Ogg stream holds the comments; it may lie on many pages."""
    packets, current, at, held = [], [], 0, 0
    while len(packets) < 2 and view[at : at + 4] == b"OggS" and held < most:
        lacing = view[at + 27 : at + 27 + view[at + 26]]
        body = at + 27 + len(lacing)
        for size in lacing:
            current.append(bytes(view[body : body + size]))
            body, held = body + size, held + size
            if size < 255:
                packets.append(b"".join(current))
                current = []
        at = body
    if len(packets) >= 2:
        for mark in (b"\x03vorbis", b"OpusTags"):
            if packets[1].startswith(mark):
                _read_comments(packets[1][len(mark) :], out)


def boxes(view, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """The boxes of an MP4 file between two places: name, start and end of what they hold."""
    at = start
    while at + 8 <= end:
        size, head = int.from_bytes(view[at : at + 4]), 8
        if size == 1:
            size, head = int.from_bytes(view[at + 8 : at + 16]), 16
        size = end - at if size == 0 else size
        if size < head or at + size > end:
            return
        yield bytes(view[at + 4 : at + 8]), at + head, at + size
        at += size


def _read_mp4(view, out: Contents) -> None:
    def inside(start: int, end: int, *path: bytes) -> Iterator[tuple[int, int]]:
        for name, a, b in boxes(view, start, end):
            if name == path[0]:
                a += 4 if name == b"meta" else 0
                yield from inside(a, b, *path[1:]) if len(path) > 1 else [(a, b)]

    for start, end in inside(0, len(view), b"moov", b"udta", b"meta", b"ilst"):
        for name, a, b in boxes(view, start, end):
            key = name.decode("latin-1").lower()
            label, values = key, []
            for part, c, d in boxes(view, a, b):
                if part == b"name":
                    label = bytes(view[c + 4 : d]).decode("utf-8", "replace")
                elif part == b"data":
                    kind, value = int.from_bytes(view[c : c + 4]), bytes(view[c + 8 : d])
                    if name == b"covr":
                        out.pictures.append(Picture(FRONT_COVER, "image/png" if kind == 14 else "image/jpeg", value))
                    elif name in (b"trkn", b"disk"):
                        values.append("/".join(str(int.from_bytes(value[i : i + 2])) for i in (2, 4) if i == 2 or any(value[i : i + 2])))
                    else:
                        values.append(value.decode("utf-8", "replace") if kind == 1 else str(int.from_bytes(value)))
            out.add({"trkn": "tracknumber", "disk": "discnumber"}.get(key) or MP4_NAMES.get(label, label), *values)


def _read_asf(view, out: Contents) -> None:
    wide = lambda data: data.decode("utf-16-le", "replace").rstrip("\x00")
    end = int.from_bytes(view[16:24], "little")
    at = 30
    while at + 24 <= min(end, len(view)):
        kind, size = bytes(view[at : at + 16]), int.from_bytes(view[at + 16 : at + 24], "little")
        if size < 24:
            return
        body = bytes(view[at + 24 : at + size])
        if kind == ASF_PLAIN:
            sizes = [int.from_bytes(body[i : i + 2], "little") for i in range(0, 10, 2)]
            place = 10
            for name, length in zip(("title", "artist", "copyright", "description", "plain rating"), sizes):
                out.add(name, wide(body[place : place + length]))
                place += length
        elif kind == ASF_EXTENDED:
            place = 2
            for _ in range(int.from_bytes(body[:2], "little")):
                length = int.from_bytes(body[place : place + 2], "little")
                name = wide(body[place + 2 : place + 2 + length]).lower()
                place += 2 + length
                what, length = int.from_bytes(body[place : place + 2], "little"), int.from_bytes(body[place + 2 : place + 4], "little")
                value = body[place + 4 : place + 4 + length]
                place += 4 + length
                if what == 0:
                    out.add(ASF_NAMES.get(name, name), wide(value))
                elif what in (2, 3, 4, 5):
                    out.add(ASF_NAMES.get(name, name), str(int.from_bytes(value, "little")))
        at += size


def _read_ape(view, out: Contents) -> None:
    for key, value in (ape_items(bytes(view[max(0, len(view) - (8 << 20)) :])) or {}).items():
        if not key.lower().startswith("cover art"):
            out.add(key, *value.decode("utf-8", "replace").split("\x00"))


def id3v1_genre(view) -> int | None:
    """The genre byte of an ID3v1 tag; None without one."""
    tail = view[len(view) - 128 :] if len(view) >= 128 else b""
    return tail[127] if tail[:3] == b"TAG" else None


def mp3_facts(view) -> dict[str, str]:
    """Bit rate, sample rate, channel mode and kind of variable rate, from the first frame of an MP3."""
    size = syncsafe(view[6:10]) if view[:3] == b"ID3" else None
    at = 0 if size is None else 10 + size
    window = bytes(view[at : at + (64 << 10)])
    for i in range(len(window) - 4):
        if window[i] != 0xFF or window[i + 1] & 0xE0 != 0xE0:
            continue
        version, layer, rate, freq = (window[i + 1] >> 3) & 3, (window[i + 1] >> 1) & 3, window[i + 2] >> 4, (window[i + 2] >> 2) & 3
        if version == 1 or layer != 1 or rate in (0, 15) or freq == 3:
            continue
        frame = window[i : i + 200]
        vbr = "VBR" if b"Xing" in frame or b"VBRI" in frame else "CBR"
        return {"bitrate_kbps": str(MP3_KBPS[1 if version == 3 else 2][rate - 1]), "sample_rate": str(MP3_RATES[version][freq]), "mode": MP3_MODES[window[i + 3] >> 6], "vbr_mode": vbr}
    return {}


def read_contents(view, ext: str) -> Contents:
    """What a file's bytes hold, by its first bytes; the extension decides only about MP3, which may begin with sound."""
    out = Contents()
    try:
        if view[:4] == b"fLaC":
            _read_flac(view, out)
        elif view[:4] == b"OggS":
            _read_ogg(view, out)
        elif view[4:8] == b"ftyp":
            _read_mp4(view, out)
        elif view[:16] == ASF_HEADER:
            _read_asf(view, out)
        elif view[:3] == b"ID3" or ext in (".mp3", ".aac"):
            _read_id3(view, out)
            if not out.tags:
                _read_ape(view, out)
            out.facts |= mp3_facts(view)
    except (IndexError, ValueError, OverflowError):
        pass  # what was read until here stands
    return out


def front_cover(pictures: list[Picture]) -> Picture | None:
    """The front cover, else the first picture."""
    return next((p for p in pictures if p.kind == FRONT_COVER), pictures[0] if pictures else None)
