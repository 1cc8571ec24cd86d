"""Tags written into the bytes of audio files: an ID3v2.4 tag before the sound, comments in the blocks of a FLAC file.

Both give new bytes and change no file; a committer replaces the file by them in one step.
"""

from __future__ import annotations

import os

from shelfmark.sources.binary import syncsafe
from shelfmark.sources.containers import id3_frames

# The frames of plain fields.
FRAMES = {"title": "TIT2", "artist": "TPE1", "album": "TALB", "genre": "TCON", "tracknumber": "TRCK", "date": "TDRC", "albumartist": "TPE2"}


def _seven_bits(n: int) -> bytes:
    return bytes((n >> shift) & 0x7F for shift in (21, 14, 7, 0))


def _frame(name: str, body: bytes) -> bytes:
    return name.encode("ascii") + _seven_bits(len(body)) + b"\x00\x00" + body


def id3_text(name: str, *values: str) -> bytes:
    return _frame(name, b"\x03" + "\x00".join(values).encode("utf-8"))


def id3_picture(data: bytes, mime: str, kind: int = 3) -> bytes:
    return _frame("APIC", b"\x03" + mime.encode("ascii") + b"\x00" + bytes([kind]) + b"\x00" + data)


def with_id3(data: bytes, fields: dict[str, str | None], pictures: list[tuple[bytes, str]] = (), drop: tuple[str, ...] = ()) -> bytes:
    """The bytes with some fields set in their ID3 tag, or removed (None); other frames stay, those in `drop` go.

    A tag of version 2.2 is left out: its frames have other names. Pictures replace those that are there.
    """
    size = syncsafe(data[6:10]) if data[:3] == b"ID3" and len(data) >= 10 else None
    kept = [] if size is None or data[3] == 2 else list(id3_frames(data))
    changed = {FRAMES.get(key, key) for key in fields} | set(drop) | ({"APIC"} if pictures else set())
    body = b"".join(_frame(name, frame) for name, frame in kept if name not in changed)
    body += b"".join(id3_text(FRAMES.get(key, key), value) for key, value in fields.items() if value is not None)
    body += b"".join(id3_picture(image, mime) for image, mime in pictures)
    sound = data if size is None else data[10 + size + (10 if data[5] & 0x10 else 0) :]
    return b"ID3\x04\x00\x00" + _seven_bits(len(body)) + body + sound if body else sound


def with_comments(data: bytes, fields: dict[str, str | None]) -> bytes:
    """The bytes of a FLAC file with its comments replaced by some fields; other blocks stay. ValueError for other files."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC file")
    blocks, at, last = [], 4, False
    while not last and at + 4 <= len(data):
        kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4])
        last = bool(data[at] & 0x80)
        blocks.append((kind, data[at + 4 : at + 4 + size]))
        at += 4 + size
    entries = [f"{key.upper()}={value}".encode() for key, value in fields.items() if value is not None]
    count = len(entries).to_bytes(4, "little")
    comments = (0).to_bytes(4, "little") + count + b"".join(len(e).to_bytes(4, "little") + e for e in entries)
    blocks = [b for b in blocks if b[0] != 4] + [(4, comments)]
    out = b"fLaC"
    for i, (kind, body) in enumerate(blocks):
        out += bytes([kind | (0x80 if i == len(blocks) - 1 else 0)]) + len(body).to_bytes(3) + body
    return out + data[at:]


def replace_file(path: str, data: bytes) -> None:
    """Put new bytes in place of a file in one step: written beside it, flushed, then renamed over it."""
    beside = f"{path}.shelfmark"
    with open(beside, "wb") as file:
        file.write(data)
        file.flush()
        os.fsync(file.fileno())
    os.replace(beside, path)
