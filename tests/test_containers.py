"""Readers of containers on bytes built by hand, and tags written and read back."""

import base64

from shelfmark.sinks.tagbytes import replace_file, with_comments, with_id3
from shelfmark.sources.binary import decoded, fingerprint, fingerprints_of, head_tail_equal, image_pixels, image_size, read_files
from shelfmark.sources.containers import ASF_EXTENDED, ASF_HEADER, ASF_PLAIN, front_cover, id3v1_genre, mp3_facts, read_contents
from shelfmark.operators.tracks import decoded_tracks

PNG = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4) + b"IHDR" + (600).to_bytes(4) + (500).to_bytes(4)
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab" + b"junk" + b"\xff\xff\xc0\x00\x0b\x08" + (300).to_bytes(2) + (400).to_bytes(2) + b"\x01\x01\x11\x00"


def box(name, *parts):
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4) + name + body


def comments(*entries):
    return (0).to_bytes(4, "little") + len(entries).to_bytes(4, "little") + b"".join(len(e.encode()).to_bytes(4, "little") + e.encode() for e in entries)


def picture_block(data, kind=3):
    return kind.to_bytes(4) + (9).to_bytes(4) + b"image/png" + (0).to_bytes(4) + b"\x00" * 16 + len(data).to_bytes(4) + data


def ogg(*packets):
    out = b""
    for packet in packets:
        lacing = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
        out += b"OggS" + b"\x00" * 22 + bytes([len(lacing)]) + lacing + packet
    return out


def test_id3_of_every_version():
    v22 = b"ID3\x02\x00\x00" + bytes([0, 0, 0, 12]) + b"TT2" + (6).to_bytes(3) + b"\x00Title"
    assert read_contents(v22, ".mp3").tags == {"title": ["Title"]}
    text = b"\x01" + "Tïtle".encode("utf-16")
    v23 = b"ID3\x03\x00\x00" + bytes([0, 0, 0, 10 + len(text)]) + b"TIT2" + len(text).to_bytes(4) + b"\x00\x00" + text
    assert read_contents(v23 + b"x", ".mp3").tags == {"title": ["Tïtle"]}
    popm = b"a@b\x00\xc4\x00\x00\x00\x00"
    txxx = b"\x03Replaygain_Track_Gain\x00-3.2 dB"
    v24 = b"ID3\x04\x00\x00" + bytes([0, 0, 0, 20 + len(popm) + len(txxx)]) + b"POPM" + bytes([0, 0, 0, len(popm)]) + b"\x00\x00" + popm + b"TXXX" + bytes([0, 0, 0, len(txxx)]) + b"\x00\x00" + txxx
    found = read_contents(v24, ".mp3")
    assert found.tags == {"popm:a@b": ["196"], "replaygain_track_gain": ["-3.2 dB"]} and found.frames == ["POPM", "TXXX"]
    assert read_contents(b"ID3\x04\x00\x00\xff\xff\xff\xff", ".mp3").tags == {} and read_contents(b"", ".mp3").tags == {}


def test_flac_ogg_and_opus():
    info = b"\x00" * 10 + ((48000 << 44) + 96_000).to_bytes(8) + b"\x00" * 16
    plain = b"fLaC\x00" + len(info).to_bytes(3) + info + b"\x06" + len(picture_block(PNG)).to_bytes(3) + picture_block(PNG) + b"\x84" + len(comments("ARTIST=A", "artist=B", "bad")).to_bytes(3) + comments("ARTIST=A", "artist=B", "bad")
    found = read_contents(plain, ".flac")
    assert found.tags == {"artist": ["A", "B"]} and found.facts == {"sample_rate": "48000", "samples": "96000"} and found.pictures[0].data == PNG
    again = read_contents(with_comments(plain + b"sound", {"title": "T"}), ".flac")
    assert again.tags == {"title": ["T"]} and again.pictures[0].data == PNG
    packed = base64.b64encode(picture_block(PNG, 0)).decode()
    for mark, head in ((b"\x03vorbis", b"\x01vorbis"), (b"OpusTags", b"OpusHead")):
        found = read_contents(ogg(head, mark + comments("TITLE=" + "x" * 600, f"METADATA_BLOCK_PICTURE={packed}", "METADATA_BLOCK_PICTURE=!")), ".ogg")
        assert found.tags == {"title": ["x" * 600]} and front_cover(found.pictures).data == PNG


def test_mp4_and_asf():
    data = lambda kind, value: box(b"data", kind.to_bytes(4), (0).to_bytes(4), value)
    ilst = box(b"ilst", box(b"\xa9nam", data(1, b"Title")), box(b"trkn", data(0, bytes([0, 0, 0, 3, 0, 12, 0, 0]))), box(b"covr", data(14, PNG)), box(b"----", box(b"mean", b"\x00" * 4, b"com"), box(b"name", b"\x00" * 4, b"RATING"), data(1, b"80")))
    found = read_contents(box(b"ftyp", b"M4A ") + box(b"moov", box(b"udta", box(b"meta", b"\x00" * 4, ilst))), ".m4a")
    assert found.tags == {"title": ["Title"], "tracknumber": ["3/12"], "rating": ["80"]} and found.pictures[0].data == PNG
    wide = lambda s: s.encode("utf-16-le")
    part = lambda kind, body: kind + (24 + len(body)).to_bytes(8, "little") + body
    plain = part(ASF_PLAIN, b"".join(len(wide(s)).to_bytes(2, "little") for s in ("T", "A", "", "", "")) + wide("T") + wide("A"))
    name, value = wide("WM/Genre\x00"), wide("Jazz\x00")
    more = part(ASF_EXTENDED, (1).to_bytes(2, "little") + len(name).to_bytes(2, "little") + name + (0).to_bytes(2, "little") + len(value).to_bytes(2, "little") + value)
    body = plain + more
    file = ASF_HEADER + (30 + len(body)).to_bytes(8, "little") + (2).to_bytes(4, "little") + b"\x01\x02" + body
    assert read_contents(file, ".wma").tags == {"title": ["T"], "artist": ["A"], "genre": ["Jazz"]}


def test_images_and_frames():
    assert image_size(PNG) == (600, 500) and image_size(JPEG) == (400, 300) and image_pixels(JPEG) == 120_000
    assert image_size(PNG[:12] + b"IDAT" + PNG[16:]) is None and image_size(b"") is None and image_pixels(b"x") is None
    assert id3v1_genre(b"x" * 10 + b"TAG" + b"\x00" * 124 + b"\x11") == 17 and id3v1_genre(b"") is None
    assert mp3_facts(b"\xff\xfb\x90\x40" + b"\x00" * 300) == {"bitrate_kbps": "128", "sample_rate": "44100", "mode": "joint stereo", "vbr_mode": "CBR"}
    assert mp3_facts(b"nothing") == {} and decoded("é".encode()) == "é" and decoded(b"\xe9") == "é"


def test_files_and_tags_written(spark, tmp_path):
    song = tmp_path / "a.mp3"
    song.write_bytes(with_id3(b"\xff\xfb\x90\x40" + b"s" * 200_000, {"title": "Old", "genre": "Jazz"}, [(PNG, "image/png")]))
    replace_file(str(song), with_id3(song.read_bytes(), {"title": "New", "genre": None, "date": "1999-05-01"}, drop=("TCMP",)))
    (tmp_path / "b.mp3").write_bytes(b"")
    paths = spark.createDataFrame([(str(song),), (str(tmp_path / "b.mp3"),), (str(tmp_path / "none.mp3"),)], "path string")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in decoded_tracks(read_files(paths)).collect()}
    assert (rows["a.mp3"]["title"], rows["a.mp3"]["genre"], rows["a.mp3"]["year"], bytes(rows["a.mp3"]["art"])) == ("New", None, 1999, PNG)
    assert rows["a.mp3"]["facts"]["bitrate_kbps"] == "128" and rows["none.mp3"]["raw_tags"] is None and rows["none.mp3"]["title"] is None
    (tmp_path / "c.mp3").write_bytes(song.read_bytes())
    assert head_tail_equal(str(song), str(tmp_path / "c.mp3")) and not head_tail_equal(str(song), str(tmp_path / "b.mp3"))
    one, two = fingerprint(str(song)), fingerprint(str(tmp_path / "c.mp3"))
    assert one["stream"] == two["stream"] and one["full"] == two["full"] and fingerprint(str(tmp_path / "none"))["error"]
    table = spark.createDataFrame([("p", song.read_bytes(), ".mp3"), ("q", None, ".mp3")], "path string, content binary, ext string")
    assert fingerprints_of(table, "path", "content", "ext").first()["stream"] == one["stream"]
