"""Headers of made containers."""

import struct

import pytest

from frameloom.cli import main
from frameloom.operators import video
from frameloom.sources import videos


def box(kind, *parts, large=False):
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if large else struct.pack(">I4s", len(body) + 8, kind) + body


def track(handler, frames, scale, length, wide=False):
    clock = struct.pack(">B3xQQIQ", 1, 0, 0, scale, length) if wide else struct.pack(">B3xIIII", 0, 0, 0, scale, length)
    table = box(b"stbl", box(b"stsd", b"\0" * 8), box(b"stsz", struct.pack(">III", 0, 0, frames), b"\0" * 4 * frames))
    return box(b"trak", box(b"tkhd", b"\0" * 84), box(b"mdia", box(b"mdhd", clock, b"\0" * 4), box(b"hdlr", b"\0" * 8, handler, b"\0" * 12), box(b"minf", box(b"vmhd", b"\0" * 12), table)))


SOUND = track(b"soun", 999, 48_000, 96_000)
HEAD, MEDIA = box(b"ftyp", b"isom\0\0\0\0"), box(b"mdat", b"\x01" * 3000)
CASES = {
    "cam_t0.mp4": (HEAD + MEDIA + box(b"moov", box(b"mvhd", b"\0" * 100), SOUND, track(b"vide", 300, 15_000, 300_000)), (300, 15.0)),
    "cam_t700.mp4": (HEAD + box(b"moov", track(b"vide", 10, 1000, 500, wide=True)) + MEDIA, (10, 20.0)),
    "cam_t900.mov": (HEAD + box(b"mdat", b"\x02" * 50, large=True) + box(b"moov", track(b"vide", 7, 30, 14)), (7, 15.0)),
    "sound_t5.mp4": (HEAD + box(b"moov", SOUND), (0, 0.0)),
    "still_t6.mp4": (HEAD + box(b"moov", track(b"vide", 4, 1000, 0)), (4, 0.0)),
    "cut_t7.mp4": ((HEAD + MEDIA + box(b"moov", track(b"vide", 300, 15_000, 300_000)))[:-700], (0, 0.0)),
    "text_t8.mp4": (b"this is no video at all", (0, 0.0)),
    "empty_t9.mp4": (b"", (0, 0.0)),
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "v").mkdir()
    for name, (data, _) in CASES.items():
        (tmp_path / "v" / name).write_bytes(data)
    return tmp_path / "v"


def test_headers(spark, folder):
    found = videos.probe(spark, str(folder))
    assert {r["path"].rsplit("/", 1)[1]: (r["frame_count"], r["fps"]) for r in found.collect()} == {k: v for k, (data, v) in CASES.items() if data}
    assert {(r["start"], r["end"]) for r in video.video_map(found).filter("frame_count > 5").collect()} == {(0, 600), (700, 720), (900, 914)}


def test_media_is_not_read(folder):
    read = []

    class File:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            read.append(n)
            return self.data[at : at + n]

    data = CASES["cam_t0.mp4"][0]
    assert videos.Boxes(File(data), len(data)).video() == (300, 15.0)
    assert sum(read) < 500 < len(data)


def test_command_and_missing_files(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    assert main(["probe", str(folder), out], spark) == 0
    assert spark.read.parquet(out).filter("frame_count > 0").count() == 4
    assert videos.measured(f"file://{folder}/none.mp4") == (0, 0.0)
    assert main(["probe", str(folder / "none"), out, "--overwrite"], spark) == 1
