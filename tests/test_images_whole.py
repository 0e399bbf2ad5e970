"""Container structure of image files, and copies that are committed in two phases."""

import os
import struct
import subprocess
import sys
import textwrap
import zlib

import pytest

from spoolworks.functions.image_structure import Bytes, image_fault
from spoolworks.operators.captions import whole_images
from spoolworks.sinks.files import copy_images, image_faults

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def tiff(order):
    entries = [(256, 3, 1, 2), (257, 3, 1, 2), (273, 4, 1, 8), (279, 4, 1, 4)]
    table = b"".join(struct.pack(order + "HHI", *e[:3]) + (struct.pack(order + "H", e[3]) + b"\0\0" if e[1] == 3 else struct.pack(order + "I", e[3])) for e in entries)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 12) + b"abcd" + struct.pack(order + "H", 4) + table + struct.pack(order + "I", 0)


VP8 = b"\0\0\0\x9d\x01\x2a\x01\0\x01\0data!"
IMAGES = {
    "png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"k\0v") + chunk(b"IDAT", zlib.compress(b"\0ab\0cd")) + chunk(b"IEND", b""),
    "jpeg": bytes.fromhex("ffd8ffe000040000ffffdb000401ffffc0000b080002000201011100ffda0008010100003f00") + b"ab\xff\x00cd\xff\xd0ef\xff\xff\xd9",
    "progressive": bytes.fromhex("ffd8ffc2000b080002000201011100ffda0008010100003f00") + b"ab\xff\xc4\x00\x04xy" + bytes.fromhex("ffda0008010100003f00") + b"cd\xff\xd9",
    "gif": b"GIF89a\x02\0\x02\0\x80\0\0" + b"\0" * 6 + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c\0\0\0\0\x02\0\x02\0\0\x02\x03abc\0\x3b",
    "webp": b"RIFF" + struct.pack("<I", 4 + 8 + len(VP8) + 1) + b"WEBPVP8 " + struct.pack("<I", len(VP8)) + VP8 + b"\0",
    "bmp": b"BM" + struct.pack("<IHHI", 70, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, 16, 0, 0, 0, 0) + b"\0" * 16,
    "tiff": tiff("<"),
    "tiff_be": tiff(">"),
}


def fault(data):
    return image_fault(Bytes(data), len(data))


@pytest.mark.parametrize("name", IMAGES)
def test_whole_and_every_cut(name):
    data = IMAGES[name]
    assert fault(data) is None
    assert fault(data + b"trailing") is None
    assert all(fault(data[:n]) for n in range(len(data)))


def test_flipped_bits():
    data = IMAGES["png"]
    for at in range(8, len(data)):
        assert fault(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]), at
    assert fault(IMAGES["webp"].replace(b"\x9d\x01", b"\x9c\x01")) == "bad frame header"
    assert fault(IMAGES["gif"].replace(b"\x21\xf9", b"\x20\xf9")) == "unknown block"
    assert fault(b"") == fault(b"text") == "no known format"


def test_long_files_by_windows():
    big = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 9, 8, 0, 0, 0, 0)) + chunk(b"IDAT", os.urandom(300_000)) * 3 + chunk(b"IEND", b"")
    assert fault(big) is None and fault(big[:-20] + b"x" + big[-19:]) == "bad checksum"
    scan = bytes.fromhex("ffd8ffc0000b080002000201011100ffda0008010100003f00") + (b"z" * 65_535 + b"\xff\x00") * 4
    assert fault(scan + b"\xff\xd9") is None and fault(scan) == "truncated"


def test_files_and_content(spark, tmp_path):
    for name, data in IMAGES.items():
        (tmp_path / f"{name}.img").write_bytes(data)
        (tmp_path / f"{name}_cut.img").write_bytes(data[:-2])
    paths = [str(p) for p in tmp_path.iterdir()] + [str(tmp_path / "gone.img")]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    found = {r.path: r.fault for r in image_faults(rows).collect()}
    assert found[str(tmp_path / "gone.img")] == "unreadable"
    assert {p for p, f in found.items() if f is None} == {str(tmp_path / f"{n}.img") for n in IMAGES}
    assert whole_images(rows, image_faults(rows)).count() == len(IMAGES)
    held = spark.createDataFrame([("a", bytearray(IMAGES["gif"])), ("b", None), ("c", bytearray(b""))], "path string, content binary")
    assert {r.path: r.fault for r in image_faults(held, content="content").collect()} == {"a": None, "b": "missing", "c": "no known format"}


def test_copies_leave_no_attempts(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i}", f"d/{i % 7}.bin", bytearray(b"x" * i)) for i in range(20)], "src string, dest string, content binary")
    assert {r.status for r in copy_images(rows, str(tmp_path / "out"), content="content").collect()} == {"written"}
    assert {r.status for r in copy_images(rows, str(tmp_path / "out"), content="content").collect()} == {"kept"}
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == [f"d/{i}.bin" for i in range(7)]


RETRY = """
    import sys, tempfile
    sys.path.insert(0, {root!r})
    from pyspark import TaskContext, cloudpickle
    from spoolworks import build_session
    from spoolworks.sinks import files

    cloudpickle.register_pickle_by_value(files)
    real = {{"stage": files._stage_one, "publish": files._publish_one}}

    def fail_once(name, done):
        # the work is done, then the task is lost
        if TaskContext.get().attemptNumber() == 0 and name.endswith("5.bin"):
            raise RuntimeError("lost")
        return done

    files._stage_one = lambda s, folder, d, *more: fail_once(d, real["stage"](s, folder, d, *more))
    files._publish_one = lambda folder, d, part: fail_once(d, real["publish"](folder, d, part))
    spark = build_session("retry", master="local[2,4]", **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(), "spark.sql.shuffle.partitions": "2"}})
    rows = spark.createDataFrame([(f"n{{i}}", f"{{i}}.bin", bytearray(b"x" * i)) for i in range(12)], "src string, dest string, content binary")
    print(sorted((r.dest, r.status) for r in files.copy_images(rows, {out!r}, content="content").collect()))
"""


def test_a_lost_task_changes_nothing(tmp_path):
    out = str(tmp_path / "out")
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(RETRY.format(root=ROOT, out=out))], capture_output=True, text=True, timeout=240)
    assert run.stdout.strip().splitlines()[-1:] == [str(sorted((f"{i}.bin", "written") for i in range(12)))], run.stderr[-2000:]
    assert "lost" in run.stderr
    assert sorted(os.listdir(out)) == sorted(f"{i}.bin" for i in range(12))
    assert [os.path.getsize(f"{out}/{i}.bin") for i in range(12)] == list(range(12))
