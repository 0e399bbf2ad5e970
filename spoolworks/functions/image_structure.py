"""Whether an image file is whole, told by the structure of its container; no pixels are decoded."""

from __future__ import annotations

import struct
import zlib

WINDOW = 1 << 16
#: Largest directory chain and value list that a TIFF check follows.
TIFF_DIRECTORIES = 10_000

# fixed values: frame markers of JPEG (all but the table markers C4, C8 and CC), sizes of TIFF value types
JPEG_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


class Fault(Exception):
    """What is wrong with a file."""


class Reader:
    """A position in a file that is read by windows; going past the end is a fault."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.begin, self.held = source, size, 0, 0, b""

    def take(self, n: int) -> bytes:
        if self.at + n > self.size:
            raise Fault("truncated")
        if not (self.begin <= self.at and self.at + n <= self.begin + len(self.held)):
            self.begin, self.held = self.at, bytes(self.source.read_at(min(max(n, WINDOW), self.size - self.at), self.at))
        out = self.held[self.at - self.begin : self.at - self.begin + n]
        if len(out) < n:
            raise Fault("truncated")
        self.at += n
        return out

    def skip(self, n: int) -> None:
        if self.at + n > self.size:
            raise Fault("truncated")
        self.at += n

    def pieces(self, n: int):
        """The next ``n`` bytes, a window at a time."""
        while n:
            piece = self.take(min(n, WINDOW))
            n -= len(piece)
            yield piece


class Bytes:
    """A file that is in memory."""

    def __init__(self, data: bytes):
        self.data = data

    def read_at(self, n: int, at: int) -> bytes:
        return bytes(self.data[at : at + n])


def _jpeg(r: Reader) -> None:
    frame = scan = False
    r.skip(2)
    mark = None
    while True:
        if mark is None:
            if r.take(1) != b"\xff":
                raise Fault("no marker where one must be")
            while (mark := r.take(1)[0]) == 0xFF:
                pass
        if mark == 0xD9:
            if not (frame and scan):
                raise Fault("ends without an image")
            return
        if mark in (0x00, 0xD8) or 0xD0 <= mark <= 0xD7:
            raise Fault("marker out of place")
        if mark == 0x01:
            mark = None
            continue
        length = int.from_bytes(r.take(2), "big")
        if length < 2:
            raise Fault("bad segment length")
        if mark in JPEG_FRAMES:
            head = r.take(6)
            if length != 8 + 3 * head[5] or not head[5] or head[3:5] == b"\0\0":
                raise Fault("bad frame header")
            frame = True
            r.skip(length - 8)
        elif mark == 0xDA:
            parts = r.take(1)[0]
            if not frame or length != 6 + 2 * parts:
                raise Fault("bad scan header")
            scan = True
            r.skip(length - 3)
            mark = _after_scan(r)
            continue
        else:
            r.skip(length - 2)
        mark = None


def _after_scan(r: Reader) -> int:
    """The marker that ends coded data; stuffed zeros and restart markers belong to the data."""
    open_ = False
    while True:
        piece = r.take(min(WINDOW, max(r.size - r.at, 1)))
        at = 0
        while at < len(piece):
            if not open_:
                at = piece.find(b"\xff", at)
                if at < 0:
                    break
                open_, at = True, at + 1
                continue
            code = piece[at]
            at += 1
            if code == 0xFF:
                continue
            open_ = False
            if code and not 0xD0 <= code <= 0xD7:
                r.at -= len(piece) - at
                return code


def _png(r: Reader) -> None:
    r.skip(8)
    first, data = True, False
    while True:
        length, kind = struct.unpack(">I4s", r.take(8))
        if length > 0x7FFFFFFF or not kind.isalpha():
            raise Fault("bad chunk header")
        if first != (kind == b"IHDR"):
            raise Fault("header chunk out of place")
        check, body = zlib.crc32(kind), b""
        for piece in r.pieces(length):
            check = zlib.crc32(piece, check)
            body = body or piece
        if check != int.from_bytes(r.take(4), "big"):
            raise Fault("bad checksum")
        if first and (length != 13 or not all(struct.unpack(">II", body[:8]))):
            raise Fault("bad header")
        first, data = False, data or kind == b"IDAT"
        if kind == b"IEND":
            if not data:
                raise Fault("ends without an image")
            return


def _gif(r: Reader) -> None:
    def blocks():
        while n := r.take(1)[0]:
            r.skip(n)

    def table(flags: int):
        if flags & 0x80:
            r.skip(3 << ((flags & 7) + 1))

    r.skip(6)
    width, height, flags = struct.unpack("<HHB", r.take(5))
    r.skip(2)
    if not width or not height:
        raise Fault("bad header")
    table(flags)
    images = 0
    while True:
        kind = r.take(1)[0]
        if kind == 0x3B:
            if not images:
                raise Fault("ends without an image")
            return
        if kind == 0x21:
            r.skip(1)
            blocks()
        elif kind == 0x2C:
            table(r.take(9)[8])
            if not 2 <= r.take(1)[0] <= 11:
                raise Fault("bad code size")
            blocks()
            images += 1
        else:
            raise Fault("unknown block")


def _webp(r: Reader) -> None:
    size = struct.unpack("<I", r.take(8)[4:])[0]
    end, image = 8 + size, False
    if end > r.size:
        raise Fault("truncated")
    r.skip(4)
    while r.at + 8 <= end:
        kind, length = struct.unpack("<4sI", r.take(8))
        stop = r.at + length + (length & 1)
        if r.at + length > end:
            raise Fault("bad chunk length")
        if kind == b"VP8 ":
            image = True
            if length < 10 or r.take(6)[3:] != b"\x9d\x01\x2a":
                raise Fault("bad frame header")
        elif kind == b"VP8L":
            image = True
            if length < 5 or r.take(1) != b"\x2f":
                raise Fault("bad frame header")
        elif kind == b"ANMF":
            image = True
        r.at = min(stop, end)
    if not image:
        raise Fault("ends without an image")


def _bmp(r: Reader) -> None:
    head = r.take(18)
    offset, dib = struct.unpack("<II", head[10:])
    if dib == 12:
        width, height, _, bits = struct.unpack("<HHHH", r.take(8))
        packed = 0
    elif dib >= 40:
        width, height, _, bits, packed = struct.unpack("<iiHHI", r.take(16))
    else:
        raise Fault("bad header")
    if width <= 0 or not height or bits not in (1, 4, 8, 16, 24, 32) and not packed:
        raise Fault("bad header")
    need = offset + (((width * bits + 31) // 32) * 4 * abs(height) if packed in (0, 3, 6) else 1)
    if need > r.size or offset < 14 + dib:
        raise Fault("truncated" if need > r.size else "bad header")


def _tiff(r: Reader) -> None:
    order = "<" if r.take(4)[:2] == b"II" else ">"
    at, seen, image = struct.unpack(order + "I", r.take(4))[0], set(), False

    def values(kind: int, count: int, raw: bytes) -> list[int]:
        width = TIFF_SIZES.get(kind, 0)
        if kind not in (3, 4):
            raise Fault("bad directory")
        if width * count > 4:
            r.at = struct.unpack(order + "I", raw)[0]
            raw = r.take(width * count)
        return list(struct.unpack(order + str(count) + ("H" if kind == 3 else "I"), raw[: width * count]))

    while at:
        if at in seen or len(seen) >= TIFF_DIRECTORIES:
            raise Fault("directories go in a circle")
        seen.add(at)
        r.at = at
        entries = struct.unpack(order + "H", r.take(2))[0]
        table = r.take(12 * entries)
        at = struct.unpack(order + "I", r.take(4))[0]
        found = {}
        for i in range(entries):
            tag, kind, count = struct.unpack(order + "HHI", table[12 * i : 12 * i + 8])
            if tag in (273, 279, 324, 325):
                found[tag] = values(kind, count, table[12 * i + 8 : 12 * i + 12])
        for places, lengths in ((273, 279), (324, 325)):
            if places in found:
                image = True
                if len(found[places]) != len(found.get(lengths, [])):
                    raise Fault("bad directory")
                if any(a + n > r.size for a, n in zip(found[places], found[lengths])):
                    raise Fault("truncated")
    if not image:
        raise Fault("ends without an image")


def image_fault(source, size: int) -> str | None:
    """Why a file is no whole image, or None. ``source`` gives bytes by ``read_at(n, place)``; a window is held at a time.

    Every marker, chunk, block and directory must be in its place and inside the file, and checksums must agree where the format
    has them (PNG). Damage inside coded pixels of other formats shows only where it breaks the structure. Bytes behind the end of an image are allowed.
    """
    r = Reader(source, size)
    head = bytes(source.read_at(min(size, 12), 0))
    kinds = [
        (head[:3] == b"\xff\xd8\xff", _jpeg), (head[:8] == b"\x89PNG\r\n\x1a\n", _png), (head[:6] in (b"GIF87a", b"GIF89a"), _gif),
        (head[:4] == b"RIFF" and head[8:12] == b"WEBP", _webp), (head[:2] == b"BM", _bmp), (head[:4] in (b"II*\0", b"MM\0*"), _tiff),
    ]
    for known, check in kinds:
        if known:
            try:
                check(r)
            except (Fault, struct.error) as fault:
                return str(fault) if isinstance(fault, Fault) else "bad header"
            return None
    return "no known format"
