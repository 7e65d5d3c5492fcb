"""Bytes of image files: PGM and PPM in and out, PNG out, and the checksums that PNG needs."""

from __future__ import annotations

import struct
import zlib

import numpy as np


class BadImage(ValueError):
    """The bytes aren't an image of the expected kind."""


def _header(data: bytes, magic: bytes) -> tuple[int, int, int]:
    """Width, height and where the pixels begin. Comments run from # to the end of the line."""
    if data[:2] != magic:
        raise BadImage(f"not a {magic.decode()} file")
    at, numbers = 2, []
    while len(numbers) < 3:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                while at < len(data) and data[at] != 10:
                    at += 1
            else:
                at += 1
        start = at
        while at < len(data) and data[at : at + 1].isdigit():
            at += 1
        if start == at:
            raise BadImage("the header holds no number where one belongs")
        numbers.append(int(data[start:at]))
    if not 0 < numbers[2] <= 255:
        raise BadImage(f"levels up to {numbers[2]} are not supported")
    return numbers[0], numbers[1], at + 1  # one white space ends the header


def read_pgm(data: bytes) -> np.ndarray:
    w, h, at = _header(data, b"P5")
    if len(data) - at < w * h:
        raise BadImage("too few pixels")
    return np.frombuffer(data, np.uint8, w * h, at).reshape(h, w)


def read_ppm(data: bytes) -> np.ndarray:
    w, h, at = _header(data, b"P6")
    if len(data) - at < w * h * 3:
        raise BadImage("too few pixels")
    return np.frombuffer(data, np.uint8, w * h * 3, at).reshape(h, w, 3)


def read_image(data: bytes) -> np.ndarray:
    return read_pgm(data) if data[:2] == b"P5" else read_ppm(data)


def write_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image).tobytes()


def write_ppm(image: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image).tobytes()


def adler32(data: bytes) -> int:
    return zlib.adler32(data)


def write_png(image: np.ndarray) -> bytes:
    """Gray or RGB, no filter, deflate blocks stored as they are."""
    h, w = image.shape[:2]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + np.ascontiguousarray(line).tobytes() for line in image)
    stored = [raw[k : k + 65535] for k in range(0, len(raw), 65535)] or [b""]
    body = b"\x78\x01" + b"".join(
        struct.pack("<BHH", k == len(stored) - 1, len(s), 0xFFFF ^ len(s)) + s for k, s in enumerate(stored)
    )
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    body += struct.pack(">I", adler32(raw))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def read_png_stored(data: bytes) -> np.ndarray:
    """An image that write_png wrote, for round trips."""
    w, h, _, kind = struct.unpack(">IIBB", data[16:26])
    at, body = 8, b""
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    depth = 1 if kind == 0 else 3
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * depth)[:, 1:]
    return lines.reshape((h, w) if depth == 1 else (h, w, 3))
