"""Uncompressed bitmaps (.bmp), without libraries."""

from __future__ import annotations

import struct

import numpy as np


def write(image: np.ndarray) -> bytes:
    """Gray levels as a bitmap of 8 bits a pixel, rows from the bottom up, each padded to four bytes."""
    h, w = image.shape
    rows = np.zeros((h, -(-w // 4) * 4), np.uint8)
    rows[:, :w] = image[::-1]
    palette = b"".join(bytes((v, v, v, 0)) for v in range(256))
    start = 14 + 40 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 11811, 11811, 256, 256) + palette + rows.tobytes()


def read(content: bytes) -> np.ndarray:
    """Gray levels of a bitmap of 8 or 24 bits a pixel; colours count 299, 587 and 114 parts in a thousand."""
    start, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", content, 10)
    if content[:2] != b"BM" or bits not in (8, 24) or packed:
        raise ValueError("bitmaps of 8 or 24 bits a pixel, uncompressed")
    stride = -(-w * bits // 32) * 4
    rows = np.frombuffer(content, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", content, 46)[0] or 256
        colours = np.frombuffer(content, np.uint8, 4 * used, 14 + size).reshape(used, 4)[:, :3].astype(np.uint32)
    else:
        colours = rows.reshape(abs(h), w, 3).astype(np.uint32)
    gray = ((colours @ np.array([114, 587, 299], np.uint32) + 500) // 1000).astype(np.uint8)
    return gray[rows] if bits == 8 else gray
