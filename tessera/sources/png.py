"""Images as files: PNG with zlib and numpy, BMP and TIFF without compression, JPEG."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tessera.sources.jpeg import encode_jpeg

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of PNG's colour types.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Adam7: first column, first row, column step, row step of each pass.
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(image: np.ndarray, palette: list[tuple[int, int, int]] | None = None) -> bytes:
    """A PNG of rows of RGB or RGBA bytes, or of palette places."""
    h, w = image.shape[:2]
    kind = 3 if palette is not None else {1: 0, 3: 2, 4: 6}[1 if image.ndim == 2 else image.shape[2]]
    rows = np.ascontiguousarray(image, np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], 1).tobytes()
    out = [_SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))]
    if palette is not None:
        out.append(_chunk(b"PLTE", bytes(v for rgb in palette for v in rgb)))
    return b"".join([*out, _chunk(b"IDAT", zlib.compress(raw, 6)), _chunk(b"IEND", b"")])


def _unfiltered(data: bytes, at: int, h: int, stride: int, bpp: int) -> tuple[np.ndarray, int]:
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        kind = data[at]
        row = np.frombuffer(data, np.uint8, stride, at + 1).copy()
        at += stride + 1
        if kind == 2:
            row += above
        elif kind == 1:
            for i in range(bpp):
                row[i::bpp] = np.cumsum(row[i::bpp], dtype=np.uint8)
        elif kind in (3, 4):
            line, up = row.tolist(), above.tolist()
            for i in range(stride):
                a = line[i - bpp] if i >= bpp else 0
                b = up[i]
                if kind == 3:
                    line[i] = (line[i] + (a + b) // 2) & 255
                else:
                    c = up[i - bpp] if i >= bpp else 0
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    line[i] = (line[i] + (a if da <= db and da <= dc else b if db <= dc else c)) & 255
            row = np.array(line, np.uint8)
        elif kind:
            raise ValueError("unknown PNG filter")
        out[y] = above = row
    return out, at


def _samples(rows: np.ndarray, w: int, channels: int, depth: int) -> np.ndarray:
    if depth == 16:
        wide = np.ascontiguousarray(rows).view(">u2")[:, : w * channels].astype(np.uint32)
        return ((wide + 128) // 257).astype(np.uint8).reshape(len(rows), w, channels)  # rounded, not cut
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
        values = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2)[:, : w * channels]
        return values.reshape(len(rows), w, channels).astype(np.uint8)
    return rows[:, : w * channels].reshape(len(rows), w, channels)


def decode(data: bytes) -> np.ndarray:
    """Rows of RGB bytes. Transparency is dropped, not blended. ValueError for what isn't a good PNG."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        at += n + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
    if head is None or not body:
        raise ValueError("a PNG without head or pixels")
    w, h, depth, color, _, _, interlaced = head
    channels = _CHANNELS[color]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    bpp = max(1, channels * depth // 8)
    out = np.zeros((h, w, channels), np.uint8)
    at = 0
    for x0, y0, dx, dy in _PASSES if interlaced else [(0, 0, 1, 1)]:
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw > 0 and ph > 0:
            rows, at = _unfiltered(raw, at, ph, -(-pw * channels * depth // 8), bpp)
            out[y0::dy, x0::dx] = _samples(rows, pw, channels, depth)
    if color == 3:
        return palette[out[:, :, 0]]
    if depth < 8:
        out = out * (255 // ((1 << depth) - 1))
    return np.repeat(out[:, :, :1], 3, 2) if channels < 3 else out[:, :, :3].copy()


def encode_bmp(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    pad = -w * 3 % 4
    rows = np.pad(image[::-1, :, 2::-1].reshape(h, -1), ((0, 0), (0, pad))).tobytes()
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 54, 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def encode_tiff(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    pixels = np.ascontiguousarray(image[:, :, :3]).tobytes()
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 3, 8), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 14), (277, 3, 1, 3), (278, 4, 1, h), (279, 4, 1, len(pixels))]
    tags[2] = (258, 3, 3, 8)
    return struct.pack("<2sHI", b"II", 42, 14 + len(pixels)) + struct.pack("<3H", 8, 8, 8) + pixels + _directory(tags)


def _directory(tags: list[tuple[int, int, int, int]]) -> bytes:
    out = struct.pack("<H", len(tags))
    for tag, kind, count, value in tags:
        out += struct.pack("<HHII", tag, kind, count, 8) if tag == 258 else struct.pack("<HHIHH", tag, kind, count, value, 0) if kind == 3 else struct.pack("<HHII", tag, kind, count, value)
    return out + struct.pack("<I", 0)


def encode_as(image: np.ndarray, name: str) -> bytes:
    """An image in the format that a file name's suffix names; ValueError for others."""
    suffix = name.rpartition(".")[2].lower()
    writers = {"png": encode, "bmp": encode_bmp, "tif": encode_tiff, "tiff": encode_tiff, "jpg": encode_jpeg, "jpeg": encode_jpeg}
    if suffix not in writers:
        raise ValueError(f"no image format is known by .{suffix}")
    return writers[suffix](image)
