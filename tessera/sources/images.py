"""Pictures read as rows of RGB bytes, in the format that a file name's suffix names: PNG, BMP, TIFF or JPEG."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tessera.sources import png
from tessera.sources.jpeg import decode_jpeg

#: TIFF: bytes of a value of each field kind, and how struct spells it.
_KINDS = {1: "B", 3: "H", 4: "I", 16: "Q"}


def decode_as(data: bytes, name: str) -> np.ndarray:
    """Rows of RGB bytes of a picture file. Transparency is dropped, not blended. ValueError for what can't be read."""
    suffix = name.rpartition(".")[2].lower()
    readers = {"png": png.decode, "bmp": decode_bmp, "tif": decode_tiff, "tiff": decode_tiff, "jpg": decode_jpeg, "jpeg": decode_jpeg}
    if suffix not in readers:
        raise ValueError(f"no image format is known by .{suffix}")
    try:
        return readers[suffix](data)
    except (struct.error, IndexError, KeyError, TypeError, OverflowError, zlib.error) as e:
        raise ValueError(f"{name}: not a good picture ({e})") from e


def _scaled(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of so many bits as bytes, rounded."""
    most = (1 << bits) - 1
    return values.astype(np.uint8) if bits == 8 else ((values.astype(np.uint32) * 255 + most // 2) // most).astype(np.uint8)


def _unpacked(rows: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n values of 1, 2, 4 or 8 bits of each row of bytes."""
    per = 8 // bits
    shifts = np.arange(per - 1, -1, -1, dtype=np.uint8) * bits
    return (rows[:, :, None] >> shifts & ((1 << bits) - 1)).reshape(len(rows), -1)[:, :n]


def decode_bmp(data: bytes) -> np.ndarray:
    """Pictures of 1 to 32 bits a pixel, plain, by bit fields or by run lengths."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP")
    start, head = struct.unpack_from("<II", data, 10)
    if head == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", data, 18)
        packing = used = 0
    else:
        w, h, _, bits, packing, _, _, _, used = struct.unpack_from("<iiHHIIiiI", data, 18)
    down, h = h > 0, abs(h)
    if w <= 0 or bits not in (1, 2, 4, 8, 16, 24, 32) or packing not in (0, 1, 2, 3, 6):
        raise ValueError("a BMP of an unknown kind")
    if packing in (1, 2):
        places = _run_lengths(data, start, w, h, packing == 2)
    else:
        stride = (w * bits + 31) // 32 * 4
        rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)
        places = _unpacked(rows, bits, w) if bits <= 8 else rows
    if bits <= 8:
        size = 3 if head == 12 else 4
        n = min(used or 1 << bits, 1 << bits)
        palette = np.zeros((256, 3), np.uint8)
        palette[:n] = np.frombuffer(data, np.uint8, n * size, 14 + head).reshape(n, size)[:, 2::-1]
        out = palette[places]
    elif bits == 24:
        out = places[:, : w * 3].reshape(h, w, 3)[:, :, ::-1]
    else:
        values = np.ascontiguousarray(places[:, : w * bits // 8]).view(f"<u{bits // 8}")
        plain = (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
        out = np.stack([_field(values, m) for m in (struct.unpack_from("<III", data, 54) if packing in (3, 6) else plain)], 2)
    return np.ascontiguousarray(out[::-1] if down else out)


def _field(values: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.zeros(values.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    own = (values.astype(np.uint32) & np.uint32(mask)) >> np.uint32(low)
    bits = (mask >> low).bit_length()
    return _scaled(own >> np.uint32(max(0, bits - 16)), min(bits, 16))


def _run_lengths(data: bytes, at: int, w: int, h: int, halves: bool) -> np.ndarray:
    """Palette places by runs, of which a byte holds two where halves. What is skipped has place 0."""
    out = np.zeros((h, w), np.uint8)
    x = y = 0

    def put(values: np.ndarray) -> None:
        if y < h:
            out[y, x : x + len(values)] = values[: max(0, w - x)]

    while at + 2 <= len(data) and y < h:
        n, v = data[at], data[at + 1]
        at += 2
        if n:
            put(np.resize([v >> 4, v & 15] if halves else [v], n))
            x += n
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2:
            x, y = x + data[at], y + data[at + 1]
            at += 2
        else:
            size = (v + 1) // 2 if halves else v
            own = np.frombuffer(data, np.uint8, size, at)
            put(_unpacked(own[None, :], 4, v)[0] if halves else own)
            x, at = x + v, at + size + size % 2
    return out


def decode_tiff(data: bytes) -> np.ndarray:
    """The first picture of a file: strips or tiles, plain, by PackBits, LZW or deflate, of gray, palette or RGB."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in _KINDS:
            shape = f"{order}{n}{_KINDS[kind]}"
            place = at + 10 + 12 * i
            tags[tag] = struct.unpack_from(shape, data, place if struct.calcsize(shape) <= 4 else struct.unpack_from(order + "I", data, place)[0])
    one = lambda tag, other=None: tags.get(tag, (other,))[0]
    w, h, channels, packing, photometric = one(256), one(257), one(277, 1), one(259, 1), one(262, 1)
    bits = tags.get(258, (1,))
    if len(set(bits)) != 1 or bits[0] not in (1, 2, 4, 8, 16) or photometric not in (0, 1, 2, 3) or one(339, 1) != 1:
        raise ValueError("a TIFF of an unknown kind")
    bits = bits[0]
    planes = channels if one(284, 1) == 2 else 1
    inner = channels // planes
    tiled = 322 in tags
    pw, ph = (one(322), one(323)) if tiled else (w, min(one(278, h), h))
    starts, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-w // pw), -(-h // ph)
    out = np.zeros((down * ph, across * pw, channels), np.uint16 if bits == 16 else np.uint8)
    stride = (pw * inner * bits + 7) // 8
    for i in range(planes * across * down):
        plane, place = divmod(i, across * down)
        y, x = divmod(place, across)
        rows = ph if tiled else min(ph, h - y * ph)
        raw = _unpack(data[starts[i] : starts[i] + sizes[i]], packing, stride * rows)
        block = np.frombuffer(raw, np.uint8, stride * rows).reshape(rows, stride)
        values = block.view(order + "u2") if bits == 16 else _unpacked(block, bits, pw * inner)
        values = values.reshape(rows, pw, inner)
        if one(317, 1) == 2:
            values = np.cumsum(values, 1, dtype=out.dtype)
        out[y * ph : y * ph + rows, x * pw : (x + 1) * pw, plane * inner : (plane + 1) * inner] = values
    out = out[:h, :w]
    if photometric == 3:
        colors = np.array(tags[320], np.uint32).reshape(3, -1).T
        return _scaled(colors, 16)[out[:, :, 0]]
    shown = _scaled(out, bits)
    if photometric == 0:
        shown = 255 - shown
    return np.ascontiguousarray(shown[:, :, :3]) if photometric == 2 else np.repeat(shown[:, :, :1], 3, 2)


def _unpack(data: bytes, packing: int, size: int) -> bytes:
    if packing == 1:
        return data
    if packing in (8, 32946):
        return zlib.decompress(data)
    if packing == 5:
        return _lzw(data, size)
    if packing != 32773:
        raise ValueError(f"TIFF compression {packing} isn't known")
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; the width grows one code early, as TIFF has it."""
    clear, end = 256, 257
    words = [bytes([i]) for i in range(256)] + [b"", b""]
    out, last, width, held, have, length = [], None, 9, 0, 0, 0
    for byte in data:
        held, have = held << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code, held = held >> have, held & ((1 << have) - 1)
        if code == end or length >= size:
            break
        if code == clear:
            del words[258:]
            last, width = None, 9
            continue
        if last is None:
            word = words[code]
        else:
            word = words[code] if code < len(words) else last + last[:1]
            words.append(last + word[:1])
        out.append(word)
        length += len(word)
        last = word
        width = min(12, (len(words) + 1).bit_length())
    return b"".join(out)
