"""JPEG: written as baseline without subsampling, with tables made for each picture; read in all common kinds."""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections import Counter

import numpy as np

_DUMMY = 256
#: Where a marker stands in coded data.
_MARKS = re.compile(rb"\xff[\x01-\xfe]")


def _zigzag() -> np.ndarray:
    """Places of a block's coefficients in the order in which they are written: along the diagonals, to and fro."""
    cells = sorted(((u + v, u if (u + v) % 2 else -u, u * 8 + v) for u in range(8) for v in range(8)))
    return np.array([place for _, _, place in cells])


def _transform() -> np.ndarray:
    k = np.arange(8)
    out = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    out[0] /= np.sqrt(2)
    return out


def code_lengths(counts: Counter) -> dict[int, int]:
    """Lengths of a prefix code, 16 at most; no code is all ones, as a symbol that isn't used has the last one."""
    counts = Counter(counts) + Counter({_DUMMY: 1})
    while True:
        heap = [(n, s == _DUMMY and -1 or s, [s]) for s, n in counts.items()]
        heapq.heapify(heap)
        out = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(out.values()) <= 16:
            return out
        counts = Counter({s: n // 2 + 1 for s, n in counts.items()})


def codes(lengths: dict[int, int]) -> tuple[dict[int, tuple[int, int]], list[int], list[int]]:
    """Codes by symbol, the numbers of codes of each length, and the symbols in order."""
    order = sorted(lengths, key=lambda s: (lengths[s], s == _DUMMY, s))
    out, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (code, last)
        code += 1
    used = [s for s in order if s != _DUMMY]
    return out, [sum(lengths[s] == n for s in used) for n in range(1, 17)], used


def _size(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def encode_jpeg(image: np.ndarray, step: int = 1) -> bytes:
    """step: how much coarser a coefficient gets with each step of frequency."""
    h, w = image.shape[:2]
    rgb = np.pad(image[:, :, :3].astype(float), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    turn = np.array([[0.299, 0.587, 0.114], [-0.168735892, -0.331264108, 0.5], [0.5, -0.418687589, -0.081312411]])
    ycc = rgb @ turn.T - np.array([128.0, 0, 0])
    rows, cols = ycc.shape[0] // 8, ycc.shape[1] // 8
    blocks = ycc.reshape(rows, 8, cols, 8, 3).transpose(0, 2, 4, 1, 3)
    d = _transform()
    table = np.maximum(1, 2 + step * np.add.outer(np.arange(8), np.arange(8)))
    zigzag = _zigzag()
    q = np.round(d @ blocks @ d.T / table).astype(np.int64).reshape(rows * cols, 3, 64)[:, :, zigzag]
    dc = np.diff(q[:, :, 0], axis=0, prepend=0).reshape(-1)
    q = q.reshape(-1, 64)
    n = len(q)
    at, k = np.nonzero(q[:, 1:])
    k = k + 1
    first = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, bool)
    run = k - np.where(first, 0, np.append(0, k[:-1])) - 1
    values = q[at, k]
    size = _size(values)
    # events: block, place in it, table (0 for the mean, 1 for the rest), symbol, length and value of what follows
    events = [np.stack([np.arange(n), np.full(n, -1), np.zeros(n, int), _size(dc), _size(dc), _extra(dc, _size(dc))], 1)]
    events.append(np.stack([at, k * 8 + 7, np.ones_like(at), run % 16 * 16 + size, size, _extra(values, size)], 1))
    for far in range(1, 4):
        long = run >= 16 * far
        events.append(np.stack([at[long], k[long] * 8 + far, np.ones(long.sum(), int), np.full(long.sum(), 0xF0), np.zeros(long.sum(), int), np.zeros(long.sum(), int)], 1))
    end = np.flatnonzero(q[:, 63] == 0)
    events.append(np.stack([end, np.full_like(end, 10_000), np.ones_like(end), np.zeros_like(end), np.zeros_like(end), np.zeros_like(end)], 1))
    e = np.concatenate(events)
    e = e[np.lexsort((e[:, 1], e[:, 0]))]
    tables = []
    code, length = np.zeros(len(e), np.int64), np.zeros(len(e), np.int64)
    for kind in (0, 1):
        own = e[:, 2] == kind
        found, sizes, used = codes(code_lengths(Counter(e[own, 3].tolist())))
        look = np.zeros((257, 2), np.int64)
        for s, c in found.items():
            look[s] = c
        code[own], length[own] = look[e[own, 3]].T
        tables.append(struct.pack(">B16B", kind << 4, *sizes) + bytes(used))
    total = length + e[:, 4]
    value = code << e[:, 4] | e[:, 5]
    parts = []
    for i in range(0, len(e), 1 << 16):
        t, v = total[i : i + (1 << 16)], value[i : i + (1 << 16)]
        shift = t[:, None] - 1 - np.arange(32)
        bits = v[:, None] >> np.maximum(shift, 0) & 1
        parts.append(bits[shift >= 0].astype(np.uint8))
    stream = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    stream = np.append(stream, np.ones(-len(stream) % 8, np.uint8))
    body = np.packbits(stream).tobytes().replace(b"\xff", b"\xff\x00")

    def segment(marker: int, data: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data

    return b"".join([
        b"\xff\xd8", segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"), segment(0xDB, b"\x00" + bytes(table.reshape(-1)[zigzag].astype(np.uint8))),
        segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))), *[segment(0xC4, t) for t in tables],
        segment(0xDA, b"\x03" + b"".join(bytes([c, 0]) for c in (1, 2, 3)) + b"\x00\x3f\x00"), body, b"\xff\xd9",
    ])


class _Stream:
    """Bits of entropy-coded data, the highest first, with zeros behind the end."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + bytes(8), np.uint8).astype(np.int64)
        n = len(raw) - 4
        self.window = sum(raw[i : n + i] << (32 - 8 * i) for i in range(5)).tolist()
        self.at, self.end = 0, 8 * (n - 1)

    def take(self, n: int) -> int:
        if not n:
            return 0
        at = self.at
        if at > self.end:
            raise ValueError("a JPEG that ends early")
        self.at = at + n
        return self.window[at >> 3] >> (40 - (at & 7) - n) & ((1 << n) - 1)

    def symbol(self, table: list[int]) -> int:
        at = self.at
        if at > self.end:
            raise ValueError("a JPEG that ends early")
        found = table[self.window[at >> 3] >> (24 - (at & 7)) & 0xFFFF]
        self.at = at + (found >> 8)
        return found & 255

    def signed(self, n: int) -> int:
        """A number of n bits, of which the first tells the sign."""
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """By the next 16 bits: the length of the code that they begin with, times 256, and its symbol."""
    lengths = np.repeat(np.arange(1, 17), list(counts))
    table = np.repeat(lengths << 8 | np.frombuffer(symbols, np.uint8), 1 << (16 - lengths))
    if len(table) > 65536:
        raise ValueError("a JPEG with a bad code table")
    return np.append(table, np.full(65536 - len(table), 16 << 8)).tolist()


class _Plane:
    """One component: sampling factors, its table of steps, and coefficients of its blocks."""

    def __init__(self, h: int, v: int, table: int):
        self.h, self.v, self.table, self.dc, self.ac, self.mean = h, v, table, 0, 0, 0

    def sized(self, w: int, h: int, most_h: int, most_v: int) -> None:
        self.wide, self.high = -(-w * self.h // most_h), -(-h * self.v // most_v)
        self.across, self.down = -(-w // (8 * most_h)) * self.h, -(-h // (8 * most_v)) * self.v
        self.values = array("h", bytes(2 * 64 * self.across * self.down))

    def order(self) -> list[int]:
        """Its blocks in a scan of its own."""
        return [y * self.across + x for y in range(-(-self.high // 8)) for x in range(-(-self.wide // 8))]

    def pixels(self, steps: np.ndarray) -> np.ndarray:
        zigzag, d = _zigzag(), _transform()
        blocks = np.zeros((self.down * self.across, 64))
        blocks[:, zigzag] = np.frombuffer(self.values, np.int16).reshape(-1, 64) * steps
        blocks = d.T @ blocks.reshape(self.down, self.across, 8, 8) @ d
        whole = blocks.transpose(0, 2, 1, 3).reshape(self.down * 8, self.across * 8)
        return np.clip(np.round(whole + 128), 0, 255)[: self.high, : self.wide]


def _units(planes: list[_Plane], w: int, h: int, most_h: int, most_v: int) -> list[list[tuple[_Plane, int]]]:
    """What is coded in turn between restarts is counted in these: the blocks of each."""
    if len(planes) == 1:
        return [[(planes[0], i)] for i in planes[0].order()]
    rows, cols = -(-h // (8 * most_v)), -(-w // (8 * most_h))
    return [[(p, (y * p.v + v) * p.across + x * p.h + u) for p in planes for v in range(p.v) for u in range(p.h)] for y in range(rows) for x in range(cols)]


class _Scan:
    """One scan's coding: the band of coefficients, and the bits that earlier and this scan leave out."""

    def __init__(self, band: tuple[int, int], high: int, low: int, tables: dict, progressive: bool):
        (self.first, self.last), self.low, self.tables = band, low, tables
        self.skip = 0
        self.step = (self.whole if not progressive else (self.mean if not high else self.mean_bit) if not self.first else self.rest if not high else self.rest_bit)

    def whole(self, s: _Stream, p: _Plane, at: int) -> None:
        self.mean(s, p, at)
        table, values, k = self.tables[1, p.ac], p.values, 1
        while k < 64:
            v = s.symbol(table)
            run, n = v >> 4, v & 15
            if n:
                k += run
                values[at + k] = s.signed(n)
                k += 1
            elif run == 15:
                k += 16
            else:
                break

    def mean(self, s: _Stream, p: _Plane, at: int) -> None:
        p.mean += s.signed(s.symbol(self.tables[0, p.dc]))
        p.values[at] = p.mean << self.low

    def mean_bit(self, s: _Stream, p: _Plane, at: int) -> None:
        p.values[at] |= s.take(1) << self.low

    def rest(self, s: _Stream, p: _Plane, at: int) -> None:
        if self.skip:
            self.skip -= 1
            return
        table, values, k = self.tables[1, p.ac], p.values, self.first
        while k <= self.last:
            v = s.symbol(table)
            run, n = v >> 4, v & 15
            if n:
                k += run
                values[at + k] = s.signed(n) << self.low
                k += 1
            elif run == 15:
                k += 16
            else:
                self.skip = (1 << run) - 1 + s.take(run)
                break

    def rest_bit(self, s: _Stream, p: _Plane, at: int) -> None:
        """Known coefficients get one bit more; new ones appear after a run of those still zero."""
        values, one = p.values, 1 << self.low
        k = self.first

        def more(i: int) -> None:
            if s.take(1) and not abs(values[i]) & one:
                values[i] += one if values[i] > 0 else -one

        while k <= self.last and not self.skip:
            v = s.symbol(self.tables[1, p.ac])
            run, n = v >> 4, v & 15
            new = 0
            if n:
                new = one if s.take(1) else -one
            elif run < 15:
                self.skip = (1 << run) + s.take(run)
                break
            while k <= self.last:
                i = at + k
                k += 1
                if values[i]:
                    more(i)
                elif run:
                    run -= 1
                else:
                    values[i] = new
                    break
        if self.skip:
            for i in range(at + k, at + self.last + 1):
                if values[i]:
                    more(i)
            self.skip -= 1


def _wider(plane: np.ndarray, times: float, axis: int, size: int) -> np.ndarray:
    """A plane at the picture's size: twice as many by weights of 3 and 1, otherwise by the nearest."""
    if times == 2:
        a = np.moveaxis(plane, axis, 0)
        far = np.concatenate([a[:1], a, a[-1:]])
        out = np.stack([3 * a + far[:-2], 3 * a + far[2:]], 1).reshape(2 * len(a), *a.shape[1:]) / 4
        plane = np.moveaxis(out, 0, axis)
    elif times != 1:
        plane = np.take(plane, (np.arange(size) / times).astype(int), axis)
    return np.take(plane, np.arange(size), axis)


def decode_jpeg(data: bytes) -> np.ndarray:
    """Rows of RGB bytes: sequential and progressive pictures of 8 bits a sample with Huffman codes, of gray, YCbCr, RGB
    or four inks. Transforms are exact and then rounded, so a value may be one off from a decoder with whole numbers."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, steps, tables, planes, restart, adobe, progressive = 2, {}, {}, {}, 0, None, False
    w = h = most_h = most_v = 0
    scans = 0
    while at + 4 <= len(data):
        if data[at] != 0xFF or data[at + 1] in (0x00, 0xFF):
            at += 1
            continue
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        n = struct.unpack_from(">H", data, at + 2)[0]
        part = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while part:
                wide = part[0] >> 4
                steps[part[0] & 15] = np.frombuffer(part, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                part = part[129 if wide else 65 :]
        elif marker == 0xC4:
            while part:
                size = sum(part[1:17])
                tables[part[0] >> 4, part[0] & 15] = _lookup(part[1:17], part[17 : 17 + size])
                part = part[17 + size :]
        elif marker in (0xC0, 0xC1, 0xC2):
            bits, h, w, count = struct.unpack_from(">BHHB", part)
            if bits != 8 or not w or not h or count not in (1, 3, 4):
                raise ValueError("a JPEG of an unknown kind")
            progressive = marker == 0xC2
            planes = {part[6 + 3 * i]: _Plane(part[7 + 3 * i] >> 4, part[7 + 3 * i] & 15, part[8 + 3 * i]) for i in range(count)}
            most_h, most_v = max(p.h for p in planes.values()), max(p.v for p in planes.values())
            for p in planes.values():
                p.sized(w, h, most_h, most_v)
        elif 0xC3 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("a JPEG of an unknown kind")
        elif marker == 0xDD:
            restart = struct.unpack(">H", part[:2])[0]
        elif marker == 0xEE and part[:5] == b"Adobe":
            adobe = part[11]
        elif marker == 0xDA:
            own = []
            for i in range(part[0]):
                p = planes[part[1 + 2 * i]]
                p.dc, p.ac = part[2 + 2 * i] >> 4, part[2 + 2 * i] & 15
                own.append(p)
            first, last, bits = part[1 + 2 * part[0] :][:3]
            ends = [m.start() for m in _MARKS.finditer(data, at)]
            stop = next((e for e in ends if not 0xD0 <= data[e + 1] <= 0xD7), len(data))
            cuts = [at, *[e for e in ends if e < stop], stop]
            scan = _Scan((first, last), bits >> 4, bits & 15, tables, progressive)
            units = _units(own, w, h, most_h, most_v)
            each = restart or len(units)
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                stream, scan.skip = _Stream(data[a + 2 * (i > 0) : b]), 0
                for p in own:
                    p.mean = 0
                for unit in units[i * each : (i + 1) * each]:
                    for p, block in unit:
                        scan.step(stream, p, 64 * block)
            scans += 1
            at = stop
    if not planes or not scans:
        raise ValueError("a JPEG without pixels")
    found = [_wider(_wider(p.pixels(steps[p.table]), most_v / p.v, 0, h), most_h / p.h, 1, w) for p in planes.values()]
    if len(found) == 1:
        return np.repeat(found[0].astype(np.uint8)[:, :, None], 3, 2)
    ids = bytes(planes)
    if adobe in (1, 2) or (adobe is None and len(found) == 3 and ids != b"RGB"):
        y, cb, cr = found[0], found[1] - 128, found[2] - 128
        found[:3] = [y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb]
    out = np.clip(np.round(np.stack(found, 2)), 0, 255)
    if len(found) == 4:
        out = np.round(out[:, :, :3] * out[:, :, 3:] / 255)
    return out.astype(np.uint8)
