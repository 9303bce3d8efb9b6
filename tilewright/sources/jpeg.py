"""JPEG images of 8 bits: sequential Huffman decoding, and an encoder with tables fitted to the image.

Coefficients of a scan are found one after the other, as the format has it, with tables that take 16 bits to a
coefficient at once; dequantising, the inverse cosine transform and colours are then done for all blocks together.
Reads grey, YCbCr and RGB at any whole sampling ratio, restart intervals, scans of one or more components, and
abbreviated streams with tables of their own, as tiles of a TIFF file are.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

_MARKER = re.compile(rb"\xff+([\x01-\xcf\xd8-\xfe])")
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")
#: Zigzag order: by diagonals, up and down in turn.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_FREQUENCY = np.arange(8)
#: Rows are the cosine basis, orthonormal.
COSINE = np.cos((2 * np.arange(8)[None, :] + 1) * _FREQUENCY[:, None] * np.pi / 16) * np.where(_FREQUENCY[:, None] == 0, np.sqrt(1 / 8), 0.5)


@dataclass
class _Component:
    name: int
    h: int
    v: int
    table: int
    rows: int = 0
    columns: int = 0
    coefficients: np.ndarray | None = None


@dataclass
class _Tables:
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    restart: int = 0
    transform: int | None = None


@lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """For each 16 bits: the length of the code they begin with (0 if none), and its symbol."""
    lengths, values = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = at = 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            low = code << (16 - n)
            if at >= len(symbols) or low >= 1 << 16:
                raise ValueError("damaged JPEG image: codes")
            lengths[low : low + (1 << (16 - n))], values[low : low + (1 << (16 - n))] = n, symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return lengths.tolist(), values.tolist()


@lru_cache(maxsize=64)
def _steps(counts: bytes, symbols: bytes) -> tuple[list[int], list[int], list[int]]:
    """For each 16 bits of other coefficients: bits taken, places gone on, and the value; no bits where it takes more than 16."""
    lengths, values = (np.array(x) for x in _lookup(counts, symbols))
    run, size = values >> 4, values & 15
    bits = np.arange(1 << 16)
    total = lengths + size
    ok = (lengths > 0) & (total <= 16)
    raw = (bits >> np.clip(16 - total, 0, 16)) & ((1 << size) - 1)
    value = np.where(size == 0, 0, np.where(raw < (1 << np.maximum(size - 1, 0)), raw - (1 << size) + 1, raw))
    # without a value: 16 zeros, or no more in the block
    jump = np.where(size == 0, np.where(run == 15, 16, 64), run + 1)
    return np.where(ok, total, 0).tolist(), jump.tolist(), value.tolist()


def _windows(data: bytes) -> list[int]:
    """40 bits from each byte on."""
    a = np.frombuffer(data + bytes(8), np.uint8).astype(np.int64)
    n = len(data) + 4
    return (a[:n] << 32 | a[1 : n + 1] << 24 | a[2 : n + 2] << 16 | a[3 : n + 3] << 8 | a[4 : n + 4]).tolist() if n + 4 <= len(a) else []


def _read_tables(marker: int, body: bytes, tables: _Tables) -> None:
    if marker == 0xDB:
        while body:
            wide, name = body[0] >> 4, body[0] & 15
            size = 128 if wide else 64
            tables.quantisers[name] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.float64)
            body = body[1 + size :]
    elif marker == 0xC4:
        while body:
            many = sum(body[1:17])
            tables.codes[body[0]] = body[1:17], body[17 : 17 + many]
            body = body[17 + many :]
    elif marker == 0xDD:
        tables.restart = struct.unpack(">H", body[:2])[0]
    elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
        tables.transform = body[11]


def _scan(data: bytes, parts: list[tuple[_Component, int, int]], frame: tuple[int, int, int, int], tables: _Tables) -> None:
    """Decode one scan's coefficients into its components."""
    w, h, h_most, v_most = frame
    single = len(parts) == 1
    if single:  # only the blocks that the image needs, in their own order
        c = parts[0][0]
        across, down = -(-(-(-w * c.h // h_most)) // 8), -(-(-(-h * c.v // v_most)) // 8)
    else:
        across, down = -(-w // (8 * h_most)), -(-h // (8 * v_most))
    units = across * down
    per = tables.restart or units
    pieces = _RESTART.split(data)
    plan = []
    for c, dc, ac in parts:
        if dc not in tables.codes or 16 + ac not in tables.codes:
            raise ValueError("damaged JPEG image: a scan's codes are missing")
        plan.append((c, 1 if single else c.h, 1 if single else c.v, _lookup(*tables.codes[dc]), _lookup(*tables.codes[16 + ac]), _steps(*tables.codes[16 + ac])))
    places: list[list[int]] = [[] for _ in parts]
    values: list[list[int]] = [[] for _ in parts]
    for number, low in enumerate(range(0, units, per)):
        if number >= len(pieces):
            raise ValueError("damaged JPEG image: it ends early")
        piece = pieces[number].replace(b"\xff\x00", b"\xff")
        bits, p, most = _windows(piece), 0, 8 * len(piece)
        before = [0] * len(parts)
        for unit in range(low, min(low + per, units)):
            y, x = divmod(unit, across)
            for k, (c, wide, high, (dc_bits, dc_size), (ac_bits, ac_size), (many, jump, value)) in enumerate(plan):
                at, out = places[k], values[k]
                for j in range(high):
                    for i in range(wide):
                        base = ((y * high + j) * c.columns + x * wide + i) * 64
                        window = (bits[p >> 3] >> (24 - (p & 7))) & 65535
                        if not dc_bits[window]:
                            raise ValueError("damaged JPEG image: no such code")
                        p += dc_bits[window]
                        size = dc_size[window]
                        if size:
                            v = (bits[p >> 3] >> (40 - (p & 7) - size)) & ((1 << size) - 1)
                            p += size
                            before[k] += v if v >> (size - 1) else v - (1 << size) + 1
                        at.append(base)
                        out.append(before[k])
                        place = 1
                        while place < 64:
                            window = (bits[p >> 3] >> (24 - (p & 7))) & 65535
                            n = many[window]
                            if n:
                                p += n
                                place += jump[window]
                                v = value[window]
                                if not v:
                                    continue
                            else:
                                n = ac_bits[window]
                                if not n:
                                    raise ValueError("damaged JPEG image: no such code")
                                size = ac_size[window] & 15
                                place += (ac_size[window] >> 4) + 1
                                p += n
                                v = (bits[p >> 3] >> (40 - (p & 7) - size)) & ((1 << size) - 1)
                                p += size
                                v = v if v >> (size - 1) else v - (1 << size) + 1
                            if place > 64:
                                raise ValueError("damaged JPEG image: a block is too long")
                            at.append(base + place - 1)
                            out.append(v)
                        if p > most:
                            raise ValueError("damaged JPEG image: it ends early")
    for (c, _, _), at, out in zip(parts, places, values, strict=True):
        c.coefficients[np.array(at, np.int64)] = out


def _plane(c: _Component, quantiser: np.ndarray) -> np.ndarray:
    """Samples of all blocks of a component, as levels around 0 that are not yet rounded."""
    blocks = np.empty((c.rows * c.columns, 64))
    blocks[:, ZIGZAG] = c.coefficients.reshape(-1, 64) * quantiser
    pixels = COSINE.T @ blocks.reshape(-1, 8, 8) @ COSINE
    return pixels.reshape(c.rows, c.columns, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.columns * 8)


def _widened(plane: np.ndarray, factor: int, axis: int) -> np.ndarray:
    """Samples between samples: at a factor of 2 a weighting of the two nearest, else the nearest."""
    if factor == 1:
        return plane
    if factor != 2:
        return np.repeat(plane, factor, axis=axis)
    plane = np.moveaxis(plane, axis, 0)
    padded = np.concatenate([plane[:1], plane, plane[-1:]])
    out = np.empty((2 * len(plane), *plane.shape[1:]))
    out[0::2], out[1::2] = (3 * plane + padded[:-2]) / 4, (3 * plane + padded[2:]) / 4
    return np.moveaxis(out, 0, axis)


def decode(data: bytes, tables: bytes = b"", rgb: bool | None = None) -> np.ndarray:
    """An image as h x w x 1 or h x w x 3.

    ``tables`` is a stream of tables that ``data`` leaves out. Three components are YCbCr, unless ``rgb`` or the stream says
    otherwise. ValueError for damaged data and for progressive, arithmetic, lossless, 12-bit and four-component images.
    """
    known = _Tables()
    components: list[_Component] = []
    size = None
    for stream in (tables, data):
        if not stream:
            continue
        if stream[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG image")
        at = 2
        while found := _MARKER.search(stream, at):
            marker, at = found[1][0], found.end()
            if marker == 0xD9:
                break
            if marker == 1:
                continue
            length = struct.unpack(">H", stream[at : at + 2].ljust(2, b"\0"))[0]
            body, at = stream[at + 2 : at + length], at + length
            if length < 2 or len(body) < length - 2:
                raise ValueError("damaged JPEG image: it ends early")
            if marker in (0xC0, 0xC1):
                bits, h, w, n = struct.unpack(">BHHB", body[:6])
                if bits != 8 or n not in (1, 3) or not h or not w:
                    raise ValueError("only JPEG images of 8 bits with one or three components")
                components = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if not all(1 <= c.h <= 4 and 1 <= c.v <= 4 for c in components):
                    raise ValueError("damaged JPEG image: sampling")
                if n == 1:
                    components[0].h = components[0].v = 1
                size = w, h, max(c.h for c in components), max(c.v for c in components)
                if any(size[2] % c.h or size[3] % c.v for c in components):
                    raise ValueError("only JPEG images of whole sampling ratios")
                for c in components:
                    c.rows, c.columns = -(-h // (8 * size[3])) * c.v, -(-w // (8 * size[2])) * c.h
                    c.coefficients = np.zeros(c.rows * c.columns * 64, np.int32)
            elif marker in (0xC2, 0xC6, 0xCA, 0xCE):
                raise ValueError("progressive JPEG images are not read")
            elif 0xC3 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only sequential JPEG images with Huffman codes are read")
            elif marker == 0xDA:
                by = {c.name: c for c in components}
                try:
                    parts = [(by[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                except KeyError:
                    raise ValueError("damaged JPEG image: a scan of no component") from None
                end = _MARKER.search(stream, at)
                entropy = stream[at : end.start() if end else len(stream)]
                try:
                    _scan(entropy, parts, size, known)
                except IndexError:
                    raise ValueError("damaged JPEG image: it ends early") from None
                at += len(entropy)
            else:
                _read_tables(marker, body, known)
    if size is None:
        raise ValueError("damaged JPEG image: no frame")
    w, h, h_most, v_most = size
    planes = []
    for c in components:
        if c.table not in known.quantisers:
            raise ValueError("damaged JPEG image: no quantisers")
        plane = _plane(c, known.quantisers[c.table])[: -(-h * c.v // v_most), : -(-w * c.h // h_most)]
        # samples are whole levels before they are widened and mixed
        plane = np.clip(np.rint(plane + 128), 0, 255)
        planes.append(_widened(_widened(plane, v_most // c.v, 0), h_most // c.h, 1)[:h, :w])
    if len(planes) == 3 and not (rgb if rgb is not None else known.transform == 0 or (known.transform is None and [c.name for c in components] == list(b"RGB"))):
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        # fixed values: the format's colour weights
        planes = [y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb]
    return np.clip(np.rint(np.stack(planes, axis=2)), 0, 255).astype(np.uint8)


def _code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of a prefix code of at most 16 bits in which no code is all ones."""
    counts = {**counts, -1: 0}  # takes the code of all ones
    while True:
        heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0])))]
        lengths = dict.fromkeys(counts, 0)
        heapq.heapify(heap)
        serial = len(heap)
        while len(heap) > 1:
            (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            for s in a + b:
                lengths[s] += 1
            heapq.heappush(heap, (n + m, serial, a + b))
            serial += 1
        if max(lengths.values()) <= 16:
            return {s: max(n, 1) for s, n in lengths.items()}
        counts = {s: n if s < 0 else (n + 1) // 2 + 1 for s, n in counts.items()}  # flatter


@lru_cache(maxsize=1024)
def _codes(counts: tuple[tuple[int, int], ...]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """The table as it is written, and (code, bits) of each symbol, from each symbol's number; small images often have the same."""
    lengths = _code_lengths(dict(counts))
    # the one for all ones comes last among the longest
    order = sorted(lengths, key=lambda s: (lengths[s], s < 0, s))
    if order[-1] >= 0:  # it is shorter: trade places, which keeps the code whole
        lengths[order[-1]], lengths[-1] = lengths[-1], lengths[order[-1]]
        order = sorted(lengths, key=lambda s: (lengths[s], s < 0, s))
    code, before, out = 0, lengths[order[0]], {}
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        out[s] = code, before
        code += 1
    out.pop(-1)
    real = [s for s in order if s >= 0]
    return bytes(sum(lengths[s] == n for s in real) for n in range(1, 17)), bytes(real), out


@lru_cache(maxsize=64)
def quantiser(step: float) -> np.ndarray:
    """64 divisors that grow with frequency; all 1 at a step of 0."""
    u = np.arange(64) // 8 + np.arange(64) % 8
    return np.clip(np.rint(1 + step * (1 + u / 2)), 1, 255)


def encode(image: np.ndarray, step: float = 2.0, chroma: int = 1, restart: int = 0, abbreviated: bool = False) -> bytes | tuple[bytes, bytes]:
    """A baseline stream of an h x w x 1 or h x w x 3 image; a pair of tables and the rest if ``abbreviated``.

    Three channels become YCbCr, with colours at every ``chroma``-th sample (1 or 2) either way; ``restart`` units form an interval.
    """
    h, w, n = image.shape
    if n not in (1, 3) or not h or not w or max(h, w) > 65535 or chroma not in (1, 2):
        raise ValueError("an image of one or three channels and at most 65535 pixels a side")
    planes = [image[:, :, i].astype(np.float64) for i in range(n)]
    if n == 3:
        r, g, b = planes
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    most = chroma if n == 3 else 1
    across, down = -(-w // (8 * most)), -(-h // (8 * most))
    divisors, blocks, ratio = quantiser(step), [], [(most, most)] + [(1, 1)] * (n - 1)
    for plane, (wide, high) in zip(planes, ratio, strict=True):
        plane = np.pad(plane, ((0, down * 8 * most - h), (0, across * 8 * most - w)), mode="edge")
        if most > wide:
            plane = plane.reshape(plane.shape[0] // 2, 2, plane.shape[1] // 2, 2).mean(axis=(1, 3))
        own = (plane - 128).reshape(down * high, 8, across * wide, 8).transpose(0, 2, 1, 3)
        blocks.append(np.rint((COSINE @ own @ COSINE.T).reshape(down * high, across * wide, 64) / divisors)[:, :, ZIGZAG].astype(np.int64))
    # symbols in the order of the scan: (table, symbol, extra bits, their number)
    events: list[tuple[int, int, int, int]] = []
    ends, before = [], [0] * n
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            ends.append(len(events))
            before = [0] * n
        y, x = divmod(unit, across)
        for k, (wide, high) in enumerate(ratio):
            for j in range(high):
                for i in range(wide):
                    block = blocks[k][y * high + j, x * wide + i].tolist()
                    v, before[k] = block[0] - before[k], block[0]
                    size = abs(v).bit_length()
                    events.append((0, size, v if v >= 0 else v + (1 << size) - 1, size))
                    run = 0
                    for v in block[1 : max((p for p in range(64) if block[p]), default=0) + 1]:
                        if not v:
                            run += 1
                            continue
                        events += [(1, 0xF0, 0, 0)] * (run // 16)
                        size = abs(v).bit_length()
                        events.append((1, run % 16 << 4 | size, v if v >= 0 else v + (1 << size) - 1, size))
                        run = 0
                    if not block[63]:
                        events.append((1, 0, 0, 0))
    used = [Counter(s for t, s, _, _ in events if t == k) for k in range(2)]
    tables = [_codes(tuple(sorted(c.items()))) for c in used]
    scans = []
    for low, high in zip([0, *ends], [*ends, len(events)], strict=True):
        text = "".join(f"{tables[t][2][s][0]:0{tables[t][2][s][1]}b}" + (f"{extra:0{size}b}" if size else "") for t, s, extra, size in events[low:high])
        text += "1" * (-len(text) % 8)
        scans.append(int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00"))

    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    first = segment(0xDB, b"\0" + divisors[ZIGZAG].astype(np.uint8).tobytes())
    first += b"".join(segment(0xC4, bytes([kind << 4]) + counts + symbols) for kind, (counts, symbols, _) in enumerate(tables))
    rest = segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([k + 1, wide << 4 | high, 0]) for k, (wide, high) in enumerate(ratio)))
    if restart:
        rest += segment(0xDD, struct.pack(">H", restart))
    rest += segment(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\0\x3f\0")
    rest += b"".join((bytes([0xFF, 0xD0 + (i - 1) % 8]) if i else b"") + s for i, s in enumerate(scans))
    if abbreviated:
        return b"\xff\xd8" + first + b"\xff\xd9", b"\xff\xd8" + rest + b"\xff\xd9"
    return b"\xff\xd8" + first + rest + b"\xff\xd9"
