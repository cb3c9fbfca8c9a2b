"""Baseline JPEG with numpy: a lossless carrier for bytes, a parser and a Huffman decoder, and thumbnails from DC coefficients alone.

The decoder follows the public standard (ITU-T T.81, sequential DCT, Huffman): any restart intervals, any tables, any sampling factors, one
or several scans. It decodes all restart intervals of many images at once, a symbol of each at a step, so the work per symbol is a few numpy
operations over long arrays. The writer stores a byte as a quantised coefficient, its value less 128, in zigzag order: 192 bytes make the
three blocks of a 4:4:4 unit. Nothing is rounded, so the bytes come back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

#: Units (of 192 bytes) in a restart interval.
INTERVAL = 8
UNIT = 192
#: Bytes that are coded or decoded together at most, about.
GROUP = 3_000_000


def dc_symbols() -> dict[int, int]:
    """Code lengths by symbol, for differences of DC coefficients: 12 sizes of 4 bits."""
    return {size: 4 for size in range(12)}


def ac_symbols() -> dict[int, int]:
    """Code lengths by symbol (run * 16 + size): short ones for the sizes of letters, digits and spaces without zeros before."""
    lengths = {5: 1, 7: 2, 4: 3, 3: 5, 6: 5, 1: 7, 2: 7, 8: 7}
    for run in range(16):
        for size in range(1, 9):
            lengths.setdefault(run * 16 + size, 13)
    return lengths | {0x00: 13, 0xF0: 13}


def canonical(lengths: dict[int, int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in the order of a DHT segment."""
    out, code, last = [], 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        out.append((s, code, n))
        code, last = code + 1, n
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _dht(cls: int, lengths: dict[int, int]) -> bytes:
    table = canonical(lengths)
    counts = bytes(sum(n == k for _, _, n in table) for k in range(1, 17))
    return _segment(0xC4, bytes([cls << 4]) + counts + bytes(s for s, _, _ in table))


def _code_arrays(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    codes, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, c, n in canonical(lengths):
        codes[s], bits[s] = c, n
    return codes, bits


_DC_CODE, _DC_BITS = _code_arrays(dc_symbols())
_AC_CODE, _AC_BITS = _code_arrays(ac_symbols())
_SIZE = np.array([int(abs(v)).bit_length() for v in range(-256, 257)])


def encode_intervals(payload: np.ndarray) -> list[bytes]:
    """The entropy-coded data of each restart interval, stuffed, for bytes that fill whole units."""
    units = len(payload) // UNIT
    coef = payload.reshape(units * 3, 64).astype(np.int64) - 128
    interval = np.arange(units * 3) // (3 * INTERVAL)
    diff = coef[:, 0].copy()
    same = interval[3:] == interval[:-3]
    diff[3:] -= np.where(same, coef[:-3, 0], 0)
    # 65 entries a block: DC, 63 AC, end of block; a zero has no bits of its own
    code = np.zeros((len(coef), 65), np.int64)
    bits = np.zeros((len(coef), 65), np.int64)
    size = _SIZE[diff + 256]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    code[:, 0], bits[:, 0] = (_DC_CODE[size] << size) | extra, _DC_BITS[size] + size
    ac = coef[:, 1:]
    size = _SIZE[ac + 256]
    extra = np.where(ac < 0, ac + (1 << size) - 1, ac)
    there = ac != 0
    at = np.where(there, np.arange(1, 64), 0)
    before = np.maximum.accumulate(at, axis=1)
    run = np.arange(1, 64) - 1 - np.concatenate([np.zeros((len(coef), 1), np.int64), before[:, :-1]], axis=1)
    symbol = (run & 15) * 16 + size
    n = _AC_BITS[symbol] + size
    c = (_AC_CODE[symbol] << size) | extra
    for _ in range(3):  # up to three codes for sixteen zeros go before
        longer = there & (run >= 16)
        if not longer.any():
            break
        c = np.where(longer, c | (_AC_CODE[0xF0] << n), c)
        n = np.where(longer, n + _AC_BITS[0xF0], n)
        run = np.where(longer, run - 16, run)
    code[:, 1:64], bits[:, 1:64] = np.where(there, c, 0), np.where(there, n, 0)
    ends = before[:, -1] < 63
    code[:, 64], bits[:, 64] = np.where(ends, _AC_CODE[0], 0), np.where(ends, _AC_BITS[0], 0)
    # each interval starts on a byte; what is left of its last byte are ones
    total = np.bincount(interval, weights=bits.sum(axis=1)).astype(np.int64)
    size_bytes = (total + 7) // 8
    base = np.concatenate([[0], np.cumsum(size_bytes)])
    flat = bits.ravel()
    run_bits = np.cumsum(flat) - flat
    first = np.concatenate([[0], np.cumsum(total)[:-1]])
    offset = run_bits + np.repeat((base[:-1] * 8 - first)[interval], 65)
    used = flat > 0
    codes, lengths, offset = code.ravel()[used], flat[used], offset[used]
    fill = size_bytes * 8 - total
    codes = np.concatenate([codes, (1 << fill) - 1])
    lengths = np.concatenate([lengths, fill])
    offset = np.concatenate([offset, base[:-1] * 8 + total])
    out = np.zeros(int(base[-1]) + 16, np.float64)
    # entries of up to 24 bits lie in 4 bytes; longer ones, with many zeros before, go in parts
    while len(codes):
        part = np.minimum(lengths, 24)
        head = codes >> (lengths - part)
        window = head << (32 - part - (offset & 7))
        for k in range(4):
            out += np.bincount((offset >> 3) + k, weights=(window >> (24 - 8 * k)) & 255, minlength=len(out))[: len(out)]
        more = lengths > 24
        codes, lengths, offset = (codes & ((1 << (lengths - part)) - 1))[more], (lengths - part)[more], (offset + part)[more]
    data = out.astype(np.uint8).tobytes()
    return [data[base[k] : base[k + 1]].replace(b"\xff", b"\xff\x00") for k in range(len(total))]


def grid(units: int) -> tuple[int, int]:
    """Width and height, in units, of an image for so many."""
    w = int(np.ceil(np.sqrt(units)))
    return w, -(-units // w)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload, of a positive multiple of 192 bytes."""
    pieces, owners = [], []
    for k, p in enumerate(payloads):
        w, h = grid(len(p) // UNIT)
        full = np.concatenate([np.frombuffer(p, np.uint8), np.full(w * h * UNIT - len(p), 128, np.uint8)])
        step = max(1, GROUP // (UNIT * INTERVAL)) * UNIT * INTERVAL
        for at in range(0, len(full), step):
            pieces.append(full[at : at + step])
            owners.append(k)
    found: list[list[bytes]] = [[] for _ in payloads]
    start = 0
    while start < len(pieces):
        # pieces that end within an interval are filled up, so that those after them start with one; what is filled is cut off again
        end, held, parts, counts = start, 0, [], []
        while end < len(pieces) and (end == start or held + len(pieces[end]) <= GROUP):
            n = len(pieces[end]) // UNIT
            held += len(pieces[end])
            counts.append(n)
            end += 1
        for n in set(counts):
            same = [k for k in range(start, end) if counts[k - start] == n]
            whole, rest = divmod(n, INTERVAL)
            if whole:
                some = encode_intervals(np.concatenate([pieces[k][: whole * INTERVAL * UNIT] for k in same]))
                for i, k in enumerate(same):
                    found[owners[k]] += some[i * whole : (i + 1) * whole]
            if rest:
                for k in same:
                    parts.append((k, pieces[k][whole * INTERVAL * UNIT :]))
        for rest in {len(p) for _, p in parts}:
            same = [(k, p) for k, p in parts if len(p) == rest]
            for (k, _), data in zip(same, _short(np.stack([p for _, p in same])), strict=True):
                found[owners[k]].append(data)
        start = end
    return [_file(p, f) for p, f in zip(payloads, found, strict=True)]


def _short(rows: np.ndarray) -> list[bytes]:
    """Intervals of fewer units: filled up with empty units whose codes, of known bits, are cut off."""
    out = []
    for row in rows:
        out += encode_intervals(row)
    return out


def _file(payload: bytes, intervals: list[bytes]) -> bytes:
    w, h = grid(len(payload) // UNIT)
    head = b"\xff\xd8" + _segment(0xFE, b"payload-bytes=%d" % len(payload)) + _segment(0xDB, b"\0" + bytes([8] + [1] * 63))
    head += _segment(0xC0, b"\x08" + (h * 8).to_bytes(2, "big") + (w * 8).to_bytes(2, "big") + b"\x03" + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3)))
    head += _dht(0, dc_symbols()) + _dht(1, ac_symbols()) + _segment(0xDD, INTERVAL.to_bytes(2, "big")) + _segment(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0")
    parts = [head]
    for k, data in enumerate(intervals):
        if k:
            parts.append(bytes([0xFF, 0xD0 + (k - 1) % 8]))
        parts.append(data)
    return b"".join([*parts, b"\xff\xd9"])


@dataclass
class Scan:
    components: list[int]
    tables: list[tuple[bytes, bytes]]
    segments: list[bytes]
    restart: int


@dataclass
class Image:
    width: int = 0
    height: int = 0
    #: (identifier, horizontal and vertical factor, number of the quantisation table)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)
    quantisation: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    #: For each component its blocks in raster order, as far as the scan goes: rows x columns x 64, in zigzag order.
    blocks: dict[int, np.ndarray] = field(default_factory=dict)


_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")
_MARKER = re.compile(rb"\xff+([\x01-\xcf\xd8-\xfe])", re.S)


def parse(data: bytes) -> Image:
    """The markers of a baseline file. ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, at, restart = Image(), 2, 0
    dht: dict[tuple[int, int], bytes] = {}
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            break
        marker, at = data[at], at + 1
        if marker == 0xD9:
            break
        n = int.from_bytes(data[at : at + 2], "big")
        body, at = data[at + 2 : at + n], at + n
        if n < 2 or len(body) != n - 2:
            raise ValueError("a segment is cut short")
        if marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                k = 128 if wide else 64
                image.quantisation[number] = np.frombuffer(body[1 : 1 + k], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + k :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                dht[body[0] >> 4, body[0] & 15] = body[1 : 17 + total]
                body = body[17 + total :]
        elif marker == 0xC0 or marker == 0xC1:
            if body[0] != 8:
                raise ValueError("samples of 8 bits only")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not sequential Huffman coding")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if not image.components:
                raise ValueError("a scan before the frame")
            end = _MARKER.search(data, at)
            stop = end.start() if end else len(data)
            names = [c[0] for c in image.components]
            order, tables = [], []
            for k in range(body[0]):
                order.append(names.index(body[1 + 2 * k]))
                t = body[2 + 2 * k]
                if (0, t >> 4) not in dht or (1, t & 15) not in dht:
                    raise ValueError("a scan without its tables")
                tables.append((dht[0, t >> 4], dht[1, t & 15]))
            image.scans.append(Scan(order, tables, [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(data[at:stop])], restart))
            at = stop
    if not image.scans:
        raise ValueError("no scan")
    return image


_LUTS: dict[bytes, np.ndarray] = {}


def _lut(table: bytes) -> np.ndarray:
    """For each 16 bits: the length of the code they start with, the run and the size, in one number; 0 where there is none."""
    if table not in _LUTS:
        if len(_LUTS) > 64:
            _LUTS.clear()
        out, code, at = np.zeros(1 << 16, np.int64), 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                s = table[at]
                out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
                code, at = code + 1, at + 1
            code <<= 1
        _LUTS[table] = out
    return _LUTS[table]


def decode_lanes(segments: list[bytes], counts: np.ndarray, pattern: np.ndarray, tables: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Coefficients, lanes x blocks x 64, of segments that start anew. counts: blocks of each; pattern: the table pair of each block of a unit."""
    gap = b"\xff" * 8
    buffer = np.frombuffer(gap.join(segments) + gap * 2, np.uint8).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum([len(s) + 8 for s in segments])[:-1]])
    window = (buffer[:-4] << 32) | (buffer[1:-3] << 24) | (buffer[2:-2] << 16) | (buffer[3:-1] << 8) | buffer[4:]
    luts = np.concatenate([_lut(t) for pair in tables for t in pair])
    most = int(counts.max())
    out = np.zeros(len(segments) * most * 64, np.int16)
    lane = np.arange(len(segments))
    lane, left = lane[counts > 0], counts[counts > 0].astype(np.int64)
    pos, limit = starts[lane] * 8, (starts + np.array([len(s) for s in segments]) + 4)[lane] * 8
    base, k, done = lane * most * 64, np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    n_pattern = len(pattern)
    dc_table = pattern * (2 << 16)
    table = np.full(len(lane), dc_table[0])
    while len(lane):
        shift = pos & 7
        w = window[pos >> 3]
        entry = luts[table + ((w >> (24 - shift)) & 0xFFFF)]
        symbol = entry & 255
        is_dc = k == 0
        size = np.where(is_dc, symbol, symbol & 15)
        if not entry.all() or (size > 15).any():
            raise ValueError("no such code")
        k += np.where(is_dc, 0, symbol >> 4)
        total = (entry >> 8) + size
        one = np.int64(1) << size
        extra = (w >> (40 - shift - total)) & (one - 1)
        value = np.where(extra * 2 < one, extra - one + 1, extra)
        if (k > 63).any():
            raise ValueError("a block is too long")
        # without a size, nothing is there (a zero is written over a zero)
        out[base + k] = np.where(size > 0, value, 0)
        pos += total
        k += 1
        ended = (k > 63) | ((symbol == 0) & ~is_dc)
        if ended.any():
            if (pos > limit).any():
                raise ValueError("a segment is cut short")
            done += ended
            base += ended * 64
            k[ended] = 0
            over = done >= left
            if over.any():
                go = ~over
                left, pos, limit, base, k, done, table = left[go], pos[go], limit[go], base[go], k[go], done[go], table[go]
                lane = lane[go]
        table = dc_table[done % n_pattern] + np.where(k == 0, 0, 1 << 16)
    return out.reshape(len(segments), most, 64)


def decode(files: list[bytes]) -> list[Image | ValueError]:
    """Parsed images with their coefficients; for a file that can't be read, why. Files with equal tables are decoded together."""
    images: list = []
    jobs: dict[tuple, list] = {}
    for k, data in enumerate(files):
        try:
            image = parse(data)
            for scan in image.scans:
                units, pattern, restart = _layout(image, scan)
                need = -(-units // restart) if restart else 1
                if len(scan.segments) < need:
                    raise ValueError("restart intervals are missing")
                jobs.setdefault((tuple(scan.tables), pattern), []).append((k, scan, units, restart or units, need))
        except (ValueError, IndexError, KeyError) as error:
            image = ValueError(str(error))
        images.append(image)
    for (tables, pattern), some in jobs.items():
        parts, held = [], 0
        for job in [*some, None]:
            if parts and (job is None or held > GROUP):
                _decode_group(images, parts, tables, pattern)
                parts, held = [], 0
            if job is not None and not isinstance(images[job[0]], ValueError):
                parts.append(job)
                held += sum(map(len, job[1].segments))
    return images


def _layout(image: Image, scan: Scan) -> tuple[int, tuple[int, ...], int]:
    """Units in a scan, the component (by place in the scan) of each block of a unit, and units between restarts."""
    if not image.width or not image.height:
        raise ValueError("no size")
    hs, vs = max(c[1] for c in image.components), max(c[2] for c in image.components)
    if len(scan.components) == 1:
        _, h, v, _ = image.components[scan.components[0]]
        cols, rows = -(-(-(-image.width * h // hs)) // 8), -(-(-(-image.height * v // vs)) // 8)
        return cols * rows, (0,), scan.restart
    cols, rows = -(-image.width // (8 * hs)), -(-image.height // (8 * vs))
    pattern = [k for k, c in enumerate(scan.components) for _ in range(image.components[c][1] * image.components[c][2])]
    return cols * rows, tuple(pattern), scan.restart


def _decode_group(images: list, jobs: list, tables: tuple, pattern: tuple[int, ...]) -> None:
    segments, counts, owner = [], [], []
    for n, (_, scan, units, restart, need) in enumerate(jobs):
        for i in range(need):
            segments.append(scan.segments[i])
            counts.append(min(restart, units - i * restart) * len(pattern))
            owner.append(n)
    counts = np.array(counts)
    step = max(1, GROUP // max(1, int(counts.max()) * 64))
    done: list[list[np.ndarray]] = [[] for _ in jobs]
    try:
        for at in range(0, len(segments), step):
            some = decode_lanes(segments[at : at + step], counts[at : at + step], np.array(pattern), list(tables))
            some[:, :, 0] = _summed(some[:, :, 0].astype(np.int64), pattern)
            for i, lane in enumerate(some):
                done[owner[at + i]].append(lane[: counts[at + i]])
    except ValueError as error:
        if len(jobs) == 1:
            images[jobs[0][0]] = error
            return
        for job in jobs:  # find the one
            _decode_group(images, [job], tables, pattern)
        return
    for (k, scan, _, _, _), lanes in zip(jobs, done, strict=True):
        image, all_ = images[k], np.concatenate(lanes) if len(lanes) > 1 else lanes[0]
        if isinstance(image, ValueError):
            continue
        per = all_.reshape(-1, len(pattern), 64)
        for place, c in enumerate(scan.components):
            mine = per[:, [i for i, p in enumerate(pattern) if p == place]]
            image.blocks[c] = _raster(image, scan, c, mine)


def _summed(dc: np.ndarray, pattern: tuple[int, ...]) -> np.ndarray:
    """Differences to values, for each component of each lane."""
    wide = -(-dc.shape[1] // len(pattern)) * len(pattern)
    dc = np.pad(dc, ((0, 0), (0, wide - dc.shape[1]))).reshape(len(dc), -1, len(pattern))
    out = np.empty_like(dc)
    for c in set(pattern):
        mine = [i for i, p in enumerate(pattern) if p == c]
        out[:, :, mine] = np.cumsum(dc[:, :, mine].reshape(len(dc), -1), axis=1).reshape(len(dc), -1, len(mine))
    return out.reshape(len(dc), wide)


def _raster(image: Image, scan: Scan, c: int, units: np.ndarray) -> np.ndarray:
    hs, vs = max(x[1] for x in image.components), max(x[2] for x in image.components)
    _, h, v, _ = image.components[c]
    if len(scan.components) == 1:
        cols = -(-(-(-image.width * h // hs)) // 8)
        return units.reshape(-1, cols, 64)
    cols = -(-image.width // (8 * hs))
    rows = len(units) // cols
    return units.reshape(rows, cols, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(rows * v, cols * h, 64)


def thumbnail(image: Image) -> np.ndarray:
    """The luminance of each 8 x 8 block, from its DC coefficient: an eighth of the size, in bytes."""
    blocks = image.blocks[0]
    q = image.quantisation[image.components[0][3]]
    _, h, v, _ = image.components[0]
    hs, vs = max(x[1] for x in image.components), max(x[2] for x in image.components)
    cols, rows = -(-(-(-image.width * h // hs)) // 8), -(-(-(-image.height * v // vs)) // 8)
    dc = blocks[:rows, :cols, 0].astype(np.int64) * int(q[0])
    return np.clip(np.floor(dc / 8 + 0.5) + 128, 0, 255).astype(np.uint8)


def stored_bytes(image: Image) -> bytes:
    """What `encode` has stored."""
    size = next(int(c[14:]) for c in image.comments if c.startswith(b"payload-bytes="))
    rows, cols, _ = image.blocks[0].shape
    units = np.stack([image.blocks[c] for c in range(3)], axis=2).reshape(rows * cols, UNIT)
    return (units + 128).astype(np.uint8).tobytes()[:size]


def difference_hash(small: np.ndarray) -> str:
    """64 bits: in a 9 x 8 reduction by means, whether each place is lighter than the one right of it."""
    sums = np.zeros((small.shape[0] + 1, small.shape[1] + 1))
    sums[1:, 1:] = small.astype(float).cumsum(0).cumsum(1)
    y0, x0 = np.arange(8) * small.shape[0] // 8, np.arange(9) * small.shape[1] // 9
    y1, x1 = np.maximum(y0 + 1, (np.arange(8) + 1) * small.shape[0] // 8), np.maximum(x0 + 1, (np.arange(9) + 1) * small.shape[1] // 9)
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    mean = (sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]) / area
    return np.packbits((mean[:, :-1] > mean[:, 1:]).ravel()).tobytes().hex()
