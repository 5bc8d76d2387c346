"""Progressive JPEG media columns.

The decoder is a general one for baseline-precision progressive files (SOF2,
Huffman coding, any sampling factors, restart intervals): spectral-selection
and successive-approximation scans accumulate into coefficient arrays, which
numpy transforms to samples; chroma is upsampled and the picture stored as a
full-resolution RGB tensor. Files of a batch that have their tables and scans
in common are decoded together: every restart interval is a lane, and a step
reads one Huffman symbol in all lanes at once.

``encode_payloads`` stores bytes without loss. JPEG's own lossless unit is the
quantised coefficient: a byte is the eight magnitude bits of a coefficient of
category 8 (128 to 255 is itself, 0 to 127 is itself less 255), 64 in zigzag
order a block and six blocks a 4:2:0 MCU.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import pieces, unused

UNIT = 192  # payloads are padded to a multiple: a 4:4:4 MCU of samples
MCU = 384
FILLER = 32
RESTART = 8
MCUS_ACROSS = 64
MAX_MCUS_DOWN = 4095
SLICE_BYTES = 2 << 20
PRECISION = 12  # bits of the integer transform

#: Natural position of each zigzag index.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else -(i // 8))))
#: First scans leave out the lowest bit; the last ones refine it.
SCRIPT = (
    [((0, 1, 2), 0, 0, 0, 1)]
    + [((c,), a, b, 0, 1) for a, b in ((1, 5), (6, 63)) for c in (0, 1, 2)]
    + [((0, 1, 2), 0, 0, 1, 0)]
    + [((c,), 1, 63, 1, 0) for c in (0, 1, 2)]
)
DC_BITS, DC_SYMBOLS = [0, 0, 0, 12, *[0] * 12], bytes(range(12))
AC_BITS, AC_SYMBOLS = [1, 0, 0, 0, 0, 15, *[0] * 10], bytes([0x07, *[n << 4 for n in range(15)]])


def _codes(bits, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, length)
            code += 1
        at, code = at + n, code << 1
    return out


@lru_cache(64)
def _lookup(table: bytes) -> np.ndarray:
    """16 bits of the stream -> length << 8 | symbol; 0 where there is no code."""
    out = np.zeros(1 << 16, np.int64)
    for symbol, (code, length) in _codes(table[:16], table[16:]).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


@lru_cache(1)
def _transform() -> np.ndarray:
    """zigzag coefficients -> 64 samples, integers of PRECISION bits: sums in doubles are exact in any order."""
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    two = np.einsum("uy,vx->uvyx", basis, basis).reshape(64, 64)
    return np.rint(two[ZIGZAG] * (1 << PRECISION))


# ---------------------------------------------------------------- encoding


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _shape(n_mcus: int) -> tuple[int, int]:
    """MCUs down and across; the last row is filled up."""
    down = min(-(-n_mcus // MCUS_ACROSS), MAX_MCUS_DOWN)
    return down, -(-n_mcus // down)


@lru_cache(256)
def _luma_order(down: int, across: int) -> np.ndarray:
    """Positions, in MCU order, of the luma blocks in raster order."""
    return np.arange(down * across * 4).reshape(down, across, 2, 2).transpose(0, 2, 1, 3).ravel()


@lru_cache(1)
def _tables() -> bytes:
    return (
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + _segment(0xDB, b"\0" + b"\1" * 64)
        + _segment(0xC4, bytes([0x00, *DC_BITS]) + DC_SYMBOLS)
        + _segment(0xC4, bytes([0x10, *AC_BITS]) + AC_SYMBOLS)
        + _segment(0xDD, struct.pack(">H", RESTART))
    )


def _head(n_bytes: int, down: int, across: int) -> bytes:
    frame = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _segment(0xFE, b"payload-bytes=%d" % n_bytes) + _tables() + _segment(0xC2, frame)


def _scan_head(components, ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *[x for c in components for x in (c + 1, 0)], ss, se, ah << 4 | al]))


def _scan_bytes(flat: np.ndarray, lengths: np.ndarray, lanes: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each file: its lanes with stuffing, restart markers between them."""
    ends = np.cumsum(lengths)
    last = np.cumsum(lanes)
    number = np.arange(len(lengths)) - np.repeat(last - lanes, lanes)
    between = np.ones(len(lengths), bool)
    between[last - 1] = False
    extra = (flat == 0xFF).astype(np.int64)
    extra[ends - 1] += 2 * between
    after = np.cumsum(extra)
    out = np.zeros(len(flat) + after[-1], np.uint8)
    out[np.arange(len(flat)) + after - extra] = flat
    marks = (ends + after[ends - 1] - 2)[between]
    out[marks], out[marks + 1] = 0xFF, 0xD0 + number[between] % 8
    stops = (ends + after[ends - 1])[last - 1]
    data = out.tobytes()
    return [data[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]


def _packed(values: np.ndarray, widths: np.ndarray, lane_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and their number for each lane of ``lane_sizes`` values; padded with ones."""
    widest = int(widths.max())
    bits = (values[:, None] >> np.arange(widest - 1, -1, -1)) & 1
    bits = bits[np.arange(widest) >= widest - widths[:, None]].astype(np.uint8)
    n_bits = np.add.reduceat(widths, np.cumsum(lane_sizes) - lane_sizes)
    n_bytes = -(-n_bits // 8)
    shift = np.cumsum(n_bytes * 8 - n_bits) - (n_bytes * 8 - n_bits)
    out = np.ones(int(n_bytes.sum()) * 8, np.uint8)
    out[np.arange(len(bits)) + np.repeat(shift, n_bits)] = bits
    return np.packbits(out), n_bytes


def _lane_sizes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes of at most RESTART units: their sizes, and their number for each file."""
    lanes = -(-units // RESTART)
    sizes = np.full(lanes.sum(), RESTART)
    sizes[np.cumsum(lanes) - 1] = units - (lanes - 1) * RESTART
    return sizes, lanes


def _signed(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.int64)
    return np.where(values < 128, values - 255, values)


def _dc_first(mcus: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dc = _signed(mcus[:, :, 0]) >> 1
    first = np.cumsum(sizes) - sizes
    diff = np.empty_like(dc)
    luma = dc[:, :4].ravel()
    d = np.diff(luma, prepend=0)
    d[first * 4] = luma[first * 4]
    diff[:, :4] = d.reshape(-1, 4)
    for c in (4, 5):
        diff[:, c] = np.diff(dc[:, c], prepend=0)
        diff[first, c] = dc[first, c]
    diff = diff.ravel()
    category = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    extra = np.where(diff < 0, diff + (1 << category) - 1, diff)
    return _packed(category << category | extra, category + 4, sizes * 6)  # codes of four bits: the category itself


def _ac_refine(blocks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An end-of-band run over each lane's blocks and the correction bits of all their coefficients."""
    codes = _codes(AC_BITS, AC_SYMBOLS)
    bits = (blocks[:, 1:] & 1) ^ (blocks[:, 1:] < 128)
    runs = sizes.astype(np.int64)
    n_bits = np.array([codes[(int(r).bit_length() - 1) << 4][1] + int(r).bit_length() - 1 if r else 0 for r in range(RESTART + 1)])
    lengths = -(-(n_bits[runs] + 63 * runs) // 8)
    starts, first = np.cumsum(lengths) - lengths, np.cumsum(sizes) - sizes
    out = np.empty(int(lengths.sum()), np.uint8)
    for r in np.unique(runs).tolist():
        lanes = np.flatnonzero(runs == r)
        n = r.bit_length() - 1
        code, length = codes[n << 4]
        head = code << n | (r - (1 << n))
        size = int(-(-(length + n + 63 * r) // 8))
        rows = np.ones((len(lanes), size * 8), np.uint8)
        rows[:, : length + n] = [head >> i & 1 for i in range(length + n - 1, -1, -1)]
        rows[:, length + n : length + n + 63 * r] = bits[first[lanes][:, None] + np.arange(r)].reshape(len(lanes), -1)
        out[starts[lanes][:, None] + np.arange(size)] = np.packbits(rows, axis=1)
    return out, lengths


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload, whose length is a positive multiple of UNIT."""
    shapes = [_shape(-(-len(p) // MCU)) for p in payloads]
    n_mcus = np.array([d * a for d, a in shapes])
    data = b"".join(p + bytes([FILLER]) * (d * a * MCU - len(p)) for p, (d, a) in zip(payloads, shapes))
    mcus = np.frombuffer(data, np.uint8).reshape(-1, 6, 64)
    base = (np.cumsum(n_mcus) - n_mcus) * 4
    order = np.concatenate([_luma_order(d, a) + b for (d, a), b in zip(shapes, base.tolist())])
    planes = (mcus[:, :4].reshape(-1, 64)[order], mcus[:, 4], mcus[:, 5])
    parts: list[list[bytes]] = []
    for components, ss, se, ah, _ in SCRIPT:
        units = n_mcus * 4 if components == (0,) else n_mcus
        sizes, lanes = _lane_sizes(units)
        if ss == 0 and ah == 0:
            flat, lengths = _dc_first(mcus, sizes)
        elif ss == 0:
            dc = (_signed(mcus[:, :, 0]) & 1).ravel()
            flat, lengths = _packed(dc, np.ones(len(dc), np.int64), sizes * 6)
        elif ah == 0:  # the code of (no run, category 7) is a zero bit and seven magnitude bits follow: a byte each
            flat, lengths = (planes[components[0]][:, ss : se + 1] >> 1).ravel(), sizes * (se - ss + 1)
        else:
            flat, lengths = _ac_refine(planes[components[0]], sizes)
        parts.append(_scan_bytes(flat, lengths, lanes))
    heads = [_scan_head(*s) for s in SCRIPT]
    return [
        b"".join([_head(len(p), d, a), *[x for h, scan in zip(heads, parts) for x in (h, scan[i])], b"\xff\xd9"])
        for i, (p, (d, a)) in enumerate(zip(payloads, shapes))
    ]


# ---------------------------------------------------------------- decoding


@dataclass(frozen=True, eq=False)
class Scan:
    """What a scan's header and the tables before it say; one object for equal ones, as they come from a cache."""

    components: tuple[int, ...]
    ss: int
    se: int
    ah: int
    al: int
    dc: tuple[bytes, ...]
    ac: tuple[bytes, ...]
    restart: int


@lru_cache(256)
def _scan(body: bytes, components: tuple, huffman: tuple, restart: int) -> Scan:
    n, tables = body[0], dict(huffman)
    index = {c[0]: i for i, c in enumerate(components)}
    own = [(index[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
    ss, se, approximation = body[1 + 2 * n : 4 + 2 * n]
    dc = tuple(tables.get(t >> 4, b"") for _, t in own) if ss == 0 else ()
    ac = tuple(tables.get(0x10 | t & 15, b"") for _, t in own) if ss else ()
    return Scan(tuple(i for i, _ in own), ss, se, approximation >> 4, approximation & 15, dc, ac, restart)


@lru_cache(4096)
def _geometry(height: int, width: int, components: tuple):
    """MCUs down and across; for each component its padded block grid, and the grid that holds samples (scans of one component go through that)."""
    h, v = max(c[1] for c in components), max(c[2] for c in components)
    mcus = -(-height // (8 * v)), -(-width // (8 * h))
    padded_grids = tuple((mcus[0] * cv, mcus[1] * ch) for _, ch, cv, _ in components)
    own = tuple((-(-(-(-height * cv // v)) // 8), -(-(-(-width * ch // h)) // 8)) for _, ch, cv, _ in components)
    return mcus, padded_grids, own


@dataclass
class Frame:
    height: int = 0
    width: int = 0
    components: tuple[tuple[int, int, int, int], ...] = ()  # id, h, v, quantisation table
    tables: dict[int, tuple[int, ...]] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    data: list[bytes] = field(default_factory=list)  # of each scan
    comment: bytes = b""
    adobe: int | None = None

    def factors(self) -> tuple[int, int]:
        return max(c[1] for c in self.components), max(c[2] for c in self.components)

    def geometry(self):
        return _geometry(self.height, self.width, self.components)

    def signature(self):
        return (self.components, tuple(sorted(self.tables.items())), tuple(self.scans), self.adobe)


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(data: bytes) -> Frame:
    """Markers of a progressive file; anything else than 8-bit Huffman SOF2 is a ValueError."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    frame, huffman, tables, restart, at = Frame(), {}, (), 0, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            frame.comment = body
        elif marker == 0xEE and body[:5] == b"Adobe":
            frame.adobe = body[11]
        elif marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, 64 * (1 + (body[0] >> 4))
                frame.tables[body[0] & 15] = struct.unpack(">64H" if wide else ">64B", body[1 : 1 + n])
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 16 + sum(body[1:17])
                huffman[body[0]] = body[1 : 1 + n]
                body = body[1 + n :]
            tables = tuple(huffman.items())
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xC2:
            precision, frame.height, frame.width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8 or not frame.height or not frame.width:
                raise ValueError("unsupported frame")
            frame.components = tuple((body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n))
        elif marker in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError(f"frame type {marker:#x} is not progressive Huffman")
        elif marker == 0xDA:
            end = _SCAN_END.search(data, at)
            stop = end.start() if end else len(data)
            frame.scans.append(_scan(body, frame.components, tables, restart))
            frame.data.append(data[at:stop])
            at = stop
    if not frame.components:
        raise ValueError("no frame")
    return frame


class _Stream:
    """The data of one scan of several files without stuffing, and where each lane starts in it."""

    def __init__(self, pieces: list[bytes]):
        raw = np.frombuffer(b"".join(pieces) + b"\0", np.uint8)
        begin = np.cumsum([0, *map(len, pieces)])
        ff = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[ff + 1]
        keep = np.ones(len(raw), bool)
        keep[-1] = False
        keep[ff[after == 0] + 1] = False
        marks = ff[(after >= 0xD0) & (after <= 0xD7)]
        keep[marks] = keep[marks + 1] = False
        starts = np.sort(np.concatenate([begin[:-1], marks + 2]))
        self.lanes = np.diff(np.searchsorted(starts, begin))  # of each file
        place = np.cumsum(keep) - keep
        self.starts = place[starts] * 8
        self.bytes = np.concatenate([raw[keep], np.zeros(16, np.uint8)])
        # Eight bytes from any byte on, as a big-endian number.
        self.windows = np.lib.stride_tricks.as_strided(self.bytes.view(np.uint8)[:8].view(">u8"), (len(self.bytes) - 8,), (1,))
        self._bits: np.ndarray | None = None

    def window(self, pos: np.ndarray) -> np.ndarray:
        at = np.minimum(pos >> 3, len(self.windows) - 1)
        return self.windows[at].astype(np.uint64) << (pos & 7).astype(np.uint64)

    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(self.bytes)
        return self._bits


def _symbols(window: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = table[(window >> np.uint64(48)).astype(np.int64)]
    if not found.all():
        raise ValueError("a bit pattern is no Huffman code")
    return found >> 8, found & 255


def _extra(window: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits behind the first skip ones."""
    x = (window << skip.astype(np.uint64)) >> np.uint64(1)
    return (x >> (63 - n).astype(np.uint64)).astype(np.int64)


def _extended(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << n) >> 1, bits - (1 << n) + 1, bits)


def _read_dc(stream, lanes, coefficients, sequence, scan) -> None:
    """lanes: start bit, first MCU, MCUs. sequence: for each block of an MCU its component's place in the scan and the blocks of all MCUs."""
    pos, first, n = lanes
    if scan.ah:
        bits, per = stream.bits(), len(sequence)
        for j, (c, blocks) in enumerate(sequence):
            plane = coefficients[scan.components[c]]
            for i in range(int(n.max())):
                on = n > i
                plane[blocks[first[on] + i], 0] |= bits[pos[on] + i * per + j].astype(np.int16) << scan.al
        return
    tables = [_lookup(t) for t in scan.dc]
    pred = np.zeros((len(scan.components), len(pos)), np.int64)
    pos = pos.copy()
    for i in range(int(n.max())):
        on = np.flatnonzero(n > i)
        for c, blocks in sequence:
            window = stream.window(pos[on])
            length, category = _symbols(window, tables[c])
            pred[c, on] += _extended(_extra(window, length, category), category)
            pos[on] += length + category
            coefficients[scan.components[c]][blocks[first[on] + i], 0] = pred[c, on] << scan.al


def _read_ac_first(stream, lanes, plane, blocks, scan) -> None:
    pos, unit, n = (x.copy() for x in lanes)
    end, k, table = unit + n, np.full(len(pos), scan.ss), _lookup(scan.ac[0])
    flat = plane.reshape(-1)
    while len(pos):
        window = stream.window(pos)
        length, symbol = _symbols(window, table)
        size, run = symbol & 15, symbol >> 4
        plain = size > 0
        if plain.all():
            bits = _extra(window, length, size)
            k += run
            flat[blocks[unit] * 64 + k] = _extended(bits, size) << scan.al
            pos += length + size
            k += 1
        else:
            width = np.where(plain, size, np.where(run < 15, run, 0))
            bits = _extra(window, length, width)
            k += run * plain
            flat[(blocks[unit] * 64 + k)[plain]] = _extended(bits, size)[plain] << scan.al
            pos += length + width
            stop = ~plain & (run < 15)
            k += np.where(plain, 1, np.where(stop, 0, 16))
            k[stop] = 64
            unit[stop] += (1 << run[stop]) + bits[stop] - 1
        done = k > scan.se
        if done.any():
            unit += done
            k[done] = scan.ss
            live = unit < end
            if not live.all():
                pos, unit, end, k = pos[live], unit[live], end[live], k[live]


def _read_ac_refine(stream, lanes, plane, blocks, scan) -> None:
    pos, unit, n = (x.copy() for x in lanes)
    end, k, table, bits = unit + n, np.full(len(pos), scan.ss), _lookup(scan.ac[0]), stream.bits()
    columns, step = np.arange(scan.ss, scan.se + 1), 1 << scan.al

    def correct(rows, where, at):
        """Read a bit for each coefficient of where (rows x columns) that isn't zero yet; returns how many."""
        values = plane[rows, scan.ss : scan.se + 1]
        known = (values != 0) & where
        if known.all():
            got = bits[np.minimum(at[:, None] + np.arange(len(columns)), len(bits) - 1)].astype(np.int16) * step
            plane[rows, scan.ss : scan.se + 1] = values + np.where(values < 0, -got, got)
            return np.full(len(rows), len(columns))
        place = np.cumsum(known, axis=1)
        got = bits[np.minimum(at[:, None] + place - 1, len(bits) - 1)] & known
        plane[rows, scan.ss : scan.se + 1] = values + np.sign(values) * (got.astype(values.dtype) * step)
        return place[:, -1]

    while len(pos):
        window = stream.window(pos)
        length, symbol = _symbols(window, table)
        size, run = symbol & 15, symbol >> 4
        ends = (size == 0) & (run < 15)
        if (~ends).any():
            on = np.flatnonzero(~ends)
            rows, at = blocks[unit[on]], pos[on] + length[on]
            new = size[on] > 0
            sign = bits[at]
            at = at + new
            inside = columns >= k[on][:, None]
            zeros = np.cumsum((plane[rows, scan.ss : scan.se + 1] == 0) & inside, axis=1)
            # A run stops at the zero after it; sixteen zeros have none to fill but are passed.
            place = (zeros <= run[on][:, None]).sum(1)
            last = np.minimum(place, len(columns) - 1)
            read = correct(rows, inside & (np.arange(len(columns)) <= last[:, None]), at)
            fill = new & (place < len(columns))
            plane[rows[fill], scan.ss + place[fill]] = np.where(sign[fill] > 0, step, -step)
            pos[on] = at + read
            k[on] = scan.ss + place + 1
        if ends.any():
            on = np.flatnonzero(ends)
            count = (1 << run[on]) + _extra(window[on], length[on], run[on])
            at, begin = pos[on] + length[on] + run[on], k[on]
            for i in range(int(count.max())):
                some = np.flatnonzero(count > i)
                at[some] += correct(blocks[unit[on[some]] + i], columns >= begin[some][:, None] if i == 0 else np.True_, at[some])
            pos[on] = at
            unit[on] += count - 1
            k[on] = scan.se + 1
        done = k > scan.se
        unit += done
        k[done] = scan.ss
        live = unit < end
        if not live.all():
            pos, unit, end, k = pos[live], unit[live], end[live], k[live]


@dataclass
class Picture:
    frame: Frame
    planes: list[np.ndarray]  # of each component: block rows x block columns x 64 coefficients in zigzag order


def _samples(plane: np.ndarray, table: tuple[int, ...]) -> np.ndarray:
    """Blocks of 64 coefficients -> blocks of 8 x 8 samples."""
    out, matrix = np.empty((len(plane), 8, 8), np.uint8), np.array(table, np.float64)[:, None] * _transform()
    for a in range(0, len(plane), 4096):
        sums = plane[a : a + 4096].astype(np.float64) @ matrix
        sums += (1 << PRECISION - 1) + (128 << PRECISION)
        sums /= 1 << PRECISION
        out[a : a + 4096] = np.minimum(np.maximum(sums, 0, out=sums), 255, out=sums).reshape(-1, 8, 8)
    return out


def _colours(luma: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """YCbCr -> RGB with the usual factors in 16 binary digits."""
    luma, cb, cr = luma.astype(np.int32), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    out = np.empty((len(luma), 3), np.uint8)
    out[:, 0] = np.minimum(np.maximum(luma + (91881 * cr + 32768 >> 16), 0), 255)
    out[:, 1] = np.minimum(np.maximum(luma - (22554 * cb + 46802 * cr + 32768 >> 16), 0), 255)
    out[:, 2] = np.minimum(np.maximum(luma + (116130 * cb + 32768 >> 16), 0), 255)
    return out


def rgb_tensors(pictures: list[Picture]) -> list[np.ndarray]:
    """height x width x 3 bytes each. One component is grey; three are YCbCr, unless an Adobe marker says RGB."""
    alike: dict = {}
    for i, p in enumerate(pictures):
        alike.setdefault((p.frame.components, tuple(sorted(p.frame.tables.items())), p.frame.adobe), []).append(i)
    out: list = [None] * len(pictures)
    for (components, tables, adobe), members in alike.items():
        if len(components) not in (1, 3):
            raise ValueError(f"{len(components)} components")
        own, full = [pictures[i] for i in members], []
        h, v = own[0].frame.factors()
        for c, (_, ch, cv, tq) in enumerate(components):
            blocks = _samples(np.concatenate([p.planes[c].reshape(-1, 64) for p in own]), dict(tables)[tq])
            at, rasters = 0, []
            for p in own:
                down, across = p.planes[c].shape[:2]
                raster = blocks[at : at + down * across].reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
                at += down * across
                height, width = p.frame.height, p.frame.width
                if v % cv or h % ch:
                    raster = raster[np.arange(height) * cv // v][:, np.arange(width) * ch // h]
                elif (ch, cv) != (h, v):
                    raster = raster.repeat(v // cv, axis=0).repeat(h // ch, axis=1)
                rasters.append(raster[:height, :width].ravel())
            full.append(np.concatenate(rasters))
        if len(full) == 1:
            flat = np.repeat(full[0][:, None], 3, axis=1)
        else:
            flat = np.stack(full, axis=1) if adobe == 0 else _colours(*full)
        at = 0
        for i, p in zip(members, own):
            n = p.frame.height * p.frame.width
            out[i] = flat[at : at + n].reshape(p.frame.height, p.frame.width, 3)
            at += n
    return out


def _decode_alike(frames: list[Frame]) -> list[Picture]:
    """Files with the same tables and scans, in lanes."""
    model = frames[0]
    shapes = [f.geometry() for f in frames]
    grids, bases, planes = [], [], []
    for c in range(len(model.components)):
        grid = [s[1][c] for s in shapes]
        sizes = np.array([a * b for a, b in grid])
        grids.append(grid)
        bases.append((np.cumsum(sizes) - sizes).tolist())
        planes.append(np.zeros((int(sizes.sum()), 64), np.int16))

    def places(c: int, extents, step=(1, 1), shift=(0, 0)) -> np.ndarray:
        """Blocks of component c in a scan's order, for all files."""
        return np.concatenate([_raster(d, a, g[1], step, shift) + b for (d, a), g, b in zip(extents, grids[c], bases[c])])

    whole = [s[0] for s in shapes]
    own = [[s[2][c] for s in shapes] for c in range(len(model.components))]
    alone = [places(c, own[c]) for c in range(len(model.components))]
    for number, scan in enumerate(model.scans):
        stream = _Stream([f.data[number] for f in frames])
        single = len(scan.components) == 1
        units = np.array([d * a for d, a in (own[scan.components[0]] if single else whole)])
        lanes = _lanes(stream, units, scan.restart)
        if scan.ss:
            read = _read_ac_refine if scan.ah else _read_ac_first
            read(stream, lanes, planes[scan.components[0]], alone[scan.components[0]], scan)
        elif single:
            _read_dc(stream, lanes, planes, [(0, alone[scan.components[0]])], scan)
        else:
            sequence = []
            for i, c in enumerate(scan.components):
                _, h, v, _ = model.components[c]
                sequence += [(i, places(c, whole, (v, h), (y, x))) for y in range(v) for x in range(h)]
            _read_dc(stream, lanes, planes, sequence, scan)
    return [Picture(f, [p[b[i] : b[i] + g[i][0] * g[i][1]].reshape(*g[i], 64) for p, b, g in zip(planes, bases, grids)]) for i, f in enumerate(frames)]


@lru_cache(4096)
def _raster(down: int, across: int, stride: int, step: tuple[int, int], shift: tuple[int, int]) -> np.ndarray:
    return ((np.arange(down) * step[0] + shift[0])[:, None] * stride + np.arange(across) * step[1] + shift[1]).ravel()


def _lanes(stream: _Stream, units: np.ndarray, restart: int):
    expected = -(-units // restart) if restart else np.ones_like(units)
    if (stream.lanes != expected).any():
        raise ValueError("restart markers don't match the restart interval")
    first = np.cumsum(units) - units
    number = np.arange(len(stream.starts)) - np.repeat(np.cumsum(expected) - expected, expected)
    done = number * restart
    n = np.repeat(units, expected) - done
    return stream.starts, np.repeat(first, expected) + done, np.minimum(n, restart) if restart else n


def decode_files(files: list[bytes]) -> list[Picture]:
    alike: dict = {}
    frames = [parse(f) for f in files]
    for i, frame in enumerate(frames):
        alike.setdefault(frame.signature(), []).append(i)
    out: list[Picture | None] = [None] * len(files)
    for members in alike.values():
        for i, picture in zip(members, _decode_alike([frames[i] for i in members])):
            out[i] = picture
    return out


def payload_of(picture: Picture) -> bytes | None:
    """The bytes that encode_payloads stored; None for other pictures."""
    if not picture.frame.comment.startswith(b"payload-bytes="):
        return None
    luma, cb, cr = picture.planes
    down, across = cb.shape[:2]
    mcus = np.empty((down, across, 6, 64), np.int16)
    mcus[:, :, :4] = luma.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    mcus[:, :, 4], mcus[:, :, 5] = cb, cr
    return (mcus + 255 * (mcus < 0)).astype(np.uint8).tobytes()[: int(picture.frame.comment[14:])]


# ---------------------------------------------------------------- columns


def padded(data: bytes) -> bytes:
    return data + bytes([FILLER]) * (UNIT - len(data) if not data else -len(data) % UNIT)


def with_media(docs: DataFrame, *, text_col: str = "text", as_col: str = "media") -> DataFrame:
    """Add a progressive JPEG that holds the whole text's UTF-8 bytes, padded with spaces to a positive multiple of UNIT.

    A null text is an empty one; rows stay as they are; a column of that name
    is replaced. Equal texts give equal files. Memory: some dozens of times a
    slice of about 2 MB or one document.
    """

    @F.arrow_udf("binary")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in pieces(texts, SLICE_BYTES):
            yield pa.array(encode_payloads([padded((t or "").encode()) for t in part.to_pylist()]), pa.binary())

    return docs.withColumn(as_col, encode.asNondeterministic()(F.col(f"`{text_col}`")))


def with_pictures(stored: DataFrame, *, media_col: str = "media") -> DataFrame:
    """Add payload, height, width and rgb (height x width x 3 bytes) of each file; they replace columns of these names.

    ``payload`` is null for pictures that weren't made by ``with_media``; all
    four are null for a null file. A file that is no progressive JPEG fails the job.
    """
    names = ("payload", "height", "width", "rgb")
    to = pa.struct([("payload", pa.binary()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])

    @F.arrow_udf("struct<payload:binary,height:int,width:int,rgb:binary>")
    def decode(media: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in pieces(media, SLICE_BYTES):
            files, out = part.to_pylist(), []
            pictures = decode_files([f for f in files if f is not None])
            tensors = rgb_tensors(pictures)
            both = iter(zip(pictures, tensors))
            for f in files:
                picture, rgb = next(both) if f is not None else (None, None)
                out.append(picture and {"payload": payload_of(picture), "height": picture.frame.height, "width": picture.frame.width, "rgb": rgb.tobytes()})
            yield pa.array(out, to)

    (picture,) = unused(stored.columns, "picture")
    found = stored.withColumn(picture, decode.asNondeterministic()(F.col(f"`{media_col}`")))
    return found.select(*[F.col(f"`{c}`") for c in stored.columns if c not in names], *[F.col(picture)[c].alias(c) for c in names])
