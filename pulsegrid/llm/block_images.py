"""Many block images at once: progressive 4:2:0 JPEG of a column of payloads, and their pixels.

``jpeg`` writes and reads any progressive image, one at a time. Images of a media
column share components, tables and scans, so here each scan is coded, and
accumulated into coefficients, for all images of a batch by the same array
operations. The bytes are those that ``jpeg.encode`` writes. DC symbols, whose
codes vary in length, are read in step: the k-th of every plane at once.
Luma and both chroma planes hold payload and are coded alike, each in scans of its own.

Coefficients have eight bits and a sign, none is under 128: halved, all are of
one size, so a band's first scan is a byte a coefficient.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

from pulsegrid.llm import jpeg

UNIT = 64
#: Most block rows of an image (65,535 pixels); longer payloads take more columns.
MOST_ROWS = 8191
PLANES = 3
#: Spectral bands and successive approximations, each of every plane: halved DC, two halved bands, then the lowest bits of DC and of the rest.
PASSES = [(0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0)]
SCRIPT = [([c], *p) for p in PASSES for c in range(PLANES)]
FLAT = {0: np.ones(64, np.int32)}
#: Planes under which the rest of their DC symbols are read one by one.
IN_STEP = 8
#: Blocks that are transformed at once.
BLOCKS = 1 << 14
_MAX_RUN = 32767
_SIZE_OF_AC = 7


def _table(kind: int, used) -> bytes:
    length = max(1, len(used).bit_length())
    return jpeg._segment(0xC4, bytes([kind]) + bytes(len(used) if k == length else 0 for k in range(1, 17)) + bytes(used))


def _scan_head(k: int) -> bytes:
    which, first, last, high, low = SCRIPT[k]
    return jpeg._segment(0xDA, bytes([len(which)]) + b"".join(bytes([c + 1, 0]) for c in which) + bytes([first, last, high << 4 | low]))


_DC, _AC, _ENDS = _table(0, jpeg._DC_SIZES.tolist()), _table(0x10, [_SIZE_OF_AC]), _table(0x10, jpeg._BAND_ENDS.tolist())
_LEADS = [t + _scan_head(PLANES * k + c) for k, t in enumerate((_DC, _AC, _AC, b"", _ENDS)) for c in range(PLANES)]
_COMPONENTS = bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])


def shape(payload_bytes: int) -> tuple[int, int]:
    """(block rows, block columns) of the luma of a payload's image; with its chroma there is room for all units."""
    units = payload_bytes // UNIT
    rows = max(1, -(-units // 2))
    if rows <= MOST_ROWS:
        return rows, 1  # each chroma plane has half as many blocks
    luma = -(-2 * units // 3)
    cols = max(2, -(-luma // MOST_ROWS))
    return -(-luma // cols), cols


def blocks_of(rows: int, cols: int) -> list[int]:
    """Blocks of each plane."""
    half = -(-rows // 2) * -(-cols // 2)
    return [rows * cols, half, half]


def _pour(values: np.ndarray, lengths: np.ndarray, first_bit: np.ndarray, out: np.ndarray) -> None:
    """The low ``lengths`` bits of each value into the bit array ``out`` from its first bit on."""
    for j in range(int(lengths.max(initial=0))):
        on = lengths > j
        out[first_bit[on] + j] = (values[on] >> (lengths[on] - 1 - j)) & 1


def _aligned(bits_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each plane's bits, a bit array of ones): planes begin on whole bytes and are filled up with ones."""
    at = np.concatenate([[0], np.cumsum(-(-bits_of // 8))])
    return at, np.ones(8 * int(at[-1]), np.uint8)


def write(payloads: list[bytes]) -> list[bytes]:
    """JPEG bytes of payloads whose sizes are positive multiples of 64."""
    shapes = [shape(len(p)) for p in payloads]
    each = [blocks_of(*s) for s in shapes]
    data = b"".join(p.ljust(UNIT * sum(n), b"\0") for p, n in zip(payloads, each, strict=True))
    b = np.frombuffer(data, np.uint8).reshape(-1, UNIT)
    blocks = np.array(each).reshape(-1)
    ends = np.cumsum(blocks)
    starts = ends - blocks
    plane = np.repeat(np.arange(len(blocks)), blocks)

    # DC: differences of halves, their sizes as codes of four bits, then their bits
    half = (b[:, 0].astype(np.int64) - np.where(b[:, 0] < 128, 255, 0)) >> 1
    diff = np.diff(half, prepend=0)
    diff[starts] = half[starts]
    size = jpeg._category(diff)
    length = 4 + size
    at = np.cumsum(length) - length
    sums = np.add.reduceat(length, starts)
    dc_at, bits = _aligned(sums)
    _pour(size << size | jpeg._extra(diff, size), length, at - at[starts][plane] + 8 * dc_at[plane], bits)
    dc = np.packbits(bits).tobytes()

    # lowest bits of magnitudes, which follow in the refining scans
    low = (b & 1) ^ (b < 128)
    refine_at, bits = _aligned(blocks)
    bits[np.arange(len(b)) - starts[plane] + 8 * refine_at[plane]] = low[:, 0]
    refine = np.packbits(bits).tobytes()
    ac_low = low[:, 1:].reshape(-1)
    tails = []
    for s, n in zip(starts.tolist(), blocks.tolist(), strict=True):
        parts = []
        for a in range(s, s + n, _MAX_RUN):
            run = min(_MAX_RUN, s + n - a)
            k = run.bit_length() - 1
            head = np.array([int(x) for x in f"{k:04b}" + (f"{run - (1 << k):0{k}b}" if k else "")], np.uint8)
            parts += [head, ac_low[63 * a : 63 * (a + run)]]
        tails.append(jpeg._stuffed(np.concatenate(parts)))

    halves = b >> 1
    lows, highs = halves[:, 1:6].tobytes(), halves[:, 6:].tobytes()
    out = []
    for i, (p, (rows, cols)) in enumerate(zip(payloads, shapes, strict=True)):
        mine = range(PLANES * i, PLANES * (i + 1))
        head = struct.pack(">BHHB", 8, 8 * rows, 8 * cols, PLANES)
        parts = [b"\xff\xd8", jpeg._segment(0xFE, struct.pack(">Q", len(p))), jpeg._segment(0xDB, bytes([0]) + b"\1" * 64), jpeg._segment(0xC2, head + _COMPONENTS)]
        codes = [dc[dc_at[k] : dc_at[k + 1]].replace(b"\xff", b"\xff\x00") for k in mine]
        codes += [lows[5 * starts[k] : 5 * ends[k]] for k in mine] + [highs[58 * starts[k] : 58 * ends[k]] for k in mine]
        codes += [refine[refine_at[k] : refine_at[k + 1]].replace(b"\xff", b"\xff\x00") for k in mine] + [tails[k] for k in mine]
        for lead, code in zip(_LEADS, codes, strict=True):
            parts += [lead, code]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_HEAD = re.compile(rb"\xff\xd8\xff\xfe\x00\x0a(.{8})\xff\xdb\x00\x43\x00\x01{64}\xff\xc2\x00\x11\x08(..)(..)\x03" + re.escape(_COMPONENTS), re.DOTALL)


def _scans(raw: bytes) -> tuple[int, int, int, list[bytes]] | None:
    """(payload bytes, block rows, block columns, each scan's bytes), or None for an image of another make."""
    head = _HEAD.match(raw)
    if head is None:
        return None
    (size,), (height,), (width,) = struct.unpack(">Q", head[1]), struct.unpack(">H", head[2]), struct.unpack(">H", head[3])
    at, scans = head.end(), []
    for lead in _LEADS:
        if not raw.startswith(lead, at):
            return None
        at += len(lead)
        end = _MARK.search(raw, at)
        if end is None:
            return None
        scans.append(raw[at : end.start()].replace(b"\xff\x00", b"\xff"))
        at = end.start()
    rows, cols = height // 8, width // 8
    if raw[at : at + 2] != b"\xff\xd9":
        return None
    return size, rows, cols, scans


def _dc_values(codes: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Differences of all planes, one after another."""
    table = jpeg._codes(_DC[5:])
    starts = np.cumsum([0, *map(len, codes)])[:-1] * 8
    data = np.frombuffer(b"".join(codes) + b"\xff" * 8, np.uint8).astype(np.int64)
    words = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    length, symbol = np.frombuffer(table.length, np.uint8).astype(np.int64), np.frombuffer(table.symbol, np.uint8).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    pos, first, count = starts[order], (np.cumsum(counts) - counts)[order], counts[order]
    out = np.zeros(int(counts.sum()), np.int64)
    steps = int(count[IN_STEP - 1]) if len(count) >= IN_STEP else 0
    active = np.searchsorted(-count, -np.arange(steps), side="left")
    for j in range(steps):  # every plane that has a j-th block
        m = active[j]
        p = pos[:m]
        window = words[p >> 3] >> (16 - (p & 7)) & 0xFFFF
        n, s = length[window], symbol[window]
        if not n.all():
            raise ValueError("no such code")
        p = p + n
        x = words[p >> 3] >> (32 - (p & 7) - s) & ((1 << s) - 1)
        out[first[:m] + j] = np.where(x >> np.maximum(s - 1, 0), x, x - (1 << s) + 1) * (s > 0)
        pos[:m] = p + s
    for k in range(min(IN_STEP, len(count))):  # the few longest go on by themselves
        i = order[k]
        r = jpeg._Reader(codes[i])
        r.at = int(pos[k] - starts[i])
        for j in range(steps, int(count[k])):
            out[first[k] + j] = r.value(r.symbol(table))
    return out


def read(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]] | None:
    """(coefficients of all blocks in scan order, bounds of each plane's blocks, (payload bytes, rows, columns)); None if an image isn't of this make."""
    found = [_scans(raw) for raw in raws]
    if any(f is None for f in found):
        return None
    blocks = np.array([blocks_of(rows, cols) for _, rows, cols, _ in found]).reshape(-1)
    bounds = np.concatenate([[0], np.cumsum(blocks)])
    plane = np.repeat(np.arange(len(blocks)), blocks)
    coef = np.zeros((int(bounds[-1]), UNIT), np.int16)
    scans = [[f[3][PLANES * k + c] for f in found for c in range(PLANES)] for k in range(len(PASSES))]

    # DC: sums of differences within each plane
    total = np.cumsum(_dc_values(scans[0], blocks))
    coef[:, 0] = (total - np.concatenate([[0], total])[bounds[:-1]][plane]) << 1
    # bands: a byte a coefficient, the code 0 and seven bits
    for k in (1, 2):
        first, last, _, shift = PASSES[k]
        band = np.frombuffer(b"".join(scans[k]), np.uint8)
        if len(band) != len(coef) * (last - first + 1) or (len(band) and band.max() > 127):
            raise ValueError("not a band of one size")
        v = band.reshape(len(coef), -1).astype(np.int16)
        coef[:, first : last + 1] = np.where(v >> (_SIZE_OF_AC - 1), v << shift, -((127 - v) << shift))
    # lowest bits: of DC as they are, of the others away from zero
    at = np.cumsum([0, *map(len, scans[3])])[:-1] * 8
    bits = np.unpackbits(np.frombuffer(b"".join(scans[3]), np.uint8))
    coef[:, 0] |= bits[np.arange(len(coef)) - bounds[:-1][plane] + at[plane]].astype(np.int16)
    low = np.empty((len(coef), UNIT - 1), np.int8)
    ends = jpeg._codes(_ENDS[5:])
    for i, code in enumerate(scans[4]):
        r, a, stop = jpeg._Reader(code), int(bounds[i]), int(bounds[i + 1])
        while a < stop:
            k = r.symbol(ends) >> 4
            run = min((1 << k) + r.bits(k), stop - a)
            low[a : a + run] = r.take(run * (UNIT - 1)).reshape(run, -1)
            a += run
    np.negative(low, out=low, where=coef[:, 1:] < 0)
    coef[:, 1:] += low
    return coef, bounds, [f[:3] for f in found]


def rgb(coef: np.ndarray, bounds: np.ndarray, heads: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(luma blocks, 64, 3) pixels of all images, block by block, and the image of each: inverse transform, chroma repeated to full resolution, colours."""
    size = np.array([h[1:] for h in heads], np.int64).reshape(-1, 2)
    first = bounds[:-1].reshape(-1, PLANES)
    of = np.repeat(np.arange(len(heads)), size[:, 0] * size[:, 1])
    local = np.arange(len(of)) - np.repeat(np.cumsum(size[:, 0] * size[:, 1]) - size[:, 0] * size[:, 1], size[:, 0] * size[:, 1])
    row, col = np.divmod(local, size[of, 1])
    over = row // 2 * -(-size[of, 1] // 2) + col // 2  # the chroma block above a luma block, of which it covers a quarter
    quarter = row % 2 * 2 + col % 2
    out = np.empty((len(of), UNIT, 3), np.uint8)
    for a in range(0, len(of), BLOCKS):
        k = slice(a, a + BLOCKS)
        y = jpeg.samples(coef[first[of[k], 0] + local[k]], FLAT[0]) + np.float32(128)
        cb, cr = (_stretched(jpeg.samples(coef[first[of[k], c] + over[k]], FLAT[0]), quarter[k]) for c in (1, 2))
        both = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], axis=2)
        out[k] = np.clip(np.rint(both), 0, 255)
    return out, of


def _stretched(blocks: np.ndarray, quarter: np.ndarray) -> np.ndarray:
    """A quarter of each block, every sample twice as wide and high."""
    four = blocks.reshape(-1, 2, 4, 2, 4).transpose(0, 1, 3, 2, 4).reshape(-1, 4, 4, 4)[np.arange(len(blocks)), quarter]
    return four.repeat(2, axis=1).repeat(2, axis=2).reshape(-1, UNIT)
