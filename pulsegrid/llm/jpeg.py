"""Progressive JPEG in numpy: coefficients to scans and back, and to RGB.

The decoder takes any Huffman-coded progressive image of 8 bits: spectral
selection, successive approximation, restart intervals, interleaved DC scans and
subsampled components accumulate into one coefficient array a component. Runs of
like codes and end-of-band runs are read as whole arrays; what remains is read
symbol by symbol. The encoder writes coefficient arrays under a scan script.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np


def _zigzag() -> np.ndarray:
    """Place in the 8x8 block, row by row, of each coefficient in scan order: diagonals, turning."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


@dataclass
class Component:
    """``coef``: (padded block rows, padded block columns, 64) int32 in scan order; ``rows``/``cols`` are those with image."""

    ident: int
    h: int
    v: int
    table: int
    rows: int = 0
    cols: int = 0
    coef: np.ndarray = field(default=None)


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""


def layout(width: int, height: int, components: list[Component]) -> None:
    """Block counts of each component, and zeroed coefficients padded to whole MCUs where there are none yet."""
    hmax, vmax = max(c.h for c in components), max(c.v for c in components)
    mcus = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    for c in components:
        c.cols, c.rows = -(-(-(-width * c.h // hmax)) // 8), -(-(-(-height * c.v // vmax)) // 8)
        if c.coef is None:
            c.coef = np.zeros((mcus[1] * c.v, mcus[0] * c.h, 64), np.int32)


@lru_cache(256)
def _one_order(rows: int, cols: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    flat = (np.arange(rows)[:, None] * stride + np.arange(cols)).reshape(-1)
    return np.zeros(len(flat), np.int64), flat


def _scan_order(components: list[Component]) -> list[tuple[int, np.ndarray]]:
    """One (which component, flat block number) array pair in coding order."""
    if len(components) == 1:
        c = components[0]
        return _one_order(c.rows, c.cols, c.coef.shape[1])
    rows, cols = components[0].coef.shape[0] // components[0].v, components[0].coef.shape[1] // components[0].h
    which, flat = [], []
    for k, c in enumerate(components):
        y = (np.arange(rows)[:, None, None, None] * c.v + np.arange(c.v)[:, None]) + np.zeros((1, cols, 1, c.h), int)
        x = (np.arange(cols)[None, :, None, None] * c.h + np.arange(c.h)) + np.zeros((rows, 1, c.v, 1), int)
        flat.append((y * c.coef.shape[1] + x).reshape(rows * cols, -1))
        which.append(np.full(flat[-1].shape, k))
    return np.concatenate(which, axis=1).reshape(-1), np.concatenate(flat, axis=1).reshape(-1)


# --- writing


def _bits(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The low ``lengths`` bits of each value, first bit first."""
    at = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    for j in range(int(lengths.max(initial=0))):
        on = lengths > j
        out[at[on] + j] = (values[on] >> (lengths[on] - 1 - j)) & 1
    return out


_CATEGORY = np.array([k.bit_length() for k in range(1 << 12)])


def _category(v: np.ndarray) -> np.ndarray:
    return _CATEGORY[np.abs(v)]


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _entropy(symbols: np.ndarray, extra: np.ndarray, extra_len: np.ndarray, tail: dict[int, np.ndarray] | None = None, used: np.ndarray | None = None):
    """(DHT body, coded bits) of symbols with their extra bits; codes have one length, the all-ones code stays free.

    ``tail`` gives raw bits that follow the i-th symbol.
    """
    used = np.unique(symbols) if used is None else used
    length = max(1, int(len(used)).bit_length())
    counts = bytes(len(used) if k == length else 0 for k in range(1, 17))
    code = np.searchsorted(used, symbols)
    bits = _bits(np.stack([code, extra], axis=1).reshape(-1), np.stack([np.full(len(symbols), length), extra_len], axis=1).reshape(-1))
    if tail:
        ends = np.cumsum(length + extra_len)
        parts, last = [], 0
        for i in sorted(tail):
            parts += [bits[last : ends[i]], tail[i]]
            last = ends[i]
        bits = np.concatenate([*parts, bits[last:]])
    return counts + bytes(used.astype(np.uint8)), bits


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


def _shifted(v: np.ndarray, low: int) -> np.ndarray:
    """Point transform of AC values: towards zero."""
    return np.sign(v) * (np.abs(v) >> low)


def _code_ac_first(coef: np.ndarray, low: int):
    v = np.abs(coef) >> low
    least = int(v.min(initial=0 if not v.size else 1 << 30))
    if least and least.bit_length() == int(v.max()).bit_length():
        # one symbol throughout: a code of one bit, 0, before each value's own bits
        s = least.bit_length()
        extra = np.where(coef < 0, (1 << s) - 1 - v, v).reshape(-1)
        bits = np.unpackbits(extra.astype(">u2").view(np.uint8)).reshape(-1, 16)[:, 15 - s :].reshape(-1)
        return bytes(k == 1 for k in range(1, 17)) + bytes([s]), bits
    v = np.where(coef < 0, -v, v)
    size = _category(v)
    symbols, extra, lens, run_of_blocks = [], [], [], 0

    def end_of_bands():
        nonlocal run_of_blocks
        while run_of_blocks:
            k = min(run_of_blocks.bit_length() - 1, 14)
            take = min(run_of_blocks, (2 << k) - 1)
            symbols.append(k << 4)
            extra.append(take - (1 << k))
            lens.append(k)
            run_of_blocks -= take

    for block, sizes in zip(v, size, strict=True):
        last = -1
        for k in np.flatnonzero(block):
            end_of_bands()
            run = k - last - 1
            while run > 15:
                symbols.append(0xF0)
                extra.append(0)
                lens.append(0)
                run -= 16
            s = int(sizes[k])
            symbols.append(run << 4 | s)
            extra.append(int(_extra(block[k], sizes[k])))
            lens.append(s)
            last = k
        if last < len(block) - 1:
            run_of_blocks += 1
    end_of_bands()
    return _entropy(np.array(symbols, np.int64), np.array(extra, np.int64), np.array(lens, np.int64))


def _code_ac_refine(coef: np.ndarray, low: int):
    now = np.abs(coef) >> low
    old = now > 1
    fresh = (now == 1) & ~old
    symbols, extra, lens, tail = [], [], [], {}
    block, n = 0, len(coef)
    while block < n:
        new = np.flatnonzero(fresh[block])
        stop = 0
        for k in new:
            # zeros without history before k, sixteen a time; corrections of the places passed follow each symbol
            zeros = np.flatnonzero(~old[block, stop:k] & ~fresh[block, stop:k]) + stop
            while len(zeros) > 15:
                symbols.append(0xF0)
                extra.append(0)
                lens.append(0)
                here = np.arange(stop, zeros[15] + 1)
                tail[len(symbols) - 1] = (now[block, here][old[block, here]] & 1).astype(np.uint8)
                stop, zeros = zeros[15] + 1, zeros[16:]
            here = np.arange(stop, k)
            symbols.append(len(zeros) << 4 | 1)
            extra.append(int(coef[block, k] > 0))
            lens.append(1)
            tail[len(symbols) - 1] = (now[block, here][old[block, here]] & 1).astype(np.uint8)
            stop = k + 1
        if stop == coef.shape[1]:
            block += 1
            continue
        # this band's end, and whole bands without anything new after it
        more = np.flatnonzero(fresh[block + 1 :].any(axis=1))
        run = min(1 + (int(more[0]) if len(more) else n - block - 1), 32767)
        k = run.bit_length() - 1
        symbols.append(k << 4)
        extra.append(run - (1 << k))
        lens.append(k)
        first = now[block, stop:][old[block, stop:]] & 1
        rest = now[block + 1 : block + run][old[block + 1 : block + run]] & 1
        tail[len(symbols) - 1] = np.concatenate([first, rest]).astype(np.uint8)
        block += run
    symbols = np.array(symbols, np.int64)
    # bands that only end need no symbols but these: one table for all such images
    used = _BAND_ENDS if not (symbols & 15).any() and not (symbols == 0xF0).any() else None
    return _entropy(symbols, np.array(extra, np.int64), np.array(lens, np.int64), tail, used)


def encode(image: Image, script: list[tuple[list[int], int, int, int, int]]) -> bytes:
    """JPEG bytes of an image's coefficients; ``script`` lists (components, first, last, high, low) scans."""
    out = [b"\xff\xd8"]
    if image.comment:
        out.append(_segment(0xFE, image.comment))
    for k, q in image.quant.items():
        out.append(_segment(0xDB, bytes([k]) + bytes(q.astype(np.uint8))))
    head = struct.pack(">BHHB", 8, image.height, image.width, len(image.components))
    out.append(_segment(0xC2, head + b"".join(bytes([c.ident, c.h << 4 | c.v, c.table]) for c in image.components)))
    for which, first, last, high, low in script:
        parts = [image.components[k] for k in which]
        owner, flat = _scan_order(parts)
        if first == 0:
            v = np.empty(len(flat), np.int64)
            for k, c in enumerate(parts):
                v[owner == k] = c.coef.reshape(-1, 64)[flat[owner == k], 0] >> low
            if high:
                table, bits = b"", (v & 1).astype(np.uint8)
            else:
                for k in range(len(parts)):
                    own = v[owner == k]
                    v[owner == k] = np.diff(own, prepend=0)
                if v.any():
                    size = _category(v)
                    table, bits = _entropy(size, _extra(v, size), size, used=_DC_SIZES)
                else:
                    table, bits = _ONE_ZERO, np.zeros(len(v), np.uint8)
                table = b"\x00" + table
        else:
            band = parts[0].coef.reshape(-1, 64)[flat, first : last + 1]
            table, bits = (_code_ac_refine if high else _code_ac_first)(band, low)
            table = b"\x10" + table
        if table:
            out.append(_segment(0xC4, table))
        out.append(_segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c.ident, 0]) for c in parts) + bytes([first, last, high << 4 | low])))
        out.append(_stuffed(bits))
    return b"".join([*out, b"\xff\xd9"])


#: Sizes of 8-bit images' DC differences and symbols of ends of bands, coded alike in every scan; and the table of a scan that has size 0 alone.
_DC_SIZES = np.arange(12)
_BAND_ENDS = np.arange(15) << 4
_ONE_ZERO = bytes(k == 1 for k in range(1, 17)) + b"\x00"


# --- reading


class _Codes:
    """A Huffman table as lookups of 16 bits: ``length`` (0: no such code) and ``symbol``."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[int, tuple[int, int]] = {}
        spans, code, at = [], 0, 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                self.codes[symbols[at]] = (code, length)
                spans.append((1 << (16 - length), length, symbols[at]))
                code, at = code + 1, at + 1
            code <<= 1
        spans.append((65536 - sum(n for n, _, _ in spans), 0, 0))
        sizes, lengths, names = (np.array(x) for x in zip(*spans, strict=True))
        self.length, self.symbol = lengths.astype(np.uint8).repeat(sizes).tobytes(), names.astype(np.uint8).repeat(sizes).tobytes()


_tables: dict[bytes, _Codes] = {}


def _codes(body: bytes) -> _Codes:
    if body not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        _tables[body] = _Codes(body[:16], body[16:])
    return _tables[body]


class _Reader:
    """Bits of one restart interval."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw + b"\xff" * 8, 0
        self._all = None

    @property
    def all(self) -> np.ndarray:
        if self._all is None:
            self._all = np.unpackbits(np.frombuffer(self.raw, np.uint8))
        return self._all

    def symbol(self, codes: _Codes) -> int:
        b = self.at >> 3
        window = int.from_bytes(self.raw[b : b + 4], "big") >> (16 - (self.at & 7)) & 0xFFFF
        length = codes.length[window]
        if not length:
            raise ValueError("no such code")
        self.at += length
        return codes.symbol[window]

    def bits(self, n: int) -> int:
        if not n:
            return 0
        b = self.at >> 3
        x = int.from_bytes(self.raw[b : b + 4], "big") >> (32 - (self.at & 7) - n) & ((1 << n) - 1)
        self.at += n
        return x

    def value(self, n: int) -> int:
        x = self.bits(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1

    def take(self, n: int) -> np.ndarray:
        out = self.all[self.at : self.at + n]
        self.at += n
        return out

    def alike(self, codes: _Codes, count: int) -> tuple[int, np.ndarray] | None:
        """(symbol, values) if the next ``count`` symbols are one that carries all its low four bits as size; else None, and nothing is read."""
        b = self.at >> 3
        window = int.from_bytes(self.raw[b : b + 4], "big") >> (16 - (self.at & 7)) & 0xFFFF
        length, s = codes.length[window], codes.symbol[window]
        step = length + (s & 15)
        if not length or self.at + step * count > 8 * (len(self.raw) - 8):
            return None
        code, n = codes.codes[s][0], s & 15
        if step == 8 and not self.at & 7:
            x = np.frombuffer(self.raw, np.uint8, count, b).astype(np.int32)
        elif step == 1:
            x = self.all[self.at : self.at + count].astype(np.int32)
        elif step < 8:
            grid = self.all[self.at : self.at + step * count].reshape(count, step)
            x = np.packbits(grid, axis=1)[:, 0].astype(np.int32) >> (8 - step)
        else:
            grid = self.all[self.at : self.at + step * count].reshape(count, step)
            x = grid @ (1 << np.arange(step - 1, -1, -1, dtype=np.int32))
        if not (x >> n == code).all():
            return None
        self.at += step * count
        x &= (1 << n) - 1
        return s, (np.where(x >> (n - 1), x, x - (1 << n) + 1) if n else x)


def _dc_first(r: _Reader, parts, owner, flat, codes, low):
    same = r.alike(codes[0], len(flat)) if all(c is codes[0] for c in codes) else None
    if same is not None:
        diff = same[1].astype(np.int64)
    else:
        diff = np.array([r.value(r.symbol(codes[k])) for k in owner.tolist()], np.int64)
    if not diff.any():
        return
    for k, c in enumerate(parts):
        on = owner == k
        c.coef.reshape(-1, 64)[flat[on], 0] = np.cumsum(diff[on]) << low


def _dc_refine(r: _Reader, parts, owner, flat, low):
    bits = r.take(len(flat)).astype(np.int32)
    for k, c in enumerate(parts):
        on = owner == k
        c.coef.reshape(-1, 64)[flat[on], 0] |= bits[on] << low


def _ac_first(r: _Reader, coef, flat, codes, first, last, low):
    width = last - first + 1
    same = r.alike(codes, len(flat) * width)
    if same is not None and 0 < same[0] < 16:
        coef[flat, first : last + 1] = same[1].reshape(-1, width) << low if (same[1] >= 0).all() else _signed_shift(same[1].reshape(-1, width), low)
        return
    if same is not None:
        r.at = 0
    left = 0
    for b in flat.tolist():
        if left:
            left -= 1
            continue
        k = first
        while k <= last:
            s = r.symbol(codes)
            run, size = s >> 4, s & 15
            if size:
                k += run
                v = r.value(size)
                coef[b, k] = v << low if v > 0 else -(-v << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                left = (1 << run) + r.bits(run) - 1
                break


def _signed_shift(v, low):
    return np.sign(v) * (np.abs(v) << low)


def _correct(r: _Reader, coef, where, low):
    """Next bits of the coefficients in ``where`` (rows, places), in order."""
    v = coef[where]
    coef[where] = v + np.sign(v) * (r.take(len(v)).astype(np.int32) << low)


def _ac_refine(r: _Reader, coef, flat, codes, first, last, low):
    i, n = 0, len(flat)
    while i < n:
        b, k = int(flat[i]), first
        while k <= last:
            s = r.symbol(codes)
            run, size = s >> 4, s & 15
            if not size and run < 15:
                blocks = min((1 << run) + r.bits(run), n - i)
                p = np.flatnonzero(coef[b, k : last + 1]) + k
                _correct(r, coef, (np.full(len(p), b), p), low)
                if blocks > 1:
                    rows = flat[i + 1 : i + blocks]
                    y, x = np.nonzero(coef[rows, first : last + 1])
                    _correct(r, coef, (rows[y], x + first), low)
                i += blocks - 1
                break
            v = (1 if r.bits(1) else -1) << low if size else 0
            zeros = np.flatnonzero(coef[b, k : last + 1] == 0) + k
            stop = int(zeros[run]) if run < len(zeros) else last
            p = np.flatnonzero(coef[b, k:stop]) + k
            _correct(r, coef, (np.full(len(p), b), p), low)
            if size:
                coef[b, stop] = v
            k = stop + 1
        i += 1


def decode(raw: bytes) -> Image:
    """Coefficients of a progressive JPEG; errors for other kinds of image."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image = Image(0, 0, [], {})
    tables: dict[int, _Codes] = {}
    at, restart = 2, 0
    data = np.frombuffer(raw, np.uint8)
    marks = np.flatnonzero(data[:-1] == 0xFF)
    marks = marks[(data[marks + 1] != 0) & (data[marks + 1] != 0xFF)]
    while True:
        while raw[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(raw) and raw[at : at + 2] != b"\xff\xd9":
            raise ValueError("the image ends early")
        kind = raw[at + 1]
        if kind == 0xD9:
            return image
        size = struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xFE:
            image.comment = body
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int32)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _codes(body[1 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            layout(image.width, image.height, image.components)
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("not a progressive Huffman image")
        elif kind == 0xDA:
            n = body[0]
            ids = {c.ident: c for c in image.components}
            parts = [ids[body[1 + 2 * k]] for k in range(n)]
            chosen = [body[2 + 2 * k] for k in range(n)]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            high, low = approx >> 4, approx & 15
            after = marks[np.searchsorted(marks, at) :]
            ends = after[(data[after + 1] & 0xF8) != 0xD0][:1]
            stop = int(ends[0]) if len(ends) else len(raw)
            cuts = [at, *(after[after < stop] + 2).tolist()]
            intervals = [raw[a:b] for a, b in zip(cuts, [*(x - 2 for x in cuts[1:]), stop], strict=True)]
            owner, flat = _scan_order(parts)
            per = restart * (sum(c.h * c.v for c in parts) if n > 1 else 1) or len(flat)
            for k, interval in enumerate(intervals):
                own, blocks = owner[k * per : (k + 1) * per], flat[k * per : (k + 1) * per]
                if not len(blocks):
                    break
                r = _Reader(interval.replace(b"\xff\x00", b"\xff"))
                if first == 0 and not high:
                    _dc_first(r, parts, own, blocks, [tables[c >> 4] for c in chosen], low)
                elif first == 0:
                    _dc_refine(r, parts, own, blocks, low)
                else:
                    coef = parts[0].coef.reshape(-1, 64)
                    (_ac_refine if high else _ac_first)(r, coef, blocks, tables[0x10 | chosen[0] & 15], first, last, low)
            at = stop


def _basis() -> np.ndarray:
    """Row k: the 64 samples (row by row) of the k-th coefficient in scan order, times 2**20 and whole: sums of products are then exact in any order."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    wave = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    wave[0] /= np.sqrt(2)
    full = np.einsum("ax,by->abxy", wave, wave).reshape(64, 64)
    return np.rint(full[ZIGZAG] * (1 << 20))


BASIS = _basis()


def samples(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Inverse cosine transform of (blocks, 64) coefficients in scan order: samples row by row, before the shift by 128."""
    x, whole = coef * quant.astype(np.float64), len(coef) // 32 * 32
    out = np.empty((len(coef), 64), np.float32)
    # small products: the linear algebra library starts no threads for them, which tasks side by side would only contend for
    out[:whole] = (x[:whole].reshape(-1, 32, 64) @ BASIS).reshape(-1, 64) / (1 << 20)
    out[whole:] = x[whole:] @ BASIS / (1 << 20)
    return out


def plane(image: Image, c: Component) -> np.ndarray:
    """Samples of a component, float, before the shift by 128."""
    rows, cols, _ = c.coef.shape
    if not c.coef.any():
        return np.zeros((rows * 8, cols * 8), np.float32)
    full = samples(c.coef.reshape(-1, 64), image.quant[c.table])
    return full.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)


def to_rgb(image: Image) -> np.ndarray:
    """(height, width, 3) uint8: inverse transform, chroma repeated to full resolution, colour conversion."""
    hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        p = plane(image, c)
        p = p.repeat(vmax // c.v, axis=0) if c.v < vmax else p
        p = p.repeat(hmax // c.h, axis=1) if c.h < hmax else p
        planes.append(p[: image.height, : image.width])
    y = planes[0] + np.float32(128)
    if len(planes) == 1:
        return np.clip(np.rint(y), 0, 255).astype(np.uint8)[..., None].repeat(3, axis=2)
    cb, cr = planes[1], planes[2]
    if not any(c.coef.any() for c in image.components[1:]):  # grey
        return np.clip(np.rint(y), 0, 255).astype(np.uint8)[..., None].repeat(3, axis=2)
    out = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
