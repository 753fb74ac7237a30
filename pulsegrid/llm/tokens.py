"""Exact ids of the public BPE tokenizers, fast enough for whole corpora.

Both vocabularies split a text before they merge, so a piece between two safe
places has the same ids wherever it stands. A batch's bytes are cut at all safe
places at once and Arrow numbers the distinct pieces; only pieces that this
worker hasn't met go to the tokenizers library, and numpy gathers ids by number.
Ids take two bytes, as both vocabularies are under 65,536.

Safe places, for texts without special tokens' literals:

* before ASCII white space that follows a character which surely isn't white
  space: no alternative of either split pattern goes on from a visible character to white space;
* between an ASCII letter and ASCII punctuation: no alternative holds one before
  the other, and neither composes with nor is reordered past the other;
* for the vocabulary that drops white space, on both sides of ASCII white space.

Everything else (other white space, combining marks, digits) stays inside a piece
and is left to the library. Literals of special tokens are cut out first and give
their own id, as in the library.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa

from pulsegrid.llm.wordhash import buffers

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Pieces a worker remembers at most, about 150 bytes each, and those it keeps when that is full: the first met are the commonest.
MEMO, KEPT = 350_000, 230_000
#: Bytes of text whose pieces are numbered at once.
WINDOW = 2 << 20
#: Pieces that one call of the library takes, joined where their ids can be told apart.
JOINED = 4_000

_OTHER, _SPACE, _LETTER, _DIGIT, _MARK, _HIGH = range(6)
_KIND = np.full(256, _OTHER, np.uint8)  # control characters are other: some libraries call them white space
_KIND[[32, 9, 10, 11, 12, 13]] = _SPACE
for _c in range(33, 127):
    _KIND[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _MARK
_KIND[128:] = _HIGH
#: Whether a piece may end between bytes of two kinds (kind before * 6 + kind after).
_CUT = np.zeros(36, bool)
_CUT[[6 * k + _SPACE for k in (_LETTER, _DIGIT, _MARK, _HIGH)] + [6 * _LETTER + _MARK]] = True
#: Last two bytes of the Unicode white space that UTF-8 writes in three bytes or two.
_WIDE_SPACES = (b"\xc2\x85", b"\xc2\xa0", b"\x9a\x80", *(bytes([0x80, c]) for c in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f")
_AFTER_WIDE = np.zeros(65_536, bool)
_AFTER_WIDE[[256 * a + b for a, b in _WIDE_SPACES]] = True


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Places inside ``data`` (UTF-8 bytes of one or more texts) where a piece may end."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    at = np.flatnonzero(_CUT[kind[:-1] * 6 + kind[1:]]) + 1
    high = np.flatnonzero(kind[at - 1] == _HIGH)
    if len(high):  # a last byte that some Unicode white space shares: leave the piece whole
        where = at[high]
        bad = _AFTER_WIDE[data[where - 2].astype(np.int64) * 256 + data[where - 1]]
        if bad.any():
            keep = np.ones(len(at), bool)
            keep[high[bad]] = False
            at = at[keep]
    return at


class Encoder:
    """``encode(texts)`` gives the ids of an Arrow array of texts, and the bounds of each text's; null counts as empty."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if kind not in ("byte", "word"):
            raise ValueError(f"kind is byte or word: {kind}")
        self.tok, self.kind = Tokenizer.from_file(path), kind
        if self.tok.get_vocab_size() > 65_536:
            raise ValueError("ids don't fit two bytes")
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self._literal = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._needles = [s.encode() for s in self.special]
        # ids that begin with a space, or end a word: they part pieces that were encoded in one call
        self.edge = np.zeros(65_536, bool)
        self.edge[[i for t, i in self.tok.get_vocab().items() if (t.endswith("</w>") if kind == "word" else t.startswith("Ġ"))]] = True
        self.memo: dict[bytes, int] = {}
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint16), 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint16, bounds int64): text i has ids[bounds[i]:bounds[i + 1]]."""
        data, bounds = buffers(texts)
        raw = data.tobytes()
        if any(s in raw for s in self._needles):
            return self._with_literals(raw, bounds)
        return self._plain(data, bounds)

    def _with_literals(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of which some hold literals: what lies between them is encoded as texts of its own."""
        parts, owner, ids = [], [], []
        for i, (a, b) in enumerate(zip(bounds.tolist(), bounds.tolist()[1:], strict=False)):
            for part in self._literal.split(raw[a:b].decode()):
                if part:
                    parts.append("" if part in self.special else part)
                    ids.append(self.special.get(part, -1))
                    owner.append(i)
        flat, at = self._plain(*buffers(pa.array(parts, pa.large_string())))
        pieces = [np.array([k], np.uint16) if k >= 0 else flat[at[j] : at[j + 1]] for j, k in enumerate(ids)]
        sizes = np.bincount(owner, [len(p) for p in pieces], len(bounds) - 1).astype(np.int64)
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)])

    def _plain(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "word" and len(data):  # this vocabulary drops white space, which parts pieces whatever stands beside it
            space = _KIND[data] == _SPACE
            kept = np.concatenate([[0], np.cumsum(~space)])
            inner = kept[np.r_[safe_cuts(data), np.flatnonzero(space)]]
            data, bounds = data[~space], kept[bounds]
        else:
            inner = safe_cuts(data)
        mark = np.zeros(len(data) + 1, bool)
        mark[inner] = mark[bounds] = True
        cuts = np.flatnonzero(mark)  # distinct, so empty texts have no piece
        out, counts = [np.zeros(0, np.uint16)], [np.zeros(1, np.int64)]
        windows = np.unique(np.r_[np.searchsorted(cuts, np.arange(0, len(data), WINDOW)), len(cuts) - 1])
        for a, b in zip(windows.tolist(), windows.tolist()[1:], strict=False):
            pieces = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(np.ascontiguousarray(cuts[a : b + 1])), pa.py_buffer(data)])
            coded = pieces.dictionary_encode()
            row = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            n = self.count[row]
            end = np.cumsum(n)
            out.append(self.flat[np.repeat(self.first[row] - (end - n), n) + np.arange(int(end[-1]))])
            counts.append(n)
        return np.concatenate(out), np.cumsum(np.concatenate(counts))[np.searchsorted(cuts, bounds)]

    def _rows(self, pieces: list[bytes]) -> np.ndarray:
        """Memo rows of distinct pieces."""
        memo = self.memo
        rows = list(map(memo.get, pieces))
        new = [p for p, r in zip(pieces, rows, strict=True) if r is None]
        if new:
            if len(memo) + len(new) > MEMO and len(memo) > KEPT:
                self.memo = dict(islice(memo.items(), KEPT))  # rows are numbered as they were met
                self.used = int(self.first[KEPT])
                return self._rows(pieces)
            self._learn(new)
            rows = [memo[p] if r is None else r for p, r in zip(pieces, rows, strict=True)]
        return np.array(rows, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        texts = [p.decode() for p in new]
        alone = []
        if self.kind == "word":
            # one word each: letters only, also after the normaliser's lower-casing
            mine = [k for k, t in enumerate(texts) if t.isalpha() and t.lower().isalpha()]
        else:
            # one space, at the front
            mine = [k for k, t in enumerate(texts) if t[0] == " " and len(t) > 1 and not any(map(str.isspace, t[1:]))]
        for a in range(0, len(mine), JOINED):
            part = mine[a : a + JOINED]
            ids = np.array(self.tok.encode_batch_fast([(" " if self.kind == "word" else "").join([texts[k] for k in part])], add_special_tokens=False)[0].ids, np.uint16)
            edge = np.flatnonzero(self.edge[ids])
            # every piece gives one edge id at least, so as many edges as pieces means one each
            if len(edge) == len(part):
                cut = edge + 1 if self.kind == "word" else edge
                cut = np.concatenate([[0], cut]) if self.kind == "word" else np.append(cut, len(ids))
                self._keep([new[k] for k in part], ids, np.diff(cut))
            else:
                alone += part
        alone += sorted(set(range(len(new))).difference(mine))
        for a in range(0, len(alone), 20_000):
            part = alone[a : a + 20_000]
            got = [e.ids for e in self.tok.encode_batch_fast([texts[k] for k in part], add_special_tokens=False)]
            self._keep([new[k] for k in part], np.array([i for ids in got for i in ids], np.uint16), np.array([len(ids) for ids in got], np.int64))

    def _keep(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        row, room = len(self.memo), self.used + len(ids)
        while len(self.first) < row + len(pieces):
            self.first, self.count = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.first, self.count))
        while len(self.flat) < room:
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint16)])
        self.flat[self.used : room] = ids
        self.count[row : row + len(pieces)] = sizes
        self.first[row : row + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.memo.update(zip(pieces, range(row, row + len(pieces)), strict=True))
        self.used = room


def closed(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) with ``end`` after each text's ids."""
    bounds = bounds + np.arange(len(bounds))
    out = np.full(int(bounds[-1]), end, np.uint16)
    own = np.ones(len(out), bool)
    own[bounds[1:] - 1] = False
    out[own] = ids
    return out, bounds


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
