"""Jaccard self-join of documents on word n-grams with signature trees.

Sets are distinct 64-bit hashes of word n-grams. Documents with one set form a
class; links are sought between classes. ``Terms`` hold the words of an n-gram and
the least similarity; op3's are 3 words and 0.9.

*Blocking, exact.* Sets at similarity t differ in at most D = size * (1 - t) / t
elements. Hash space is cut into K > D parts; some part then agrees in full, so
classes that agree on a part's content are candidates. K steps through fixed
levels, a class takes the one for its size and, near a step, the one for its
largest partner. Parts of under three shingles (two, one at lower similarities) say
little (a shingle of a common passage may stand alone there), so a class sends
them only when it has as many of them as could hide its one agreeing part: K - D
or more; empty parts only when these alone are as many. Within a map task a
part is sent once, by one class, and its other holders are tied to that class.

*Trees.* Candidate components are dealt to tasks with their classes' sets. A task
builds a tree whose nodes hold the union and intersection of token bitmaps and
the size range below them, and walks pairs of nodes: a pair goes when its
largest possible overlap is too small, or when everything below is already
linked. What remains at the leaves is compared element by element.

*Large components*, which chance agreements chain together and which outgrow the
input, are first cut by pairs: the classes of each part, and no others, are compared
by odd sketches, bitmaps of two to four bits a shingle that differ at no more places
than their sets do. Components of the pairs that pass are dealt as above.

*What stays large* is dealt in blocks by hash. Every block first meets a hub
block; then only the classes outside their component's largest group meet all
blocks. So copies by the thousand cost a few comparisons each, and no pair that
could add a link is left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import every, fresh, frugal, lean, staged, table
from pulsegrid.llm.components import components
from pulsegrid.llm.wordhash import hash_words, mix64, slices

N, NUM, DEN = 3, 9, 10
CHUNK_BYTES = 1 << 20
#: Shingles of a block of a large component: 4 MB of sets.
BLOCK_SHINGLES = 500_000
#: What a set counts for at least in a block, so that a block holds at most 2,000 sets.
SET_WEIGHT = 250
#: Shingles under which a part is weak.
WEAK = 3
WORDS_OF_BITMAP = 8
#: Bits that tell which texts may be a candidate class's: 8 MB at most.
BITMAP_SLOTS = 1 << 26
LEAF, FAN = 16, 8
#: Bytes of a task's sketches, and pairs and words of them that are compared at a time.
SKETCH_BYTES, PAIRS, WORDS = 4 << 20, 1 << 17, 1 << 22


@dataclass(frozen=True)
class Terms:
    """Words of an n-gram, and the least similarity as ``num`` / ``den``."""

    n: int = N
    num: int = NUM
    den: int = DEN

    @staticmethod
    def of(n: int, threshold: float) -> Terms:
        t = Fraction(str(threshold))
        if n < 1 or not 0 < t <= 1:
            raise ValueError(f"an n-gram has a word at least and a similarity is in (0, 1]: {n}, {threshold}")
        return Terms(n, t.numerator, t.denominator)

    def differing(self, size):
        """Elements in which a set of ``size`` and one that is similar differ at most."""
        return size * (self.den - self.num) // self.num

    @property
    def weak(self) -> int:
        """Shingles under which a part is weak: at most ``WEAK``, fewer where parts have to be small."""
        return WEAK if self.den == self.num else min(WEAK, max(1, self.num // (self.den - self.num) // 2))


OP3 = Terms()


def shingle_sets(texts: pa.Array, n_words: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of all texts, bounds of each text's)."""
    w = hash_words(texts, lower=True)
    n = np.diff(w.first)
    ok = w.fits(n_words)
    h, doc = w.windows(n_words)[ok], w.text_of[ok]
    for short in range(1, n_words):  # a text of fewer words is one shingle
        at = w.first[:-1][n == short]
        if len(at):
            h, doc = np.r_[h, w.windows(short)[at]], np.r_[doc, w.text_of[at]]
    by = np.lexsort((h, doc))
    h, doc = h[by], doc[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def class_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit key of each set; texts of one set share it."""
    size = np.diff(bounds).astype(np.uint64)
    return mix64(_sums(mix64(h + np.uint64(11)), bounds) + size * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _levels() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(-(-out[-1] * 3 // 2))
    return np.array(out)


_LEVELS = _levels()


def _level(n: np.ndarray, terms: Terms) -> np.ndarray:
    """Place in ``_LEVELS`` of the parts for sets of ``n`` shingles: more than may differ, with room for weak parts in large sets."""
    d = terms.differing(n)
    return np.searchsorted(_LEVELS, np.where(d < 5, d + 1, d * 5 // 4 + 3))


def part_signatures(h: np.ndarray, bounds: np.ndarray, terms: Terms = OP3) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) of the parts that the texts' sets send."""
    n = np.diff(bounds)
    mixed = mix64(h + np.uint64(23))
    own = np.repeat(np.arange(len(n)), n)
    lo, hi, differ = _level(n, terms), _level(n * terms.den // terms.num, terms), terms.differing(n)
    sigs, docs = [], []
    for step in range(int((hi - lo).max(initial=0)) + 1):
        k, use = _LEVELS[lo + step], (n > 0) & (lo + step <= hi)
        if not use.any():
            continue
        here = use[own]
        hh, d = h[here], own[here]
        part = ((hh >> np.uint64(32)) * k[d].astype(np.uint64)) >> np.uint64(32)
        start = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[start, len(hh)])
        run_doc, run_part = d[start], part[start]
        sig = _signature(_sums(mixed[here], np.r_[start, len(hh)]), k[run_doc], run_part)
        strong = size >= terms.weak
        all_of = use & (k - np.bincount(run_doc[strong], minlength=len(n)) >= k - differ)
        send = strong | all_of[run_doc]
        sigs.append(sig[send])
        docs.append(run_doc[send])
        for i in np.flatnonzero(use & (k - np.bincount(run_doc, minlength=len(n)) >= k - differ)):
            empty = np.setdiff1d(np.arange(k[i], dtype=np.uint64), run_part[run_doc == i])
            sigs.append(_signature(np.zeros(len(empty), np.uint64), np.full(len(empty), k[i]), empty))
            docs.append(np.full(len(empty), i))
    return (np.concatenate(sigs), np.concatenate(docs)) if sigs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _signature(content, k, part):
    return mix64(content ^ mix64(k.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + part.astype(np.uint64)))


def _pieces(batches):
    for batch in batches:
        for a, b in slices(batch.column(1), CHUNK_BYTES):
            yield batch.slice(a, b - a)


def _classify(terms, batches):
    for piece in _pieces(batches):
        h, bounds = shingle_sets(piece.column(1), terms.n)
        yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(np.diff(bounds), pa.int64()), pa.array(class_keys(h, bounds))], ["doc_id", "th", "n", "cls"])


def _send_parts(terms, batches):
    for piece in _pieces(batches):
        h, bounds = shingle_sets(piece.column(1), terms.n)
        cls = class_keys(h, bounds)
        sig, doc = part_signatures(h, bounds, terms)
        # distinct (signature, class); the first class of a signature speaks for the others, which a private key ties to it
        by = np.lexsort((cls[doc], sig))
        sig, c = sig[by], cls[doc][by]
        first = np.r_[True, sig[1:] != sig[:-1]] if len(sig) else np.zeros(0, bool)
        lead = c[first][np.cumsum(first) - 1] if len(sig) else c
        other = ~first & (c != lead)
        pair = np.unique(np.stack([lead[other], c[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
        key = mix64(mix64(pair[:, 0].view(np.uint64)) + pair[:, 1].view(np.uint64)).view(np.int64) if len(pair) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([sig[first].view(np.int64), key, key])), pa.array(np.concatenate([c[first], pair[:, 0], pair[:, 1]]))], ["sig", "cls"])


def _set_rows(terms, batches):
    """(.., text) rows to (.., set) rows: the sorted hashes as bytes."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for a, b in slices(batch.column(at), CHUNK_BYTES):
            piece = batch.slice(a, b - a)
            h, bounds = shingle_sets(piece.column(at), terms.n)
            raw = [h[x:y].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)]
            names = ["cls", "comp", "blocks"]
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in names], pa.array(raw, pa.binary())], [*names, "set"])


def odd_sketches(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parities of the hashes at each place of a bitmap, which has a power of two places, 64 and two a shingle at least.

    An element in which two sets differ flips one place, so their bitmaps differ at no more places than the sets in elements. A bitmap folds to a shorter one.
    """
    n = np.diff(bounds)
    places = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1)))).astype(np.int64)
    first = np.r_[0, np.cumsum(places)]
    own = np.repeat(np.arange(len(n)), n)
    at = first[own] + (mix64(h + np.uint64(37)) & (places[own] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=first[-1]) & 1).astype(np.uint8), bitorder="little")
    return [bits[a:b].tobytes() for a, b in zip(first // 8, first[1:] // 8, strict=False)]


class Sketches:
    """Odd sketches of sets of ``n`` shingles."""

    def __init__(self, raw: list[bytes], n: np.ndarray, terms: Terms):
        self.n, self.terms, self.raw, self.folded = n, terms, raw, {}
        self.level = np.log2(np.array([len(x) for x in raw], np.int64) // 8).astype(np.int64)

    def _at(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of each sketch, sketches) of at least 2**level words, folded to as many."""
        if level not in self.folded:
            place, parts, rows = np.full(len(self.n), -1), [], 0
            for k in np.unique(self.level[self.level >= level]):
                at = np.flatnonzero(self.level == k)
                words = np.frombuffer(b"".join(self.raw[i] for i in at), np.uint64).reshape(len(at), 1 << (k - level), 1 << level)
                parts.append(np.bitwise_xor.reduce(words, axis=1))
                place[at] = rows + np.arange(len(at))
                rows += len(at)
            self.folded[level] = place, np.concatenate(parts)
        return self.folded[level]

    def allow(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the sets i and j may be similar, for each pair; False is certain."""
        num, den = self.terms.num, self.terms.den
        n, m = self.n[i], self.n[j]
        out = den * np.minimum(n, m) >= num * np.maximum(n, m)
        level = np.minimum(self.level[i], self.level[j])
        for k in np.unique(level[out]):
            place, words = self._at(k)
            asked = np.flatnonzero(out & (level == k))
            for a in range(0, len(asked), step := max(1, WORDS >> k)):
                at = asked[a : a + step]
                differ = np.bitwise_count(words[place[i[at]]] ^ words[place[j[at]]]).sum(axis=1, dtype=np.int64)
                out[at] = (num + den) * differ <= (den - num) * (n[at] + m[at])
        return out


def _sketch_rows(terms, batches):
    for piece in _texts(batches):
        h, bounds = shingle_sets(piece, terms.n)
        yield pa.RecordBatch.from_arrays([pa.array(class_keys(h, bounds)), pa.array(np.diff(bounds), pa.int64()), pa.array(odd_sketches(h, bounds), pa.binary())], ["cls", "n", "sketch"])


def _part_rows(terms, batches):
    for piece in _texts(batches):
        h, bounds = shingle_sets(piece, terms.n)
        sig, doc = part_signatures(h, bounds, terms)
        yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(class_keys(h, bounds)[doc]), pa.array(np.diff(bounds)[doc], pa.int64())], ["sig", "cls", "n"])


def _texts(batches):
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        for a, b in slices(text, CHUNK_BYTES):
            yield text.slice(a, b - a)


def _allowed_rows(terms, batches):
    """(u, v, n and sketch of both) rows to (u, v) of those that may be similar."""
    for batch in batches:
        k = len(batch)
        n = np.concatenate([batch.column(c).to_numpy() for c in ("nu", "nv")])
        sketches = Sketches([*batch.column("su").to_pylist(), *batch.column("sv").to_pylist()], n, terms)
        keep = pa.array(sketches.allow(np.arange(k), k + np.arange(k)))
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])


def _spread(lo: np.ndarray, hi: np.ndarray):
    """(i, j) for every j of [lo[i], hi[i])."""
    count = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(lo)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + lo[i]


def _cross_task(terms: Terms, key: tuple, rows: pa.Table) -> pa.Table:
    """Pairs (u, v) of classes of one part whose labels differ and whose sizes allow a link, once each."""
    sig, cls, label, n = (rows.column(c).to_numpy() for c in ("sig", "cls", "label", "n"))
    by = np.lexsort((label, sig))
    sig, cls, label, n = sig[by], cls[by], label[by], n[by]
    ends = lambda new: np.r_[np.flatnonzero(new) + 1, len(sig)][np.cumsum(np.r_[0, new])]
    part = sig[1:] != sig[:-1]
    lo, hi = ends(part | (label[1:] != label[:-1])), ends(part)
    found, total = [np.zeros((0, 2), np.int64)], np.cumsum(hi - lo)
    for a, b in _runs(total):
        i, j = _spread(lo[a:b], hi[a:b])
        i = i + a
        near = terms.den * np.minimum(n[i], n[j]) >= terms.num * np.maximum(n[i], n[j])
        found.append(np.unique(np.sort(np.stack([cls[i[near]], cls[j[near]]], axis=1), axis=1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def _runs(total: np.ndarray):
    """[a, b) of rows with about ``PAIRS`` pairs, from the running total; a row at least."""
    a = 0
    while a < len(total):
        before = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + PAIRS, "right")))
        yield a, b
        a = b


def _group_task(terms: Terms, key: tuple, rows: pa.Table) -> pa.Table:
    """Links (u, v) that join the classes of each part wherever sketches allow it; of blocks b and c, pairs between them."""
    n, sig = rows.column("n").to_numpy(), rows.column("sig").to_numpy()
    by = np.lexsort((n, sig))
    n, sig, cls, block = n[by], sig[by], rows.column("cls").to_numpy()[by], rows.column("block").to_numpy()[by]
    _, label = np.unique(rows.column("label").to_numpy()[by], return_inverse=True)
    raw = rows.column("sketch").to_pylist()
    sketches = Sketches([raw[i] for i in by], n, terms)
    part = np.cumsum(np.r_[0, sig[1:] != sig[:-1]])
    # the last row of the part that isn't too large
    wide = int(n.max()) * terms.den // terms.num + 2
    hi = np.searchsorted(part * wide + n, part * wide + n * terms.den // terms.num, "right")
    lo = np.arange(1, len(n) + 1)
    group = np.arange(label.max() + 1)
    u, v = [], []
    for a, b in _runs(np.cumsum(np.maximum(hi - lo, 0))):
        i, j = _spread(lo[a:b], hi[a:b])
        i = i + a
        asked = (group[label[i]] != group[label[j]]) & ((key[1] == key[2]) | (block[i] != block[j]))
        i, j = i[asked], j[asked]
        ok = sketches.allow(i, j)
        i, j = i[ok], j[ok]
        while len(i):  # a link, and then what is left to link
            x, y = group[label[i]], group[label[j]]
            new = x != y
            i, j, x, y = i[new], j[new], x[new], y[new]
            if not len(i):
                break
            low, high = np.minimum(x, y), np.maximum(x, y)
            high, at = np.unique(high, return_index=True)  # each group goes under one that is lower
            to = np.arange(len(group))
            to[high] = low[at]
            while (to[to] != to).any():
                to = to[to]
            group = to[group]
            u.append(cls[i[at]])
            v.append(cls[j[at]])
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
    return pa.Table.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


class Tree:
    """A signature tree over sets: per node OR and AND bitmaps, size range, and its rows [lo, hi) in tree order."""

    def __init__(self, sets: list[np.ndarray], terms: Terms = OP3):
        self.terms = terms
        n = len(sets)
        size = np.array([len(s) for s in sets])
        bits = np.zeros((n, WORDS_OF_BITMAP), np.uint64)
        own = np.repeat(np.arange(n), size)
        flat = np.concatenate(sets)
        place = (flat >> np.uint64(20)) % np.uint64(64 * WORDS_OF_BITMAP)
        np.bitwise_or.at(bits, (own, (place >> np.uint64(6)).astype(int)), np.uint64(1) << (place & np.uint64(63)))
        least = np.array([s[0] for s in sets])
        # like sizes and like least hashes side by side: near copies mostly share both
        self.order = np.lexsort((least, np.log(size) // 0.1))
        self.sets = [sets[i] for i in self.order]
        self.size, self.bits = size[self.order], bits[self.order]
        lo = np.arange(0, n, LEAF)
        levels = [self._level(lo, np.minimum(lo + LEAF, n))]
        while len(levels[-1]["lo"]) > 1:
            below = levels[-1]
            first = np.arange(0, len(below["lo"]), FAN)
            last = np.minimum(first + FAN, len(below["lo"])) - 1
            levels.append(self._level(below["lo"][first], below["hi"][last]) | {"kids": list(zip(first, last + 1, strict=True))})
        self.levels = levels

    def _level(self, lo, hi):
        return {
            "lo": lo, "hi": hi,
            "any": np.bitwise_or.reduceat(self.bits, lo, axis=0), "all": np.bitwise_and.reduceat(self.bits, lo, axis=0),
            "min": np.minimum.reduceat(self.size, lo), "max": np.maximum.reduceat(self.size, lo),
        }

    def links(self, group: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
        """Groups after linking: ``group`` holds equal numbers for rows already linked (tree order), and is refined in place.

        With ``side`` (booleans) only pairs with a True are sought.
        """
        num, den = self.terms.num, self.terms.den
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            t = self.levels[level]
            g = group[t["lo"][a] : t["hi"][a]], group[t["lo"][b] : t["hi"][b]]
            if g[0].min() == g[0].max() == g[1].min() == g[1].max():
                continue
            if side is not None and not (side[t["lo"][a] : t["hi"][a]].any() or side[t["lo"][b] : t["hi"][b]].any()):
                continue
            # least bits of a set below one node that no set below the other has: tokens they can't share
            only_a = int(np.bitwise_count(t["all"][a] & ~t["any"][b]).sum())
            only_b = int(np.bitwise_count(t["all"][b] & ~t["any"][a]).sum())
            if den * t["max"][a] - num * t["min"][b] < (num + den) * only_a or den * t["max"][b] - num * t["min"][a] < (num + den) * only_b:
                continue
            if level == 0:
                self._leaf(t["lo"][a], t["hi"][a], t["lo"][b], t["hi"][b], group, side)
                continue
            (a0, a1), (b0, b1) = t["kids"][a], t["kids"][b]
            stack += [(level - 1, x, y) for x in range(a0, a1) for y in range(b0, b1) if a != b or y >= x]
        return group

    def _leaf(self, a0, a1, b0, b1, group, side):
        x, y = self.bits[a0:a1, None], self.bits[None, b0:b1]
        n, m = self.size[a0:a1, None], self.size[None, b0:b1]
        most = np.minimum(n - np.bitwise_count(x & ~y).sum(axis=2, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=2, dtype=np.int64))
        may = ((self.terms.num + self.terms.den) * most >= self.terms.num * (n + m)) & (group[a0:a1, None] != group[None, b0:b1])
        if a0 == b0:
            may &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)
        if side is not None:
            may &= side[a0:a1, None] | side[None, b0:b1]
        for i, j in zip(*np.nonzero(may), strict=True):
            i, j = i + a0, j + b0
            if group[i] != group[j] and similar(self.sets[i], self.sets[j], self.terms):
                group[group == group[j]] = group[i]


def similar(x: np.ndarray, y: np.ndarray, terms: Terms = OP3) -> bool:
    """den * intersection >= num * union, of sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return (terms.num + terms.den) * int((y[at] == x).sum()) >= terms.num * (len(x) + len(y))


def _link_task(terms: Terms, key: tuple, rows: pa.Table) -> pa.Table:
    """Links of one task's sets, as (u, v) from each class to one of its group."""
    cls = rows.column("cls").to_numpy()
    tree = Tree([np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()], terms)
    cls = cls[tree.order]
    _, group = np.unique(rows.column("label").to_numpy()[tree.order], return_inverse=True)
    side = rows.column("probe").to_numpy(zero_copy_only=False)[tree.order]
    tree.links(group, None if side.all() else side)
    _, lead = np.unique(group, return_index=True)
    lead_of = dict(zip(group[lead].tolist(), cls[lead].tolist(), strict=True))
    u, v = cls, np.array([lead_of[g] for g in group.tolist()], np.int64)
    keep = u != v
    return pa.Table.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])


def _tasks(rows: DataFrame, terms: Terms) -> DataFrame:
    # dealt anew, as a dealing by component alone would bring all blocks of a large one to one task
    return rows.repartition("comp", "rb", "b").groupBy("comp", "rb", "b").applyInArrow(lambda key, rows: _link_task(terms, key, rows), "u long, v long")


def _marked(rows: DataFrame, speaks: DataFrame) -> DataFrame:
    """(id, h, text) of the ``rows`` that may be one of ``speaks`` (id, h), without moving any: few others pass."""
    told = F.xxhash64("id", "h")
    marked = rows.withColumns({"id": _named(F.col("doc_id")), "h": F.col("th")}).join(F.broadcast(_bitmap(speaks, told)), F.bitmap_bucket_number(_slot(told)) == F.col("bucket"))
    return marked.where(_holds(F.col("bits"), F.bitmap_bit_position(_slot(told)))).select("id", "h", "text")


def _named(c):
    return F.coalesce(c, F.lit(-(1 << 63)))


def _allowed(pairs: DataFrame, drawn: DataFrame, terms: Terms) -> DataFrame:
    one, two = (drawn.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "uv")
    return pairs.join(one, "u").join(two, "v").select("u", "v", "nu", "nv", "su", "sv").mapInArrow(frugal(partial(_allowed_rows, terms)), "u long, v long")


def _refined(rows: DataFrame, speaks: DataFrame, terms: Terms) -> DataFrame:
    """(cls, comp) of the classes ``speaks`` stands for, by the pairs that agree on a part and that sketches allow; a class without such a pair has none.

    Every link is such a pair, so components of these pairs hold all links. Parts are cut again from the classes' texts, which don't move. First each class
    meets the least class of each of its parts. Then parts that still hold several groups are compared in full, as pairs where these are few, which many
    parts may share, and as rows with sketches otherwise: a part's rows are dealt once, and those of one beyond ``SKETCH_BYTES`` in pairs of blocks.
    """
    marked = _marked(rows, speaks)
    drawn = staged(marked.mapInArrow(frugal(partial(_sketch_rows, terms)), "cls long, n long, sketch binary").dropDuplicates(["cls"]), "sketches")
    part = W.partitionBy("sig")
    shared = marked.mapInArrow(frugal(partial(_part_rows, terms)), "sig long, cls long, n long").withColumns({"head": F.min("cls").over(part), "last": F.max("cls").over(part)})
    shared = staged(shared.where("head <> last").drop("last"), "shared")
    links = staged(_allowed(shared.where("cls <> head").select(F.col("cls").alias("u"), F.col("head").alias("v")).distinct(), drawn, terms), "links")
    label = components(links).select(F.col("node").alias("cls"), F.col("root").alias("label"))
    mixed = shared.join(label, "cls", "left").select("sig", "cls", "n", F.coalesce("label", "cls").alias("label")).distinct()
    weight = F.col("n") * 3 / 8 + 64
    mixed = mixed.withColumns({"g": F.count("*").over(part), "own": F.count("*").over(W.partitionBy("sig", "label"))}).where("own < g")
    mixed = mixed.withColumns({"cross": F.sum(F.col("g") - F.col("own")).over(part) / 2, "bytes": F.sum(weight).over(part)})
    mixed = staged(mixed, "mixed")
    few = F.col("cross") <= F.col("g") * F.greatest(F.col("n") / 256, F.lit(1))
    few = mixed.groupBy("sig").agg(F.min(few).alias("few"))
    mixed = mixed.join(few, "sig")
    total = mixed.agg(F.sum(F.when(F.col("few"), 64).otherwise(weight)).alias("bytes")).first().bytes or 0
    task = F.pmod(F.xxhash64("sig"), F.lit(int(total // SKETCH_BYTES) + 1))
    pairs = mixed.where("few").select("sig", "cls", "label", "n", task.alias("task")).groupBy("task").applyInArrow(lambda key, rows: _cross_task(terms, key, rows), "u long, v long").distinct()
    dealt = mixed.where("NOT few").withColumn("blocks", F.ceil(F.col("bytes") / SKETCH_BYTES).cast("long")).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(drawn.select("cls", "sketch"), "cls")
    dealt = dealt.select(F.when(F.col("blocks") > 1, F.col("sig")).otherwise(task).alias("task"), F.least("block", "other").alias("b"), F.greatest("block", "other").alias("c"), "sig", "cls", "n", "label", "block", "sketch")
    # dealt by all three, as above
    more = dealt.repartition("task", "b", "c").groupBy("task", "b", "c").applyInArrow(lambda key, rows: _group_task(terms, key, rows), "u long, v long")
    links = links.unionByName(_allowed(pairs, drawn, terms)).unionByName(more)
    return components(links).select(F.col("node").alias("cls"), F.col("root").alias("comp"))


def _slot(key):
    """A key's place in a bitmap of ``BITMAP_SLOTS``, from 1."""
    return F.pmod(key, F.lit(BITMAP_SLOTS)) + 1


def _bitmap(rows: DataFrame, key) -> DataFrame:
    """Which slots the keys of ``rows`` take: bucket, bits. At most ``BITMAP_SLOTS`` / 32,768 rows of 4 KB, whatever ``rows`` holds."""
    at = rows.select(_slot(key).alias("slot"))
    return at.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def _holds(bits, place):
    """Whether a bitmap has the bit of ``place``."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = NUM / DEN) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, cls, root, th, by distinct ``n``-word shingles and a similarity of ``threshold`` at least.

    ``component_id`` is the component's smallest id, ``root`` its key (null without
    shingles), ``th`` a hash of the text. Null, empty and blank texts have no
    shingles and link with nothing: their own id is their component's. Rows that
    repeat an id are rows of their own, whatever texts they have. Rows without an id
    link like others but never name a component; one of them alone has none. Very
    long texts are read whole. An empty table gives no rows; other columns are ignored.

    Shingles and classes are 64-bit hashes: below 10**9 documents a false merge is unlikely (a chance of 3 %).
    """
    terms = Terms.of(n, threshold)
    lean(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    of = staged(rows.mapInArrow(frugal(partial(_classify, terms)), "doc_id long, th long, n long, cls long"), "classes")
    folded = of.where("n > 0").groupBy("cls", "n", "doc_id", "th").agg(F.count("*").alias("rows"))
    classes = folded.groupBy("cls").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.min(F.struct("doc_id", "th", "rows")).alias("speaker"))
    # one shuffle of parts, which take more room than texts; a part has at most one row a slice of ``CHUNK_BYTES``, however many texts hold it
    sent = rows.mapInArrow(frugal(partial(_send_parts, terms)), "sig long, cls long")
    head = F.min("cls").over(W.partitionBy("sig"))
    near = sent.withColumn("head", head).where("cls <> head").select(F.col("cls").alias("u"), F.col("head").alias("v")).distinct()
    groups = components(near).select(F.col("node").alias("cls"), F.col("root").alias("comp"))
    cand = staged(groups.join(classes, "cls"), "candidates")
    sized = lambda c: c.groupBy("comp").agg(F.greatest(F.ceil(F.sum(F.greatest("n", F.lit(SET_WEIGHT))) / BLOCK_SHINGLES), F.lit(1)).cast("long").alias("blocks"))
    speaker = lambda c: c.select("cls", "comp", _named(F.col("speaker.doc_id")).alias("id"), F.col("speaker.th").alias("h"), F.col("speaker.rows").alias("rows"))
    large = sized(cand).where("blocks > 1").select("comp")
    if large.limit(1).count():
        fine = _refined(rows, speaker(cand.join(large, "comp")), terms)
        cut = cand.join(large, "comp").drop("comp").join(fine, "cls").select(*cand.columns)
        cand = staged(cand.join(large, "comp", "left_anti").select(*cand.columns).unionByName(cut), "refined")
    size = sized(cand)
    # one text of each candidate class becomes its set, once; only texts that may be speakers move; the join decides
    speaks = speaker(cand)
    held = _marked(rows, speaks).join(speaks.join(size, "comp").hint("shuffle_hash"), ["id", "h"]).select("cls", "comp", "blocks", "text", "rows")
    if cand.where("speaker.rows > 1").limit(1).count():  # rows repeated whole
        held = held.where("rows = 1").unionByName(held.where("rows > 1").dropDuplicates(["cls"]))
    held = held.mapInArrow(frugal(partial(_set_rows, terms)), "cls long, comp long, blocks long, set binary")
    sets = staged(held, "sets").withColumn("b", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    first = sets.withColumn("label", F.col("cls")).withColumn("probe", F.lit(True)).withColumn("rb", F.lit(0).cast("long"))
    hub = first.where("b = 0 AND blocks > 1").withColumn("b", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)))
    cols = ["cls", "comp", "label", "probe", "set", "rb", "b"]
    links = staged(_tasks(first.select(*cols).unionByName(hub.select(*cols)), terms), "links")
    big = size.where("blocks > 1")
    if big.limit(1).count():
        found = components(links)
        named = sets.where("blocks > 1").select("cls", "comp").join(found.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "comp", F.coalesce("root", "cls").alias("label"))
        named = staged(named, "labels")
        count = named.groupBy("comp", "label").agg(F.count("*").alias("k"))
        main = count.groupBy("comp").agg(F.max(F.struct("k", "label")).alias("m")).select("comp", F.col("m.label").alias("main"))
        named = named.join(main, "comp").select("cls", "label", (F.col("label") != F.col("main")).alias("out"))
        left = sets.where("blocks > 1").join(named, "cls")
        few = left.where("out").groupBy("comp").agg(F.ceil(F.sum(F.greatest(F.length("set") / 8, F.lit(SET_WEIGHT))) / BLOCK_SHINGLES).cast("long").alias("rblocks"))
        left = left.join(few, "comp")  # components without such classes are done
        probe = left.where("out").withColumn("rb", F.pmod(F.xxhash64("cls", F.lit("rb")), F.col("rblocks")))
        probe = probe.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("probe", F.lit(True))
        rest = left.withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rblocks") - 1))).withColumn("probe", F.lit(False))
        again = _tasks(probe.select(*cols).unionByName(rest.select(*cols)), terms)
        links = staged(links.unionByName(again), "links")
    linked = components(links).select(F.col("node").alias("cls"), "root").join(classes.select("cls", "least"), "cls")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(least, "root").select("cls", "component", "root")
    alone = classes.join(linked, "cls", "left").select(F.col("cls").alias("c"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"), F.coalesce("root", "cls").alias("root"))
    alone = staged(alone, "named")  # with both sides read from files, adaptive execution splits a class that holds many rows
    out = of.join(alone, (F.col("cls") == F.col("c")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "cls", "root", "th")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = NUM / DEN) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id, all columns as they came, whatever their names.

    Texts without shingles all stay. Where a component holds an id several times,
    the text with the least hash stays; of rows that repeat id and text, one. A
    component of rows without an id keeps one of them.
    """
    groups = staged(jaccard_components(docs, id_col, text_col, n, threshold).where("root IS NOT NULL").groupBy("root", "doc_id", "th").agg(F.count("*").alias("rows")), "groups")
    by = fresh(docs, "id", "th")
    never_null = lambda c: F.coalesce(c.cast("long"), F.lit(-(1 << 63)))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("m"))
    stays = F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("th") == F.col("m.th"))
    marked = groups.join(first, "root").select(never_null(F.col("doc_id")).alias(by[0]), F.col("th").alias(by[1]), stays.alias("stays"), "rows")
    marked = staged(marked.where("NOT stays OR rows > 1"), "marked")
    gone, twice = marked.where("NOT stays").select(*by), marked.where("stays").select(*by)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({by[0]: never_null(F.col(id_col)), by[1]: F.xxhash64(text)})
    # texts move only where the rows to drop are too many to broadcast
    kept = keyed.join(gone, by, "left_anti")
    if twice.limit(1).count():
        kept = kept.join(twice, by, "left_anti").unionByName(kept.join(twice, by, "left_semi").dropDuplicates(by))
    return kept.select(*every(docs))


def op3_ngram_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS n FROM w),
k AS (SELECT doc_id, n, pos, concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d) AS s FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT DISTINCT doc_id, s FROM k WHERE pos <= greatest(n - 3, 0)),
c AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_have FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN c x ON x.doc_id = u JOIN c y ON y.doc_id = v WHERE 100 * both_have >= 90 * (x.n + y.n - both_have)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id)
SELECT d.doc_id, coalesce(max(c.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""
