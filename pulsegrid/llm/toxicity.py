"""Toxicity from class-conditional Kneser-Ney models of words' letters.

Each class has a discounted model of ``ORDER`` bytes over what words are spelt of
(inflected and compounded insults share their stem, not their form). Both back
off to one shared model of continuation counts over shorter contexts, so a rare
spelling that neither class knows says little. A word's evidence is the
difference of its two log-likelihoods a byte; a text is judged by the
length-normalised difference over all its words and by its strongest words, as
a few words can make a long text toxic. Tasks count the n-grams of all labelled
training rows by class and only the summed table, one row a distinct n-gram,
reaches the driver. A bounded sample of rows fits the logistic map from these
features to a probability, by a model of the counts without that sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import frugal, release, table
from pulsegrid.llm.language_id import fold
from pulsegrid.llm.wordhash import _LOWER, Words, buffers, slices

#: Three times the labelled rows of each class that fit the logistic map at most, chosen by a hash of their id; counts take all rows.
SAMPLE = 3_000
#: Bytes of an n-gram; its key packs them into one integer.
ORDER = 6
DISCOUNT = 0.9
#: Strongest words whose mean evidence is a feature.
TOP = 3
THRESHOLD = 0.7
TEXT_BYTES = 1 << 20
_MARK = 32
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = _MARK


def _words(texts: pa.Array) -> Words:
    """Words without ASCII punctuation and case, so "scum," and "Scum" are one word."""
    data, bounds = buffers(texts)
    return Words(_LOWER[_PLAIN[data]], bounds)


def _spelt(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of the words ``which``, marks around them, and where each word's begin."""
    size = w.end[which] - w.start[which]
    first = np.concatenate([[0], np.cumsum(size + 1)])
    width = np.concatenate([[0], np.cumsum(size + ORDER)])
    flat = np.full(int(width[-1]), _MARK, np.uint64)
    own = np.repeat(np.arange(len(which)), size)
    inner = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    flat[width[own] + ORDER - 1 + inner] = w.data[w.start[which][own] + inner]
    key = np.zeros(max(0, len(flat) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        key = (key << np.uint64(8)) | flat[k : k + len(key)]
    at = np.repeat(width[:-1] - first[:-1], size + 1) + np.arange(int(first[-1]))
    return key[at], first


def _tail(keys: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes of each key."""
    return keys & np.uint64((1 << (8 * n)) - 1)


class Table:
    """A float column by key, 0 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.append(values[order], 0.0)

    def get(self, keys: np.ndarray) -> np.ndarray:
        return self.values[self.row(keys)]

    def row(self, keys: np.ndarray) -> np.ndarray:
        n = len(self.keys)
        if not n:
            return np.zeros(len(keys), np.int64)
        at = np.searchsorted(self.keys, keys)
        at[at == n] = 0
        return np.where(self.keys[at] == keys, at, n)


def _shared(grams: np.ndarray) -> dict[int, tuple[Table, Table]]:
    """Per order below ``ORDER``: continuation counts by n-gram, and (discount mass) weights by context."""
    out, above = {}, grams
    for n in range(ORDER - 1, 0, -1):
        keys, count = np.unique(_tail(above, n), return_counts=True)  # distinct longer n-grams
        ctx, inv = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(inv, count), np.bincount(inv)
        out[n] = Table(keys, np.maximum(count - DISCOUNT, 0) / total[inv]), Table(ctx, DISCOUNT * kinds / total)
        above = keys
    return out


def _backoff(shared: dict, keys: np.ndarray) -> np.ndarray:
    """Probability of each key's last byte after its context of ORDER - 2 bytes, under the shared model."""
    p = np.full(len(keys), 1 / 256)
    for n in range(1, ORDER):
        k = _tail(keys, n)
        seen, weight = shared[n]
        lam = weight.get(k >> np.uint64(8))
        p = np.where(lam > 0, seen.get(k) + lam * p, p)
    return p


@dataclass
class Model:
    grams: Table  # log ratio by n-gram that either class has
    contexts: Table  # log ratio of what a context leaves to n-grams that neither has
    weights: np.ndarray

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Per text: mean log ratio a byte, its strongest word, the mean of its ``TOP`` strongest, log words."""
        w = _words(texts)
        n = np.diff(w.first)
        out = np.zeros((len(texts), 4))
        out[:, 3] = np.log1p(n)
        if not len(w.h):
            return out
        _, which, back = np.unique(w.h, return_index=True, return_inverse=True)
        keys, first = _spelt(w, which)
        row = self.grams.row(keys)
        ratio = np.where(row < len(self.grams.keys), self.grams.values[row], self.contexts.get(keys >> np.uint64(8)))
        total = np.add.reduceat(ratio, first[:-1])
        size = np.diff(first)
        word = (total / size)[back]
        sums = np.concatenate([[0.0], np.cumsum(total[back])])
        sizes = np.concatenate([[0], np.cumsum(size[back])])
        some = np.flatnonzero(n)
        out[:, 0] = (sums[w.first[1:]] - sums[w.first[:-1]]) / np.maximum(sizes[w.first[1:]] - sizes[w.first[:-1]], 1)
        by = np.lexsort((-word, w.text_of))
        strong = word[by]
        out[some, 1] = strong[w.first[some]]
        csum = np.concatenate([[0.0], np.cumsum(strong)])
        k = np.minimum(n[some], TOP)
        out[some, 2] = (csum[w.first[some] + k] - csum[w.first[some]]) / TOP
        return out

    def features(self, texts: pa.Array) -> np.ndarray:
        e = self.evidence(texts)
        return np.column_stack([np.ones(len(e)), e, e[:, 1] * e[:, 3], e[:, 1] ** 2])

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def _counts(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = _words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    _, which, n = np.unique(w.h, return_index=True, return_counts=True)
    keys, first = _spelt(w, which)
    keys, inv = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inv, np.repeat(n, np.diff(first)), len(keys))


def _model(grams: np.ndarray, plain: np.ndarray, toxic: np.ndarray) -> Model:
    """The model of two classes' counts of ``grams`` (sorted, distinct), without weights."""
    some = (plain > 0) | (toxic > 0)
    grams, plain, toxic = grams[some], plain[some], toxic[some]
    shared = _shared(grams)
    low = _backoff(shared, grams)
    ctx, inv = np.unique(grams >> np.uint64(8), return_inverse=True)
    logs, left = [], []
    for n in (plain, toxic):
        total, kinds = np.bincount(inv, n, len(ctx)), np.bincount(inv, n > 0, len(ctx))
        lam = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[inv] + lam[inv] * low))
        left.append(np.log(lam))
    return Model(Table(grams, logs[1] - logs[0]), Table(ctx, left[1] - left[0]), np.zeros(7))


def _weights(model: Model, toxic: list[str], plain: list[str]) -> np.ndarray:
    if not toxic or not plain:
        return np.zeros(7)
    return _logistic(model.features(pa.array(plain + toxic, pa.string())), np.r_[np.zeros(len(plain)), np.ones(len(toxic))])


def train(toxic: list[str], plain: list[str]) -> Model:
    """Counts n-grams on two texts of three of each class; the third fits the logistic map."""
    part = lambda x, k: [t for i, t in enumerate(x) if (i % 3 == 2) == k]
    both = [_counts(part(plain, False)), _counts(part(toxic, False))]
    grams = np.union1d(both[0][0], both[1][0])
    n = np.zeros((2, len(grams)))
    for k, (keys, count) in enumerate(both):
        n[k, np.searchsorted(grams, keys)] = count
    model = _model(grams, *n)
    model.weights = _weights(model, part(toxic, True), part(plain, True))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method on the penalised log-likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count_rows(batches):
    """(toxic, held, text) rows to (key, n0, n1, held0, held1): each batch's n-grams with their counts by class, over all rows and over held ones."""
    names = ["key", "n0", "n1", "held0", "held1"]
    for batch in batches:
        for a, b in slices(batch.column(2), TEXT_BYTES):
            piece = batch.slice(a, b - a)
            of = piece.column(0).to_numpy() + 2 * piece.column(1).to_numpy()
            part = {k: _counts(piece.column(2).filter(pa.array(of == k))) for k in range(4)}
            keys = np.unique(np.concatenate([part[k][0] for k in range(4)]))
            n = np.zeros((4, len(keys)), np.int64)
            for k, (own, count) in part.items():
                n[k, np.searchsorted(keys, own)] = count
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(x) for x in (n[0] + n[2], n[1] + n[3], n[2], n[3]))], names)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on all labelled rows whose crc32(doc_id) mod 3 isn't 1; an id with several labels counts as toxic if one says so.

    At most about ``sample`` / 3 rows of a class, and a third of it, fit the map.
    """
    may = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 3) != 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in may.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    level = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30))
    share = [min(1.0, sample / max(1, sizes.get(k, 0))) / 3 for k in (0, 1)]
    may = may.withColumn("held", (level < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]) * float(1 << 30)).cast("int"))
    rows = docs.where(F.col("text").isNotNull() & (fold(F.col("doc_id"), 3) != 1)).select("doc_id", "text")
    # about ``sample`` / 3 rows a class by a hash of their id, which bounds the broadcast; ids that many texts share are cut by an order
    picked = may.where("held = 1")
    some = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").distinct()
    some = some.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(2 * sample)
    some = sorted(((r[0], r[1], r[2]) for r in some.collect()), key=lambda r: r[:2])
    # labels grow with the corpus: never broadcast, so that small tables take the plan that large ones need
    counted = rows.join(may.hint("shuffle_hash"), "doc_id").select("toxic", "held", "text").mapInArrow(frugal(_count_rows), "key long, n0 long, n1 long, held0 long, held1 long")
    got = counted.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "held0", "held1")]).toArrow()
    grams = got.column("key").to_numpy().view(np.uint64)
    by = np.argsort(grams)
    n = {c: got.column(c).to_numpy()[by].astype(float) for c in ("n0", "n1", "held0", "held1")}
    grams = grams[by]
    del got
    weights = _weights(_model(grams, n["n0"] - n["held0"], n["n1"] - n["held1"]), [r[1] for r in some if r[2] == 1], [r[1] for r in some if r[2] == 0])
    model = _model(grams, n["n0"], n["n1"])
    model.weights = weights
    del some
    release()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score.

    Null and empty texts get the score of a text without evidence. Equal texts have
    equal scores, long ones are read whole; rows that repeat an id or have none are
    scored like others. An empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), TEXT_BYTES):
                piece = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(model.score(piece.column(1)), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, score double")


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
