"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are byte n-grams of the text, letters lower-cased in ASCII and white
space folded to one mark, hashed to ``BUCKETS``. A text is the average of their
embeddings; both layers are trained by stochastic gradient descent on a bounded
sample of labelled rows of each language, whole texts and short cuts of them. One
more class stands for everything else: scrambled texts, invented languages, other
scripts, noise and code, all made up here. A temperature and the level of that
class's probability from which a text is rejected are then fitted on rows kept out
of training. Scoring multiplies the layers once: every subword adds one row of a
(bucket, class) table.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import every, frugal, lean, release, table, trim
from pulsegrid.llm.wordhash import _LOWER, _WS, buffers, slices

BUCKETS, DIM, ORDERS = 1 << 15, 16, (2, 3, 4)
#: Labelled rows that training reads, by a hash of id and text: about this many in all, dealt evenly to the languages, ``LEAST`` of each where there are so many.
SAMPLE, LEAST = 2_500, 50
#: Made-up texts of no language, for each labelled text.
OTHERS = 0.5
EPOCHS, RATE, SEED = 6, 2.0, 7
#: Share of the kept-out rows that the rejection level may turn away.
REJECT_SHARE = 0.001
UNKNOWN = "und"
TEXT_BYTES = 1 << 17


def subwords(data: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per order the bucket of the subword at each place (BUCKETS where it leaves its text); subwords per text; texts' first places."""
    texts = len(bounds) - 1
    folded = _LOWER[data]
    white = _WS[data]
    folded[white] = 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(white[1:] & white[:-1])
    # every text is laid out as mark, bytes, mark
    size = np.add.reduceat(np.r_[keep, False].astype(np.int64), np.minimum(bounds[:-1], len(data))) if texts else np.zeros(0, np.int64)
    size[np.diff(bounds) == 0] = 0
    first = np.concatenate([[0], np.cumsum(size + 2)])
    flat = np.full(int(first[-1]), 32, np.uint8)
    inside = np.ones(len(flat), bool)
    inside[first[:-1]] = False
    inside[first[1:] - 1] = False
    flat[inside] = folded[keep]
    x = flat.astype(np.uint32)
    gram, out, counts = x.copy(), [], np.zeros(texts, np.int64)
    owner_end = np.repeat(first[1:], size + 2)
    at = np.arange(len(flat))
    for n in range(2, max(ORDERS) + 1):
        gram = gram[:-1] * np.uint32(0x01000193) + x[n - 1 :] + np.uint32(1)
        if n in ORDERS:
            ok = at[: len(gram)] + n <= owner_end[: len(gram)]
            h = gram ^ (gram >> np.uint32(15))
            h = h * np.uint32(0x2C1B3C6D)
            out.append(np.where(ok, (h ^ (h >> np.uint32(12))) & np.uint32(BUCKETS - 1), BUCKETS).astype(np.int64))
            counts += np.maximum(size + 2 - n + 1, 0)
    return out, counts, first


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS + 1, langs) of float32; the last row, of no subword, is zero
    bias: np.ndarray
    temperature: float
    reject: float  # from this probability of the class of everything else on

    def logits(self, texts: pa.Array) -> np.ndarray:
        data, bounds = buffers(texts)
        if not len(texts):
            return np.zeros((0, self.table.shape[1]))
        grams, counts, first = subwords(data, bounds)
        total = np.zeros((len(texts), self.table.shape[1]))
        for g in grams:
            if len(g):
                rows = np.zeros((len(g) + 1, self.table.shape[1]), np.float32)
                np.take(self.table, g, axis=0, out=rows[:-1])
                at = np.minimum(first[:-1], len(g))
                total += np.add.reduceat(rows, at, axis=0, dtype=np.float64)
        return (total / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Of each language, and last of everything else."""
        z = self.logits(texts)
        p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated score and rejection of each text; ``und``, 0 and True without any letter."""
        p = self.probabilities(texts)
        k = len(self.langs)
        best = p[:, :k].argmax(axis=1) if len(p) else np.zeros(0, int)
        score = p[:, :k].max(axis=1) if len(p) else np.zeros(0)
        other = p[:, k] if p.shape[1] > k else np.zeros(len(p))
        lang = [self.langs[i] for i in best]
        data, bounds = buffers(texts)
        folded = _LOWER[data]
        ascii_letters = np.concatenate([[0], np.cumsum((folded >= 97) & (folded <= 122))])
        for i in np.flatnonzero(ascii_letters[bounds[1:]] == ascii_letters[bounds[:-1]]):
            if not any(c.isalpha() for c in texts[int(i)].as_py() or ""):
                lang[i], score[i] = UNKNOWN, 0.0
        return lang, score, (other >= self.reject) | (np.array(lang, object) == UNKNOWN)


@lru_cache(1)
def _letters() -> list[str]:
    """All lower-case or caseless letters of the basic plane, in order: neighbours mostly share a script."""
    return [chr(c) for c in range(0xA1, 0xD7A4) if unicodedata.category(chr(c)) in ("Ll", "Lo")]


def other_text(rng: np.random.Generator, text: str) -> str:
    """A text of no known language: ``text`` scrambled in one of several ways, or something made up of as many words."""
    words = text.lower().split()[: int(rng.integers(5, 120))] or ["x"]
    pick = lambda pool, n: "".join(pool[i] for i in rng.integers(0, len(pool), n))
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    kind = rng.integers(0, 7)
    if kind == 0:  # letters of each word in another order
        return " ".join("".join(rng.permutation(list(w))) for w in words)
    if kind == 1:  # one letter for another throughout
        swap = dict(zip(alphabet, rng.permutation(list(alphabet)), strict=True))
        return " ".join("".join(swap.get(c, c) for c in w) for w in words)
    if kind == 2:  # noise
        return " ".join(pick(alphabet, int(rng.integers(1, 14))) for _ in words)
    if kind == 3:  # some other script
        letters = _letters()
        at = int(rng.integers(0, len(letters) - 60))
        return " ".join(pick(letters[at : at + int(rng.integers(8, 60))], int(rng.integers(1, 12))) for _ in words)
    if kind == 4:  # few letters over and over
        return " ".join(pick(pick(alphabet, int(rng.integers(1, 3))), int(rng.integers(1, 30))) for _ in words)
    if kind == 5:  # names and signs, as in code
        signs = ["()", "=", ":", "[0]", "{", "}", ";", "->", "==", "+=", ".", "_", "<", ">", '"', "\n    ", "\n"]
        return "".join((pick(alphabet, int(rng.integers(1, 9))) if rng.random() < 0.5 else words[int(rng.integers(len(words)))]) + signs[int(rng.integers(len(signs)))] + (" " if rng.random() < 0.5 else "") for _ in words)
    # an invented language: its own letters, syllables and words
    odd = [c for c in _letters() if ord(c) < 0x180]
    vowels = [*rng.permutation(list("aeiouy"))[: int(rng.integers(3, 6))], *rng.choice(odd, 2)]
    rest = [*rng.permutation(list("bcdfghjklmnpqrstvwxz"))[: int(rng.integers(8, 18))], *rng.choice(odd, 3)]
    shapes = rng.choice(["cv", "cvc", "vc", "ccv", "v", "cvcc"], 3)
    syllable = lambda: "".join(rng.choice(vowels if x == "v" else rest) for x in rng.choice(shapes))
    lexicon = ["".join(syllable() for _ in range(int(rng.integers(1, 5)))) for _ in range(min(len(words), 60))]
    return " ".join(lexicon[i] for i in rng.integers(0, len(lexicon), len(words)))


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the distinct buckets and their shares."""
    out = []
    for t in texts:
        data, bounds = buffers(pa.array([t]))
        grams, _, _ = subwords(data, bounds)
        u, c = np.unique(np.concatenate(grams), return_counts=True)
        c = c[u < BUCKETS] / max(1, c[u < BUCKETS].sum())
        out.append((u[u < BUCKETS].astype(np.uint16), c.astype(np.float32)))
    return out


def train(texts: list[str], langs: list[str]) -> Model:
    """Fits on four rows of five; the fifth sets temperature and rejection level."""
    if not texts:
        return Model([UNKNOWN], np.zeros((BUCKETS + 1, 1), np.float32), np.zeros(1), 1.0, 1.0)
    rng = np.random.default_rng(SEED)
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    held = np.arange(len(texts)) % 5 == 4 if len(texts) >= 25 else np.zeros(len(texts), bool)

    def cuts(rows):
        """Each text whole, and a cut of 3 to 40 words at a random place."""
        out, label = [], []
        for i in rows:
            words = texts[i].split()
            n = int(rng.integers(3, 41))
            k = int(rng.integers(0, max(1, len(words) - n + 1)))
            out += [texts[i], " ".join(words[k : k + n])]
            label += [y[i], y[i]]
        return _features(out), np.array(label)

    def others(rows):
        return [other_text(rng, texts[i]) for i in rng.choice(rows, max(1, int(len(rows) * OTHERS)))]

    fit, fit_y = cuts(np.flatnonzero(~held))
    more = _features(others(np.flatnonzero(~held)))
    fit, fit_y = fit + more, np.r_[fit_y, np.full(len(more), len(names))]
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    soft, bias = rng.normal(0, 1 / DIM, (DIM, len(names) + 1)), np.zeros(len(names) + 1)
    steps, total = 0, EPOCHS * len(fit)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            u, c = fit[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            v = c @ emb[u]
            z = v @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[fit_y[i]] -= 1
            grad = soft @ p
            soft -= rate * np.outer(v, p)
            bias -= 0.1 * rate * p
            emb[u] -= rate * len(u) ** 0.5 * np.outer(c, grad)
    model = Model(names, np.vstack([emb @ soft, np.zeros(len(names) + 1)]).astype(np.float32), bias, 1.0, 0.5)
    if held.any():
        whole = pa.array([texts[i] for i in np.flatnonzero(held)])
        z = model.logits(whole)
        grid = np.geomspace(0.5, 5, 40)  # no sharper than half: a kept-out set without errors would ask for certainty
        logs = [-np.mean((z / t)[np.arange(len(z)), y[held]] - np.logaddexp.reduce(z / t, axis=1)) for t in grid]
        model.temperature = float(grid[int(np.argmin(logs))])
        # between what kept-out rows reach (but for ``REJECT_SHARE`` of them) and what made-up texts exceed (but for one in 20), nearer the latter
        logit = lambda x: np.log(np.clip(x, 1e-6, 1 - 1e-6) / (1 - np.clip(x, 1e-6, 1 - 1e-6)))
        own = np.sort(model.probabilities(whole)[:, -1])
        strange = np.sort(model.probabilities(pa.array(others(np.flatnonzero(held))))[:, -1])
        low, high = logit(own[int((1 - REJECT_SHARE) * (len(own) - 1))]), logit(strange[len(strange) // 20])
        model.reject = float(1 / (1 + np.exp(-(low + 0.7 * max(high - low, 1.0)))))
    return model


def fold(id_col, parts: int):
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on rows with a language and a text whose crc32(doc_id) mod 4 isn't 2.

    Each language has its share of ``sample`` rows, so that a rare one is learnt as
    well; rows that repeat id, text and language count once. Reruns agree.
    """
    may = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 4) != 2)).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = may.groupBy("lang").agg(F.count("*").alias("of"))
    each = F.greatest(F.lit(LEAST), F.lit(sample) / F.count("*").over(W.partitionBy()))  # one row a language
    sizes = sizes.select(F.col("lang").alias("of_lang"), F.least(F.lit(1.0), each / F.col("of")).alias("share"))
    level = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = may.join(F.broadcast(sizes), F.col("lang") == F.col("of_lang")).where(level < F.col("share")).select("doc_id", "text", "lang").distinct()
    rows = sorted(map(tuple, picked.collect()))
    model = train([r[1] for r in rows], [r[2] for r in rows])
    del rows
    release()
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, rejected.

    Texts without a letter, null and empty ones among them, are ``und`` with score 0
    and rejected. Equal texts have equal results; long texts are read whole. Rows
    without an id and rows that repeat one are predicted like others. An empty
    table gives no rows; columns besides id and text are ignored.
    """

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), TEXT_BYTES):
                piece = batch.slice(a, b - a)
                lang, score, no = model.predict(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(no.astype(bool))], ["doc_id", "lang_pred", "score", "rejected"])
            trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows the model rejects, all columns as they came."""
    lean(docs)
    at = docs.columns.index("text")
    plain = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(every(docs))])  # any names may come, dots among them

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(at), TEXT_BYTES):
                piece = batch.slice(a, b - a)
                yield piece.filter(pa.array(~model.predict(piece.column(at))[2].astype(bool)))
            trim()

    return plain.mapInArrow(frugal(run), plain.schema).toDF(*docs.columns)


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
