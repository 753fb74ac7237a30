"""Mixing, packing, token files, media, classifiers, HTML and the pipeline."""

import os
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pulsegrid.llm import block_images, exact_dedup, html_text, jpeg, language_id, media, mixing, packing, queries, token_files, tokens, toxicity
from tests.llm.conftest import prose

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    twin = con.execute(queries.oracle_sql()[name]).df()
    mine = queries.queries()[name](spark, SF).toPandas()
    key = lambda d: sorted(map(str, d[sorted(d.columns)].itertuples(index=False, name=None)))
    assert sorted(mine.columns) == sorted(twin.columns) and key(mine) == key(twin)


def test_mix(docs, corpus, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus) and mixing.mix(empty).count() == 0
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, total = dict.fromkeys(order, 0.0), 1.5 * sum(size.values())
    free = set(order)
    while True:  # reshare the excess by weight until none is above
        left = total - sum(2 * size[s] for s in order if s not in free)
        for s in order:
            want[s] = left * weight[s] / sum(weight[x] for x in free) if s in free else 2.0 * size[s]
        over = {s for s in free if want[s] > 2 * size[s]}
        if not over:
            break
        free -= over
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r.text or "")) for r in mixed.collect())
    assert abs(words - sum(taken.values())) <= 2 * max(r.size for r in rows if r.doc_id == corpus[3][0]) + len(order)


#: Characters that split patterns, normalisers and added tokens treat unlike: white space of all kinds, marks, cases, digits, literals.
ODD = [*"abeiKzZ019'., ;:)(!-\n\t\r  \x0b\x0c\x1c\x1d\x1f\x85\xa0\u1680\u180e\u2000\u2003\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff", *"\u0130\u0131\u03a3\u03c2\u01c5\u00e9\u0301\u0308\u0327\u0345\u212b\u212a\ufb01\u5317\ud55c\u1112\u1161\u11ab\U0001f642\u00df\u1e9e\u00bd\u00b2\u0663\u2167\x00\x01\x7f\u00ad\u200d\u00f1\u0e33"]
ODD += ["'s", "'re", "'LL", "'t", "e\u0301", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", "</w>", "\n\n"]


@pytest.mark.parametrize(("name", "kind"), [(tokens.BYTE_BPE, "byte"), (tokens.WORD_BPE, "word")])
def test_ids_equal_the_plain_library(corpus, name, kind):
    plain = Tokenizer.from_file(tokens.public_path(name))
    enc = tokens.Encoder(tokens.public_path(name), kind)
    rng = random.Random(9)
    extra = ["First par.\n\nSecond\xa0par.", "Prix\xa0: 5\n\nFin", " (\u0130,", "e\n\xa0\x85)BB(", "a\n\nb\u2003z", "\x1c .", "a  b", "it's  we'll\r\n", "trail  ", "1,000.5 a,b .x ,y"]
    extra += ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 25))) for _ in range(20_000)]
    texts = [t for _, t, *_ in corpus] + extra
    for at in range(0, len(texts), 500):
        ids, bounds = enc.encode(pa.array(texts[at : at + 500]))
        for k, t in enumerate(texts[at : at + 500]):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t
    # pieces that were forgotten, and windows that cut a long text
    enc.memo, long = {}, " ".join(texts[i] or "" for i in range(0, len(texts), 7))
    tokens.WINDOW, kept = 1000, tokens.WINDOW
    ids, _ = enc.encode(pa.array([long]))
    tokens.WINDOW = kept
    assert ids.tolist() == plain.encode(long, add_special_tokens=False).ids


def library_ids(name, text, end):
    """Ids by the plain library, for expectations that don't rest on the encoder."""
    return np.array([*Tokenizer.from_file(tokens.public_path(name)).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_pack(docs, corpus, empty):
    rows = packing.pack(docs).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, t, *_ in corpus:
        ids = library_ids(tokens.BYTE_BPE, t, 0)
        n = sum(1 for x in corpus if x[0] == i)
        for s in range(0, len(ids), 1024):
            part = ids[s : s + 1024]
            same = [r for r in by[i] if (r.start, r.length, r.ids_crc32, r.doc_tokens) == (s, len(part), zlib.crc32(part.tobytes()), len(ids))]
            assert len(same) == n
    for parts in seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(seq) <= 1.1 * sum(r.length for r in rows) / 1024 + 2
    assert packing.pack(empty).count() == 0


def test_plan_holds_exactly_its_histogram():
    rng = np.random.default_rng(2)
    for n in (1, 7, 300, 20_000):
        sizes, counts = np.unique(rng.integers(1, 65, n), return_counts=True)
        want = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
        got = defaultdict(int)
        patterns = packing.plan(dict(want), 64)
        for p, times in patterns:
            assert sum(k * v for k, v in p.items()) <= 64
            for k, v in p.items():
                got[k] += v * times
        assert dict(got) == want
        if n > 10_000:
            assert sum(t for _, t in patterns) <= 1.01 * sum(k * v for k, v in want.items()) / 64
    value, pick = packing.best_pattern(np.array([3, 5]), np.array([3.1, 5.0]), 11)
    assert abs(value - 11.2) < 1e-9 and pick.tolist() == [2, 1]


def test_token_files(docs, corpus, empty, monkeypatch):
    shards = token_files.write_shards(docs)
    rows = sorted(token_files.read_shards(shards).collect(), key=lambda r: r.start)
    want, at = [], defaultdict(list)
    for i, t, *_ in corpus:
        ids = library_ids(tokens.WORD_BPE, t, 2)
        at[i].append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r.doc_id for r in rows] == sorted((i for i, *_ in corpus), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    for i, both in at.items():
        want += sorted((i, *x) for x in both)
    key = lambda r: (r[0] is not None, r)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    # real files, and one document read from one of them by itself
    file = sorted(shards.collect(), key=lambda r: (r.task, r.seq))[-1].file
    raw = Path(file.removeprefix("file:")).read_bytes()
    s = token_files.Shard.of(raw)
    last = max(i for i, *_ in corpus if i is not None)
    text = next(t for i, t, *_ in corpus if i == last)
    assert s.doc_ids()[-1].as_py() == last and s.doc(s.n - 1).tolist() == library_ids(tokens.WORD_BPE, text, 2).tolist()
    assert token_files.read_shards(token_files.write_shards(empty)).count() == 0


def test_elias_fano_selects_every_boundary():
    rng = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 500, 5000):
        sizes = rng.integers(0, 200, n) * (rng.random(n) < 0.7)
        sizes[n // 2] = 90_000
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ids = rng.integers(0, 60_000, int(bounds[-1])).astype("<u2")
        names = np.sort(rng.integers(-(1 << 62), 1 << 62, n))
        names[n // 3 :] = names[n // 3]
        raw, asked = token_files.pack_shard(ids, bounds, names, nulls=0), []

        def read(at, size, raw=raw, asked=asked):
            asked.append(size)
            return raw[at : at + size]

        s = token_files.Shard(read)
        assert s.bounds().tolist() == bounds.tolist() and s.doc_ids().to_pylist() == names.tolist()
        asked.clear()
        for i in {0, n // 2, n - 1, *rng.integers(0, n, 20).tolist()}:
            assert s.doc(i).tolist() == ids[bounds[i] : bounds[i + 1]].tolist()
        assert sum(asked) < 2 * 22 * (90_000 + 4_000) and min(asked) >= 0
        assert len(raw) - ids.nbytes < 16 * n + 300  # names of 64 random bits among them
    with pytest.raises(ValueError):
        token_files.Shard.of(b"nope" * 20)


def test_media(docs, corpus, empty):
    rows = media.read(media.store(docs)).collect()
    assert len(rows) == len(corpus) and media.read(media.store(empty)).count() == 0
    by = {(r.doc_id, r.n_bytes): r for r in rows}
    for i, t, *_ in corpus:
        raw = (t or "").encode()
        r, payload = by[i, len(raw)], media.padded(raw)
        assert r.payload_bytes == len(payload) and r.tail_crc32 == zlib.crc32(payload[-64:]) and r.payload_bytes % 64 == 0 < r.payload_bytes
        stored = media.to_jpeg(payload)
        assert r.media_bytes == len(stored) and media.from_jpeg(stored)[0] == payload
    t = media.tensors(media.store(docs)).first()
    assert len(t.rgb) == 3 * t.height * t.width


def test_payload_of_every_byte_and_size():
    for payload in (bytes(range(256)) * 3, bytes(64), b"\xff" * 6400, np.random.default_rng(0).bytes(64 * 9001)):
        assert media.from_jpeg(media.to_jpeg(payload))[0] == payload


@pytest.mark.parametrize(("w", "h", "samp"), [(40, 24, [(2, 2), (1, 1), (1, 1)]), (17, 9, [(1, 1)]), (33, 70, [(2, 1), (1, 1), (1, 1)])])
def test_progressive_scans_accumulate(w, h, samp):
    rng = np.random.default_rng(1)
    parts = [jpeg.Component(k + 1, a, b, 0) for k, (a, b) in enumerate(samp)]
    jpeg.layout(w, h, parts)
    for c in parts:
        v = (rng.normal(0, 30, c.coef.shape) * (rng.random(c.coef.shape) < np.linspace(0.9, 0.05, 64))).astype(int)
        c.coef[: c.rows, : c.cols] = v[: c.rows, : c.cols]
    n = range(len(parts))
    script = [(list(n), 0, 0, 0, 1)] + [([k], 1, 5, 0, 2) for k in n] + [([k], 6, 63, 0, 2) for k in n] + [([k], 1, 63, 2, 1) for k in n] + [(list(n), 0, 0, 1, 0)] + [([k], 1, 63, 1, 0) for k in n]
    got = jpeg.decode(jpeg.encode(jpeg.Image(w, h, parts, {0: np.full(64, 3)}), script))
    assert all((a.coef == b.coef).all() for a, b in zip(parts, got.components, strict=True))
    assert jpeg.to_rgb(got).shape == (h, w, 3)


def test_batches_of_block_images_equal_single_ones():
    rng = random.Random(3)
    sizes = [0, 1, 63, 64, 65, 700, 5000, 12000, 64 * 300] * 3 + [64 * 8191 + 5, 64 * 40_000]
    payloads = [media.padded(rng.randbytes(n)) for n in sizes]
    raws = block_images.write(payloads)
    assert raws == [media.to_jpeg(p) for p in payloads]
    got, features = media.payloads_and_features(raws)
    assert got == payloads and features == [media.feature(media.from_jpeg(raw)[1]) for raw in raws]
    # an image of another make among them, and a damaged one
    parts = [jpeg.Component(1, 1, 1, 0)]
    jpeg.layout(8, 8, parts)
    parts[0].coef[:] = -100
    other = jpeg.encode(jpeg.Image(8, 8, parts, {0: np.ones(64, int)}, (64).to_bytes(8, "big")), [([0], 0, 0, 0, 0), ([0], 1, 63, 0, 0)])
    assert media.payloads_and_features([raws[5], other])[0] == [payloads[5], bytes([155]) * 64]
    with pytest.raises(ValueError):
        media.payloads_and_features([raws[5][:60]])


def test_inverse_transform_equals_the_cosine_sum():
    """Random coefficients with subsampled chroma against the textbook double sum, repeated chroma and colour formula."""
    rng = np.random.default_rng(1)
    parts = [jpeg.Component(1, 2, 2, 0), jpeg.Component(2, 1, 1, 1), jpeg.Component(3, 1, 1, 1)]
    jpeg.layout(32, 16, parts)
    quant = {0: rng.integers(1, 9, 64), 1: rng.integers(1, 9, 64)}
    for c in parts:
        c.coef[:] = rng.integers(-9, 10, c.coef.shape)
    zigzag = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]

    def value(c, y, x):
        block, total = c.coef[y // 8, x // 8], 0.0
        for k, place in enumerate(zigzag):
            v, u = divmod(place, 8)
            scale = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
            total += scale * block[k] * quant[c.table][k] * np.cos((2 * (x % 8) + 1) * u * np.pi / 16) * np.cos((2 * (y % 8) + 1) * v * np.pi / 16)
        return total

    rgb = jpeg.to_rgb(jpeg.Image(32, 16, parts, quant))
    for y in range(0, 16, 3):
        for x in range(0, 32, 5):
            lum, cb, cr = value(parts[0], y, x) + 128, value(parts[1], y // 2, x // 2), value(parts[2], y // 2, x // 2)
            want = np.clip([lum + 1.402 * cr, lum - 0.344136 * cb - 0.714136 * cr, lum + 1.772 * cb], 0, 255)
            assert np.abs(rgb[y, x] - want).max() <= 0.51


def test_inverse_transform_and_colour():
    parts = [jpeg.Component(1, 2, 2, 0), jpeg.Component(2, 1, 1, 0), jpeg.Component(3, 1, 1, 0)]
    jpeg.layout(16, 16, parts)
    parts[0].coef[..., 0] = 8 * (150 - 128)
    parts[2].coef[..., 0] = 8 * 20
    rgb = jpeg.to_rgb(jpeg.Image(16, 16, parts, {0: np.ones(64, int)}))
    assert (rgb.reshape(-1, 3) == [178, 136, 150]).all()
    with pytest.raises(ValueError):
        jpeg.decode(b"GIF")


def test_language_id_held_out():
    rng = random.Random(8)
    langs = ["en", "de", "fr"] * 60
    model = language_id.train([prose(rng, x, rng.randint(3, 80)) for x in langs], langs)
    test = ["en", "de", "fr"] * 40
    pred, score, no = model.predict(pa.array([prose(rng, x, rng.randint(8, 60)) for x in test]))
    assert np.mean([a == b for a, b in zip(pred, test, strict=True)]) > 0.97 and not no.any()
    pred, score, no = model.predict(pa.array(["", None, " 12 % ", "é", "the"]))
    assert pred[:3] == ["und"] * 3 and no[:3].all() and score[:3].tolist() == [0, 0, 0] and "und" not in pred[3:]
    assert model.predict(pa.array([], pa.string()))[0] == []


#: Texts of no learned language: code, noise, other scripts, one letter, an unlearned language of the same script.
STRANGE = {
    "code": "def main():\n    import os\n    for i in range(10):\n        print(os.path.join('a', str(i)))\n    return None",
    "noise": "xqzj vkwpd qqzzt hgfkd wrtpl mnbvc zxcvq kjhgf plmkn",
    "japanese": "これは日本語の文章です。今日はとても良い天気なので散歩に行きました。",
    "russian": "Это предложение на русском языке, которое не должно быть распознано.",
    "one letter": "aaaa aaaaaaa aaaaa aaaaaaaaaa aaaa",
    "turkish": "Bugün hava çok güzel olduğu için arkadaşlarımla birlikte parkta uzun bir yürüyüş yaptık ve sonra kahve içtik.",
}


def test_language_id_turns_away_other_texts(spark):
    """Trained on the tables' rows: held-out rows stay, texts of no learned language go, a rare language is learnt, reruns agree."""
    docs = language_id.table(spark, SF.replace("sf0.001", "sf0.01"), "documents")
    rare = [(10**6 + k, " ".join(random.Random(k).choices("zorgu blint kavap nemzi thruul".split(), k=40)), "xx") for k in range(60)]
    docs = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    model = language_id.fit(docs, 800)
    again = language_id.fit(docs.repartition(7), 800)
    assert model.langs == again.langs and "xx" in model.langs and np.array_equal(model.table, again.table) and model.reject == again.reject
    held = docs.where((language_id.fold(docs.doc_id, 4) == 2) & docs.lang.isNotNull() & docs.text.isNotNull()).collect()
    pred, _, no = model.predict(pa.array([r.text for r in held]))
    assert np.mean([p == r.lang for p, r in zip(pred, held, strict=True)]) > 0.99 and no.mean() < 0.005
    turned = dict(zip(STRANGE, model.predict(pa.array(list(STRANGE.values())))[2].tolist(), strict=True))
    assert sum(turned.values()) >= 5, turned


def test_language_id_runs_on_odd_rows(docs, corpus, empty):
    model = language_id.fit(docs)
    rows = language_id.predict(docs, model).collect()
    assert len(rows) == len(corpus)
    out = language_id.keep_identified(docs, model)
    assert out.columns == docs.columns and out.count() == sum(not r.rejected for r in rows)
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0


def test_toxicity_held_out(spark, docs, empty, corpus):
    rng = random.Random(4)
    stems = ["grumf", "sklorp", "vextra", "drubni"]

    def text(bad):
        words = prose(rng, rng.choice(["en", "de"]), rng.randint(20, 120)).split()
        for _ in range(rng.randint(2, 5) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "en", "ed", "heit", ","]))
        return " ".join(words)

    model = toxicity.train([text(True) for _ in range(150)], [text(False) for _ in range(150)])
    score = model.score(pa.array([text(k % 2 == 0) for k in range(200)]))
    assert (score[::2] >= 0.7).mean() > 0.9 and (score[1::2] >= 0.7).mean() < 0.03
    s = model.score(pa.array(["", None, "..."]))
    assert ((s >= 0) & (s <= 1)).all() and s[0] == s[1] == s[2] and s[0] < 0.7
    assert len(model.score(pa.array([], pa.string()))) == 0
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    fitted = toxicity.fit(docs, labels)
    assert toxicity.score(docs, fitted).count() == len(corpus)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_html_blocks():
    page = "<title>t</title><nav><a href='/x'>m</a></nav><p>One &amp; two\n <b>three</b>.<br>four<p>Five &lt;x&gt;<script>var a='<p>no</p>'</script><!-- <p>gone</p> --><div>a < b<ul><li>i<li>j</ul>k</div>"
    texts = [b[0] for b in html_text.leaf_blocks(page)]
    assert texts == ["m", "One & two three. four", "Five <x>", "a < b", "i", "j", "k"]
    assert html_text.leaf_blocks(None) == [] and html_text.leaf_blocks("<p>") == [] and html_text.leaf_blocks("plain") [0][0] == "plain"
    assert [b[0] for b in html_text.leaf_blocks("<script>never closed <p>x</p>")] == []


def test_html_held_out(spark):
    field = html_text.train(250)
    rng = random.Random(77)
    right = total = 0
    for _ in range(150):
        page, main = html_text.labelled_page(rng)
        blocks = html_text.leaf_blocks(page)
        for b, y in zip(blocks, field.viterbi(html_text.features(blocks)), strict=True):
            right += (b[0] in main) == bool(y)
            total += 1
    assert right / total > 0.97
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><h1>T</h1><p>A b c d e f.</p></article><footer>&copy; x</footer>")]
    out = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), field).collect()}
    assert out[1].text == "" == out[2].text and out[3].text == "T\n\nA b c d e f." and out[3].n_chars == 15
