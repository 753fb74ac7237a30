"""Frames as image files: found faces, measurements, crops and the largest blob against a plain search."""

import struct
import zlib

import numpy as np
import pytest

from pulsegrid.functions import vision_np as vi
from pulsegrid.operators import ingest
from pulsegrid.sources import datasets

TONE = (198, 158, 140)


def png(rgb: np.ndarray) -> bytes:
    """A PNG of unfiltered rows."""
    h, w = rgb.shape[:2]
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def picture(face: bool = True, x: int = 30) -> np.ndarray:
    f = np.full((96, 128, 3), 20, np.uint8)
    if face:
        f[10:90, x : x + 64] = TONE
    return f


def flood(mask):
    """Largest set of touching pixels by a plain search: (box, area), the first found of equal ones."""
    seen, best = np.zeros_like(mask), None
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        todo, got = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            got.append((a, b))
            for c in range(max(a - 1, 0), min(a + 2, mask.shape[0])):
                for d in range(max(b - 1, 0), min(b + 2, mask.shape[1])):
                    if mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
        ys, xs = zip(*got, strict=True)
        if best is None or len(got) > best[1]:
            best = (min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1), len(got)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_largest_blob_is_that_of_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random(rng.integers(1, 24, 2)) < rng.choice([0.1, 0.3, 0.45, 0.7, 1.0])
    assert vi.largest_blob(mask) == flood(mask)


def test_spirals_are_one_blob():
    mask = np.zeros((21, 21), bool)
    for k in range(0, 10, 2):
        mask[k, k:21 - k] = mask[20 - k, k:21 - k] = mask[k:21 - k, 20 - k] = True
        mask[k + 2 : 21 - k, k] = True
        mask[k + 2, k : k + 3] = True
    assert vi.largest_blob(mask) == flood(mask)


def test_detectors():
    box, sure = vi.find_face(picture())
    assert box == (30, 10, 64, 80) and sure == pytest.approx(0.8)
    assert vi.find_face(picture(False)) is None
    assert vi.find_face(picture(False), "static") == ((32, 14, 64, 67), 0.5)
    small = picture(False)
    small[:6, :6] = TONE
    assert vi.find_face(small)[1] == pytest.approx(0.24)  # under a hundredth of the frame
    with pytest.raises(ValueError):
        vi.find_face(small, "other")


def test_anchor_is_the_skin_inside_a_loose_box():
    mask = vi.skin_locus(picture())
    assert vi.anchored(mask, (10, 0, 110, 96)) == (30, 10, 64, 80)
    assert vi.anchored(mask, (0, 0, 30, 96)) is None and vi.anchored(mask, (30, 10, 6, 6)) is None


def test_crops_are_area_means():
    rng = np.random.default_rng(3)
    f = rng.integers(0, 256, (90, 70, 3)).astype(np.uint8)
    got = vi.face_crop(f, (3, 5, 60, 80), 20)
    want = f[5:85, 3:63].reshape(20, 4, 20, 3, 3).mean(axis=(1, 3))
    assert np.abs(got - want).max() <= 0.5 + 1e-9
    odd = vi.face_crop(np.full((50, 50, 3), 77, np.uint8), (1, 1, 37, 41), 72)
    assert odd.shape == (72, 72, 3) and (odd == 77).all()
    assert not vi.face_crop(f, (69, 0, 40, 40)).any()


def test_image_files_to_traces_and_crops(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for k in range(18):
        (tmp_path / "a" / f"f{k}.png").write_bytes(png(picture(k != 3, 30 + (k == 11))))
    (tmp_path / "a" / "f4.png").write_bytes(b"no image")
    (tmp_path / "b" / "f0.png").write_bytes(png(picture(False)))
    files = datasets.images(spark, str(tmp_path))
    raw = ingest.measure_images(files)
    rows = ingest.trace(raw).orderBy("recording_id", "i").toPandas()
    a = rows[rows.recording_id == "a"]
    assert a.i.tolist() == list(range(17)) and a.valid.tolist() == [k != 3 for k in range(17)]
    assert np.allclose(a.loc[a.valid, list("rgb")], TONE) and a.face.iloc[0] == pytest.approx(0.8) and a.face.iloc[3] == 0
    assert a.motion.iloc[10] < 1 == a.motion.iloc[9]  # f11 moved; f4 is no image
    assert raw.where("i % 15 <> 0 AND (chroma_ratio IS NOT NULL OR blockiness IS NOT NULL)").count() == 0
    assert rows[rows.recording_id == "b"].valid.tolist() == [False]
    cut = {(r.recording_id, r.i): bytes(r.crop) for r in ingest.crops(files, size=8).collect()}
    assert len(cut) == 18 and cut["a", 3] == cut["a", 2] == bytes(TONE) * 64 and cut["b", 0] == bytes(192)
