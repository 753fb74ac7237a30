"""Synthetic traces with a known rate: closed-form columns over ``spark.range``, no rendering.

Rate drifts, breathes and may answer an event; its integral drives a pulse
waveform, and skin colour follows illumination, pulse and a seeded noise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import scoring


@dataclass(frozen=True)
class Config:
    recording_id: int
    seconds: float = 60.0
    fps: float = 30.0
    base_hr: float = 72.0
    drift_bpm: float = 6.0
    rsa_bpm: float = 3.0
    amplitude: float = 0.012
    noise: float = 0.0004
    seed: int = 0
    event: tuple[float, float, float, float] | None = None  # start, stop, ramp, bpm
    tone: tuple[float, float, float] = (0.62, 0.46, 0.40)
    motion: float = 0.0  # size of broadband movement, in face widths
    specular: float = 0.0  # colourless glare that movement brings, as a share of full white
    light: float = 1.0  # brightness of the scene
    chroma: float = 1.0  # chroma detail that compression leaves


def cohort(n: int = 4, **more) -> list[Config]:
    """Plain cohort: rates 58, 69, 80, ... bpm."""
    return [Config(i, base_hr=58.0 + 11 * i, seed=i, **more) for i in range(n)]


PROTOCOL_TASK = (90.0, 180.0)


def protocol(n: int = 6, task_bpm: float = 12.0) -> list[Config]:
    """Rest, task, recovery: rates 58, 64, ... bpm and an event during the task."""
    return [Config(i, seconds=240.0, base_hr=58.0 + 6 * i, seed=100 + i, event=(*PROTOCOL_TASK, 8.0, task_bpm)) for i in range(n)]


def stress(n: int = 2) -> list[Config]:
    """Five levels of rising noise, ``n`` recordings each."""
    return [Config(level * n + k, base_hr=62.0 + 9 * k, noise=0.0004 * 6**level, seed=level * n + k) for level in range(5) for k in range(n)]


#: Degradations by axis: what each level changes.
AXES = {
    "noise": lambda level: {"noise": 0.0004 * 5.0**level},
    "motion": lambda level: {"motion": 0.2 * level, "specular": 0.2 * level},
    "light": lambda level: {"light": 1.0 / (1.0 + 1.2 * level), "noise": 0.0004 * (1.0 + level)},
    "compression": lambda level: {"chroma": 0.35**level, "noise": 0.0004 * (1.0 + level)},
}


def axis(name: str, levels: int = 5, n: int = 2, **more) -> list[Config]:
    """``n`` recordings at each level of one degradation; recording_id // n is the level."""
    if name not in AXES:
        raise ValueError(f"unknown axis {name!r}; there are {sorted(AXES)}")
    return [Config(level * n + k, base_hr=62.0 + 9 * k, seed=level * n + k, **AXES[name](level) | more) for level in range(levels) for k in range(n)]


def frames(spark: SparkSession, configs: list[Config]) -> DataFrame:
    """(recording_id, i, t, hr, bvp, r, g, b, valid, quality columns) of all recordings."""
    rows = [
        (c.recording_id, int(c.seconds * c.fps), c.fps, c.base_hr, c.drift_bpm, c.rsa_bpm, c.amplitude, c.noise, c.seed, float(np.random.default_rng(c.seed + 9973).uniform(0, 2 * math.pi)), *(c.event or (0.0, 0.0, 1.0, 0.0)), *c.tone, c.motion, c.specular, c.light, c.chroma)
        for c in configs
    ]
    names = "recording_id long, n long, fps double, base double, drift double, rsa double, amp double, noise double, seed long, phi double, e0 double, e1 double, ramp double, ebpm double, tr double, tg double, tb double, motion_size double, specular double, bright double, chroma double"
    df = spark.createDataFrame(rows, names).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    t = F.col("i") / F.col("fps")
    event = F.col("ebpm") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - F.col("e0")) / F.col("ramp"), (F.col("e1") - t) / F.col("ramp")))
    hr = F.col("base") + F.col("drift") * F.sin(2 * math.pi * t / 70 + F.col("phi")) + F.col("rsa") * F.sin(2 * math.pi * 0.25 * t) + event
    by = W.partitionBy("recording_id").orderBy("i")
    df = df.withColumn("t", t).withColumn("hr", hr).withColumn("phase", 2 * math.pi * F.sum("hr").over(by) / 60 / F.col("fps"))
    wave = F.sin("phase") + 0.25 * F.sin(2 * F.col("phase") + 0.6) + 0.12 * F.sin(3 * F.col("phase") + 1.1)
    df = df.withColumn("wave", wave).withColumn("bvp", F.col("wave") / F.max(F.abs("wave")).over(W.partitionBy("recording_id")))
    # noise from a hash of its place: the same wherever and however often it is computed
    unit = lambda c, *of: (F.pmod(F.xxhash64(*(of or ("seed", "i")), F.lit(c)), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    gauss = lambda c: F.sqrt(-2 * F.log(unit(c))) * F.cos(2 * math.pi * unit(c + "'"))
    pbv = {"r": 0.33, "g": 0.77, "b": 0.53}
    # broadband movement: five incommensurate waves of seeded phase between 0.2 and 2.3 Hz, within [-1, 1]
    waves = [F.sin(2 * math.pi * (hz * F.col("t") + unit(f"m{k}", "seed"))) for k, hz in enumerate((0.23, 0.47, 0.89, 1.51, 2.29))]
    sway = sum(waves[1:], waves[0]) / 5
    df = df.withColumn("sway", sway * F.col("motion_size"))
    glare = F.col("specular") * F.abs(sway) * 255
    light = F.col("bright") * (1 + 0.02 * F.sin(2 * math.pi * F.col("t") / 17) + F.col("sway"))
    value = lambda c: light * (F.col(f"t{c}") + F.col("chroma") * pbv[c] * F.col("amp") * F.col("bvp")) * 255 + glare + gauss(c) * F.col("noise") * 255
    colours = {c: F.greatest(F.lit(0.0), F.least(F.lit(255.0), value(c))) for c in "rgb"}
    step = F.abs(F.col("sway") - F.coalesce(F.lag("sway").over(by), F.col("sway")))
    quality = {
        "face": F.lit(0.95), "lighting": 0.95 * scoring.clip(F.col("bright") * 140 / scoring.GOOD_LUMA[0]), "sharpness": F.lit(0.9),
        "motion": 0.95 * scoring.motion(step, F.lit(1.0)), "compression": scoring.clip(1.0 + F.log10(F.col("chroma")) / 1.7),
    }
    return df.withColumns(colours | quality | {"valid": F.lit(True)}).select("recording_id", "i", "t", "hr", "bvp", *"rgb", "valid", *quality)
