"""Packets as a stream, consent that changes beside it, and state samples into the study store."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.operators.store import Store
from pulsegrid.sources import packets
from pulsegrid.streaming.engine import ROCKS


def packet_stream(spark: SparkSession, path: str) -> DataFrame:
    """Frame rows from JSON-lines files of (session_id, seq, ts, json) that arrive in ``path``.

    ``seq`` is the index of a message's first frame, ``ts`` its event time; where that is missing, the time of its arrival counts.
    """
    messages = spark.readStream.schema("session_id long, seq long, ts timestamp, json string").json(path)
    rows = packets.parse(messages.withColumn("ts", F.coalesce("ts", F.current_timestamp())))
    return rows.select("session_id", (F.col("seq") + F.col("at")).alias("i"), "ts", *"rgb", "valid", "face", "lighting", "sharpness", "motion", "compression")


class _Gate(StatefulProcessor):
    """Holds a session's frames until the watermark has passed them, and lets out those that the newest consent event before them allows."""

    def __init__(self, payload: str, names: list[str], whole: list[bool]):
        self.payload, self.names, self.whole = payload, names, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getListState("said", "us long, granted boolean")
        self.held = handle.getListState("held", self.payload)

    def _out(self, key: tuple, frames: list[tuple], events: list[tuple], watermark_us: int) -> Iterator[pd.DataFrame]:
        events = sorted(events, key=lambda e: (e[0], not e[1]))  # at one instant a withdrawal is the newer
        times = [us for us, _ in events]
        ready, wait = [], []
        for f in frames:  # the time comes first
            (ready if f[0] < watermark_us else wait).append(f)
        self.held.put(wait) if wait else self.held.clear()
        old = bisect_right(times, watermark_us)
        events_left = events[max(0, old - 1) :]
        self.said.put(events_left) if events_left else self.said.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if wait:
            self.handle.registerTimer(max(f[0] for f in wait) // 1000 + 1)
        out = [f for f in ready if (k := bisect_right(times, f[0])) and events[k - 1][1]]
        if out:
            columns = {c: [f[k] for f in out] for k, c in enumerate(self.names)}
            yield pd.DataFrame({"session_id": [key[0]] * len(out)} | {c: pd.Series(v, dtype="Int64") if w else v for (c, v), w in zip(columns.items(), self.whole, strict=True)})

    def _state(self) -> tuple[list, list]:
        return [tuple(f) for f in self.held.get()], [tuple(e) for e in self.said.get()]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames, events = self._state()
        for pdf in rows:
            event = pdf["event"].to_numpy(bool)
            events += list(zip(pdf["us"][event].tolist(), pdf["granted"][event].astype(bool).tolist(), strict=True))
            values = pdf.loc[~event, self.names].astype(object).where(pdf.loc[~event, self.names].notna(), None)
            frames += [tuple(int(v) if w and v is not None else v for v, w in zip(row, self.whole, strict=True)) for row in values.values.tolist()]
        yield from self._out(key, frames, events, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._out(key, *self._state(), timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def consented(frames: DataFrame, consents: DataFrame, delay_s: float = 10.0) -> DataFrame:
    """A stream's frames whose session consented when they were taken.

    ``consents``: a stream of (session_id, at, granted boolean). Both streams meet by session in one stateful operator. A frame waits until the watermark,
    ``delay_s`` behind the newest event time of the slower stream, has passed it, as until then an event may still arrive. It passes if the newest consent event up
    to its time is a grant; at one instant a withdrawal counts as the newer. So frames after a withdrawal never pass, not even in its own
    micro-batch, and frames before it do. State holds a session's frames of ``delay_s`` and the consent events that may still matter. (An interval join followed by
    an aggregation gives the same rows, but only after the longest validity of a consent: the join's watermark lags by its interval.)
    Frames and events without a session or time are dropped.
    """
    spark = frames.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    names = [c for c in kinds if c not in ("session_id", "ts")]
    whole = [True, *(kinds[c] in ("bigint", "int", "smallint", "tinyint") for c in names)]
    payload = ", ".join(["us long", *(f"`{c}` {kinds[c]}" for c in names)])
    left = frames.withWatermark("ts", f"{delay_s} seconds").select("session_id", "ts", F.unix_micros("ts").alias("us"), *names, F.lit(False).alias("granted"), F.lit(False).alias("event"))
    nothing = [(F.lit(0) if w else F.lit(None)).cast(kinds[c]).alias(c) for c, w in zip(names, whole[1:], strict=True)]
    right = consents.withWatermark("at", f"{delay_s} seconds").select("session_id", F.col("at").alias("ts"), F.unix_micros("at").alias("us"), *nothing, F.coalesce("granted", F.lit(False)).alias("granted"), F.lit(True).alias("event"))
    both = left.unionByName(right).where("session_id IS NOT NULL AND ts IS NOT NULL")
    out = both.groupBy("session_id").transformWithStateInPandas(_Gate(payload, ["us", *names], whole), f"session_id {kinds['session_id']}, {payload}", "append", "eventTime")
    return out.withColumn("ts", F.timestamp_micros("us")).select(*kinds)


def to_store(states: DataFrame, store: Store, checkpoint: str):
    """Writes state samples of consenting sessions as upserts, each micro-batch once: the store remembers the numbers. Returns the started query.

    Samples of a session whose consent is missing or withdrawn are left out; those of the others go in.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col("session_id").cast("string").alias("session_id"), "t", "hr_bpm", "confidence", "reason")
        store.append_samples(rows, consenting=True, batch=(checkpoint, number))

    return states.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
