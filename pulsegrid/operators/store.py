"""A study store over Parquet tables: studies, sessions, consents, samples and marks.

Rows are appended with an ingest order and the newest row of a key counts, so an
upsert is an append. Tables are cut by a hash of the session (``BUCKETS``), so that
erasing one rewrites one partition of each table and reading one reads one. A manifest
lists the folders that make up the tables; what it doesn't list isn't there. Every change
writes its folders first and then one new manifest under the next number. That number can be taken once,
which makes it the commit: a crash before it changes nothing, and a writer that lost the race judges
its rows again by the tables as they are now. (HDFS and local disks refuse a second taker. An object
store that doesn't needs one writer at a time.)

Erasure and retention rewrite the partitions concerned, commit, and then delete what
they replaced; opening a store finishes a deletion that a crash cut short. Folders that no manifest
ever listed belong to writers at work, or crashed: they go after ``LEASE_S``, and a writer
slower than that is told so at its commit. Nothing keeps a copy, and there is no unbounded retention.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import studies
from pulsegrid.staging import staged

TABLES = {
    "studies": ("study_id string, name string, created_at double, retention_days int, closed_at double", ["study_id"]),
    "sessions": ("session_id string, study_id string, created_at double, external_ref string, method string, fps double, closed_at double, withdrawn_at double", ["session_id"]),
    "consents": ("session_id string, granted_at double, notice_version string, notice_text string, scopes array<string>, withdrawn_at double", ["session_id"]),
    "samples": ("session_id string, t double, hr_bpm double, confidence double, reason string", ["session_id", "t"]),
    "marks": ("session_id string, t double, label string", None),
}


#: Partitions of a table.
BUCKETS = 16
#: Seconds after which folders of an uncommitted change count as left behind.
LEASE_S = 6 * 3600.0
#: Times a change is tried again when other writers come first.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer came first."""


class ConsentError(PermissionError):
    """No active consent, a superseded notice, or a missing scope."""


@dataclass(frozen=True)
class SessionConfig:
    fps: float = 30.0
    method: str = "pos"
    window_s: float = 20.0
    emit_hz: float = 1.0
    calibration_s: float = 45.0
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        for name, lo, hi, open_ in (("fps", 0, 120, True), ("window_s", 5, 60, False), ("emit_hz", 0, 5, True), ("calibration_s", 0, 180, False)):
            v = getattr(self, name)
            if not (lo < v if open_ else lo <= v) or v > hi:
                raise ValueError(f"{name} must lie in {'(' if open_ else '['}{lo}, {hi}]")


def _key(table: str) -> str:
    return "study_id" if table == "studies" else "session_id"


def _bucket(key: str):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int").alias("bucket")


class Store:
    #: Manifests behind the newest that stay, for readers that still list by them.
    KEPT = 3

    def __init__(self, spark: SparkSession, root: str, notice: tuple[str, str] = ("1", ""), scopes: tuple[str, ...] = ("camera", "measurements")):
        self.spark, self.root, self.notice, self.scopes = spark, root.rstrip("/"), notice, scopes
        self._known: dict[str, list[str]] = {}
        if self._manifests():
            self._sweep()

    def _path(self, *parts):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        path, fs = self._path(folder), self._fs()
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._listed("_manifest") if n.endswith(".json")]

    def _read_manifest(self, name: str) -> dict:
        stream = self._fs().open(self._path("_manifest", name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _manifest(self) -> tuple[int, dict[str, list[str]]]:
        """(number, folders of each table) as committed last, by any writer."""
        found = self._manifests()
        return (int(found[-1].split(".")[0]), self._read_manifest(found[-1])) if found else (0, {t: [] for t in TABLES})

    def _commit(self, number: int, names: dict) -> None:
        """Takes the number after ``number``; ``Conflict`` if another writer has it."""
        for t in TABLES:
            for n in set(names[t]) - set(self._known.get(t, ())):
                if not self._fs().exists(self._path(t, n)):
                    raise RuntimeError(f"{t}/{n} is gone: the change took longer than {LEASE_S:.0f} s")
        draft, final = self._path("_manifest", f"{uuid.uuid4().hex}.draft"), self._path("_manifest", f"{number + 1:012d}.json")
        out = self._fs().create(draft)
        out.write(bytearray(json.dumps(names).encode()))
        out.close()
        if not self._taken(draft, final):
            self._fs().delete(draft, False)
            raise Conflict("another writer changed the store; try again")
        self._known = {t: names[t] for t in TABLES}
        for old in self._manifests()[: -self.KEPT]:
            self._fs().delete(self._path("_manifest", old), False)

    def _taken(self, draft, final) -> bool:
        """Gives the draft its final name unless that exists, in one step."""
        if self._fs().getScheme() != "file":
            return self._fs().rename(draft, final)  # refuses to replace
        files, java = self.spark._jvm.java.nio.file.Files, self.spark._jvm.java.io.File
        try:
            files.createLink(java(final.toUri().getPath()).toPath(), java(draft.toUri().getPath()).toPath())
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        self._fs().delete(draft, False)
        return True

    def _write(self, table: str, rows: DataFrame) -> list[str]:
        """Writes rows as new folders, one a partition, and returns them."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
        rows.withColumn("ingest", F.lit(name)).withColumn("bucket", _bucket(_key(table))).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{table}/{name}")
        return [f"{name}/{n}" for n in self._listed(f"{table}/{name}") if n.startswith("bucket=")]

    def _changed(self, change):
        """Commits what ``change(names)`` makes of the tables' folders, again and again while other writers come first."""
        for _ in range(TRIES):
            number, names = self._manifest()
            new = change(names)
            if new is None:
                return
            try:
                self._commit(number, names | new)
            except Conflict:
                continue
            return
        raise Conflict(f"other writers came first {TRIES} times")

    def _append(self, table: str, rows: DataFrame) -> None:
        new = self._write(table, rows)
        self._changed(lambda names: {table: [*names[table], *new]})

    def _put(self, table: str, *values) -> None:
        self._append(table, self.spark.createDataFrame([values], TABLES[table][0]))

    def _sweep(self) -> None:
        """Deletes folders that an earlier manifest listed and the newest doesn't, and those that none listed once their lease is over."""
        found = self._manifests()
        now = self._read_manifest(found[-1])
        past = [self._read_manifest(n) for n in found[:-1]]
        for t in TABLES:
            dropped = {n for names in past for n in names[t]} - set(now[t])
            live = {n.split("/")[0] for n in now[t]}
            for n in dropped:
                self._fs().delete(self._path(t, n), True)
            for folder in set(self._listed(t)) - live:
                if folder in {n.split("/")[0] for n in dropped} or time.time() - int(folder.split("-")[0]) / 1e9 > LEASE_S:
                    self._fs().delete(self._path(t, folder), True)

    def read(self, table: str, session_id: str | None = None) -> DataFrame:
        """The table's current rows; those of a session come from its partition alone."""
        return self._read(table, self._manifest()[1], session_id)

    def _read(self, table: str, manifest: dict, session_id: str | None = None) -> DataFrame:
        schema, key = TABLES[table]
        names = manifest[table]
        if session_id is not None:
            own = self.spark.createDataFrame([(session_id,)], "session_id string").select(_bucket("session_id")).first()[0]
            names = [n for n in names if n.endswith(f"/bucket={own}")]
        if not names:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema + ", ingest string").parquet(*[f"{self.root}/{table}/{n}" for n in names])
        rows = rows if session_id is None else rows.where(F.col("session_id") == session_id)
        return (studies.latest(rows, key, [F.col("ingest").desc()]) if key else rows).drop("ingest")

    def create_study(self, name: str, retention_days: int = 90) -> str:
        if not 1 <= len(name) <= 200 or not 1 <= retention_days <= 730:
            raise ValueError("a study has a name of 1 to 200 characters and a retention of 1 to 730 days")
        key = uuid.uuid4().hex
        self._put("studies", key, name, time.time(), retention_days, None)
        return key

    def list_studies(self) -> DataFrame:
        return self.read("studies").orderBy(F.col("created_at").desc())

    def create_session(self, study_id: str | None = None, config: SessionConfig | None = None, external_ref: str | None = None) -> str:
        config = config or SessionConfig()
        if study_id is not None and not self.read("studies").where(F.col("study_id") == study_id).count():
            raise KeyError(study_id)
        key = uuid.uuid4().hex
        self._put("sessions", key, study_id, time.time(), external_ref, config.method, float(config.fps), None, None)
        return key

    def grant(self, session_id: str, version: str, scopes: list[str]) -> None:
        if version != self.notice[0]:
            raise ConsentError("the notice was superseded")
        if missing := set(self.scopes) - set(scopes):
            raise ConsentError(f"consent requires all scopes; missing: {sorted(missing)}")
        self._put("consents", session_id, time.time(), version, self.notice[1], sorted(self.scopes), None)

    def append_samples(self, rows: DataFrame, consenting: bool = False, batch: tuple[str, int] | None = None) -> None:
        """Adds or replaces samples of sessions with active consent.

        Other rows are refused as a whole; with ``consenting`` they are left out. Consent is judged by the
        tables that the commit builds on: a withdrawal meanwhile counts. ``batch`` (source, number) is taken in once: a
        number up to the source's last is a replay and changes nothing.
        """
        rows = staged(rows.select(*[c.split()[0] for c in TABLES["samples"][0].split(", ")]), "samples")

        def change(names):
            done = names.get("_batches", {})
            if batch and batch[1] <= done.get(batch[0], -1):
                return None
            allowed = studies.consent_gate(rows, self._read("consents", names))
            if not consenting and rows.count() != allowed.count():
                raise ConsentError("no active consent for some session")
            return {"samples": [*names["samples"], *self._write("samples", allowed)]} | ({"_batches": done | {batch[0]: batch[1]}} if batch else {})

        self._changed(change)

    def mark(self, session_id: str, t: float, label: str) -> None:
        if not self.read("consents", session_id).where("withdrawn_at IS NULL").count():
            raise ConsentError("no active consent for this session")
        self._put("marks", session_id, float(t), label)

    def _rewrite(self, gone: DataFrame | None, tables) -> None:
        """The tables without the sessions of ``gone``: their partitions are written anew, committed at once, then the old folders go. None: all partitions."""
        if gone is not None:
            gone = staged(gone.select("session_id").distinct(), "gone")  # read by every table, whatever number of sessions a purge names
            touched = {r[0] for r in gone.select(_bucket("session_id")).distinct().collect()}  # at most BUCKETS
        else:
            gone, touched = self.spark.createDataFrame([], "session_id string"), set(range(BUCKETS))

        def change(names):
            new = {}
            for t in tables:
                mine = [n for n in names[t] if int(n.rsplit("=", 1)[1]) in touched]
                if mine:
                    new[t] = [n for n in names[t] if n not in mine] + self._write(t, studies.erase(self._read(t, {t: mine}), gone))
            return new

        self._changed(change)
        self._sweep()

    def compact(self) -> None:
        """One folder a partition, without rows that newer ones replaced."""
        self._rewrite(None, tuple(TABLES)[1:])

    def close_session(self, session_id: str) -> None:
        """Stamps a session's end; a session that is closed, withdrawn or unknown can't be closed."""
        one = self.read("sessions", session_id).where("closed_at IS NULL AND withdrawn_at IS NULL")
        if not one.limit(1).count():
            raise KeyError(session_id)
        self._append("sessions", one.withColumn("closed_at", F.lit(time.time())))

    def withdraw(self, session_id: str, erase: bool = True) -> None:
        """Removes samples and marks, and by default the session and its consent; else both are flagged."""
        one = self.spark.createDataFrame([(session_id,)], "session_id string")
        if not erase:
            now = time.time()
            for t in ("sessions", "consents"):
                self._append(t, self.read(t, session_id).withColumn("withdrawn_at", F.lit(now)))
        self._rewrite(one, ("samples", "marks", "consents", "sessions") if erase else ("samples", "marks"))

    def purge_expired(self, now: float | None = None) -> int:
        gone = studies.expired_sessions(self.read("sessions"), self.read("studies"), time.time() if now is None else now)
        n = gone.count()
        if n:
            self._rewrite(gone, ("samples", "marks", "consents", "sessions"))
        return n

    def export(self, session_id: str) -> DataFrame:
        one = lambda t: self.read(t, session_id)
        samples = one("samples")
        return studies.session_export(one("sessions"), samples, one("marks")).join(one("consents").select("session_id", "granted_at", "notice_version", "scopes"), "session_id", "left")

    def aggregate(self, study_id: str) -> DataFrame:
        live = self.read("sessions").where((F.col("study_id") == study_id) & F.col("withdrawn_at").isNull())
        return studies.study_aggregate(live.select("session_id", "study_id"), self.read("samples"))
