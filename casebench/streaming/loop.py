"""The loop over cases with state that outlives it: which poll of a case runs a cycle, and why.

A poll sees the hashes of some of a case's artifacts. A cycle runs if there was none before (first_run), if a hash isn't what
the last cycle saw (changed), if that cycle left work over (backlog), or if it was more than a day ago (full_sweep). What a
case's last cycle saw is a row of a log table, written in the batch that ran it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from casebench.sources.logtable import LogTable
from casebench.streaming.watch import FULL_SWEEP_SECONDS, due

STATE = "case_id string, cycles long, last_cycle timestamp, complete boolean, artifacts array<struct<name:string,sha256:string>>"
CYCLES = "case_id string, poll long, at timestamp, reason string, cycle long"
OBSERVED = "case_id string, poll long, at timestamp, artifact string, sha256 string, complete boolean"
MICROS = 1_000_000


@dataclass
class Case:
    """One case's state as its polls come in order; memory: its artifacts."""

    case_id: str
    cycles: int = 0
    last: int = 0
    complete: bool = True
    seen: dict[str, str] = field(default_factory=dict)
    touched: bool = False

    def poll(self, at: int, hashes: dict[str, str], complete: bool) -> str | None:
        """Why a cycle runs, or None. hashes: of the artifacts that this poll saw; complete: whether a cycle run now ends its work."""
        changes = any(self.seen.get(k) != v for k, v in hashes.items())
        over = at - self.last > FULL_SWEEP_SECONDS * MICROS
        why = due(changes, not self.cycles, self.complete, FULL_SWEEP_SECONDS if over else 0)
        if why:
            self.cycles, self.last, self.complete, self.touched = self.cycles + 1, at, complete, True
            self.seen |= hashes
        return why


def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a state and its case's observations in order become decisions (state null) and new states (poll null)."""
    out: list[tuple] = []
    own: Case | None = None
    poll: tuple | None = None  # poll, at, hashes, complete

    def polled() -> None:
        nonlocal poll
        if poll and (why := own.poll(poll[1], poll[2], poll[3])):
            out.append((own.case_id, poll[0], poll[1], why, own.cycles, None, None))
        poll = None

    def closed() -> None:
        polled()
        if own.touched:
            out.append((own.case_id, None, own.last, None, own.cycles, own.complete, [{"name": k, "sha256": v} for k, v in sorted(own.seen.items())]))

    def taken() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("name", pa.string()), ("sha256", pa.string())])))
        columns = list(zip(*out, strict=True)) or [()] * len(types)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["case_id", "poll", "at", "reason", "cycle", "complete", "artifacts"])

    for batch in batches:
        micros = batch.column("at").cast(pa.int64()).to_pylist()
        rest = [batch.column(c).to_pylist() for c in ("case_id", "poll", "artifact", "sha256", "complete", "cycles", "artifacts")]
        for at, case, number, artifact, sha, complete, cycles, artifacts in zip(micros, *rest, strict=True):
            if own is None or case != own.case_id:
                if own:
                    closed()
                own = Case(case)
            if cycles is not None:
                own.cycles, own.last, own.complete, own.seen = cycles, at, complete, {a["name"]: a["sha256"] for a in artifacts or []}
                continue
            if poll and poll[:2] != (number, at):
                polled()
            if poll is None:
                poll = (number, at, {}, True)
            poll[2][artifact] = sha
            poll = (number, at, poll[2], poll[3] and bool(complete))
        if len(out) > 20_000:
            yield taken()
    if own:
        closed()
    yield taken()


class CaseLoop:
    """Cycles and states of all cases below a folder that driver and executors share; a new object goes on where the last ended."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.states = LogTable(spark, f"{self.root}/state", STATE, ["case_id"])

    def step(self, observed: DataFrame, batch: int, cycle: Callable[[DataFrame, int], None] | None = None) -> None:
        """Decide a batch of observations (OBSERVED), polls of a case in order of (at, poll). A batch seen before changes nothing.

        The decisions are written first and the states with the batch's number last: what is between is done again after a
        failure. cycle: gets the decisions; a repeated call must be harmless, as its calls to models go through the cache.
        An observation without case, time or artifact is no poll. Of one artifact twice in a poll the largest hash counts.
        """
        if batch <= self.states.last_batch():
            return
        kept = self.states.read()
        given = observed.filter(F.col("case_id").isNotNull() & F.col("at").isNotNull() & F.col("artifact").isNotNull())
        obs = given.select("case_id", "at", "poll", "artifact", "sha256", "complete", F.lit(None).cast("long").alias("cycles"), F.lit(None).cast("array<struct<name:string,sha256:string>>").alias("artifacts"))
        before = kept.select("case_id", F.col("last_cycle").alias("at"), F.lit(None).cast("long").alias("poll"), F.lit(None).cast("string").alias("artifact"), F.lit(None).cast("string").alias("sha256"), "complete", "cycles", "artifacts")
        rows = before.unionByName(obs).repartition("case_id").sortWithinPartitions("case_id", F.col("cycles").isNull(), "at", "poll", "artifact", "sha256")
        out = f"{self.root}/decided/{batch:012d}"
        rows.mapInArrow(decided, "case_id string, poll long, at timestamp, reason string, cycle long, complete boolean, artifacts array<struct<name:string,sha256:string>>").write.mode("overwrite").parquet(out)
        done = self.spark.read.parquet(out)
        if cycle:
            cycle(done.filter("reason IS NOT NULL").select("case_id", "poll", "at", "reason", "cycle"), batch)
        self.states.append(done.filter("reason IS NULL").select("case_id", F.col("cycle").alias("cycles"), F.col("at").alias("last_cycle"), "complete", "artifacts"), batch)

    def cycles(self) -> DataFrame:
        """All decisions (CYCLES) of the batches that are done."""
        done = [f"{self.root}/decided/{b:012d}" for b in self._batches() if b <= self.states.last_batch()]
        rows = self.spark.read.parquet(*done) if done else self.spark.createDataFrame([], CYCLES)
        return rows.filter("reason IS NOT NULL").select("case_id", "poll", "at", "reason", "cycle")

    def _batches(self) -> list[int]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/decided")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def watch_cases(spark: SparkSession, folder: str, root: str, cycle: Callable[[DataFrame, int], None] | None = None, once: bool = True, pause: str = "300 seconds"):
    """Run a CaseLoop over the files of observations that come into a folder; `once`: all there are, then stop.

    The stream's checkpoint and the states are below root; a restart goes on from both.
    """
    stream = spark.readStream.schema(OBSERVED).parquet(folder)
    writer = stream.writeStream.foreachBatch(lambda df, batch: CaseLoop(spark, root).step(df, batch, cycle)).option("checkpointLocation", f"{root}/checkpoint")
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=pause)).start()
    if once:
        query.awaitTermination()
    return query
