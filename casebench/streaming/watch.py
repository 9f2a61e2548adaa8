"""Streaming: a loop that runs a cycle when a case's files change, and event-time daily counts."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

POLL_SECONDS, FULL_SWEEP_SECONDS = 300, 86_400


def artifact_hashes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, sha256) of artifacts; a file that isn't there has the hash 'missing'."""
    names = spark.createDataFrame([(k, v) for k, v in paths.items()], "name string, path string")
    there = []
    for path in paths.values():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            there.append(path)
    if not there:
        return names.select("name", F.lit("missing").alias("sha256"))
    files = spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha2("content", 256).alias("sha256"))
    return names.join(files, "path", "left").select("name", F.coalesce("sha256", F.lit("missing")).alias("sha256"))


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """Names whose hash is another than before, or that are new or gone."""
    return before.withColumnRenamed("sha256", "__a").join(now.withColumnRenamed("sha256", "__b"), "name", "full_outer").filter(~F.col("__a").eqNullSafe(F.col("__b"))).select("name")


def due(changes: bool, first: bool, complete: bool, seconds_since_full: float) -> str | None:
    """Why a cycle runs now, or None: first run, changed files, a backlog, or a day since the last full one."""
    if first:
        return "first_run"
    if changes:
        return "changed"
    if not complete:
        return "backlog"
    return "full_sweep" if seconds_since_full >= FULL_SWEEP_SECONDS else None


@dataclass
class LoopState:
    """What a loop knows: whether it has run, whether its last cycle was complete, and when it began. loop.CaseLoop keeps it for each case."""

    first: bool = True
    complete: bool = True
    full_at: float = 0.0


def polled(state: LoopState, changes: bool, cycle: Callable[[str], bool], clock: Callable[[], float] = time.time) -> str | None:
    """Run a cycle if one is due, and say why; state follows. A cycle returns whether it was complete."""
    now = clock()
    why = due(changes, state.first, state.complete, now - state.full_at)
    if why:
        state.complete = cycle(why)
        state.first, state.full_at = False, now  # every cycle covers the whole case
    return why


def watch(spark: SparkSession, folder: str, schema, checkpoint: str, cycle: Callable[[DataFrame, int], bool], fmt: str = "json", once: bool = True, most_turns: int = 100, pause: float = 0.0):
    """Run cycle(new rows, epoch) on each batch of new files in a folder; again while it returns False, most_turns times at most.

    The checkpoint keeps which files were seen, so a restart with nothing new runs nothing; a batch whose backlog doesn't end
    fails and is seen again. pause: seconds before the second turn, twice as many before each next one, up to POLL_SECONDS.
    `once`: all there is, then stop.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        if df.isEmpty():
            return
        state = LoopState()
        for turn in range(most_turns):
            polled(state, False, lambda why: cycle(df, epoch))
            if state.complete:
                return
            time.sleep(min(pause * 2**min(turn, 30), POLL_SECONDS))
        raise RuntimeError(f"batch {epoch} isn't complete after {most_turns} cycles")

    stream = spark.readStream.schema(schema).format(fmt).load(folder)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{POLL_SECONDS} seconds")
    query = writer.start()
    if once:
        query.awaitTermination()
    return query


def daily_counts(stream: DataFrame, ts: str, *by: str, late: str = "1 day") -> DataFrame:
    """Events a day of event time, late ones up to `late` counted."""
    return stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).groupBy(F.window("__ts", "1 day").alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), *by, "n")


def streamed_daily_counts(spark: SparkSession, path: str, glob: str, ts: str, by: str, folder: str) -> DataFrame:
    """The daily counts of all files now in a folder, through a stream that ends when they are read.

    Each batch writes the counts as they then are to the shared folder, under its number, so a batch that runs twice changes
    nothing; the last one's are read back.
    """
    schema = spark.read.parquet(f"{path}/{glob}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)
    last: list[int] = []

    def written(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/counts/{epoch}")
        last.append(epoch)

    counts = daily_counts(stream, ts, by)
    counts.writeStream.outputMode("complete").foreachBatch(written).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/counts/{max(last)}") if last else spark.createDataFrame([], counts.schema)
