"""A table by key as a log of segments: batches are appended, the latest row of a key counts, old segments are merged."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from casebench.sources.sinks import _fs, put_small, read_small

SEQ = "__seq"


class LogTable:
    """Rows by `keys`; a row of a later batch replaces an earlier one, within a batch the largest by `order` counts.

    Every append is a new segment folder and then one rename of the list of segments, so a reader sees a batch whole or not at
    all, and a killed job leaves a folder that nobody reads. A batch has a number; one that is appended again changes nothing,
    which makes a retried streaming batch safe. One writer at a time. After `fan` segments the latest rows are merged into one,
    the number of their batch kept; the segments that the list before last named are deleted then, so that a reader that began
    before a merge can end.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType, keys: list[str], order: tuple[str, ...] = (), fan: int = 8):
        self.spark, self.root, self.keys, self.order, self.fan = spark, root.rstrip("/"), keys, order, fan
        self.schema = spark.createDataFrame([], schema).schema

    def manifest(self) -> dict:
        return json.loads(read_small(self.spark, f"{self.root}/_SEGMENTS") or '{"segments": [], "old": [], "batch": -1}')

    def last_batch(self) -> int:
        """The number of the latest batch; -1 before the first."""
        return self.manifest()["batch"]

    def _write(self, rows: DataFrame) -> str:
        name = f"s-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return name

    def append(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Add a batch, by default the next one; False, and nothing done, if that batch or a later one is there already."""
        now = self.manifest()
        batch = now["batch"] + 1 if batch is None else batch
        if batch <= now["batch"]:
            return False
        name = self._write(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn(SEQ, F.lit(batch).cast("long")))
        now |= {"segments": [*now["segments"], name], "batch": batch}
        put_small(self.spark, f"{self.root}/_SEGMENTS", json.dumps(now))
        if len(now["segments"]) > self.fan:
            self.compact()
        return True

    def _latest(self, segments: list[str]) -> DataFrame:
        schema = StructType([*self.schema.fields]).add(SEQ, "long")
        if not segments:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s}" for s in segments])
        rest = [f.name for f in self.schema if f.name not in self.keys]
        # partial aggregation: a key with a third of all rows sends one row a task
        newest = F.max(F.struct(SEQ, *self.order, *[c for c in rest if c not in self.order])).alias("__row")
        if any("map" in f.dataType.simpleString() for f in self.schema):
            newest = F.max_by(F.struct(SEQ, *rest), F.struct(SEQ, *self.order)).alias("__row")
        found = rows.groupBy(*self.keys).agg(newest)
        return found.select(*[F.col(f.name) if f.name in self.keys else F.col(f"__row.{f.name}") for f in self.schema], F.col(f"__row.{SEQ}").alias(SEQ))

    def read(self) -> DataFrame:
        """The latest row of each key."""
        return self._latest(self.manifest()["segments"]).drop(SEQ)

    def compact(self) -> None:
        """All segments as one; no key is lost."""
        now = self.manifest()
        if len(now["segments"]) < 2:
            return
        name = self._write(self._latest(now["segments"]))
        put_small(self.spark, f"{self.root}/_SEGMENTS", json.dumps({"segments": [name], "old": now["segments"], "batch": now["batch"]}))
        for old in now["old"]:
            fs, p = _fs(self.spark, f"{self.root}/{old}")
            fs.delete(p, True)
