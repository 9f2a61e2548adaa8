"""Sinks: versioned tables with a current pointer, append logs, upserts, replacing by document, gated and proposed output."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_small(spark: SparkSession, path: str) -> str | None:
    """The content of a small file; None if it isn't there. Spark's own readers pass over names that begin with _."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_small(spark: SparkSession, path: str, content: str) -> None:
    """Write a small file by one rename over the old one: a reader sees the one or the other."""
    fs, final = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}-{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(content.encode()))
    out.close()
    options = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, final, over)


class VersionedTable:
    """A parquet table whose every write is a new folder; `_CURRENT` names the one that readers see.

    One writer at a time. A reader that began before a write goes on with the version it began with.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _pointer(self) -> str | None:
        return read_small(self.spark, f"{self.root}/_CURRENT")

    def read(self) -> DataFrame | None:
        current = self._pointer()
        return self.spark.read.parquet(f"{self.root}/{current}") if current else None

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> str:
        version = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{version}")
        put_small(self.spark, f"{self.root}/_CURRENT", version)
        fs, root = _fs(self.spark, self.root)
        versions = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("v"))
        for old in versions[: -self.keep]:
            fs.delete(_fs(self.spark, f"{self.root}/{old}")[1], True)
        return version


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows by key: a row of new replaces one of old, but for the columns in `keep`, which stay as they were.

    new has each key once. A full outer join; nothing but the join's shuffle.
    """
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = o.withColumn("__o", F.lit(True)).alias("o").join(n.withColumn("__n", F.lit(True)).alias("n"), on, "full_outer")
    there, here = F.col("o.__o").isNotNull(), F.col("n.__n").isNotNull()
    pick = lambda c: F.when(there & (F.lit(c in keep) | ~here), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select(*[pick(c).alias(c) for c in old.columns])


def merged_catalog(*layers: DataFrame, key: str) -> DataFrame:
    """Later layers win by key; origin is the number of the layer that a row is from."""
    tagged = [df.withColumn("origin", F.lit(i)) for i, df in enumerate(layers)]
    union = tagged[0]
    for df in tagged[1:]:
        union = union.unionByName(df, allowMissingColumns=True)
    best = union.groupBy(key).agg(F.max_by(F.struct(*union.columns), "origin").alias("r"))
    return best.select(*[F.col(f"r.{c}").alias(c) for c in union.columns])


def with_new_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and those of new whose key old hasn't."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def replaced_by_document(old: DataFrame, new: DataFrame, doc: str, processed: DataFrame, order: list[str]) -> DataFrame:
    """Rows of documents that weren't processed, and the new rows; sorted, so equal content is written in equal order."""
    return old.join(processed.select(doc).distinct(), doc, "left_anti").unionByName(new, allowMissingColumns=True).orderBy(*order)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Overwrite a folder of CSV files with header, quoted as read_csv() reads; rows in order over the files, null as ''."""
    out = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    out.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def appended(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_proposal(df: DataFrame, live: str) -> str:
    """Written beside the live catalogue, never over it."""
    path = f"{live.rstrip('/')}_proposed"
    df.write.mode("overwrite").parquet(path)
    return path


def cleared(spark: SparkSession, root: str, level: str) -> list[str]:
    """Delete what a level of rebuilding makes anew: analysis, then derived, then extracted; never raw."""
    levels = {"analysis": ["findings", "reports"], "derived": ["facts", "persons", "chunks", "vectors"], "extracted": ["extracted"]}
    names = [n for k in list(levels)[: list(levels).index(level) + 1] for n in levels[k]]
    gone = []
    for n in names:
        fs, p = _fs(spark, f"{root}/{n}")
        if fs.exists(p):
            fs.delete(p, True)
            gone.append(n)
    return gone
