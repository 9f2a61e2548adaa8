"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: ASCII white space, which separates words: `[^\x20\x09-\x0D]+` is a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset a local session (tests) gets a
    temporary one; on a cluster, whose machines don't share such a folder, that is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="casebench-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str, *by: str) -> DataFrame:
    """df written to the shared folder (a folder for each value of the columns `by`) and read back: the work is done once and
    a lost executor costs no recomputation.

    All of an application's tables are below one folder, to be deleted when it has ended; release() deletes one sooner.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/casebench-{spark.sparkContext.applicationId}/casebench-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    spark._jvm.System.gc()  # the context cleaner deletes shuffle files only of plans that were collected: disk would fill up
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete what materialize() wrote for df, once nothing reads it any more."""
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/casebench-" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns; any other column is dropped, so clashing names do no harm."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def spans_of_bytes(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow batch into pieces of about `limit` UTF-8 bytes, at row ends.

    Yields (first row, row after the last, bytes, offsets of the rows in them). A null text is an empty one.
    """
    col = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return
    _, off, buf = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + 60_000)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def sums_by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags[offsets[i]:offsets[i+1]] for each row i."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, dtype=np.int64, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def byte_table(members: bytes) -> np.ndarray:
    """A 256-entry 0/1 table."""
    table = np.zeros(256, np.uint8)
    table[list(members)] = 1
    return table


def numbered(df: DataFrame, group: list[str], order: list, out: str, shards: int = 256, key: str = "doc_id") -> DataFrame:
    """Gapless numbers from 0 within each group, in order of (shard, *order), where the shard is a hash of `key`.

    Each group is dealt over `shards` windows, so that a group with a third of all rows isn't one task. The counts of
    (group, shard), aggregated before their shuffle, give each window its first number. df is read twice.
    """
    df = df.withColumn("__shard", F.pmod(F.xxhash64(F.lit("shard"), F.col(key)), F.lit(shards)).cast("int"))
    before = W.partitionBy(*[f"__g_{g}" for g in group]).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    counts = df.groupBy(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__shard").alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    first = counts.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(*group, "__shard").orderBy(*order)) - 1)
    on = F.col("__shard") == F.col("__s")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return ranked.join(first, on).withColumn(out, (F.col("__first") + F.col("__rank")).cast("long")).drop("__shard", "__s", "__first", "__rank", *[f"__g_{g}" for g in group])


def starts_of_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """1 at each byte that begins a word; words don't go over the ends of rows."""
    table = np.ones(256, np.uint8)
    table[list(SPACE_BYTES)] = 0
    inside = table[data]
    starts = inside.copy()
    starts[1:] &= 1 - inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[firsts] = inside[firsts]
    return starts


def count_words(batches: Iterator[pa.RecordBatch], carried: list[str], out: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [sums_by_row(starts_of_words(data, offsets), offsets) for _, _, data, offsets in spans_of_bytes(batch)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())], names=[*carried, out])


def with_words(docs: DataFrame, *carried: str, out: str = "size") -> DataFrame:
    """The carried columns and `out`, the number of words of the text (null: 0)."""
    given = docs.select(*carried, *([] if "text" in carried else [F.col("text").cast("string").alias("text")]))
    fields = ", ".join(f"`{n}` {t}" for n, t in given.dtypes if n in carried)
    return given.mapInArrow(lambda it: count_words(it, list(carried), out), f"{fields}, `{out}` long")
