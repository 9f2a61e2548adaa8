"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows of each partition a uniform shuffle would send to each shard follows a multivariate hypergeometric law.
The matrix of those counts is drawn first, row by row, so its margins are exact: partitions keep their rows, shards get
sizes at most one apart. Each partition then permutes its rows and cuts them by its line of the matrix, the shards are
exchanged, and each permutes again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from casebench.llm.common import materialize, numbered

SHARDS, SEED = 40, 20_240
#: Rows of a logical partition, on average; and groups of partitions, whose lines of the matrix the driver draws.
ROWS_A_PART, GROUPS = 250_000, 1024


def drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric draw, by inversion where a population is beyond the generator's range of 10**9: the law is the same.

    The chances go from one count to the next by an exact ratio; those 40 deviations off the mode are below any double.
    """
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    least, most = max(0, n - bad), min(n, good)
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), least), most)
    wide = 50 + int(40 * (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5)
    lo, hi = max(least, mode - wide), min(most, mode + wide)
    x = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1)
    chance = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(chance - chance.max()))
    return lo + int(np.searchsorted(chance, rng.random() * chance[-1], side="right"))


def matrix(sizes: list[int], shards: list[int], rng: np.random.Generator) -> np.ndarray:
    """counts[partition, shard] of a uniform shuffle: lines sum to the partitions' sizes, columns to the shards'."""
    left = np.array(shards, np.int64)
    out = np.zeros((len(sizes), len(left)), np.int64)
    for p, size in enumerate(sizes):
        rest, todo = int(left.sum()), int(size)
        for k in range(len(left)):
            rest -= int(left[k])
            out[p, k] = drawn(rng, int(left[k]), rest, todo) if todo else 0
            todo -= int(out[p, k])
        left -= out[p]
    return out


def even(n: int, shards: int, rng: np.random.Generator) -> list[int]:
    """Shard sizes at most one apart; which ones are larger is drawn."""
    left = np.full(shards, n // shards, np.int64)
    left[rng.permutation(shards)[: n % shards]] += 1
    return left.tolist()


def lines(counts: DataFrame, shards: int, seed: int, groups: int) -> DataFrame:
    """(__p, __ends) of counts (__part, n): up to which rank a partition's rows go to each shard.

    Drawn in two steps, which gives the same law: the driver draws how many rows of each group of partitions go to each
    shard, `groups` lines whatever the table; each group then draws its partitions' lines where it lies.
    """
    grouped = counts.withColumn("__group", F.col("__part") % groups)
    sizes = {r["__group"]: r["n"] for r in grouped.groupBy("__group").agg(F.sum("n").alias("n")).collect()}
    rng = np.random.default_rng(seed)
    top = matrix([sizes.get(g, 0) for g in range(groups)], even(sum(sizes.values()), shards, rng), rng)
    table = counts.sparkSession.createDataFrame([(g, line) for g, line in enumerate(top.tolist())], "__g int, __line array<long>")

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__part")
        own = np.random.default_rng([seed, int(pdf["__group"].iloc[0]) + 1])
        ends = np.cumsum(matrix(pdf["n"].tolist(), list(pdf["__line"].iloc[0]), own), axis=1)
        return pd.DataFrame({"__p": pdf["__part"].to_numpy(), "__ends": ends.tolist()})

    joined = grouped.join(F.broadcast(table), F.col("__group") == F.col("__g")).select("__group", "__part", "n", "__line")
    return joined.groupBy("__group").applyInPandas(of_group, "__p long, __ends array<long>")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16) and text_crc32; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def shuffled(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, key: tuple[str, ...] = ("doc_id", "text_crc32")) -> DataFrame:
    """rows with shard and slot (gapless from 0 in each shard); rows is read several times, so it should be a written table.

    Partitions are logical: a hash of the key, not of where a row lies, so reruns and lost executors change nothing. Rows
    with one key are alike and may swap places; a key with a third of all rows makes its partition as large. Null keys are
    hashed like others. An empty table gives an empty one.
    """
    n = rows.count()
    parts = max(16, n // ROWS_A_PART)
    rows = rows.withColumns({"__part": F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(parts)), "__r1": F.xxhash64(F.lit(seed + 1), *key), "__r2": F.xxhash64(F.lit(seed + 2), *key)})
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    # written: a plain shuffle joins it where it is too large to be sent
    ends = materialize(lines(counts, shards, seed, min(parts, GROUPS)), "lines")
    ranked = rows.withColumn("__rank", F.row_number().over(W.partitionBy("__part").orderBy("__r1", *key)) - 1)
    dealt = ranked.join(ends, F.col("__part") == F.col("__p")).withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))))
    sent = materialize(dealt.drop("__part", "__p", "__ends", "__rank", "__r1"), "sharded")
    return numbered(sent, ["shard"], ["__r2", *key], "slot", shards=max(8, parts // shards), key="__r2").drop("__r2")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The shard and slot of every document, with its size and checksum. Only these short rows are shuffled, never texts."""
    return shuffled(materialize(sized(docs), "sizes"), shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Write whole documents to path/shard=N, each shard sorted by slot, and return where each went."""
    where = shard_documents(docs, shards, seed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    both = docs.withColumns({"__crc": F.crc32(text.cast("binary")), "__id": F.col("doc_id").cast("long")})
    both = both.withColumn("__copy", F.row_number().over(W.partitionBy("__id", "__crc").orderBy(F.lit(1))))
    keyed = where.withColumn("__copy", F.row_number().over(W.partitionBy("doc_id", "text_crc32").orderBy("shard", "slot"))).select(F.col("doc_id").alias("__i"), F.col("text_crc32").alias("__c"), "__copy", F.col("shard"), F.col("slot"))
    joined = both.join(keyed.withColumnRenamed("__copy", "__k"), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__crc") == F.col("__c")) & (F.col("__copy") == F.col("__k"))).drop("__id", "__crc", "__copy", "__i", "__c", "__k")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return where


def op7_shard_shuffle(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
