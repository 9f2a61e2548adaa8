"""Measuring retrieval and judges: hit rate, reciprocal rank, paired outcomes, agreement, sampling, stopping rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

UNKNOWN = "UNKNOWN"


def gold_ranks(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, rank): where the gold chunk stands among the hits (from 0), null if it doesn't."""
    best = hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    return gold.join(best, ["query_id", "chunk_id"], "left").select(*[c for c in gold.columns if c != "chunk_id"], "rank")


def hit_rate_mrr(ranks: DataFrame, by: list[str] | None = None, k: int | None = None) -> DataFrame:
    found = F.col("rank").isNotNull() & (F.lit(True) if k is None else F.col("rank") < k)
    return ranks.groupBy(*(by or [])).agg(F.round(F.avg(found.cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.when(found, 1 / (F.col("rank") + 1)).otherwise(0.0)), 6).alias("mrr"), F.count(F.lit(1)).alias("n"))


def paired(ranks: DataFrame, a: str, b: str) -> DataFrame:
    """Of two configs' per-query ranks (config, query_id, rank): queries that both, only a, only b, or neither found."""
    wide = ranks.filter(F.col("config").isin(a, b)).groupBy("query_id").agg(*[F.bool_or((F.col("config") == c) & F.col("rank").isNotNull()).alias(n) for c, n in ((a, "x"), (b, "y"))])
    x, y = F.col("x"), F.col("y")
    return wide.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def distribution(verdicts: DataFrame) -> DataFrame:
    """(judge, verdict, n, share of the judge's)."""
    n = verdicts.groupBy("judge", "verdict").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("judge")), 3))


def complete_queries(verdicts: DataFrame, judges: int = 3) -> DataFrame:
    return verdicts.groupBy("query_id").agg(F.count_distinct("judge").alias("judges")).filter(F.col("judges") == judges).select("query_id")


def wide(verdicts: DataFrame, judges: list[str]) -> DataFrame:
    """A row a query, a column a judge; UNKNOWN is null."""
    return verdicts.groupBy("query_id").agg(*[F.max(F.when((F.col("judge") == j) & (F.col("verdict") != UNKNOWN), F.col("verdict"))).alias(j) for j in judges])


def agreement(table: DataFrame, judges: list[str]) -> DataFrame:
    """(judge_a, judge_b, n, agree) of each pair, over queries that both judged; all pairs in one pass."""
    pairs = [(a, b) for i, a in enumerate(judges) for b in judges[i + 1 :]]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("judge_a"), F.lit(b).alias("judge_b"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs])).alias("p")
    return table.select(each).select("p.*").filter("a IS NOT NULL AND b IS NOT NULL").groupBy("judge_a", "judge_b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("agree"))


def all_agree_rate(table: DataFrame, judges: list[str]) -> DataFrame:
    full = table.dropna(subset=judges)
    same = F.lit(True)
    for j in judges[1:]:
        same = same & (F.col(j) == F.col(judges[0]))
    return full.agg(F.round(F.avg(same.cast("double")), 6).alias("all_agree"), F.count(F.lit(1)).alias("n"))


def majority(verdicts: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, majority): the label with `least` votes or more, ALL_UNKNOWN without a valid one, else SPLIT."""
    valid = verdicts.withColumn("label", F.nullif("verdict", F.lit(UNKNOWN)))
    votes = valid.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("label").isNotNull()
    return votes.groupBy("query_id").agg(F.max(F.when(known, F.struct("n", "label"))).alias("top")).select("query_id", F.when(F.col("top").isNull(), "ALL_UNKNOWN").when(F.col("top.n") >= least, F.col("top.label")).otherwise("SPLIT").alias("majority"))


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest salted hash of the key: samples of one seed are nested, on any engine and partitioning."""
    h = F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")), 256)
    return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")


def head_split(df: DataFrame, order: list[str], n: int, by: list[str] | None = None) -> DataFrame:
    """df with `part`: validation for the first n rows of each group by order, else test. order makes rows unique."""
    first = df.select(*(by or []), *order).withColumn("__n", F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy(*order))).filter(F.col("__n") <= n)
    keys = list(dict.fromkeys([*(by or []), *order]))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = df.join(first.select(*[F.col(k).alias(f"__{k}") for k in keys], F.lit("validation").alias("part")), on, "left")
    return both.select(*df.columns, F.coalesce("part", F.lit("test")).alias("part"))


def running_stop(log: DataFrame, order: str, ceiling: float, failed: Column | None = None, rate: float = 0.1, least: int = 10, by: list[str] | None = None) -> DataFrame:
    """log (order, cost_usd) with running cost and failures, and whether a brake was on: cost over the ceiling, or over `rate` failed after `least`.

    One running window a group in `by`; without groups it is one sequence, as a brake on one job is.
    """
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    bad = failed.cast("int") if failed is not None else F.lit(0)
    out = log.withColumns({"seq": F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy(order)), "spent": F.round(F.sum(F.coalesce(F.col("cost_usd"), F.lit(0.0))).over(w), 6), "failures": F.sum(bad).over(w)})
    return out.withColumn("stopped", (F.col("spent") > ceiling) | ((F.col("seq") >= least) & (F.col("failures") > rate * F.col("seq"))))


def coerced_sum(c: Column) -> Column:
    return F.sum(F.coalesce(c.try_cast("double"), F.lit(0.0)))


def best(table: DataFrame, metric: str, name: str) -> DataFrame:
    """The row with the largest metric; ties to the smaller name."""
    return table.orderBy(F.col(metric).desc(), name).limit(1)


def boost_trials(spark, fields: list[str], n: int = 20, seed: int = 42, low: float = 0.0, high: float = 3.0) -> DataFrame:
    """(trial, one column a field): n random boosts, from hashes of (seed, trial, field), so they are the same everywhere."""
    draw = lambda f: F.round(low + (high - low) * F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(f)), F.lit(1_000_003)) / 1_000_003.0, 6)
    return spark.range(n).select(F.col("id").alias("trial"), *[draw(f).alias(f) for f in fields])
