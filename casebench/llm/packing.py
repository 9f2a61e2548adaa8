"""Packing into optimal length buckets.

Padding is what a batch spends on filling its texts up to the bucket's length. A dynamic program over the histogram of
all lengths chooses the boundaries that minimise the corpus's padding, and batches of a fixed token budget form in each
bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casebench.llm.common import materialize, numbered, with_words

BUCKETS, BUDGET = 16, 65_536


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most `buckets` buckets with the least padding; the last is the largest length. lengths: ascending.

    cost[k, j] = min over i < j of cost[k-1, i] + lengths[j] * (rows in (i, j]); the tokens themselves are the same in any
    choice. For a fixed k the options are lines in lengths[j] whose slopes fall with i, so the lower hull of the lines
    answers all j in one walk: time and memory grow with the number of different lengths. All in whole numbers.
    """
    if not lengths:
        return []
    n = len(lengths)
    before = [0]
    for c in counts:
        before.append(before[-1] + int(c))
    cost: list[int | None] = [0] + [None] * n
    choice: list[list[int]] = []
    for _ in range(min(buckets, n)):
        new: list[int | None] = [0] + [None] * n
        pick = [0] * (n + 1)
        hull: list[int] = []
        at = 0
        for j in range(1, n + 1):
            i, base = j - 1, cost[j - 1]
            if base is not None:
                while len(hull) > 1:
                    a, b = hull[-2], hull[-1]
                    # b is never least if a and i cross before a and b do
                    if (base - cost[a]) * (before[b] - before[a]) <= (cost[b] - cost[a]) * (before[i] - before[a]):
                        hull.pop()
                    else:
                        break
                hull.append(i)
                at = min(at, len(hull) - 1)
            x = int(lengths[j - 1])
            while at + 1 < len(hull) and cost[hull[at + 1]] - x * before[hull[at + 1]] <= cost[hull[at]] - x * before[hull[at]]:
                at += 1
            pick[j] = hull[at]
            new[j] = cost[hull[at]] + x * (before[j] - before[hull[at]])
        cost = new
        choice.append(pick)
    ends, j = [], n
    for pick in reversed(choice):
        if j:
            ends.append(lengths[j - 1])
            j = pick[j]
    return ends[::-1]


def packed(sized: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """sized (doc_id, size, more) with bucket, bucket_length, batch, position and padding; sized is read several times.

    A batch holds budget // bucket_length rows, one at least: a text longer than the budget is a batch of its own. Rows of
    length 0 go to the first bucket. bucket_length is the length of the bucket's longest row. Rows are dealt to batches by a
    hash of doc_id and length; null doc_ids and repeated rows are packed like others, texts of any length whole. The
    histogram, a row for each different length, is all that the driver gets: at most as many as the longest text has words.
    Columns named bucket, bucket_length, batch, position or padding are replaced; names that begin with __ are taken.
    """
    hist = sorted((r["size"], r["n"]) for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect())
    ends = boundaries([x for x, _ in hist], [n for _, n in hist], buckets)
    at = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e < F.col("size"))) if ends else F.lit(0)
    length = F.element_at(F.array(*[F.lit(max(e, 1)).cast("long") for e in ends or [1]]), F.col("bucket") + 1)
    of = sized.withColumn("bucket", at.cast("int")).withColumn("bucket_length", length).withColumn("__key", F.xxhash64("doc_id", "size"))
    # windows of about a quarter of a million rows, however many a bucket has
    shards = max(256, sum(n for _, n in hist) // 250_000)
    slots = numbered(of, ["bucket"], ["__key", "doc_id", "size"], "__slot", shards=shards, key="__key")
    many = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length"))).cast("long")
    return slots.withColumns({"batch": F.floor(F.col("__slot") / many).cast("long"), "position": (F.col("__slot") % many).cast("int"), "padding": F.col("bucket_length") - F.col("size")}).drop("__slot", "__key")


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Every document's length in words, bucket and batch; a null text has length 0, an empty table gives an empty one."""
    return packed(materialize(with_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), "lengths"), buckets, budget)


def op6_length_buckets(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("size", "n_words")
