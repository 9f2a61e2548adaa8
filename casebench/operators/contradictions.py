"""Pairs of facts that can't both hold: same amount, count or instrument with other dates or roles; opposite actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from casebench.functions import lexicon, scalars

CAP = 40


def buckets(facts: DataFrame) -> DataFrame:
    """(bucket, key, fact_id, day, role): facts by amount and party count in their folded quote, and by document."""
    quote = lexicon.fold(F.col("verbatim_quote"))
    base = facts.select("fact_id", scalars.iso_date(F.col("date")).alias("day"), F.col("actor_role").alias("role"), "source_doc_id", quote.alias("quote"))
    made = F.concat(
        F.transform(lexicon.amounts(F.col("quote")), lambda x: F.struct(F.lit("montant").alias("bucket"), x.cast("string").alias("key"))),
        F.transform(lexicon.party_counts(F.col("quote")), lambda x: F.struct(F.lit("denombrement").alias("bucket"), x["noun"].alias("key"))),
        F.array(F.struct(F.lit("date_instrument").alias("bucket"), F.col("source_doc_id").alias("key"))))
    return base.select("fact_id", "day", "role", F.explode(made).alias("b")).select("b.bucket", "b.key", "fact_id", "day", "role").distinct()


def collisions(bucketed: DataFrame, largest: int | None = None) -> DataFrame:
    """(bucket, key, a, b) of a < b in one bucket whose known dates or whose roles differ.

    A self-join on (bucket, key); adaptive execution splits a skewed key. `largest` leaves out buckets with more members,
    whose number is the answer of oversized().
    """
    if largest is not None:
        bucketed = bucketed.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("bucket", "key"))).filter(F.col("__n") <= largest).drop("__n")
    a, b = bucketed.alias("a"), bucketed.alias("b")
    differ = (F.col("a.day").isNotNull() & F.col("b.day").isNotNull() & (F.col("a.day") != F.col("b.day"))) | (F.col("a.role") != F.col("b.role"))
    return a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fact_id") < F.col("b.fact_id")) & differ).select("a.bucket", "a.key", F.col("a.fact_id").alias("a"), F.col("b.fact_id").alias("b"))


def oversized(bucketed: DataFrame, largest: int) -> DataFrame:
    return bucketed.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > largest)


def opposites(facts: DataFrame) -> DataFrame:
    """(bucket, key, a, b): one role and target with actions of opposite sign on one axis."""
    f = facts.select("fact_id", "actor_role", lexicon.fold(F.col("target")).alias("target"), lexicon.polarity(lexicon.fold(F.col("action"))).alias("p")).filter("p IS NOT NULL").select("fact_id", "actor_role", "target", "p.axis", "p.sign")
    up, down = f.filter("sign = 1").drop("sign"), f.filter("sign = -1").drop("sign").withColumnRenamed("fact_id", "other")
    return up.join(down, ["actor_role", "target", "axis"]).select(F.lit("sens_action").alias("bucket"), F.concat_ws("|", "actor_role", "target", "axis").alias("key"), F.least("fact_id", "other").alias("a"), F.greatest("fact_id", "other").alias("b")).distinct()


def candidates(facts: DataFrame, cap: int = CAP) -> tuple[DataFrame, bool]:
    """(the first `cap` pairs in total order, whether that is all of them). The cap is after the sort, so a larger one only adds."""
    pairs = collisions(buckets(facts)).unionByName(opposites(facts)).orderBy("bucket", "key", "a", "b")
    head = pairs.limit(cap + 1).withColumn("__n", F.row_number().over(W.orderBy("bucket", "key", "a", "b")))  # cap + 1 rows
    return head.filter(F.col("__n") <= cap).drop("__n"), head.count() <= cap


def judged(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs with tier and confidence: compatible ones go, adjudicated ones are T4 and medium, the rest T5 and low."""
    j = pairs.join(verdicts.select("a", "b", "label"), ["a", "b"], "left").filter("label IS NULL OR label <> 'compatible'")
    return j.withColumns({"tier": F.when(F.col("label").isNull(), "T5").otherwise("T4"), "confidence": F.when(F.col("label").isNull(), "low").otherwise("medium")})
