"""Conversations, turns and feedback: upserts, imports, the latest rating, and the dashboard's figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casebench.sources.sinks import upserted


def save_turns(turns: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by turn_id; a known turn keeps its question and created_at."""
    return upserted(turns, new, ["turn_id"], keep=("question", "created_at"))


def save_conversations(conversations: DataFrame, new: DataFrame) -> DataFrame:
    return upserted(conversations, new, ["id"], keep=("created_at",))


def violations(conversations: DataFrame, turns: DataFrame, feedback: DataFrame) -> DataFrame:
    """(problem, key): turns without a conversation, feedback without a turn, ratings other than -1 and 1."""
    a = turns.join(conversations.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti").select(F.lit("turn_without_conversation").alias("problem"), F.col("turn_id").alias("key"))
    b = feedback.join(turns.select("turn_id"), "turn_id", "left_anti").select(F.lit("feedback_without_turn").alias("problem"), F.col("turn_id").alias("key"))
    c = feedback.filter("rating IS NULL OR rating NOT IN (-1, 1)").select(F.lit("bad_rating").alias("problem"), F.col("turn_id").alias("key"))
    return a.unionByName(b).unionByName(c)


def without_conversation(conversations: DataFrame, turns: DataFrame, feedback: DataFrame, gone: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A delete that cascades from conversations to turns to feedback."""
    t = turns.filter(~F.col("conversation_id").isin(gone))
    return conversations.filter(~F.col("id").isin(gone)), t, feedback.join(t.select("turn_id"), "turn_id", "left_semi")


def latest_feedback(feedback: DataFrame, key: str = "turn_id", value: str = "rating", at: str = "created_at", tie: str | None = None) -> DataFrame:
    """(key, value): the latest of each key, by partial maxima, without a window."""
    order = F.struct(at, tie) if tie else F.struct(at, value)
    return feedback.groupBy(key).agg(F.max_by(value, order).alias(value))


def history(conversations: DataFrame, turns: DataFrame, feedback: DataFrame) -> DataFrame:
    """Turns with their conversation's title and latest rating; turns of no conversation are dropped; citations parsed."""
    cites = F.from_json("citations", "array<struct<chunk_id:string,num:int,url:string>>")
    c = conversations.select(F.col("id").alias("conversation_id"), "title", "updated_at")
    return turns.withColumn("citations", cites).join(c, "conversation_id").join(latest_feedback(feedback), "turn_id", "left").orderBy(F.col("updated_at").desc(), "conversation_id", "position")


def append_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))


def new_feedback(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's rows that aren't stored and, of equal (turn_id, created_at) within it, one."""
    return batch.dropDuplicates(["turn_id", "created_at"]).join(stored.select("turn_id", "created_at"), ["turn_id", "created_at"], "left_anti")


def drift(imported: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: how many of each, and whether they differ."""
    a, b = imported.agg(F.count(F.lit(1)).alias("imported")), stored.agg(F.count(F.lit(1)).alias("stored"))
    return a.crossJoin(b).withColumn("differ", F.col("imported") != F.col("stored"))


def per_day(df: DataFrame, ts: Column, *by: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day"), *by).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): bin 0 below low, bins + 1 from high on."""
    return df.filter(value.isNotNull()).groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def feedback_ratio(latest: DataFrame, rating: str = "rating") -> DataFrame:
    r = F.col(rating)
    return latest.agg(F.count_if(r > 0).alias("up"), F.count_if(r < 0).alias("down"), F.round(F.count_if(r > 0) / F.nullif(F.count_if(r != 0), F.lit(0)), 6).alias("ratio"))


def turns_per_conversation(turns: DataFrame, conversation: str = "conversation_id") -> DataFrame:
    """(turns, conversations): two levels of counts."""
    n = turns.groupBy(conversation).agg(F.count(F.lit(1)).alias("turns"))
    return n.groupBy("turns").agg(F.count(F.lit(1)).alias("conversations"))


def title_labels(conversations: DataFrame) -> DataFrame:
    """label: the title, numbered by creation where several conversations have it."""
    w = W.partitionBy("title")
    n = F.row_number().over(w.orderBy("created_at", "id"))
    return conversations.withColumn("label", F.when(F.count(F.lit(1)).over(w) > 1, F.concat("title", F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col("title")))


def accessible(cases: DataFrame, public: tuple[str, ...], unlocked: tuple[str, ...], user: str | None) -> DataFrame:
    """Cases (case_id, owner, entries) that a user may see and that hold something, those with entries first."""
    ok = F.col("case_id").isin(*public, *unlocked) if public or unlocked else F.lit(False)
    return cases.filter(ok | (F.col("owner") == F.lit(user))).orderBy((F.col("entries") > 0).desc(), "case_id")


def cases(spark, root: str) -> list[str]:
    """The ids of the cases below a folder of `case_id=...` folders or of folders named by their case, sorted; others aren't cases."""
    import re

    from casebench.schemas import CASE_ID

    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName().removeprefix("case_id=") for s in (fs.listStatus(p) if fs.exists(p) else []) if s.isDirectory()]
    return sorted(n for n in names if re.fullmatch(CASE_ID.strip("^$"), n))
