"""The training-data pipeline: each stage takes what the one before kept, and all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casebench.llm import language, mixing, packing, secrets, simhash
from casebench.llm.common import materialize, with_words

#: A text of at least so many code points whose best language has a smaller share of its n-grams is in no known language.
LEAST_SHARE, LONG_ENOUGH = 0.2, 40


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or long ones in no learned language, go; a null lang is filled in.

    Where no document has a language to learn from, only those without a letter go.
    """
    filters = language.learned(docs.select("doc_id", "text", "lang"))
    if not filters.languages:
        return docs.filter(F.rlike(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"\p{L}")))
    carried = [c for c in docs.columns if c != "doc_id"]
    found = language.identify_languages(docs.select("doc_id", *carried), filters, *carried)
    bad = (F.col("lang_pred") == language.UND) | ((F.col("score") < LEAST_SHARE) & (F.length("text") >= LONG_ENOUGH))
    return found.filter(~bad).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group of similarity 0.8 or more over 5-word shingles stays."""
    return simhash.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: every span becomes [SECRET] and n_chars follows; all documents stay."""
    given = docs.withColumn("__row", F.struct(*docs.columns))
    ratios = secrets.fit(secrets.samples(spark))
    found = secrets.scan(given, ratios, carried=("__row",))
    fields = {c: F.col(f"__row.{c}") for c in docs.columns}
    clean = secrets.redacted(F.col("hidden"))
    fields["text"] = F.when(F.col("__row.text").isNotNull(), clean).alias("text")
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.size("spans") > 0, F.length(clean).cast("long")).otherwise(F.col("__row.n_chars")).alias("n_chars")
    return found.select(*[c.alias(name) for name, c in fields.items()])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: a document stands as often as the mix takes it, 0 to 2 times.

    Rows that share doc_id and size get the largest number of copies among them. Columns must not be named __words, __id,
    __size, __copies or __copy.
    """
    sized = materialize(with_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"), "doc_id", "source"), "sources")
    taken = mixing.mixed(sized).filter("copies > 0").groupBy(F.col("doc_id").alias("__id"), F.col("size").alias("__size")).agg(F.max("copies").alias("__copies"))
    own = with_words(docs, *docs.columns, out="__words")
    # the decisions grow with the documents: a merge join at every size
    both = own.join(taken.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__words") == F.col("__size")))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the length bucket and batch of every row."""
    return packing.pack_documents(docs).withColumnRenamed("size", "n_words")


STAGES = [
    ("language_id", languages),
    ("simhash_near_dedup", near_copies),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix),
    ("length_packing", pack),
]

#: Models and draws that SQL can't express; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
