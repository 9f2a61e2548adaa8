"""A collection of embedded chunks in which a case can be replaced without touching the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casebench.models import ModelProvider, embedded
from casebench.sources.sinks import _fs

STATUTES = "statutes"
FIELDS = ("chunk_id", "text", "source", "source_label", "num", "titre", "section_path", "url")


class VectorCollection:
    """Rows chunk_id, embedding, text and metadata, a folder for each case and one for the statutes.

    Adding cases overwrites the folders of those cases alone (dynamic partition overwrite), so it may be repeated, costs what the
    cases hold, and never reads the rest. A case is told by its id, not by a prefix of chunk ids: case `a` isn't part of `a-b`.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _write(self, chunks: DataFrame, provider: ModelProvider | None, mode: str) -> None:
        own = F.col("case_id").eqNullSafe(F.lit(STATUTES)) | F.coalesce(F.col("chunk_id").startswith(F.concat(F.lit("dossier-"), "case_id", F.lit("-"))), F.lit(False))
        # ids alone are read for the check, before a folder is replaced
        wrong = chunks.groupBy("case_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("chunk_id").isNull() | F.col("case_id").isNull() | ~own).limit(20).collect()
        if wrong:
            raise ValueError(f"ids null, twice or of another case: {[(r.case_id, r.chunk_id) for r in wrong]}")
        given = chunks if "embedding" in chunks.columns else embedded(chunks, "text", provider)
        fields = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in chunks.columns else F.lit("").alias(c) for c in FIELDS]
        out = given.select(*fields, F.col("embedding").cast("array<float>").alias("embedding"), "case_id")
        # a case's rows side by side in its folder, a large case in several files
        out.repartition("case_id", F.pmod(F.xxhash64("chunk_id"), F.lit(16))).write.partitionBy("case_id").mode("overwrite").option("partitionOverwriteMode", mode).parquet(self.root)

    def rebuild(self, chunks: DataFrame, provider: ModelProvider | None = None) -> None:
        """All of it anew: chunks (chunk_id, text, metadata, case_id; null: a statute), with an embedding or a provider for it."""
        self._write(chunks.withColumn("case_id", F.coalesce("case_id", F.lit(STATUTES))), provider, "static")

    def add_cases(self, chunks: DataFrame, cases: list[str] | None = None, provider: ModelProvider | None = None) -> None:
        """Replace the cases that chunks hold; of `cases`, those without chunks become empty. Statutes are never touched."""
        self._write(chunks.withColumn("case_id", F.nullif("case_id", F.lit(STATUTES))), provider, "dynamic")
        if cases:
            left = {r.case_id for r in chunks.filter(F.col("case_id").isin(*cases)).select("case_id").distinct().collect()}
            for case in {*cases} - left - {STATUTES}:
                fs, p = _fs(self.spark, f"{self.root}/case_id={case}")
                fs.delete(p, True)

    def read(self, *cases: str) -> DataFrame:
        """All rows, or those of cases: other folders aren't read."""
        rows = self.spark.read.option("basePath", self.root).schema(f"chunk_id string, {', '.join(f'{c} string' for c in FIELDS if c != 'chunk_id')}, embedding array<float>, case_id string").parquet(self.root)
        return rows.filter(F.col("case_id").isin(*cases)) if cases else rows
