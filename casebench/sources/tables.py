"""A case's tables in the catalogue, bucketed by fact, so that facts, edges and coverage join where they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Table: its columns, and what it is bucketed and sorted by.
DDL = {
    "facts": ("fact_id string, case_id string, role_id string, action string, event_date string, source_doc_id string", "fact_id"),
    "edges": ("fact_id string, person_id string, role_id string", "fact_id"),
    "roles": ("role_id string, case_id string, label string", "role_id"),
    "coverage": ("fact_id string, doc_id string, status string", "fact_id"),
}
BUCKETS = 64


class CaseTables:
    """facts, edges, roles and coverage below a folder, in a database of the catalogue.

    create() may be called at every start: what is there stays. put() replaces a table's rows. The buckets are the index: a join
    or a look-up by fact_id reads buckets side by side, without a shuffle. All tables have the same number of buckets.
    """

    def __init__(self, spark: SparkSession, database: str, root: str, buckets: int = BUCKETS):
        self.spark, self.database, self.root, self.buckets = spark, database, root.rstrip("/"), buckets

    def create(self) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}`")
        for name, (columns, key) in DDL.items():
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS `{self.database}`.`{name}` ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'")

    def put(self, name: str, rows: DataFrame) -> None:
        """Replace a table by rows; columns by name, missing ones null, others left out."""
        schema, key = self.spark.table(f"`{self.database}`.`{name}`").schema, DDL[name][1]
        out = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        # one file a bucket, however many tasks there are: rows are dealt out by the bucket that Spark will put them in
        bucket = F.pmod(F.hash(key), F.lit(self.buckets))
        out.repartition(self.buckets, bucket).write.insertInto(f"`{self.database}`.`{name}`", overwrite=True)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"`{self.database}`.`{name}`")

    def graph(self) -> DataFrame:
        """Facts with the persons that hold them and their documents' coverage: a row for each fact and edge, dangling edges left out."""
        edges = self.table("edges").select("fact_id", "person_id", F.col("role_id").alias("person_role"))
        covered = self.table("coverage").select("fact_id", F.col("doc_id").alias("covered_doc"), "status")
        return self.table("facts").join(edges.hint("merge"), "fact_id", "left").join(covered.hint("merge"), "fact_id", "left")

    def health(self) -> DataFrame:
        """One row: facts, edges, dangling edges, facts without coverage, roles of facts that the catalogue lacks."""
        facts, edges = self.table("facts"), self.table("edges")
        dangling = edges.join(facts.select("fact_id").hint("merge"), "fact_id", "left_anti").agg(F.count(F.lit(1)).alias("dangling"))
        bare = facts.join(self.table("coverage").select("fact_id").hint("merge"), "fact_id", "left_anti").agg(F.count(F.lit(1)).alias("uncovered"))
        strange = facts.select("role_id").filter("role_id IS NOT NULL").distinct().join(self.table("roles").select("role_id"), "role_id", "left_anti").agg(F.count(F.lit(1)).alias("uncatalogued"))
        counts = facts.agg(F.count(F.lit(1)).alias("facts")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each
        return counts.crossJoin(dangling).crossJoin(bare).crossJoin(strange)

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS `{self.database}` CASCADE")
