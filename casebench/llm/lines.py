"""Line dedup over levelled sorted runs of line hashes.

A run is a table sorted by key hash: for each key the number of documents that hold it and the largest of their ids. A new
batch of documents is merge-anti-joined with the runs, so that keys about which they already say all aren't added again;
the rest becomes a run of level 0. When a level has FAN runs they are compacted to one of the next level. A key's lines go
from every document but the largest, once enough documents hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from casebench.llm.common import materialize, release

#: Key length in code points and number of documents from which a key counts as boilerplate.
LEAST_LENGTH, LEAST_DOCS = 20, 3
#: Runs of a level that are compacted; batches of a whole table.
FAN, BATCHES = 3, 6
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Smaller than any doc_id but the smallest there is: what a null one counts as.
NO_ID = -(1 << 63)


def keys_of(text: F.Column) -> F.Column:
    """16-byte hashes of a text's different keys of at least LEAST_LENGTH code points."""
    lines = F.split(F.translate(text, UPPER, LOWER), "\n", -1)
    keys = F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE))), lambda x: F.length(x) >= LEAST_LENGTH)
    return F.transform(F.array_distinct(keys), lambda x: F.unhex(F.substring(F.sha2(x, 256), 1, 32)))


def holding(docs: DataFrame) -> DataFrame:
    """key, doc_id and part for each document and different key; part, a hash of the text, deals out rows that share doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("part"), text.alias("text"))
    return own.select(F.explode(keys_of(F.col("text"))).alias("key"), "doc_id", "part")


class LineRuns:
    """The runs of all batches so far, newest last: (level, table)."""

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.runs: list[tuple[int, DataFrame]] = []

    @staticmethod
    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def written(self, rows: DataFrame, level: int) -> tuple[int, DataFrame]:
        return level, materialize(rows.sortWithinPartitions("key"), f"run{level}")

    def known(self) -> DataFrame | None:
        """key, docs and last over all runs."""
        if not self.runs:
            return None
        both = self.runs[0][1]
        for _, run in self.runs[1:]:
            both = both.unionByName(run)
        return self.summed(both)

    def add(self, pairs: DataFrame) -> None:
        """A batch (key, doc_id). A document's rows must all be in one batch; a repeated row or doc_id counts once."""
        own = self.summed(pairs.select("key", "doc_id").distinct().select("key", F.lit(1).cast("long").alias("docs"), F.col("doc_id").alias("last")))
        if self.runs:
            # settled keys, held often enough and by a larger document, need no further row
            known = self.known().filter(F.col("docs") >= LEAST_DOCS).select(F.col("key").alias("__key"), F.col("last").alias("__last")).hint("merge")
            own = own.join(known, (F.col("key") == F.col("__key")) & (F.col("last") < F.col("__last")), "left_anti")
        self.runs.append(self.written(own, 0))
        self.compact()

    def compact(self) -> None:
        """While the newest runs are `fan` of one level, they become one of the next; nothing is dropped."""
        while len(self.runs) >= self.fan and len({level for level, _ in self.runs[-self.fan :]}) == 1:
            old = self.runs[-self.fan :]
            both = old[0][1]
            for _, run in old[1:]:
                both = both.unionByName(run)
            self.runs[-self.fan :] = [self.written(self.summed(both), old[0][0] + 1)]
            for _, run in old:
                release(run)

    def dropped(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose lines go: their key is held by LEAST_DOCS documents and by a larger one than theirs."""
        known = self.known()
        if known is None:
            return pairs.limit(0)
        # written first, so that the join has plain shuffles on both sides and a key with a third of all rows can be split
        common = materialize(known.filter(F.col("docs") >= LEAST_DOCS).select(F.col("key").alias("__key"), F.col("last").alias("__last")), "common")
        return pairs.join(common.hint("merge"), (F.col("key") == F.col("__key")) & (F.col("doc_id") < F.col("__last"))).select(*pairs.columns)


def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_lines, n_dropped, kept and kept_sha256 of text and the hashes of the keys that go (null: none)."""
    fields = ("n_lines", "n_dropped", "kept", "kept_sha256")
    for batch in batches:
        out: dict[str, list] = {f: [] for f in fields}
        for text, gone in zip(batch.column("text"), batch.column("gone"), strict=True):
            data = text.as_py() or ""
            lines = data.split("\n")
            n = len(lines)
            if gone.is_valid:
                hashes = set(gone.as_py())
                lines = [x for x in lines if len(x) < LEAST_LENGTH or hash_of(x) not in hashes]
                data = "\n".join(lines)
            for f, v in zip(fields, (n, n - len(lines), data, hashlib.sha256(data.encode()).hexdigest()), strict=True):
                out[f].append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out["n_lines"], pa.int64()), pa.array(out["n_dropped"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["kept_sha256"], pa.string())], names=["doc_id", *fields])


def hash_of(line: str) -> bytes:
    return hashlib.sha256(line.encode().lower().strip(SPACE.encode())).digest()[:16]


def without_common_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without the lines that go) and kept_sha256 of every row of docs.

    A null or empty text is one empty line. Rows that share a doc_id are one document: a key counts once, and a key's lines
    stay in all of them if the document is its largest; rows with a null doc_id are one document, smaller than any other.
    Keys are told by 16 bytes of their SHA-256. A text all of whose lines go leaves an empty one. Other columns are ignored;
    an empty table gives an empty one. The keys of the table are written once, by batch; each batch reads its own.
    """
    spark = docs.sparkSession
    of = F.pmod(F.xxhash64(F.lit("batch"), F.col("doc_id")), F.lit(batches)).cast("int")
    pairs = materialize(holding(docs).withColumn("batch", of), "holding", "batch")
    runs = LineRuns(spark)
    for b in range(batches):
        runs.add(pairs.filter(F.col("batch") == b))
    gone = runs.dropped(pairs.select("key", "doc_id", "part")).groupBy("doc_id", "part").agg(F.collect_set("key").alias("gone"))
    gone = materialize(gone.select(F.col("doc_id").alias("__id"), F.col("part").alias("__part"), "gone"), "gone")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    both = own.join(gone, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("__id")) & (F.xxhash64("text") == F.col("__part")), "left")
    return both.select("doc_id", "text", "gone").mapInArrow(cleaned, "doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string")


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    return without_common_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


ORACLE = r"""
WITH lines AS (
    SELECT d.rowid_ AS r, coalesce(d.doc_id, -9223372036854775808) AS doc, l.pos, l.line,
           translate(trim(l.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts, row_number() OVER () AS rowid_ FROM documents) d,
         LATERAL (SELECT unnest(d.parts) AS line, generate_subscripts(d.parts, 1) AS pos) l),
common AS (SELECT key, max(doc) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc) >= 3)
SELECT nullif(l.doc, -9223372036854775808) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.key = c.key AND l.doc < c.last
GROUP BY l.r, l.doc
"""
