"""Scoped hybrid retrieval: BM25, exact vector search, weighted reciprocal-rank fusion, reranking, prompts, reconciliation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casebench.models import ModelProvider, scored
from casebench.schemas import CASE_ID

# Fixed values.
RRF_K, WEIGHTS = 60, (0.3, 1.0)
RETRIEVE_K, RERANK_K, SCOPED_FETCH = 20, 5, 200
BOOSTS = {"texte": 1.0, "titre": 1.0, "section_path": 1.0, "num": 1.0}
K1, B = 1.2, 0.75
HIT_FIELDS = "chunk_id source source_label num section_path titre texte url".split()


def scope_sources(scope: str, statute: list[str]) -> tuple[str, ...] | None:
    """The sources that a scope allows; None: no limit. An unknown scope, or an empty or malformed case id, raises."""
    kind, _, case = scope.partition(":")
    if scope == "statute":
        return tuple(statute)
    if kind in ("case", "case+statute"):
        if not re.match(CASE_ID, case):
            raise ValueError(f"bad case id in scope {scope!r}")
        return (f"dossier-{case}", *(statute if kind == "case+statute" else ()))
    if scope in ("dossier", "blended"):
        return None
    raise ValueError(f"unknown scope {scope!r}")


def scope_filter(scope: str, statute: list[str], source: str = "source") -> Column:
    """A predicate on the source column, pushed to the scan: an allowlist, never a denylist."""
    allowed = scope_sources(scope, statute)
    if allowed is not None:
        return F.col(source).isin(*allowed)
    return F.col(source).startswith("dossier-") if scope == "dossier" else F.lit(True)


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"(?U)[^\w]+"), lambda t: t != "")


def postings(chunks: DataFrame, fields: list[str], key: str = "chunk_id", wanted: DataFrame | None = None) -> DataFrame:
    """(field, term, key, tf, length) of each field's words, or of the wanted ones (term) only, which are dropped before anything
    is shuffled; one pass, then one shuffle by (field, term, key) with partial sums.
    """
    packed = F.array(*[F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("words")) for f in fields])
    each = chunks.select(key, F.explode(packed).alias("p")).select(key, "p.field", "p.words", F.size("p.words").alias("length"))
    words = each.select(key, "field", "length", F.explode("words").alias("term"))
    words = words if wanted is None else words.join(wanted, "term", "left_semi")
    return words.groupBy("field", "term", key, "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(chunks: DataFrame, queries: DataFrame, n: int, boosts: dict[str, float] | None = None, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, rank from 0) of the n best chunks of each query (query_id, query), by Okapi BM25 summed over boosted fields.

    Only the postings of words in queries are shuffled: a semi-join drops all others right where texts are split.
    Ties go to the smaller key.
    """
    boosts = boosts or BOOSTS
    fields = [f for f, b in boosts.items() if b and f in chunks.columns]
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    sizes = chunks.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(terms(F.col(f))).alias("length")) for f in fields])).alias("p")).groupBy("p.field").agg(F.count(F.lit(1)).alias("docs"), F.avg("p.length").alias("mean"))
    known = asked.select("term").distinct()
    known = F.broadcast(known) if known.count() <= 100_000 else known
    wanted = postings(chunks, fields, key, known)
    df = wanted.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    weighed = wanted.join(df, ["field", "term"]).join(F.broadcast(sizes), "field")  # sizes: a row a field
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.greatest(F.col("mean"), F.lit(1e-9))))
    boost = F.create_map(*[F.lit(x) for f in fields for x in (f, float(boosts[f]))])[F.col("field")]
    scores = weighed.withColumn("part", part * boost).join(asked, "term").groupBy("query_id", key).agg(F.round(F.sum("part"), 9).alias("score"))
    return ranked(scores, n, key)


def ranked(scores: DataFrame, n: int, key: str = "chunk_id") -> DataFrame:
    """The n best of each query with their rank from 0; the window's group limit keeps n a task before the shuffle."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < n)


#: Queries that are sent to every task at once.
QUERY_BLOCK = 8192


def nearest_in(batches: Iterator[pa.RecordBatch], ids: pa.Array, matrix: np.ndarray, n: int, key: str) -> Iterator[pa.RecordBatch]:
    """(query_id, key, score) of each batch's n best for each query, with all that tie with the last."""
    length = np.sqrt((matrix**2).sum(axis=1))
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
            own = flat.reshape(part.num_rows, -1)
            size = np.sqrt((own**2).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = np.nan_to_num((own @ matrix.T) / (size[:, None] * length[None, :]))
            least = np.partition(scores, max(0, len(scores) - n), axis=0)[max(0, len(scores) - n)]
            row, query = np.nonzero(scores >= least[None, :])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), part.column(key).take(pa.array(row)), pa.array(scores[row, query])], names=["query_id", key, "score"])


def dense(vectors: DataFrame, queries: DataFrame, n: int, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, rank) of the n nearest by cosine, exactly; 0 where a vector has no length.

    queries (query_id, embedding): a stated set, in blocks of bounded size that are sent to every task; each task keeps its
    best. All vectors have one length; null ones take no part.
    """
    blocks = -(-queries.count() // QUERY_BLOCK)
    given = vectors.filter("embedding IS NOT NULL").select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.filter("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1))).alias("block"))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {key} {dict(vectors.dtypes)[key]}, score double"
    out = vectors.sparkSession.createDataFrame([], schema)
    for block in range(blocks):
        rows = asked.filter(F.col("block") == block).toArrow().combine_chunks()
        if rows.num_rows:
            ids = rows.column("query_id").combine_chunks()
            matrix = rows.column("embedding").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            sent = vectors.sparkSession.sparkContext.broadcast((ids, matrix))
            out = out.unionByName(given.mapInArrow(lambda it, sent=sent: nearest_in(it, *sent.value, n, key), schema))
    return ranked(out, n, key)


def fused(lexical: DataFrame, vector: DataFrame, k: int, weights: tuple[float, float] = WEIGHTS, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, rrf_score, rank): the sum of weight / (60 + rank) over both arms; ties go to the smaller key."""
    arms = [df.select("query_id", key, (F.lit(w) / (RRF_K + F.col("rank"))).alias("part")) for df, w in zip((lexical, vector), weights, strict=True)]
    total = arms[0].unionByName(arms[1]).groupBy("query_id", key).agg(F.sum("part").alias("score"))
    return ranked(total, k, key).withColumnRenamed("score", "rrf_score")


def search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = RETRIEVE_K, mode: str = "hybrid", scope: str = "blended", statute: list[str] | None = None, weights: tuple[float, float] = WEIGHTS, boosts: dict[str, float] | None = None) -> DataFrame:
    """Hits of queries (query_id, query, embedding), k each, with the chunk's fields and rrf_score.

    The scope is a predicate on both scans, and vectors without a chunk are dropped, both before any limit.
    """
    if mode not in ("bm25", "vector", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    inside = chunks.filter(scope_filter(scope, statute or []))
    fetch = max(3 * k, SCOPED_FETCH) if scope != "blended" else 3 * k
    none = queries.sparkSession.createDataFrame([], "query_id string, chunk_id string, rank int")
    lexical = bm25(inside, queries, fetch, boosts) if mode != "vector" else none
    near = dense(vectors.join(inside.select("chunk_id"), "chunk_id", "left_semi"), queries, 3 * k) if mode != "bm25" else none
    return hydrated(fused(lexical.select("query_id", "chunk_id", "rank"), near.select("query_id", "chunk_id", "rank"), k, weights), inside)


def hydrated(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    return hits.join(chunks.select([c for c in HIT_FIELDS if c in chunks.columns]), "chunk_id")


def retrieve(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, scope: str = "blended", statute: list[str] | None = None) -> DataFrame:
    return search(chunks, vectors, queries, RETRIEVE_K, "hybrid", scope, statute, WEIGHTS)


def rerank(hits: DataFrame, queries: DataFrame, provider: ModelProvider, k: int = RERANK_K) -> DataFrame:
    """The k best of each query's hits by a pair scorer; ties go to the smaller chunk_id."""
    pairs = hits.join(queries.select("query_id", "query"), "query_id")
    return ranked(scored(pairs, "query", "texte", provider).drop("rank"), k)


def rewritten(queries: DataFrame, answer: str) -> DataFrame:
    """The model's rewriting where it gave one, else the query as asked."""
    return queries.withColumn("query_rewritten", F.coalesce(F.nullif(F.trim(answer), F.lit("")), F.col("query")))


def routed(decisions: DataFrame) -> DataFrame:
    """(intent, confidence, case_id) to intent, scope, confidence: the table of routes. A failed or unknown intent is `other`, low."""
    known = F.col("intent").isin("statute_lookup", "case_factual", "gap_analysis", "other")
    intent = F.when(known, F.col("intent")).otherwise("other")
    sure = F.when(known & F.col("confidence").isin("low", "medium", "high"), F.col("confidence")).otherwise("low")
    case = F.col("case_id")
    scope = F.when(case.isNull(), "statute").when(intent == "case_factual", F.concat(F.lit("case:"), case)).otherwise(F.concat(F.lit("case+statute:"), case))
    low = case.isNull() & intent.isin("case_factual", "gap_analysis")
    return decisions.withColumns({"intent": intent, "scope": scope, "confidence": F.when(low, "low").otherwise(sure)})


def prompts(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, prompt): numbered extracts in order of rank, under a head that says what kinds of text they are."""
    label = F.coalesce(F.nullif(F.col("titre"), F.lit("")), F.nullif(F.col("section_path"), F.lit("")), F.lit("—"))
    line = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] "), F.col("source_label"), F.lit(" — "), label, F.lit("\n"), F.col("texte"))
    case = F.col("source").startswith("dossier-")
    packed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"), F.bool_or(case).alias("has_case"), F.bool_or(~case).alias("has_statute"))
    head = F.when(F.col("has_case") & F.col("has_statute"), "Case documents and statute").when(F.col("has_case"), "Case documents").otherwise("Statute")
    return packed.join(queries.select("query_id", "query"), "query_id").select("query_id", F.concat(head, F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n"), F.lit("\n\nQuestion: "), F.col("query")).alias("prompt"))


def reconciled(vectors: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, state): ok, orphan (a vector without a chunk) or unvectorised (a chunk without a vector)."""
    v, c = vectors.select(key).distinct().withColumn("__v", F.lit(1)), chunks.select(key).distinct().withColumn("__c", F.lit(1))
    return v.join(c, key, "full_outer").select(key, F.when(F.col("__c").isNull(), "orphan").when(F.col("__v").isNull(), "unvectorised").otherwise("ok").alias("state"))


def without_orphans(vectors: DataFrame, chunks: DataFrame, apply: bool = False, key: str = "chunk_id") -> DataFrame:
    """The vectors, less orphans only if apply."""
    return vectors.join(chunks.select(key), key, "left_semi") if apply else vectors
