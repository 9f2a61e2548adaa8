"""Retrieval and its measures over documents and embeddings, judges over labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casebench.functions import scalars
from casebench.operators import candidates, evaluation, retrieval
from casebench.plans.registry import Tables, query

K = 10
_SIM = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"
_NEAR = f"""n AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {_SIM.format(a="q.embedding", b="v.embedding")} AS score, q.label AS ql, v.label AS vl FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM n)"""


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def near(t: Tables, n: int, width: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) for the queries, every row whose id 50 divides, without itself.

    Scores are rounded, so a few more than n are asked for and ranked again.
    """
    v = vectors(t)
    v = v.withColumn("embedding", F.slice("embedding", 1, width)) if width else v
    found = retrieval.dense(v, v.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding"), n + 10)
    return retrieval.ranked(found.filter("query_id <> chunk_id").select("query_id", "chunk_id", F.round("score", 6).alias("score")), n)


@query(f"WITH {_NEAR} SELECT query_id, id AS chunk_id, score, rank FROM k WHERE rank < 10")
def vector_topk_cosine(t):
    return near(t, K).withColumn("rank", F.col("rank").cast("long"))


_WORDS = "('the', 'and', 'und', 'des', 'los', 'thand')"
_LEX = f"""w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM documents),
l AS (SELECT doc_id AS id, count(*) AS score FROM w WHERE w IN {_WORDS} GROUP BY doc_id), lr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM l)"""


def lexical(t: Tables) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w.isin("the", "and", "und", "des", "los", "thand"))
    scored = t.documents.select(F.lit(0).alias("query_id"), F.col("doc_id").alias("chunk_id"), F.size(words).alias("score")).filter("score > 0")
    return retrieval.ranked(scored, 200)


@query(f"""WITH {_LEX}, v AS (SELECT v.vec_id AS id, row_number() OVER (ORDER BY {_SIM.format(a="q.embedding", b="v.embedding")} DESC, v.vec_id) - 1 AS rank FROM embeddings q JOIN embeddings v ON q.vec_id = 0),
u AS (SELECT id, 0.3::DOUBLE / (60 + rank) AS s FROM lr WHERE rank < 200 UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank) FROM v WHERE rank < 60), f AS (SELECT id, round(sum(s), 9) AS s FROM u GROUP BY id)
SELECT id AS chunk_id, s AS rrf_score, row_number() OVER (ORDER BY s DESC, id) - 1 AS rank FROM f ORDER BY rank LIMIT 20""")
def rrf_hybrid_topk(t):
    v = vectors(t)
    q = v.filter("chunk_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("__q"))
    dense = retrieval.ranked(v.join(F.broadcast(q)).select("query_id", "chunk_id", F.round(scalars.cosine(F.col("embedding"), F.col("__q")), 6).alias("score")), 60)  # q: one row
    both = retrieval.fused(lexical(t).select("query_id", "chunk_id", "rank"), dense.select("query_id", "chunk_id", "rank"), 1_000)
    return retrieval.ranked(both.select("query_id", "chunk_id", F.round("rrf_score", 9).alias("score")), 20).select("chunk_id", F.col("score").alias("rrf_score"), F.col("rank").cast("long"))


@query(r"""WITH p AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-zà-ÿß]+') AS ws FROM documents), q AS (SELECT doc_id, list_filter(ws, lambda x: x <> '') AS ws FROM p),
a AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM q), w AS (SELECT doc_id, len(ws) AS l, unnest(ws) AS w FROM q), f AS (SELECT w, doc_id, any_value(l) AS l, count(*) AS tf FROM w WHERE w IN ('thand', 'keit', 'ement', 'zez') GROUP BY w, doc_id), d AS (SELECT w, count(*) AS df FROM f GROUP BY w),
s AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM f JOIN d USING (w), a GROUP BY doc_id)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM s ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_topk(t):
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.regexp_replace(F.lower("text"), "[^a-zà-ÿß]+", " ").alias("texte"))
    q = t.spark.createDataFrame([(0, "thand keit ement zez")], "query_id int, query string")
    scores = retrieval.bm25(chunks, q, 1_000, {"texte": 1.0}).select("query_id", "chunk_id", F.round("score", 6).alias("score"))
    return retrieval.ranked(scores, 20).select(F.col("chunk_id").alias("doc_id"), "score", F.col("rank").cast("long"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE source IN ('src1', 'src7', 'src19')")
def scope_allowlist_filter(t):
    return t.documents.select("doc_id", "source", "n_chars").filter(retrieval.scope_filter("statute", ["src1", "src7", "src19"]))


@query(f"WITH {_NEAR} SELECT query_id, id AS chunk_id, rank, source, md5(text) AS digest FROM k JOIN documents ON doc_id = id WHERE rank < 5")
def hydrate_hits(t):
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), "source", F.col("text").alias("texte"))
    return retrieval.hydrated(near(t, 5), chunks).select("query_id", "chunk_id", F.col("rank").cast("long"), "source", F.md5(F.col("texte").cast("binary")).alias("digest"))


@query("SELECT coalesce(vec_id, doc_id) AS chunk_id, CASE WHEN doc_id IS NULL THEN 'orphan' WHEN vec_id IS NULL THEN 'unvectorised' ELSE 'ok' END AS state FROM embeddings FULL JOIN documents ON vec_id = doc_id")
def reconcile_vectors(t):
    return retrieval.reconciled(vectors(t), t.documents.select(F.col("doc_id").alias("chunk_id")))


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY source")
def unvectorised_by_source(t):
    return t.documents.select("doc_id", "source").join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def first_relevant(t: Tables, width: int | None = None) -> DataFrame:
    """(query_id, rank) of the first hit with the query's label, null if none of K has it."""
    lab = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "label")
    hits = near(t, K, width).join(lab, "chunk_id").join(lab.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return hits.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("own"), F.col("rank"))).alias("rank"))


_FIRST = "r AS (SELECT query_id, min(CASE WHEN ql = vl THEN rank END) AS rank FROM k WHERE rank < 10 GROUP BY query_id)"


@query(f"WITH {_NEAR}, {_FIRST} SELECT round(avg(CAST(rank IS NOT NULL AS DOUBLE)), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / (rank + 1), 0)), 6) AS mrr, count(*) AS n FROM r")
def hit_rate_mrr(t):
    return evaluation.hit_rate_mrr(first_relevant(t))


@query(f"""WITH {_NEAR}, {_FIRST}, n8 AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {_SIM.format(a="q.embedding[1:8]", b="v.embedding[1:8]")} AS score, q.label AS ql, v.label AS vl FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
k8 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM n8), r8 AS (SELECT query_id, min(CASE WHEN ql = vl THEN rank END) AS rank FROM k8 WHERE rank < 10 GROUP BY query_id),
p AS (SELECT r.rank IS NOT NULL AS x, r8.rank IS NOT NULL AS y FROM r JOIN r8 USING (query_id)) SELECT count(*) FILTER (x AND y) AS both, count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (NOT x AND y) AS only_b, count(*) FILTER (NOT x AND NOT y) AS neither FROM p""")
def paired_discordant(t):
    r = first_relevant(t).withColumn("config", F.lit("all")).unionByName(first_relevant(t, 8).withColumn("config", F.lit("eight")))
    return evaluation.paired(r, "all", "eight")


_JUDGES = """v AS (SELECT doc_id AS query_id, 'a' AS judge, CASE WHEN quality = 1 THEN 'RELEVANT' ELSE 'NON_RELEVANT' END AS verdict FROM labels
  UNION ALL SELECT doc_id, 'b', CASE WHEN toxic = 0 THEN 'RELEVANT' WHEN doc_id % 2 = 0 THEN 'UNKNOWN' ELSE 'NON_RELEVANT' END FROM labels UNION ALL SELECT doc_id, 'c', CASE WHEN doc_id % 5 = 0 THEN 'UNKNOWN' WHEN doc_id % 3 = 0 THEN 'PARTLY' ELSE 'RELEVANT' END FROM labels WHERE doc_id % 7 <> 0)"""
_WIDE = _JUDGES + ", w AS (SELECT query_id, max(nullif(verdict, 'UNKNOWN')) FILTER (judge = 'a') AS a, max(nullif(verdict, 'UNKNOWN')) FILTER (judge = 'b') AS b, max(nullif(verdict, 'UNKNOWN')) FILTER (judge = 'c') AS c FROM v GROUP BY query_id)"


def judges(t: Tables) -> DataFrame:
    """Three judges made of the labels: quality, toxicity with unknowns, and one by id that leaves out some."""
    i = F.col("doc_id")
    lab = t.labels
    of = lambda df, name, verdict: df.select(i.alias("query_id"), F.lit(name).alias("judge"), verdict.alias("verdict"))
    a = of(lab, "a", F.when(F.col("quality") == 1, "RELEVANT").otherwise("NON_RELEVANT"))
    b = of(lab, "b", F.when(F.col("toxic") == 0, "RELEVANT").when(i % 2 == 0, "UNKNOWN").otherwise("NON_RELEVANT"))
    c = of(lab.filter(i % 7 != 0), "c", F.when(i % 5 == 0, "UNKNOWN").when(i % 3 == 0, "PARTLY").otherwise("RELEVANT"))
    return a.unionByName(b).unionByName(c)


@query(f"WITH {_JUDGES} SELECT judge, verdict, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY judge) AS DOUBLE), 3) AS share FROM v GROUP BY judge, verdict")
def judge_distribution(t):
    return evaluation.distribution(judges(t))


@query(f"WITH {_WIDE} SELECT 'a' AS judge_a, 'b' AS judge_b, count(*) AS n, round(avg(CAST(a = b AS DOUBLE)), 6) AS agree FROM w WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT 'a', 'c', count(*), round(avg(CAST(a = c AS DOUBLE)), 6) FROM w WHERE a IS NOT NULL AND c IS NOT NULL UNION ALL SELECT 'b', 'c', count(*), round(avg(CAST(b = c AS DOUBLE)), 6) FROM w WHERE b IS NOT NULL AND c IS NOT NULL")
def pairwise_agreement(t):
    return evaluation.agreement(evaluation.wide(judges(t), ["a", "b", "c"]), ["a", "b", "c"])


@query(f"WITH {_WIDE} SELECT round(avg(CAST(a = b AND b = c AS DOUBLE)), 6) AS all_agree, count(*) AS n FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def all_judges_agree(t):
    return evaluation.all_agree_rate(evaluation.wide(judges(t), ["a", "b", "c"]), ["a", "b", "c"])


@query(f"""WITH {_JUDGES}, n AS (SELECT query_id, nullif(verdict, 'UNKNOWN') AS l, count(*) AS n FROM v GROUP BY ALL), b AS (SELECT query_id, max(n) FILTER (l IS NOT NULL) AS n, arg_max(l, (n, l)) FILTER (l IS NOT NULL) AS l FROM n GROUP BY query_id)
SELECT query_id, CASE WHEN n IS NULL THEN 'ALL_UNKNOWN' WHEN n >= 2 THEN l ELSE 'SPLIT' END AS majority FROM b""")
def majority_vote(t):
    return evaluation.majority(judges(t))


@query(f"WITH {_JUDGES} SELECT query_id FROM v GROUP BY query_id HAVING count(DISTINCT judge) = 3")
def complete_queries(t):
    return evaluation.complete_queries(judges(t))


@query("SELECT doc_id FROM documents ORDER BY sha256(doc_id || '|42'), doc_id LIMIT 50")
def deterministic_sample(t):
    return evaluation.sampled(t.documents.select("doc_id"), "doc_id", 50)


@query("""WITH e AS (SELECT event_id % 4 AS k, event_type, event_id % 3 AS c FROM events), d AS (SELECT CASE k WHEN 0 THEN 'statute_lookup' WHEN 1 THEN 'case_factual' WHEN 2 THEN 'gap_analysis' ELSE 'nonsense' END AS i, CASE WHEN c = 0 THEN 'high' ELSE 'sure' END AS conf, CASE WHEN event_type = 'view' THEN 'demo' END AS case_id FROM e),
r AS (SELECT CASE WHEN i = 'nonsense' THEN 'other' ELSE i END AS intent, CASE WHEN case_id IS NULL THEN 'statute' WHEN i = 'case_factual' THEN 'case:demo' ELSE 'case+statute:demo' END AS scope, CASE WHEN i = 'nonsense' OR conf = 'sure' OR (case_id IS NULL AND i IN ('case_factual', 'gap_analysis')) THEN 'low' ELSE 'high' END AS confidence FROM d)
SELECT intent, scope, confidence, count(*) AS n FROM r GROUP BY ALL""")
def route_table(t):
    i = F.col("event_id") % 4
    d = t.events.select(F.when(i == 0, "statute_lookup").when(i == 1, "case_factual").when(i == 2, "gap_analysis").otherwise("nonsense").alias("intent"), F.when(F.col("event_id") % 3 == 0, "high").otherwise("sure").alias("confidence"), F.when(F.col("event_type") == "view", "demo").alias("case_id"))
    return retrieval.routed(d).groupBy("intent", "scope", "confidence").agg(F.count(F.lit(1)).alias("n"))


_PAIRS = """w AS (SELECT doc_id, f, list_distinct(list_filter(regexp_split_to_array(x, '[^A-Za-zÀ-ÿ]+'), lambda t: length(t) >= 9)) AS words, list_distinct(list_filter(string_split(x, chr(10)), lambda t: length(t) >= 20)) AS lines FROM (SELECT doc_id, coalesce(source, '') AS f, coalesce(text, '') AS x FROM documents)),
n AS (SELECT count(*) AS n FROM documents)"""


def _pairs_sql(kind: str, k: int) -> str:
    return f"""{kind}_e AS (SELECT doc_id, f, unnest({kind}) AS key FROM w), {kind}_d AS (SELECT key, count(*) AS df FROM {kind}_e GROUP BY key HAVING count(*) > 1),
{kind}_p AS (SELECT a.doc_id AS a, b.doc_id AS b, CAST(sum(n.n // d.df) AS BIGINT) AS score, count(*) AS shared FROM {kind}_e a JOIN {kind}_d d ON a.key = d.key JOIN {kind}_e b ON a.key = b.key AND a.doc_id < b.doc_id AND a.f <> b.f, n GROUP BY ALL ORDER BY score DESC, a, b LIMIT {k})"""


@query(f"""WITH {_PAIRS}, {_pairs_sql("words", 32)}, {_pairs_sql("lines", 40)}
SELECT a, b, score, shared, 'keywords' AS found_by FROM words_p UNION ALL SELECT * FROM (SELECT a, b, score, shared, 'discovery' AS found_by FROM lines_p WHERE (a, b) NOT IN (SELECT a, b FROM words_p) ORDER BY score DESC, a, b LIMIT 8)""")
def duplicate_candidates(t):
    """The pairs of documents of different sources that share the rarest long words, and of the rest those that share the rarest lines."""
    d = t.documents.select(F.col("doc_id").alias("entry"), F.col("source").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.filter(F.split("text", "[^A-Za-zÀ-ÿ]+"), lambda x: F.length(x) >= 9)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 20)
    return candidates.candidate_pairs(d.select("entry", "file", words.alias("keys")), d.select("entry", "file", lines.alias("keys")))
