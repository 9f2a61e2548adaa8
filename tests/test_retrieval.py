import pytest

from casebench.models import Stub, embedded, through_cache
from casebench.operators import evaluation as ev, retrieval as r
from pyspark.sql import functions as F

CHUNKS = [("c0", "cc", "usufruit et nue propriété"), ("c1", "cc", "partage de la succession"), ("d0", "dossier-demo", "lettre du notaire sur la succession"), ("d1", "dossier-demo", "relevé de la banque"), ("a0", "dossier-acme", "lettre de la banque"), ("a1", "dossier-demo-x", "succession")]


@pytest.fixture
def corpus(spark):
    c = spark.createDataFrame([(i, s, s, "", "", i, t, "") for i, s, t in CHUNKS], "chunk_id string, source string, source_label string, num string, section_path string, titre string, texte string, url string")
    return c, embedded(c, "texte", Stub()).select("chunk_id", "embedding")


def queries(spark, *texts):
    return embedded(spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string"), "query", Stub())


@pytest.mark.parametrize(("scope", "sources"), [("statute", {"cc"}), ("case:demo", {"dossier-demo"}), ("case+statute:demo", {"cc", "dossier-demo"}), ("dossier", {"dossier-demo", "dossier-acme", "dossier-demo-x"})])
@pytest.mark.parametrize("mode", ["bm25", "vector", "hybrid"])
def test_scopes(spark, corpus, scope, sources, mode):
    got = r.search(*corpus, queries(spark, "lettre de la succession banque propriété"), 20, mode, scope, ["cc"]).collect()
    assert got and {x.source for x in got} <= sources
    if mode != "bm25":
        assert {x.source for x in got} == sources


def test_bad_scopes():
    for scope in ("case:", "nowhere", "case:../x"):
        with pytest.raises(ValueError):
            r.scope_filter(scope, [])


def test_bm25_prefers_the_rare_word(spark, corpus):
    got = r.bm25(corpus[0], queries(spark, "usufruit succession"), 3).orderBy("rank").collect()
    assert got[0].chunk_id == "c0" and [x["rank"] for x in got] == [0, 1, 2]


def arms(spark, lexical, dense):
    of = lambda ids: spark.createDataFrame([("q", i, k) for k, i in enumerate(ids)], "query_id string, chunk_id string, rank int")
    return of(lexical), of(dense)


def test_fusion(spark):
    a = arms(spark, ["c6"], [f"c{i}" for i in range(6)])
    even = r.fused(*a, 7, (1.0, 1.0)).orderBy("rank").collect()
    assert {even[0].chunk_id, even[1].chunk_id} == {"c0", "c6"} and even[0].rrf_score == even[1].rrf_score == 1 / 60
    assert r.fused(*a, 1).first().chunk_id == "c0"
    assert [x.chunk_id for x in r.fused(*a, 3).orderBy("rank").collect()] == [x.chunk_id for x in r.fused(*a, 7).orderBy("rank").collect()][:3]


def test_orphans_go_before_the_cut(spark, corpus):
    c, v = corpus
    ghost = v.unionByName(v.filter("chunk_id = 'c1'").withColumn("chunk_id", F.lit("ghost")))
    got = r.search(c, ghost, queries(spark, "partage de la succession"), 3, "vector").orderBy("rank").collect()
    assert len(got) == 3 and got[0].chunk_id == "c1" and "ghost" not in {x.chunk_id for x in got}
    assert {x.chunk_id: x.state for x in r.reconciled(ghost, c.filter("chunk_id <> 'c0'").unionByName(c.limit(1).withColumn("chunk_id", F.lit("new")))).collect() if x.state != "ok"} == {"ghost": "orphan", "c0": "orphan", "new": "unvectorised"}
    assert r.without_orphans(ghost, c).count() == 7 and r.without_orphans(ghost, c, apply=True).count() == 6


def test_rerank_prompt_and_routes(spark, corpus):
    q = queries(spark, "lettre de la banque")
    hits = r.retrieve(*corpus, q)
    top = r.rerank(hits, q, Stub(), 2).orderBy("rank").collect()
    assert top[0].chunk_id == "a0"
    prompt = r.prompts(hits, q).first().prompt
    assert prompt.startswith("Case documents and statute\n\n[1] ") and prompt.endswith("Question: lettre de la banque")
    rows = [("statute_lookup", "high", None, "statute", "high"), ("case_factual", "high", None, "statute", "low"), ("case_factual", "high", "demo", "case:demo", "high"), ("gap_analysis", "medium", "demo", "case+statute:demo", "medium"), ("junk", "high", "demo", "case+statute:demo", "low"), ("gap_analysis", "high", None, "statute", "low")]
    got = r.routed(spark.createDataFrame([x[:3] for x in rows], "intent string, confidence string, case_id string")).collect()
    assert [(x.scope, x.confidence) for x in got] == [x[3:] for x in rows]


def test_measures(spark):
    gold = spark.createDataFrame([("q0", "c0"), ("q1", "c1"), ("q2", "c2")], "query_id string, chunk_id string")
    hits = spark.createDataFrame([("q0", "c0", 0), ("q1", "x", 0), ("q1", "c1", 3)], "query_id string, chunk_id string, rank int")
    ranks = ev.gold_ranks(gold, hits)
    assert tuple(ev.hit_rate_mrr(ranks).first()) == (0.666667, round(1.25 / 3, 6), 3)
    assert tuple(ev.hit_rate_mrr(ranks, k=2).first())[0] == 0.333333
    both = ranks.withColumn("config", F.lit("a")).unionByName(ranks.withColumn("config", F.lit("b")).withColumn("rank", F.when(F.col("query_id") == "q2", 1)))
    assert tuple(ev.paired(both, "a", "b").first()) == (0, 2, 1, 0)
    trials = ev.boost_trials(spark, ["x", "y"]).collect()
    assert len(trials) == 20 and all(0 <= t.x <= 3 for t in trials) and trials == ev.boost_trials(spark, ["x", "y"]).collect()


def test_samples_are_nested(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    ten, forty = ({x.k for x in ev.sampled(df, "k", n).collect()} for n in (10, 40))
    assert ten < forty and ten == {x.k for x in ev.sampled(df.repartition(7), "k", 10).collect()}


def test_cache_hit_makes_no_call(spark):
    class Counting(Stub):
        def complete(self, prompts):
            assert all("new" in p for p in prompts), "called for a cached prompt"
            return super().complete(prompts)

    work = spark.createDataFrame([("k1", "old"), ("k2", "new")], "cache_key string, prompt string")
    cache = spark.createDataFrame([("k1", "a", 1), ("k1", "b", 2)], "cache_key string, result_json string, created_at long")
    results, fresh = through_cache(work, cache, "prompt", Counting())
    assert {x.cache_key: x.result_json for x in results.collect()}["k1"] == "b" and [x.cache_key for x in fresh.collect()] == ["k2"]
