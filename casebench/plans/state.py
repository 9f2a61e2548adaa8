"""Queries of what outlives a run: the loop over cases, the store of verdicts, collections by case."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, functions as F

from casebench import models
from casebench.operators import register
from casebench.plans.registry import Tables, query
from casebench.session import shared_dir
from casebench.sources import collections, rest
from casebench.sources.tables import CaseTables
from casebench.streaming import loop


def fresh_folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def observations(t: Tables) -> DataFrame:
    """Each turn as a poll of its conversation's case, some hours after the turn before, that sees one artifact; some leave work over."""
    n = F.length("text")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("turn") * 20 + n % 20) * 3600)
    return t.conversations.select(F.col("conv_id").cast("string").alias("case_id"), F.col("turn").alias("poll"), at.alias("at"), F.col("role").alias("artifact"), F.floor(n / 200).cast("string").alias("sha256"), (n % 5 > 0).alias("complete"))


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, turn * 20 + length(text) % 20 AS hours, length(text) % 5 = 0 AS incomplete, length(text) // 200 AS sha, role FROM conversations),
p AS (SELECT conv_id, turn, hours, incomplete, sha IS DISTINCT FROM lag(sha) OVER (PARTITION BY conv_id, role ORDER BY hours, turn) AS changed, row_number() OVER (PARTITION BY conv_id ORDER BY hours, turn) AS n FROM o),
c AS (SELECT conv_id, n, turn, 'first_run' AS reason, 1 AS cycle, hours AS last, incomplete AS backlog FROM p WHERE n = 1
UNION ALL SELECT conv_id, n, turn, why, cycle + CAST(why IS NOT NULL AS INT), CASE WHEN why IS NULL THEN last ELSE hours END, CASE WHEN why IS NULL THEN backlog ELSE incomplete END
FROM (SELECT p.conv_id, p.n, p.turn, p.hours, p.incomplete, c.cycle, c.last, c.backlog, CASE WHEN p.changed THEN 'changed' WHEN c.backlog THEN 'backlog' WHEN p.hours - c.last > 24 THEN 'full_sweep' END AS why FROM c JOIN p ON p.conv_id = c.conv_id AND p.n = c.n + 1))
SELECT CAST(conv_id AS VARCHAR) AS case_id, turn AS poll, reason, CAST(cycle AS BIGINT) AS cycle FROM c WHERE reason IS NOT NULL""")
def case_loop_cycles(t):
    """The loop over all cases, in two streams, the second of which goes on from the kept state."""
    root = fresh_folder(t, "loop")
    obs = observations(t)
    ends = obs.agg(F.min("at").cast("double").alias("a"), F.max("at").cast("double").alias("b")).first()
    first = F.col("at").cast("double") <= ((ends.a or 0) + (ends.b or 0)) / 2
    for part in (first, ~first):
        obs.filter(part).write.mode("append").parquet(f"{root}/in")
        loop.watch_cases(t.spark, f"{root}/in", root)
    return loop.CaseLoop(t.spark, root).cycles().select("case_id", "poll", "reason", "cycle")


class RoundModel:
    """Answers with the number of its round; fails where the prompt's number and the round's are together divisible by 4."""

    def __init__(self, number: int):
        self.name, self.number = f"round-{number}", number

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [json.dumps({"round": self.number}) if (int(p) + self.number) % 4 else None for p in prompts]


@query("""WITH w AS (SELECT DISTINCT coalesce(source, '') AS subject, n_chars % 1000 AS k, doc_id % 3 AS round FROM documents)
SELECT subject, k, CAST(min(round) FILTER ((k + round) % 4 <> 0) AS BIGINT) AS answered_in, count(*) FILTER ((k + round) % 4 = 0 AND round < coalesce(first, 9)) AS failed
FROM (SELECT *, min(round) FILTER ((k + round) % 4 <> 0) OVER (PARTITION BY subject, k) AS first FROM w) GROUP BY subject, k HAVING answered_in IS NOT NULL""")
def stored_cache(t):
    """Three rounds of verification through one store: what was answered before isn't asked again, a failed call is."""
    cache = models.StoredCache(t.spark, fresh_folder(t, "cache"), fan=2)
    work = t.documents.select(F.coalesce("source", F.lit("")).alias("subject"), (F.col("n_chars") % 1000).alias("k"), (F.col("doc_id") % 3).alias("round"))
    work = work.select(models.cache_key(F.lit("check"), F.col("subject"), F.col("k")).alias("cache_key"), F.lit("check").alias("pass_name"), "subject", "k", F.col("k").cast("string").alias("prompt"), "round").distinct()
    for number in range(3):
        cache.answered(work.filter(F.col("round") == number), "prompt", RoundModel(number))
    # a round before the one that answered asked in vain
    answers = cache.table.read().select("cache_key", F.get_json_object("result_json", "$.round").cast("long").alias("answered_in"))
    keys = work.select("cache_key", "subject", "k", "round").join(answers, "cache_key")
    return keys.groupBy("subject", "k", "answered_in").agg(F.count_if(F.col("round") < F.col("answered_in")).alias("failed"))


@query("""WITH e AS (SELECT CAST(label AS VARCHAR) AS c, vec_id AS i FROM embeddings WHERE label IS NOT NULL)
SELECT 'statutes' AS case_id, 'c' || i AS chunk_id FROM e WHERE i % 4 = 0
UNION ALL SELECT c, 'dossier-' || c || '-' || i FROM e WHERE i % 4 > 0 AND CASE c WHEN '1' THEN i % 3 = 0 WHEN '2' THEN false WHEN '3' THEN i % 7 = 1 ELSE i % 2 = 1 END""")
def vector_collection(t):
    """A collection built anew, two cases replaced, one of them again, and one emptied; no other case changes."""
    e = t.embeddings.filter("label IS NOT NULL").select("vec_id", "embedding", F.col("label").cast("string").alias("case_id"))
    own = e.filter("vec_id % 4 > 0").withColumn("chunk_id", F.concat(F.lit("dossier-"), "case_id", F.lit("-"), F.col("vec_id").cast("string")))
    statutes = e.filter("vec_id % 4 = 0").select("vec_id", "embedding", F.lit(None).cast("string").alias("case_id"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"))
    vectors = collections.VectorCollection(t.spark, fresh_folder(t, "vectors"))
    vectors.rebuild(own.filter("vec_id % 2 = 1").unionByName(statutes))
    vectors.add_cases(own.filter("(case_id = '1' AND vec_id % 3 = 0) OR (case_id = '3' AND vec_id % 5 = 0)"))
    vectors.add_cases(own.filter("case_id = '3' AND vec_id % 7 = 1"), ["2", "3"])
    return vectors.read().select("case_id", "chunk_id")


@query("""WITH RECURSIVE i AS (SELECT CAST(doc_id AS VARCHAR) AS key, coalesce(source, '?') || ':' || n_chars AS value, md5(text) AS twin FROM documents),
n AS (SELECT DISTINCT a.key AS a, b.key AS b FROM i a JOIN i b ON a.value = b.value OR a.twin = b.twin),
r AS (SELECT key AS a, key AS b FROM i UNION SELECT r.a, n.b FROM r JOIN n ON n.a = r.b)
SELECT a AS key, min(b) AS class FROM r GROUP BY a""")
def replacement_classes(t):
    """Documents as identifiers: those of one source and length share a replacement, copies are chained; the classes."""
    d = t.documents.select(F.col("doc_id").cast("string").alias("key"), F.concat(F.coalesce("source", F.lit("?")), F.lit(":"), F.col("n_chars").cast("string")).alias("value"), F.md5(F.col("text").cast("binary")).alias("twin"))
    # copies are chained through the first of them
    firsts = d.groupBy("twin").agg(F.min("key").alias("a"))
    groups = d.join(firsts, "twin").filter("a <> key").select("a", F.col("key").alias("b"))
    return register.classes(d.select("key", "value"), groups)


@query("""WITH d AS (SELECT doc_id, coalesce(source, '?') AS c, coalesce(lang, '?') AS lang, 'v' || (n_chars % 50) AS v FROM documents),
x AS (SELECT DISTINCT c, v, CASE WHEN v LIKE 'v1%' THEN 'commune' WHEN v LIKE 'v2%' THEN 'voie' ELSE 'personne' END AS kind FROM d),
s AS (SELECT c, v, kind || '_' || row_number() OVER (PARTITION BY c, kind ORDER BY CASE WHEN kind = 'voie' THEN 'du ' || v ELSE v END) AS slug FROM x)
SELECT d.c AS "case", CAST(doc_id AS VARCHAR) AS key, slug FROM d JOIN s ON s.c = d.c AND s.v = d.v""")
def role_designations(t):
    """Documents as identifiers of the case of their source; the designation that stands for each."""
    v = F.concat(F.lit("v"), (F.col("n_chars") % 50).cast("string"))
    extras = t.documents.select(F.coalesce("source", F.lit("?")).alias("case"), F.col("doc_id").cast("string").alias("key"), F.when(v.startswith("v2"), F.concat(F.lit("du "), v)).otherwise(v).alias("value"))
    return register.role_identifiers(extras, ("v1",), by=("case",))


@query("""SELECT page_id, 'ok' AS status, CASE WHEN page_id % 10 = 0 THEN 5 ELSE 1 END AS attempts, url, length(html) AS size FROM pages WHERE page_id % 25 <> 3
UNION ALL SELECT page_id, 'failed', 5, NULL, NULL FROM pages WHERE page_id % 25 = 3""")
def rest_pages(t):
    """Pages asked for from a service that fails, refuses old tokens and answers with what it was asked."""
    asked = t.pages.select("page_id", F.lit("/page").alias("path"), F.to_json(F.struct("page_id", "url", F.length("html").alias("size"))).alias("payload"))
    got = rest.fetched(asked, Unsteady(), rate=1e9, sleep=lambda _: None)
    item = F.from_json("body", "page_id long, url string, size long")
    ok = F.col("status") == "ok"
    return got.select("page_id", "status", "attempts", F.when(ok, item["url"]).alias("url"), F.when(ok, item["size"]).alias("size"))


class Unsteady:
    """A local service: every tenth page fails four times, every 25th always; a token is good for seven requests."""

    def __init__(self):
        self.failed: dict[int, int] = {}
        self.tokens, self.left = 0, 0

    def token(self) -> tuple[str, float]:
        self.tokens, self.left = self.tokens + 1, 7
        return f"t{self.tokens}", 3600.0

    def send(self, path: str, payload: dict, token: str) -> tuple[int, str]:
        if token != f"t{self.tokens}" or not self.left:
            return 401, "expired"
        self.left -= 1
        page = payload["page_id"]
        if page % 25 == 3 or (page % 10 == 0 and self.failed.setdefault(page, 0) < 4):
            self.failed[page] = self.failed.get(page, 0) + 1
            return 503, "busy"
        return 200, json.dumps(payload)


@query("""SELECT CAST(doc_id AS VARCHAR) AS fact_id, coalesce(source, '?') AS case_id, 'p' || quality AS person_id, CASE WHEN doc_id % 3 = 0 THEN 'complete' END AS status FROM documents LEFT JOIN labels USING (doc_id)""")
def case_tables(t):
    """Documents as facts, labels as the edges to persons, every third document covered; joined where the buckets lie."""
    return state_tables(t).graph().select("fact_id", "case_id", "person_id", "status")


def state_tables(t: Tables) -> CaseTables:
    tables = CaseTables(t.spark, f"case_{uuid.uuid4().hex}", fresh_folder(t, "tables"))
    tables.create()
    fact = F.col("doc_id").cast("string").alias("fact_id")
    tables.put("facts", t.documents.select(fact, F.coalesce("source", F.lit("?")).alias("case_id"), F.col("lang").alias("role_id")))
    tables.put("edges", t.labels.select(fact, F.concat(F.lit("p"), F.col("quality").cast("string")).alias("person_id")))
    tables.put("coverage", t.documents.filter("doc_id % 3 = 0").select(fact, F.lit("complete").alias("status")))
    return tables
