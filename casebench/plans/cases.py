"""Obligations, contradictions, findings and integrity over orders, lineitems and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StructField, StructType

from casebench.functions import scalars
from casebench.operators import contradictions, cycle, findings, integrity, obligations, persons
from casebench.plans.registry import Tables, query
from casebench.schemas import FINDING
from casebench.sources import sinks

#: An order of these priorities must ship within so many days.
URGENT, DAYS = ("1-URGENT", "2-HIGH"), 90

_STATUS_SQL = f"""
e AS (SELECT o_orderkey, any_value(o_orderpriority) AS p, any_value(o_orderstatus) AS s, CAST(any_value(o_orderdate) AS DATE) AS d,
    CAST(min(CASE WHEN l_shipdate >= o_orderdate THEN l_shipdate END) AS DATE) AS f, count(DISTINCT CASE WHEN l_shipdate >= o_orderdate THEN l_suppkey END) AS n
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
s AS (SELECT o_orderkey, n, s AS os, CASE WHEN p NOT IN ('1-URGENT', '2-HIGH') THEN 'not_triggered' WHEN f > d + {DAYS} THEN 'window_breach' WHEN f IS NOT NULL THEN 'satisfied' WHEN s = 'F' THEN 'gap' ELSE 'unverifiable' END AS status,
    date_diff('day', d + {DAYS}, f) AS late FROM e),
r AS (SELECT o_orderkey, status, CASE WHEN status = 'window_breach' THEN late END AS breach_days, CASE WHEN status = 'not_triggered' THEN NULL WHEN status IN ('satisfied', 'window_breach') THEN CASE WHEN n >= 2 AND os = 'F' THEN 'T1' ELSE 'T2' END WHEN os = 'F' THEN 'T3' ELSE 'T5' END AS tier FROM s)
"""


def shipping(t: Tables) -> DataFrame:
    """(o_orderkey, status, breach_days, tier): one aggregation of lineitem by order, joined to orders on the key they share."""
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", F.to_date("o_orderdate").alias("d"), "o_orderdate")
    j = o.join(t.lineitem.select("l_orderkey", "l_suppkey", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    after = F.col("l_shipdate") >= F.col("o_orderdate")
    e = j.groupBy("o_orderkey", "o_orderpriority", "o_orderstatus", "d").agg(F.to_date(F.min(F.when(after, F.col("l_shipdate")))).alias("f"), F.count_distinct(F.when(after, F.col("l_suppkey"))).alias("n"))
    due, found, covered = F.date_add("d", DAYS), F.col("f").isNotNull(), F.col("o_orderstatus") == "F"
    status = F.when(~F.col("o_orderpriority").isin(*URGENT), "not_triggered").when(F.col("f") > due, "window_breach").when(found, "satisfied").when(covered, "gap").otherwise("unverifiable")
    one = F.lit(1)
    tier = obligations.tier_of(status, F.when(found, 1).otherwise(0), F.lit(0), F.col("n"), covered, F.lit(True), one, F.when(covered, 1).otherwise(0))
    return e.select("o_orderkey", status.alias("status"), F.when(status == "window_breach", F.datediff("f", due)).cast("long").alias("breach_days"), tier["tier"].alias("tier"))


@query(f"WITH {_STATUS_SQL} SELECT o_orderkey, status, breach_days, tier FROM r")
def obligation_deadline_status(t):
    return shipping(t)


@query(f"WITH {_STATUS_SQL} SELECT status, tier, count(*) AS n, max(breach_days) AS latest FROM r GROUP BY status, tier")
def obligation_tier(t):
    return shipping(t).groupBy("status", "tier").agg(F.count(F.lit(1)).alias("n"), F.max("breach_days").alias("latest"))


@query("""SELECT l_suppkey, count(*) AS scope, count(*) FILTER (l_linestatus = 'F') AS verified,
  CASE WHEN count(*) FILTER (l_linestatus = 'F') = count(*) THEN 'covered' WHEN count(*) FILTER (l_linestatus = 'F') = 0 THEN 'uncovered' ELSE 'partial' END AS coverage FROM lineitem GROUP BY l_suppkey""")
def obligation_scope_coverage(t):
    n, ok = F.count(F.lit(1)), F.count_if(F.col("l_linestatus") == "F")
    return t.lineitem.groupBy("l_suppkey").agg(n.alias("scope"), ok.alias("verified"), F.when(ok == n, "covered").when(ok == 0, "uncovered").otherwise("partial").alias("coverage"))


@query("""WITH e AS (SELECT user_id, event_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup')
SELECT user_id, count(DISTINCT day) > 1 AS ambiguous, arg_min(event_id, (day, event_id)) AS earliest, CAST(min(day) AS DATE) AS first_day,
  (SELECT min(x.event_id) FROM e x WHERE x.user_id = e.user_id AND x.day = max(e.day)) AS latest FROM e GROUP BY user_id""")
def trigger_ambiguity(t):
    e = t.events.filter("event_type = 'signup'").select("user_id", "event_id", F.to_date("ts").alias("day"))
    return e.groupBy("user_id").agg((F.count_distinct("day") > 1).alias("ambiguous"), F.min(F.struct("day", "event_id"))["event_id"].alias("earliest"), F.min("day").alias("first_day"), (-F.max(F.struct("day", (-F.col("event_id")).alias("e")))["e"]).alias("latest"))


@query("""WITH p AS (SELECT user_id, event_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, CAST(min(ts) AS DATE) AS s FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT user_id, count(*) AS evidence, count(*) FILTER (s IS NULL OR d >= s) AS after_or_unknown FROM p LEFT JOIN s USING (user_id) GROUP BY user_id""")
def temporal_null_pass(t):
    s = t.events.filter("event_type = 'signup'").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("s"))
    p = t.events.filter("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("d"))
    return p.join(s, "user_id", "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("evidence"), F.count_if(scalars.after_or_unknown(F.col("d"), F.col("s"))).alias("after_or_unknown"))


@query("""WITH b AS (SELECT o_orderkey AS id, o_custkey || ':' || CAST(floor(o_totalprice / 1000) AS BIGINT) AS k, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS r FROM orders)
SELECT a.k AS key, a.id AS a, b.id AS b FROM b a JOIN b ON a.k = b.k AND a.id < b.id AND (a.d <> b.d OR a.r <> b.r) ORDER BY key, a, b LIMIT 40""")
def contradiction_amount_pairs(t):
    key = F.concat_ws(":", F.col("o_custkey").cast("string"), F.floor(F.col("o_totalprice") / 1000).cast("string"))
    b = t.orders.select(F.lit("montant").alias("bucket"), key.alias("key"), F.col("o_orderkey").alias("fact_id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("role"))
    return contradictions.collisions(b).select("key", "a", "b").orderBy("key", "a", "b").limit(contradictions.CAP)


@query("""WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END AS s FROM events)
SELECT 'u' || p.user_id || '|le ' || p.d || '|accepter/refuser' AS key, least(p.event_id, n.event_id) AS a, greatest(p.event_id, n.event_id) AS b FROM e p JOIN e n ON p.user_id = n.user_id AND p.d = n.d AND p.s = 1 AND n.s = -1""")
def contradiction_polarity_pairs(t):
    action = F.when(F.col("event_type") == "purchase", "Acceptée par écrit").when(F.col("event_type") == "error", "REFUS d'y donner suite").otherwise("sans objet")
    facts = t.events.select(F.col("event_id").alias("fact_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor_role"), F.concat(F.lit("Le "), F.to_date("ts").cast("string")).alias("target"), action.alias("action"))
    return contradictions.opposites(facts).select("key", "a", "b")


_CASE_SQL = """f AS (SELECT CAST(event_id AS VARCHAR) AS fact_id, event_id AS n, 'u' || (user_id % 40) AS role, 'd' || user_id AS doc, CAST(ts AS DATE) AS day, event_type || ' ' || CAST(floor(value) AS BIGINT) AS quote FROM events),
t AS (SELECT role, min(day) AS t, min(day) <> max(day) AS several FROM f WHERE contains(quote, 'signup 77') GROUP BY role),
r AS (SELECT DISTINCT role FROM f),
h AS (SELECT f.role, count(*) AS hits, min(f.day) AS d, count(DISTINCT doc) AS docs, bool_and(CAST(right(doc, 1) AS INT) % 2 = 0) AS docs_ok FROM f JOIN t USING (role) WHERE contains(quote, 'purchase 1') AND f.day >= t.t GROUP BY f.role),
s AS (SELECT role, count(DISTINCT doc) AS scope, count(DISTINCT doc) FILTER (CAST(right(doc, 1) AS INT) % 2 = 0) AS verified FROM f GROUP BY role),
e AS (SELECT r.role, t.t IS NOT NULL AS fires, coalesce(hits, 0) AS hits, coalesce(several, false) AS several, date_diff('day', t.t + 5, h.d) AS late, scope, verified, docs, docs_ok FROM r LEFT JOIN t USING (role) LEFT JOIN h USING (role) JOIN s USING (role)),
v AS (SELECT *, CASE WHEN NOT fires THEN 'not_triggered' WHEN hits >= 3 THEN CASE WHEN late > 0 AND NOT several THEN 'window_breach' ELSE 'satisfied' END WHEN verified > 0 THEN 'gap' ELSE 'unverifiable' END AS status FROM e)"""


def case(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evaluations, facts, coverage): events as facts of forty roles, each of which must purchase thrice after a rare signup."""
    quote = F.concat_ws(" ", "event_type", F.floor("value").cast("string"))
    role = F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string"))
    facts = t.events.select(F.col("event_id").cast("string").alias("fact_id"), F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("source_doc_id"), role.alias("actor_role"), F.to_date("ts").cast("string").alias("date"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("target"), quote.alias("verbatim_quote"), F.lit(None).cast("string").alias("distilled_context"))
    facts = obligations.prepared(facts)
    of = lambda k: obligations.obligation(f"o{k}", (f"u{k}",), [obligations.leaf("all_of", ("purchase 1",), after=True, least=3)], "Rien n'atteste {title_fr}", title=f"u{k}", trigger_terms=("Signup 77",), trigger_roles=(f"u{k}",), deadline_days=5)
    catalog = obligations.catalog(t.spark, [of(k) for k in range(40)])
    coverage = t.events.select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("doc_id"), F.when(F.col("user_id") % 2 == 0, "ok").otherwise("parse_failed").alias("status")).distinct()
    return obligations.evaluate(*catalog, facts, coverage), facts, coverage


@query(f"WITH {_CASE_SQL} SELECT 'o' || substr(role, 2) AS obligation_id, status, CASE WHEN fires THEN hits ELSE 0 END AS matched, CASE WHEN status = 'window_breach' THEN late END AS breach_days, scope, verified FROM v")
def case_evaluation(t):
    return case(t)[0].filter(F.size("scope_docs") > 0).select("obligation_id", "status", F.size("matched").cast("long").alias("matched"), F.col("breach_days").cast("long").alias("breach_days"), F.size("scope_docs").cast("long").alias("scope"), F.col("verified_docs").cast("long").alias("verified"))


@query(f"""WITH {_CASE_SQL} SELECT 'o' || substr(role, 2) AS obligation_id, status, CASE WHEN status IN ('satisfied', 'window_breach') THEN CASE WHEN docs >= 2 AND docs_ok THEN 'T1' ELSE 'T2' END WHEN verified = scope THEN 'T3' WHEN verified = 0 THEN 'T5' ELSE 'T4' END AS tier,
  'statut=' || status || ' · ' AS head, CASE status WHEN 'gap' THEN 'Rien n''atteste ' || role WHEN 'satisfied' THEN 'Exécution attestée : ' || role WHEN 'window_breach' THEN 'Exécution tardive : ' || role ELSE 'Exécution non vérifiable : ' || role END AS claim FROM v WHERE fires""")
def case_findings(t):
    """The findings of all obligations that were triggered, met or not."""
    evaluations, facts, coverage = case(t)
    made = obligations.findings(evaluations, facts, coverage)
    return made.select("obligation_id", "status", "tier", F.left("evidence", F.length("status") + 10).alias("head"), "claim")


@query("""WITH f AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS role, 'd' || user_id AS doc, value < 100 AS undated, event_id % 7 = 0 AS loose, user_id, event_id FROM events),
u AS (SELECT 'dangling_edge' AS kind, user_id || '|' || (event_id + 1000000000) AS m FROM f WHERE event_id % 11 = 0
UNION ALL SELECT 'uncatalogued_role', role FROM f WHERE role NOT IN ('view', 'click', 'purchase')
UNION ALL SELECT 'document_without_facts', 'd' || doc_id FROM documents WHERE 'd' || doc_id NOT IN (SELECT doc FROM f)
UNION ALL SELECT 'document_not_verified', 'd' || doc_id FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 'undated_fact', id FROM f WHERE undated UNION ALL SELECT 'unanchored_fact', id FROM f WHERE loose UNION ALL SELECT 'unparsed_rows', '4 lignes'),
d AS (SELECT DISTINCT kind, m FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY m) AS i FROM d)
SELECT kind, count(*) AS n, string_agg(m, ',' ORDER BY m) FILTER (i <= 5) AS sample FROM k GROUP BY kind""")
def integrity_missing(t):
    doc = lambda c: F.concat(F.lit("d"), F.col(c).cast("string"))
    facts = t.events.select(F.col("event_id").cast("string").alias("fact_id"), F.col("event_type").alias("actor_role"), doc("user_id").alias("source_doc_id"), F.when(F.col("value") >= 100, F.to_date("ts").cast("string")).alias("date"), F.when(F.col("event_id") % 7 != 0, "c").alias("source_chunk_id"))
    roles = t.spark.createDataFrame([("view",), ("click",), ("purchase",)], "role_id string")
    edges = t.events.select("user_id", F.when(F.col("event_id") % 11 == 0, F.col("event_id") + 1_000_000_000).otherwise(F.col("event_id")).cast("string").alias("fact_id")).withColumnRenamed("user_id", "person_id")
    documents = t.documents.select(doc("doc_id").alias("doc_id"))
    coverage = t.documents.select(doc("doc_id").alias("doc_id"), F.when(F.col("doc_id") % 3 == 0, "parse_failed").otherwise("ok").alias("status"))
    return integrity.integrity(facts, roles, edges, documents, coverage, rejected=4).select("kind", "n", F.array_join("sample", ",").alias("sample"))


@query("SELECT o_orderkey, substr(sha256('check|' || o_orderkey || '|' || o_orderpriority), 1, 12) AS id, sha256(o_custkey || '|' || o_orderkey) AS full_id, substr(sha1(o_orderkey || '|' || o_orderstatus), 1, 12) AS entry_id FROM orders")
def finding_ids(t):
    return t.orders.select("o_orderkey", scalars.short_id(F.lit("check"), F.col("o_orderkey"), F.col("o_orderpriority")).alias("id"), scalars.short_id(F.col("o_custkey"), F.col("o_orderkey"), length=64).alias("full_id"), scalars.short_sha1(F.col("o_orderkey"), F.col("o_orderstatus")).alias("entry_id"))


def order_findings(t: Tables, cycle: int) -> DataFrame:
    """Findings of a cycle: late orders of customers by the year's parity, so that two cycles overlap in part."""
    o = t.orders.filter((F.year("o_orderdate") + F.col("o_custkey")) % 3 != cycle)
    tier = F.when(F.col("o_totalprice") > 300_000 + 20_000 * cycle, "T1").when(F.col("o_totalprice") > 100_000, "T2").otherwise("T4")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("check").alias("pass_name"), F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("subject"), F.lit("late").alias("claim"), F.concat(F.lit("cycle "), F.lit(cycle).cast("string")).alias("evidence"), tier.alias("tier"), F.lit("medium").alias("severity"), F.lit("high").alias("confidence"), (F.col("o_orderstatus") != "P").alias("externalisable"),
                    F.struct(F.array(F.col("o_orderkey").cast("string")).alias("fact_ids"), F.array().cast("array<string>").alias("doc_ids"), F.array().cast("array<string>").alias("chunk_ids"), F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("person_ids"), F.array().cast("array<string>").alias("candidate_fact_ids"), F.array().cast("array<string>").alias("scope_doc_ids"), F.lit(None).cast("string").alias("trigger_fact_id")).alias("evidence_pointers"))


def store_after(t: Tables) -> DataFrame:
    empty = t.spark.createDataFrame([], StructType([StructField(f.name, f.dataType) for f in FINDING]))
    one = findings.upserted(empty, order_findings(t, 0), F.lit("2026-01-01"))
    two = findings.upserted(one, order_findings(t, 1), F.lit("2026-01-02"))
    return findings.reconciled(two, order_findings(t, 1).select("id"), "check", True, F.lit("2026-01-02"))


_STORE_SQL = """
f AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey, o_orderstatus <> 'P' AS ext, (year(o_orderdate) + o_custkey) % 3 AS m, o_totalprice AS p FROM orders),
g AS (SELECT *, m <> 0 AS c0, m <> 1 AS c1, CASE WHEN p > 300000 THEN 'T1' WHEN p > 100000 THEN 'T2' ELSE 'T4' END AS t0, CASE WHEN p > 320000 THEN 'T1' WHEN p > 100000 THEN 'T2' ELSE 'T4' END AS t1 FROM f),
st AS (SELECT id, o_custkey, ext, CASE WHEN c1 THEN t1 ELSE t0 END AS tier, CASE WHEN c1 THEN 'open' ELSE 'resolved' END AS status, CASE WHEN c0 THEN '2026-01-01' ELSE '2026-01-02' END AS first_seen,
  CASE WHEN c1 THEN '2026-01-02' ELSE '2026-01-01' END AS last_seen, CASE WHEN NOT c1 THEN '2026-01-02' END AS resolved_at, CAST(c0 AND c1 AND t0 <> t1 AS INT) AS moves, CASE WHEN c1 THEN 'cycle 1' ELSE 'cycle 0' END AS evidence FROM g WHERE c0 OR c1)
"""


@query(f"WITH {_STORE_SQL} SELECT id, tier, first_seen, last_seen, moves, evidence FROM st")
def findings_upsert(t):
    return store_after(t).select("id", "tier", "first_seen", "last_seen", F.size("calibration").alias("moves"), "evidence")


@query(f"WITH {_STORE_SQL} SELECT status, tier, count(*) AS n, count(resolved_at) AS resolved FROM st GROUP BY status, tier")
def findings_reconcile(t):
    return store_after(t).groupBy("status", "tier").agg(F.count(F.lit(1)).alias("n"), F.count("resolved_at").alias("resolved"))


@query(f"""WITH {_STORE_SQL}, o AS (SELECT * FROM st WHERE status = 'open' AND ext AND tier IN ('T1', 'T2')), p AS (SELECT DISTINCT 'c' || o_custkey AS pid FROM o), l AS (SELECT pid, 'personne#' || dense_rank() OVER (ORDER BY pid) AS label FROM p)
SELECT id, tier, label AS person FROM o JOIN l ON pid = 'c' || o_custkey""")
def gate_outbound(t):
    return findings.outbound(store_after(t), "demo", ("demo",)).select("id", "tier", F.element_at("evidence_pointers.person_ids", 1).alias("person"))


@query("""SELECT tier, pass_name, count(*) AS n, min(subject) AS first_subject FROM (WITH """ + _STORE_SQL + """ SELECT tier, 'check' AS pass_name, 'customer ' || o_custkey AS subject FROM st WHERE status = 'open') GROUP BY tier, pass_name""")
def findings_digest(t):
    return findings.digest(store_after(t)).groupBy("tier", "pass_name").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("first_subject"))


@query("""WITH u AS (SELECT p_partkey, p_name, p_retailprice, 0 AS origin FROM part UNION ALL SELECT p_partkey, upper(p_name), p_retailprice + 1, 1 FROM part WHERE p_size > 40)
SELECT p_partkey, arg_max(p_name, origin) AS p_name, round(arg_max(p_retailprice, origin), 2) AS p_retailprice, CAST(max(origin) AS INT) AS origin FROM u GROUP BY p_partkey""")
def catalog_overlay(t):
    base = t.part.select("p_partkey", "p_name", "p_retailprice", "p_size")
    over = base.filter("p_size > 40").withColumns({"p_name": F.upper("p_name"), "p_retailprice": F.col("p_retailprice") + 1})
    return sinks.merged_catalog(base.drop("p_size"), over.drop("p_size"), key="p_partkey").withColumn("p_retailprice", F.round("p_retailprice", 2))


@query("""SELECT 'orders' AS tbl, count(*) - count(DISTINCT o_orderkey) AS duplicates, count(*) FILTER (o_orderkey IS NULL) AS nulls FROM orders
UNION ALL SELECT 'documents', count(*) - count(DISTINCT doc_id), count(*) FILTER (doc_id IS NULL) FROM documents
UNION ALL SELECT 'lineitem', (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)), count(*) FILTER (l_orderkey IS NULL) FROM lineitem""")
def duplicate_keys(t):
    of = lambda name, df, key: df.agg(F.lit(name).alias("tbl"), (F.count(F.lit(1)) - F.count_distinct(*key)).alias("duplicates"), F.count_if(F.col(key[0]).isNull()).alias("nulls"))
    return of("orders", t.orders, ["o_orderkey"]).unionByName(of("documents", t.documents, ["doc_id"])).unionByName(of("lineitem", t.lineitem, ["l_orderkey", "l_linenumber"]))


@query("""SELECT 'shared' AS presence, count(*) AS n FROM (SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer)
UNION ALL SELECT 'customer_only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'orders_only', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)""")
def id_set_coverage(t):
    a, b = t.orders.select(F.col("o_custkey").alias("k")).distinct(), t.customer.select(F.col("c_custkey").alias("k"))
    n = lambda name, df: df.agg(F.lit(name).alias("presence"), F.count(F.lit(1)).alias("n"))
    return n("shared", a.intersect(b)).unionByName(n("customer_only", b.subtract(a))).unionByName(n("orders_only", a.subtract(b)))


@query("""WITH f AS (SELECT event_type AS role, CAST(ts AS DATE) AS d, event_id, row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE), event_id) AS n FROM events) SELECT role, event_id, d AS date FROM f WHERE n <= 30""")
def facts_cap_by_role(t):
    f = t.events.select(F.col("event_type").alias("actor_role"), F.to_date("ts").alias("date"), F.col("event_id").alias("fact_id"))
    return persons.capped_facts(f).select(F.col("actor_role").alias("role"), F.col("fact_id").alias("event_id"), "date")


@query("""WITH a AS (SELECT CAST(user_id AS VARCHAR) AS r, event_type AS a, min((CAST(ts AS DATE), event_id)) AS o FROM events GROUP BY 1, 2), k AS (SELECT r, a, row_number() OVER (PARTITION BY r ORDER BY o) AS n FROM a)
SELECT r AS role, string_agg(a, ' ; ' ORDER BY n) AS actions FROM k WHERE n <= 5 GROUP BY r""")
def first_distinct_actions(t):
    f = t.events.select(F.col("user_id").cast("string").alias("actor_role"), F.col("event_type").alias("action"), F.to_date("ts").alias("date"), F.col("event_id").alias("fact_id"))
    return persons.first_actions(f).select(F.col("actor_role").alias("role"), "actions")


@query("""SELECT event_type AS role_id, arg_min('label ' || user_id, (user_id, 'label ' || user_id)) AS label, count(*) AS fact_count, min(user_id) AS first_doc FROM events GROUP BY event_type""")
def role_catalogue(t):
    f = t.events.select(F.col("event_type").alias("actor_role"), F.col("user_id").alias("source_doc_id"))
    labels = t.events.select(F.col("event_type").alias("role_id"), F.col("user_id").alias("doc_id"), F.concat(F.lit("label "), F.col("user_id").cast("string")).alias("label"))
    return persons.role_catalogue(f, labels)


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS d, l_returnflag || l_linestatus AS r FROM lineitem), p AS (SELECT DISTINCT a.r, b.r AS o FROM d a JOIN d b ON a.d = b.d AND a.r <> b.r), k AS (SELECT r, o, row_number() OVER (PARTITION BY r ORDER BY o) AS n FROM p)
SELECT r AS role, string_agg(o, ',' ORDER BY o) AS others FROM k WHERE n <= 3 GROUP BY r""")
def role_cooccurrence(t):
    f = t.lineitem.select(F.col("l_orderkey").alias("source_doc_id"), F.concat("l_returnflag", "l_linestatus").alias("actor_role"))
    return persons.co_occurring(f).select("role", F.array_join("others", ",").alias("others"))


@query("""WITH m AS (SELECT 'customer' AS role, 'Maître  Dupönt ' || right(c_name, 2) AS name, c_custkey AS pos, CASE WHEN c_acctbal > 5000 THEN 2 WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS c, 'c' || c_custkey AS e FROM customer
  UNION ALL SELECT 'supplier', 'DUPONT ' || right(s_name, 2), 1000000 + s_suppkey, CASE WHEN s_acctbal > 5000 THEN 2 WHEN s_acctbal > 0 THEN 1 ELSE 0 END, 's' || s_suppkey FROM supplier UNION ALL SELECT 'supplier', 'Dupont', 0, 0, 'x'),
k AS (SELECT *, 'dupont ' || right(name, 2) AS key FROM m WHERE name <> 'Dupont'),
r AS (SELECT key, role, max(c) AS c, count(DISTINCT e) AS e FROM k GROUP BY ALL)
SELECT 'demo-' || replace(key, ' ', '-') AS person_id, arg_max(name, (length(name), -pos)) AS name, (SELECT string_agg(role || ':' || ['low', 'medium', 'high'][c + 1] || ':' || e, ',' ORDER BY role) FROM r WHERE r.key = k.key) AS roles, count(DISTINCT name) - 1 AS aliases FROM k GROUP BY key""")
def person_merge(t):
    c = lambda b: F.element_at(F.array(*[F.lit(x) for x in scalars.CONFIDENCES]), F.when(b > 5000, 3).when(b > 0, 2).otherwise(1))
    some = lambda df, role, name, pos, bal, tag, key: df.select(F.lit(role).alias("role_id"), name.alias("name"), F.lit(None).cast("array<string>").alias("aliases"), c(F.col(bal)).alias("confidence"), F.lit(None).cast("string").alias("note"), F.array(F.concat(F.lit(tag), F.col(key).cast("string"))).alias("evidence_fact_ids"), pos.alias("pos"))
    a = some(t.customer, "customer", F.concat(F.lit("Maître  Dupönt "), F.right("c_name", F.lit(2))), F.col("c_custkey"), "c_acctbal", "c", "c_custkey")
    b = some(t.supplier, "supplier", F.concat(F.lit("DUPONT "), F.right("s_name", F.lit(2))), F.col("s_suppkey") + 1_000_000, "s_acctbal", "s", "s_suppkey")
    bare = t.spark.createDataFrame([("supplier", "Dupont", None, "low", None, ["x"], 0)], "role_id string, name string, aliases array<string>, confidence string, note string, evidence_fact_ids array<string>, pos long")
    got = persons.resolved(a.unionByName(b).unionByName(bare), "demo")
    roles = F.array_join(F.transform("role_assignments", lambda r: F.concat_ws(":", r["role_id"], r["confidence"], F.size(r["evidence_fact_ids"]).cast("string"))), ",")
    return got.select("person_id", F.col("canonical_name").alias("name"), roles.alias("roles"), F.size("aliases").cast("long").alias("aliases"))


@query("""WITH g AS (SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'roster ' || c_custkey WHEN c_nationkey = 3 THEN 'pinned ' || c_custkey END AS persona FROM customer),
r AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM g WHERE persona IS NULL), p AS (SELECT 'part ' || p_partkey AS persona, row_number() OVER (ORDER BY p_partkey) AS m FROM part WHERE p_size < 20)
SELECT id AS person_id, persona FROM g WHERE persona IS NOT NULL UNION ALL SELECT r.id, coalesce(p.persona, 'Personne ' || CASE WHEN n - x <= 26 THEN chr(CAST(64 + n - x AS INT)) WHEN n - x <= 702 THEN chr(CAST(65 + (n - x - 27) // 26 AS INT)) || chr(CAST(65 + (n - x - 27) % 26 AS INT)) ELSE chr(CAST(65 + (n - x - 703) // 676 AS INT)) || chr(CAST(65 + (n - x - 703) // 26 % 26 AS INT)) || chr(CAST(65 + (n - x - 703) % 26 AS INT)) END) FROM r LEFT JOIN p ON n = m, (SELECT count(*) AS x FROM p)""")
def persona_assignment(t):
    c = t.customer
    people = c.select(F.col("c_custkey").alias("person_id"))
    roster = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("person_id"), F.concat(F.lit("roster "), F.col("c_custkey").cast("string")).alias("persona"))
    pinned = c.filter("c_nationkey = 3").select(F.col("c_custkey").alias("person_id"), F.concat(F.lit("pinned "), F.col("c_custkey").cast("string")).alias("persona"))
    pool = t.part.filter("p_size < 20").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("persona"))
    return persons.personas(people, roster, pinned, pool)


@query("""SELECT c_custkey AS person_id, CASE WHEN count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) = 1 THEN c_mktsegment || '-' || c_nationkey ELSE c_mktsegment || '-' || c_nationkey || '_' || row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) END AS label FROM customer""")
def numbered_role_labels(t):
    h = t.customer.select(F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("role"), F.col("c_custkey").alias("person_id"))
    return persons.numbered_labels(h).select("person_id", "label")


@query("""SELECT tier, basis, count(*) AS n FROM (SELECT CASE WHEN s IN (0, 1) THEN CASE WHEN m > 0 AND d > 0 THEN 'T5' WHEN docs >= 2 AND ok AND cov THEN 'T1' WHEN m > 0 THEN 'T2' ELSE 'T5' END ELSE CASE WHEN d > 0 THEN 'T5' WHEN NOT cov THEN 'T5' WHEN sc > 0 AND v = sc THEN 'T3' WHEN v = 0 THEN 'T5' ELSE 'T4' END END AS tier,
  CASE WHEN s IN (0, 1) THEN CASE WHEN m > 0 AND d > 0 THEN 'presence_defaut_integrite' WHEN docs >= 2 AND ok AND cov THEN 'presence_multi_source_couvert' WHEN m > 0 THEN 'presence_source_unique' ELSE 'presence_sans_fait' END ELSE CASE WHEN d > 0 THEN 'absence_defaut_integrite' WHEN NOT cov THEN 'absence_perimetre_non_couvert' WHEN sc > 0 AND v = sc THEN 'absence_perimetre_couvert' WHEN v = 0 THEN 'absence_perimetre_non_couvert' ELSE 'absence_perimetre_partiellement_couvert' END END AS basis
  FROM (SELECT l_linenumber % 4 AS s, l_partkey % 3 AS m, CAST(l_suppkey % 7 = 0 AS INT) AS d, l_partkey % 4 AS docs, l_suppkey % 2 = 0 AS ok, l_orderkey % 5 <> 0 AS cov, l_suppkey % 3 AS sc, least(l_partkey % 3, l_suppkey % 3) AS v FROM lineitem)) GROUP BY tier, basis""")
def tier_table(t):
    c = F.col
    status = F.element_at(F.array(*[F.lit(s) for s in ("satisfied", "window_breach", "gap", "unverifiable")]), (c("l_linenumber") % 4 + 1).cast("int"))
    one = obligations.tier_of(status, c("l_partkey") % 3, (c("l_suppkey") % 7 == 0).cast("int"), c("l_partkey") % 4, c("l_suppkey") % 2 == 0, c("l_orderkey") % 5 != 0, c("l_suppkey") % 3, F.least(c("l_partkey") % 3, c("l_suppkey") % 3))
    return t.lineitem.select(one.alias("t")).groupBy("t.tier", "t.basis").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT user_id AS subject, event_id % 3 AS judge, CASE WHEN value < 30 THEN 'met' WHEN value < 60 THEN 'breached' END AS label FROM events),
p AS (SELECT subject, judge, label, count(*) AS n FROM v WHERE label IS NOT NULL GROUP BY ALL), b AS (SELECT subject, judge, max((n, label)) AS t FROM p GROUP BY ALL), s AS (SELECT subject, count(*) AS n, count(DISTINCT t[2]) AS k, min(t[2]) AS l FROM (SELECT subject, [CAST(t[1] AS VARCHAR), t[2]] AS t FROM (SELECT subject, [CAST(struct_extract_at(t, 1) AS VARCHAR), struct_extract_at(t, 2)] AS t FROM b WHERE struct_extract_at(t, 1) >= 2)) GROUP BY subject),
j AS (SELECT subject, count(DISTINCT judge) AS judges FROM v GROUP BY subject)
SELECT CAST(subject AS VARCHAR) AS subject, CASE WHEN coalesce(n, 0) = 0 THEN 'aucun_verdict' WHEN k > 1 THEN 'divergence' WHEN judges = 1 THEN 'juge_unique' WHEN n = judges THEN 'unanime' ELSE 'partiel' END AS outcome, CASE WHEN k = 1 THEN l END AS label FROM j LEFT JOIN s USING (subject)""")
def judges_combined(t):
    v = t.events.select(F.col("user_id").cast("string").alias("subject"), (F.col("event_id") % 3).alias("judge"), F.when(F.col("value") < 30, "met").when(F.col("value") < 60, "breached").alias("label"))
    return obligations.combined_verdicts(v)


@query("""WITH k AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), g AS (SELECT l_suppkey, l_orderkey AS after, lag(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS before FROM k)
SELECT l_suppkey, before, after, after - before - 1 AS missing FROM g WHERE after - before > 1""")
def number_gaps(t):
    return cycle.number_gaps(t.lineitem, "l_orderkey", "l_suppkey")


@query("SELECT count(DISTINCT user_id) AS docs, count(*) AS facts, count(DISTINCT event_type) AS roles, (SELECT count(*) FROM labels WHERE toxic = 1) AS ambiguities FROM events")
def stage_summary(t):
    return cycle.stage_summary(t.events.select(F.col("user_id").alias("source_doc_id"), F.col("event_type").alias("actor_role")), t.labels.filter("toxic = 1"))


@query(f"""WITH {_STORE_SQL} SELECT id, tier, CASE WHEN evidence = 'cycle 1' THEN 'gap' ELSE 'window_breach' END AS outcome FROM st WHERE status = 'open' AND tier <> 'T4'""")
def actionable_findings(t):
    named = F.when(F.col("tier") == "T4", "statut=satisfied").when(F.col("evidence") == "cycle 1", "statut=gap · retard").otherwise("statut=window_breach")
    return cycle.actionable(store_after(t).withColumn("evidence", named)).select("id", "tier", "outcome")
