"""A catalogue of many shapes over documents as facts: every branch, window, instance and tier, held against SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from casebench.operators import brief, obligations
from casebench.operators.obligations import leaf, obligation
from casebench.plans.registry import Tables, query


def entries() -> list[tuple[dict, list[dict]]]:
    src = lambda k: f"src{k % 20}"
    out = []
    for k in range(20):
        standing = [leaf("all_of", ("thing", "cion"), least=2), leaf("none_of", ("password", "akia"), roles=(src(k + 1), src(k + 2)))]
        out.append(obligation(f"a{k}", (src(k),), standing, "Rien n'atteste {title_fr}", title=f"a {k}", severity="high", externalisable=k % 2 == 0))
        window = [leaf("any_of", ("secret",), after=True, fields=("verbatim_quote",)), leaf("any_of", ("api",), roles=(src(k + 2), src(k + 3)), before=True, least=4)]
        out.append(obligation(f"b{k}", (src(k), src(k + 7)), window, "Rien depuis {title_fr}", title=f"b {k}", trigger_terms=("licen", "copyright"), trigger_roles=(src(k),), trigger_select="latest" if k % 2 else "earliest", deadline_days=20, presence_cap="T2"))
    for k in range(5):
        each = [leaf("all_of", ("th", "en"), any_actor=True, bind=True, least=1 + 2 * k), leaf("all_of", ("token", "key"), any_actor=True)]
        out.append(obligation(f"c{k}", (src(k),), each, "Rien pour {foreach_role} {foreach_key}", title=f"c {k}", foreach=(src(k), src(k + 5), src(k + 6))))
        out.append(obligation(f"d{k}", (src(k),), [leaf("all_of", ("zzzqq",))], "Rien dans {title_fr}", title=f"d {k}", patterns=(f"d{k}?", "d9*", f"d{3 * k}"), gate="ok"))
        out.append(obligation(f"e{k}", (src(k),), [leaf("any_of", ("es",), roles=(src(k), src(k + 1)), before=True)], "Rien de {title_fr}", title=f"e {k}", trigger_terms=(), trigger_roles=(), trigger_select="latest", deadline_days=0, patterns=("nope*",) if k % 2 else ()))
    out.append(obligation("n0", ("nobody",), [leaf("all_of", ("x",))], "Rien de {title_fr}", title="n"))
    out.append(obligation("n1", ("src1",), [leaf("all_of", ("e",))], "Rien de {title_fr}", title="n", trigger_terms=("zzzqq",)))
    return out


def graph(t: Tables) -> dict[str, DataFrame]:
    """Documents as facts of their sources; some undated, ambiguous, defective, held by persons; three quarters of the filing covered."""
    d = t.documents.select(F.col("doc_id").alias("n"), F.col("doc_id").cast("string").alias("fact_id"), F.col("source").alias("actor_role"), F.concat(F.lit("d"), (F.col("doc_id") % 97).cast("string")).alias("source_doc_id"), "text", "lang")
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("n") * 7) % 300).cast("int"))
    none = F.lit(None).cast("string")
    facts = d.select("fact_id", "source_doc_id", "actor_role", F.when(F.col("n") % 5 > 0, day).cast("string").alias("date"), F.col("lang").alias("action"), none.alias("target"), F.col("text").alias("verbatim_quote"), none.alias("distilled_context"))
    person = F.concat(F.lit("p"), (F.col("n") % 11).cast("string")).alias("person_id")
    number = F.substring("source_doc_id", 2, 9).cast("int")
    return {
        "facts": obligations.prepared(facts), "coverage": d.select(F.col("source_doc_id").alias("doc_id"), F.when(number % 4 > 0, "ok").otherwise("parse_failed").alias("status")).distinct(),
        "person_facts": d.filter("n % 4 = 0").select(person, "fact_id"), "person_roles": d.filter("n % 40 = 0").select(person, F.col("actor_role").alias("role")),
        "ambiguous": d.filter("n % 13 = 0").select("fact_id"), "defective": d.filter("n % 17 = 0").select("fact_id"),
    }


def evaluated(t: Tables) -> tuple[DataFrame, dict[str, DataFrame]]:
    g = graph(t)
    return obligations.evaluate(*obligations.catalog(t.spark, entries()), g["facts"], g["coverage"], g["person_facts"], g["person_roles"], g["ambiguous"]), g


def _literal(v) -> str:
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_literal, v)) + "]::VARCHAR[]"
    return "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"


@lru_cache(1)
def _rules_sql() -> str:
    rows = entries()
    table = lambda name, columns, values: f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(_literal(r[c]) for c in columns) + ')' for r in values)})"
    ob = ["obligation_id", "title", "severity", "externalisable", "bearer_roles", "trigger_roles", "trigger_terms", "trigger_select", "deadline_days", "foreach_roles", "doc_id_patterns", "require_gate_status", "absence_tier_cap", "presence_tier_cap", "claim_template"]
    lf = ["obligation_id", "leaf", "branch", "actor_roles", "any_actor", "any_terms", "match_fields", "after_trigger", "before_or_at_trigger", "bind_to_foreach", "min_count"]
    return f"""{table("ob", ob, [o for o, _ in rows])}, {table("lf", lf, [x for _, ls in rows for x in ls])},
f AS (SELECT doc_id AS n, CAST(doc_id AS VARCHAR) AS id, source AS role, 'd' || (doc_id % 97) AS doc, CASE WHEN doc_id % 5 > 0 THEN DATE '2024-01-01' + CAST((doc_id * 7) % 300 AS INT) END AS day, coalesce(lang, '') AS action, strip_accents(lower(coalesce(text, ''))) AS quote, doc_id % 13 = 0 AS unsure, 'p' || (doc_id % 11) AS person FROM documents),
cov AS (SELECT DISTINCT doc, CASE WHEN CAST(substr(doc, 2) AS INT) % 4 > 0 THEN 'ok' ELSE 'parse_failed' END AS status FROM f),
t0 AS (SELECT obligation_id, trigger_select, id, day, doc FROM ob JOIN f ON trigger_terms IS NOT NULL AND (len(trigger_roles) = 0 OR (list_contains(trigger_roles, role) AND NOT unsure)) AND (len(trigger_terms) = 0 OR len(list_filter(trigger_terms, lambda x: contains(action || '  ' || quote, x))) > 0)),
t1 AS (SELECT obligation_id, any_value(trigger_select) AS s, min(id) AS lowest, min((day, id, doc)) FILTER (day IS NOT NULL) AS a, max((day, id, doc)) FILTER (day IS NOT NULL) AS b, min((id, doc)) AS u, count(DISTINCT day) > 1 AS several FROM t0 GROUP BY 1),
t AS (SELECT obligation_id, several, CASE WHEN a IS NULL THEN lowest WHEN s = 'latest' THEN struct_extract_at(b, 2) ELSE struct_extract_at(a, 2) END AS tid, CASE WHEN a IS NULL THEN NULL WHEN s = 'latest' THEN struct_extract_at(b, 1) ELSE struct_extract_at(a, 1) END AS tday, CASE WHEN a IS NULL THEN struct_extract_at(u, 2) WHEN s = 'latest' THEN struct_extract_at(b, 3) ELSE struct_extract_at(a, 3) END AS tdoc FROM t1),
pr AS (SELECT DISTINCT person, role FROM f WHERE n % 40 = 0),
i AS (SELECT ob.obligation_id, NULL AS frole, NULL AS fkey FROM ob WHERE foreach_roles IS NULL UNION ALL SELECT ob.obligation_id, pr.role, pr.person FROM ob JOIN pr ON list_contains(foreach_roles, pr.role)),
o AS (SELECT i.*, row_number() OVER () AS k, ob.* EXCLUDE (obligation_id), t.* EXCLUDE (obligation_id), trigger_terms IS NULL OR tid IS NOT NULL AS fires FROM i JOIN ob USING (obligation_id) LEFT JOIN t USING (obligation_id)),
h0 AS (SELECT lf.*, CASE WHEN len(actor_roles) > 0 THEN actor_roles WHEN any_actor THEN [] ELSE bearer_roles END AS roles, tday FROM lf JOIN ob USING (obligation_id) LEFT JOIN t USING (obligation_id)),
h1 AS (SELECT h0.obligation_id, h0.leaf, f.id, f.day, f.doc, f.person, f.n FROM h0 JOIN f ON (len(roles) = 0 OR (list_contains(roles, role) AND NOT unsure))
  AND (NOT after_trigger OR f.day IS NULL OR tday IS NULL OR f.day >= tday) AND (NOT before_or_at_trigger OR f.day IS NULL OR tday IS NULL OR f.day <= tday)
  AND len(list_filter(any_terms, lambda x: contains(CASE WHEN list_contains(match_fields, 'action') THEN action ELSE '' END || '  ' || quote, x))) > 0),
h AS (SELECT o.k, lf.leaf, lf.branch, lf.min_count, h1.id, h1.day, h1.doc FROM o JOIN lf USING (obligation_id) LEFT JOIN h1 ON o.fires AND h1.obligation_id = o.obligation_id AND h1.leaf = lf.leaf AND (NOT lf.bind_to_foreach OR (h1.n % 4 = 0 AND h1.person = o.fkey))),
l AS (SELECT k, leaf, branch, count(id) >= any_value(min_count) AS enough FROM h GROUP BY 1, 2, 3),
ok AS (SELECT k, coalesce(bool_and(enough) FILTER (branch = 'all_of'), true) AND coalesce(bool_or(enough) FILTER (branch = 'any_of'), true) AND NOT coalesce(bool_or(enough) FILTER (branch = 'none_of'), false) AS holds FROM l GROUP BY 1),
m AS (SELECT k, list(DISTINCT id ORDER BY id) FILTER (id IS NOT NULL AND branch <> 'none_of') AS ids, min(day) FILTER (branch <> 'none_of') AS first FROM h GROUP BY 1),
c0 AS (SELECT o.k, f.id, len(list_filter((SELECT flatten(list(any_terms)) FROM lf WHERE lf.obligation_id = o.obligation_id), lambda x: contains(action || '  ' || quote, x))) AS found FROM o JOIN f ON fires AND list_contains(bearer_roles, role) AND (fkey IS NULL OR (f.n % 4 = 0 AND f.person = fkey))),
c AS (SELECT k, list(id ORDER BY p) AS cand FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY found DESC, id) AS p FROM c0) WHERE p <= 8 GROUP BY 1),
s0 AS (SELECT DISTINCT o.k, x.doc, require_gate_status AS gate FROM o JOIN (SELECT DISTINCT doc, role FROM f) x ON CASE WHEN len(doc_id_patterns) > 0 THEN len(list_filter(doc_id_patterns, lambda g: x.doc GLOB g)) > 0 ELSE list_contains(bearer_roles, x.role) OR (fires AND x.doc = tdoc) END),
s AS (SELECT k, count(*) AS scope, count(*) FILTER (status = gate) AS verified FROM s0 LEFT JOIN cov USING (doc) GROUP BY 1),
e AS (SELECT o.*, CASE WHEN fires THEN coalesce(ids, []) ELSE [] END AS ids, CASE WHEN fires THEN coalesce(cand, []) ELSE [] END AS cand, coalesce(scope, 0) AS scope, coalesce(verified, 0) AS verified, date_diff('day', tday + deadline_days, first) AS late,
  CASE WHEN NOT fires THEN 'not_triggered' WHEN holds THEN CASE WHEN NOT coalesce(several, false) AND date_diff('day', tday + deadline_days, first) > 0 THEN 'window_breach' ELSE 'satisfied' END WHEN coalesce(verified, 0) > 0 THEN 'gap' ELSE 'unverifiable' END AS status
  FROM o LEFT JOIN ok USING (k) LEFT JOIN m USING (k) LEFT JOIN c USING (k) LEFT JOIN s USING (k)),
u AS (SELECT k, count(*) FILTER (CAST(x AS BIGINT) % 17 = 0) AS bad, count(DISTINCT f.doc) AS docs, bool_and(cov.status = 'ok') AS docs_ok FROM (SELECT k, unnest(CASE WHEN status IN ('satisfied', 'window_breach') THEN ids ELSE cand END) AS x FROM e) JOIN f ON f.id = x JOIN cov ON cov.doc = f.doc GROUP BY 1),
r AS (SELECT e.*, CASE WHEN status IN ('satisfied', 'window_breach') THEN CASE WHEN len(ids) > 0 AND bad > 0 THEN 'T5 presence_defaut_integrite' WHEN docs >= 2 AND docs_ok THEN 'T1 presence_multi_source_couvert' WHEN len(ids) > 0 THEN 'T2 presence_source_unique' ELSE 'T5 presence_sans_fait' END
  WHEN coalesce(bad, 0) > 0 THEN 'T5 absence_defaut_integrite' WHEN scope > 0 AND verified = scope THEN 'T3 absence_perimetre_couvert' WHEN verified = 0 THEN 'T5 absence_perimetre_non_couvert' ELSE 'T4 absence_perimetre_partiellement_couvert' END AS tb FROM e LEFT JOIN u USING (k) WHERE status <> 'not_triggered')"""


@query(f"""WITH {_rules_sql()} SELECT obligation_id, frole AS foreach_role, fkey AS foreach_key, status, len(ids) AS matched, md5(array_to_string(ids, ',')) AS ids, array_to_string(cand, ',') AS candidates, tid AS trigger_id, tday AS trigger_day, coalesce(several, false) AS trigger_ambiguous, CASE WHEN status = 'window_breach' THEN late END AS breach_days, scope, verified FROM e""")
def case_rules(t):
    """Every obligation and instance of the catalogue: status, what matched, candidates, trigger, lateness, scope."""
    e = evaluated(t)[0]
    return e.select("obligation_id", "foreach_role", "foreach_key", "status", F.size("matched").cast("long").alias("matched"), F.md5(F.array_join("matched", ",").cast("binary")).alias("ids"), F.array_join("candidates", ",").alias("candidates"), "trigger_id", "trigger_day", "trigger_ambiguous", F.col("breach_days").cast("long").alias("breach_days"), F.size("scope_docs").cast("long").alias("scope"), F.col("verified_docs").cast("long").alias("verified"))


@query(f"""WITH {_rules_sql()} SELECT concat_ws('|', obligation_id, frole, fkey) AS subject, status, greatest(left(tb, 2), CASE WHEN status IN ('satisfied', 'window_breach') THEN presence_tier_cap ELSE absence_tier_cap END) AS tier, substr(tb, 4) AS tier_basis, CASE WHEN status = 'satisfied' THEN 'info' ELSE severity END AS severity, externalisable AND status <> 'satisfied' AS externalisable,
concat_ws(' · ', 'statut=' || status, 'faits_retenus=' || len(ids), 'périmètre=' || verified || '/' || scope || ' document(s) vérifié(s)', 'déclencheur=' || tid || ' (' || coalesce(CAST(tday AS VARCHAR), 'sans date') || ')', CASE WHEN status = 'window_breach' THEN 'retard=' || late || ' jour(s)' WHEN several THEN 'échéance non testée : date du fait déclencheur ambiguë dans le dossier' END,
  CASE WHEN len(ids) > 0 THEN 'faits=' || array_to_string(ids[1:6], ', ') WHEN len(cand) > 0 THEN 'candidats=' || array_to_string(cand[1:6], ', ') END) AS evidence,
CASE status WHEN 'gap' THEN replace(replace(replace(claim_template, '{{foreach_role}}', coalesce(frole, '')), '{{foreach_key}}', coalesce(fkey, '')), '{{title_fr}}', title) WHEN 'satisfied' THEN 'Exécution attestée : ' || title || coalesce(' (' || frole || ' : ' || fkey || ')', '') WHEN 'window_breach' THEN 'Exécution tardive : ' || title || coalesce(' (' || frole || ' : ' || fkey || ')', '') ELSE 'Exécution non vérifiable : ' || title || coalesce(' (' || frole || ' : ' || fkey || ')', '') END AS claim FROM r""")
def case_rule_findings(t):
    """The findings of all that the catalogue triggers, with tier, basis, evidence and claim."""
    e, g = evaluated(t)
    return obligations.findings(e, g["facts"], g["coverage"], g["defective"]).select("subject", "status", "tier", "tier_basis", "severity", "externalisable", "evidence", "claim")


@query("""WITH v AS (SELECT 'o' || (doc_id % 7) AS o, CAST(doc_id AS VARCHAR) AS f, 'm1' AS j, 'q' || quality AS l FROM labels UNION ALL SELECT 'o' || (doc_id % 7), CAST(doc_id AS VARCHAR), 'm2', 'q' || toxic FROM labels),
c AS (SELECT o, f, j, l, count(*) AS n FROM v WHERE l IS NOT NULL GROUP BY ALL), m AS (SELECT o, f, j, arg_min(l, (-n, l)) AS l FROM c GROUP BY ALL)
SELECT 'divergence|' || o || '|' || f AS subject, 'Lecture divergente d''une pièce : ' || o AS claim, 'fait=' || f || ' · ' || string_agg(j || '=' || l, ', ' ORDER BY j) || ' · ' || string_agg(j || ' : ', ' ‖ ' ORDER BY j) AS evidence, 'T5' AS tier, false AS externalisable FROM m GROUP BY o, f HAVING count(DISTINCT l) > 1""")
def divergence_findings(t):
    """Labels as two judges' readings of each document: where they differ, a finding that never leaves."""
    of = lambda judge, c: t.labels.select(F.concat(F.lit("o"), (F.col("doc_id") % 7).cast("string")).alias("obligation_id"), F.col("doc_id").cast("string").alias("fact_id"), F.lit(judge).alias("judge"), F.concat(F.lit("q"), F.col(c).cast("string")).alias("label"), F.lit(None).cast("string").alias("reason"))
    titles = t.spark.createDataFrame([(f"o{k}", None) for k in range(7)], "obligation_id string, title string")
    facts = t.labels.select(F.col("doc_id").cast("string").alias("fact_id"), F.col("doc_id").cast("string").alias("doc_id")).distinct()
    return brief.divergences(of("m1", "quality").unionByName(of("m2", "toxic")), titles, facts).select("subject", "claim", "evidence", "tier", "externalisable")
