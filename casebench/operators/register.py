"""The register of roles: classes of identifiers and persons that are one, and the designations that stand for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casebench.functions import phrases, text
from casebench.session import written

# Roles that say where a person stands in a case and not what office they hold, and words that mark a place.
WEAK_ROLES = (
    "heritier", "mandant", "mandataire", "personne_decedee", "titulaire_contrat",
    "heritier_successoral", "heritier_ayant_droit", "heritier_beneficiaire",
    "heritier_representant", "heritier_petit_enfant", "representant_legal",
    "debit_successoral", "plaignant", "donateur",
)
PLACE_MARKERS = ("commune", "voie", "lieu")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) of an undirected graph (a, b): the least node that can be reached; nodes (node) adds those without edges.

    Alternating stars: every node is tied to the least neighbour, first for its larger neighbours, then for the smaller ones,
    until no edge changes; about log(length of the longest path) rounds. Each half round is a minimum by node, aggregated before
    its shuffle, and a join; its edges are written to the shared folder, so a node with a third of all edges is split by
    adaptive execution and a lost executor costs a task. Only three numbers a round reach the driver. A null node is in no edge.
    """
    # from the larger to the smaller
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    every = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    now, before, turn = written(now, "edges"), None, 0
    while True:
        # large star: a node's larger neighbours go to the least of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "large-least")
        large = written(both.filter("v > u").join(least.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: a node and its smaller neighbours go to the least of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "small-least")
        moved = large.join(least.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if before == after:
            break
        before, turn = after, turn + 1
    all_nodes = (every if nodes is None else every.unionByName(nodes.select("node"))).filter("node IS NOT NULL").distinct()
    return all_nodes.join(now.select(F.col("u").alias("__u"), F.col("v").alias("component")), F.col("node") == F.col("__u"), "left").select("node", F.coalesce("component", "node").alias("component"))


def classes(identifiers: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(key, class) of identifiers (key, value): keys that share a value are one class, and so are keys chained by groups (a, b).

    The class is its least key. A group's member that is no identifier still chains others. A null key or value is left out
    as a link; a key without value is a class of its own.
    """
    keyed = lambda c: F.concat(F.lit("k"), F.col(c).cast("string"))
    links = identifiers.filter("key IS NOT NULL AND value IS NOT NULL").select(keyed("key").alias("a"), F.concat(F.lit("v"), F.col("value").cast("string")).alias("b"))
    if groups is not None:
        links = links.unionByName(groups.filter("a IS NOT NULL AND b IS NOT NULL").select(keyed("a").alias("a"), keyed("b").alias("b")))
    found = components(links, identifiers.filter("key IS NOT NULL").select(keyed("key").alias("node"))).filter(F.col("node").startswith("k"))
    mine = found.join(identifiers.select(keyed("key").alias("node"), F.col("key").cast("string").alias("key")).distinct(), "node")
    named = mine.groupBy("component").agg(F.min("key").alias("class"))
    return mine.join(named, "component").select("key", "class")


def in_order(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """df with gapless numbers from 1 within each group, by order (ties by no rule: make it unique).

    Rows are dealt out by ranges of (group, order), so a group with a third of all rows is numbered by many tasks; ranges' counts,
    a row for each task and group, say where each begins. The dealt rows are written to the shared folder first.
    """
    dealt = written(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()), "dealt")
    before = W.partitionBy(*[f"__g{i}" for i in range(len(group))]).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    on = F.col("__part") == F.col("__p")  # with no group, the counts are a row for each task
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    own = dealt.withColumn("__row", F.row_number().over(W.partitionBy(*group, "__part").orderBy(*order)))
    return own.join(starts, on).withColumn(out, (F.col("__start") + F.col("__row")).cast("long")).select(*df.columns, out)


def kind_of(value: Column, places: tuple[str, ...], kept: Column) -> Column:
    """What a replacement stands for: marker, commune, produit (kept as it was on purpose), voie or personne."""
    holds = lambda words, c: reduce(lambda x, w: x | F.contains(c, F.lit(w)), words, F.lit(False))
    folded = phrases.evened_phrase(value)
    street = holds(PLACE_MARKERS, folded) | value.startswith("des ") | value.startswith("du ") | value.startswith("archipel")
    return F.when(value.startswith("["), "marker").when(holds(places, value), "commune").when(kept, "produit").when(street, "voie").otherwise("personne")


def role_identifiers(extras: DataFrame, places: tuple[str, ...] = (), tokens: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, key, slug) of identifiers extras (by, key, value): all keys of one value get one designation, such as commune_2.

    Designations are numbered by value within their kind. A value in brackets is its own. tokens (by, token, persona): bare
    words that the roster names get their persona's designation, '[nom]' if it has none; a key of extras wins; words that
    begin with '_' are notes. by: the case, if several are in the table.
    """
    own = extras.filter("key IS NOT NULL AND value IS NOT NULL").groupBy(*by, "key").agg(F.max("value").alias("value"))
    kept = own.filter("key = value").select(*by, "value", F.lit(True).alias("__kept")).distinct()
    values = own.select(*by, "value").distinct().join(kept, [*by, "value"], "left")
    kinds = values.withColumn("kind", kind_of(F.col("value"), places, F.coalesce("__kept", F.lit(False)))).drop("__kept")
    numbered = in_order(kinds.filter("kind <> 'marker'"), [*by, "kind"], ["value"], "__n")
    slugs = numbered.select(*by, "value", F.concat("kind", F.lit("_"), F.col("__n").cast("string")).alias("slug")).unionByName(kinds.filter("kind = 'marker'").select(*by, "value", F.col("value").alias("slug")))
    table = own.join(slugs, [*by, "value"]).select(*by, "key", "slug")
    if tokens is None:
        return table
    named = tokens.filter(~F.col("token").startswith("_")).select(*by, F.col("token").alias("key"), F.col("persona").alias("__p"))
    missing = named.join(table.select(*by, "key"), [*by, "key"], "left_anti")
    found = missing.join(table.select(*by, F.col("key").alias("__p"), "slug"), [*by, "__p"], "left")
    return table.unionByName(found.select(*by, "key", F.coalesce("slug", F.lit("[nom]")).alias("slug")))


def role_bindings(roles: DataFrame, groups: DataFrame | None = None, by: tuple[str, ...] = (), weak: tuple[str, ...] = WEAK_ROLES) -> DataFrame:
    """(by, head, label) of persons' roles (by, person_id, role): a head's office, numbered by head where several hold it.

    groups (by, head, person_id): who is one person; another is their own head. The most specific role of all members names them.
    """
    heads = roles.join(groups.select(*by, "person_id", "head"), [*by, "person_id"], "left") if groups is not None else roles.withColumn("head", F.lit(None).cast("string"))
    held = heads.filter("role <> ''").select(*by, F.coalesce("head", "person_id").alias("person_id"), "role")
    chosen = held.groupBy(*by, "person_id").agg(F.min(F.struct(F.col("role").isin(*weak).alias("weak"), "role")).alias("r")).select(*by, F.col("person_id").alias("head"), text.slug(phrases.evened_phrase(F.col("r.role"))).alias("role"))
    holders = chosen.groupBy(*by, "role").agg(F.count(F.lit(1)).alias("__holders"))
    numbered = in_order(chosen, [*by, "role"], ["head"], "__n").join(holders, [*by, "role"])
    return numbered.select(*by, "head", F.when(F.col("__holders") == 1, F.col("role")).otherwise(F.concat("role", F.lit("_"), F.col("__n").cast("string"))).alias("label"))


def merged_persons(records: DataFrame, groups: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each head of records (by, person_id, name, note, role, fact_id): names, notes and roles of all its members.

    (by, head, aliases, note, roles): aliases and notes without repeats; roles in order, each with its facts, sorted, without
    repeats. groups as for role_bindings(). A person without role or fact has none.
    """
    own = records.join(groups.select(*by, "person_id", F.col("head").alias("__h")), [*by, "person_id"], "left").withColumn("head", F.coalesce("__h", "person_id"))
    facts = own.filter("role IS NOT NULL").select(*by, "head", "role", "fact_id").distinct().groupBy(*by, "head", "role").agg(F.sort_array(F.collect_list("fact_id")).alias("facts"))
    roles = facts.groupBy(*by, "head").agg(F.sort_array(F.collect_list(F.struct("role", "facts"))).alias("roles"))
    said = own.groupBy(*by, "head").agg(F.sort_array(F.collect_set(F.nullif(F.trim("name"), F.lit("")))).alias("aliases"), F.nullif(F.array_join(F.sort_array(F.collect_set(F.nullif(F.trim("note"), F.lit("")))), " · "), F.lit("")).alias("note"))
    return said.join(roles, [*by, "head"], "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<struct<role:string,facts:array<string>>>")))
