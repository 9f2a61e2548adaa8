"""Pairs worth a judge's look: the most alike entries of different files, within a budget.

An inverted index weighs a key by how few entries have it; a pair's score is the weight of the keys it shares. The best pairs are
found exactly without making all pairs: once k pairs of score t are known, a better pair must share one of the first keys of
both its entries, rarest first, whose rest weighs less than t.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casebench.session import written

KEYWORD_BUDGET, DISCOVERY_BUDGET = 32, 8
#: Rounds that raise the score to beat take only keys of so many entries at most; the last takes all.
ROUNDS = (8, 64, None)
WIDTH, SHORT = 15, 24


def weighed(entries: DataFrame) -> tuple[DataFrame, int]:
    """entry and keys (strings, rarest first) of entries (entry, keys array), and the number of entries.

    Keys that others have too, each after its number of entries in WIDTH digits; a key longer than SHORT is told by so many
    hexadecimal digits of its SHA-256. Of a key that a third of all entries has, counts come before the shuffle and the join
    can be split.
    """
    short = lambda k: F.when(F.length(k) > SHORT, F.left(F.sha2(k, 256), F.lit(SHORT))).otherwise(k)
    each = entries.filter("entry IS NOT NULL").select("entry", F.explode(F.transform(F.array_distinct("keys"), short)).alias("key")).filter("key IS NOT NULL")
    total = entries.filter("entry IS NOT NULL").count()
    df = each.groupBy(F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = each.join(df, F.col("key") == F.col("__key")).select("entry", F.concat(F.lpad(F.col("df").cast("string"), WIDTH, "0"), "key").alias("k"))
    return own.groupBy("entry").agg(F.sort_array(F.collect_list("k")).alias("keys")), total


def entries_with(key: Column) -> Column:
    return F.left(key, F.lit(WIDTH)).cast("long")


def without_twins(entries: DataFrame, k: int) -> DataFrame:
    """Of entries with the same keys, those that can be in one of the k best pairs: k + 1 of a file, 2 * (k + 1) in all, by id.

    A pair with a later one comes after k pairs with earlier ones, which score the same.
    """
    same = entries.withColumn("__same", F.sha2(F.array_join("keys", "\u001f"), 256))
    mine = same.withColumn("__n", F.row_number().over(W.partitionBy("__same", "file").orderBy("entry"))).filter(F.col("__n") <= k + 1)
    return mine.withColumn("__n", F.row_number().over(W.partitionBy("__same").orderBy("entry"))).filter(F.col("__n") <= 2 * (k + 1)).drop("__n", "__same")


def best_pairs(entries: DataFrame, k: int = KEYWORD_BUDGET) -> DataFrame:
    """(a, b, score, shared) of the k pairs of entries of different files with the highest score, then the smallest ids.

    entries (entry, file, keys array); entry is unique, a null one takes no part; a null file differs from none but other nulls
    count as one file. Pairs that share no key aren't pairs. Exact; the work is that of the keys that can still lead to a better
    pair, so keys that very many entries have cost nothing once k pairs share rarer ones.
    """
    known = entries.select("entry", F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file"), "keys")
    keyed, total = weighed(known)
    weight = lambda x: F.floor(F.lit(total) / entries_with(x))
    held = written(without_twins(keyed.join(known.select("entry", "file"), "entry"), k), "entries")
    least, best = 0, None
    for turn, most in enumerate(ROUNDS):
        # the first keys: those from which on the keys weigh at least the score to beat
        sums = F.aggregate(F.reverse("keys"), F.struct(F.lit(0).cast("long").alias("rest"), F.lit(0).alias("n")),
                           lambda acc, x: F.struct((acc["rest"] + weight(x)).alias("rest"), (acc["n"] + (acc["rest"] + weight(x) >= least).cast("int")).alias("n")))
        some = F.slice("keys", F.lit(1), sums["n"])
        some = F.filter(some, lambda x: entries_with(x) <= most) if most else some
        heavy = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + weight(x))
        asked = held.select("entry", "file", some.alias("some"), heavy(F.col("keys")).alias("all")).select("entry", "file", (F.col("all") - heavy(F.col("some"))).alias("rest"), F.explode("some").alias("key"))
        left, right = (asked.select("key", F.col("entry").alias(e), F.col("file").alias(f"__f{e}"), F.col("rest").alias(f"__r{e}")) for e in "ab")
        # what a pair shares of these keys is the least that it scores; the most is that and all that its entries have besides
        low = left.join(right, "key").filter("a < b AND __fa <> __fb").groupBy("a", "b").agg(F.sum(weight(F.col("key"))).alias("low"), (F.any_value("__ra") + F.any_value("__rb")).alias("more"))
        low = written(low, "low")
        lows = [r.low for r in low.orderBy(F.col("low").desc()).limit(k).select("low").collect()]  # k numbers
        beat = max(least, min(lows)) if len(lows) == k else least
        met = low.filter(F.col("low") + F.col("more") >= beat).select("a", "b")
        keys = held.select("entry", "keys")
        both = met.join(keys.withColumnsRenamed({"entry": "a", "keys": "__ka"}), "a").join(keys.withColumnsRenamed({"entry": "b", "keys": "__kb"}), "b")
        shared = F.array_intersect("__ka", "__kb")
        scored = both.select("a", "b", F.aggregate(shared, F.lit(0).cast("long"), lambda acc, x: acc + weight(x)).alias("score"), F.size(shared).cast("long").alias("shared"))
        best = written(scored.orderBy(F.col("score").desc(), "a", "b").limit(k), "best")
        scores = [r.score for r in best.select("score").collect()]  # k numbers
        least = min(scores) if len(scores) == k else 0
    return best


def candidate_pairs(entries: DataFrame, discovery: DataFrame, keyword_budget: int = KEYWORD_BUDGET, discovery_budget: int = DISCOVERY_BUDGET) -> DataFrame:
    """(a, b, score, shared, found_by): the best pairs by keywords, and the best by discovery keys that aren't among them.

    discovery (entry, file, keys): keys of another kind, such as lines or cells of an embedding, by which pairs come up that
    share no keyword.
    """
    first = best_pairs(entries, keyword_budget).withColumn("found_by", F.lit("keywords"))
    more = best_pairs(discovery, keyword_budget + discovery_budget).join(first.select("a", "b"), ["a", "b"], "left_anti")
    rest = more.orderBy(F.col("score").desc(), "a", "b").limit(discovery_budget)
    return first.unionByName(rest.withColumn("found_by", F.lit("discovery")))
