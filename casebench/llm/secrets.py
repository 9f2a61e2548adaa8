"""Secret scan: patterns, and character Markov models of random strings against ordinary identifiers.

Two models of the next character given the last, one trained on labelled random strings, one on ordinary identifiers and
words, score every long token by their log-likelihood ratio. All of it is DataFrame functions: training counts pairs of
characters, and the table of log ratios, of fixed size, is a literal in the plan of the scan.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The kinds, and the patterns of the base spans (the value of an assignment is its group 2).
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
#: A token of fewer different characters (a ruler, a repeated syllable) isn't judged.
LEAST_DISTINCT = 8
#: Tokens that the models judge, in one piece.
TOKEN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
# Words of which ordinary identifiers are made.
WORDS = (
    "access account action address after amount append apply array batch before block buffer builder button cache callback channel check child class client color column command common "
    "config connection container content context controller count create current cursor data database default delete dispatch document element enable error event exception execute factory "
    "field file filter format frame function global handle handler header height image index information initialize input instance internal interface iterator language length limit list "
    "listener loader manager maximum message method minimum model module network number object offset option order output package parameter parent parser pattern position process property "
    "provider query queue reader record reference register release remote render request resource response result return schema search section select server service session settings "
    "source standard start status storage stream string struct support system table target template thread timestamp transaction transform update validate value version window writer "
    "gesellschaft verantwortung entwicklung einrichtung freundlich wirtschaftlich geschwindigkeit möglichkeiten zwischen verständlich "
    "établissement développement connaissance gouvernement particulièrement vraiment nouvelle beaucoup information responsabilidad desarrollo comunicaciones administración conocimiento nuestro"
).split()
#: Noncharacters that stand for what a base span covers: a digit, a to f, a capital, anything else. A text has none of them.
COVERED = "\ufdd0\ufdd1\ufdd2\ufdd3"
COVERED_ACCESS = r"AKIA[A-Z0-9\x{FDD0}\x{FDD2}]{16,}"
COVERED_HEX = r"[0-9a-f\x{FDD0}\x{FDD1}]{24,}"
#: Entries of an array that one step sums up.
STEP = 256
#: Log of the odds that a token is ordinary before it is looked at.
PRIOR = math.log(10_000)


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled samples (text, random): n digests in several encodings, and n identifiers of WORDS in several styles."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    other = F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256)
    style = F.col("id") % 7
    raw = F.unhex(digest)
    encoded = F.when(style < 4, F.translate(F.base64(raw), "=", "")).when(style == 4, F.substring(digest, 1, 40)).when(style == 5, F.upper(F.substring(other, 1, 32))).otherwise(F.translate(F.regexp_replace(F.base64(raw), "[+/=]", ""), "0O1lI", "23456"))
    words = F.array(*[F.lit(unicodedata.normalize("NFKD", w).encode("ascii", "ignore").decode()) for w in WORDS])
    picked = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), k), F.lit(len(WORDS))) + 1).cast("int")))
    title = F.transform(picked, lambda w: F.initcap(w))
    styles = [F.array_join(picked, "_"), F.array_join(title, ""), F.concat(F.element_at(picked, 1), F.array_join(F.slice(title, 2, 3), "")), F.array_join(picked, "-"), F.upper(F.array_join(picked, "_")), F.array_join(picked, "."), F.array_join(picked, "/"), F.array_join(picked, ""), F.concat(F.array_join(F.slice(picked, 1, 3), "_"), F.lit("_"), (F.col("id") % 2000).cast("string")), F.upper(F.array_join(picked, ""))]
    chosen = F.element_at(F.array(*styles), (F.col("id") % len(styles) + 1).cast("int"))
    ids = spark.range(n)
    return ids.select(encoded.alias("text"), F.lit(True).alias("random")).unionByName(ids.select(chosen.alias("text"), F.lit(False).alias("random")))


@dataclass(frozen=True)
class Ratios:
    """log P(b | a, random) - log P(b | a, ordinary) at [a * len(ALPHABET) + b]."""

    table: tuple[float, ...]

    def score(self, token: str) -> float:
        at = [ALPHABET.index(c) for c in token]
        return sum(self.table[a * len(ALPHABET) + b] for a, b in zip(at, at[1:], strict=False))


def pairs(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, 2))


def fit(labelled: DataFrame, smoothing: float = 0.5) -> Ratios:
    """Both models from labelled (text, random); a pair with a character outside the alphabet is left out."""
    counts = labelled.select("random", F.explode(pairs(F.col("text"))).alias("pair")).filter(F.length("pair") == 2).groupBy("random", "pair").count().collect()
    k = len(ALPHABET)
    seen = {True: np.full((k, k), smoothing), False: np.full((k, k), smoothing)}
    for r in counts:
        if r["random"] is not None and all(c in ALPHABET for c in r["pair"]):
            seen[r["random"]][ALPHABET.index(r["pair"][0]), ALPHABET.index(r["pair"][1])] += r["count"]
    log = {x: np.log(c / c.sum(axis=1, keepdims=True)) for x, c in seen.items()}
    table = log[True] - log[False]
    np.fill_diagonal(table, np.minimum(table.diagonal(), 0))  # a run of one character isn't random
    return Ratios(tuple(table.ravel().tolist()))


def steps(token: Column, ratios: Ratios) -> Column:
    """The log ratio of each character of a token of the alphabet after the one before. A lambda that used this would work it out
    anew for each entry, and each use puts the table into the plan: it is what an aggregate goes over, once.
    """
    table = F.lit(np.array(ratios.table))
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    n = F.length(token) - 1
    return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: F.element_at(table, ((a - 1) * len(ALPHABET) + b).cast("int")))


def ratio(token: Column, ratios: Ratios) -> Column:
    """The log-likelihood ratio of a token of the alphabet."""
    return F.aggregate(steps(token, ratios), F.lit(0.0), lambda total, add: total + add)


SEGMENTS = "array<struct<best:double,start:int,stop:int>>"


def segments(token: Column, ratios: Ratios, prior: float) -> Column:
    """array<struct<best, start, stop>>: the token's segments whose log-likelihood ratio is over the prior (positions from 0).

    A segment begins where the running ratio last rose from zero, and ends at its peak, once the ratio has fallen to zero or by
    the prior below it: an ordinary stretch as unlike a key as a key is unlike it parts two keys.
    """
    limit = F.lit(prior)

    def closed(acc: Column) -> Column:
        one = F.array(F.struct(acc["peak"].alias("best"), acc["begin"].alias("start"), acc["stop"].alias("stop")))
        return F.when(acc["peak"] > limit, F.concat(acc["out"], one)).otherwise(acc["out"])

    def step(acc: Column, add: Column) -> Column:
        # over: the running ratio is spent, or far enough below a peak that counts
        over = (acc["total"] <= 0) | ((acc["peak"] > limit) & (acc["peak"] - acc["total"] > limit))
        total = F.when(over, F.lit(0.0)).otherwise(acc["total"]) + add
        peak = F.when(over, F.lit(0.0)).otherwise(acc["peak"])
        return F.struct((acc["i"] + 1).alias("i"), total.alias("total"), F.when(over, acc["i"] - 1).otherwise(acc["begin"]).alias("begin"), F.greatest(total, peak).alias("peak"), F.when(total > peak, acc["i"] + 1).otherwise(acc["stop"]).alias("stop"), F.when(over, closed(acc)).otherwise(acc["out"]).alias("out"))

    none = F.struct(F.lit(1).alias("i"), F.lit(0.0).alias("total"), F.lit(0).alias("begin"), F.lit(0.0).alias("peak"), F.lit(0).alias("stop"), F.array().cast(SEGMENTS).alias("out"))
    return F.aggregate(steps(token, ratios), none, step, closed)


def joined(found: Column) -> Column:
    """Spans of one token in order, those that overlap as one."""
    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"), F.lit("").alias("value"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] > x["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(found, F.array().cast(SPAN), add)


def within(s: Column, ratios: Ratios, prior: float) -> Column:
    """The spans (start, stop, value) of a token: the whole if it is random, else its random segments, out to the next of / . = _ -"""
    value = s["value"]
    distinct = lambda v: F.size(F.array_distinct(F.split(v, "")))

    def bounds(best: Column) -> Column:
        before = F.length(F.regexp_extract(F.substring(value, F.lit(1), best["start"]), r"[^/._=-]*$", 0))
        after = F.length(F.regexp_extract(F.substring(value, best["stop"] + 1, F.length(value)), r"^[^/._=-]*", 0))
        # the first piece of a segment that is ordinary as a whole isn't of the key
        wide = F.substring(value, best["start"] - before + 1, F.length(value))
        head = F.regexp_extract(wide, r"^([^/._=-]*)[/._=-]+", 0)
        first = F.regexp_extract(wide, r"^([^/._=-]*)[/._=-]+", 1)
        ordinary = (F.length(first) < 3) | (ratio(F.rpad(first, F.greatest(F.length(first), F.lit(3)), "-"), ratios) < 0)
        return F.struct((best["start"] - before + F.when(ordinary, F.length(head)).otherwise(0)).alias("start"), (best["stop"] + after).alias("stop"))

    def cut(at: Column) -> Column:
        return F.struct((s["start"] + at["start"]).alias("start"), (s["start"] + at["stop"]).alias("stop"), F.substring(value, at["start"] + 1, at["stop"] - at["start"]).alias("value"))

    found = F.transform(F.transform(segments(value, ratios, prior), bounds), cut)
    part = joined(F.filter(found, lambda x: (F.length(x["value"]) >= 20) & (distinct(x["value"]) >= LEAST_DISTINCT)))
    return F.when(distinct(value) < LEAST_DISTINCT, F.array().cast(SPAN)).when(ratio(value, ratios) > prior, F.array(s)).otherwise(part)


SPAN = "array<struct<start:int,stop:int,value:string>>"


def running(lengths: Column) -> Column:
    """The sums of all entries before each entry. Sums of STEP entries first, so that no long array is copied entry by entry."""
    def sums(parts: Column, first: Column) -> Column:
        return F.aggregate(parts, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    starts = F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(STEP))
    blocks = F.transform(starts, lambda i: F.slice(lengths, i, F.lit(STEP)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
    return F.flatten(F.zip_with(blocks, sums(totals, F.lit(0)), sums))


def gaps(text: Column, pattern: str) -> Column:
    """What stands before each match, and after the last."""
    return F.split(text, pattern, -1)


def spans(found: Column, text: Column, pattern: str) -> Column:
    """array<struct<start, stop, value>> of the matches `found`, in code points, from the lengths between them."""
    between = F.transform(F.slice(gaps(text, pattern), 1, F.size(found)), lambda x: F.length(x))
    both = F.zip_with(between, found, lambda gap, value: gap + F.length(value))
    made = F.zip_with(F.zip_with(running(both), between, lambda a, b: a + b), found, lambda start, value: F.struct(start.alias("start"), (start + F.length(value)).alias("stop"), value.alias("value")))
    return F.when(F.size(found) > 0, made).otherwise(F.array().cast(SPAN))


def cover(value: Column) -> Column:
    """As many noncharacters, of the same classes."""
    digits, small, capitals = "0123456789", "abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    classed = F.translate(value, digits + small + capitals, COVERED[0] * len(digits) + COVERED[1] * len(small) + COVERED[2] * len(capitals))
    return F.regexp_replace(classed, r"[^\x{FDD0}-\x{FDD3}]", COVERED[3])


def covered(text: Column, pattern: str, keep=None) -> Column:
    """The text with each match of the pattern (that `keep` says) covered."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    apart = gaps(text, pattern)
    hide = lambda m: cover(m) if keep is None else F.when(keep(m), cover(m)).otherwise(m)
    # one piece more than matches: the last has none after it
    joined = F.zip_with(apart, found, lambda gap, m: F.concat(gap, F.coalesce(hide(m), F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(joined, "")).otherwise(text)


def scan(docs: DataFrame, ratios: Ratios, prior: float = PRIOR, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, the text ('' for null), its base spans and all spans, array<struct<start, rank, stop>> by
    start, then kind (rank in KINDS, from 1), and `hidden`: the text with noncharacters where a span is.

    Base spans are leftmost and don't overlap within a kind; a match whose value is too short is dropped after it is found.
    What base spans leave of a token, if still long enough, is a span of kind random if its log-likelihood ratio is over the
    prior, or else each of its segments whose own is, out to the next separators; spans of a token that overlap are one. Time
    grows with the text and its spans: no array or text is copied for each. Nothing is shuffled; null doc_ids and repeated rows are scanned like others,
    texts of any length whole; a carried column must not be named text, base, spans or hidden, nor __ and assign, access,
    hex, left, tokens, token or random.
    """
    text = F.col("text")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE
    for name, pattern in base:
        out = out.withColumn(f"__{name}", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    # covered in turn: the classes let what is left of an overlapping match be found as it was
    some = F.size("__assign") + F.size("__access") + F.size("__hex") > 0
    out = out.withColumn("__left", F.when(F.size("__assign") > 0, covered(text, ASSIGN, long_value)).otherwise(text))
    out = out.withColumn("__left", F.when(some, covered(F.col("__left"), COVERED_ACCESS)).otherwise(F.col("__left")))
    out = out.withColumn("__left", F.when(some, covered(F.col("__left"), COVERED_HEX)).otherwise(F.col("__left")))
    out = out.withColumn("__tokens", F.regexp_extract_all(F.col("__left"), F.lit(TOKEN), F.lit(0)))
    for name, pattern in base:
        out = out.withColumn(f"__{name}", spans(F.col(f"__{name}"), text, pattern))
    out = out.withColumn("__token", spans(F.col("__tokens"), F.col("__left"), TOKEN))
    as_kind = lambda column, rank: F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop")))
    out = out.withColumn("base", F.array_sort(F.concat(as_kind(F.filter("__assign", lambda s: long_value(s["value"])), 1), as_kind("__access", 2), as_kind("__hex", 3))))
    out = out.withColumn("__random", F.transform("__token", lambda s: within(s, ratios, prior)))

    def hide(token: Column, found: Column) -> Column:
        value, first = token["value"], token["start"]
        cut = lambda acc, one: F.struct(one["stop"].alias("at"), F.concat(acc["out"], F.substring(value, acc["at"] - first + 1, one["start"] - acc["at"]), F.repeat(F.lit(COVERED[3]), one["stop"] - one["start"])).alias("out"))
        rest = lambda acc: F.concat(acc["out"], F.substring(value, acc["at"] - first + 1, F.length(value)))
        return F.when(F.size(found) == 0, value).otherwise(F.aggregate(found, F.struct(first.alias("at"), F.lit("").alias("out")), cut, rest))

    pieces = F.zip_with(gaps(F.col("__left"), TOKEN), F.zip_with("__token", "__random", hide), lambda gap, token: F.concat(gap, F.coalesce(token, F.lit(""))))
    hidden = F.when(F.size("__token") > 0, F.array_join(pieces, "")).otherwise(F.col("__left"))
    return out.select("doc_id", *carried, "text", "base", F.array_sort(F.concat("base", as_kind(F.flatten("__random"), 4))).alias("spans"), hidden.alias("hidden"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(hidden: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of spans that overlap or touch, as the mark."""
    return F.regexp_replace(hidden, r"[\x{FDD0}-\x{FDD3}]+", mark)


def secret_spans(docs: DataFrame, ratios: Ratios | None = None) -> DataFrame:
    """Counts of base spans, their digest, and all spans of every text."""
    found = scan(docs, ratios or fit(samples(docs.sparkSession)))
    n = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select("doc_id", n(1).alias("n_assign"), n(2).alias("n_access"), n(3).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
