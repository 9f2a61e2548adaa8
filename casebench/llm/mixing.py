"""Mixing sources to target weights by the cube method.

A source that is to give r times its words gives each document floor(r) times, and once more with probability r -
floor(r). Drawing these apart would miss the target by chance. The cube method moves the vector of probabilities along
directions that leave the source's document and token totals unchanged, until all but two are 0 or 1. That flight runs in
blocks of a source; what the blocks leave over flies again; at the end a dozen documents of a source at most are landed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from casebench.llm.common import materialize, with_words

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Documents of a source that one task's flight takes, on average.
BLOCK = 4000
#: Documents, of sizes up to the third quartile, that each block of an earlier round leaves to the next, and that the last
#: doesn't fly but lands with what it leaves.
SPARE, RESERVE = 4, 10
EPS = 1e-9


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Of each source: the total share by weight, never above `most` times its size; what is over goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, rest = share * sum(sizes.values()), set(order)
    while rest:
        total = sum(weight[s] for s in rest)
        over = [s for s in order if s in rest and left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in rest}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        rest -= set(over)
    return out


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, reserve: int = 0) -> np.ndarray:
    """p moved to 0 or 1, but for at most two, with sum(p) and sum(p * size) kept; each p stays its own mean.

    `reserve` fractional ones, evenly spaced in order of size up to the third quartile, keep their p.
    """
    order = [i for i in np.argsort(size, kind="stable").tolist() if EPS < p[i] < 1 - EPS and size[i] > 0]
    still = {order[int(0.75 * k * (len(order) - 1) / reserve)] for k in range(1, reserve + 1)} if order else set()
    p = p.astype(float).tolist()
    size = size.astype(float).tolist()
    draws = rng.random(len(p) + 3).tolist()
    active: list[int] = []
    todo = iter([i for i, x in enumerate(p) if EPS < x < 1 - EPS and i not in still])
    step = 0
    while True:
        while len(active) < 3 and (i := next(todo, None)) is not None:
            active.append(i)
        if len(active) < 3:
            # two of one size can still move against each other
            if len(active) == 2 and size[active[0]] == size[active[1]]:
                u = [1.0, -1.0]
            else:
                return np.array(p)
        else:
            a, b, c = (size[i] for i in active)
            u = [b - c, c - a, a - b]
            if not any(u):
                u = [1.0, -1.0, 0.0]
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(active, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(active, u, strict=True) if v)
        move = up if draws[step % len(draws)] * (up + down) < down else -down
        step += 1
        for i, v in zip(active, u, strict=True):
            x = p[i] + move * v
            p[i] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x
        active = [i for i in active if 0.0 < p[i] < 1.0]


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The fractions that the flight left (2 + RESERVE at most), rounded so that tokens and documents change least.

    A document too many or too few weighs like a twentieth of the mean size.
    """
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    picks = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    off = np.abs((picks - p[left]) @ size[left]), np.abs((picks - p[left]).sum(axis=1))
    out = p.copy()
    out[left] = picks[np.argmin(off[0] + off[1] * size[left].mean() / 20)]
    return out


FLOWN = ("doc_id", "source", "size", "source_size", "target", "whole", "p", "blocks", "round")


def flown_block(seed: int, rnd: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """The flight of one block of a source, and the landing after the last; seeded by what the block is.

    Ids stay in Arrow: beside a null, pandas would turn them into floats.
    """

    def fly(block: pa.Table) -> pa.Table:
        order = pc.sort_indices(block, sort_keys=[("doc_id", "ascending"), ("size", "ascending"), ("p", "ascending")], null_placement="at_end")
        block = block.take(order)
        key = f"{seed}|{rnd}|{block.column('source')[0].as_py()}|{block.column('__block')[0].as_py()}".encode()
        rng = np.random.default_rng(np.frombuffer(key + b" " * (-len(key) % 4), np.uint32))
        size = block.column("size").to_numpy().astype(float)
        p = flight(block.column("p").to_numpy(), size, rng, RESERVE if last else SPARE)
        out = {name: block.column(name) for name in FLOWN if name not in ("p", "round")}
        out |= {"p": pa.array(landing(p, size) if last else p, pa.float64()), "round": pa.array(np.full(len(p), rnd), pa.int32())}
        return pa.table({name: out[name] for name in FLOWN})

    return fly


def mixed(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 9, block: int = BLOCK) -> DataFrame:
    """sized (doc_id, source, size) with source_size, target, copies and taken; sized should be a written table.

    Null is a source, the last; a document of size 0 takes nothing; null doc_ids and repeated rows fly like others, and ids
    come back as given; a text's length only matters as its size; columns but the three are dropped. The
    driver gets one row a source. Flights are seeded and run in order of doc_id, so reruns agree.
    """
    spark = sized.sparkSession
    per = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    sizes = {r["source"]: r["n"] for r in per}
    goal = targets(sizes, weights, share, most)
    lines = []
    for r in per:
        ratio = min(most, goal[r["source"]] / r["n"]) if r["n"] else 0.0
        whole = int(np.floor(ratio + EPS))
        lines.append((r["source"], r["n"], goal[r["source"]], whole, max(0.0, ratio - whole), max(1, r["rows"] // block)))
    of = spark.createDataFrame(lines, "__source string, source_size long, target double, whole int, p double, blocks int")
    # a row a source: F.broadcast only while that table is small
    of = F.broadcast(of) if len(lines) <= 100_000 else of
    flying = sized.join(of, sized.source.eqNullSafe(F.col("__source"))).drop("__source")
    schema = "doc_id long, source string, size long, source_size long, target double, whole int, p double, blocks int, round int"
    done, rnd = None, 0
    blocks = max((x[-1] for x in lines), default=1)
    while True:
        last = blocks == 1

        dealt = flying.withColumn("__block", F.pmod(F.xxhash64(F.lit(rnd), "doc_id", "size"), F.col("blocks")))
        flown = materialize(dealt.groupBy("source", "__block").applyInArrow(flown_block(seed, rnd, last), schema), "flight")
        still = (F.col("p") > 0) & (F.col("p") < 1)
        ended = flown if last else flown.filter(~still)
        done = ended if done is None else done.unionByName(ended)
        if last:
            break
        left = 2 + SPARE  # of a block, at most
        blocks, rnd = max(1, min(blocks // 2, -(-left * blocks // block))), rnd + 1
        flying = flown.filter(still).drop("round").withColumn("blocks", F.greatest(F.lit(1), F.least(F.floor(F.col("blocks") / 2), F.ceil(left * F.col("blocks") / block))).cast("int"))
    copies = (F.col("whole") + F.round("p").cast("int")).cast("int")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Every document's size in words, its source's target and the words that the mix takes of it."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return mixed(materialize(with_words(given, "doc_id", "source"), "sources"), weights, share, most)


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", "copies")
