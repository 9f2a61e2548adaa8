"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree hashes a vector to a string of LEVELS bits, the sides of random hyperplanes, and keeps its vectors as an array
sorted by string. The array's directory is a trie of prefixes: one that holds many vectors is split by further bits, as
often as the data ask for it. A query descends each tree to the longest prefix that it shares, then ascends all trees
together, one bit at a time, until the subtrees above it hold `least` vectors and one of them holds all that are asked
for; those are its candidates, a range of each array. Arrays are cut into pages of bounded size; a query is sent to the
pages that its ranges touch and scored there against the slice in range, and the best of its pages are merged. How many
vectors a query must see is measured: true neighbours of a bounded sample of queries, found against all rows, tell the
recall of every choice of `least`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from casebench.llm.common import materialize, release

TREES, LEVELS, SEED = 8, 48, 5
#: Bits by which the directory's prefixes are split first, and then; vectors that a prefix holds unsplit, and how many
#: prefixes a tree's directory may have, on average, before those hold more: its size stays bounded.
FIRST_BITS, MORE_BITS, UNSPLIT, MOST_PREFIXES = 12, 3, 64, 1 << 14
#: Vectors of a page; queries of the sample, and the recall that `least` has to reach on it.
PAGE, SAMPLE_QUERIES, RECALL = 16_384, 128, 0.95
#: Rows from which the centre is estimated.
CENTRE_ROWS = 10_000


@dataclass(frozen=True)
class Planes:
    """Hyperplanes [tree * LEVELS, dim + 1] of vectors lifted to one length, so the largest product is the least angle.

    A shorter vector is one with zeros at its end.
    """

    normals: np.ndarray
    centre: np.ndarray
    longest: float
    lift: float
    query_lift: float

    def leaves(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """[row, tree] of hash strings. A query is scaled to the lifted length; its lift is that of a long vector."""
        square = np.einsum("ij,ij->i", vectors, vectors)
        scale = np.sqrt(square)[:, None] if query else self.longest
        lift = np.full(len(vectors), self.query_lift) if query else lifts(square, self.longest)
        lifted = np.concatenate([vectors / scale - self.centre, lift[:, None] - self.lift], axis=1)
        bits = (lifted @ self.normals.T > 0).reshape(len(vectors), TREES, LEVELS)
        return bits @ (1 << np.arange(LEVELS, dtype=np.int64)[::-1])


def lifts(square: np.ndarray, longest: float) -> np.ndarray:
    """The coordinate that brings a vector of this squared length to the longest one's, as a share of that."""
    return np.sqrt(np.maximum(1 - square / longest**2, 0))


def matrix_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(table: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part, with zeros at the end up to the longest one's length."""
    good = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = good.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite & F.exists("embedding", lambda x: x != 0))
    low, high = good.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    return good if low == high else good.withColumn("embedding", F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(high) - F.size("embedding"))))


def strings(batches: Iterator[pa.RecordBatch], planes: Planes) -> Iterator[pa.RecordBatch]:
    """Of each vector the list of its strings, one a tree."""
    for batch in batches:
        if batch.num_rows:
            flat = planes.leaves(matrix_of(batch.column("embedding")), query=False).ravel()
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, TREES), pa.int32()), pa.array(flat, pa.int64()))], names=["strings"])


def prefix_counts(batches: Iterator[pa.RecordBatch], depth: int, wanted: list[np.ndarray] | None, more: int) -> Iterator[pa.RecordBatch]:
    """(tree, prefix, n) of a task: the prefixes of depth + more bits, of those vectors whose first `depth` bits are wanted."""
    seen: list[dict[int, int]] = [{} for _ in range(TREES)]
    for batch in batches:
        if not batch.num_rows:
            continue
        m = batch.column("strings").flatten().to_numpy().reshape(-1, TREES)
        for t in range(TREES):
            own = m[:, t]
            if wanted is not None:
                head = own >> (LEVELS - depth)
                at = np.minimum(np.searchsorted(wanted[t], head), max(len(wanted[t]) - 1, 0))
                own = own[wanted[t][at] == head] if len(wanted[t]) else own[:0]
            for p, c in zip(*(x.tolist() for x in np.unique(own >> (LEVELS - depth - more), return_counts=True)), strict=True):
                seen[t][p] = seen[t].get(p, 0) + c
    for t, counts in enumerate(seen):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), t), pa.int32()), pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["tree", "prefix", "n"])


def directory(hashed: DataFrame, total: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each tree the first strings of its prefixes, ascending, and how many vectors each holds.

    A prefix with more than `most` vectors is split by further bits, each time in one pass over the strings, until none is or
    they have no more bits. `most` follows the table, so the directory has a bounded number of prefixes.
    """
    most = max(UNSPLIT, total // MOST_PREFIXES)
    starts: list[dict[int, int]] = [{} for _ in range(TREES)]
    depth, more, wanted = 0, FIRST_BITS, None
    while True:
        asked = (depth, wanted, more)
        found = hashed.mapInArrow(lambda it, asked=asked: prefix_counts(it, *asked), "tree int, prefix long, n long").groupBy("tree", "prefix").agg(F.sum("n").alias("n")).toArrow()
        depth += more
        more = min(MORE_BITS, LEVELS - depth)
        tree, prefix, n = (found.column(c).to_numpy() for c in ("tree", "prefix", "n"))
        heavy = (n > most) & (more > 0)
        for t, p, c in zip(tree[~heavy].tolist(), prefix[~heavy].tolist(), n[~heavy].tolist(), strict=True):
            starts[t][p << (LEVELS - depth)] = c
        wanted = [np.sort(prefix[heavy & (tree == t)]) for t in range(TREES)]
        if not heavy.any():
            first = [np.array(sorted(x), np.int64) for x in starts]
            return first, [np.array([x[k] for k in f.tolist()], np.int64) for x, f in zip(starts, first, strict=True)]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each line the positions of its k largest scores; equal scores by smaller id."""
    if scores.shape[1] > 2 * k:
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        # what lies within rounding of the k-th score stays for the exact look
        line, col = np.nonzero(scores >= cut[:, None] - 1e-9)
    else:
        line, col = np.divmod(np.arange(scores.size), scores.shape[1])
    order = np.lexsort((ids[col], -scores[line, col], line))
    line, col = line[order], col[order]
    rank = np.arange(len(line)) - np.searchsorted(line, line)
    out = np.full((len(scores), k), -1)
    keep = rank < k
    out[line[keep], rank[keep]] = col[keep]
    return out


def top(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of each query's k best, scored pair by pair so that a score doesn't depend on the block it is in."""
    out = []
    for lo in range(0, len(queries), 512):
        part = queries[lo : lo + 512]
        for q, cols in zip(part, best(part @ vectors.T, ids, k + 8), strict=True):
            cols = cols[cols >= 0]
            exact = (vectors[cols] * q).sum(axis=1)
            order = np.lexsort((ids[cols], -exact))[:k]
            out.append((ids[cols][order], exact[order]))
    return out


def lists(qid: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(i) for i, _ in found])]).astype(np.int32)
    flat = [np.concatenate(x) if x else np.zeros(0) for x in ([i for i, _ in found], [s for _, s in found])]
    cols = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, t)) for x, t in zip(flat, (pa.int64(), pa.float64()), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), *cols], names=["qid", "ids", "scores"])


def against_all(batches: Iterator[pa.RecordBatch], qid: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The sample's k best among a task's vectors."""
    for batch in batches:
        if batch.num_rows and len(qid):
            yield lists(qid.tolist(), top(queries, matrix_of(batch.column("embedding")), batch.column("vec_id").to_numpy(), k))


def merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each qid, of lists that come sorted by qid; an id found several times counts once, with its best score."""
    now, ids, scores = None, [], []

    def done() -> tuple[np.ndarray, np.ndarray]:
        i, s = np.concatenate(ids), np.concatenate(scores)
        order = np.lexsort((-s, i))
        i, first = np.unique(i[order], return_index=True)
        s = s[order][first]
        order = np.lexsort((i, -s))[:k]
        return i[order], s[order]

    for batch in batches:
        out_q, out = [], []
        for q, i, s in zip(batch.column("qid").to_pylist(), batch.column("ids"), batch.column("scores"), strict=True):
            if q != now and now is not None:
                out_q.append(now)
                out.append(done())
                ids, scores = [], []
            now = q
            ids.append(i.values.to_numpy())
            scores.append(s.values.to_numpy())
        if out_q:
            yield lists(out_q, out)
    if now is not None:
        yield lists([now], [done()])


@dataclass(frozen=True)
class Forest:
    """The planes and each tree's directory: the first string of each prefix, and the number of vectors before it."""

    planes: Planes
    starts: list[np.ndarray]
    before: list[np.ndarray]  # one longer than starts
    least: int
    enough: int  # vectors that one tree's range must hold, so that a query gets so many different ones

    def pages(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each tree and prefix the first page, and the number of pages. A prefix over a page's size has pages of its own."""
        first, many, page = [], [], 0
        for before in self.before:
            n = np.diff(before)
            many.append(np.maximum(1, -(-n // PAGE)))
            own, held = [], 0
            for size, wide in zip(n.tolist(), many[-1].tolist(), strict=True):
                if held and held + size > PAGE:
                    page, held = page + 1, 0
                own.append(page)
                held += size
                if wide > 1:
                    page, held = page + wide, 0
            first.append(np.array(own, np.int64))
            page += 1
        return first, many

    def ranges(self, leaves: np.ndarray, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """[query, tree]: the first and last prefix of the range at the deepest level where the ranges hold enough."""
        least = max(self.least if least is None else least, 1)
        lo, hi = np.zeros(leaves.shape, np.int64), np.zeros(leaves.shape, np.int64)
        todo = np.arange(len(leaves))
        for level in range(LEVELS, -1, -1):
            low = leaves[todo] >> (LEVELS - level) << (LEVELS - level)
            high = low | ((1 << (LEVELS - level)) - 1)
            a, b, held = np.zeros_like(low), np.zeros_like(low), np.zeros_like(low)
            for t in range(TREES):
                # a level within a prefix takes the whole prefix
                a[:, t] = np.maximum(np.searchsorted(self.starts[t], low[:, t], side="right") - 1, 0)
                b[:, t] = np.maximum(np.searchsorted(self.starts[t], high[:, t], side="right") - 1, a[:, t])
                held[:, t] = self.before[t][b[:, t] + 1] - self.before[t][a[:, t]]
            full = ((held.sum(axis=1) >= least) & (held.max(axis=1) >= self.enough)) if level else np.ones(len(todo), bool)
            lo[todo[full]], hi[todo[full]] = a[full], b[full]
            todo = todo[~full]
            if not len(todo):
                break
        return lo, hi


def to_pages(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """(page, lo, hi, id, embedding): a vector once a tree, with lo = its prefix and hi null; a query once a page, with its range."""
    first, many = forest.pages()
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, is_query = batch.column("id").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
        vectors = matrix_of(batch.column("embedding"))
        for query in (False, True):
            rows = np.flatnonzero(is_query == query)
            if not len(rows):
                continue
            leaves = forest.planes.leaves(vectors[rows], query)
            low, high = forest.ranges(leaves) if query else (None, None)
            for t in range(TREES):
                if not query:
                    lo = np.searchsorted(forest.starts[t], leaves[:, t], side="right") - 1
                    page, take, hi = first[t][lo] + ids[rows] % many[t][lo], rows, pa.nulls(len(rows), pa.int64())
                else:
                    a, b = low[:, t], high[:, t]
                    start, stop = first[t][a], first[t][b] + many[t][b]
                    width = stop - start
                    page = np.repeat(start, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                    take, lo, hi = np.repeat(rows, width), np.repeat(a, width), pa.array(np.repeat(b, width), pa.int64())
                for at in range(0, len(take), 20_000):
                    part = slice(at, at + 20_000)
                    yield pa.RecordBatch.from_arrays([pa.array(page[part], pa.int64()), pa.array(lo[part], pa.int64()), hi[part], pa.array(ids[take[part]]), batch.column("embedding").take(pa.array(take[part]))], names=["page", "lo", "hi", "id", "embedding"])


def searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by page, its vectors first, in order of leaf; then queries. Memory: a page, and a batch of queries."""
    now, leaf, ids, vectors, ready = None, [], [], [], False
    for batch in batches:
        pages = batch.column("page").to_numpy()
        his = batch.column("hi")
        is_query = his.is_valid().to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((np.diff(pages) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if pages[a] != now:
                now, leaf, ids, vectors, ready = pages[a], [], [], [], False
            lo, one, m = part.column("lo").to_numpy(), part.column("id").to_numpy(), matrix_of(part.column("embedding"))
            if not is_query[a]:
                leaf.append(lo)
                ids.append(one)
                vectors.append(m)
                continue
            if not leaf:
                continue
            if not ready:
                leaf, ids, vectors, ready = [np.concatenate(leaf)], [np.concatenate(ids)], [np.concatenate(vectors)], True
            hi = part.column("hi").to_numpy()
            ranges, of = np.unique(np.stack([lo, hi]), axis=1, return_inverse=True)
            for r, (x, y) in enumerate(ranges.T):
                rows = np.flatnonzero(of.ravel() == r)
                s, e = np.searchsorted(leaf[0], x, side="left"), np.searchsorted(leaf[0], y, side="right")
                if e > s:
                    yield lists(one[rows].tolist(), top(m[rows], vectors[0][s:e], ids[0][s:e], k))


LISTS = "qid long, ids array<long>, scores array<double>"


def grow(vectors: DataFrame, queries: DataFrame, k: int, recall: float = RECALL, sample_queries: int = SAMPLE_QUERIES) -> Forest:
    """Planes, the directory over all vectors, and the smallest `least` that reaches the recall on a sample of queries."""
    sc = vectors.sparkSession.sparkContext
    some = np.array([r.embedding for r in vectors.select("embedding").limit(CENTRE_ROWS).collect()])
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    longest, total = vectors.agg(F.max(norm), F.count(F.lit(1))).first()
    dim = some.shape[1]
    lift = lifts(np.einsum("ij,ij->i", some, some), longest)
    planes = Planes(np.random.default_rng(SEED).normal(size=(TREES * LEVELS, dim + 1)), some.mean(axis=0) / longest, longest, float(lift.mean()), float(np.quantile(lift, 0.1)))
    sent = sc.broadcast(planes)
    hashed = materialize(vectors.select("embedding").mapInArrow(lambda it: strings(it, sent.value), "strings array<long>"), "strings")
    starts, counts = directory(hashed, total)
    release(hashed)
    before = [np.concatenate([[0], np.cumsum(n)]) for n in counts]
    forest = Forest(planes, starts, before, TREES * total, min(k, total))
    sample = queries.orderBy(F.xxhash64("qid")).limit(sample_queries).collect()
    qid, q = np.array([r.qid for r in sample]), np.array([r.embedding for r in sample])
    asked = sc.broadcast((qid, q))
    found = vectors.mapInArrow(lambda it: against_all(it, *asked.value, k), LISTS)
    true = found.repartition("qid").sortWithinPartitions("qid").mapInArrow(lambda it: merged(it, k), LISTS)
    near = true.select("qid", F.explode("ids").alias("vec_id"))
    # sample_queries * k rows at most
    pairs = vectors.join(F.broadcast(near), "vec_id").select("qid", "embedding").collect()
    place = {int(x): i for i, x in enumerate(qid)}
    at = np.array([place[r.qid] for r in pairs])
    mine = planes.leaves(q, query=True)
    theirs = planes.leaves(np.array([r.embedding for r in pairs]), query=False)
    where = np.stack([np.searchsorted(starts[t], theirs[:, t], side="right") - 1 for t in range(TREES)], axis=1)
    least = TREES * total
    for step in range(1, 4 * LEVELS):
        fewer = int(TREES * total / 2 ** (step / 4))
        lo, hi = forest.ranges(mine, fewer)
        if not fewer or ((where >= lo[at]) & (where <= hi[at])).any(axis=1).mean() < recall:
            break
        least = fewer
    for one in (sent, asked):
        one.unpersist()
    return Forest(planes, starts, before, least, min(k, total))


def nearest(table: DataFrame, is_query: F.Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query, its own row excepted; all others, if fewer.

    Takes part: a vector without null or non-finite components, not zero, with an id; a shorter vector counts as one with
    zeros at its end. Of equal vectors the k + 1 with the smallest ids are indexed; no result needs more. Equal queries are
    searched once. Ties go to the smaller id; of rows that share an id the nearest counts; an empty table gives an empty one; other
    columns are ignored. The driver gets the directory, of bounded size, and the sample.
    """
    good = materialize(usable(table), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    asked = good.filter(is_query)
    if good.isEmpty() or asked.isEmpty():
        return table.sparkSession.createDataFrame([], schema)
    rank = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    kept = materialize(good.withColumn("__rank", rank).filter(F.col("__rank") <= k + 1).select("vec_id", "embedding"), "index")
    queries = materialize(asked.groupBy("embedding").agg(F.min("vec_id").alias("qid")).select("qid", "embedding"), "queries")
    forest = table.sparkSession.sparkContext.broadcast(grow(kept, queries, k + 1, recall))
    both = kept.select(F.col("vec_id").alias("id"), F.lit(False).alias("is_query"), "embedding").unionByName(queries.select(F.col("qid").alias("id"), F.lit(True).alias("is_query"), "embedding"))
    paged = both.select("id", "is_query", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(lambda it: to_pages(it, forest.value), "page long, lo long, hi long, id long, embedding array<double>")
    dealt = paged.repartition("page").sortWithinPartitions("page", F.col("hi").isNotNull(), "lo", "hi")
    lists_ = dealt.mapInArrow(lambda it: searched(it, k + 1), LISTS).repartition("qid").sortWithinPartitions("qid").mapInArrow(lambda it: merged(it, k + 1), LISTS)
    of = queries.join(lists_, "qid").select(F.col("embedding").alias("__vector"), "ids", "scores")
    back = asked.join(of, F.col("embedding") == F.col("__vector")).select(F.col("vec_id").alias("query_id"), F.arrays_zip("ids", "scores").alias("found"))
    own = F.slice(F.filter("found", lambda x: x["ids"] != F.col("query_id")), 1, k)
    return back.select("query_id", F.posexplode(own)).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.ids").alias("vec_id"), F.col("col.scores").alias("score"))


def op5_ann_forest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
