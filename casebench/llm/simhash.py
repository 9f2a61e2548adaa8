"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most r bits have a midpoint within r/2 of both, so each fingerprint's ball of
variants within r/2 bits is shuffled by variant and whatever meets there is linked. A ball of radius 2 has 2081 variants;
they aren't sent. The space of variants is cut into slices by its leading bits, each fingerprint is sent once to each
slice that its ball enters, and the slice makes the variants that lie in it, sorts them and links what is equal. Members
of one variant are within r of each other, so a star to the smallest links them; each slice sends on a spanning forest.

Fingerprints of a large family of near copies share their leading bits and crowd one slice. Slices are counted first; a
crowded one is cut into parts by a linear hash of the variant. H(fp ^ mask) = H(fp) ^ H(mask), so a part knows which masks
lead into it and makes only those variants: each variant is still made once, and parts are alike whatever the family.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from casebench.llm.common import materialize, release, spans_of_bytes, texts

#: Variants that one slice makes on average; with it grows the memory of a task. A slice of CROWDED times as many is cut.
VARIANTS_A_SLICE, CROWDED = 4_000_000, 4


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(bits), 240):
        ones += bits[lo : lo + 240].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Of the text's shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -shingle] + 1).tolist()]
    return majority(np.array([hashed(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, _, data, offsets in spans_of_bytes(batch):
            raw = data.tobytes()
            out += [fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def masks(bits: int, radius: int) -> np.ndarray:
    """All words of so many bits with at most `radius` set, fewest first."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(bits), k)], np.uint64)


def to_slices(batches: Iterator[pa.RecordBatch], bits: int, half: int) -> Iterator[pa.RecordBatch]:
    """(slice, fp) for each slice that the ball of fp enters."""
    mask = masks(bits, half)
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for lo in range(0, len(fp), 50_000):
            part = fp[lo : lo + 50_000]
            slices = ((part >> np.uint64(64 - bits))[:, None] ^ mask).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(slices.astype(np.int64)), pa.array(np.repeat(part, len(mask)).view(np.int64))], names=["slice", "fp"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b: (member, smallest member), numpy all through."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def syndromes(words: np.ndarray, parts: int) -> np.ndarray:
    """A linear hash of each word to parts bits: the parities of the word under fixed random masks."""
    rng = np.random.default_rng(64)
    checks = rng.integers(0, 1 << 63, parts, dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, parts, dtype=np.uint64)
    out = np.zeros(len(words), np.int64)
    for k, check in enumerate(checks):
        out |= (np.bitwise_count(words & check) & 1).astype(np.int64) << k
    return out


def variants_of(low: np.ndarray, mask: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(variant, position in low) of the variants whose syndrome is `part`."""
    if not parts:
        return (low[:, None] ^ mask).ravel(), np.repeat(np.arange(len(low)), len(mask))
    of = syndromes(mask, parts)
    order = np.argsort(of, kind="stable")
    mask, of = mask[order], of[order]
    needed = syndromes(low, parts) ^ part
    first, last = np.searchsorted(of, needed, side="left"), np.searchsorted(of, needed, side="right")
    count = last - first
    who = np.repeat(np.arange(len(low)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return low[who] ^ mask[at], who


def to_parts(batches: Iterator[pa.RecordBatch], bits: int, half: int) -> Iterator[pa.RecordBatch]:
    """(slice, part, parts, fp) for each part of its slice in which fp makes a variant; an uncut slice is its part 0."""
    rest = 64 - bits
    for batch in batches:
        cuts, parts, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("slice", "parts", "fp"))
        fp = fp.view(np.uint64)
        away = np.bitwise_count((fp >> np.uint64(rest)) ^ cuts.view(np.uint64))
        low = fp & np.uint64((1 << rest) - 1)
        kinds = np.unique(np.where(parts > 0, parts.astype(np.int64) * (half + 1) + away, 0))
        for p, d in (divmod(k, half + 1) for k in kinds.tolist()):
            who = np.flatnonzero((parts == p) & ((p == 0) | (away == d)))
            reached = np.unique(syndromes(masks(rest, half - d), p)) if p else np.zeros(1, np.int64)
            for lo in range(0, len(who), max(1, 500_000 // len(reached))):
                some = who[lo : lo + max(1, 500_000 // len(reached))]
                part = (syndromes(low[some], p)[:, None] ^ reached).ravel() if p else np.zeros(len(some), np.int64)
                take = np.repeat(some, len(reached))
                yield pa.RecordBatch.from_arrays([pa.array(cuts[take]), pa.array(part), pa.array(np.full(len(take), p, np.int32)), pa.array(fp[take].view(np.int64))], names=["slice", "part", "parts", "fp"])


def links_of_slice(cut: int, fp: np.ndarray, bits: int, half: int, part: int = 0, parts: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The links that fingerprints make through variants within one slice, or one of its 2**parts parts, as a forest."""
    rest = 64 - bits
    away = np.bitwise_count((fp >> np.uint64(rest)) ^ np.uint64(cut))
    low = fp & np.uint64((1 << rest) - 1)
    variants, owners = [], []
    for d in range(half + 1):
        who = np.flatnonzero(away == d)
        if len(who):
            v, o = variants_of(low[who], masks(rest, half - d), part, parts)
            variants.append(v)
            owners.append(who[o])
    v, o = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(v)
    v, o = v[order], o[order]
    same = np.flatnonzero(v[1:] == v[:-1])
    a, b = fp[o[same]], fp[o[same + 1]]
    near = np.bitwise_count(a ^ b) <= 2 * half  # holds for all that share a variant
    return forest(a[near], b[near])


def linked(batches: Iterator[pa.RecordBatch], bits: int, half: int) -> Iterator[pa.RecordBatch]:
    """Rows (slice, part, parts, fp) come sorted by slice and part; one may go over several batches."""
    names = ["a", "b"]

    def made(where: tuple[int, int, int], held: list[np.ndarray]) -> pa.RecordBatch:
        cut, part, parts = where
        a, b = links_of_slice(cut, np.unique(np.concatenate(held)), bits, half, part, parts)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

    now, held = None, []
    for batch in batches:
        cuts, part, parts, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("slice", "part", "parts", "fp"))
        if not len(cuts):
            continue
        edges = [0, *(np.flatnonzero((np.diff(cuts) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(cuts)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            here = int(cuts[lo]), int(part[lo]), int(parts[lo])
            if now is not None and here != now:
                yield made(now, held)
                held = []
            now = here
            held.append(fp[lo:hi].view(np.uint64))
    if held:
        yield made(now, held)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over links (a, b); nodes without links are left out.

    Alternates large-star and small-star until the links don't change. Each round shuffles the links and is written to
    the shared folder, so lineage stays short; nothing but two sums goes to the driver.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        new = materialize(small, "links")
        n, total = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(edges)
        edges = new
        if (n, total) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = (n, total)


def simhash_links(prints: DataFrame, radius: int = 4, variants_a_slice: int = VARIANTS_A_SLICE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints within `radius` (even) bits.

    prints: fp, one row for each. The number of slices follows the number of fingerprints, and a crowded slice is cut, so a
    task's memory doesn't grow.
    """
    half = radius // 2
    n = prints.count()
    bits = max(2, min(40, int(np.ceil(np.log2(max(n, 1) * len(masks(64, half)) / variants_a_slice + 1)))))
    spark = prints.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(masks(64, half)) // 40_000_000)
    sent = prints.select("fp").mapInArrow(lambda it: to_slices(it, bits, half), "slice long, fp long")
    # what each slice makes is summed up in the tasks; only crowded ones go on, a few in all that there are
    away = F.bit_count(F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("slice"))) + 1
    made = F.sum(F.element_at(F.array(*[F.lit(len(masks(64 - bits, half - d))) for d in range(half + 1)]), away.cast("int"))).alias("made")
    crowded = sent.groupBy("slice").agg(made).filter(F.col("made") > CROWDED * variants_a_slice)
    crowded = materialize(crowded.select(F.col("slice").alias("__slice"), F.ceil(F.log2(F.col("made") / variants_a_slice)).cast("int").alias("parts")), "crowded")
    sent = sent.join(crowded, F.col("slice") == F.col("__slice"), "left").select("slice", F.coalesce("parts", F.lit(0)).alias("parts"), "fp")
    sent = sent.mapInArrow(lambda it: to_parts(it, bits, half), "slice long, part long, parts int, fp long")
    dealt = sent.repartition(parts, "slice", "part").sortWithinPartitions("slice", "part")
    return dealt.mapInArrow(lambda it: linked(it, bits, half), "a long, b long")


def simhash_groups(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every text.

    The component_id is the smallest doc_id reachable over links of at most `radius` bits. A null or empty text, or one
    without words, has fingerprint zero and is linked like any other; a null doc_id is carried but never is an id, so a
    component of such rows alone has a null id; repeated rows share a fingerprint. Copies aren't expanded into pairs:
    links are between distinct fingerprints. Texts of any length are read whole; columns but doc_id and text are ignored. An
    empty table gives an empty one.
    """
    prints = materialize(texts(docs).mapInArrow(lambda it: fingerprints(it, shingle), "doc_id long, fp long"), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    groups = components(simhash_links(distinct, radius))
    rooted = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select(F.col("fp").alias("of_fp"), "component_id")
    return prints.join(of, F.col("fp") == F.col("of_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Near copies of a given similarity. One fingerprint of 64 bits can't tell 0.8 from 0.6 at a radius whose balls are small.
# So `tables` fingerprints of 32 bits each are hashed with balls of radius 1 (pairs within 2 bits of a table meet). The bits
# of all tables together go along: they tell the angle between two shingle sets, which only rules pairs out, and every pair
# that meets and that they leave is settled by the sets. Two rounds join what is dense, so that a group of n leaves few
# pairs: one over few tables with likely links of neighbours, one over all with a forest of the closest pairs between the
# groups so far. What they don't find the last round does: it takes every pair of different groups, once.

TABLES, TABLE_BITS = 32, 32
SIMILARITY, SHINGLE = 0.8, 5
#: Shingles up to which a text is also compared by the shingles themselves: of so few, bits differ too much by chance.
FEW = 80
#: Standard deviations beyond which the bits rule a pair out.
HOPELESS = 3.0
#: Rows of a document that one round of tables shuffles, and pairs that are judged at once.
ROWS_A_ROUND, PAIRS_AT_ONCE = 16, 100_000


def differing(similarity: float, bits: int, deviations: float) -> int:
    """Bits that differ on average between sets of this Jaccard similarity and equal size, and so many standard deviations."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + deviations * (bits * share * (1 - share)) ** 0.5)


def hashes_of(text: bytes, shingle: int) -> np.ndarray:
    """The set of the text's shingle hashes; of the whole sequence, if it has fewer words; empty without words."""
    words = text.lower().split()
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(line, 42)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    return np.array(list({hashed(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)}), np.uint64)


def sketch(text: bytes, tables: int, shingle: int) -> bytes:
    """The majority bits of all tables over the set of the text's shingles; zero without words."""
    return bits_of(hashes_of(text, shingle), tables)


def bits_of(h: np.ndarray, tables: int) -> bytes:
    out = np.zeros(tables * TABLE_BITS // 64, np.uint64)
    if len(h):
        for k in range(len(out)):
            x = h * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out[k] = majority(x ^ (x >> np.uint64(32)))
    return out.tobytes()


def sketches(batches: Iterator[pa.RecordBatch], tables: int, shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, few = [], []
        for _, _, data, offsets in spans_of_bytes(batch):
            raw = data.tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                h = hashes_of(raw[a:b], shingle)
                out.append(bits_of(h, tables))
                few.append(np.sort(h).view(np.int64) if 0 < len(h) <= FEW else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(out, pa.binary()), pa.array(few, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "bits", "few"])


def words_of(column: pa.Array) -> np.ndarray:
    """The bits of each row as 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def to_table_slices(batches: Iterator[pa.RecordBatch], some: list[int], bits: int) -> Iterator[pa.RecordBatch]:
    """(slice, key, bits, id, root) for each slice of `some` tables that the ball of radius 1 enters.

    A slice is table << bits | leading bits.
    """
    mask = masks(bits, 1)
    for batch in batches:
        ids, roots = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "root"))
        words = words_of(batch.column("bits")) if len(ids) else np.zeros((0, 1), np.uint64)
        for lo in range(0, len(ids), 4000):
            part = words[lo : lo + 4000]
            for t in some:
                key = part.view(np.uint32)[:, t]
                lead = key.astype(np.uint64) >> np.uint64(TABLE_BITS - bits)
                cuts = ((lead[:, None] ^ mask) | np.uint64(t << bits)).ravel()
                sent = np.repeat(part, len(mask), axis=0)
                ends = np.arange(len(sent) + 1, dtype=np.int32) * (8 * sent.shape[1])
                columns = [pa.array(x) for x in (cuts.astype(np.int32), np.repeat(key.view(np.int32), len(mask)), np.repeat(ids[lo : lo + 4000], len(mask)), np.repeat(roots[lo : lo + 4000], len(mask)))]
                columns.insert(2, pa.Array.from_buffers(pa.binary(), len(sent), [None, pa.py_buffer(ends), pa.py_buffer(sent)]))
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "key", "bits", "id", "root"])


def meeting(cut: int, key: np.ndarray, root: np.ndarray, bits: int, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of different roots that share a variant of the slice, some at a time: all of them, each in one
    variant of its table, or the neighbours in a variant only. Rows come in order of root."""
    rest = TABLE_BITS - bits
    key = key.view(np.uint32).astype(np.uint64)
    low = key & np.uint64((1 << rest) - 1)
    inside = key >> np.uint64(rest) == np.uint64(cut & ((1 << bits) - 1))
    who = np.flatnonzero(inside)
    met_at = low[who][:, None] ^ masks(rest, 1)
    met_at <<= np.uint64(32)
    met_at |= who[:, None].astype(np.uint64)
    met_at = met_at.ravel()
    if len(who) < len(low):
        met_at = np.concatenate([met_at, low[~inside] << np.uint64(32) | np.flatnonzero(~inside).astype(np.uint64)])
    met_at.sort()
    v = (met_at >> np.uint64(32)).astype(np.uint32)
    same = v[1:] == v[:-1]
    shared = np.zeros(len(v), bool)  # most variants have one row, which meets none
    shared[1:] = same
    shared[:-1] |= same
    v, o = v[shared], (met_at[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    del met_at
    if not len(v):
        return
    ends = np.append(np.flatnonzero(v[1:] != v[:-1]) + 1, len(v))
    runs = np.append(np.flatnonzero((v[1:] != v[:-1]) | (root[o[1:]] != root[o[:-1]])) + 1, len(v))
    at = np.arange(len(v))
    run = runs[np.searchsorted(runs, at, side="right")]
    count = ends[np.searchsorted(ends, at, side="right")] - run
    if not whole:
        count = np.minimum(count, run == at + 1)
    at = at[count > 0]
    run, count = run[at], count[at]
    total = np.cumsum(count)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
        n = count[lo:hi]
        i = np.repeat(at[lo:hi], n)
        j = np.repeat(run[lo:hi] - np.cumsum(n) + n, n) + np.arange(len(i))
        a, b = o[i], o[j]
        if whole:  # keys that differ share two variants: the one with their lowest bit swapped counts, the smaller of both
            swap = (key[a] ^ key[b]) & (np.uint64(0) - (key[a] ^ key[b]))
            once = np.minimum(key[a] ^ swap, key[b] ^ swap) == (np.uint64(cut & ((1 << bits) - 1)) << np.uint64(rest) | v[i])
        else:
            once = (key[a] != key[b]) | (v[i] == low[a])
        yield a[once], b[once]
        lo = hi


def links_of_table_slice(cut: int, key: np.ndarray, words: np.ndarray, node: np.ndarray, root: np.ndarray, bits: int, most: int, how: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) of different roots that meet in a slice and of whose bits at most `most` differ.

    how: "neighbours", a forest of the neighbours in a variant; "closest", a forest of roots by least differing bits; "all",
    every pair, in the first table where it meets.
    """
    order = np.lexsort((node, root))
    key, words, node, root = key[order], words[order], node[order], root[order]
    table = cut >> bits
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for a, b in meeting(cut, key, root, bits, how != "neighbours"):
        apart = words[a] ^ words[b]
        away = np.bitwise_count(apart).sum(axis=1, dtype=np.int64)
        close = away <= most
        if how == "all" and table:
            close[close] = (np.bitwise_count(apart[close].view(np.uint32)[:, :table]) > 2).all(axis=1)
        a, b, away = a[close], b[close], away[close]
        if not len(a):
            continue
        if how == "closest":
            a, b, away = (np.concatenate(x) for x in zip(best, (a, b, away), strict=True))
            order = np.lexsort((root[b], root[a], away))
            a, b, away = a[order], b[order], away[order]
            kept = spanning(root[a], root[b])
            best = (a[kept], b[kept], away[kept])
            continue
        if how == "neighbours":
            kept = spanning(node[a], node[b])
            a, b = a[kept], b[kept]
        yield np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
    if len(best[0]):
        a, b, _ = best
        yield np.minimum(node[a], node[b]), np.maximum(node[a], node[b])


def spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of those of the links a-b that join two components of the ones before."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = find(x), find(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            kept.append(i)
    return kept


def met(batches: Iterator[pa.RecordBatch], bits: int, most: int, how: str) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each slice; rows come sorted by slice."""

    def made(cut: int, rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        for a, b in links_of_table_slice(cut, *(np.concatenate(x) for x in zip(*rows, strict=True)), bits, most, how):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts, key, ids, roots = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("slice", "key", "id", "root"))
        columns = (key, words_of(batch.column("bits")), ids, roots)
        edges = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(cuts)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if now is not None and cuts[lo] != now:
                yield from made(int(now), held)
                held = []
            now = cuts[lo]
            held.append(tuple(c[lo:hi] for c in columns))
    if held:
        yield from made(int(now), held)


def shingled(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in spans_of_bytes(batch):
            raw = data.tobytes()
            sets = [hashes_of(raw[a:b], shingle).view(np.int64) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets), pa.int64()))], names=["node", "shingles"])


def short_pairs(rooted: DataFrame, few: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of different roots: every pair of texts with at most FEW shingles that may have the similarity.

    Two such sets share one of the first shingles of both, rarest first, of which a set of n has n - ceil(similarity * n) + 1,
    and their sizes are alike. rooted: id, root; few: id, few (the set). Exact; a shingle of very many texts is hardly ever
    among the first of one.
    """
    each = few.join(rooted.select("id", "root"), "id").select("id", "root", F.size("few").alias("n"), F.explode("few").alias("s"))
    often = each.groupBy(F.col("s").alias("__s")).agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(often.filter("df > 1"), F.col("s") == F.col("__s")).groupBy("id", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("all"))
    # shingles that no other text has come first of all and meet none
    alone = F.col("n") - F.size("all")
    first = F.greatest(F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1 - alone, F.lit(0)).cast("int")
    asked = materialize(ranked.select("id", "root", "n", F.explode(F.slice("all", F.lit(1), first)).alias("x")).select("id", "root", "n", "x.s"), "first")
    left, right = (asked.select("s", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "root", "n")]) for side in "ab")
    alike = (F.col("n_a") >= similarity * F.col("n_b") - 1e-9) & (F.col("n_b") >= similarity * F.col("n_a") - 1e-9)
    return left.join(right, "s").filter((F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & alike).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def settled(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity. nodes: id, text_hash of one of its texts."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = asked.join(nodes.select(F.col("id").alias("node"), F.col("text_hash").alias("__hash")), "node")
    text = docs.join(asked, F.col("text_hash") == F.col("__hash")).dropDuplicates(["node"]).select("node", "text")
    sets = materialize(text.mapInArrow(lambda it: shingled(it, shingle), "node long, shingles array<long>"), "sets")
    of = lambda node, name: sets.select(F.col("node").alias(node), F.col("shingles").alias(name))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").filter(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, tables: int = TABLES) -> DataFrame:
    """(doc_id, text_hash, root, first): the group of every text under links of about this similarity or more, and whether
    its doc_id is the group's smallest. A written table; text_hash is xxhash64 of the text, '' for null.

    Equal texts are linked always. Texts of Jaccard similarity s over their sets of 5-word shingles meet in one of 32
    tables with probability 0.98 at 0.8 and nearly 1 from 0.85; two of at most FEW shingles meet always, by their shingles. The
    share of 1024 bits that differs only rules pairs out; no pair is linked but by its sets or by equal bits, and of texts that
    meet none is left out unless both are in one group already. A group of n gives few pairs; a family of n texts that are alike
    but less than `similarity` gives up to n * n.
    """
    hashed = texts(docs).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    prints = materialize(hashed.mapInArrow(lambda it: sketches(it, tables, shingle), "doc_id long, text_hash long, bits binary, few array<long>"), "sketches")
    one = F.min(F.struct("text_hash", "few")).alias("one")  # the set is that of the text with the least hash
    distinct = materialize(prints.groupBy("bits").agg(F.min("doc_id").alias("least"), one).select(F.xxhash64("bits").alias("id"), "bits", "least", "one.text_hash", "one.few"), "nodes")
    few = distinct.filter("few IS NOT NULL").select("id", "few")
    n = distinct.count()
    bits = max(0, min(20, int(np.ceil(np.log2(max(n, 1) * (TABLE_BITS + 1) / (2 * VARIANTS_A_SLICE))))))
    likely, most = (differing(similarity, tables * TABLE_BITS, x) for x in (0, HOPELESS))

    def candidates(some: list[int], rooted: DataFrame, limit: int, how: str) -> DataFrame:
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(some) << bits >> 1)
        sent = rooted.mapInArrow(lambda it: to_table_slices(it, some, bits), "slice int, key int, bits binary, id long, root long")
        dealt = sent.repartition(parts, "slice").sortWithinPartitions("slice")
        links = dealt.mapInArrow(lambda it: met(it, bits, limit, how), "a long, b long")
        return materialize(links if how == "all" else links.distinct(), "met")

    # an eighth of the tables links what is dense; all of them then the groups that are close, and last every two that meet
    of = lambda pairs: materialize(settled(hashed, distinct, pairs, similarity, shingle), "settled")
    under = lambda groups: materialize(distinct.join(groups, distinct.id == groups.node, "left").select("id", "bits", F.coalesce("root", "id").alias("root")), "rooted")
    step = max(1, ROWS_A_ROUND // (bits + 1))
    rounds = [list(range(t, min(t + step, tables))) for t in range(0, tables, step)]
    every = lambda rooted, how: reduce(DataFrame.unionByName, [candidates(some, rooted, most, how) for some in rounds])
    found = of(candidates(list(range(max(1, tables // 8))), distinct.select("id", "bits", F.col("id").alias("root")), likely, "neighbours"))
    found = found.unionByName(of(every(under(components(found)), "closest").distinct()))
    rooted = under(components(found))
    groups = components(found.unionByName(of(every(rooted, "all").unionByName(short_pairs(rooted, few, similarity)).distinct())))
    rooted = distinct.join(groups, distinct.id == groups.node, "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("keep"))
    of_node = rooted.join(first, "root").select("id", "root", "keep")
    out = prints.select("doc_id", "text_hash", F.xxhash64("bits").alias("node")).join(of_node, F.col("node") == F.col("id"))
    return materialize(out.select("doc_id", "text_hash", "root", (F.col("doc_id").eqNullSafe(F.col("keep"))).alias("first")), "groups")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, tables: int = TABLES) -> DataFrame:
    """The rows of docs that stay when one document of each group of near copies does: that with the smallest doc_id.

    Of rows with that doc_id and one text any one stays; of different texts under one doc_id, that with the least
    text_hash. All columns are kept. A group whose doc_ids are all null keeps one row.
    """
    groups = similar_groups(docs, similarity, shingle, tables)
    stay = groups.filter("first").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("s"), F.count(F.lit(1)).alias("n"))
    stay = materialize(stay.select(F.col("s.doc_id").alias("__id"), F.col("s.text_hash").alias("__hash"), (F.col("n") > 1).alias("__again")), "stay")
    keyed = docs.withColumns({"__d": F.col("doc_id").cast("long"), "__t": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    kept = keyed.join(stay, F.col("__d").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__hash")))
    if not stay.filter("__again").isEmpty():  # only then can a row stand twice
        kept = kept.dropDuplicates(["__d", "__t"])
    return kept.select(*docs.columns)
