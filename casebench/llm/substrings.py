"""Exact substring dedup by the interval tree of common prefixes of a sparse suffix array.

A string of `length` bytes that occurs twice holds the same anchor at the same place: of its GRAM-byte grams the leftmost
with the least hash. So only suffixes that begin at anchors (about one byte in 70) can begin the common part, and only
those whose gram occurs again matter. For each such gram the suffixes (up to `length` bytes) are sorted into a suffix
array with its common-prefix array; a stack scan of that gives the tree of intervals, each a prefix shared by all suffixes
in it; and what stands before the suffixes, compared from the anchor leftwards, is tested for diversity: where it differs
the repeat is maximal. Every member of an interval is looked at, not just neighbours in the array.

Suffixes whose surroundings are equal on all sides are copies: they are counted, not compared, so a passage in a third of
all documents is one suffix with a count. A gram with very many different surroundings (the ends of a very common passage)
would be one large task, so it is cut: two suffixes match if for some p between `gram` and `length` they share p bytes from
the anchor on and length - p before it, and those with p in a range agree on the range's least shares. A crowded group is
dealt anew by these bytes for each half of its range, and those again if need be. Each part goes to the tree; a range of
one p is a single string, whose members are one interval without comparing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from casebench.llm.common import materialize, release, spans_of_bytes, texts

LENGTH, GRAM = 200, 56
#: Different surroundings that one group of the tree has; one with more is cut.
MOST_CONTEXTS = 20_000
#: Windows that are hashed at once; bits of a place among them.
PIECE, PLACE = 1 << 19, 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + (b ^ (b >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of data[i:i+gram] for each i, from hashes of its halves; gram: a multiple of 8."""
    x = data.astype(np.uint64)
    for s in (1, 2, 4):
        x = x[:-s] | x[s:] << np.uint64(8 * s)
    done, at, size, part = None, 0, 8, x
    parts = {8: x}
    while size * 2 <= gram:
        part = mixed(part[:-size], part[size:])
        size *= 2
        parts[size] = part
    n = len(data) - gram + 1
    for size in sorted(parts, reverse=True):
        if gram & size:
            piece = parts[size][at : at + n]
            done = piece if done is None else mixed(done, piece)
            at += size
    done = done * _A
    return done ^ (done >> np.uint64(32))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(place in data, hash) of each anchor, ascending; no window of `length` bytes crosses the end of a row."""
    n, wide = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.zeros(n + 1, np.int32)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    np.add.at(ends, np.maximum(offsets[full], offsets[full + 1] - length + 1), 1)
    np.add.at(ends, offsets[full + 1], -1)
    valid = np.cumsum(ends[:-1])[: n - length + 1] == 0
    places, hashes = [], []
    mask = np.uint64((1 << PLACE) - 1)
    for lo in range(0, n - length + 1, PIECE):
        g = gram_hashes(data[lo : lo + PIECE + length - 1], gram)
        least = (g & ~mask) | np.arange(len(g), dtype=np.uint64)
        s = 1
        while s * 2 <= wide:
            least = np.minimum(least[:-s], least[s:])
            s *= 2
        if wide > s:
            least = np.minimum(least[: -(wide - s)], least[wide - s :])
        at = (least & mask)[valid[lo : lo + PIECE]].astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        places.append(at + lo)
        hashes.append(g[at])
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, of which Python objects are made."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def keys(batch: pa.RecordBatch, lo: int, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key, tag) of rows: the doc_id, or for null a hash of the text; and 31 bits of the text, which tell apart equal ids."""
    ids = batch.column("doc_id").slice(lo, len(rows)).to_pylist()
    hashed = [xxhash.xxh3_64_intdigest(x) for x in rows]
    key = [i if i is not None else int(np.array(h, np.uint64).view(np.int64)) for i, h in zip(ids, hashed, strict=True)]
    return np.array(key, np.int64), np.array([h >> 33 for h in hashed], np.int64)


def cut(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def anchored(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(key, at, h, c): at is tag << 32 | place in the text, h the anchor's gram, c what surrounds it."""
    before = length - gram
    hashed = xxhash.xxh3_64_intdigest
    for batch in batches:
        for lo, _, data, offsets in spans_of_bytes(batch):
            rows = cut(data, offsets)
            key, tag = keys(batch, lo, rows)
            place, h = anchors(data, offsets, length, gram)
            if not len(place):
                continue
            row = np.searchsorted(offsets, place, side="right") - 1
            start = np.maximum(place - before, offsets[row])
            stop = np.minimum(place + length, offsets[row + 1])
            raw = data.tobytes()
            c = np.array([hashed(raw[a:b], x) for a, b, x in zip(start.tolist(), stop.tolist(), (place - start).tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(tag[row] << 32 | place - offsets[row]), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))], names=["key", "at", "h", "c"])


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tag, doc_id, bytes) of every row."""
    for batch in batches:
        for lo, hi, data, offsets in spans_of_bytes(batch):
            rows = cut(data, offsets)
            key, tag = keys(batch, lo, rows)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tag), batch.column("doc_id").slice(lo, hi - lo), pa.array(rows, pa.binary())], names=["key", "tag", "doc_id", "bytes"])


def surroundings(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(h, c, many, key, at, left, right) for each wanted anchor: the bytes before it, last first, and from it on."""
    before = length - gram
    for batch in sliced(batches, 256):
        out: list[tuple] = []
        for key, tag, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("key", "tag", "bytes", "wanted")), strict=True):
            for w in wanted:
                p = w["place"]
                out.append((w["h"], w["c"], w["many"], key, tag << 32 | p, text[max(0, p - before) : p][::-1], text[p : p + length]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["h", "c", "many", "key", "at", "left", "right"])


def padded(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """[string, byte] with zeros after the end, and the lengths."""
    flat = b"".join(s.ljust(width, b"\0") for s in strings)
    return np.frombuffer(flat, np.uint8).reshape(len(strings), width), np.array([len(s) for s in strings], np.int64)


def common(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Length of the common prefix, line by line."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(la, lb))


def intervals(prefix: list[int]) -> list[tuple[int, int, int]]:
    """(first, last, shared) of each interval of the tree, by a stack scan; prefix[i] is shared by suffixes i and i + 1."""
    out, stack = [], []
    for i, p in enumerate([*prefix, -1]):
        left = i
        while stack and stack[-1][1] > p:
            left, shared = stack.pop()
            out.append((left, i, shared))
        if p >= 0 and (not stack or stack[-1][1] < p):
            stack.append((left, p))
    return out


def order_of(m: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Lexicographic order of padded strings; a prefix comes first."""
    return np.lexsort((lengths, np.ascontiguousarray(m).view(f"S{m.shape[1]}").ravel())) if len(m) > 1 else np.zeros(len(m), np.int64)


def repeats(left: list[bytes], right: list[bytes], length: int, gram: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The maximal repeats of at least `length` bytes through one anchor: (before, after, members, reach of each member).

    All members share `after` bytes from the anchor on and `before` bytes before it, no more; a member's reach is the most
    that it shares with any other of the group before the anchor.
    """
    lm, ll = padded(left, length - gram)
    rm, rl = padded(right, length)
    order = order_of(rm, rl)
    prefix = common(rm[order[:-1]], rm[order[1:]], rl[order[:-1]], rl[order[1:]])
    rank = np.empty(len(left), np.int64)
    rank[order_of(lm, ll)] = np.arange(len(left))
    for first, last, shared in intervals(prefix.tolist()):
        need = length - shared
        members = order[first : last + 1]
        members = members[ll[members] >= need]
        if need > length - gram or len(members) < 2:
            continue
        members = members[np.argsort(rank[members])]
        reach = common(lm[members[:-1]], lm[members[1:]], ll[members[:-1]], ll[members[1:]])
        # left diversity: where neighbours in order share less than is needed one repeat ends and another begins
        for lo, hi in runs(reach >= need):
            inner = reach[lo:hi]
            most = np.maximum(np.concatenate([[0], inner]), np.concatenate([inner, [0]]))
            yield int(inner.min()), shared, members[lo : hi + 1], most


def maximal(left: list[bytes], right: list[bytes], length: int, gram: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(before, after, members) of every maximal repeat through one anchor: an interval of the tree of what follows, and
    within it one of the tree of what stands before, whose members don't all share more on either side.
    """
    lm, ll = padded(left, length - gram)
    rm, rl = padded(right, length)
    order = order_of(rm, rl)
    place = np.empty(len(left), np.int64)
    place[order] = np.arange(len(left))
    prefix = common(rm[order[:-1]], rm[order[1:]], rl[order[:-1]], rl[order[1:]])
    rank = np.empty(len(left), np.int64)
    rank[order_of(lm, ll)] = np.arange(len(left))
    for first, last, shared in intervals(prefix.tolist()):
        members = order[first : last + 1]
        members = members[np.argsort(rank[members])]
        reach = common(lm[members[:-1]], lm[members[1:]], ll[members[:-1]], ll[members[1:]])
        for lo, hi, before in intervals(reach.tolist()):
            if before + shared >= length:
                own = members[lo : hi + 1]
                at = place[own]
                if prefix[at.min() : at.max()].min() == shared:
                    yield before, shared, own


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def groups_of(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[list]]:
    """The named columns of rows that come sorted by the first name, as lists, so that no group is cut in two."""
    held: list[list] = [[] for _ in names]
    for batch in batches:
        for part, name in zip(held, names, strict=True):
            part += batch.column(name).to_pylist()
        if not held[0]:
            continue
        # the last group may go on in the next batch
        done = held[0].index(held[0][-1]) if held[0][0] != held[0][-1] else 0
        if done:
            yield [x[:done] for x in held]
            held = [x[done:] for x in held]
    if held[0]:
        yield held


def edges_of(column: list) -> list[tuple[int, int]]:
    cuts = [0, *(i for i in range(1, len(column)) if column[i] != column[i - 1]), len(column)]
    return list(zip(cuts, cuts[1:], strict=False))


def compared(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(key, tag, start, stop) of what repeats; rows come sorted by group. Groups of two are compared all at once."""
    for rows in groups_of(batches, ("group", "many", "key", "at", "left", "right")):
        got: tuple[list, list, list, list] = ([], [], [], [])
        edges = edges_of(rows[0])
        twos = [a for a, b in edges if b - a == 2]
        for lo in range(0, len(twos), 4096):
            pair = twos[lo : lo + 4096]
            x, y = ([padded([rows[c][a + d] for a in pair], w) for d in (0, 1)] for c, w in ((4, length - gram), (5, length)))
            before, after = (common(p[0][0], p[1][0], p[0][1], p[1][1]) for p in (x, y))
            for i in np.flatnonzero(before + after >= length).tolist():
                for a in (pair[i], pair[i] + 1):
                    if not rows[1][a]:
                        for part, v in zip(got, (rows[2][a], rows[3][a], int(before[i]), int(after[i])), strict=True):
                            part.append(v)
        for a, b in edges:
            if b - a > 2:
                # all repeats of a suffix hold its anchor, so together they are one range
                most = np.full((2, b - a), -1)
                for _, after, members, reach in repeats(rows[4][a:b], rows[5][a:b], length, gram):
                    most[0, members] = np.maximum(most[0, members], reach)
                    most[1, members] = np.maximum(most[1, members], after)
                for m in np.flatnonzero(most[0] >= 0).tolist():
                    if not rows[1][a + m]:
                        for part, v in zip(got, (rows[2][a + m], rows[3][a + m], int(most[0, m]), int(most[1, m])), strict=True):
                            part.append(v)
        at = np.array(got[1], np.int64)
        place = at & 0xFFFFFFFF
        yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(at >> 32), pa.array(place - np.array(got[2], np.int64)), pa.array(place + np.array(got[3], np.int64))], names=["key", "tag", "start", "stop"])


def owned(string: bytes, place: int, length: int, gram: int) -> bool:
    """Whether a window of the string has its anchor at this place. Only then has every place of the string an anchor there."""
    return bool((anchors(np.frombuffer(string, np.uint8), np.array([0, len(string)]), length, gram)[0] == place).any())


def grouped(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(repeat, before, after, h, c) of each maximal repeat and each of its members' surroundings; rows come sorted by group."""
    names = ["repeat", "before", "after", "h", "c"]
    for rows in groups_of(batches, ("group", "h", "c", "left", "right", "many")):
        out: list[tuple] = []
        for a, b in edges_of(rows[0]):
            # surroundings that occur several times are a repeat, alone or of those that the tree finds
            found = [(len(rows[3][k]), len(rows[4][k]), [k - a]) for k in range(a, b) if rows[5][k]]
            if b - a > 1:
                found += maximal(rows[3][a:b], rows[4][a:b], length, gram)
            for before, after, members in found:
                m = a + int(members[0])
                string = rows[3][m][:before][::-1] + rows[4][m][:after]
                if owned(string, before, length, gram):
                    name = xxhash.xxh3_128_hexdigest(string)
                    out += [(name, before, after, rows[1][a + int(k)], rows[2][a + int(k)]) for k in members]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names)


def named(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(repeat, before, after, h, c) of rows whose bytes `before` and `after` the anchor are a repeat."""
    for batch in sliced(batches, 4096):
        out: list[tuple] = []
        for x, y, i, k, h, c in zip(*(batch.column(n).to_pylist() for n in ("left", "right", "before", "after", "h", "c")), strict=True):
            string = x[:i][::-1] + y[:k]
            if owned(string, i, length, gram):
                out.append((xxhash.xxh3_128_hexdigest(string), i, k, h, c))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["repeat", "before", "after", "h", "c"])


def united(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the spans, within the text."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, s["start"]), min(size, s["stop"])) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif b > a:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"]
    list_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in sliced(batches, 512):
        out: list[tuple] = []
        for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "bytes", "spans")), strict=True):
            found, kept, at = united(spans, len(text)), [], 0
            for a, b in found:
                kept.append(text[at:a])
                at = b
            rest = b"".join([*kept, text[at:]])
            out.append((doc_id, len(text), len(text) - len(rest), len(found), hashlib.sha256(rest).hexdigest(), [{"start": a, "stop": b} for a, b in found], rest))
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), list_type, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)


def placed() -> Column:
    """The place in the text, of `at`."""
    return F.col("at").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def surrounded(docs: DataFrame, length: int, gram: int, copies: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: anchors (key, at, h, c) whose gram occurs again; contexts (h, c, n, one) of the different surroundings;
    and sides (h, c, many, key, at, left, right), the bytes of one place of each of those whose gram has several, or with
    `copies` also of those that occur several times.
    """
    found = texts(docs).mapInArrow(lambda it: anchored(it, length, gram), "key long, at long, h long, c long")
    # written first, so that the join's sides are plain shuffles, of which skewed partitions can be split; so are copies' below
    again = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "grams")
    found = materialize(found.join(again, "h"), "anchors")
    release(again)
    contexts = materialize(found.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at")).alias("one")), "contexts")
    several = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("contexts"), F.max("n").alias("most")).filter("contexts > 1 OR most > 1" if copies else "contexts > 1").select("h")
    wanted = contexts.join(several, "h").select("h", "c", (F.col("n") > 1).alias("many"), F.col("one.key").alias("key"), F.col("one.at").alias("at"))
    wanted = wanted.select("key", F.shiftright("at", 32).alias("tag"), F.struct(placed().alias("place"), "h", "c", "many").alias("w")).groupBy("key", "tag").agg(F.collect_list("w").alias("wanted"))
    at_hand = texts(docs).mapInArrow(keyed, "key long, tag long, doc_id long, bytes binary").select("key", "tag", "bytes")
    sides = at_hand.join(wanted, ["key", "tag"]).mapInArrow(lambda it: surroundings(it, length, gram), "h long, c long, many boolean, key long, at long, left binary, right binary").dropDuplicates(["key", "at"])
    return found, contexts, materialize(sides, "surroundings")


def resolved(sides: DataFrame, length: int, gram: int, most_contexts: int, tree: Callable[[DataFrame], DataFrame], single: Callable[[DataFrame], DataFrame], weight: Column | None = None) -> DataFrame:
    """The union of tree(groups of at most most_contexts sides) and single(the members of one string, split at byte p).

    A group is what its range lo to hi of p says that the members share: the gram at first. A crowded group's range is halved
    and its members dealt by what each half asks for, all ranges of a level in one table; who is alone in a group drops out.
    Without a crowded group nothing is written. weight: how many a side counts for, 1 by default.
    """
    part = sides.withColumns({"group": F.encode(F.col("h").cast("string"), "UTF-8"), "lo": F.lit(gram), "hi": F.lit(length)})
    done, before = None, None
    while True:
        sizes = part.groupBy("group").agg(F.sum(weight if weight is not None else F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi")).filter("n > 1")
        crowded = materialize(sizes.filter((F.col("n") > most_contexts) & (F.col("lo") < F.col("hi"))).select("group"), "crowded")
        last = crowded.isEmpty()
        if last and before is None:
            return tree(part)
        many = sizes.filter((F.col("n") <= most_contexts) | (F.col("lo") == F.col("hi"))).select("group")
        kept = part.join(many, "group", "left_semi")
        out = tree(kept.filter("lo < hi")).unionByName(single(kept.filter("lo = hi").withColumn("p", F.col("lo"))))
        out = materialize(out, "resolved")
        done = out if done is None else done.unionByName(out)
        rest = None if last else materialize(part.join(crowded, "group", "left_semi").drop("group"), "rest")
        for table in (crowded, before):
            if table is not None:
                release(table)
        if last:
            return done
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct("lo", middle.alias("hi")), F.struct((middle + 1).alias("lo"), "hi"))
        part = rest.withColumn("half", F.explode(halves)).withColumns({"lo": F.col("half.lo"), "hi": F.col("half.hi")}).drop("half")
        part = part.filter((F.octet_length("right") >= F.col("lo")) & (F.octet_length("left") >= length - F.col("hi")))
        shared = F.concat(F.encode(F.concat_ws("|", F.col("h").cast("string"), F.col("lo").cast("string"), F.col("hi").cast("string"), F.lit("")), "UTF-8"), F.substring("right", F.lit(1), F.col("lo")), F.substring("left", F.lit(1), length - F.col("hi")))
        part, before = part.withColumn("group", F.unhex(F.sha2(shared, 256))), rest


def repeat_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(key, tag, start, stop) of byte ranges that strings of `length` bytes which also start elsewhere cover."""
    found, contexts, sides = surrounded(docs, length, gram)
    tag = F.shiftright("at", 32)
    copies = found.join(contexts.filter("n > 1").select("h", "c"), ["h", "c"]).select("key", tag.alias("tag"), (placed() - (length - gram)).alias("start"), (placed() + length).alias("stop"))

    def tree(part: DataFrame) -> DataFrame:
        rows = part.select("group", "many", "key", "at", "left", "right").repartition("group").sortWithinPartitions("group")
        return rows.mapInArrow(lambda it: compared(it, length, gram), "key long, tag long, start long, stop long")

    def single(part: DataFrame) -> DataFrame:
        return part.filter("not many").select("key", tag.alias("tag"), (placed() - (length - F.col("p"))).alias("start"), (placed() + F.col("p")).alias("stop"))

    spans = materialize(copies.unionByName(resolved(sides, length, gram, most_contexts, tree, single)), "spans")
    for done in (found, contexts, sides):
        release(done)
    return spans


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(repeat, size, key, tag, start): the maximal repeats of at least `length` bytes, and every place of each.

    repeat is a digest of the repeated bytes, key and tag name the row (see keys()), start is a byte. A repeat is looked at
    length - gram bytes before an anchor and `length` after it; what goes on beyond is told by the repeats of its next
    anchors, so a long passage is a chain of overlapping repeats. Strings of a cut group are repeats of exactly `length` bytes
    where the range came down to one p.
    """
    found, _, sides = surrounded(docs, length, gram, copies=True)
    schema = "repeat string, before long, after long, h long, c long"

    def tree(part: DataFrame) -> DataFrame:
        rows = part.select("group", "h", "c", "left", "right", "many").repartition("group").sortWithinPartitions("group")
        return rows.mapInArrow(lambda it: grouped(it, length, gram), schema)

    def single(part: DataFrame) -> DataFrame:
        return part.withColumns({"before": length - F.col("p"), "after": F.col("p")}).mapInArrow(lambda it: named(it, length, gram), schema)

    every = resolved(sides, length, gram, most_contexts, tree, single, 1 + F.col("many").cast("int"))
    start = placed() - F.col("before")
    return every.distinct().join(found, ["h", "c"]).select("repeat", (F.col("before") + F.col("after")).alias("size"), "key", F.shiftright("at", 32).alias("tag"), start.alias("start")).distinct()


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed ranges and the kept bytes of every text.

    A byte goes if a string of `length` bytes over it also starts anywhere else, in the same text or another, as the input
    stands. A null text is empty. Rows with a null doc_id are texts of their own; repeated rows are copies of each other.
    length - gram must be at least 1, gram a multiple of 8. Copies are told by 64 bits of the gram and 64 of its
    surroundings, all else by its bytes. Texts of any length are read whole; columns but doc_id and text are ignored. Texts
    are shuffled twice, by row; all else is short rows.
    """
    spans = repeat_spans(docs, length, gram, most_contexts)
    of = spans.groupBy("key", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    at_hand = texts(docs).mapInArrow(keyed, "key long, tag long, doc_id long, bytes binary")
    both = at_hand.join(of, ["key", "tag"], "left").select("doc_id", "bytes", "spans")
    return both.mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,stop:long>>, kept binary")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed", "kept")
