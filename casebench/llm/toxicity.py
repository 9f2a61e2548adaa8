"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = s(cut[k] - w . x) for the ordered cuts of all grades but the last, with one weight vector shared by all
cuts. x marks which word beginnings a text has, hashed to a fixed number of features. The expected severity is the mean
grade. The model is fitted with proximal gradient steps on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casebench.llm.common import spans_of_bytes, texts
from casebench.llm.language import letters

#: Most labelled texts that the model is fitted on; hashed features; word beginnings, in bytes (8 also stands for the word).
SAMPLE_ROWS, FEATURE_BITS, BEGINNINGS = 6000, 18, (4, 5, 6, 7, 8)
#: In a run of letters of more bytes (a script without spaces) a word may begin at any character.
LONG_RUN = 24
STEPS, L1 = 200, 1e-4
#: Features that fewer sampled texts have aren't used; of the others the so many that go most with the grade are.
MIN_TEXTS, MOST_FEATURES = 3, 4096


def features(rows: list[bytes], bits: int = FEATURE_BITS, beginnings: tuple[int, ...] = BEGINNINGS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each text's word beginnings, once a row, sorted; words are runs of letters, in lower case."""
    cleaned = [letters(x) for x in rows]
    lengths = np.array([len(x) for x in cleaned], np.int64)
    data = np.frombuffer(b"".join(cleaned) + b" " * 9, np.uint8)
    start = np.flatnonzero((data[:-1] == 32) & (data[1:] != 32)) + 1
    size = np.flatnonzero((data[:-1] != 32) & (data[1:] == 32)) + 1 - start
    if (size > LONG_RUN).any():
        edge = np.zeros(len(data) + 1, np.int8)
        edge[start[size > LONG_RUN]], edge[(start + size)[size > LONG_RUN]] = 1, -1
        within = np.flatnonzero((np.cumsum(edge[:-1], dtype=np.int8) > 0) & (data & 0xC0 != 0x80))
        start = np.union1d(start, within)
    row = np.searchsorted(np.cumsum(lengths), start, side="right")
    head = np.zeros(len(start), np.uint64)
    open_word = np.ones(len(start), bool)
    keys = []
    for k in range(max(beginnings)):
        byte = data[np.minimum(start + k, len(data) - 1)]
        open_word &= byte != 32
        head = head << np.uint64(8) | np.where(open_word, byte, 0).astype(np.uint64)
        if k + 1 in beginnings:
            has = open_word if k + 1 < max(beginnings) else slice(None)  # a shorter word only counts as a whole
            hashed = ((head[has] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            keys.append(row[has].astype(np.uint64) << np.uint64(bits) | hashed)
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    return (found >> np.uint64(bits)).astype(np.int64), (found & np.uint64((1 << bits) - 1)).astype(np.int64)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Ordinal:
    """Shared weights and ascending cuts; grade k lies between cuts k-1 and k. grades: the values that they stand for."""

    weights: np.ndarray
    cuts: np.ndarray
    grades: tuple[int, ...]

    def probabilities(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        score = np.bincount(row, self.weights[feature], minlength=n)[:n]
        below = logistic(self.cuts[None, :] - score[:, None])
        return np.diff(np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1), axis=1)


def fit(grade: np.ndarray, row: np.ndarray, feature: np.ndarray, bits: int = FEATURE_BITS, steps: int = STEPS, l1: float = L1, min_texts: int = MIN_TEXTS) -> Ordinal:
    """From the grade of each text and the (row, feature) that they have, by accelerated proximal gradient steps on the mean log loss and l1 * |w|."""
    grades = tuple(np.unique(grade).tolist())
    size = 1 << bits
    if len(grades) < 2:
        return Ordinal(np.zeros(size), np.zeros(0), grades or (0,))
    n, y = len(grade), np.searchsorted(grades, grade)
    have = np.bincount(feature, minlength=size)
    centred = (y - y.mean()) / max(y.std(), 1e-9)
    linked = np.abs(np.bincount(feature, centred[row], minlength=size)) / np.sqrt(np.maximum(have * (1 - have / n), 0.5))
    used = np.flatnonzero(have >= min_texts)
    used = np.sort(used[np.argsort(-linked[used], kind="stable")[:MOST_FEATURES]])
    where = np.full(size, -1)
    where[used] = np.arange(len(used))
    keep = where[feature] >= 0
    row, col = row[keep], where[feature[keep]]
    share = np.cumsum(np.bincount(y, minlength=len(grades)))[:-1] / n
    cuts = np.log(share / (1 - share))
    w = np.zeros(len(used))
    v, old_w, old_cuts, mix, rate = w, w, cuts, cuts, 1.0

    def loss_and_slope(w: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        score = np.bincount(row, w[col], minlength=n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = logistic(edges[y + 1] - score), logistic(edges[y] - score)
        hi[y == len(cuts)], lo[y == 0] = 1.0, 0.0
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        slope_cuts = np.array([(d_lo[y == k + 1].sum() - d_hi[y == k].sum()) / n for k in range(len(cuts))])
        return -np.log(p).mean(), np.bincount(col, ((d_hi - d_lo) / n)[row], minlength=len(used)), slope_cuts

    momentum = 1.0
    for _ in range(steps):
        loss, slope, slope_cuts = loss_and_slope(v, mix)
        while True:
            moved = v - rate * slope
            new_w = np.sign(moved) * np.maximum(np.abs(moved) - rate * l1, 0)
            new_cuts = np.sort(mix - rate * slope_cuts)
            step = np.concatenate([new_w - v, new_cuts - mix])
            if rate < 1e-6 or loss_and_slope(new_w, new_cuts)[0] <= loss + step @ np.concatenate([slope, slope_cuts]) + step @ step / (2 * rate) + 1e-12:
                break
            rate /= 2
        nxt = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        v, mix = new_w + (momentum - 1) / nxt * (new_w - old_w), np.sort(new_cuts + (momentum - 1) / nxt * (new_cuts - old_cuts))
        old_w, old_cuts, momentum, rate = new_w, new_cuts, nxt, rate * 1.1
    weights = np.zeros(size)
    weights[used] = old_w
    return Ordinal(weights, old_cuts, grades)


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in spans_of_bytes(batch):
            raw = data.tobytes()
            row, feature = features([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            ends = np.searchsorted(row, np.arange(hi - lo + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("grade").slice(lo, hi - lo), lists], names=["grade", "features"])


def learned(docs: DataFrame, labels: DataFrame, grade: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Ordinal:
    """Fit on about sample_rows of the documents that have a grade, picked by a hash of doc_id: sample_rows in as many as there
    are, in whole numbers, so that no size leaves none. All of them, if there are no more.
    """
    graded = labels.filter(f"doc_id is not null and {grade} is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max(grade).cast("int").alias("grade"))
    total = max(graded.count(), 1)
    picked = F.broadcast(graded.filter(F.pmod(F.xxhash64(F.lit("grade"), "of"), F.lit(total).cast("long")) < sample_rows).limit(2 * sample_rows))
    rows = texts(docs).join(picked, F.col("doc_id") == F.col("of")).select("grade", "text").mapInArrow(featured, "grade int, features array<int>").toArrow()
    lists = rows.column("features").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    return fit(rows.column("grade").to_numpy(), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), lists.flatten().to_numpy())


def scored(batches: Iterator[pa.RecordBatch], model: Ordinal) -> Iterator[pa.RecordBatch]:
    values = np.array(model.grades, float)
    for batch in batches:
        for lo, hi, data, offsets in spans_of_bytes(batch):
            raw = data.tobytes()
            row, feature = features([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            p = model.probabilities(row, feature, hi - lo)
            grade = values[p.argmax(axis=1)]
            over = p[:, 1:].sum(axis=1) if len(values) > 1 else np.zeros(hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(p @ values), pa.array(grade.astype(np.int32)), pa.array(over >= 0.5)], names=["doc_id", "severity", "grade", "toxic"])


def grade_documents(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity (the mean grade), grade (the likeliest) and toxic (over the lowest grade with even odds or more).

    A null or empty text has no features and gets what the cuts alone say; of equally likely grades the lowest is taken. Null
    doc_ids and repeated rows are graded each, texts of any length whole; columns but doc_id and text are ignored. With fewer than two grades among the labels every text has the one there is (0 without labels). One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return texts(docs).mapInArrow(lambda it: scored(it, sent.value), "doc_id long, severity double, grade int, toxic boolean")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grade_documents(docs, learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
