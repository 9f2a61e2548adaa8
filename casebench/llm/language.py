"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds the n-grams of all languages at once: a slot is a mask with a bit for each language, an
n-gram sets the bit of its language in `hashes` slots, and the AND of its slots names all languages that contain it. A
text's n-grams give each language a popcount; what a filter of that fill answers by mistake is taken off, and the
language with the largest corrected share is predicted. The table has a fixed size, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casebench.llm.common import spans_of_bytes, texts

#: Most texts of a language from which its n-grams are learned.
SAMPLE_DOCS = 600
NGRAM, TABLE_BITS, HASHES, MIN_COUNT = 5, 20, 2, 3
UND = "und"
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_BLANK = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def letters(text: bytes) -> bytes:
    """The text in lower case with all ASCII but letters as single blanks, one before and one after; empty without a letter."""
    lower = text.decode("utf-8", "replace").lower()
    words = lower.encode().translate(_BLANK).split()
    if not words or not (any(97 <= w[0] <= 122 for w in words) or any(c.isalpha() for c in lower)):
        return b""
    return b" " + b" ".join(words) + b" "


def grams(data: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """The n-gram at each byte as a number; the last n-1 bytes have none."""
    m = max(len(data) - n + 1, 0)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out << np.uint64(8) | data[k : k + m]
    return out


@dataclass(frozen=True)
class Filters:
    """The bit-sliced table [slot, word], its languages (language i is bit i % wide of word i // wide), their false-positive
    rates, and the commonest language."""

    table: np.ndarray
    languages: tuple[str, ...]
    errors: tuple[float, ...]
    fallback: int
    n: int = NGRAM
    hashes: int = HASHES

    def slots(self, g: np.ndarray, k: int) -> np.ndarray:
        return ((g * np.uint64(_MULTIPLIERS[k])) >> np.uint64(64 - (self.table.shape[0].bit_length() - 1))).astype(np.int64)

    def containing(self, g: np.ndarray) -> np.ndarray:
        """[n-gram, word]: for each n-gram the mask of the languages that contain it."""
        found = self.table[self.slots(g, 0)]
        for k in range(1, self.hashes):
            found = found & self.table[self.slots(g, k)]
        return found


def fit(rows: list[tuple[str, str]], n: int = NGRAM, table_bits: int = TABLE_BITS, hashes: int = HASHES, min_count: int = MIN_COUNT, sizes: dict[str, int] | None = None) -> Filters:
    """Learn from (lang, text): a language's filter gets the n-grams that it has min_count times (all, if it has few texts).

    sizes: how many texts each language has in the corpus; the commonest answers for texts without an n-gram.
    """
    languages = tuple(sorted({lang for lang, _ in rows}))
    kind, wide = next((t, w) for t, w in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(languages) <= w or w == 64)
    empty = Filters(np.zeros((1 << table_bits, max(1, -(-len(languages) // wide))), kind), languages, (0.0,) * len(languages), 0, n, hashes)
    sizes = sizes or {x: sum(x == y for y, _ in rows) for x in languages}
    for i, lang in enumerate(languages):
        own = [letters((t or "").encode()) for x, t in rows if x == lang]
        found, counts = np.unique(np.concatenate([grams(np.frombuffer(x, np.uint8), n) for x in own]), return_counts=True)
        kept = found[counts >= min(min_count, 1 + len(own) // 10)]
        for k in range(hashes):
            empty.table[np.unique(empty.slots(kept, k)), i // wide] |= kind(1 << i % wide)
    fill = [float(np.mean((empty.table[:, i // wide] >> kind(i % wide)) & kind(1))) for i in range(len(languages))]
    return Filters(empty.table, languages, tuple(f**hashes for f in fill), max(range(len(languages)), key=lambda i: sizes[languages[i]], default=0), n, hashes)


def identify(rows: list[bytes], filters: Filters) -> tuple[list[str], list[float]]:
    """The language and the corrected share of n-grams of each text, in one pass over their joined letters.

    Of languages with equal shares the first by name is taken.
    """
    cleaned = [letters(x) for x in rows]
    lengths = np.array([len(x) for x in cleaned], np.int64)
    ends = np.cumsum(lengths)
    hits = filters.containing(grams(np.frombuffer(b"".join(cleaned) + b" " * (filters.n - 1), np.uint8), filters.n)) if len(rows) else np.zeros((0, 1), np.uint8)
    wide = 8 * hits.dtype.itemsize
    counts = np.maximum(lengths - filters.n + 1, 0)
    starts, stops = ends - lengths, ends - lengths + counts
    shares = np.zeros((len(rows), max(len(filters.languages), 1)))
    for i, wrong in enumerate(filters.errors):
        total = np.zeros(len(hits) + 1, np.int64)
        np.cumsum((hits[:, i // wide] >> hits.dtype.type(i % wide)) & hits.dtype.type(1), dtype=np.int64, out=total[1:])
        got = total[stops] - total[starts]
        shares[:, i] = (got - wrong * counts) / np.maximum((1 - wrong) * counts, 1e-9)
    shares = np.clip(shares, 0, 1)
    best = shares.argmax(axis=1)
    best[shares.max(axis=1) == 0] = filters.fallback
    known = (lengths > 0) & bool(filters.languages)
    lang = [filters.languages[b] if k else UND for b, k in zip(best.tolist(), known.tolist(), strict=True)]
    return lang, np.where(known, shares[np.arange(len(rows)), best], 0.0).tolist()


def predicted(batches: Iterator[pa.RecordBatch], filters: Filters, carried: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in spans_of_bytes(batch):
            raw = data.tobytes()
            lang, score = identify([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], filters)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in carried), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*carried, "lang_pred", "score"])


def learned(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Filters from labelled (doc_id, text, lang): of each language about sample_docs texts, picked by a hash of doc_id (of the
    text where it is null). The share is sample_docs in as many as there are, in whole numbers, so that a language of any size
    is learned; one of at most sample_docs texts is learned from all of them.
    """
    labelled = labelled.filter("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return fit([])
    total = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, n)])
    mark = F.xxhash64(F.lit("lang"), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    picked = labelled.filter(F.pmod(mark, total[F.col("lang")]) < sample_docs).select("doc_id", "lang", "text")
    rows = sorted((r.lang, r.text) for r in picked.limit(2 * sample_docs * len(sizes)).collect())
    return fit(rows, sizes=sizes)


def identify_languages(docs: DataFrame, filters: Filters, *carried: str) -> DataFrame:
    """doc_id (and the carried columns), lang_pred and score of every text, from its whole text alone.

    `und` with score 0: a null text, or one without a letter, or nothing learned. A text too short for an n-gram gets the
    commonest learned language with score 0; of equal shares the first language by name wins. Null doc_ids and repeated rows
    are carried, texts of any length read whole; no column but doc_id, text and the carried ones is read. One pass, no
    shuffle; the table that goes to the executors has a fixed size for each 64 languages.
    """
    table = docs.sparkSession.sparkContext.broadcast(filters)
    names = ["doc_id", *carried]
    given = docs.select(*names, *([] if "text" in carried else [F.col("text").cast("string").alias("text")]))
    fields = ", ".join(f"`{n}` {t}" for n, t in given.dtypes if n in names)
    return given.mapInArrow(lambda it: predicted(it, table.value, names), f"{fields}, lang_pred string, score double")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = learned(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return identify_languages(texts(docs), filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
