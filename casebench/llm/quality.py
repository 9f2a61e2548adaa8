"""Quality rules: a short-circuit cascade ordered by rejections per cost.

The base figures of each text are exact. The further rules are independent yes/no tests; which of them rejects a text
first doesn't change the verdict, so their order is free: on a bounded sample each rule's cost and share of rejections
are measured, and the rules run in order of rejections per second, each only on texts that no earlier rule rejected.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casebench.llm.common import SPACE_BYTES, WORD, byte_table, spans_of_bytes, sums_by_row, texts

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
#: Most texts on which the rules' costs and rejections are estimated.
SAMPLE_ROWS = 200


@dataclass(frozen=True)
class Rule:
    """A name and a test of a whole text's UTF-8 bytes: True rejects."""

    name: str
    rejects: Callable[[bytes], bool]


def count(text: bytes, members: bytes) -> int:
    return len(text) - len(text.translate(None, members))


def shouts(text: bytes) -> bool:
    """More than 6 of 10 ASCII letters are capitals."""
    upper, lower = count(text, UPPER), count(text, LOWER)
    return 10 * upper > 6 * (upper + lower)


def symbol_heavy(text: bytes) -> bool:
    """More than 2 of 10 bytes that aren't white space are `#*$%&|<>`."""
    return 10 * count(text, SYMBOLS) > 2 * (len(text) - count(text, SPACE_BYTES))


def digit_heavy(text: bytes) -> bool:
    """More than 4 of 10 bytes that aren't white space are digits."""
    return 10 * count(text, DIGIT) > 4 * (len(text) - count(text, SPACE_BYTES))


def odd_words(text: bytes) -> bool:
    """The mean word has fewer than 2 or more than 20 bytes."""
    n, size = len(text.split()), len(text) - count(text, SPACE_BYTES)
    return size < 2 * n or size > 20 * n


def repeats_lines(text: bytes) -> bool:
    """More than half of the lines that have a word repeat an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return 2 * (len(lines) - len(set(lines))) > len(lines)


RULES = (Rule("shouts", shouts), Rule("symbol_heavy", symbol_heavy), Rule("digit_heavy", digit_heavy), Rule("odd_words", odd_words), Rule("repeats_lines", repeats_lines))


def ordered(rules: tuple[Rule, ...], sample: list[bytes], clock: Callable[[], float] = time.perf_counter) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a text, share rejected), by share rejected per second, largest first; ties keep the given order."""
    found = []
    for rule in rules:
        began = clock()
        hits = sum(map(rule.rejects, sample))
        found.append((rule, max(clock() - began, 1e-9) / max(len(sample), 1), hits / max(len(sample), 1)))
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(rules: list[Rule], rows: list[bytes]) -> list[str | None]:
    """For each text the first rule that rejects it, or None; a rule sees only what the earlier ones kept."""
    out: list[str | None] = [None] * len(rows)
    left = range(len(rows))
    for rule in rules:
        kept = []
        for i in left:
            if rule.rejects(rows[i]):
                out[i] = rule.name
            else:
                kept.append(i)
        left = kept
    return out


def repeat_words(rows: list[list[bytes]]) -> np.ndarray:
    """For each list of words the number of words in 3-word windows that occur twice or more in the list."""
    lengths = np.array([len(x) for x in rows], np.int64)
    out = np.zeros(len(rows), np.int64)
    total = int(lengths.sum())
    if total < 3:
        return out
    ids = np.empty(total, np.int64)
    at = most = 0
    for words in rows:
        seen: dict[bytes, int] = {}
        put = seen.setdefault
        ids[at : at + len(words)] = [put(w, len(seen)) for w in words]
        at += len(words)
        most = max(most, len(seen))
    row = np.repeat(np.arange(len(rows)), lengths)
    last = np.repeat(np.cumsum(lengths), lengths)
    start = np.flatnonzero(np.arange(total) + 3 <= last)
    if not len(start):
        return out
    bits = max(most.bit_length(), 1)
    window = (ids[start] << bits | ids[start + 1]) if 2 * bits < 62 else np.unique(np.stack([ids[start], ids[start + 1]]), axis=1, return_inverse=True)[1].ravel()
    for part in (ids[start + 2], row[start]):
        wide = max(int(part.max()).bit_length(), 1)
        if int(window.max()).bit_length() + wide > 62:
            window = np.unique(window, return_inverse=True)[1].astype(np.int64)
        window = window << wide | part
    order = np.argsort(window, kind="stable")
    got = window[order]
    same = got[1:] == got[:-1]
    twice = np.zeros(len(got), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = start[order[twice]]
    covered = np.zeros(total + 2, bool)
    for k in range(3):
        covered[hit + k] = True
    np.add.at(out, row[np.flatnonzero(covered[:total])], 1)
    return out


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())])


def judge(batches: Iterator[pa.RecordBatch], rules: list[Rule], min_words: int, max_repeat: int) -> Iterator[pa.RecordBatch]:
    table = np.ones(256, np.uint8)
    table[list(SPACE_BYTES)] = 0
    table[0x80:0xC0] = 0  # continuation bytes: not the first of a code point
    symbols = byte_table(SYMBOLS)
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, data, offsets in spans_of_bytes(batch):
            raw = data.tobytes()
            rows = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            words = [x.split() for x in rows]
            n_words = np.array([len(x) for x in words], np.int64)
            dups = []
            for x in rows:
                lines = [y for y in x.split(b"\n") if y.strip()]
                dups.append(len(lines) - len(set(lines)))
            n_repeat = repeat_words(words)
            failed = (n_words < min_words) | (100 * n_repeat > max_repeat * n_words)
            why: list[str | None] = ["base" if f else None for f in failed.tolist()]
            left = np.flatnonzero(~failed).tolist()
            for i, name in zip(left, cascade(rules, [rows[i] for i in left]), strict=True):
                why[i] = name
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in (n_words, sums_by_row(table[data], offsets), sums_by_row(symbols[data], offsets), dups, n_repeat)), pa.array(failed), pa.array([x is None for x in why]), pa.array(why, pa.string())], schema=OUT)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat: int = 50, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A verdict on every text, with the base figures and the first rule that rejected it.

    base_failed: fewer than min_words words, or more than max_repeat of 100 words in repeated 3-word windows. kept: neither
    base_failed nor rejected by a rule. A null text has no words and fails; a null doc_id is carried; repeated rows are
    judged each; an empty table gives an empty one. `sample_rows` bounds the sample that orders the cascade: the verdict
    doesn't depend on it, only rejected_by does: costs are seconds, so of two rules that reject a text the one that is named may
    change from run to run. Columns but doc_id and text are ignored. One pass over the texts, no shuffle but the sample's top rows.
    """
    docs = texts(docs)
    # one text of so many that the first twentieth of the partitions fills the sample; the count comes from the footers
    part = max(1, 20 * 1_000_000 * sample_rows // max(docs.count(), 1))
    picked = docs.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part) & F.col("text").isNotNull()).select("text").limit(sample_rows)
    sample = [r.text.encode() for r in picked.collect()]
    order = [x[0] for x in ordered(rules, sample)] if sample else list(rules)
    return docs.mapInArrow(lambda it: judge(it, order, min_words, max_repeat), SCHEMA)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rejected_by")


_LEN = "strlen(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))"
_COUNT = "(strlen(t) - strlen(regexp_replace(t, '[{}]', '', 'g')))"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM d),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER v || ' ' || lead(word, 2) OVER v AS g FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS u FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
b AS (SELECT w.doc_id, t, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  {_COUNT.format("#*$%&|<>")} AS n_symbols, coalesce(m.n - m.u, 0) AS n_dup_lines, coalesce(m.n, 0) AS n_lines, coalesce(c.n, 0) AS n_repeat_words,
  {_LEN} AS size, {_COUNT.format("A-Z")} AS upper, {_COUNT.format("a-z")} AS lower, {_COUNT.format("0-9")} AS digits
  FROM w LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * upper > 6 * (upper + lower) OR 10 * n_symbols > 2 * size OR 10 * digits > 4 * size OR size < 2 * n_words OR size > 20 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM f"""
