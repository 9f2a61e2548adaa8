import hashlib
import random

import numpy as np
import pytest

from casebench.llm import substrings
from tests.llm.fixtures import ROWS, documents, none, rows


def brute(rows_, length):
    seen = {}
    texts = [(r[0], (r[1] or "").encode()) for r in rows_]
    for _, b in texts:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(substrings.op4_suffix_dedup(spark, sf), *NAMES) == brute(docs, 200)


def test_odd_rows(spark):
    assert rows(substrings.without_repeats(documents(spark)), *NAMES) == brute([r[:2] for r in ROWS], 200)
    assert substrings.without_repeats(none(spark)).count() == 0


@pytest.mark.parametrize("most_contexts", [substrings.MOST_CONTEXTS, 1, 6])
def test_planted_passages(spark, most_contexts):
    """Passages with varied edges, periodic text and two symbols; also with groups cut, once or down to single strings."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [word(n) for n in (39, 40, 41, 90, 300)]
    docs = [(i, word(rng.randrange(80)) + rng.choice(passages) + word(rng.randrange(80)) + rng.choice(passages)[rng.randrange(30) :] + word(5)) for i in range(60)]
    docs += [(100, "ab" * 100), (101, "a" * 39), (102, "a" * 40), (103, "x" * 41), (104, "abc" * 30 + "Q" + "abc" * 30), (105, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(substrings.without_repeats(df, length=40, gram=16, most_contexts=most_contexts), *NAMES) == brute(docs, 40)


def test_interval_tree_finds_all_maximal_repeats():
    """Against all pairs: for each suffix the longest range shared with any other through the anchor."""
    rng = random.Random(2)
    for _ in range(30):
        left = ["".join(rng.choice("ab") for _ in range(24)).encode() for _ in range(12)]
        right = [("ANCHOR__" + "".join(rng.choice("ab") for _ in range(rng.randrange(3, 24)))).encode() for _ in range(12)]
        want = set()
        share = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        for i in range(12):
            for j in range(12):
                if i != j and share(left[i], left[j]) + share(right[i], right[j]) >= 14:
                    want |= {(i, -share(left[i], left[j])), (i, share(right[i], right[j]))}
        got = {}
        for _, after, members, reach in substrings.repeats(left, right, 14 + 18, 8):
            for m, r in zip(members.tolist(), reach.tolist(), strict=True):
                got.setdefault(m, []).append((r, after))
        for i, pairs in got.items():
            assert all((i, a) in want for _, a in pairs if a >= 14)
    assert substrings.intervals([2, 5, 5, 0, 3]) == [(1, 3, 5), (0, 3, 2), (4, 5, 3), (0, 5, 0)]


@pytest.mark.parametrize("most_contexts", [substrings.MOST_CONTEXTS, 4])
def test_groups_have_every_place(spark, most_contexts):
    """Each repeat's places hold one string, all of them; and the places together cover what is removed."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [word(n) for n in (41, 60, 90)]
    docs = [(i, word(rng.randrange(40)) + rng.choice(passages) + word(rng.randrange(40)) + rng.choice(passages)[rng.randrange(12) :]) for i in range(40)]
    docs += [(50, passages[2]), (51, passages[2])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    text = {i: t.encode() for i, t in docs}
    groups = {}
    for r in substrings.repeat_groups(df, length=40, gram=16, most_contexts=most_contexts).collect():
        groups.setdefault(r.repeat, set()).add((r.key, r.start, r.size))
    covered = {i: set() for i in text}
    for places in groups.values():
        strings = {text[k][s : s + n] for k, s, n in places}
        assert len(strings) == 1 and len(places) > 1 and len(next(iter(strings))) >= 40
        one = next(iter(strings))
        assert {(k, s) for k, s, _ in places} == {(k, s) for k, b in text.items() for s in range(len(b)) if b.startswith(one, s)}
        for k, s, n in places:
            covered[k] |= set(range(s, s + n))
    assert {i: len(c) for i, c in covered.items()} == {r[0]: r[2] for r in brute(docs, 40)}


def test_one_gram_with_very_many_surroundings(spark):
    """A passage whose ends all differ, in more texts than a group of the tree takes at once."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(230))
    docs = [(i, "".join(rng.choice("klmnopqrstuvw ") for _ in range(60)) + passage + "".join(rng.choice("klmnopqrstuvw ") for _ in range(60))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(substrings.without_repeats(df, most_contexts=50), *NAMES) == brute(docs, 200)
