import numpy as np
import xxhash

from casebench.llm import simhash
from tests.llm.fixtures import ROWS, documents, none, rows


def brute(rows_, radius=4):
    """(doc_id, fingerprint, component) by all pairs."""
    prints = []
    for _, text, *_ in rows_:
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows_):
        ids = [rows_[j][0] for j in range(len(prints)) if find(j) == find(i) and rows_[j][0] is not None]
        out.append((r[0], f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


def test_against_all_pairs(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(simhash.op2_simhash(spark, sf)) == brute(docs)


def test_odd_rows(spark):
    assert rows(simhash.simhash_groups(documents(spark))) == brute(ROWS)
    assert simhash.simhash_groups(none(spark)).count() == 0


def test_links_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, d, replace=False))) for b in base for d in (1, 3, 4, 5, 8)]
    prints = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    links = simhash.simhash_links(df, variants_a_slice=20_000)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    want = {}
    signed = prints.view(np.int64)
    for i, x in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(prints ^ x) <= 4):
            want.setdefault(int(signed[i]), set()).add(int(signed[j]))
    for a, others in want.items():
        for b in others:
            assert got.get(a, a) == got.get(b, b)
    for a, r in got.items():
        assert a != r


def test_near_copies(spark):
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words)
    near = " ".join(words[:200] + ["changed"] + words[201:])
    far = " ".join(w if i % 3 else "x" + w for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, base, "s"), (2, near, "s"), (3, far, "s"), (4, base, "s"), (5, None, "s"), (6, "", "s"), (4, base, "s")], "doc_id long, text string, source string")
    assert [r[0] for r in rows(simhash.one_of_each(docs))] == [1, 3, 5]
    assert simhash.one_of_each(documents(spark)).count() == 8
    assert simhash.one_of_each(none(spark)).count() == 0


def test_repeated_row_stays_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "q r s"), (None, "q r s")], "doc_id long, text string")
    assert rows(simhash.one_of_each(docs)) == [(None, "q r s"), (1, "a b c d e f")]


def test_forest_keeps_components():
    a, b = np.array([5, 9, 1, 7]), np.array([9, 2, 3, 7])
    member, root = simhash.forest(a, b)
    assert dict(zip(member.tolist(), root.tolist(), strict=True)) == {5: 2, 9: 2, 3: 1}


def test_a_crowded_slice_is_cut(spark):
    """A family that shares its leading bits, with slices so small that it is cut into many parts: every link is found."""
    rng = np.random.default_rng(8)
    centre = np.uint64(0xDEADBEEF12345678)
    family = np.unique(np.array([centre ^ np.uint64(sum(1 << int(k) for k in rng.choice(48, rng.integers(1, 9), replace=False))) for _ in range(400)], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in family.view(np.int64)], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.simhash_links(df, variants_a_slice=3000)).collect()}
    signed = family.view(np.int64).tolist()
    root = list(range(len(family)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(family):
        for j in np.flatnonzero(np.bitwise_count(family ^ x) <= 4).tolist():
            root[find(i)] = find(j)
    want = {signed[i]: min(signed[j] for j in range(len(family)) if find(j) == find(i)) for i in range(len(family))}
    assert {x: got.get(x, x) for x in signed} == want


def test_parts_make_each_variant_once():
    fp = np.random.default_rng(1).integers(0, 1 << 40, 9, dtype=np.uint64)
    mask = simhash.masks(40, 2)
    whole = sorted(zip(*(x.tolist() for x in simhash.variants_of(fp, mask, 0, 0)), strict=True))
    cut = sorted(pair for part in range(8) for pair in zip(*(x.tolist() for x in simhash.variants_of(fp, mask, part, 3)), strict=True))
    assert whole == cut


def test_a_pair_that_meets_comes_once():
    """Over all slices of all tables, each pair within 2 bits in a table comes once; the closest ones form a forest of roots."""
    rng = np.random.default_rng(3)
    bits, tables, n = 2, 4, 60
    words = np.repeat(rng.integers(0, 1 << 63, (6, tables // 2), dtype=np.uint64), n // 6, axis=0)
    for row in words:
        for k in rng.choice(64 * len(row), 6, replace=False).tolist():
            row[k // 64] ^= np.uint64(1 << (k % 64))
    words[7] = words[6]
    node, root = np.arange(n), np.arange(n) // 2
    keys = words.view(np.uint32)
    got, closest = [], []
    for t in range(tables):
        for lead in range(1 << bits):
            here = np.flatnonzero(np.bitwise_count((keys[:, t] >> np.uint32(32 - bits)) ^ np.uint32(lead)) <= 1)
            given = (t << bits | lead, keys[here, t].copy().view(np.int32), words[here], node[here], root[here], bits, 20)
            for how, out in (("all", got), ("closest", closest)):
                out.extend(p for a, b in simhash.links_of_table_slice(*given, how) for p in zip(a.tolist(), b.tolist(), strict=True))
    away = np.bitwise_count(keys[:, None] ^ keys[None])
    want = [(a, b) for a in range(n) for b in range(a + 1, n) if root[a] != root[b] and (away[a, b] <= 2).any() and away[a, b].sum() <= 20]
    assert sorted(got) == want and len(want) > 50
    assert set(closest) <= set(want)


def test_short_near_copies_are_all_found(spark):
    """Pairs at or above 0.8 of texts of any short length, among others just below and unlike ones; by all pairs."""
    import random

    rng = random.Random(3)
    draw = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(180):
        own = draw([1, 4, 5, 6, 8, 9, 12, 17, 25, 40, 60, 80][k % 12])
        rows.append(" ".join(own))
        rows.append(" ".join([*own, *draw(1)]))  # one word more: at 0.8 from 8 words on
        rows.append(" ".join([*own[:-1], *draw(1)]))
        rows.append(" ".join(own).upper() + "  ")
        rows.append(" ".join([*draw(1), *own, *draw(1)]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    roots = {r.doc_id: r.root for r in simhash.similar_groups(docs).collect()}
    sets = [set(simhash.hashes_of(t.encode(), 5).tolist()) for t in rows]
    want = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = want[i], want[j]
                want = [min(a, b) if x in (a, b) else x for x in want]
    found = {}
    for d, r in roots.items():
        found.setdefault(r, set()).add(d)
    true = {}
    for d, r in enumerate(want):
        true.setdefault(r, set()).add(d)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, true.values()))
