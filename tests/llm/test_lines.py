import collections
import hashlib

from casebench.llm import lines
from tests.llm.fixtures import documents, none

SCHEMA = "doc_id long, text string, key string"
A, B = "the usual footer of every page", "another line that many pages share"


def brute(rows):
    """(doc_id, n_lines, n_dropped, kept) of rows (doc_id, text), sorted."""
    where = collections.defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(lines.SPACE))
    rank = lambda d: lines.NO_ID if d is None else d
    for d, text in rows:
        for x in (text or "").split("\n"):
            where[key(x)].add(rank(d))
    out = []
    for d, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if not (len(key(x)) >= 20 and len(where[key(x)]) >= 3 and rank(d) != max(where[key(x)]))]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda r: (rank(r[0]), r[1:]))


def compare(spark, rows, **more):
    got = lines.without_common_lines(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), **more).collect()
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in got)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got), key=lambda r: (lines.NO_ID if r[0] is None else r[0], r[1:])) == brute(rows)


def test_small_cases(spark):
    rows = [
        (1, f"{A}\nown text here that is long enough\n{A}"),
        (2, f"  {A.upper()}\t\nsomething"),
        (3, f"{A}\n{B}\n"),
        (4, f"{A}\r\n{B}"),
        (5, f"{A}\n{A}\n{B} "),
        (6, f" {A}"),  # not ASCII white space: another key
        (7, "short line\nshort line"), (8, "short line"), (9, "short line"),
        (10, "x" * 19), (11, "x" * 19), (12, "x" * 19), (13, "x" * 20), (14, "x" * 20), (15, "x" * 20),
        (16, "ÀÉ" * 10), (17, "àé" * 10), (18, "ÀÉ" * 10), (19, "ÀÉ" * 10),
        (20, None), (21, ""), (22, "\n\n"),
    ]
    compare(spark, rows)


def test_shared_and_missing_ids(spark):
    rows = [(1, A), (1, A), (1, f"{A}\nx"), (2, A), (None, A), (None, f"{B}\n{A}"), (None, B), (3, B), (4, f"{B}\n{B}\n{B}"), (7, "z" * 30), (7, "z" * 30), (6, "z" * 30)]
    compare(spark, rows, batches=4)
    compare(spark, rows, batches=1)


def test_runs_lose_nothing(spark):
    """After any number of batches the runs say of every key what one aggregation says; levels are compacted."""
    runs, rows = lines.LineRuns(spark, fan=2), []
    for b in range(7):
        batch = [(f"k{i}".encode(), d) for i in range(30) for d in (100 - 10 * b, 100 - 10 * b + 1 + i % 3, b) if (i + d) % 3 or i < 4]
        rows += batch
        runs.add(spark.createDataFrame(batch, "key binary, doc_id long"))
    assert [level for level, _ in runs.runs] == [2, 1, 0]
    said = {bytes(r.key): (r.docs, r.last) for r in runs.known().collect()}
    true = collections.defaultdict(set)
    for k, d in rows:
        true[k].add(d)
    assert set(said) == set(true)
    for k, docs in true.items():
        assert said[k][1] == max(docs) and (said[k][0] >= 3) == (len(docs) >= 3)


def test_settled_keys_are_not_added_again(spark):
    runs = lines.LineRuns(spark)
    frame = lambda *rows: spark.createDataFrame(rows, "key binary, doc_id long")
    runs.add(frame((b"a", 9), (b"a", 8), (b"a", 7), (b"b", 9)))
    runs.add(frame((b"a", 5), (b"b", 5), (b"c", 5)))
    assert {bytes(r.key) for r in runs.runs[1][1].collect()} == {b"b", b"c"}
    runs2 = lines.LineRuns(spark)
    runs2.add(frame((b"a", 1), (b"a", 2), (b"a", 3)))
    runs2.add(frame((b"a", 5)))
    assert runs2.known().first()["last"] == 5


def test_odd_rows(spark):
    got = lines.without_common_lines(documents(spark)).collect()
    assert len(got) == 14 and all(r.n_dropped == 0 for r in got)
    assert lines.without_common_lines(none(spark)).count() == 0


def test_query_by_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in lines.op13_line_dedup(spark, sf).collect()}
    want = brute(rows)
    assert len(got) == len(want) and sum(w[2] for w in want) > 0
    for d, n, dropped, kept in want:
        assert (got[d].n_lines, got[d].n_dropped, got[d].kept_sha256) == (n, dropped, hashlib.sha256(kept.encode()).hexdigest())


def test_query_by_sql(spark, sf, duck):
    got = sorted(tuple(r) for r in lines.op13_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == sorted(duck(sf).execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({lines.ORACLE})").fetchall())
