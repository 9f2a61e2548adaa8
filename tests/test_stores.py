import json

import pytest
from pyspark.sql import functions as F

from casebench import models
from casebench.plans import state
from casebench.plans.registry import Tables
from casebench.sources import collections, rest
from casebench.sources.tables import CaseTables

CHUNKS = "chunk_id string, text string, case_id string, url string"


def test_collection_replaces_a_case_alone(spark, tmp_path):
    store = collections.VectorCollection(spark, str(tmp_path / "v"))
    frame = lambda *rows: spark.createDataFrame([(*r, "u") for r in rows], CHUNKS)
    ids = lambda: sorted((r.case_id, r.chunk_id) for r in store.read().collect())
    stub = models.Stub(8)
    store.rebuild(frame(("s1", "law one", None), ("dossier-a-1", "x y", "a"), ("dossier-a-2", "x", "a"), ("dossier-a-b-1", "y", "a-b")), stub)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "v").glob("case_id=a-b/*.parquet")}
    for _ in range(2):
        store.add_cases(frame(("dossier-a-7", "new", "a")), provider=stub)
    assert ids() == [("a", "dossier-a-7"), ("a-b", "dossier-a-b-1"), ("statutes", "s1")]
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "v").glob("case_id=a-b/*.parquet")} == before
    assert len(store.read("a").first().embedding) == 8 and store.read("a").first().url == "u"
    store.add_cases(spark.createDataFrame([], CHUNKS), ["a", "statutes"], stub)
    assert ids() == [("a-b", "dossier-a-b-1"), ("statutes", "s1")]
    for bad in [("dossier-b-1", "t", "a"), ("x", "t", None), (None, "t", "a"), ("s1", "t", "statutes")]:
        with pytest.raises(ValueError):
            store.add_cases(frame(bad), provider=stub)
    with pytest.raises(ValueError):
        store.add_cases(frame(("dossier-a-1", "t", "a"), ("dossier-a-1", "u", "a")), provider=stub)
    assert ids() == [("a-b", "dossier-a-b-1"), ("statutes", "s1")]
    plan = store.read("a-b")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(case_id" in plan


class Fake:
    """A service whose answers come from a list of statuses; 200 once they are used up."""

    def __init__(self, *statuses, holds=3600.0):
        self.statuses, self.holds, self.tokens, self.sent = [*statuses], holds, 0, []

    def token(self):
        self.tokens += 1
        return f"t{self.tokens}", self.holds

    def send(self, path, payload, token):
        self.sent.append(token)
        status = self.statuses.pop(0) if self.statuses else 200
        if status is None:
            raise ConnectionError("gone")
        return status, json.dumps(payload)


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def client(fake, rate=1000.0):
    clock = Clock()
    return rest.Client(fake, rate, clock, clock.sleep), clock


def test_four_failures_then_an_answer():
    c, clock = client(Fake(503, None, 500, 429))
    assert c.post("/a", {"x": 1}) == '{"x": 1}' and c.tries == 5
    assert [s for s in clock.slept if s >= 1] == [2.0, 2.0, 4.0, 8.0]


def test_the_fifth_failure_is_raised():
    c, _ = client(Fake(*[503] * 5))
    with pytest.raises(rest.RequestFailed, match="503"):
        c.post("/a", {})
    assert c.tries == 5


def test_a_refused_token_is_renewed_once_and_an_old_one_before_it_ends():
    fake = Fake(401)
    c, clock = client(fake)
    c.post("/a", {})
    assert fake.sent == ["t1", "t2"] and c.tries == 1
    fake = Fake(holds=100.0)
    c, clock = client(fake)
    c.post("/a", {})
    clock.now = 39.0
    c.post("/a", {})
    clock.now = 41.0  # a minute before its end
    c.post("/a", {})
    assert fake.sent == ["t1", "t1", "t2"]
    c, _ = client(Fake(401, 401, 200))
    assert c.post("/a", {}) == "{}" and c.tries == 2


def test_rate():
    c, clock = client(Fake(), rate=4.0)
    for _ in range(5):
        c.post("/a", {})
    assert clock.now == pytest.approx(1.0)


def local_pages(options):
    """A transport for the data source: seven pages, page 3 fails twice."""
    failed = []

    class Local(Fake):
        def send(self, path, payload, token):
            if payload["page"] == 3 and len(failed) < 2:
                failed.append(1)
                return 500, ""
            return 200, json.dumps({"pages": 7, "items": [{"page": payload["page"], "i": i, "é": path} for i in range(payload["page"])]})

    return Local()


def test_data_source(spark):
    spark.dataSource.register(rest.RestPages)
    read = spark.read.format("rest_pages").option("path", "/list").option("transport", "tests.test_stores:local_pages").option("rate", "100000").option("pause", "0").option("tasks", "3")
    df = read.load()
    assert df.rdd.getNumPartitions() == 3
    got = [(r.page, json.loads(r.item)) for r in df.collect()]
    assert sorted((p, x["i"]) for p, x in got) == [(p, i) for p in range(7) for i in range(p)] and all(x["é"] == "/list" for _, x in got)


def test_requests_without_rows(spark):
    none = spark.createDataFrame([], "path string, payload string, status long")
    assert rest.fetched(none, Fake(), 1e9).count() == 0 and rest.fetched(none, Fake()).columns == ["path", "payload", "status", "attempts", "body"]


def test_case_tables_join_where_they_lie(spark, sf):
    tables = state.state_tables(Tables(spark, sf))
    try:
        plan = tables.graph()._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
        import glob
        files = [f.rsplit("_", 1)[1] for f in glob.glob(f"{tables.root.removeprefix('file:')}/facts/part-*.parquet")]
        assert len(files) == len(set(files)) <= tables.buckets  # a file for each bucket that has rows
        tables.create()  # what is there stays
        assert tables.table("facts").count() == spark.read.parquet(f"{sf}/documents.parquet").count()
        h = tables.health().first()
        labels = spark.read.parquet(f"{sf}/labels.parquet")
        assert h.facts == tables.table("facts").count() and h.edges == labels.count() and h.dangling == 0
        assert h.uncovered == spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 3 <> 0").count()
        assert h.uncatalogued == spark.read.parquet(f"{sf}/documents.parquet").filter("lang IS NOT NULL").select("lang").distinct().count()
        tables.put("edges", spark.createDataFrame([("nowhere", "p")], "fact_id string, person_id string"))
        assert tables.health().first().dangling == 1 and tables.graph().filter(F.col("person_id").isNotNull()).count() == 0
    finally:
        tables.drop()
    CaseTables(spark, tables.database, tables.root).drop()
