import datetime
import random

import pytest

from casebench import models
from casebench.sources.logtable import LogTable
from casebench.streaming import loop

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


@pytest.mark.parametrize("fan", [1, 2, 3, 99])
def test_log_table_keeps_the_latest_row_of_each_key(spark, tmp_path, fan):
    rng, table, want = random.Random(fan), LogTable(spark, str(tmp_path / "t"), "k string, v long, w string", ["k"], ("v",), fan), {}
    assert table.read().count() == 0 and table.last_batch() == -1
    for batch in range(6):
        rows = [(rng.choice(["a", "b", "c", f"k{batch}", None]), rng.randrange(100), rng.choice("xyz")) for _ in range(12)]
        assert table.append(spark.createDataFrame(rows, "k string, v long, w string"))
        for k in {r[0] for r in rows}:
            want[k] = max(r[1:] for r in rows if r[0] == k)
        assert {r.k: (r.v, r.w) for r in table.read().collect()} == want
    again = LogTable(spark, str(tmp_path / "t"), "k string, v long, w string", ["k"], ("v",), fan)
    assert again.last_batch() == 5 and not again.append(spark.createDataFrame([("a", 999, "x")], "k string, v long, w string"), batch=5)
    table.compact()
    assert {r.k: (r.v, r.w) for r in again.read().collect()} == want
    assert len(again.manifest()["segments"]) == 1


def test_a_segment_that_no_list_names_is_not_read(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"), "k string, v long", ["k"])
    table.append(spark.createDataFrame([("a", 1)], "k string, v long"))
    table._write(spark.createDataFrame([("b", 2)], "k string, v long").selectExpr("*", "9L AS __seq"))  # a job killed before its rename
    assert [tuple(r) for r in table.read().collect()] == [("a", 1)]


class Counting:
    name = "counting"

    def __init__(self, ok):
        self.ok = ok

    def complete(self, prompts):
        return [f'{{"p": "{p}"}}' if self.ok else None for p in prompts]


def test_a_failed_call_is_asked_again_and_an_answer_is_not(spark, tmp_path):
    cache = models.StoredCache(spark, str(tmp_path / "c"), fan=2)
    work = spark.createDataFrame([("k1", "p", "s", "one"), ("k1", "p", "s", "one"), ("k2", "p", "s", "two")], "cache_key string, pass_name string, subject string, prompt string")
    assert all(r.result_json is None for r in cache.answered(work, "prompt", Counting(False)).collect())
    assert cache.table.read().count() == 0
    assert sorted(r.result_json for r in cache.answered(work, "prompt", Counting(True)).collect()) == ['{"p": "one"}', '{"p": "one"}', '{"p": "two"}']
    assert sorted(r.result_json for r in models.StoredCache(spark, str(tmp_path / "c")).answered(work, "prompt", Counting(False)).collect()) == ['{"p": "one"}', '{"p": "one"}', '{"p": "two"}']


def observed(spark, rows):
    return spark.createDataFrame([(c, p, START + at, a, h, ok) for c, p, at, a, h, ok in rows], loop.OBSERVED)


def reasons(case_loop):
    return {(r.case_id, r.poll): (r.reason, r.cycle) for r in case_loop.cycles().collect()}


def test_loop_reasons_and_restart(spark, tmp_path):
    root = str(tmp_path / "loop")
    first = [
        ("a", 1, 0 * DAY, "facts", "x", True), ("a", 1, 0 * DAY, "roles", "y", True),  # one poll of two artifacts
        ("a", 2, DAY / 2, "facts", "x", True), ("a", 3, DAY, "facts", "x", True), ("b", 1, 0 * DAY, "facts", "missing", False),
    ]
    loop.CaseLoop(spark, root).step(observed(spark, first), 0)
    assert reasons(loop.CaseLoop(spark, root)) == {("a", 1): ("first_run", 1), ("b", 1): ("first_run", 1)}  # a day exactly is no sweep
    second = [("a", 4, DAY + DAY / 86_400, "roles", "y", True), ("a", 5, DAY * 1.5, "roles", "z", False), ("a", 6, DAY * 1.6, "roles", "z", True), ("a", 7, DAY * 1.7, "roles", "z", True), ("b", 2, DAY / 10, "facts", "missing", True), ("b", 3, DAY / 5, "facts", "here", True)]
    for _ in range(2):  # a batch that comes again changes nothing
        loop.CaseLoop(spark, root).step(observed(spark, second), 1)
    want = {("a", 4): ("full_sweep", 2), ("a", 5): ("changed", 3), ("a", 6): ("backlog", 4), ("b", 2): ("backlog", 2), ("b", 3): ("changed", 3)}
    assert {k: v for k, v in reasons(loop.CaseLoop(spark, root)).items() if k not in (("a", 1), ("b", 1))} == want


def test_loop_by_one_pass_and_by_many_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("abc"), i, DAY * (i / 7), rng.choice(["f", "g"]), rng.choice("xy"), rng.random() < 0.8) for i in range(120)]
    whole, cut = loop.CaseLoop(spark, str(tmp_path / "w")), str(tmp_path / "c")
    whole.step(observed(spark, rows), 0)
    for b in range(4):
        loop.CaseLoop(spark, cut).step(observed(spark, rows[30 * b : 30 * b + 30]), b)
    assert reasons(whole) == reasons(loop.CaseLoop(spark, cut)) and {v[0] for v in reasons(whole).values()} == {"first_run", "changed", "backlog", "full_sweep"}


def test_a_batch_that_failed_before_its_state_is_done_again(spark, tmp_path):
    root, calls = str(tmp_path / "loop"), []

    def failing(df, batch):
        calls.append(df.count())
        if len(calls) == 1:
            raise RuntimeError("killed")

    rows = [("a", 1, 0 * DAY, "f", "x", True), (None, 1, 0 * DAY, "f", "x", True)]
    with pytest.raises(RuntimeError):
        loop.CaseLoop(spark, root).step(observed(spark, rows), 0, failing)
    assert loop.CaseLoop(spark, root).cycles().count() == 0
    loop.CaseLoop(spark, root).step(observed(spark, rows), 0, failing)
    assert reasons(loop.CaseLoop(spark, root)) == {("a", 1): ("first_run", 1)} and calls == [1, 1]
