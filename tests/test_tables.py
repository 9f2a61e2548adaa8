"""Queries against their SQL on small made-up tables: odd rows, and what only large tables have."""

import pytest

from casebench import plans
from casebench.functions import scalars
from tests.test_queries import plain


@pytest.fixture
def same(spark, duck, tmp_path):
    """same(query, table=DataFrame, ...): the query's rows over these tables, which must be those of its SQL."""

    def check(name, **tables):
        for table, df in tables.items():
            df.coalesce(1).write.parquet(str(tmp_path / table))
            next((tmp_path / table).glob("*.parquet")).rename(tmp_path / f"{table}.parquet")
        df = plans.QUERIES[name](spark, str(tmp_path))
        cursor = duck(str(tmp_path)).execute(plans.ORACLE_SQL[name])
        got = df.select(*[d[0] for d in cursor.description]).collect()
        assert sorted((tuple(map(plain, r)) for r in got), key=str) == sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=str)
        return got

    return check


def test_epoch_dates_of_any_year(spark, same):
    ids = [0, 1636, 1637, 80903, 80904, 500_000, 2_000_000, -18_000, -17_900, -19_000, -19_500, -200_000, None]
    days = {r.doc_id: r.day for r in same("epoch_dates", documents=spark.createDataFrame([(i,) for i in ids], "doc_id long"))}
    assert days[80903] == "9999-11-25" and days[80904] == "10000-01-01" and days[None] is None


def test_html_strip_of_odd_pages(spark, same):
    pages = ["a&amp;&amp</title>b", "&quot &quot; &copy &copy; &middot; &lt;i&gt; &amp;lt; &#233;", "&amp;quot;&quot;amp;", "\u00a0<p>a\u00a0 \u00a0b\x0b\x85</p>\u2003", "a\x85<br>\u2028", "<>x<\n>", " \t", "", None]
    got = same("html_strip", pages=spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))
    assert {r.page_id for r in got if r.digest is None} == {8}


def test_letters_after_three():
    assert [scalars.letters(n) for n in (702, 703, 18_278, 18_279, 475_254, 475_255)] == ["zz", "aaa", "zzz", "aaaa", "zzzz", "aaaaa"]
