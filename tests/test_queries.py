import datetime
import decimal

import pytest

from casebench import plans


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return str(v)[:19].removesuffix(" 00:00:00")
    return str(v) if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=str)
    if name not in plans.ORACLE_SQL:
        assert got
        return
    cursor = duck(sf).execute(plans.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
