"""Every core query runs on the smallest data and equals its SQL."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from lavra.plans import registry

DATA = os.environ.get("LAVRA_TESTDATA", "/root/testdata/sf0.001")


#: Queries without SQL that the smallest data may leave without rows.
MAY_BE_EMPTY = {"document_glossary", "glossary_variants", "answer_citations", "repair_instructions", "named_documents"}


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    sql = registry.oracle().get(name)
    assert len(set(df.columns)) == len(cols) and (sql or rows or name in MAY_BE_EMPTY)
    if sql:
        want = duck.sql(sql)
        assert sorted(want.columns) == cols
        assert rows == sorted(repr([plain(r[want.columns.index(c)]) for c in cols]) for r in want.fetchall())
