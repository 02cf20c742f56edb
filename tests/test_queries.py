"""Every query with SQL against DuckDB, as sorted rows."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from voxloom import detection_queries, queries, source_queries, spatial_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return out


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.6g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


core, sql = ({**getattr(queries, x), **getattr(source_queries, x), **getattr(spatial_queries, x), **getattr(detection_queries, x)} for x in ("QUERIES", "SQL"))


@pytest.mark.parametrize("name", sorted(sql))
def test_query_equals_sql(spark, sf_dir, db, name):
    own = core[name](spark, sf_dir)
    columns = sorted(own.columns)
    got = sorted(tuple(map(plain, x)) for x in own.select(*columns).collect())
    found = db.execute(f"select * from ({sql[name]})")
    assert sorted(d[0] for d in found.description) == columns
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in at) for row in found.fetchall())
    assert len(got) == len(want)
    own, theirs = set(got), set(want)
    assert [x for x in got if x not in theirs][:3] == [x for x in want if x not in own][:3] == []


def test_queries_without_sql_run(spark, sf_dir):
    for name in set(core) - set(sql):
        assert core[name](spark, sf_dir).count() > 0, name


def test_entry(spark):
    assert entry.entry(spark).count() == 16 and set(entry.oracle_sql()) <= set(entry.queries())
