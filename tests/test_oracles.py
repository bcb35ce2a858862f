"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def rows_of(rows, order):
    return sorted(tuple(repr(r[i] + 0.0) if isinstance(r[i], float) and not math.isnan(r[i]) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n in ORACLES if not n.startswith("op") and n != "pipeline"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    kinds = {c[0]: str(c[1]) for c in want.description}
    assert sorted(names) == sorted(found.columns)
    assert {f.name: f.dataType.simpleString() for f in found.schema.fields} == {n: TYPES.get(k, k) for n, k in kinds.items()}
    assert rows_of(found.collect(), [found.columns.index(c) for c in sorted(names)]) == rows_of(want.fetchall(), [names.index(c) for c in sorted(names)])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_without_sql_is_known():
    assert {n for n in QUERIES if n not in ORACLES and not n.startswith("op") and n != "pipeline"} == set()
