"""Every registered query against its DuckDB oracle on sf0.001 (the driver
runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF0001
from tools.compare import rows_of

ORACLES = E.oracle_sql()
DUCK_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF0001)
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck.sql(ORACLES[name])
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    spark_types = {f.name: DUCK_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in sdf.schema.fields}
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert rows_of(sdf.columns, srows) == rows_of(rel.columns, drows)


def test_every_query_has_an_oracle_or_is_listed():
    from dupstream.plans.queries import REGISTRY
    rows_only = set(REGISTRY) - set(ORACLES)
    assert rows_only == set()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "seen" in df.columns
