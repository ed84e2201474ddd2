"""Every registered query against its DuckDB oracle on the smallest tables, and the
driver's entry point."""

import pytest

from oracle_check import digest, duck

SF = "/root/testdata/sf0.001"
_SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                  "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 16 and df.columns == ["var_x", "var_y", "pearson_r"]


def _names():
    import __spark_entry__ as E
    return list(E.queries())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert df.columns  # rows-only query: it runs and has a schema
        return
    rel = con.sql(sql)
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert {f.name: _SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in df.schema.fields} == types
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(cols) == sorted(df.columns)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows) == digest(cols, drows)
