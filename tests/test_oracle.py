"""Every registered query against its DuckDB oracle on the driver tables."""

from __future__ import annotations

import re
from importlib.util import find_spec

import pytest

from casework.plans.registry import load_all
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

REGISTRY = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
              "BOOLEAN": "boolean", "DATE": "date"}


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, con, name):
    fn, sql = REGISTRY[name]
    assert sql is not None, f"{name} has no oracle"
    df = fn(spark, SF_SMALL)
    rel = con.sql(sql)
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    duck_types = {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == duck_types
    got, want = df.toPandas(), rel.df()
    assert compare(got, want) == "OK", compare(got, want)


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and {r.tipo_decisao for r in rows} >= {"Total"}
    assert set(E.oracle_sql()) <= set(E.queries())
    # The training-data subpackage adds its own queries where it is installed.
    added = {name for name in E.queries() if name == "pipeline" or re.match(r"op\d+_", name)}
    assert set(E.queries()) - added == set(REGISTRY)
    assert bool(added) == (find_spec("casework.llm") is not None and find_spec("corpus_pipeline") is not None)
