"""Physical-plan checks: no Python on the hot path, pruning and pushdown,
broadcast only where the size is checked, no single-partition window over
data-sized inputs."""

from __future__ import annotations

import pytest

from casework.plans.registry import load_all
from tests.conftest import SF_SMALL

REGISTRY = load_all()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Elements, rows and nested tables of saved pages need an HTML parser; records that
# cross byte ranges need a scanner that keeps its state from line to line.
PARSED = {"csv_roundtrip", "case_table_csv", "json_pretty_hits", "gzip_csv_dictionary", "case_numbers_csv", "edge_csv", "edge_dictionary",
          "page_status", "page_field_primary", "page_labelled_cell", "page_decision_text", "page_extract", "page_edge_cases", "incremental_rerun"}


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - PARSED))
def test_no_python_udf(spark, name):
    plan = _plan(REGISTRY[name][0](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas"):
        assert node not in plan, f"{name}: {node}"


def test_scan_prunes_columns_and_pushes_filters(spark):
    from pyspark.sql import functions as F

    from casework.plans import datasets as DS

    ev = DS.tables(spark, SF_SMALL).events.filter(F.col("event_type") == "click").select("ts")
    plan = _plan(ev)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "ts:timestamp_ntz" in read and "event_type:string" in read
    # Unused columns never reach the scan.
    for unused in ("event_id", "user_id", "value", "props"):
        assert unused not in read


def test_small_dictionary_is_broadcast_by_its_bytes(spark):
    df = REGISTRY["name_lookup"][0](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_first_decision_is_partial_aggregate(spark):
    df = REGISTRY["first_decision"][0](spark, SF_SMALL)
    plan = _plan(df)
    assert "partial_min_by" in plan
    assert "Window" not in plan
