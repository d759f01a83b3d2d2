"""The progress as a log of batches with a summary: merging, failures, pruning."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from casework.streaming import incremental as I


def _records(spark, rows):
    return spark.createDataFrame([(k, None, None, s, None) for k, s in rows],
                                 "numero_processo string, juiz string, requerente string, status string, texto_decisao string")


def _read(spark, path):
    return sorted(((r.numero_processo, r.status) for r in I.read_progress(spark, path).collect()), key=str)


def _files(path):
    return sum(f.endswith(".parquet") for _, _, files in os.walk(path) for f in files)


def _filled(spark, path, batches=6):
    want = {}
    for b in range(batches):
        rows = [(str(k), f"s{b}") for k in range(b * 10, b * 10 + 25)] + [(None, f"s{b}")]
        I.store_batch(_records(spark, rows).repartition(5), path, f"{b:03d}")
        want |= dict(rows)
    return sorted(want.items(), key=str)


def test_files_are_bounded_by_shares_and_the_newest_record_wins(spark, tmp_path):
    path = str(tmp_path / "progress")
    want = _filled(spark, path)
    assert _read(spark, path) == want
    # A batch makes one file for each share it has keys in.
    assert max(_files(f"{path}/lote={b:03d}") for b in range(6)) <= 26
    assert not I.compact(spark, path, after=6) and I.compact(spark, path, after=5)
    assert _read(spark, path) == want and _files(path) <= I.SHARES
    assert I.progress_state(spark, path).batches == () and not any(n.startswith("lote=") for n in os.listdir(path))
    # Batches after the summary, one of them under a merged batch's name.
    I.store_batch(_records(spark, [("3", "new"), ("999", "new"), (None, "new")]), path, "000")
    again = dict(want) | {"3": "new", "999": "new", None: "new"}
    assert _read(spark, path) == sorted(again.items(), key=str)
    assert I.compact(spark, path) and _read(spark, path) == sorted(again.items(), key=str)
    assert len(os.listdir(f"{path}/resumo")) == 1 and _files(path) <= I.SHARES


@pytest.mark.parametrize("step", ["_publish", "_remove"])
def test_a_failure_inside_a_compaction_loses_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "progress")
    want = _filled(spark, path, batches=3)

    def failing(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(I, step, failing)
        with pytest.raises(RuntimeError, match="stopped"):
            I.compact(spark, path)
    assert _read(spark, path) == want
    # A merged batch done again counts, also where its folder was still there.
    I.store_batch(_records(spark, [("1", "again")]), path, "002")
    state = I.progress_state(spark, path)
    assert "002" in state.batches
    if step == "_remove":  # the summary holds what batch 002 had; its new record comes after
        assert dict(_read(spark, path)) == dict(want) | {"1": "again"}
    before = _read(spark, path)
    assert I.compact(spark, path) and _read(spark, path) == before
    assert len(os.listdir(f"{path}/resumo")) == 1 and not any(n.startswith("lote=") for n in os.listdir(path))


def test_few_keys_read_few_shares_and_the_summary_is_not_aggregated(spark, tmp_path):
    path = str(tmp_path / "progress")
    _filled(spark, path)
    I.compact(spark, path)
    keys = spark.createDataFrame([("3",), ("4",)], "numero_processo string")
    shares = I.shares_of(keys)
    part = I.read_progress(spark, path, keys)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "parte" in plan and "Exchange" not in plan and "Aggregate" not in plan
    got = {r.numero_processo for r in part.collect()}
    everyone = I._stored(spark, path)
    assert {"3", "4"} <= got == {r.numero_processo for r in everyone.where(F.col("parte").isin(shares)).collect()}
    assert len(got) < everyone.count()


def test_empty_batches_and_absent_paths(spark, tmp_path):
    path = str(tmp_path / "progress")
    assert not I.compact(spark, path) and _read(spark, path) == []
    I.store_batch(_records(spark, []), path, "a")
    assert _read(spark, path) == []
    assert I.compact(spark, path) and _read(spark, path) == []
    I.store_batch(_records(spark, [("1", "x")]), path, "b")
    assert _read(spark, path) == [("1", "x")]
