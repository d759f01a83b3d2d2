"""Incremental collection: batch rerun and the Structured Streaming face."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from casework.operators import pages as PG
from casework.plans import datasets as DS
from casework.sources.fixtures import case_pages
from casework.streaming.incremental import read_progress, run_counts, run_incremental, start_page_stream, store_batch
from tests.conftest import SF_SMALL


def _extract(df):
    return PG.extract(df)


def test_incremental_rerun_only_processes_pending(spark):
    base = tempfile.mkdtemp(prefix="cw-inc-")
    progress = os.path.join(base, "progress")
    listed = DS.union(spark, SF_SMALL).select("numero_processo")
    pages = case_pages(DS.collected(spark, SF_SMALL))
    half = listed.filter(F.substring("numero_processo", 20, 1).isin("0", "2", "4", "6", "8"))
    first = run_incremental(half, pages, progress, _extract)
    assert first.count() == half.count()
    second = run_incremental(listed, pages, progress, _extract)
    assert second.count() == listed.count()
    # nothing was processed twice
    done = read_progress(spark, progress)
    assert done.count() == done.select("numero_processo").distinct().count()


def test_page_stream_appends_each_new_file_once(spark):
    base = tempfile.mkdtemp(prefix="cw-stream-")
    inbox, progress, ckpt = (os.path.join(base, d) for d in ("inbox", "progress", "ckpt"))
    pages = case_pages(DS.collected(spark, SF_SMALL)).select("numero_processo", "html")
    parts = pages.randomSplit([0.5, 0.5], seed=7)
    parts[0].write.parquet(os.path.join(inbox, "batch0"))
    schema = pages.schema
    q = start_page_stream(spark, os.path.join(inbox, "*"), schema, progress, ckpt, _extract)
    q.awaitTermination()
    n0 = read_progress(spark, progress).count()
    assert n0 == parts[0].count()
    parts[1].write.parquet(os.path.join(inbox, "batch1"))
    q = start_page_stream(spark, os.path.join(inbox, "*"), schema, progress, ckpt, _extract)
    q.awaitTermination()
    done = read_progress(spark, progress)
    assert done.count() == pages.count()
    assert done.select("numero_processo").distinct().count() == pages.count()


def _records(spark, rows):
    return spark.createDataFrame([(k, None, None, s, None) for k, s in rows],
                                 "numero_processo string, juiz string, requerente string, status string, texto_decisao string")


def test_only_a_missing_path_is_empty(spark):
    base = tempfile.mkdtemp(prefix="cw-prog-")
    assert read_progress(spark, os.path.join(base, "absent")).count() == 0
    path = os.path.join(base, "prog")
    store_batch(_records(spark, [("1", "sucesso")]), path, "a")
    with open(os.path.join(path, "lote=a", "part-99999-broken.parquet"), "wb") as f:
        f.write(b"not a parquet file")
    with pytest.raises(Exception):
        read_progress(spark, path).collect()


def test_a_batch_done_again_changes_nothing(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="cw-prog-"), "prog")
    store_batch(_records(spark, [("1", "erro"), ("2", "sucesso")]), path, "a")
    store_batch(_records(spark, [("1", "sucesso")]), path, "b")
    store_batch(_records(spark, [("1", "sucesso")]), path, "b")
    progress = read_progress(spark, path)
    assert sorted((r.numero_processo, r.status) for r in progress.collect()) == [("1", "sucesso"), ("2", "sucesso")]
    counts = run_counts(_records(spark, [("1", ""), ("1", ""), ("3", "")]), progress).first()
    assert tuple(counts) == (2, 2, 1, 1, 1)


def test_a_failed_batch_keeps_the_earlier_ones(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="cw-prog-"), "prog")
    pages = spark.createDataFrame([(str(i), "<p>x</p>") for i in range(40)], "numero_processo string, html string")
    calls = []

    def failing(df):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return PG.extract(df)

    with pytest.raises(RuntimeError, match="stopped"):
        run_incremental(pages, pages, path, failing, batches=4)
    stored = read_progress(spark, path).count()
    assert 0 < stored < 40
    assert run_incremental(pages, pages, path, PG.extract).count() == 40
