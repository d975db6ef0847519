"""Incremental current values against the full computation."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from boursecraft.operators import maintain as T
from boursecraft.operators import reconcile as R
from boursecraft.plans import adapters as A
from boursecraft.plans import q_reconcile as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def others(spark):
    runs, ranked = Q.run_tables(spark, SF)
    files, rows = A.archive_tables(spark, SF)
    return {"runs": runs, "ranked": ranked, "files": files, "rows": rows, "aliases": A.ticker_aliases(spark, SF)}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_random_batches_equal_the_full_result(spark, others, tmp_path):
    obs, instruments = A.observations(spark, SF), A.instruments(spark, SF)
    dealt = obs.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(4)))
    part = lambda *k: dealt.filter(F.col("batch").isin(*k)).drop("batch")
    root = str(tmp_path / "store")
    T.build(root, part(0), instruments, A.AS_OF, **others, buckets=8)
    for k in (1, 2, 3, 3):  # the last one twice: nothing changes
        T.apply(root, part(k), instruments, A.AS_OF, **others, buckets=8)
    full = R.current_metrics(obs, instruments, A.AS_OF, **others)
    assert rows_of(T.read_current(spark, root).select(*full.columns)) == rows_of(full)
    # a later day alone: filings age out
    later = "2025-02-15"
    T.apply(root, part(9), instruments, later, **others, was=A.AS_OF, buckets=8)
    aged = R.current_metrics(obs, instruments, later, **others)
    assert rows_of(T.read_current(spark, root).select(*full.columns)) == rows_of(aged) != rows_of(full)
    # an instrument that is no longer active leaves
    gone = instruments.filter("active AND kind = 'EQUITY'").agg(F.min("instrument_id")).first()[0]
    fewer = instruments.withColumn("active", F.col("active") & (F.col("instrument_id") != gone))
    T.apply(root, part(9), fewer, later, **others, also=fewer.filter(F.col("instrument_id") == gone), buckets=8)
    left = T.read_current(spark, root)
    assert left.filter(F.col("instrument_id") == gone).count() == 0
    assert rows_of(left.select(*full.columns)) == [r for r in rows_of(aged) if r[0] != gone]


def test_a_small_batch_reads_its_part_of_the_state(spark, tmp_path):
    obs = spark.range(4000).selectExpr(
        "id", "id % 400 AS instrument_id", "'current_price' AS field", "CAST(id AS DOUBLE) AS numeric_value", "CAST(NULL AS STRING) AS text_value", "'inr' AS unit",
        "'nse' AS provider", "timestamp'2024-01-01' AS observed_at", "true AS is_valid", "CAST(NULL AS DATE) AS period_end",
    )
    instruments = spark.range(400).selectExpr("id AS instrument_id", "concat('T', id) AS ticker", "'NSE' AS exchange", "'EQUITY' AS kind", "true AS active", "concat('N', id) AS company_name", "timestamp'2024-01-01' AS updated_at")
    none = {
        "runs": spark.createDataFrame([], "run_id string, created_at timestamp"),
        "ranked": spark.createDataFrame([], "run_id string, instrument_id long, rank long, score double, data_coverage double, score_status string, movement string, factors map<string,double>"),
        "files": spark.createDataFrame([], "source_path string, content_sha256 string, source_modified_at timestamp, imported_at timestamp"),
        "rows": spark.createDataFrame([], "source_path string, content_sha256 string, row_number int, record map<string,string>"),
    }
    root = str(tmp_path / "store")
    T.build(root, obs, instruments, A.AS_OF, **none, buckets=400)
    buckets = [r[0] for r in spark.createDataFrame([(5,), (77,), (200,), (399,)], "instrument_id long").select(T._bucket(400)).distinct().collect()]
    read = T.read_state(spark, root, buckets)
    assert read.count() <= 0.03 * T.read_state(spark, root).count()  # 1 % of the instruments and what shares their buckets
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", read._jdf.queryExecution().executedPlan().toString())
    before = {f.name for b in (tmp_path / "store" / "state").glob("bucket=*") for f in b.iterdir()}
    new = obs.filter("id IN (5, 77, 200, 399)").withColumns({"id": F.col("id") + 10000, "numeric_value": F.lit(-1.0)})
    T.apply(root, new, instruments, A.AS_OF, **none, buckets=400)
    after = {f.name for b in (tmp_path / "store" / "state").glob("bucket=*") for f in b.iterdir()}
    assert len([n for n in before - after if n.endswith(".parquet")]) <= len(buckets)  # the other buckets are as they were
    full = R.current_metrics(obs.unionByName(new.select(*obs.columns)), instruments, A.AS_OF, **none)
    assert rows_of(T.read_current(spark, root).select(*full.columns)) == rows_of(full)


def test_evidence_from_the_state_equals_evidence_from_observations(spark):
    obs = A.observations(spark, SF)
    found, want = R.evidence_of(R.newest_state(obs)), R.evidence(obs)
    assert rows_of(found.select(*want.columns)) == rows_of(want)


def test_current_values_scan_their_inputs_once(spark, monkeypatch):
    plans = []
    real = R.materialise
    monkeypatch.setattr(R, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    Q.stored(spark, SF)  # publishes what the runs need
    plans.clear()
    final = Q.current(spark, SF)
    plans.append(final._jdf.queryExecution().executedPlan().toString())
    scans = [line for plan in plans for line in plan.splitlines() if "FileScan parquet" in line]
    assert sum("events.parquet" in line for line in scans) == 1
    assert sum("customer.parquet" in line for line in scans) <= 4
