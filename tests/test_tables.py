"""Writes, streams, files: everything that touches storage."""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from boursecraft.sinks import tables as B
from boursecraft.sources import csv_archive as Z
from boursecraft.sources import files as E
from boursecraft.sources import payloads as P
from boursecraft.streaming import ingest

OBS = "id long, instrument_id long, field string, provider string, observed_at timestamp, numeric_value double"


def instruments(spark):
    return spark.createDataFrame([(1, "EQUITY", True), (2, "EQUITY", True), (3, "EQUITY", False)], "instrument_id long, kind string, active boolean")


def obs(spark, rows):
    return spark.createDataFrame([(i, k, "f", "p", dt.datetime(2024, 1, day), v) for i, k, day, v in rows], OBS)


def test_observation_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "obs")
    first = obs(spark, [(1, 1, 1, 1.0), (2, 1, 1, 2.0), (3, 3, 1, 3.0), (4, 2, 2, 4.0)])
    B.append_observations(first, path, instruments(spark))
    B.append_observations(first, path, instruments(spark))
    B.append_observations(obs(spark, [(9, 2, 2, 9.0), (10, 2, 3, 5.0)]), path, instruments(spark))
    got = {(r["instrument_id"], r["numeric_value"]) for r in spark.read.parquet(path).collect()}
    assert got == {(1, 1.0), (2, 4.0), (2, 5.0)}


BAR = "ticker string, ts timestamp, interval string, provider string, close double, ingested_at timestamp"


def bar(month, day, close, version, ticker="a"):
    return (ticker, month and dt.datetime(2024, month, day), "1d", "y", close, dt.datetime(2024, 6, version))


def test_bar_upsert_rewrites_only_touched_months(spark, tmp_path):
    path = str(tmp_path / "bars")
    B.upsert_bars(spark.createDataFrame([bar(1, 1, 1.0, 1), bar(2, 1, 2.0, 1)], BAR), path, buckets=4)
    january = {f.name for f in (tmp_path / "bars" / "month=2024-01").iterdir()}
    B.upsert_bars(spark.createDataFrame([bar(2, 1, 9.0, 2), bar(2, 2, 3.0, 2)], BAR), path, buckets=4)
    got = {(r["ts"].month, r["ts"].day): r["close"] for r in spark.read.parquet(path).collect()}
    assert got == {(1, 1): 1.0, (2, 1): 9.0, (2, 2): 3.0}
    assert {f.name for f in (tmp_path / "bars" / "month=2024-01").iterdir()} == january
    # an older version changes nothing, a repeated batch neither
    for _ in range(2):
        B.upsert_bars(spark.createDataFrame([bar(2, 1, 7.0, 1), bar(3, 1, 4.0, 1)], BAR), path, buckets=4)
    assert {(r["ts"].month, r["ts"].day): r["close"] for r in spark.read.parquet(path).collect()} == got | {(3, 1): 4.0}
    spark.sql(f"DROP TABLE {B.bars_table(spark, path, spark.read.parquet(path), B.BAR_KEY, 4)}")  # as a new session: months are found again
    B.upsert_bars(spark.createDataFrame([bar(1, 1, 5.0, 3)], BAR), path, buckets=4)
    assert {(r["ts"].month, r["ts"].day): r["close"] for r in spark.read.parquet(path).collect()} == got | {(3, 1): 4.0, (1, 1): 5.0}


def test_a_bar_without_its_key_is_refused_and_nothing_is_lost(spark, tmp_path):
    path = str(tmp_path / "bars")
    B.upsert_bars(spark.createDataFrame([bar(1, 1, 1.0, 1)], BAR), path, buckets=2)
    for row in (bar(None, 1, 2.0, 2), bar(1, 1, 2.0, 2, ticker=None)):
        with pytest.raises(Exception, match="a bar needs"):
            B.upsert_bars(spark.createDataFrame([row], BAR), path, buckets=2)
    assert [r["close"] for r in spark.read.parquet(path).collect()] == [1.0]


def test_a_merge_shuffles_the_incoming_side_only(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = spark.createDataFrame([bar(m, d, 1.0, 1, f"t{d}") for m in (1, 2) for d in range(1, 20)], BAR)
    B.upsert_bars(rows, path, buckets=8)
    _, merged = B.merged_bars(rows, path, buckets=8)
    lines = merged._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(k for k, line in enumerate(lines) if "FileScan parquet" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, at = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < at:
            above.append(line)
            at = depth(line)
    assert any("SortMergeJoin" in line for line in above) and not any("Exchange" in line for line in above)
    assert "SelectedBucketsCount: 8 out of 8" in lines[scan] and "dynamicpruning" in lines[scan]


def test_a_merge_writes_one_file_for_a_bucket_and_month(spark, tmp_path):
    path, wanted = str(tmp_path / "bars"), {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "5"}
    kept = {name: spark.conf.get(name) for name in wanted}
    rows = [bar(m, d, 1.0, 1, f"t{d}") for m in (1, 2) for d in range(1, 29)]
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        for version in (1, 2):
            B.upsert_bars(spark.createDataFrame([(*r[:4], float(version), dt.datetime(2024, 6, version)) for r in rows], BAR), path, buckets=3)
            for month in ("2024-01", "2024-02"):
                assert len(list((tmp_path / "bars" / f"month={month}").glob("*.parquet"))) == 3  # it was one for each of five tasks and bucket
        assert {name: spark.conf.get(name) for name in wanted} == wanted
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert sorted((r["ticker"], r["ts"], r["close"]) for r in spark.read.parquet(path).collect()) == sorted((r[0], r[1], 2.0) for r in rows)


def test_an_archive_import_computes_its_rows_once(spark, tmp_path):
    made, path = spark.sparkContext.accumulator(0), str(tmp_path / "archive")

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    schema = "source_path string, content_sha256 string, row_number long, version string"
    rows = lambda version, files: spark.createDataFrame([(f"{f}.csv", "h", n, version) for f in files for n in (1, 2)], schema).mapInArrow(counted, schema)
    B.upsert_archive(rows("old", "abc"), path, buckets=2)
    B.upsert_archive(rows("new", "bcd"), path, buckets=2)
    assert made.value == 12
    got = sorted((r.source_path, r.row_number, r.version) for r in spark.read.parquet(path).collect())
    assert got == [(f"{f}.csv", n, "old" if f == "a" else "new") for f in "abcd" for n in (1, 2)]


def test_buckets_of_a_bar_table_grow_with_its_rows():
    assert B.bar_buckets(0) == B.bar_buckets(600_000) == 2
    assert B.bar_buckets(216_000_000) == 6 * B.bar_buckets(36_000_000) == 108


def test_streams_have_batch_semantics(spark, tmp_path):
    source, table, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    rows = obs(spark, [(1, 1, 1, 1.0), (2, 2, 2, 2.0)])
    rows.write.mode("append").parquet(source)
    rows.write.mode("append").parquet(source)
    for _ in range(2):
        query = ingest.stream_observations(spark, source, rows.schema, table, check, instruments(spark), per_batch=1)
        query.awaitTermination(120)
        rows.write.mode("append").parquet(source)
    assert spark.read.parquet(table).count() == 2


def test_keyed_state_drops_repeats_and_late_rows(spark, tmp_path):
    source, table, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")

    def drain():
        query = ingest.stream_observations(spark, source, obs(spark, []).schema, table, check, instruments(spark), per_batch=1, delay="3 days")
        query.awaitTermination(120)
        return query

    first = obs(spark, [(1, 1, 10, 1.0), (2, 2, 11, 2.0), (3, 3, 11, 9.0)])
    for _ in range(3):  # replays of one file: the second and third are found in the state, nothing stored is read
        first.coalesce(1).write.mode("append").parquet(source)
    drain()
    obs(spark, [(4, 1, 20, 3.0)]).coalesce(1).write.mode("append").parquet(source)
    drain()  # a restart goes on with its state and watermark
    obs(spark, [(5, 1, 20, 7.0), (6, 2, 19, 4.0)]).coalesce(1).write.mode("append").parquet(source)
    drain()
    obs(spark, [(7, 2, 2, 5.0)]).coalesce(1).write.mode("append").parquet(source)
    late = drain()
    got = sorted((r["instrument_id"], r["observed_at"].day, r["numeric_value"]) for r in spark.read.parquet(table).collect())
    assert got == [(1, 10, 1.0), (1, 20, 3.0), (2, 11, 2.0), (2, 19, 4.0)]
    assert sum(o["numRowsDroppedByWatermark"] for p in late.recentProgress for o in p["stateOperators"]) == 1
    B.append_observations(obs(spark, [(7, 2, 2, 5.0)]), table, instruments(spark))  # the way for late rows
    assert spark.read.parquet(table).count() == 5


def test_a_replayed_batch_leaves_the_same_table(spark, tmp_path):
    source, table, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    rows = obs(spark, [(1, 1, 10, 1.0), (2, 2, 11, 2.0)])
    rows.write.parquet(source)
    run = lambda: ingest.stream_observations(spark, source, rows.schema, table, check, instruments(spark), delay="3 days").awaitTermination(120)
    run()
    # as if the driver had died between the write and its commit record
    for name in ("0", ".0.crc"):
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    run()
    assert spark.read.parquet(table).count() == 2


def test_bar_stream_keeps_the_last_write(spark, tmp_path):
    source, table, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [[bar(1, 1, 1.0, 1), bar(2, 1, 2.0, 1)], [bar(2, 1, 9.0, 2)], [bar(1, 1, 5.0, 1), bar(3, 1, 3.0, 1)]]
    schema = spark.createDataFrame([], BAR).schema
    for rows in batches:
        spark.createDataFrame(rows, BAR).coalesce(1).write.mode("append").parquet(source)
        ingest.stream_bars(spark, source, schema, table, check, per_batch=1, buckets=2).awaitTermination(120)
    got = {r["ts"].month: r["close"] for r in spark.read.parquet(table).collect()}
    assert got == {1: 5.0, 2: 9.0, 3: 3.0}


def test_runs_replace_their_own_partition(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = lambda run, n: spark.range(n).select(F.lit(run).alias("run_id"), "id")
    B.publish_run(rows("r1", 3), path)
    B.publish_run(rows("r2", 2), path)
    B.publish_run(rows("r1", 3), path)
    assert spark.read.parquet(path).groupBy("run_id").count().count() == 2
    assert spark.read.parquet(path).count() == 5


def test_baseline_is_the_previous_run_date(spark, tmp_path):
    root = str(tmp_path / "hist")
    for day, n in (("2024-01-01", 1), ("2024-01-08", 2), ("2024-01-15", 3)):
        B.promote_baseline(spark.range(n), root, day)
    history = spark.read.option("basePath", root).parquet(root).withColumn("run_date", F.col("run_date").cast("string"))
    assert B.baseline(history, "2024-01-15").count() == 2


def test_poor_fundamentals_coverage_is_refused(spark):
    cached = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "ticker string, beta double")
    with pytest.raises(RuntimeError, match="cached ones stay"):
        B.merge_fundamentals(cached, cached.filter("ticker = 'a'"), cached.select("ticker"), ["beta"])


def test_envelopes_round_trip(spark, tmp_path):
    folder = tmp_path / "raw" / "bse" / "2024-01-01"
    folder.mkdir(parents=True)
    body = '{"a": 1}'
    payloads = {
        "plain": {"text": body}, "b64": {"body_base64": base64.b64encode(body.encode()).decode()},
        "gz": {"body_base64": base64.b64encode(gzip.compress(body.encode())).decode()},
    }
    for name, payload in payloads.items():
        (folder / f"{name}.json").write_text(json.dumps({"request_id": name, "provider": "bse", "payload": payload}, indent=2))
    got = {r["request_id"]: r["body"] for r in E.read_envelopes(spark, str(tmp_path / "raw")).collect()}
    assert got == {"plain": body, "b64": body, "gz": body}


def test_envelope_hash_ignores_key_order_and_hides_secrets(spark):
    rows = [('{"b":1,"a":{"y":2,"x":3}}',), ('{ "a": {"x":3, "y":2}, "b": 1 }',)]
    df = spark.createDataFrame(rows, "payload string").withColumns({"request_params": F.create_map(F.lit("token"), F.lit("t")), "received_at": F.lit(dt.datetime(2024, 1, 1))})
    out = B.envelopes(df).collect()
    assert out[0]["content_sha256"] == out[1]["content_sha256"]
    assert out[0]["request_params"] == {"token": "[redacted]"}


def test_csv_archive_is_lossless(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.csv").write_text("a\n1\n")
    (tmp_path / "q.csv").write_bytes(b'\xef\xbb\xbfa,b,a\r\n"x\ny",2,3\r\n')
    (tmp_path / "ragged.csv").write_text("a,b\n1\n2,3,4\n")
    files = Z.read_csv_files(spark, str(tmp_path))
    rows = {(r["source_path"].rsplit("/", 1)[-1], r["row_number"]): r for r in Z.archive_rows(files).collect()}
    assert len(rows) == 3
    assert rows["q.csv", 1]["record"] == {"a": "x\ny", "b": "2", "a__duplicate_2": "3"}
    assert rows["ragged.csv", 1]["record"] == {"a": "1", "b": None}
    assert rows["ragged.csv", 2]["record"] == {"a": "2", "b": "3", "extra_column_1": "4"}
    stored = Z.archive_files(files, Z.archive_rows(files))
    assert all(r["verified"] for r in Z.import_audit(stored, Z.archive_rows(files)).collect())


def test_exchange_csv_headers_and_missing_columns(spark, tmp_path):
    path = tmp_path / "delivery.csv"
    path.write_text("SYMBOL, SERIES, TTL_TRD_QNTY, DELIV_PER\nA, EQ,\"1,000\", 45.5\nA, N1,5, 10\nB, BE,x, -\nC, BE,x, 20\n")
    got = {r["symbol"]: (r["delivery_pct"], r["volume"]) for r in E.delivery(E.read_exchange_csv(spark, str(path))).collect()}
    assert got == {"A": (45.5, 1000.0), "C": (20.0, 0.0)}
    with pytest.raises(ValueError, match="missing SYMBOL"):
        E.listing(spark.createDataFrame([("x",)], "html string"))


def test_headline_ratios_only_named_ones(spark):
    html = '<span class="name">ROE</span><b><span class="number">1,012.5</span></b><span class="name">P/E</span><span class="number">7</span>'
    pages = spark.createDataFrame([(1, html), (2, "<p>blocked</p>")], "page_id long, html string")
    assert [(r["page_id"], r["field"], r["numeric_value"]) for r in P.headline_ratios(pages).collect()] == [(1, "roe_pct", 1012.5)]
    assert [r["page_id"] for r in P.headline_issues(pages).collect()] == [2]


def test_an_observation_without_a_time_is_refused(spark, tmp_path):
    rows = obs(spark, [(1, 1, 1, 1.0)]).withColumn("observed_at", F.lit(None).cast("timestamp"))
    with pytest.raises(Exception, match="observed_at"):
        B.append_observations(rows, str(tmp_path / "o"), instruments(spark))


def test_archive_names_records_and_hashes(spark):
    import hashlib
    import json

    text = 'a,,a,a\r\n1,2,3,4,"five\x0b\t""q\\"\r\n\r\n' + "a\r\n"
    files = spark.createDataFrame([("f.csv", text.encode()), ("empty.csv", b""), ("two.csv", "﻿x,x,x__duplicate_2\nä,2,3\n".encode())], "source_path string, content binary")
    rows = {(r.source_path, r.row_number): r for r in Z.archive_rows(files).collect()}
    assert sorted(rows) == [("f.csv", 1), ("f.csv", 2), ("f.csv", 3), ("two.csv", 1)]
    one = rows["f.csv", 1]
    assert one.record == {"a": "1", "column_2": "2", "a__duplicate_2": "3", "a__duplicate_3": "4", "extra_column_1": 'five\x0b\t"q\\'}
    assert rows["f.csv", 2].values_array == [] and rows["f.csv", 2].record["a"] is None
    assert rows["two.csv", 1].record == {"x": "ä", "x__duplicate_2": "3"}
    for r in rows.values():
        assert r.row_sha256 == hashlib.sha256(json.dumps(r.values_array, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    declared = Z.manifest(Z.archive_files(files, Z.archive_rows(files))).collect()
    assert {(r.source_path, r.total_rows) for r in declared} == {("f.csv", 3), ("empty.csv", 0), ("two.csv", 1), (None, 4)}
