"""Quoted CSV cut into records range by range, against the reader of the standard library."""

from __future__ import annotations

import csv
import hashlib
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boursecraft.sources import csv_archive as Z
from boursecraft.sources import csv_ranges as R

PARTS = st.lists(st.sampled_from(["a", ",", '"', "\r", "\n", "\r\n", "é", '""', '"x\ny",']), max_size=60).map("".join)


def whole(data: bytes) -> list[list[str]]:
    csv.field_size_limit(1 << 30)
    return list(csv.reader(io.TextIOWrapper(io.BytesIO(data), "utf-8-sig", newline="")))


@settings(max_examples=500, deadline=None)
@given(PARTS, st.integers(1, 700), st.lists(st.integers(0, 2000), max_size=6))
def test_any_cut_gives_the_records_of_the_whole(text, repeat, places):
    data = (text * repeat)[:3000].encode()
    edges = sorted({0, len(data), *(p for p in places if p < len(data))})
    state, bodies = R.RECORD, []
    for a, b in zip(edges, edges[1:]):
        part = data[a:b]
        first, starts = R.cut(part, state)
        if first and bodies:
            bodies[-1][0] += part[:first]
        if starts:
            bodies.append([part[first:], starts])
        state = R.state_map(part)[state]
    found = [R.records(body) for body, _ in bodies]
    assert [r for rows in found for r in rows] == whole(data)
    assert [len(rows) for rows in found] == [n for _, n in bodies]


def odd_files(spark):
    rng = random.Random(4)
    texts = ["", "a", "a,b\n", '"a', "\n\n", "a\r", 'x,y\r\n1,"two\r\nlines"\r\n3', "﻿\"h,1\",b\n1,2", "é" * 50 + ",b\n" + '"' + "z" * 300 + '"']
    texts += ["".join(rng.choice(["a", ",", '"', "\n", "\r\n", "é"]) for _ in range(rng.randrange(200))) for _ in range(30)]
    return spark.createDataFrame([(f"{k}.csv", t.encode()) for k, t in enumerate(texts)], "source_path string, content binary")


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_records_of_many_files_in_ranges_of_any_size(spark, size):
    files = odd_files(spark)
    found: dict = {}
    for r in R.record_rows(R.content_ranges(files, size)).collect():
        found.setdefault(r.source_path, {})[r.row_number] = r.cells
    for path, content in [tuple(r) for r in files.collect()]:
        try:
            want = whole(bytes(content))
        except UnicodeDecodeError:
            continue
        assert [found.get(path, {}).get(k) for k in range(len(want))] == want and len(found.get(path, {})) == len(want)


def test_a_file_that_holds_most_rows_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(9)
    cell = lambda: rng.choice(["plain", 'quo"ted', "two\nlines", "a,b", "\n\n\n", "x" * 300, ""])
    big = io.StringIO(newline="")
    writer = csv.writer(big)
    writer.writerow(["id", "text", "text"])
    for k in range(6000):
        writer.writerow([k, cell(), cell()])
    contents = {"big.csv": b"\xef\xbb\xbf" + big.getvalue().encode(), "no_end.csv": b'a,b\n1,"2\n', "end.csv": b"a,b\n1,2\n", "empty.csv": b"", "marked.csv": b"\xef\xbb\xbfa,b\n1,2"}
    (tmp_path / ".venv").mkdir()
    (tmp_path / ".venv" / "x.csv").write_text("a\n1\n")
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        tasks = R.read_ranges(spark, str(tmp_path), 5000).withColumn("task", F.spark_partition_id()).where("source_path LIKE '%big.csv'")
        assert tasks.select("task").distinct().count() >= 8
        ranges = Z.read_csv_ranges(spark, str(tmp_path), 5000)
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    sums = {r.source_path.rsplit("/", 1)[-1]: (r.content_sha256, r.size_bytes) for r in R.digests(ranges).collect()}
    assert sums == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in contents.items() if d}
    fields = ["row_number", "row_sha256", "values_array", "record", "content_sha256"]
    by_range = sorted((r.source_path.rsplit("/", 1)[-1], *(r[f] for f in fields)) for r in Z.archive_range_rows(ranges).collect())
    files = spark.createDataFrame(list(contents.items()), "source_path string, content binary")
    assert by_range == sorted((r.source_path, *(r[f] for f in fields)) for r in Z.archive_rows(files).collect())
    rows = whole(contents["big.csv"])
    assert [r[3] for r in by_range if r[0] == "big.csv"] == rows[1:] and [r[1] for r in by_range if r[0] == "big.csv"] == list(range(1, len(rows)))


def test_files_of_one_range_are_neither_stored_nor_joined(spark, monkeypatch):
    files = odd_files(spark).filter("source_path <> '8.csv'")
    stored: list[tuple[str, int]] = []

    def noting(df, name, real=Z.materialise):
        kept = real(df, name)
        stored.append((name, kept.count()))
        return kept

    for module in (Z, R):
        monkeypatch.setattr(module, "materialise", noting)
    contents = {p: bytes(c) for p, c in files.collect()}
    whole_files = {p: whole(data) for p, data in contents.items()}
    found = {(r.source_path, r.row_number): r for r in Z.archive_rows(files).collect()}
    assert sum(n for _, n in stored) == 0
    assert {k: r.values_array for k, r in found.items()} == {(p, k): line for p, lines in whole_files.items() for k, line in enumerate(lines) if k}
    assert all(r.content_sha256 == hashlib.sha256(contents[p]).hexdigest() for (p, _), r in found.items())
    # the same rows where every file has many ranges, and none of a path that names two files
    in_ranges = {(r.source_path, r.row_number): r for r in Z.archive_rows(files, 7).collect()}
    assert in_ranges == found and sum(n for _, n in stored) > 0
    twice = files.unionByName(files.filter("source_path = '7.csv'"))
    assert {(r.source_path, r.row_number) for r in Z.archive_rows(twice).collect()} == {k for k in found if k[0] != "7.csv"}


def test_a_batch_of_ranges_is_not_copied_whole():
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(64)]), pa.array([bytes(1 << 20)] * 64)], ["source_path", "bytes"])
    tracemalloc.start()
    try:
        assert sum(len(data) for _, data in R._rows(batch)) == 64 << 20
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()
