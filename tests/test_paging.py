"""Range index and postings against sorting and scanning."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from boursecraft.operators import explore as X
from boursecraft.operators import paging as G
from boursecraft.operators import postings as N
from boursecraft.operators import quality as D


def stocks(spark, n=20000):
    """Names over few syllables, ties and blanks in every sort column, a third of the rows alike."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ri", "ng", "bo", "lt", "É", "a b", "-"]) for _ in range(rng.randrange(0, 5)))
    rows = [(k, f"T{k % 700}" if k % 3 else "SAME", rng.choice([None, "", word(), word().upper()]), rng.choice(["x", "y", None]), rng.choice([None, float(rng.randrange(5))]), rng.choice([None, 40.0, 90.0])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "instrument_id long, ticker string, shortName string, sector string, pe double, data_cov double").repartition(8)


@pytest.mark.parametrize("key,descending", [("pe", True), ("shortName", False)])
def test_any_page_equals_the_sorted_rows_and_reads_two_ranges(spark, key, descending):
    _, frame = stocks(spark)
    index = X.explorer_index(frame, sector="x", key=key, descending=descending, ranges=16)
    want = [r.instrument_id for r in X.sorted_blanks_last(X.explorer_rows(frame, sector="x"), key, descending).collect()]
    assert index.total == len(want) and len(index.starts) > 8
    last = index.total // 10 + 1
    for page in (1, 2, last // 2, last - 1, last, last + 5):
        assert [r.instrument_id for r in index.page(page, 10).collect()] == want[(page - 1) * 10 : page * 10]
        assert len(index.ranges((page - 1) * 10, 10)) <= 2
    plan = index.page(last // 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_range", plan)
    # pages that follow each other by the last place seen
    place, seen = 0, []
    while rows := index.after(place, 2500).collect():
        seen += [r.instrument_id for r in rows]
        place = rows[-1].place
    assert seen == want


def test_pages_of_nothing(spark):
    _, frame = stocks(spark, 10)
    index = X.explorer_index(frame, sector="none", key="pe")
    assert index.total == 0 and index.page(1, 10).count() == 0
    assert X.explorer(frame, sector="none", key="pe").count() == 0


def test_issue_pages_and_their_total(spark):
    issues = "array<struct<code:string,message:string,severity:string,field:string,raw_value:string>>"
    obs = spark.range(500).select("id", F.lit(1).alias("instrument_id"), F.lit("p").alias("provider"), F.when(F.col("id") % 3 == 0, F.array(*[F.struct(F.lit(c).alias("code"), F.lit("m").alias("message"), F.lit("e").alias("severity"), F.lit("f").alias("field"), F.lit("r").alias("raw_value")) for c in ("b", "a")])).otherwise(F.array().cast(issues)).alias("issues"))
    every = [(r.id, r.code) for r in D.flattened_issues(obs).orderBy("id", "code").collect()]
    page = D.issue_page(obs, 40, after=130).collect()
    assert [(r.id, r.code) for r in page] == every[130:170] and {r.total for r in page} == {len(every)}


def test_postings_equal_the_scan_on_random_needles(spark):
    rows, frame = stocks(spark, 3000)
    postings = N.build_postings(frame)
    rng = random.Random(7)
    names = [t for r in rows for t in r[1:3] if t]
    needles = ["", " ", "ri", "zzz", "SAME", "é", "rin g"] + [name[a : a + rng.randrange(1, 7)] for name in rng.sample(names, 25) for a in [rng.randrange(len(name))]]
    for needle in needles:
        want = sorted(r.instrument_id for r in frame.filter(X.matches_text(needle, "ticker", "shortName")).collect())
        assert sorted(r.instrument_id for r in postings.search(frame, needle).collect()) == want
    assert postings.candidates("ri") is None and postings.candidates("qqq").count() == 0
    plan = postings.candidates("same")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "PushedFilters: [" in plan
    assert [r.instrument_id for r in X.search(frame.withColumn("rank", F.col("instrument_id")), "same", "x", 50.0, 5, postings).collect()] == [r.instrument_id for r in X.search(frame.withColumn("rank", F.col("instrument_id")), "same", "x", 50.0, 5).collect()]
