"""Connected components of links: in one task up to a number of links, by alternating large-star and small-star rounds beyond."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boursecraft.session import discard, materialise


#: Links that one task joins: 16 bytes each and some arrays of that size. More are rewired in rounds of jobs.
ONCE = 1 << 21


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id reachable) of every id that isn't the smallest itself."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    up, a, b = np.arange(len(ids)), place[: len(u)], place[len(u) :]
    while len(a):
        a, b = up[a], up[b]
        apart = a != b
        a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        np.minimum.at(up, a, b)  # whatever has a smaller neighbour goes under it: half are left, at most
        while True:
            top = up[up]
            if (top == up).all():
                break
            up = top
    moved = np.flatnonzero(up != np.arange(len(ids)))
    return ids[moved], ids[up[moved]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if held:
        u, v = _joined(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        for k in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[k : k + (1 << 16)]), pa.array(v[k : k + (1 << 16)])], ["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that has a link; component is the smallest id reachable.

    Up to ``ONCE`` distinct links are joined by one task. Of more, each round rewires the links towards
    smaller ids and stores them; it ends when every id links to the smallest one of its component only.
    Rows with a null end and loops count for nothing.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(u.alias("u"), v.alias("v")).where("u > v").distinct()
    edges = materialise(edges, "links")
    once = edges.dtypes == [("u", "bigint"), ("v", "bigint")] and edges.count() <= ONCE
    if once:
        before, edges = edges, materialise(edges.coalesce(1).mapInArrow(_stars, "u long, v long"), "links")
        discard(before)
    while not once:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, materialise(small, "links")
        discard(before)  # only the last round's links outlive the call: what it returns is read from them
        # done when no id has two smaller ones and no smaller one has one itself
        loose = edges.groupBy("u").count().where("count > 1").select("u").unionByName(edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi"))
        if loose.isEmpty():
            break
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
