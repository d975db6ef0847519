"""Embedding near duplicates by cover trees and dual traversal.

Vectors are scaled to length one, where a cosine of c is a chord of sqrt(2 - 2c). Within a label the
space is divided into cells around pivots; a vector lives in the cell of its nearest pivot and
visits every other cell that it can have a partner in: by the covering radius of the cell, and
because a partner within reach can't lie deeper in the other cell than twice that reach. Cells are
split into blocks, so no task holds more than two blocks. For a pair of blocks both cover trees
(nested levels, radii halving) are walked together; a pair of nodes whose distance exceeds the
reach by more than their covering radii is pruned with everything below it. Pairs of vectors that
remain are decided by the cosine in double precision.

A task returns for each vector the number of its links and the smallest vector it is joined to
within the task; pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boursecraft.llm.components import components
from boursecraft.session import materialise

#: Vectors of one block; vectors for each pivot aimed at, until a label has so many pivots, from where on
#: they grow with the square root of its size; vectors that look for their pivot in one task.
BLOCK = 2048
CELL = 8192
PIVOTS = 256
SLICE = 8192
#: Below this many vectors a node of the tree is not divided any more.
LEAF = 32
_SLACK = 1e-9


class CoverTree:
    """Points of a block in nested nodes. A node has a centre, the radius that covers all its
    points, and children whose centres lie more than half of the level's radius apart."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if len(points):
            self._node(np.arange(len(points)), 0, 2.0)

    def _node(self, rows: np.ndarray, centre: int, level: float) -> int:
        """``level`` is the radius of this node's level; the children's is a half of it."""
        here = len(self.centre)
        away = np.sqrt(np.maximum(((self.points[rows] - self.points[centre]) ** 2).sum(1), 0))
        self.centre.append(centre)
        self.radius.append(float(away.max(initial=0.0)))
        self.children.append([])
        self.members.append(rows)
        if len(rows) <= LEAF or self.radius[here] < 1e-7:
            return here
        while level >= self.radius[here]:  # levels that would have one child are passed over
            level /= 2
        left, net, owner = rows, centre, []
        while len(left):
            gap = np.sqrt(np.maximum(((self.points[left] - self.points[net]) ** 2).sum(1), 0))
            near = gap <= level
            owner.append((net, left[near]))
            left, gap = left[~near], gap[~near]
            if len(left):
                net = int(left[gap.argmin()])
        if len(owner) > len(rows) // 2:  # no structure at this level: leave the points to the leaf
            return here
        self.children[here] = [self._node(some, net, level) for net, some in owner]
        return here


def dual_pairs(a: CoverTree, b: CoverTree, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of rows (of a, of b) that hold every pair within ``reach``; for a tree with itself
    either order of a pair of nodes comes once."""
    if not a.centre or not b.centre:
        return
    same = a is b
    stack = [(0, 0)]
    while stack:
        x, y = stack.pop()
        gap = float(np.sqrt(((a.points[a.centre[x]] - b.points[b.centre[y]]) ** 2).sum()))
        if gap > reach + a.radius[x] + b.radius[y] + _SLACK:
            continue
        below_x, below_y = a.children[x], b.children[y]
        if not below_x and not below_y:
            yield a.members[x], b.members[y]
        elif same and x == y:
            stack.extend((below_x[i], below_x[j]) for i in range(len(below_x)) for j in range(i, len(below_x)))
        elif below_x and (not below_y or a.radius[x] >= b.radius[y]):
            stack.extend((c, y) for c in below_x)
        else:
            stack.extend((x, c) for c in below_y)


def _linked(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Link counts of the points of a and of b, and the linked rows, for pairs of different points."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    count_a, count_b, found = np.zeros(len(a.points), np.int64), np.zeros(len(b.points), np.int64), []
    for rows, columns in dual_pairs(a, b, reach):
        for start in range(0, len(rows), 1024):
            some = rows[start : start + 1024]
            hit = a.points[some] @ b.points[columns].T >= cosine
            i, j = np.nonzero(hit)
            i, j = some[i], columns[j]
            if a is b:
                once = i < j if rows is columns or np.array_equal(rows, columns) else i != j
                i, j = i[once], j[once]
            if len(i):
                np.add.at(count_a, i, 1)
                np.add.at(count_a if a is b else count_b, j, 1)
                found.append((i, j))
    return count_a, count_b, found


def _roots(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest row that each row is joined to: labels sink along links until nothing moves."""
    root = np.arange(n)
    if not links:
        return root
    i, j = np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links])
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before, root.copy())
        root = root[root]
        if np.array_equal(root, before):
            return root


def _rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """A number, id, label and vector of every row; the vector is null where it can't link."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    usable = F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))
    # -0.0 and 0.0 are the same
    return rows.select("id", "label", F.when(usable, F.transform("v", lambda x: x + 0.0)).alias("v"), F.monotonically_increasing_id().alias("row"))


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def links(vectors: DataFrame, cosine: float, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id, kept.

    Linked are different rows of equal, non-null label and equal length whose cosine is at least
    ``cosine``. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without an identifier, link with nothing. Equal vectors of a label count as one point with
    copies: they link with one another, and n_links counts every copy. An identifier on several rows
    is one identifier: each row has its own n_links, all have the component that any of them reaches.
    Other columns are ignored.
    """
    every = materialise(_rows(vectors, id_col, vector_col, label_col).withColumn("size", F.size("v")), "vectors")
    stored = every.where("v IS NOT NULL")
    grouped = stored.groupBy("label", "size", "v").agg(F.count("*").alias("copies"))
    points = materialise(grouped.withColumn("point", F.monotonically_increasing_id()), "points")  # points have numbers of their own

    # pivots: of each label as many as its size asks for, by hash, and one at least
    counts = points.groupBy("label", "size").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("point").alias("h"), "point")).alias("one"))
    most = F.greatest(F.lit(PIVOTS), F.ceil(F.sqrt("n") * 0.18))
    counts = materialise(counts.select("label", "size", "n", F.col("one.point").alias("one"), (F.least(most, F.ceil(F.col("n") / CELL)) / F.col("n")).alias("share")), "label-sizes")
    drawn = (F.xxhash64("point").bitwiseAND((1 << 53) - 1) / float(1 << 53)) < F.col("share")
    pivots = points.join(counts, ["label", "size"]).where((F.col("point") == F.col("one")) | ((F.col("n") > CELL) & drawn)).select("label", "size", "point", "v", "n")
    pivots = materialise(pivots, "pivots")
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + _SLACK
    label_type = points.schema["label"].dataType

    def assign(rows: pa.Table, around: pa.Table) -> pa.Table:
        """Home cell of every vector of a slice, and the cells that it may have a partner in."""
        centres = _unit(_matrix(around.column("v"))[np.argsort(around.column("point").to_numpy())])
        unit = _unit(_matrix(rows.column("v")))
        cells, depth = [], []
        for start in range(0, len(unit), 256):
            some = unit[start : start + 256]
            for gap in np.sqrt(np.maximum(((some[:, None, :] - centres[None, :, :]) ** 2).sum(2), 0)) if some.size * len(centres) < 1 << 24 else (np.sqrt(((u - centres) ** 2).sum(1)) for u in some):
                home = int(gap.argmin())
                # itself in ``home``; each pair of cells once
                far = [home, *(home + 1 + np.flatnonzero(gap[home + 1 :] - gap[home] <= 2 * reach)).tolist()]
                cells.append(far)
                depth.append(gap[far])
        return pa.Table.from_arrays(
            [rows.column("label"), rows.column("size"), pa.array(list(unit), pa.list_(pa.float64())), rows.column("point"), rows.column("copies"), pa.array(cells, pa.list_(pa.int32())), pa.array(depth, pa.list_(pa.float64()))],
            ["label", "size", "u", "point", "copies", "cells", "depth"],
        )

    # vectors meet their label's pivots once for every slice of some thousand vectors
    slices = F.ceil(F.col("n") / SLICE)
    sliced = points.join(counts.select("label", "size", "n"), ["label", "size"]).withColumn("slice", F.pmod(F.xxhash64("point"), slices)).drop("n")
    spread = pivots.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).select("label", "size", "slice", "point", "v")
    keys = ["label", "size", "slice"]
    met = sliced.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(assign, f"label {label_type.simpleString()}, size int, u array<double>, point long, copies long, cells array<int>, depth array<double>")
    placed = materialise(met, "placed")
    home = placed.select("label", "size", "u", "point", "copies", F.col("cells")[0].alias("cell"), F.col("depth")[0].alias("depth"))
    cells = home.groupBy("label", "size", "cell").agg(F.count("*").alias("n"), F.max("depth").alias("radius")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    cells = materialise(cells, "cells")

    # every point goes to its block paired with each block that may hold partners of it
    keyed = home.join(cells.drop("n", "radius"), ["label", "size", "cell"]).withColumn("part", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    own = keyed.select("label", "size", "u", "point", "copies", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    own = own.select("label", "size", "u", "point", "copies", F.col("cell").alias("cell_a"), F.least("part", "other").alias("part_a"), F.col("cell").alias("cell_b"), F.greatest("part", "other").alias("part_b"), F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"))
    # visitors go to every block of the other cell, in blocks of their own cell's
    guests = placed.select("label", "size", "u", "point", "copies", F.col("cells")[0].alias("cell_a"), F.explode(F.expr("slice(arrays_zip(cells, depth), 2, size(cells))")).alias("to"))
    guests = guests.select("label", "size", "u", "point", "copies", "cell_a", F.col("to.cells").alias("cell"), F.col("to.depth").alias("depth"))
    guests = guests.join(cells.drop("n"), ["label", "size", "cell"]).where(F.col("depth") <= F.col("radius") + reach)
    home_blocks = cells.select("label", "size", F.col("cell").alias("cell_a"), F.col("blocks").alias("blocks_a"))
    guests = guests.join(home_blocks, ["label", "size", "cell_a"]).withColumn("part_a", F.pmod(F.xxhash64("point"), F.col("blocks_a")).cast("int"))
    visits = guests.select("label", "size", "cell_a", "part_a", F.col("cell").alias("cell_b"), "blocks").distinct().withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    sent = guests.withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("label", "size", "u", "point", "copies", "cell_a", "part_a", F.col("cell").alias("cell_b"), "part_b", F.lit(0).alias("side"))
    hosts = keyed.select("label", "size", "u", "point", "copies", F.col("cell").alias("cell_b"), F.col("part").alias("part_b")).join(visits, ["label", "size", "cell_b", "part_b"])
    hosts = hosts.select("label", "size", "u", "point", "copies", "cell_a", "part_a", "cell_b", "part_b", F.lit(1).alias("side"))
    work = own.unionByName(sent).unionByName(hosts)

    def compare(group: pa.Table) -> pa.Table:
        u, ids, copies = _matrix(group.column("u")), group.column("point").to_numpy(), group.column("copies").to_numpy()
        side = group.column("side").to_numpy()
        order = np.lexsort((ids, side))
        u, ids, copies, side = u[order], ids[order], copies[order], side[order]
        n = int((side == 0).sum())
        a = CoverTree(u[:n])
        inside = group.column("cell_a")[0] == group.column("cell_b")[0] and group.column("part_a")[0] == group.column("part_b")[0]
        b = a if inside else CoverTree(u[n:])
        _, _, found = _linked(a, b, cosine)
        shift = 0 if inside else n
        pairs = [(i, j + shift) for i, j in found]
        total = np.zeros(len(ids), np.int64)
        for i, j in pairs:
            np.add.at(total, i, copies[j])
            np.add.at(total, j, copies[i])
        rank = np.argsort(ids, kind="stable")  # roots are smallest identifiers, not smallest rows
        at = np.empty_like(rank)
        at[rank] = np.arange(len(ids))
        root = ids[rank[_roots(len(ids), [(at[i], at[j]) for i, j in pairs])]][at]
        some = total > 0
        return pa.table({"point": ids[some], "links": total[some], "root": root[some]})

    keys = ["label", "size", "cell_a", "part_a", "cell_b", "part_b"]
    found = materialise(work.groupBy(*keys).applyInArrow(compare, "point long, links long, root long"), "found")
    linked = found.groupBy("point").agg(F.sum("links").alias("links"))

    # back to rows: copies link with one another as well, and the points of one identifier are joined
    members = materialise(stored.join(points, ["label", "size", "v"]).select("row", "id", "point", "copies"), "members")
    several = members.groupBy("id").agg(F.min("point").alias("a"), F.max("point").alias("z")).where("a < z")
    same = members.join(several, "id").where("point <> a").select("a", F.col("point").alias("b"))
    joined = components(found.select(F.col("point").alias("a"), F.col("root").alias("b")).unionByName(same))
    owned = members.join(joined.select(F.col("id").alias("point"), "component"), "point", "left").withColumn("component", F.coalesce("component", "point"))
    least = owned.groupBy("component").agg(F.min("id").alias("component_id"))
    of_point = materialise(owned.select("point", "component").distinct().join(least, "component").join(linked, "point", "left").select("point", "component_id", "links"), "point-components")
    linking = members.join(of_point, "point").select("row", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # rows that can't link take the component of their identifier's other rows, where there are any
    of_id = members.join(of_point, "point").groupBy("id").agg(F.min("component_id").alias("component_id"))
    rest = every.where("v IS NULL").select("row", "id").join(of_id, "id", "left").select("id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = every.where("v IS NOT NULL").select("row", "id").join(linking, "row").select("id", "n_links", "component_id").unionByName(rest)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
