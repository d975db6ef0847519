"""Merkle manifest of a dataset, with a proof for every row, by an exchange of subtrees.

A row's leaf is a digest of its fields. Leaves of one tree are ordered by key and numbered; eight
consecutive nodes make the node above them, until one is left: the subroot. Subroots, ordered by
tree, make the root the same way.

Trees are worked on in superblocks of 4,096 consecutive nodes. Going up, a superblock is reduced to
its top node; the tops are the nodes of the next round, so every round has 4,096 times fewer.
Coming down, a round's nodes and the one outer path that their superblock needs are cogrouped: the
local reduction is finished again, local siblings and outer path are joined to a proof for each
node, and a claimed digest is folded along it. No task holds more than a superblock and one path.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boursecraft.session import materialise

FANOUT = 8
#: Levels that a superblock is reduced by in one round.
DEEP = 4
SUPERBLOCK = FANOUT**DEEP

_PATH = "tree string, block long, places array<int>, others array<string>, subroot string, root string"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A field so that no two lists of fields have one encoding: ``-`` for null, else bytes:value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Lowercase hex digest of a row's fields."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def tree_name(value: Column) -> Column:
    """A tree's name that is never null and sorts as the value does: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def number(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``position`` (from 0, by ``order``, nulls first) and ``total`` of their group.

    Rows are range-sorted and counted in their partition; a partition's count per group is the only
    thing that is accumulated. Ties are parted by the place of a row, so no key fills one task.
    """
    keys = [F.col(group).asc(), *[F.col(c).asc_nulls_first() for c in order], F.col("_salt").asc()]
    ranged = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()  # the partition in the upper 31 bits, the row in the lower 33
    stored = materialise(ranged.withColumn("_place", place).drop("_salt"), "numbered").withColumns(
        {"_part": F.shiftright("_place", 33), "_row": F.col("_place").bitwiseAND((1 << 33) - 1)}
    )
    counts = stored.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    over = Window.partitionBy(group)
    before = counts.select("_part", group, (F.sum("_n").over(over.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_before"), F.sum("_n").over(over).alias("total"))
    return stored.join(before, ["_part", group]).withColumn("position", F.col("_before") + F.col("_row")).drop("_part", "_row", "_place", "_before")


def height(total: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while total > 1:
        total = -(-total // FANOUT)
        levels += 1
    return levels


def _reduce(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of a superblock, level by level, from its own up to its top."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([_hash("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return out


def _siblings(level: list[str]) -> list[str]:
    """For each node of a level the others of its run, joined."""
    out = []
    for i in range(0, len(level), FANOUT):
        run = level[i : i + FANOUT]
        out += ["".join(run[:k] + run[k + 1 :]) for k in range(len(run))]
    return out


def fold(digest: str, places: list[int], others: list[str]) -> str:
    """The root that follows from a node's digest and the siblings on its way up."""
    for place, beside in zip(places, others):
        digest = _hash(f"{beside[: 64 * place]}{digest}{beside[64 * place :]}")
    return digest


def _tops(nodes: DataFrame) -> DataFrame:
    """One row per superblock, numbered as the nodes of the next round."""

    def top(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        total = int(group["total"].iloc[0])
        levels = _reduce(group["digest"].tolist(), min(DEEP, height(total)))
        return pd.DataFrame({"tree": [group["tree"].iloc[0]], "position": [group["block"].iloc[0]], "total": [-(-total // SUPERBLOCK)], "digest": [levels[-1][0]]})

    narrow = nodes.select("tree", "block", "position", "total", "digest")
    return narrow.groupBy("tree", "block").applyInPandas(top, "tree string, position long, total long, digest string")


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("position") / SUPERBLOCK))


def _local(nodes: pd.DataFrame) -> list[list[str]]:
    """Sorted nodes of a superblock: per level, the siblings of each node."""
    levels = _reduce(nodes["digest"].tolist(), min(DEEP, height(int(nodes["total"].iloc[0]))))
    return [_siblings(level) for level in levels[:-1]]


def _path_of(beside: list[list[str]], k: int, outer) -> tuple[list[int], list[str]]:
    places = [(k // FANOUT**n) % FANOUT for n in range(len(beside))]
    others = [level[k // FANOUT**n] for n, level in enumerate(beside)]
    return [*places, *map(int, outer["places"])], [*others, *outer["others"]]


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(nodes of each round by superblock, the single node that each tree ends in)."""
    rounds, above = [], _blocked(nodes)
    while (above.agg(F.max("total")).first()[0] or 1) > 1:
        rounds.append(above)
        above = _blocked(materialise(_tops(above), "tops"))
    return rounds, above


def _descend(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of the nodes of the lowest round, from those of the nodes that the trees end in."""

    def join(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("position")
        beside, top = _local(nodes), outer.iloc[0]
        found = [_path_of(beside, k, top) for k in range(len(nodes))]
        return pd.DataFrame({"tree": nodes["tree"], "block": nodes["position"], "places": [p for p, _ in found], "others": [o for _, o in found], "subroot": top["subroot"], "root": top["root"]})

    for nodes in reversed(rounds):
        narrow = nodes.select("tree", "block", "position", "total", "digest")
        paths = narrow.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInPandas(join, _PATH)
    return paths


def manifest(docs: DataFrame, fields: list[str], tree_col: str, key_col: str, claimed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, tree, leaf, claimed, position and total.

    Leaves of a tree ascend by key, null first; rows that share a key follow their digests.
    ``claimed`` replaces fields by what somebody else says they are; without it the claim is the
    leaf. Other columns are ignored, whatever their names.
    """
    own = [F.col(c) for c in fields]
    said = [(claimed or {}).get(c, F.col(c)) for c in fields]
    rows = docs.select(F.col(key_col).cast("long").alias("id"), tree_name(F.col(tree_col)).alias("tree"), leaf(*own).alias("leaf"), (leaf(*said) if claimed else leaf(*own)).alias("claimed"))
    return number(materialise(rows, "leaves"), "tree", ["id", "leaf"])


def prove(leaves: DataFrame, key_col: str = "id", with_proof: bool = False) -> DataFrame:
    """``leaves`` of ``manifest`` with subroot, root, proof_sha256, folded_root and verified.

    A proof is the siblings of a leaf and of all nodes above it, level by level and left to right;
    folded_root follows from the claimed digest and the proof, verified tells whether that is the
    root. ``with_proof`` adds the proof itself: ``places`` (how many siblings stand to the left) and
    ``others`` (their digests, joined) by level. A lone leaf is its tree's subroot and a lone subroot
    the root; empty input gives no rows.
    """
    leaves = _blocked(leaves)
    nodes = leaves.withColumn("digest", F.col("leaf"))
    rounds, subroots = _rounds(nodes)
    subroots = materialise(subroots.select("tree", "digest"), "subroots")
    outer_rounds, roots = _rounds(number(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"]))
    top = roots.select("tree", F.col("position").alias("block"), F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("others"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    if outer_rounds:
        named = outer_rounds[0].select("tree", F.col("position").alias("block"), "name", "digest")
        top = _descend(outer_rounds, top).drop("subroot").join(named, ["tree", "block"])
    else:
        top = top.drop("subroot").join(roots.select("tree", F.col("position").alias("block"), "name", "digest"), ["tree", "block"])
    paths = top.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "places", "others", F.col("digest").alias("subroot"), "root")
    # the lowest round's superblocks; a table of lone leaves has no rounds, each leaf then being a superblock
    paths = _descend(rounds[1:], paths)
    names = ["id", "tree", "position", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "places", "others"]

    def finish(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("position")
        beside, above = _local(nodes), outer.iloc[0]
        proofs, folded, paths = [], [], []
        for k, claim in enumerate(nodes["claimed"]):
            places, others = _path_of(beside, k, above)
            proofs.append(_hash("".join(others)))
            folded.append(fold(claim, places, others))
            if with_proof:
                paths.append((places, others))
        out = nodes[["id", "tree", "position", "leaf"]].assign(subroot=above["subroot"], root=above["root"], proof_sha256=proofs, folded_root=folded)
        out["verified"] = out["folded_root"] == out["root"]
        if with_proof:
            out["places"], out["others"] = [p for p, _ in paths], [o for _, o in paths]
        return out

    schema = "id string, tree string, position long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    # keys pass pandas as text: a column of longs with a null would come as doubles
    narrow = leaves.select("tree", "block", "position", "total", F.col("leaf").alias("digest"), F.col("id").cast("string").alias("id"), "leaf", "claimed")
    found = narrow.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInPandas(finish, schema + (", places array<int>, others array<string>" if with_proof else ""))
    return found.select(F.col("id").cast("long").alias(key_col), *names[1 : len(names) if with_proof else -2])
