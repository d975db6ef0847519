from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from boursecraft.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(row, text) -> str:
    values = [*(row[c] for c in FIELDS[:-1]), text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def walk(level: list[str], place: int) -> tuple[str, list[tuple[str, str]]]:
    """(top, (left, right) siblings upwards) of one node, the plain way."""
    path = []
    while len(level) > 1:
        run = level[place // 8 * 8 : place // 8 * 8 + 8]
        path.append(("".join(run[: place % 8]), "".join(run[place % 8 + 1 :])))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        place //= 8
    return level[0], path


def brute(rows) -> list[tuple]:
    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, encoded(r, r["text"]), r))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    tops = {}
    for t in order:
        trees[t].sort(key=lambda x: x[:3])
        tops[t] = walk([x[2] for x in trees[t]], 0)[0]
    out = []
    for at, t in enumerate(order):
        root, above = walk([tops[u] for u in order], at)
        for k, (_, _, leaf, r) in enumerate(trees[t]):
            path = walk([x[2] for x in trees[t]], k)[1] + above
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
            folded = encoded(r, r["text"].translate(LOWER)) if bad else leaf
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((r["doc_id"], leaf, tops[t], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


def spark_rows(docs):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    leaves = merkle.manifest(docs, FIELDS, "lang", "doc_id", {"text": tampered})
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.prove(leaves, "doc_id").select(*columns).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, position int")


def test_awkward_trees_equal_brute_force(spark):
    big = 1 << 60
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(70)]
    rows += [(5, "s", "en", 5, "Text 5")] * 30 + [(5, None, "en", 5, "other")] * 2  # repeated keys, alike and not
    rows += [(big + i, None, "de", None, None) for i in range(9)] + [(None, "s", "de", 1, "Ünï 😀")] * 2  # exact beyond 2^53 beside null keys
    rows += [(1, "s", "fr", 0, "")] + [(2, "s", None, 0, "A" * 100000)] + [(k, "s", f"l{k}", 1, "One") for k in range(20)]
    docs = table(spark, rows)
    assert spark_rows(docs) == brute([dict(zip(FIELDS, r)) for r in rows])


@pytest.mark.parametrize("deep", [1, 2])
def test_many_rounds_equal_brute_force(spark, monkeypatch, deep):
    monkeypatch.setattr(merkle, "DEEP", deep)
    monkeypatch.setattr(merkle, "SUPERBLOCK", 8**deep)
    rows = [(i, "s", f"l{i % 17 * (i % 3 == 0)}", i, f"Text {i}") for i in range(700)]
    assert spark_rows(table(spark, rows)) == brute([dict(zip(FIELDS, r)) for r in rows])


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "Only")], [(2, "s", "en", 1, "A"), (2, "s", None, 1, "A")]])
def test_none_one_and_two_lone_leaves(spark, rows):
    assert spark_rows(table(spark, rows)) == brute([dict(zip(FIELDS, r)) for r in rows])


def test_proofs_lead_to_the_root_and_only_the_right_leaf_does(spark):
    docs = table(spark, [(i, "s", "en", i, f"Text {i}") for i in range(100)])
    for r in merkle.prove(merkle.manifest(docs, FIELDS, "lang", "doc_id"), with_proof=True).collect():
        assert r.verified and merkle.fold(r.leaf, r.places, r.others) == r.root
        assert merkle.fold(sha(r.leaf), r.places, r.others) != r.root and sha("".join(r.others)) == r.proof_sha256


def test_no_task_gets_a_tree(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "id AS n_chars", "'t' AS text")
    leaves = merkle.manifest(docs, FIELDS, "lang", "doc_id")
    sizes = [r["count"] for r in merkle._blocked(leaves).groupBy("tree", "block").count().collect()]
    assert len(sizes) == 5 and max(sizes) == merkle.SUPERBLOCK
    assert {r.n for r in leaves.groupBy("position").agg(F.count("*").alias("n")).collect()} == {1}
