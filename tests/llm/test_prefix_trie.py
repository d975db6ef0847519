from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from boursecraft.llm import prefix_trie


def brute(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    """Nodes from prefixes written out."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    out = []
    total: dict = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        total[p] = (sum(total[k][0] for k in kids[p]) or 1, own + sum(total[k][1] for k in kids[p]))
    for p, held in members.items():
        text = ",".join(map(str, sorted(ends[p])))
        out.append((min(held), len(p), min(members[p[:-1]]) if p else None, len(held), len(kids[p]), *total[p], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(trie) -> list[tuple]:
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in trie.select(*names).collect()), key=repr)


def table(spark, convs, extra=()):
    rows = [(c, k, role, text, "x") for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    return spark.createDataFrame([*rows, *extra], "conv_id long, turn long, role string, text string, depth string")


def random_convs(seed: int, n: int) -> dict:
    """A hot first turn, a hot conversation, one very long one that two share, and short random ones."""
    rng = random.Random(seed)
    long = [("user", f"t{i}" * 3) for i in range(400)]
    convs = {}
    for c in rng.sample(range(-50, 10 * n), n):
        kind = rng.random()
        if kind < 0.3:
            convs[c] = [("user", "hot é😀"), ("assistant", "same")]
        else:
            convs[c] = [("user", "hot é😀")] * (kind < 0.7) + [("user", rng.choice("abc") * 5) for _ in range(rng.randrange(1, 5))]
    first, second, *_ = convs
    convs[first], convs[second] = long, long[:390] + [("user", "other")]
    return convs


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 300), (3, 1000)])
def test_tries_over_many_shards_equal_brute_force(spark, seed, n):
    convs = random_convs(seed, n)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert found(prefix_trie.build(prefix_trie.sequences(table(spark, convs)))) == brute(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def rebuilt(convs: dict) -> dict:
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c - np.fmod(c, 100))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def test_rebuilt_conversations_equal_brute_force(spark):
    convs = random_convs(5, 250)
    assert any(not t for t in rebuilt(convs).values())  # some have no turns left
    assert found(prefix_trie.build(prefix_trie.rebuild(prefix_trie.sequences(table(spark, convs))))) == brute(rebuilt(convs))


def test_awkward_rows(spark):
    schema = "conv_id long, turn long, role string, text string, sequence string, shard int"
    rows = [(1, None, "user", "first", "x", 1), (1, 0, "user", "second", "x", 1), (1, 7, None, None, None, None), (2, 0, "", "", "x", 1), (None, 0, "user", "nobody", "x", 1), (3, 0, "user", "y" * 100000, "x", 1)]
    convs = {1: [("user", "first"), ("user", "second"), ("", "")], 2: [("", "")], 3: [("user", "y" * 100000)]}
    assert found(prefix_trie.build(prefix_trie.sequences(spark.createDataFrame(rows, schema)))) == brute(convs)
    assert prefix_trie.build(prefix_trie.sequences(spark.createDataFrame([], schema))).count() == 0
    one = spark.createDataFrame([(9, 0, "user", "z", "x", 1)], schema)
    assert found(prefix_trie.build(prefix_trie.sequences(one))) == brute({9: [("user", "z")]})
    # repeated turns: both count, in the order of their digests
    twice = spark.createDataFrame([(9, 0, "user", "z", "x", 1)] * 2, schema)
    assert found(prefix_trie.build(prefix_trie.sequences(twice))) == brute({9: [("user", "z")] * 2})


@pytest.mark.parametrize("seed", range(20))
def test_findclose_and_range_minimum(seed):
    rng = random.Random(seed)
    bits, depth = [], 0
    for _ in range(rng.choice([3, 60, 2000])):
        up = depth == 0 or rng.random() < rng.choice([0.5, 0.9])
        bits.append(up)
        depth += 1 if up else -1
    bits += [False] * depth
    stack, close = [], {}
    for k, up in enumerate(bits):
        if up:
            stack.append(k)
        else:
            close[stack.pop()] = k
    at = np.array(sorted(close))
    assert prefix_trie.Parentheses(np.array(bits)).findclose(at).tolist() == [close[k] for k in at.tolist()]
    values = np.array([rng.randrange(100) for _ in range(50)])
    pairs = [(a, b) for a in range(50) for b in range(a + 1, 51)]
    least = prefix_trie.RangeMinimum(values).least(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert least.tolist() == [values[a:b].min() for a, b in pairs]
