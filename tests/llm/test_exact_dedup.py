from __future__ import annotations

import hashlib
import random

from boursecraft.llm import exact_dedup
from boursecraft.llm.exact_dedup import PatriciaTrie


def brute(rows, pick):
    fold = lambda t: (t or "").encode().lower()
    ids, n = {}, {}
    for i, t in rows:
        ids.setdefault(fold(t), []).extend([i] if i is not None else [])
        n[fold(t)] = n.get(fold(t), 0) + 1
    owner = {k: pick(v) if v else None for k, v in ids.items()}
    return sorted(((i, owner[fold(t)], n[fold(t)], i == owner[fold(t)], hashlib.sha256(fold(t)).hexdigest()) for i, t in rows), key=repr)


def test_assignment_equals_brute_force(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for keep, pick in (("smallest", min), ("largest", max)):
        got = sorted((tuple(r) for r in exact_dedup.assign(awkward, keep=keep).collect()), key=repr)
        assert got == brute(rows, pick)


def test_spilled_subtrees_give_the_same_owners(awkward):
    whole = sorted(tuple(r) for r in exact_dedup.owners(awkward.where("doc_id is not null")).collect())
    tiny = sorted(tuple(r) for r in exact_dedup.owners(awkward.where("doc_id is not null"), trie_bytes=100).collect())
    assert whole == tiny


def test_spills_go_to_their_folder_and_are_deleted(tmp_path):
    trie = PatriciaTrie(min, 500, f"file://{tmp_path}/spill")
    keys = [f"{k % 7} some text {k} of a document".encode() for k in range(400)]
    for k, key in enumerate(keys):
        trie.insert(key, k, 1, "")
    assert list((tmp_path / "spill").iterdir())
    assert {k: v[0] for k, v in trie.items()} == {key: k for k, key in enumerate(keys)}
    assert not list((tmp_path / "spill").iterdir())


def test_trie_holds_any_bytes():
    random.seed(5)
    keys = [bytes(random.choice(b"ab\x00") for _ in range(random.randint(0, 12))) for _ in range(3000)]
    for limit in (1 << 20, 500):
        trie, best = PatriciaTrie(min, limit), {}
        for k, key in enumerate(keys):
            trie.insert(key, 3000 - k, 1, "")
            owner, n = best.get(key, (9999, 0))
            best[key] = (min(owner, 3000 - k), n + 1)
        assert {k: (v[0], v[1]) for k, v in trie.items()} == best


def test_dropping_keeps_columns_and_one_of_each(awkward, nothing):
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 5, 6, 7, 8, 9, 10, 11, 12]
    assert exact_dedup.assign(nothing).count() == 0
