"""BPE, token counts and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from boursecraft.llm import bpe, packing, token_counts, vocabulary

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(BYTES)
CODEC = bpe.Codec(vocabulary.load(BYTES))
COUNTER = token_counts.Counter(token_counts.compile_tables(BYTES))
TEXT = st.lists(st.sampled_from([*"abc's tredLlvem 12٣  \n\t\r\xa0 　\x1c\x85.,é́ßçǅ漢😀", "<|endoftext|>", "'re", "'ll", "'s", "  ", "ing"]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_codec_and_counts_equal_the_library(texts):
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    got = CODEC.encode(texts)
    assert [g.tolist() for g in got] == want
    assert [CODEC.decode(g) for g in got] == [LIBRARY.decode(w, skip_special_tokens=False) for w in want]
    assert COUNTER.count(texts).tolist() == [len(w) for w in want]


@pytest.mark.parametrize("text", ["ab" * 3000, "x" * 5000, " " * 3000, "é" * 999, "<|endoftext|>" * 40, "", "\n\n\n"])
def test_long_words_and_special_strings(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.encode([text])[0].tolist() == want
    assert COUNTER.count([text]).tolist() == [len(want)]


def test_short_and_long_merges_agree():
    random.seed(2)
    tables = vocabulary.load(BYTES)
    words = ["".join(random.choice("abetrings ") for _ in range(random.randint(1, 40))).encode() for _ in range(300)]
    short = bpe.RankArrays(tables["ids"], tables["merges"]).parts(words)
    for word, ids in zip(words, short):
        bounds = bpe.split_long(word, tables["merges"])
        assert np.frombuffer(ids, "<u4").tolist() == [tables["ids"][word[a:b]] for a, b in zip(bounds, bounds[1:])]


def test_scanner_state_maps_compose():
    """Words don't depend on where chunks are cut."""
    following, output, start = token_counts.scanner()
    rng = np.random.default_rng(1)
    kind = np.append(rng.integers(0, 10, 5000), 10).astype(np.uint8)
    mark = token_counts.word_starts(kind, following, output, start)
    state, said = start, []
    for c in kind:
        said.append(output[state * 11 + c])
        state = following[state * 11 + c]
    plain = np.array([bool(s & 1) for s in said]) | np.append(np.array([bool(s & 2) for s in said[1:]]), False)
    assert (mark == plain).all()


LONG = "It's the  naïve café's 12345 words, 😀😀 don't!\n\n\tspaces   and <|endoftext|> more " + "x" * 700 + " Ünïcödé漢字" * 30 + " end"


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 500, 4096])
def test_composed_chunk_counts_equal_the_library_for_any_chunk_length(chunk):
    counter = token_counts.Counter(token_counts.compile_tables(BYTES), chunk)
    texts = [LONG, "", "short", LONG * 3, "a" * 1000, "<|endoftext|>", " " * 50 + "tail", LONG[:-1] + "<|endoftext|>" + LONG]
    assert counter.count(texts).tolist() == [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


def test_count_maps_compose_in_any_grouping():
    words = token_counts.Counter(token_counts.compile_tables(BYTES)).words
    rng = random.Random(6)
    for _ in range(50):
        maps = [token_counts.CountMap(bytes(rng.choices(b"abcde", k=rng.randrange(4))), rng.random() < 0.4, rng.randrange(5), words.run(0, bytes(rng.choices(b"abcde", k=rng.randrange(4))))[0]) for _ in range(6)]
        maps = [m._replace(added=0, state=0) if m.passes else m for m in maps]
        one = maps[0]
        for m in maps[1:]:
            one = one.then(m, words)
        other = maps[-1]
        for m in reversed(maps[:-1]):
            other = m.then(other, words)
        assert one == other == token_counts.composed(maps, words)[-1]


def test_encode_operator_on_awkward_rows(awkward, nothing):
    rows = bpe.encode(awkward, BYTES).collect()
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    assert len(rows) == awkward.count()
    for r in rows:
        if r.doc_id is not None:
            assert r.token_ids == LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids and r.decoded == texts[r.doc_id]
    for r in bpe.digests(awkward, BYTES).where("doc_id is not null").collect():
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    for r in token_counts.count_tokens(awkward, BYTES).where("doc_id is not null").collect():
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids))
    assert bpe.encode(nothing, BYTES).count() == 0 and token_counts.count_tokens(nothing, BYTES).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aHK'és Σς12,|.<>=\n\t\xa0　\u0338\u0301é漢", "<|endoftext|>", "'s", " | "]), max_size=40).map("".join), min_size=1, max_size=6))
def test_runs_are_tokenised_as_whole_texts(texts):
    library = Tokenizer.from_file(WORDS)
    tokenizer = packing.WordTokenizer(WORDS)
    assert [e.tolist() for e in tokenizer.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_packing_places_every_piece_once(awkward, nothing):
    capacity = 64
    parts = packing.pack(packing.pieces(awkward, WORDS, capacity, with_ids=True), capacity, shard_pieces=50).collect()
    library = Tokenizer.from_file(WORDS)
    want = []
    for r in awkward.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want += [(r.doc_id, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(np.array(ids[k : k + capacity], "<u4").tobytes())) for k in range(0, len(ids), capacity)]
    assert sorted(((p.id, p.piece, p.start, p.length, p.ids_crc32) for p in parts), key=repr) == sorted(want, key=repr)
    held = {}
    for p in parts:
        held.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(packing.pieces(nothing, WORDS, capacity), capacity).count() == 0


def test_sum_of_squares_takes_the_least_change():
    rng = np.random.default_rng(4)
    lengths = [int(x) for x in rng.integers(1, 100, 400)]
    sequences = packing.sum_of_squares(lengths, 100)
    gaps, total = {}, []
    for i in sorted(range(400), key=lambda k: (-lengths[k], k)):  # the same rule by brute force
        best = None
        for gap in [*sorted(g for g in gaps if gaps[g]), 100]:
            if gap < lengths[i]:
                continue
            after = dict(gaps)
            if gap < 100:
                after[gap] -= 1
            if gap > lengths[i]:
                after[gap - lengths[i]] = after.get(gap - lengths[i], 0) + 1
            squares = sum(n * n for n in after.values())
            if best is None or squares < best[0]:
                best = (squares, after, gap)
        gaps = best[1]
        total.append(best[2] == 100)
    assert len(sequences) == sum(total)
    assert sorted(i for s in sequences for i in s) == list(range(400))
    assert len(packing.packed(lengths, 100)) <= len(sequences)
