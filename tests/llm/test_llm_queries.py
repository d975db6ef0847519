"""The registered queries: those with SQL against it, the pipeline against its parts."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from check_queries import compare, connect
from tokenizers import Tokenizer

import corpus_pipeline
from boursecraft.llm import queries  # noqa: F401  (registers)
from boursecraft.llm import exact_dedup, near_dedup, toxicity
from boursecraft.llm.registry import ORACLES, QUERIES
from boursecraft.session import materialise

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    problem, _ = compare(QUERIES[name](spark, SF), ORACLES[name], connect(SF))
    assert not problem


def test_token_queries_equal_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op6_token_counts"](spark, SF).collect()}
    assert counts == {i: (len(texts[i].encode()), len(v), len(v) > 512) for i, v in ids.items()}
    coded = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op9_bpe"](spark, SF).collect()}
    assert coded == {i: (len(v), sha(",".join(map(str, v))), sha(library.decode(v, skip_special_tokens=False))) for i, v in ids.items()}


def test_packing_query_places_every_token_once(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want += [(r.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    rows = QUERIES["op5_packing"](spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(held) <= -(-sum(w[3] for w in want) // 2048) + 3


def test_near_dedup_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    weights = near_dedup.Weights(near_dedup.common_shingles(near_dedup._texts(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")))
    names = sorted(docs)
    every = [near_dedup._leveled(docs[i], weights) for i in names]
    like = near_dedup.similarities(every, every)
    group = {i: i for i in names}
    for _ in names:  # the smallest name sinks along links
        moved = False
        for a, b in zip(*np.nonzero(like >= 0.8 - 1e-12)):
            low = min(group[names[a]], group[names[b]])
            moved = moved or group[names[a]] != low or group[names[b]] != low
            group[names[a]] = group[names[b]] = low
        if not moved:
            break
    found = {r.doc_id: (r.group_id, r.kept) for r in QUERIES["op2_minhash_near_dedup"](spark, SF).collect()}
    assert found == {i: (g, g == i) for i, g in group.items()}


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "t")
        out[name] = docs
        if name != "best-fit packing":
            assert docs.columns == columns
    every = spark.read.parquet(f"{SF}/documents.parquet")
    lexicon = toxicity.train(every, spark.read.parquet(f"{SF}/labels.parquet").where(~queries.held_out()))
    clean = every.join(toxicity.score(every, lexicon).where("score < 0.5").select("doc_id"), "doc_id", "left_semi")
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert ids(out["toxicity"]) == ids(clean)
    assert ids(out["exact dedup"]) == ids(exact_dedup.assign(clean, keep="largest").where("kept"))
    assert ids(out["minhash near-dedup"]) == ids(near_dedup.near_duplicates(out["exact dedup"]).where("kept")) == ids(out["secret scans"])
    assert not [r for r in out["secret scans"].collect() if "password=" in r.text and "[SECRET]" not in r.text]
    assert ids(out["best-fit packing"]) == ids(out["secret scans"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids(out["best-fit packing"])


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, _before string, _gone long, _kept_id long, row string, id long, owner long, gone long, _text string, _parts string"


def awkward_documents(spark):
    words = " ".join(f"w{k}" for k in range(40))
    given = [
        (1, "same text here for all of us to read", 1), (2, "Same text here for all of us to READ", 1), (3, words, 1), (4, words + " end", 1), (5, None, None), (6, "", 0), (None, "nobody's own text", 1),
        (7, "my password=abcdef123 and more words", 1), (7, "my password=abcdef123 and more words", 1), (8, "x" * 50000, 50000), (9, "token = 'zzzzzz99' twice token = 'zzzzzz99'", 1),
    ]
    return spark.createDataFrame([(i, t, "en", None, n, "password=hidden77", 1, 1, "r", 9, 9, 1, t, "p") for i, t, n in given], AWKWARD)


def test_pipeline_stages_on_awkward_documents(spark):
    docs = awkward_documents(spark)
    ids = lambda d: sorted((r.doc_id is not None, r.doc_id or 0) for r in d.collect())
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF), "awkward")
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        kept[name], docs = ids(out), out
    assert kept["toxicity"] == ids(awkward_documents(spark))
    assert [i for _, i in kept["exact dedup"]].count(1) == 0 and (True, 2) in kept["exact dedup"]  # the larger of two equal texts
    assert (True, 3) in kept["minhash near-dedup"] and (True, 4) not in kept["minhash near-dedup"]
    assert kept["secret scans"] == kept["minhash near-dedup"]
    texts = {r.doc_id: r for r in docs.collect()}
    assert texts[7].text == "my [SECRET] and more words" and texts[7].n_chars == len(texts[7].text) and texts[7]._before == "password=hidden77" and texts[7].row == "r"
    assert texts[9].text == "[SECRET]' twice [SECRET]'" and texts[8].n_chars == 50000 and None in texts
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(texts)


def test_pipeline_stages_on_empty_documents(spark):
    docs = awkward_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
