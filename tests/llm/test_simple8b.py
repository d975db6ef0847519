from __future__ import annotations

import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

import public_tokenizers

from boursecraft.llm import simple8b

PATH = public_tokenizers.path("word_bpe_49k.json")
NUMBER = st.one_of(st.integers(0, 3), st.integers(0, 49407), st.integers(0, (1 << 60) - 1), st.integers(1 << 60, (1 << 64) - 1), st.just(0))
RUN = st.tuples(NUMBER, st.integers(1, 300)).map(lambda r: [r[0]] * r[1])


def plain_words(ids: list[int]) -> list[int]:
    """A block by the rule: the selector with the most ids that all fit."""
    words, at = [], 0
    while at < len(ids):
        fits = [(simple8b.COUNTS[s], s) for s in range(1, 16) if all(v.bit_length() <= simple8b.WIDTHS[s] for v in ids[at : at + simple8b.COUNTS[s]])]
        count, selector = max(fits, default=(1, simple8b.ESCAPE))
        word = selector << 60
        if selector:
            for k, v in enumerate(ids[at : at + count]):
                word |= v << (simple8b.WIDTHS[selector] * k)
        words.append(word)
        at += count
    return words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(RUN, st.lists(NUMBER, max_size=40)), max_size=8))
def test_any_ids_come_back_by_the_packing_rule(parts):
    docs = [np.array(p, np.uint64) for p in parts]
    lengths = np.array([len(d) for d in docs], np.int64)
    sizes = simple8b.block_sizes(lengths)
    ids = np.concatenate([*docs, np.zeros(0, np.uint64)])
    words, per_block, escapes, _ = simple8b.encode(ids, sizes)
    assert simple8b.decode(words, per_block, escapes, sizes).tolist() == ids.tolist()
    edges = np.append(0, np.cumsum(sizes)).tolist()
    assert words.tolist() == [w for a, b in zip(edges, edges[1:]) for w in plain_words(ids[a:b].tolist())]


def test_blocks_never_span_sequences():
    assert simple8b.block_sizes(np.array([0, 1, 1024, 1025, 0, 3000])).tolist() == [1, 1024, 1024, 1, 1024, 1024, 952]


def in_order(spark, docs):
    """Documents as the files hold them: by identifier, null first, then by the hash of the text."""
    rows = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS tie").collect()
    return [(r.doc_id, r.text) for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))]


def expected(rows):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    out, start = [], 0
    for i, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_bytes", [1, 3000, simple8b.FILE_BYTES])
def test_files_hold_all_documents_in_order(spark, awkward, tmp_path, file_bytes):
    docs = awkward.select("doc_id", "text", "score").withColumnRenamed("score", "words")
    uri = f"file://{tmp_path}/data"
    simple8b.write(docs, PATH, 2, uri, file_bytes=file_bytes)
    found = sorted((tuple(r) for r in simple8b.read(spark, uri).collect()), key=lambda r: r[1])
    assert [(i, s, n, bytes(t)) for i, s, n, t in found] == expected(in_order(spark, docs))
    assert not [f for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(str(tmp_path), recursive=True)) if f.path.endswith(".tmp")]


def test_query_equals_the_library(spark):
    from boursecraft.llm import queries, registry

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert queries.op12 is registry.QUERIES["op12_simple8b_files"]
    found = sorted(tuple(r) for r in queries.op12(spark, sf).collect())
    assert found == sorted((i, s, n, zlib.crc32(t)) for i, s, n, t in expected(in_order(spark, docs)))


def test_damage_and_unfinished_data_sets_are_found(spark, awkward, nothing, tmp_path):
    uri = f"file://{tmp_path}/data"
    simple8b.write(awkward, PATH, 2, uri, file_bytes=3000)
    name = sorted(tmp_path.glob("data/*.s8b"))[0]
    raw = name.read_bytes()
    name.write_bytes(raw[:-1] + b"x")
    with pytest.raises(Exception, match="not the file of its manifest"):
        simple8b.read(spark, uri).collect()
    manifest = sorted(tmp_path.glob("data/manifest-*.json"))[0]
    body = json.loads(manifest.read_text())
    body["files"] = body["files"][1:]
    manifest.write_text(json.dumps(body))
    with pytest.raises(ValueError, match="add up"):
        simple8b.read(spark, uri)
    with pytest.raises(FileNotFoundError):
        simple8b.read(spark, f"file://{tmp_path}/none")
    simple8b.write(nothing, PATH, 2, f"file://{tmp_path}/empty")
    assert simple8b.read(spark, f"file://{tmp_path}/empty").count() == 0


def test_packing_is_denser_than_four_bytes(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    simple8b.write(docs, PATH, 2, f"file://{tmp_path}/data")
    files = [f for m in tmp_path.glob("data/manifest-*.json") for f in json.loads(m.read_text())["files"]]
    assert sum(f["bytes"] for f in files) < 2.8 * sum(f["ids"] for f in files)
