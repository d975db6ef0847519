from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F

from boursecraft.llm import chat, warc

PARTS = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN:x]", "[/TURN]", "\\", " ", "a", "\n", "[", "<", "😀"])
TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool x]", "é\n"]), st.lists(PARTS, max_size=6).map("".join))


@settings(max_examples=400, deadline=None)
@given(st.lists(TURN, max_size=5))
def test_any_conversation_comes_back(turns):
    formatted, loss = chat.round_trip(turns)
    assert chat.parse(formatted) == (turns, loss)
    masked = ["".join(v for v, _, _, _ in chat._tokens(formatted[a:b])) for a, b in loss]
    assert masked == [t for role, t in turns if role == "assistant"]


def test_plain_texts_are_not_escaped_and_markers_are():
    assert chat.round_trip([("user", "a\\b"), ("assistant", "c")])[0] == "<s>[INST] a\\b [/INST] c </s>"
    assert "\\</s>" in chat.round_trip([("user", "</s>"), ("assistant", "fine")])[0]
    with pytest.raises(chat.NotInGrammar):
        chat.parse("<s>[INST] never closed")


def test_formatting_awkward_rows(spark):
    rows = [(1, 1, "assistant", "</s>", "x"), (1, 0, "user", None, "x"), (None, 0, "user", "a", "y"), (2, None, None, "", "y"), (2, None, None, "", "y"), (3, 0, "assistant", "z" * 90000, "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.digests(chat.format_conversations(table)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out[1].turns_sha256 == sha("user\n\nassistant\n</s>\n") and out[1].loss_sha256 == sha("</s>") and out[1].loss_chars == 4
    assert out[2].n_turns == 2 and out[2].loss_chars == 0 and out[None].n_turns == 1 and out[3].loss_chars == 90000
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_archives_hold_what_was_written(spark, tmp_path):
    rows = [(3, "u", "same", 1), (1, "u\r\nX: y", "same", 1), (2, None, "", 1), (4, "v", None, 1), (None, "w", "same", 1), (5, "v", "é" * 50000, 1), (5, "v", "other", 1), (1 << 40, "far", "x", 2), (-7, "minus", "y", 2)]
    rows += [(6, "copy", "again and again", 1)] * 40 + [(None, f"n{k % 2}", "nobody's", 1) for k in range(20)] + [(9, "late", "again and again", 1)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    folder = f"file://{tmp_path}/a"
    warc.write(pages, folder, shard_bytes=40, file_bytes=300)
    found = warc.read(spark, folder).collect()
    first = {"same": 1, "": 2, "again and again": 6}
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        owner = first.get(html or "")
        refers = owner if owner is not None and i is not None and owner < i else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers else "response", refers))
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == sorted(want, key=repr)
    files, place = fs.FileSystem.from_uri(folder)
    names = [f.base_name for f in files.get_file_info(fs.FileSelector(place))]
    manifest = warc.manifest(spark, folder)
    assert not [n for n in names if n.endswith(".tmp")] and any(n.startswith("manifest-") for n in names) and manifest.count() > 2
    # copies of one row that fill shards are dealt over them, and no two records share a name
    records = [h for f in files.get_file_info(fs.FileSelector(place)) if f.base_name.endswith(".gz") for h, _ in warc.parse(io.BufferedReader(gzip.open(f.path)))]
    ids = [h["warc-record-id"] for h in records]
    assert len(set(ids)) == len(ids) == len(rows)
    assert {h["warc-refers-to"] for h in records if "warc-refers-to" in h} <= set(ids)
    assert len({r.shard for r in manifest.collect()}) > 5
    warc.write(pages.limit(0), f"file://{tmp_path}/c")
    assert warc.read(spark, f"file://{tmp_path}/c").count() == 0


def test_files_depend_on_the_rows_alone(spark, tmp_path):
    rows = [(k % 97, f"u{k}", f"text {k % 61} " * (k % 7), 1) for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    sums = []
    for k, given in enumerate((pages, pages.repartition(5), pages.orderBy(F.desc("url")))):
        warc.write(given, f"file://{tmp_path}/{k}", shard_bytes=2000, file_bytes=900)
        sums.append(sorted((r.path.rsplit("/", 1)[1], r.sha256) for r in warc.manifest(spark, f"file://{tmp_path}/{k}").collect()))
    assert sums[0] == sums[1] == sums[2] and len(sums[0]) > 5


def test_unfinished_and_damaged_archives_are_found(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"text {k}") for k in range(50)], "page_id long, url string, html string")
    uri = f"file://{tmp_path}/a"
    warc.write(pages, uri, shard_bytes=100)
    sorted(tmp_path.glob("a/manifest-*.json"))[0].unlink()
    with pytest.raises(ValueError, match="add up"):
        warc.read(spark, uri)
    (tmp_path / "a" / "dataset.json").unlink()
    with pytest.raises(FileNotFoundError):
        warc.read(spark, uri)


def test_least_size_of_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/d", revisit_from=3)
    assert [r.record_type for r in warc.read(spark, f"file://{tmp_path}/d").collect()] == ["response", "response"]
