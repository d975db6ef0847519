"""Simple-8b word-aligned coding of id sequences, and files of coded documents.

A word has 64 bits: a selector in the upper four and a payload of equal-width ids in the others. The
packer takes the selector with the most ids that all fit. An id beyond 60 bits is an escape word and
stands in a list beside the words. Blocks of 1,024 ids begin at a word of their own and never span
documents, so any block can be decoded alone, and all words of a selector at once.

A file holds consecutive documents: header, identifiers and lengths, per-block offsets into words and
escapes, words, escapes. Files are written as a whole under a temporary name and renamed; a shard's
manifest follows its files and the data set's follows all shards, so a task that is lost or doubled
leaves equal files, and a data set without its own manifest was never finished.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boursecraft.llm.packing import WordTokenizer, blocks
from boursecraft.session import tables_dir

#: Ids of a block.
BLOCK = 1024
#: Bytes of words after which a file is closed, and tasks that read files back, at most.
FILE_BYTES = 8 << 20
READERS = 4096

# Bits of an id and ids of a word, by selector. Selector 0 is the escape.
WIDTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0)
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 240)
ESCAPE, ZEROS = 0, 15
#: Words of up to eight ids are chosen by one look at the next eight; selector 7 and below hold more.
_MANY = 6

MAGIC = b"IDS8B-01"
_HEADER = np.dtype([("magic", "S8"), ("block", "<u8"), ("docs", "<u8"), ("ids", "<u8"), ("blocks", "<u8"), ("words", "<u8"), ("escapes", "<u8")])
_COUNT = np.array(COUNTS, np.int64)
_FEW = np.arange(COUNTS[_MANY + 1])
_FEW_WIDTHS = np.array([WIDTHS[COUNTS.index(n + 1, 1)] for n in _FEW.tolist()], np.uint8)

_FILES = "shard int, files array<struct<name: string, docs: long, ids: long, bytes: long, sha256: string>>"
_READ = "id long, start long, n_tokens long, tokens binary"


# ---- coding of arrays ------------------------------------------------------------------------------

_SMALL_BITS = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    top = int(ids.max()) if len(ids) else 0
    if top < len(_SMALL_BITS):
        return _SMALL_BITS[ids.astype(np.intp)]
    need = np.zeros(len(ids), np.uint8)
    for bit in range(top.bit_length()):
        need += ids >= np.uint64(1 << bit)
    return need


def block_sizes(lengths: np.ndarray) -> np.ndarray:
    """Ids of each block of sequences of these lengths; an empty sequence has no block."""
    full = -(-lengths // BLOCK)
    size = np.full(int(full.sum()), BLOCK, np.int64)
    ends = np.cumsum(full)[full > 0] - 1
    size[ends] = (lengths - (full - 1) * BLOCK)[full > 0]
    return size


def _fitting(need: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The selector of the word that begins at each place: the one with the most ids that all fit."""
    index = at[:, None] + _FEW
    most = np.maximum.accumulate(np.where(index < end[:, None], need[index], 0), axis=1)
    fits = most <= _FEW_WIDTHS
    count = _FEW[-1] + 1 - fits[:, ::-1].argmax(1)
    selector = np.where(fits.any(1), 15 - count, ESCAPE).astype(np.uint8)  # up to eight ids a word, selectors count down
    rows, reach = np.flatnonzero(fits[:, -1]), len(_FEW)
    most = most[rows, -1]
    for many in range(_MANY, 0, -1):  # and ever more ids where those are small
        if not len(rows):
            break
        index = at[rows, None] + np.arange(reach, COUNTS[many])
        most = np.maximum(most, np.where(index < end[rows, None], need[index], 0).max(1))
        reach = COUNTS[many]
        ok = most <= WIDTHS[many]
        selector[rows[ok]] = many
        small = most <= WIDTHS[many - 1]
        rows, most = rows[small], most[small]
    if len(rows):  # nothing but zeros so far
        index = at[rows, None] + np.arange(reach, COUNTS[ZEROS])
        zero = np.where(index < end[rows, None], need[index], 0).max(1) == 0
        selector[rows[zero]] = ZEROS
    return selector


def encode(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, words of each block, escapes, escapes of each block) for blocks of ``sizes`` ids."""
    ids = ids.astype(np.uint64, copy=False)
    need = np.append(_bits(ids), np.zeros(max(COUNTS), np.uint8))
    ends = np.cumsum(sizes)
    at, end, places, chosen = ends - sizes, ends, [], []
    while len(at):  # all blocks go from word to word at once
        selector = _fitting(need, at, end)
        places.append(at)
        chosen.append(selector)
        at = at + _COUNT[selector]
        more = at < end
        at, end = at[more], end[more]
    start = np.concatenate([*places, np.zeros(0, np.int64)])
    order = np.argsort(start, kind="stable")
    start, selectors = start[order], np.concatenate([*chosen, np.zeros(0, np.uint8)])[order]
    following = np.minimum(start + _COUNT[selectors], ends[np.searchsorted(ends, start, side="right")])
    words = selectors.astype(np.uint64) << np.uint64(60)
    padded = np.append(ids, np.zeros(max(COUNTS), np.uint64))
    for selector in np.unique(selectors):
        if selector in (ESCAPE, ZEROS):
            continue
        rows = np.flatnonzero(selectors == selector)
        begin, held, width = start[rows], following[rows] - start[rows], WIDTHS[selector]
        value = padded[begin]
        short = np.flatnonzero(held < COUNTS[selector])  # the last word of a block may hold fewer
        for k in range(1, COUNTS[selector]):
            part = padded[begin + k]
            part[short[held[short] <= k]] = 0
            value |= part << np.uint64(width * k)
        words[rows] |= value
    block_of = np.searchsorted(ends, start, side="right")
    escaped = selectors == ESCAPE
    return words, np.bincount(block_of, minlength=len(sizes)), ids[start[escaped]], np.bincount(block_of[escaped], minlength=len(sizes))


def decode(words: np.ndarray, block_words: np.ndarray, escapes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ids of whole blocks: all words of one selector are unpacked together."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNT[selectors]
    upto = np.cumsum(count) - count
    block_of = np.repeat(np.arange(len(sizes)), block_words)
    first_word = np.cumsum(block_words) - block_words
    within = upto - upto[first_word[block_of]] if len(words) else upto
    held = np.minimum(count, sizes[block_of] - within)
    to = (np.cumsum(sizes) - sizes)[block_of] + within
    out = np.zeros(int(sizes.sum()), np.uint64)
    out[to[selectors == ESCAPE]] = escapes
    for selector in np.unique(selectors):
        if selector in (ESCAPE, ZEROS):
            continue
        rows = np.flatnonzero(selectors == selector)
        width = WIDTHS[selector]
        mask, value, place, many = np.uint64((1 << width) - 1), words[rows], to[rows], held[rows]
        for k in range(COUNTS[selector]):
            some = many > k
            if not some.all():
                value, place, many = value[some], place[some], many[some]
            out[place + k] = (value >> np.uint64(width * k)) & mask
    return out


# ---- files -----------------------------------------------------------------------------------------

class Shard:
    """Files of one shard, filled with coded documents in order."""

    def __init__(self, uri: str, shard: int, file_bytes: int):
        self.files, self.folder = fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.folder, recursive=True)
        self.shard, self.limit, self.done = shard, file_bytes, []
        self._fresh()

    def _fresh(self) -> None:
        self.ids, self.lengths, self.parts, self.size = [], [], ([], [], [], []), 0

    def add(self, number: int | None, length: int, *parts: bytes) -> None:
        """``parts``: words, words of each block, escapes of each block, escapes."""
        if self.size and self.size + len(parts[0]) > self.limit:
            self.roll()
        self.ids.append(number)
        self.lengths.append(length)
        for held, part in zip(self.parts, parts):
            held.append(part)
        self.size += len(parts[0]) + 1

    def roll(self) -> None:
        if not self.ids:
            return
        words, block_words, block_escapes, escapes = (b"".join(p) for p in self.parts)
        offsets = [np.append(0, np.cumsum(np.frombuffer(p, "<u4").astype(np.uint64))).astype("<u8").tobytes() for p in (block_words, block_escapes)]
        head = np.array([(MAGIC, BLOCK, len(self.ids), sum(self.lengths), len(block_words) // 4, len(words) // 8, len(escapes) // 8)], _HEADER)
        absent = np.array([i is None for i in self.ids], np.uint8).tobytes()
        numbers = np.array([i or 0 for i in self.ids], "<i8").tobytes()
        data = b"".join([head.tobytes(), numbers, np.array(self.lengths, "<u8").tobytes(), *offsets, words, escapes, absent])
        name = f"ids-{self.shard:06d}-{len(self.done):06d}.s8b"
        commit(self.files, f"{self.folder}/{name}", data)
        self.done.append({"name": name, "docs": len(self.ids), "ids": sum(self.lengths), "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
        self._fresh()

    def close(self) -> None:
        self.roll()
        commit(self.files, f"{self.folder}/manifest-{self.shard:06d}.json", json.dumps({"shard": self.shard, "files": self.done}).encode())


def commit(files: fs.FileSystem, path: str, data: bytes) -> None:
    """Write under a name of its own, then rename: readers see a whole file or none."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(temporary) as out:
        out.write(data)
    files.move(temporary, path)


def parse(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(identifiers, lengths, ids) of a file."""
    head = np.frombuffer(data, _HEADER, 1)[0]
    if bytes(head["magic"]) != MAGIC or head["block"] != BLOCK:
        raise ValueError("not a file of this format")
    at = _HEADER.itemsize

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        values = np.frombuffer(data, kind, n, at)
        at += values.nbytes
        return values

    docs, many = int(head["docs"]), int(head["blocks"])
    numbers, lengths = take("<i8", docs), take("<u8", docs).astype(np.int64)
    words_to, escapes_to = take("<u8", many + 1), take("<u8", many + 1)
    words, escapes, absent = take("<u8", int(head["words"])), take("<u8", int(head["escapes"])), take("u1", docs)
    if words_to[-1] != len(words) or escapes_to[-1] != len(escapes):
        raise ValueError("block offsets do not fit the words")
    ids = decode(words, np.diff(words_to).astype(np.int64), escapes, block_sizes(lengths))
    return [None if gone else n for n, gone in zip(numbers.tolist(), absent.tolist())], lengths, ids


# ---- Spark ---------------------------------------------------------------------------------------

def coded(numbers: list[int | None], found: list[np.ndarray]) -> Iterator[tuple]:
    """(identifier, length, words, words of each block, escapes of each block, escapes) of documents."""
    lengths = np.array([len(ids) for ids in found], np.int64)
    words, per_block, escapes, per_block_escapes = encode(np.concatenate(found), block_sizes(lengths))
    upto_block = np.append(0, np.cumsum(-(-lengths // BLOCK)))
    upto = [np.append(0, np.cumsum(p)) for p in (per_block, per_block_escapes)]
    raw = words.astype("<u8").tobytes(), per_block.astype("<u4").tobytes(), per_block_escapes.astype("<u4").tobytes(), escapes.astype("<u8").tobytes()
    edges = 8 * upto[0][upto_block], 4 * upto_block, 4 * upto_block, 8 * upto[1][upto_block]
    parts = [[data[a:b] for a, b in zip(edge.tolist(), edge[1:].tolist())] for data, edge in zip(raw, edges)]
    return zip(numbers, lengths.tolist(), *parts)


def write(docs: DataFrame, path: str, end_id: int, uri: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of documents, by the tokenizer file and each with ``end_id`` behind, under ``uri``.

    Documents ascend by identifier, null first; rows that share one follow the hashes of their texts.
    Null texts are empty: the end id alone. Other columns are ignored, whatever their names. Texts are
    range-sorted before they are tokenised, so that ids go from the tokenizer into files; a row's
    place parts ties, so no identifier fills a task. The driver gets the totals.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({"path": path})
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"_tie": F.xxhash64("text"), "_salt": F.monotonically_increasing_id()})
    keys = [F.col("id").asc_nulls_first(), F.col("_tie").asc(), F.col("_salt").asc()]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, last = shared.value, None, np.array([end_id], "<u4")
        if "tokenizer" not in held:
            held["tokenizer"] = WordTokenizer(held["path"])
        for numbers, texts in blocks(batches):
            shard = shard or Shard(uri, TaskContext.get().partitionId(), file_bytes)
            for row in coded(numbers, [np.append(ids, last) for ids in held["tokenizer"].encode(texts)]):
                shard.add(*row)
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([len(shard.done)], pa.int64()), pa.array([sum(f["docs"] for f in shard.done)], pa.int64()), pa.array([sum(f["ids"] for f in shard.done)], pa.int64())], ["files", "docs", "ids"])

    done = ordered.mapInArrow(put, "files long, docs long, ids long")
    total = done.agg(F.count("*").alias("shards"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "docs", "ids")]).first()
    files, folder = fs.FileSystem.from_uri(uri)
    files.create_dir(folder, recursive=True)
    commit(files, f"{folder}/dataset.json", json.dumps(total.asDict()).encode())


def read(spark: SparkSession, uri: str) -> DataFrame:
    """One row per document of the data set: id, start (ids of all documents before it), n_tokens and
    tokens, its ids as little-endian unsigned 32-bit integers.

    The files are those that the manifests name; sizes, digests and the data set's totals are checked.
    A task holds one file, which ``file_bytes`` bounds unless one document is larger.
    """
    files, folder = fs.FileSystem.from_uri(uri)
    with files.open_input_stream(f"{folder}/dataset.json") as source:
        total = json.loads(source.read())
    if not total["shards"]:
        return spark.createDataFrame([], _READ)
    shards = spark.read.schema(_FILES).json(f"{uri}/manifest-*.json")
    named = shards.select("shard", F.posexplode("files").alias("place", "file")).select("shard", "place", "file.*")
    found = named.agg(F.count_distinct("shard").alias("shards"), F.count("*").alias("files"), F.sum("docs").alias("docs"), F.sum("ids").alias("ids")).first()
    if found.asDict() != total:
        raise ValueError(f"{uri}: the manifests {found.asDict()} do not add up to {total}")
    # ids before a shard: a row per shard is accumulated; ids before a file: inside its shard
    per_shard = shards.select("shard", F.aggregate("files", F.lit(0).cast("long"), lambda n, f: n + f["ids"]).alias("_n"))
    before = per_shard.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_shard_start"))
    inside = F.sum("ids").over(Window.partitionBy("shard").orderBy("place")) - F.col("ids")
    placed = named.withColumn("_inside", inside).join(before, "shard").select(F.concat(F.lit(f"{uri}/"), "name").alias("path"), "bytes", "sha256", (F.col("_inside") + F.col("_shard_start")).alias("start"))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, sha, start in zip(*(c.to_pylist() for c in batch.columns)):
                source_files, place = fs.FileSystem.from_uri(path)
                with source_files.open_input_stream(place, compression=None) as source:
                    data = source.read()
                if len(data) != size or hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{path} is not the file of its manifest")
                numbers, lengths, ids = parse(data)
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                edges = np.append(0, 4 * ends).tolist()
                for k in range(0, len(numbers), 4096):
                    some = slice(k, k + 4096)
                    tokens = [raw[a:b] for a, b in zip(edges[k : k + 4096], edges[k + 1 : k + 4097])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers[some], pa.int64()), pa.array(start + ends[some] - lengths[some]), pa.array(lengths[some]), pa.array(tokens, pa.binary())], ["id", "start", "n_tokens", "tokens"]
                    )

    return placed.repartition(max(1, min(READERS, total["files"]))).mapInArrow(get, _READ)


def new_folder(spark: SparkSession) -> str:
    """A folder for a data set in the place that all executors share; removed when the application ends."""
    base = tables_dir(spark)
    return f"{base if ':' in base else 'file://' + base}/ids-{uuid.uuid4().hex}"
