"""Cutting quoted CSV into records inside a file, range by range.

Whether a line end closes a record depends on every quote before it. A range of bytes is therefore
first summed up as a map: for each state a range may be entered in, the state it is left in. Maps
compose, so the state that each range is entered in follows from the maps of the ranges before it,
without their bytes. Then each range knows its first real record start; what stands before it belongs
to a record of an earlier range and is sent there. No task needs more than a range and the record
that runs over its end.
"""

from __future__ import annotations

import csv
import hashlib
import io
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boursecraft.session import materialise, ship_functions

ship_functions(__name__)

#: Bytes of a range.
RANGE_BYTES = 4 << 20
_LANE = 256
_BOM = b"\xef\xbb\xbf"

# States: at a record's start; behind a separator; in a plain cell; inside quotes; behind a quote inside
# quotes; behind a carriage return that closed a record.
RECORD, FIELD, PLAIN, QUOTED, CLOSING, RETURN = range(6)
_OTHER, _COMMA, _QUOTE, _CR, _LF = range(5)
_NEXT = np.zeros((6, 5), np.uint8)
for _state in (RECORD, FIELD, RETURN):
    _NEXT[_state] = [PLAIN, FIELD, QUOTED, RETURN, RECORD]
_NEXT[PLAIN] = [PLAIN, FIELD, PLAIN, RETURN, RECORD]
_NEXT[QUOTED] = [QUOTED, QUOTED, CLOSING, QUOTED, QUOTED]
_NEXT[CLOSING] = [PLAIN, FIELD, QUOTED, RETURN, RECORD]
_FLAT = _NEXT.ravel()
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in ',"\r\n']] = [_COMMA, _QUOTE, _CR, _LF]


def _lanes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(classes of the bytes in lanes of equal length, the last lane's rest)."""
    kind = _KIND[np.frombuffer(data, np.uint8)]
    whole = len(kind) // _LANE * _LANE
    return kind[:whole].reshape(-1, _LANE), kind[whole:]


def _lane_maps(lanes: np.ndarray) -> np.ndarray:
    maps = np.tile(np.arange(6, dtype=np.uint8), (len(lanes), 1))
    for t in range(lanes.shape[1] if len(lanes) else 0):
        maps = _FLAT[maps * np.uint8(5) + lanes[:, t, None]]
    return maps


def _scan(maps: np.ndarray) -> np.ndarray:
    """Row k becomes the composition of rows 0..k."""
    reach = 1
    while reach < len(maps):
        later = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), 1)
        maps = np.concatenate([maps[:reach], later])
        reach *= 2
    return maps


def state_map(data: bytes) -> list[int]:
    """The state behind ``data`` for each state before it."""
    lanes, rest = _lanes(data)
    upto = _scan(_lane_maps(lanes))
    state = upto[-1] if len(upto) else np.arange(6, dtype=np.uint8)
    for kind in rest:
        state = _NEXT[state, kind]
    return state.tolist()


def cut(data: bytes, state: int) -> tuple[int, int]:
    """(where the first record that starts in ``data`` starts, how many start), entered in ``state``.

    Without a start the first number is the length. A line feed behind a carriage return ends nothing.
    """
    lanes, rest = _lanes(data)
    upto = _scan(_lane_maps(lanes))
    before = np.append(np.uint8(state), upto[:, state]) if len(upto) else np.array([state], np.uint8)
    seen = np.empty((len(lanes), _LANE), np.uint8)
    at = before[:-1]
    for t in range(_LANE if len(lanes) else 0):
        seen[:, t] = at
        at = _FLAT[at * np.uint8(5) + lanes[:, t]]
    tail, at = np.empty(len(rest), np.uint8), before[-1]
    for k, kind in enumerate(rest):
        tail[k] = at
        at = _NEXT[at, kind]
    entered, kind = np.append(seen.ravel(), tail), np.append(lanes.ravel(), rest)
    # a record starts at a byte that is entered at a record's start, or behind a return by no line feed
    starts = np.flatnonzero((entered == RECORD) | ((entered == RETURN) & (kind != _LF)))
    return (int(starts[0]), len(starts)) if len(starts) else (len(data), 0)


def records(data: bytes) -> list[list[str]]:
    """The cells of each record of whole records."""
    csv.field_size_limit(sys.maxsize)
    return list(csv.reader(io.TextIOWrapper(io.BytesIO(data), "utf-8", newline="")))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows one at a time: Python never holds the values of a whole batch."""
    for row in zip(*batch.columns):
        yield tuple(value.as_py() for value in row)


_OUT = 1 << 20
_LINES = 4096


def whole_lines(files: DataFrame) -> DataFrame:
    """(source_path, content_sha256, header, first_number, lines) of files small enough to be parsed whole,
    some thousand lines to a row; the first record, the header, has number 0 and is no line."""
    columns = ["source_path", "content_sha256", "header", "first_number", "lines"]
    kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.list_(pa.string())))
    body = F.when(F.substring("content", 1, 3) == F.lit(_BOM), F.expr("substring(content, 4)")).otherwise(F.col("content"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], columns)
        rows, held = [], 0
        for batch in batches:
            for source, digest, data in _rows(batch):
                header, *lines = records(data)
                for k in range(0, len(lines), _LINES):
                    some = lines[k : k + _LINES]
                    rows.append((source, digest, header, k + 1, some))
                    held += sum(len(cell) for line in (header, *some) for cell in line)
                    if held >= _OUT:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    bodies = files.select("source_path", "content_sha256", body.alias("_body")).where(F.octet_length("_body") > 0)
    return bodies.mapInArrow(parse, "source_path string, content_sha256 string, header array<string>, first_number long, lines array<array<string>>")


# ---- ranges ----------------------------------------------------------------------------------------

def content_ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """(source_path, block, seq, bytes) from whole contents; a content is one value of at most 2 GB."""
    body = F.when(F.substring("content", 1, 3) == F.lit(_BOM), F.expr("substring(content, 4)")).otherwise(F.col("content"))
    cuts = F.sequence(F.lit(0).cast("long"), F.ceil(F.octet_length("_body") / size) - 1)
    rows = files.select("source_path", body.alias("_body")).where(F.octet_length("_body") > 0)
    return rows.select("source_path", F.lit(0).cast("long").alias("block"), F.explode(cuts).alias("seq"), "_body").select(
        "source_path", "block", "seq", F.expr(f"substring(_body, CAST(seq * {size} + 1 AS INT), {size})").alias("bytes")
    )


def read_ranges(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """(source_path, block, seq, bytes, file_size) of the CSV files under ``path``.

    Files are read in splits of ``spark.sql.files.maxPartitionBytes``, many tasks to a file. Splits are
    cut at line feeds only as a convenience of the reader: a range may still begin inside quotes. The
    line feed behind the last line, which the reader cannot tell, is put right by ``trimmed``.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"), F.col("value").cast("binary").alias("bytes"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, length, seq = None, [], 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([name[0]]), pa.array([name[1]], pa.int64()), pa.array([seq], pa.int64()), pa.array([b"".join(held)], pa.binary()), pa.array([name[2]], pa.int64())],
                ["source_path", "block", "seq", "bytes", "file_size"],
            )

        for batch in batches:
            for source, block, total, line in _rows(batch):
                if (source, block, total) != name:
                    if held:
                        yield row()
                    name, held, length, seq = (source, block, total), [], 0, 0
                elif length >= size:
                    yield row()
                    held, length, seq = [], 0, seq + 1
                held += [line, b"\n"]
                length += len(line) + 1
        if held:
            yield row()

    return rows.mapInArrow(join, "source_path string, block long, seq long, bytes binary, file_size long")


def trimmed(ranges: DataFrame) -> DataFrame:
    """Ranges of ``read_ranges`` without a line feed that the file doesn't end with; ``marked`` tells the
    first range of a file that begins with a byte order mark, which the reader leaves out. The file's
    size tells both apart: a line feed is one byte too many, a mark three too few."""
    sizes = ranges.select("source_path", "block", "seq", "file_size", F.octet_length("bytes").cast("long").alias("_n"))
    here = F.struct("block", "seq")
    each = sizes.groupBy("source_path").agg((F.sum("_n") - F.max("file_size")).alias("_over"), F.max(here).alias("_last"), F.min(here).alias("_first"))
    both = ranges.drop("file_size").join(each, "source_path")
    shorter = (here == F.col("_last")) & F.col("_over").isin(1, -2)
    body = F.when(shorter, F.expr("substring(bytes, 1, octet_length(bytes) - 1)")).otherwise(F.col("bytes"))
    return both.select("source_path", "block", "seq", body.alias("bytes"), ((here == F.col("_first")) & (F.col("_over") < 0)).alias("marked"))


def digests(ranges: DataFrame) -> DataFrame:
    """(source_path, content_sha256, size_bytes) of files given as ranges of ``trimmed``: a digest is one
    chain over a file's bytes, so it is streamed by one task a file, a range at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, size = None, None, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()]), pa.array([size], pa.int64())], ["source_path", "content_sha256", "size_bytes"])
        for batch in batches:
            for source, data, marked in _rows(batch):
                if source != name:
                    if name is not None:
                        yield row()
                    name, state, size = source, hashlib.sha256(), 0
                data = _BOM + data if marked else data
                state.update(data)
                size += len(data)
        if name is not None:
            yield row()

    ordered = ranges.repartition("source_path").sortWithinPartitions("source_path", "block", "seq")
    return ordered.select("source_path", "bytes", "marked").mapInArrow(run, "source_path string, content_sha256 string, size_bytes long")


# ---- records ---------------------------------------------------------------------------------------

def entry_states(ranges: DataFrame) -> DataFrame:
    """(source_path, block, seq, state): the state that each range is entered in. What is brought
    together for a file is a map of six numbers for each of its ranges."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [state_map(data.as_py()) for data in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(maps, pa.list_(pa.int8()))], ["source_path", "block", "seq", "map"])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, RECORD
        for batch in batches:
            states = []
            for source, moves in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if source != name:
                    name, state = source, RECORD
                states.append(state)
                state = moves[state]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(states, pa.int8())], ["source_path", "block", "seq", "state"])

    keys = "source_path string, block long, seq long"
    maps = ranges.select("source_path", "block", "seq", "bytes").mapInArrow(summed, f"{keys}, map array<tinyint>")
    return maps.repartition("source_path").sortWithinPartitions("source_path", "block", "seq").mapInArrow(composed, f"{keys}, state tinyint")


def record_rows(ranges: DataFrame) -> DataFrame:
    """(source_path, row_number, cells) of files given as ranges; the first record has number 0.

    A range's bytes up to its first record start go to the last range before it in which a record
    starts; every range then holds whole records and is parsed alone. Records are numbered from the
    counts of the ranges before. A file without bytes has no records.
    """
    key = ["source_path", "block", "seq"]
    states = materialise(entry_states(ranges), "csv-states")
    entered = ranges.select(*key, "bytes").join(states, key)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [*key, "head", "body", "starts"])
        rows, held = [], 0
        for batch in batches:
            for source, block, seq, data, state in _rows(batch):
                first, starts = cut(data, state)
                rows.append((source, block, seq, data[:first], data[first:], starts))
                held += len(data)
                if held >= _OUT:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    pieces = materialise(entered.select(*key, "bytes", "state").mapInArrow(split, "source_path string, block long, seq long, head binary, body binary, starts long"), "csv-pieces")
    # counts and owners of ranges: one narrow row for each
    in_order = Window.partitionBy("source_path").orderBy("block", "seq")
    own = F.when(F.col("starts") > 0, F.struct("block", "seq"))
    placed = pieces.select(*key, "starts").withColumns({
        "first_number": F.sum("starts").over(in_order) - F.col("starts"),
        "owner": F.last(own, ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)),
    })
    heads = pieces.where(F.octet_length("head") > 0).select(*key, "head").join(placed.select(*key, "owner"), key).where("owner IS NOT NULL")
    ends = heads.groupBy("source_path", F.col("owner.block").alias("block"), F.col("owner.seq").alias("seq")).agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("b"), F.col("seq").alias("s"), "head"))).alias("ends"))
    whole = pieces.where("starts > 0").select(*key, "body").join(placed.select(*key, "first_number"), key).join(ends, key, "left")
    joined = whole.select("source_path", "first_number", "body", F.transform("ends", lambda e: e["head"]).alias("ends"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        for batch in batches:
            for source, number, body, rest in _rows(batch):
                found = records(b"".join([body, *(rest or [])]))
                for k in range(0, len(found), 4096):
                    some = found[k : k + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([source] * len(some)), pa.array(range(number + k, number + k + len(some)), pa.int64()), pa.array(some, kind)], ["source_path", "row_number", "cells"])

    return joined.mapInArrow(parse, "source_path string, row_number long, cells array<string>")
