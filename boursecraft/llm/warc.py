"""Deterministic sharded WARC writer, and its reader.

Records are range-sorted by identifier and payload digest and cut into shards by the bytes before
them, so boundaries depend on the rows alone. A shard is written by one task as a sequence of files
that roll over by compressed size; every record is a gzip member of its own, its headers and digests
are made from the payload. A file is written under a temporary name and renamed; a shard's manifest
(names, sizes, digests, record counts) follows and the data set's comes last, the same way: a repeated
or doubled task replaces files by equal ones, and what no manifest names is never read.

Folders are given as URIs; files go through the file system that the URI names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boursecraft.session import materialise, tables_dir

#: Bytes of payload of a shard where the caller names none: an eight thousandth of all, within these bounds.
LEAST_SHARD_BYTES, MOST_SHARD_BYTES, SHARDS = 16 << 20, 1 << 30, 8192
#: Bytes of compressed records after which a file is closed.
FILE_BYTES = 4 << 20
#: Tasks that read archives back, at most.
READERS = 4096

_DATE = "1970-01-01T00:00:00Z"  # the tables have no time of capture; a clock would not be deterministic
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_FILES = "shard int, files array<struct<name: string, records: long, bytes: long, sha256: string>>"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(number: int | None, digest: str, place: str = "") -> str:
    """Identifier and payload name a record; copies of one have their place behind."""
    return f"<urn:page:{'none' if number is None else number}:{digest}{':' if place else ''}{place}>"


def record(number: int | None, url: str | None, payload: bytes, refers_to: int | None, place: str = "") -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header of its payload and no body, and names the record
    of the same payload that it refers to."""
    digest = _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c for c in (url or "") if c not in "\r\n")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(number, digest, place)}",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_digest(block)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member without name or time, so equal data gives equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _commit(files: fs.FileSystem, path: str, data: bytes) -> None:
    """Write under a name of its own, then rename: readers see a whole file or none."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(temporary) as out:
        out.write(data)
    files.move(temporary, path)


class ShardWriter:
    """Files of one shard: part-<shard>-<file>.warc.gz and, last, its manifest."""

    def __init__(self, uri: str, shard: int, file_bytes: int):
        self.files, self.folder = fs.FileSystem.from_uri(uri)
        self.shard, self.limit = shard, file_bytes
        self.files.create_dir(self.folder, recursive=True)
        self.held, self.records, self.size, self.manifest = [], 0, 0, []

    def add(self, data: bytes) -> None:
        member = _member(data)
        if self.size and self.size + len(member) > self.limit:
            self.roll()
        self.held.append(member)
        self.size += len(member)
        self.records += 1

    def roll(self) -> None:
        if not self.held:
            return
        data = b"".join(self.held)
        name = f"part-{self.shard:06d}-{len(self.manifest):04d}.warc.gz"
        _commit(self.files, f"{self.folder}/{name}", data)
        self.manifest.append({"name": name, "records": self.records, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
        self.held, self.records, self.size = [], 0, 0

    def close(self) -> list[dict]:
        self.roll()
        _commit(self.files, f"{self.folder}/manifest-{self.shard:06d}.json", json.dumps({"shard": self.shard, "files": self.manifest}).encode())
        return self.manifest


def _key(number: Column, content: Column) -> Column:
    """Sorts as (identifier, null first, and content), bytewise."""
    return F.concat(F.coalesce(F.concat(F.lit("1"), F.lpad(F.hex(number.bitwiseXOR(-(1 << 63))), 16, "0")), F.lit("0").cast("string")), content)


def boundaries(rows: DataFrame, target: int | None = None) -> tuple[list[str], list[int], int]:
    """(keys, shard of each, shards) from (key, n_bytes): where shards of about ``target`` bytes begin.

    Keys are range-sorted with their bytes; a row's shard is the number of whole targets among the bytes
    before its key. A key of more bytes than a target spans several shards. The driver gets one key for
    each shard that begins with one.
    """
    keys = rows.groupBy("key").agg(F.sum("n_bytes").alias("n"))
    ranged = materialise(keys.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "warc-keys")
    sums = ranged.groupBy("part").agg(F.sum("n").alias("m"))
    before = sums.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))  # a row for each range
    total = ranged.agg(F.sum("n")).first()[0]
    if total is None:
        return [], [], 0
    target = target or min(MOST_SHARD_BYTES, max(LEAST_SHARD_BYTES, total // SHARDS))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("key"))
    placed = ranged.withColumn("upto", upto).join(before, "part").select("key", ((F.col("before") + F.col("upto") - F.col("n")) / target).cast("long").alias("shard"))
    first = placed.groupBy("shard").agg(F.min("key").alias("key")).orderBy("shard").collect()
    return [r["key"] for r in first], [r["shard"] for r in first], int(-(-total // target)) or 1


def _revisits(rows: DataFrame, least: int) -> DataFrame:
    """key, id, content, refers_to of the rows whose payload a smaller identifier has: narrow, without payloads."""
    narrow = rows.where("id IS NOT NULL").select("key", "id", "n_bytes", "content").where(F.col("n_bytes") >= least)
    first = narrow.groupBy("content", "n_bytes").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return narrow.join(first, ["content", "n_bytes"]).where("refers_to < id").select("key", "id", "content", "refers_to").distinct()


def write(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 0, shard_bytes: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for every row under ``uri``.

    Of rows with equal payloads of at least ``revisit_from`` bytes the smallest identifier is the
    response and the others revisit it. Null payloads are empty, null URLs are an empty target. Rows
    that repeat an identifier are records of their own, in order of payload digest and URL; so are rows
    without one, which come first and are responses. Copies of one identifier and payload that fill more
    than a shard are dealt over as many shards as they fill.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"content": F.substring(F.sha2("payload", 256), 1, 32), "n_bytes": F.octet_length("payload").cast("long")}).withColumn("key", _key(F.col("id"), F.col("content")))
    narrow = materialise(rows.select("key", "id", "content", "n_bytes"), "page-keys")
    keys, shards, total = boundaries(narrow, shard_bytes)
    places = spark.sparkContext.broadcast((keys, shards, total))  # a key for each shard

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and last shard of each key."""
        edges, numbers, total = np.array(places.value[0], "S49"), np.array([*places.value[1], places.value[2]], np.int64), places.value[2]
        for batch in batches:
            asked = np.array(batch.column(0).to_pylist(), "S49")
            at = np.searchsorted(edges, asked, side="right") - 1
            low = numbers[np.maximum(at, 0)]
            whole = edges[np.maximum(at, 0)] == asked  # a key that begins a shard may go on until the next one that does
            high = np.where(whole, np.minimum(numbers[np.minimum(at + 1, len(edges))], total) - 1, low)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low), pa.array(np.maximum(high, low))], [*batch.schema.names, "low", "high"])

    # payloads are shuffled once; what a row revisits arrives in its shards as a row before it
    none = lambda kind: F.lit(None).cast(kind)
    marks = _revisits(narrow, revisit_from).select("key", "id", none("string").alias("url"), none("binary").alias("payload"), "content", "refers_to")
    both = rows.select("key", "id", "url", "payload", "content", none("long").alias("refers_to")).unionByName(marks)
    placed = both.mapInArrow(shard_of, "key string, id long, url string, payload binary, content string, refers_to long, low long, high long")
    copy = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("high") - F.col("low") + 1) + F.col("low")
    dealt = placed.withColumn("shard", F.explode(F.when(F.col("payload").isNull(), F.sequence("low", "high")).otherwise(F.array(copy))))
    ordered = dealt.repartitionById(max(1, total), F.col("shard").cast("int")).sortWithinPartitions("shard", "key", F.col("payload").isNotNull(), "url").select("id", "url", "payload", "content", "refers_to", "low", "shard")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, place, mark, last = None, 0, None, None

        def closed() -> pa.RecordBatch:
            files = writer.close()
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in (len(files), sum(f["records"] for f in files))], ["files", "records"])

        for batch in batches:
            for number, url, payload, content, refers_to, low, shard in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None or writer.shard != shard:
                    if writer is not None:
                        yield closed()
                    writer, place, mark, last = ShardWriter(uri, shard, file_bytes), 0, None, None
                if payload is None:
                    mark = (number, content, refers_to)
                    continue
                refers = mark[2] if mark is not None and mark[:2] == (number, content) else None
                # the first record of a key has its plain name, further ones their shard and place
                plain = (number, content) != last and low == shard
                writer.add(record(number, url, payload, refers, "" if plain else f"{shard}-{place}"))
                last = (number, content)
                place += 1
        if writer is not None:
            yield closed()

    done = ordered.mapInArrow(put, "files long, records long").agg(F.count("*").alias("shards"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "records")]).first()
    files, folder = fs.FileSystem.from_uri(uri)
    files.create_dir(folder, recursive=True)
    _commit(files, f"{folder}/dataset.json", json.dumps(done.asDict()).encode())


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    """One row per file of the data set: shard, path, records, bytes, sha256, as its manifests name them."""
    files, folder = fs.FileSystem.from_uri(uri)
    with files.open_input_stream(f"{folder}/dataset.json") as source:
        total = json.loads(source.read())
    if not total["shards"]:
        return spark.createDataFrame([], "shard int, path string, records long, bytes long, sha256 string")
    named = spark.read.schema(_FILES).json(f"{uri}/manifest-*.json").select("shard", F.explode("files").alias("f"))
    found = named.agg(F.count_distinct("shard").alias("shards"), F.count("*").alias("files"), F.sum("f.records").alias("records")).first()
    if found.asDict() != total:
        raise ValueError(f"{uri}: the manifests {found.asDict()} do not add up to {total}")
    return named.select("shard", F.concat(F.lit(f"{uri}/"), "f.name").alias("path"), "f.records", "f.bytes", "f.sha256")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record must begin with its version")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if f"sha1:{_digest(block)}" != headers["warc-block-digest"]:
            raise ValueError(f"block digest of {headers['warc-record-id']} is wrong")
        yield headers, block


def _number(record_id: str) -> int | None:
    value = record_id.removeprefix("<urn:page:").split(":")[0]
    return None if value == "none" else int(value)


def read(spark: SparkSession, uri: str) -> DataFrame:
    """A row per record of the data set; a response has its payload, a revisit has null.

    Sizes and digests of files, blocks and payloads are checked; a task holds one file, which
    ``file_bytes`` bounds unless one record is larger.
    """

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for path, size, sha in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("path", "bytes", "sha256"))):
                files, place = fs.FileSystem.from_uri(path)
                with files.open_input_stream(place, compression=None) as source:
                    data = source.read()
                if len(data) != size or hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{path} is not the file of its manifest")
                rows, held = [], 0
                for headers, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)))):
                    head, _, body = block.partition(b"\r\n\r\n")
                    length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    response = headers["warc-type"] == "response"
                    if response and (len(body) != length or _digest(body) != digest):
                        raise ValueError(f"payload of {headers['warc-record-id']} is wrong")
                    rows.append((_number(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-type"], None if response else _number(headers["warc-refers-to"]), length, digest, body if response else None))
                    held += len(body)
                    if held > 8 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    named = manifest(spark, uri)
    tasks = max(1, min(READERS, named.count()))
    return named.repartition(tasks).mapInArrow(get, _READ)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def new_folder(spark: SparkSession) -> str:
    """A folder for archives in the place that all executors share; removed when the application ends."""
    base = tables_dir(spark)
    return f"{base if ':' in base else 'file://' + base}/warc-{uuid.uuid4().hex}"
