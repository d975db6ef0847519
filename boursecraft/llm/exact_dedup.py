"""Exact duplicates by Patricia tries.

Texts are split over partitions by byte length and content hash. Each partition inserts the full
byte strings into a compressed radix trie, so equality is decided on bytes and never on a hash.
A terminal node stores the identifier that owns the text and how many rows had it. A trie that
outgrows its memory spills its heaviest subtree to a file in the shared folder, which is turned into a
trie of its own afterwards. Before the shuffle every task folds its own copies in a local trie, so a
text that a third of the rows share leaves each task once.
"""

from __future__ import annotations

import hashlib
import io
import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boursecraft.session import tables_dir

#: Bytes of text that a trie holds before a subtree is spilled, and that a map task folds at once.
TRIE_BYTES = 96 << 20
FOLD_BYTES = 24 << 20

_KEYS = "id long, text_sha256 string"
_OWNERS = "n_bytes long, text_sha256 string, body binary, owner long, copies long"
_OWNED = "text_sha256 string, owner long, copies long"


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: each comparison is one memory compare."""
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while low < high - 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Spill:
    """A subtree's texts one after another: in a file under ``folder`` (a URI), in memory without one."""

    def __init__(self, folder: str | None):
        self.place = None
        if folder is None:
            self.out = io.BytesIO()
            return
        self.files, base = fs.FileSystem.from_uri(folder)
        self.files.create_dir(base, recursive=True)
        self.place = f"{base}/{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.place, buffer_size=1 << 20)

    def add(self, *row) -> None:
        self.out.write(pickle.dumps(row))

    def rows(self) -> Iterator[tuple]:
        """All rows; afterwards nothing more can be added."""
        if self.place is not None and not self.out.closed:
            self.out.close()
        source = io.BytesIO(self.out.getvalue()) if self.place is None else io.BufferedReader(self.files.open_input_stream(self.place), 1 << 20)
        with source:
            while True:
                try:
                    yield pickle.load(source)
                except EOFError:
                    return

    def delete(self) -> None:
        if self.place is not None:
            self.files.delete_file(self.place)


class PatriciaTrie:
    """Byte strings to [owner, copies, tag]; the owner is the best identifier seen.

    A node is [edges, terminal]; edges map a first byte to (label, node). ``better`` picks of two
    identifiers, null last. Subtrees below a root edge are spilled when labels exceed ``limit``, to
    files under ``folder``.
    """

    def __init__(self, better=min, limit: int = TRIE_BYTES, folder: str | None = None):
        self.better, self.limit, self.folder = better, limit, folder
        self.root: list = [{}, None]
        self.held: dict[int, int] = {}  # label bytes below each edge of the root
        self.total = 0
        self.spilled: dict[int, Spill] = {}

    def insert(self, key: bytes, owner: int | None, copies: int, tag: str) -> None:
        first = key[0] if key else -1
        if first in self.spilled:
            self.spilled[first].add(key, owner, copies, tag)
            return
        added = self._insert(key, owner, copies, tag)
        self.held[first] = self.held.get(first, 0) + added
        self.total += added
        if self.total > self.limit and len(key) > 0:
            self._spill()

    def _insert(self, key: bytes, owner: int | None, copies: int, tag: str) -> int:
        node, at = self.root, 0
        while at < len(key):
            edge = node[0].get(key[at])
            if edge is None:
                node[0][key[at]] = (key[at:], [{}, [owner, copies, tag]])
                return len(key) - at + 64
            label, child = edge
            rest = key[at : at + len(label)]
            n = _common(label, rest)
            if n < len(label):
                middle = [{label[n]: (label[n:], child)}, None]
                node[0][key[at]] = (label[:n], middle)
                child = middle
            node, at = child, at + n
        if node[1] is None:
            node[1] = [owner, copies, tag]
            return 64
        best = node[1]
        if owner is not None:
            best[0] = owner if best[0] is None else self.better(best[0], owner)
        best[1] += copies
        return 0

    def _spill(self) -> None:
        first = max((k for k in self.held if k >= 0 and k not in self.spilled), key=self.held.get)
        out = self.spilled[first] = Spill(self.folder)
        label, child = self.root[0].pop(first)
        for key, terminal in self._walk(label, child):
            out.add(key, *terminal)
        self.total -= self.held.pop(first)

    def _walk(self, prefix: bytes, node: list) -> Iterator[tuple[bytes, list]]:
        stack = [(prefix, node)]
        while stack:
            path, (edges, terminal) = stack.pop()
            if terminal is not None:
                yield path, terminal
            stack.extend((path + label, child) for label, child in edges.values())

    def items(self) -> Iterator[tuple[bytes, list]]:
        """Every text with its terminal; spilled subtrees one after another, below what their texts share."""
        yield from self._walk(b"", self.root)
        self.root, self.held = [{}, None], {}
        for file in self.spilled.values():
            shared = None
            for key, *_ in file.rows():
                shared = key if shared is None else shared[: _common(shared, key)]
            below = PatriciaTrie(self.better, self.limit, self.folder)
            for key, *row in file.rows():
                below.insert(key[len(shared) :], *row)
            file.delete()
            for key, terminal in below.items():
                yield shared + key, terminal
        self.spilled = {}


def _batches(rows: list[tuple], names: list[str], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    types = {"body": pa.binary(), "text_sha256": pa.string()}
    for start in range(0, len(rows), 4096):
        part = rows[start : start + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for n, c in zip(names, zip(*part))], names)


def _folded(text: str | None) -> bytes:
    """UTF-8 with A-Z lowered and nothing else; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256(_folded(t)).hexdigest() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], ["id", "text_sha256"])


def _local_owners(better):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "text_sha256", "body", "owner", "copies"]

        def flush(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
            rows, held = [], 0
            for body, (owner, copies, tag) in trie.items():
                rows.append((len(body), tag, body, owner, copies))
                held += len(body)
                if held > 4 << 20:
                    yield from _batches(rows, names)
                    rows, held = [], 0
            yield from _batches(rows, names)

        trie, seen = PatriciaTrie(better), 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = _folded(text)
                trie.insert(body, i, 1, hashlib.sha256(body).hexdigest())
                seen += len(body)
                if seen > FOLD_BYTES:
                    yield from flush(trie)
                    trie, seen = PatriciaTrie(better), 0
        yield from flush(trie)

    return fold


def _owners(better, limit: int, folder: str):
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(better, limit, folder)
        for batch in batches:
            for _, tag, body, owner, copies in zip(*(c.to_pylist() for c in batch.columns)):
                trie.insert(body, owner, copies, tag)
        rows = []
        for _, (owner, copies, tag) in trie.items():
            rows.append((tag, owner, copies))
            if len(rows) == 4096:
                yield from _batches(rows, ["text_sha256", "owner", "copies"])
                rows = []
        yield from _batches(rows, ["text_sha256", "owner", "copies"])

    return own


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: text_sha256, owner (the identifier that stays), copies.

    ``keep`` is smallest or largest. Null texts count as empty; null identifiers never own a text
    that another row has, and own it (owner null) where all are null. Empty input: no rows.
    """
    better = {"smallest": min, "largest": max}[keep]
    base = tables_dir(docs.sparkSession)
    folder = f"{base if ':' in base else 'file://' + base}/tries-{uuid.uuid4().hex}"
    local = _texts(docs, id_col, text_col).mapInArrow(_local_owners(better), _OWNERS)
    return local.repartition(F.col("n_bytes"), F.col("text_sha256")).mapInArrow(_owners(better, trie_bytes, folder), _OWNED)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: ``id``, keep_id, group_size, kept, text_sha256.

    The digest column only carries a document to the owner that the tries found. Rows that repeat
    the owner's identifier and text are that same document: all of them are marked kept. Columns
    of the input other than the two named ones are ignored, whatever their names.
    """
    keys = _texts(docs, id_col, text_col).mapInArrow(_keys, _KEYS)
    found = owners(docs, id_col, text_col, keep, trie_bytes)
    return keys.join(found, "text_sha256").select(
        F.col("id").alias(id_col),
        F.col("owner").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("id").eqNullSafe(F.col("owner")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents that own their text, with all their columns. Rows without an identifier stay
    only where no row with one has their text; an identifier that stays keeps every row it is on."""
    kept: Column = F.col("kept")
    ids = assign(docs, id_col, text_col, keep).where(kept).select(F.col(id_col).alias("owner")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"))  # whatever the columns are named
    return rows.join(ids, F.col("id").eqNullSafe(F.col("owner")), "left_semi").select("row.*")
