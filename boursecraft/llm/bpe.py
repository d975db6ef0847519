"""BPE encoding and decoding with contiguous rank arrays.

A short word is one row of two arrays: its parts, and the ranks of adjacent parts. The smallest
rank is found by a scan, the boundary behind it is deleted, and the two neighbouring ranks are
refreshed, until no adjacent parts can merge. The words of a batch that are not in the memo are
worked on together, a row each. Words beyond ``SHORT`` bytes take the same merges from a heap,
because scans would be quadratic there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boursecraft.llm import vocabulary

SHORT = 96
#: Texts whose unknown words are worked on together.
BATCH = 512
_NONE = 1 << 30

_SCHEMA = "id long, token_ids array<int>, decoded string"
_DIGEST = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _rank(merges: dict, word: bytes, start: int, middle: int, end: int) -> int:
    hit = merges.get(word[start:end])
    return hit[1] if hit is not None and hit[0] == middle - start else _NONE


class RankArrays:
    """Merges of many short words at once."""

    def __init__(self, ids: dict[bytes, int], merges: dict[bytes, tuple[int, int]]):
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        keys, ranks, merged = [], [], []
        for token, (left, rank) in merges.items():
            keys.append(ids[token[:left]] << 32 | ids[token[left:]])
            ranks.append(rank)
            merged.append(ids[token])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(ranks, np.int64)[order], _NONE)
        self.merged = np.zeros(max(ranks, default=0) + 1, np.int64)
        self.merged[ranks] = merged
        pairs = self.byte_id[:, None] << 32 | self.byte_id[None, :]
        self.first = self._ranks(pairs.ravel())

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def parts(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word as 32-bit integers; no word is longer than ``SHORT`` bytes."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        start = int(np.searchsorted(sizes[order], 1))
        while start < len(order):
            width = int(sizes[order[start]])
            stop = int(np.searchsorted(sizes[order], max(8, width + width // 2), side="right"))
            stop = min(stop, start + 16384)
            self._group([words[i] for i in order[start:stop]], order[start:stop], out)
            start = stop
        return out

    def _group(self, words: list[bytes], rows: np.ndarray, out: list[bytes]) -> None:
        width = len(words[-1])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        column = np.arange(width)
        parts = self.byte_id[raw]
        ranks = np.full((len(words), width), _NONE, np.int64)  # the last column never holds a pair
        ranks[:, :-1] = np.where(column[None, 1:] < size[:, None], self.first[raw[:, :-1] << 8 | raw[:, 1:]], _NONE)
        while len(rows):
            at = ranks.argmin(1)
            each = np.arange(len(rows))
            low = ranks[each, at]
            done = low == _NONE
            if done.any():
                wide, ids = 4 * parts.shape[1], parts[done].astype("<i4").tobytes()
                for k, (row, n) in enumerate(zip(rows[done].tolist(), size[done].tolist())):
                    out[row] = ids[k * wide : k * wide + 4 * n]
                left = ~done
                rows, parts, ranks, size, at, low = rows[left], parts[left], ranks[left], size[left], at[left], low[left]
                if not len(rows):
                    break
                most = int(size.max())
                parts, ranks = parts[:, :most], ranks[:, :most]
                each = np.arange(len(rows))
            # delete the boundary behind part ``at``: later parts and ranks move up by one
            behind = np.arange(parts.shape[1])[None, :-1] > at[:, None]
            parts[:, :-1] = np.where(behind, parts[:, 1:], parts[:, :-1])
            ranks[:, :-1] = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            size -= 1
            parts[each, at] = self.merged[low]
            here = self._ranks(parts[each, at] << 32 | parts[each, np.minimum(at + 1, size - 1)])
            ranks[each, at] = np.where(at + 1 < size, here, _NONE)
            before = np.maximum(at - 1, 0)
            there = self._ranks(parts[each, before] << 32 | parts[each, at])
            ranks[each, before] = np.where(at > 0, there, ranks[each, before])


def split_long(word: bytes, merges: dict) -> list[int]:
    """The same boundaries in n log n: pending merges in a heap by rank, then position."""
    n = len(word)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    heap = []
    for i in range(n - 1):
        rank = _rank(merges, word, i, i + 1, i + 2)
        if rank != _NONE:
            heap.append((rank, i, i + 1, i + 2))
    heapify(heap)
    alive = [True] * n + [True]
    while heap:
        _, start, middle, end = heappop(heap)
        if not (alive[start] and alive[middle] and after[start] == middle and after[middle] == end):
            continue
        alive[middle] = False
        after[start] = end
        if end <= n:
            before[end] = start
        if start > 0:
            left = before[start]
            rank = _rank(merges, word, left, start, end)
            if rank != _NONE:
                heappush(heap, (rank, left, start, end))
        if end < n:
            rank = _rank(merges, word, start, end, after[end])
            if rank != _NONE:
                heappush(heap, (rank, start, end, after[end]))
    bounds, at = [0], 0
    while at < n:
        at = after[at]
        bounds.append(at)
    return bounds


class ByteTable:
    """Byte strings by number, written out for whole arrays of numbers at once."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.append(0, np.cumsum(self.size))[:-1]
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def join(self, numbers: np.ndarray) -> bytes:
        size = self.size[numbers]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        index = np.repeat(self.start[numbers] - ends + size, size)
        index += np.arange(len(index))
        return self.flat[index].tobytes()


class Codec:
    """Encodes and decodes whole texts with the tables of a vocabulary file."""

    def __init__(self, tables: dict):
        self.ids, self.merges, self.special, self.memo = (tables[k] for k in ("ids", "merges", "special", "memo"))
        if "bytes" not in tables:
            known = [*self.ids.items(), *((s.encode(), i) for s, i in self.special.items())]
            entries = [b""] * (max((i for _, i in known), default=-1) + 1)
            for token, i in known:
                entries[i] = token
            tables["bytes"] = ByteTable(entries)
            tables["numerals"] = ByteTable([b"%d," % i for i in range(len(entries))])
            tables["arrays"] = RankArrays(self.ids, self.merges)
        self.bytes, self.numerals, self.arrays = tables["bytes"], tables["numerals"], tables["arrays"]
        self.words = regex.compile(vocabulary.PATTERN)

    def _words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        found = self.arrays.parts([w if len(w) <= SHORT else b"" for w in raw])
        for k, word in enumerate(raw):
            if len(word) > SHORT:
                bounds = split_long(word, self.merges)
                found[k] = np.array([self.ids[word[a:b]] for a, b in zip(bounds, bounds[1:])], "<i4").tobytes()
        return found

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        memo = self.memo
        split = {p: self.words.findall(p) for p in pieces}
        unknown = [w for w in {w for words in split.values() for w in words} if w not in memo]
        fresh = dict(zip(unknown, self._words(unknown)))
        for piece, words in split.items():
            if piece not in fresh:
                fresh[piece] = b"".join([fresh[w] if w in fresh else memo[w] for w in words])
        memo.update((p, ids) for p, ids in fresh.items() if len(p) <= SHORT)
        return fresh

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; special strings in them become their ids, as the library does."""
        if len(self.memo) > vocabulary.MEMO_ENTRIES:
            self.memo.clear()
        known, rows, missing = self.memo.get, [], {}
        for text in texts:
            cut, got = [], []
            for part, special in vocabulary.ordinary(text, self.special):
                some = [part] if special >= 0 else vocabulary.pieces(part)
                cut += some
                got += [special.to_bytes(4, "little")] if special >= 0 else map(known, some)
            rows.append((cut, got))
            if None in got:
                missing.update((p, None) for p, ids in zip(cut, got) if ids is None)
        fresh = self._pieces(list(missing)) if missing else {}
        out = []
        for cut, got in rows:
            if None in got:
                got = [fresh[p] if ids is None else ids for p, ids in zip(cut, got)]
            out.append(np.frombuffer(b"".join(got), "<i4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes.join(ids).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self.numerals.join(ids)[:-1]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, token_ids, decoded. Null texts are empty and have no tokens.

    Other columns of the input are ignored, whatever their names. Ids come from the vocabulary file
    alone, so repeated rows give repeated results.
    """
    tables = docs.sparkSession.sparkContext.broadcast(vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables.value)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                ids = codec.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(codec.decode, ids), pa.string())], ["id", "token_ids", "decoded"])

    return _texts(docs, id_col, text_col).mapInArrow(run, _SCHEMA).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same encoding and decoding, reduced to n_tokens and digests before it leaves Python."""
    tables = docs.sparkSession.sparkContext.broadcast(vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables.value)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                rows = []
                for i, ids in zip(part.column(0).to_pylist(), codec.encode(part.column(1).to_pylist())):
                    rows.append((i, len(ids), hashlib.sha256(codec.listed(ids)).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, _DIGEST).withColumnRenamed("id", id_col)
