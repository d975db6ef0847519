"""Sum-of-squares packing of documents into sequences of bounded length.

Every document is its ids and an end id. Documents beyond the capacity are cut into full pieces;
a full piece is a sequence of its own. The other pieces are placed, longest first, where the sum of
the squared counts of open sequences per residual gap becomes smallest; opening a sequence is one
of the choices. Only lengths take part: a shard is some ten thousand pieces dealt at random, and
the number of shards follows the number of pieces.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boursecraft.llm import runs
from boursecraft.session import materialise

#: Pieces that one task packs together.
SHARD_PIECES = 16384
#: Characters of text tokenised together, and distinct runs that a worker remembers.
BLOCK_CHARS = 8 << 20
MEMO_ENTRIES = 500_000

_PIECES = "id long, piece int, start long, length long, ids_crc32 long"

# Byte classes for cutting text where no token of a word-end vocabulary can span: white space,
# ASCII letters, other ASCII. Apostrophes and bytes of other characters are glued to both sides.
_SPACE, _LETTER, _OTHER, _GLUE = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[128:] = _GLUE
_CLASS[ord("'")] = _GLUE
_CLASS[[ord(c) for c in " \n\r\t"]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER


def word_runs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that can be tokenised on their own."""
    kind = np.zeros(len(raw) + 2, np.uint8)
    kind[1:-1] = _CLASS[np.frombuffer(raw, np.uint8)]
    here, before = kind[1:], kind[:-1]
    cut = here * before == _LETTER * _OTHER
    start = np.flatnonzero((here != _SPACE) & ((before == _SPACE) | cut))
    end = np.flatnonzero((before != _SPACE) & ((here == _SPACE) | cut))
    return start, end


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, which sees each distinct run of a block once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

        # runs of ASCII letters are one word in lower case: the model takes them without the library's
        # text steps, where a trial shows that these change nothing
        trial = ["a", "Hello", "WORLD", "tokenizers", "xqzvkjw", "don", "s", "abcdefghijklmnopqrstuvwxyz"]
        self.direct = all(self._model(w) == self.library.encode(w, add_special_tokens=False).ids for w in trial)
        self.bar = self.library.encode("|", add_special_tokens=False).ids
        # known runs in two generations: the older one is dropped as a whole, what was used since has moved on
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _model(self, word: str) -> list[int]:
        return [token.id for token in self.library.model.tokenize(word.lower())]

    def _library(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct runs. Runs of ASCII letters go to the model; others without a bar to the
        library, a hundred at a time with bars between them, whose id parts them again."""
        found = [b""] * len(words)
        tokenize, rest = self.library.model.tokenize, list(range(len(words)))
        if self.direct:
            rest = []
            for k, word in enumerate(words):
                if word.isascii() and word.isalpha() and len(word) <= runs.LONGEST:
                    found[k] = array("I", [token.id for token in tokenize(word.decode().lower())]).tobytes()
                else:
                    rest.append(k)
        alone = [k for k in rest if len(words[k]) > runs.LONGEST or b"|" in words[k] or len(self.bar) != 1]
        kept = set(alone)
        joined = [k for k in rest if k not in kept]
        texts = [words[k].decode("utf-8", "surrogatepass") for k in joined]
        lines = [" | ".join([*texts[i : i + 100], ""]) for i in range(0, len(texts), 100)]
        encoded = self.library.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in encoded]) if lines else np.zeros(0, "<u4")
        bars = np.flatnonzero(ids == self.bar[0]) if len(self.bar) == 1 else np.zeros(0, np.int64)
        flat, begin = ids.tobytes(), 0
        for k, bar in zip(joined, bars.tolist()):
            found[k] = flat[4 * begin : 4 * bar]
            begin = bar + 1
        for k, e in zip(alone, self.library.encode_batch_fast([words[k].decode("utf-8", "surrogatepass") for k in alone], add_special_tokens=False)):
            found[k] = np.array(e.ids, "<u4").tobytes()
        return found

    def _ask(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        known = list(map(self.memo.get, words))
        new = []
        for k, ids in enumerate(known):
            if ids is None:
                ids = self.older.get(words[k])
                if ids is None:
                    new.append(k)
                else:
                    known[k] = self.memo[words[k]] = ids
        if len(self.memo) > MEMO_ENTRIES // 2:
            self.memo, self.older = {}, self.memo
        for k, ids in zip(new, self._library([words[k] for k in new])):
            known[k] = ids
            if len(words[k]) <= runs.LONGEST:
                self.memo[words[k]] = ids
        size = np.array([len(ids) for ids in known], np.int64) // 4
        return np.frombuffer(b"".join(known), "<u4"), size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [not any(s in t for s in self.special) for t in texts]
        raw, ends, total = [], [], 0
        for text, usual in zip(texts, plain):
            raw.append(text.encode("utf-8", "surrogatepass") if usual else b"")
            total += len(raw[-1]) + 1
            ends.append(total)
        block = b"\n".join([*raw, b""])
        start, end = word_runs(block)
        if len(start):
            first, kinds = runs.distinct(block, start, end)
            flat, size = self._ask([block[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])
            ids = runs.spread(flat, size, kinds)
            upto = np.append(0, np.cumsum(size[kinds]))[np.searchsorted(start, ends)]
        else:
            ids, upto = np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        out = np.split(ids, upto[:-1]) if len(texts) else []
        for k, usual in enumerate(plain):
            if not usual:
                out[k] = np.array(self.library.encode(texts[k], add_special_tokens=False).ids, "<u4")
        return out


def blocks(batches: Iterator[pa.RecordBatch], chars: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(identifiers, texts) of about ``chars`` characters at most, a longer text alone."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and held + len(text) > chars:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(text)
            held += len(text)
    if ids:
        yield ids, texts


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and token_ids if ``with_ids``.

    Null texts are empty: a piece of the end id alone. Other columns are ignored, whatever their
    names; repeated rows give repeated pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"path": path})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "tokenizer" not in held:
            held["tokenizer"] = WordTokenizer(held["path"])
        last = np.array([end_id], "<u4").tobytes()
        for ids, texts in blocks(batches):
            rows: list[tuple] = []
            for i, found in zip(ids, held["tokenizer"].encode(texts)):
                raw = found.tobytes() + last
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    row = (i, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4")) if with_ids else row)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["id", "piece", "start", "length", "ids_crc32", "token_ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names[: len(rows[0])])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, _PIECES + (", token_ids array<int>" if with_ids else ""))


def sum_of_squares(lengths: list[int], capacity: int, sequences: list[list[int]] | None = None) -> list[list[int]]:
    """Sequences, as lists of the indices of lengths that they hold; all lengths are below the capacity.

    Lengths not yet in ``sequences`` are taken longest first. With N(g) open sequences of gap g, an
    item of length s changes the sum of N squared by 2(N(g-s) - N(g)) + 2 in a sequence of gap
    g > s, by 1 - 2N(s) in one it fills, and by 2N(capacity-s) + 1 in a new one; the least change
    wins, then the smallest gap.
    """
    sequences = [list(s) for s in sequences or []]
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    waiting = set(range(len(lengths)))
    for k, held in enumerate(sequences):
        gap = capacity - sum(lengths[i] for i in held)
        waiting.difference_update(held)
        if gap:
            count[gap] += 1
            open_at[gap].append(k)
    never = np.int64(1 << 40)
    for k in sorted(waiting, key=lambda i: (-lengths[i], i)):
        size = lengths[k]
        have = count[size:capacity]
        change = np.where(have > 0, 2 * (count[: capacity - size] - have) + 2, never)
        if count[size]:
            change[0] = 1 - 2 * count[size]
        best = int(change.argmin())
        if change[best] <= 2 * count[capacity - size] + 1:
            gap = best + size
            into = open_at[gap].pop()
            count[gap] -= 1
            sequences[into].append(k)
        else:
            gap, into = capacity, len(sequences)
            sequences.append([k])
        if gap > size:
            count[gap - size] += 1
            open_at[gap - size].append(into)
    return sequences


def packed(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sum-of-squares packing, then rounds in which the emptier half of the sequences that have a
    gap is emptied and placed again by the same rule, for as long as that saves a sequence."""
    best = sum_of_squares(lengths, capacity)
    while True:
        filled = [sum(lengths[i] for i in held) for held in best]
        order = sorted(range(len(best)), key=lambda k: filled[k])
        emptied = set(order[: max(2, sum(f < capacity for f in filled) // 2)])
        again = sum_of_squares(lengths, capacity, [held for k, held in enumerate(best) if k not in emptied])
        if len(again) >= len(best):
            return best
        best = again


def pack(parts: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``parts`` (with id, piece and length) and two columns more: sequence_id and offset.

    The rows are stored once, because they are counted before they are dealt. Ties in length are
    settled by id and piece; repeated rows are packed as often as they come. Empty input: no rows.
    """
    parts = materialise(parts, "pieces")
    shards = max(1, -(-parts.where(F.col("length") < capacity).count() // shard_pieces))
    # a stored row's place parts rows that repeat an identifier and text, or have none
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        lengths = group.column("length").to_pylist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for k, held in enumerate(packed(lengths, capacity)):
            at = 0
            for i in held:
                sequence[i], offset[i] = k, at
                at += lengths[i]
        shard = group.column("shard")[0].as_py()
        numbers = pa.array([shard << 40 | s for s in sequence], pa.int64())
        return group.drop_columns(["shard"]).append_column("sequence_id", numbers).append_column("offset", pa.array(offset, pa.int64()))

    open_parts = dealt.where(F.col("length") < capacity).groupBy("shard").applyInArrow(place, f"{fields}, sequence_id long, offset long")
    # a full piece needs no packing: its sequence number only has to be its own
    full = parts.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return open_parts.unionByName(full)
