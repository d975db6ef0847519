"""Token counts by compiled finite-state transducers.

Two deterministic transducers stand for a byte-level BPE tokenizer:

* The scanner cuts text into words. It has twelve states over ten character classes; a transition
  tells whether a word begins at this character or at the one before. Text is cut into chunks of
  equal length wherever they fall; a chunk's state map (end state for each start state) is worked
  out for all chunks at once, the maps are composed by a parallel prefix scan, and a second pass
  from the then known states writes the word starts.
* The word transducer reads a word's bytes. A transition carries how many tokens it adds to (or,
  where a merge reaches back, takes from) the count. Its state is the longest suffix that some
  token begins with, and for each position in that suffix the last token there and the count
  relative to the end. The last token after a byte is the longest token ending there that is
  compatible with the last token before it: the pair must encode to itself. States and transitions
  are made when first needed and kept up to ``MOST_TRANSITIONS``.

A text's counts are put together from chunks of ``COUNT_CHUNK`` bytes cut wherever they fall, inside
words too. A chunk's map tells, for any state it is entered in, how many tokens it adds and the state it
is left in: a word start inside makes all but the bytes before it independent of the state entered in,
so these bytes, one count and one state are the map. Maps compose, and a prefix scan composes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boursecraft.llm import runs, vocabulary
from boursecraft.llm.bpe import SHORT, RankArrays, split_long
from boursecraft.llm.packing import blocks

CHUNK = 64
COUNT_CHUNK = 4096
MOST_TRANSITIONS = 600_000
#: Distinct words whose counts a worker remembers.
MEMO_ENTRIES = 500_000

_SCHEMA = "id long, n_bytes long, n_tokens long"

# Character classes. The letters apart are those of the contractions 's 't 'm 'd 're 've 'll.
LETTER, ONE, TWO, ELL, E, NUMBER, BLANK, SPACE, OTHER, QUOTE, END = range(11)
_CLASSES = 11
_HERE, _BEFORE = 1, 2  # a word starts at this character; at the one before


def scanner() -> tuple[np.ndarray, np.ndarray, int]:
    """(next state, output, start) by state * classes + class."""
    names = ["none", "letters", "numbers", "others", "blank", "space", "spaces_blank", "spaces", "quote", "quote_two", "quote_ell", "done"]
    at = {n: k for k, n in enumerate(names)}
    letters = {LETTER, ONE, TWO, ELL, E}
    first = {c: "letters" for c in letters} | {NUMBER: "numbers", OTHER: "others", QUOTE: "quote", BLANK: "blank", SPACE: "space"}
    joined = first | {QUOTE: "others"}  # behind a blank a quote only opens a run of other characters
    more_space = {BLANK: "spaces_blank", SPACE: "spaces"}

    def step(state: str, c: int) -> tuple[str, int]:
        if c == END:
            return "none", _HERE | (_BEFORE if state in ("quote_two", "quote_ell") else 0)
        fresh = (first[c], _HERE)
        if state == "letters" and c in letters or state == "numbers" and c == NUMBER or state == "others" and c in (OTHER, QUOTE):
            return state, 0
        if state in ("blank", "space", "spaces_blank", "spaces"):
            if c in more_space:
                return more_space[c], 0
            if state == "space":
                return fresh
            if state == "spaces":
                return first[c], _HERE | _BEFORE
            return joined[c], 0 if state == "blank" else _BEFORE
        if state == "quote":
            if c == ONE:
                return "done", 0
            if c in (TWO, ELL):
                return ("quote_two" if c == TWO else "quote_ell"), 0
            return ("others", 0) if c in (OTHER, QUOTE) else fresh
        if state in ("quote_two", "quote_ell"):
            if c == (E if state == "quote_two" else ELL):
                return "done", 0
            return ("letters", _BEFORE) if c in letters else (first[c], _HERE | _BEFORE)
        return fresh

    steps = [step(n, c) for n in names for c in range(_CLASSES)]
    return np.array([at[n] for n, _ in steps], np.uint8), np.array([o for _, o in steps], np.uint8), at["none"]


def character_classes() -> np.ndarray:
    """Class of every code point, and of one more that stands for an end."""
    every = "".join(map(chr, range(0x110000)))
    kind = np.full(0x110001, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for hit in regex.finditer(pattern, every):
            kind[hit.start() : hit.end()] = c
    kind[[*range(0x1C, 0x20)]] = OTHER
    for letters, c in (("stmd", ONE), ("rv", TWO), ("l", ELL), ("e", E), (" ", BLANK), ("'", QUOTE)):
        kind[[ord(x) for x in letters]] = c
    kind[0x110000] = END
    return kind


def chunk_maps(kind: np.ndarray, following: np.ndarray) -> np.ndarray:
    """End state of every chunk (a row of classes) for every start state."""
    states = len(following) // _CLASSES
    maps = np.tile(np.arange(states, dtype=np.uint8), (len(kind), 1))
    for t in range(kind.shape[1]):
        maps = following[maps.astype(np.intp) * _CLASSES + kind[:, t, None]]
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Row k becomes the composition of rows 0..k, in log2 rounds over all rows."""
    reach = 1
    while reach < len(maps):
        later = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), 1)
        maps = np.concatenate([maps[:reach], later])
        reach *= 2
    return maps


def word_starts(kind: np.ndarray, following: np.ndarray, output: np.ndarray, start: int) -> np.ndarray:
    """True where a word or an end begins, for a sequence of classes that ends with END."""
    n = len(kind)
    padded = np.full(-(-n // CHUNK) * CHUNK, END, np.uint8)
    padded[:n] = kind
    rows = padded.reshape(-1, CHUNK)
    upto = prefix_scan(chunk_maps(rows, following))
    state = np.append(np.uint8(start), upto[:-1, start]).astype(np.intp)
    said = np.empty(rows.shape, np.uint8)
    for t in range(CHUNK):
        key = state * _CLASSES + rows[:, t]
        said[:, t] = output[key]
        state = following[key].astype(np.intp)
    said = said.ravel()[:n]
    mark = (said & _HERE).astype(bool)
    mark[:-1] |= (said[1:] & _BEFORE).astype(bool)
    return mark


class WordTransducer:
    """Counts the tokens of words, byte by byte."""

    def __init__(self, ids: dict[bytes, int], merges: dict[bytes, tuple[int, int]]):
        self.merges, self.arrays = merges, RankArrays(ids, merges)
        words = [w for w in ids if 0 < len(w) <= SHORT]
        alone = [len(p) == 4 for p in self.arrays.parts(words)]  # tokens that encode to themselves
        long = [w for w in ids if len(w) > SHORT]
        alone += [len(split_long(w, merges)) == 2 for w in long]
        self.tokens = {w: ids[w] for w, own in zip([*words, *long], alone) if own}
        self.text = {i: w for w, i in self.tokens.items()}
        self.begins = {w[:k] for w in self.tokens for k in range(len(w) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        # a state: (suffix, ((last token or -1 at the word's start, count there less the count here), ...))
        self.states = {(b"", ((-1, 0),)): 0}
        self.signatures = [(b"", ((-1, 0),))]
        self.steps: list[dict[int, tuple[int, int]]] = [{}]
        self.made = 0

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            a, b = self.text[left], self.text[right]
            known = split_long(a + b, self.merges) == [0, len(a), len(a) + len(b)]
            if len(self.pairs) > MOST_TRANSITIONS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _make(self, state: int, byte: int) -> tuple[int, int]:
        suffix, window = self.signatures[state]
        read = suffix + bytes([byte])
        while read not in self.begins:
            read = read[1:]
        for size in range(len(read), 0, -1):
            token = self.tokens.get(read[-size:])
            if token is not None:
                before, less = window[-size]
                if before < 0 or self.compatible(before, token):
                    break
        added = less + 1
        kept = window[len(window) - len(read) :] if len(read) else ()
        signature = (read, (*((t, n - added) for t, n in kept), (token, 0)))
        found = self.states.get(signature)
        if found is None:
            found = self.states[signature] = len(self.signatures)
            self.signatures.append(signature)
            self.steps.append({})
        self.steps[state][byte] = (found, added)
        self.made += 1
        return found, added

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        """(state, tokens added) behind ``data``, entered in ``state``."""
        total = 0
        steps = self.steps
        for byte in data:
            step = steps[state].get(byte)
            if step is None:
                step = self._make(state, byte)
            state = step[0]
            total += step[1]
        return state, total

    def count(self, word: bytes) -> int:
        return self.run(0, word)[1]


class CountMap(NamedTuple):
    """What a chunk does to any state: ``head`` is read in the state entered in; behind it, unless the
    chunk has no word start (``passes``), ``added`` tokens follow and ``state`` is left."""

    head: bytes
    passes: bool
    added: int = 0
    state: int = 0

    def then(self, other: CountMap, words: WordTransducer) -> CountMap:
        """The map of this chunk and the one behind it."""
        if self.passes:
            return CountMap(self.head + other.head, other.passes, other.added, other.state)
        state, added = words.run(self.state, other.head)
        if other.passes:
            return CountMap(self.head, False, self.added + added, state)
        return CountMap(self.head, False, self.added + added + other.added, other.state)


def composed(maps: list[CountMap], words: WordTransducer) -> list[CountMap]:
    """Entry k becomes the composition of entries 0..k, in log2 rounds."""
    reach = 1
    while reach < len(maps):
        maps = [*maps[:reach], *(a.then(b, words) for a, b in zip(maps, maps[reach:]))]
        reach *= 2
    return maps


class Counter:
    """Counts the tokens of whole texts."""

    def __init__(self, tables: dict, chunk: int = COUNT_CHUNK):
        self.chunk, self.special, self.kind = chunk, tables["special"], tables["classes"]
        self.following, self.output, self.start = tables["scanner"]
        self.words = WordTransducer(tables["ids"], tables["merges"])
        self.memo: dict[bytes, int] = {}

    def _counts(self, words: list[bytes]) -> np.ndarray:
        memo, count = self.memo, self.words.count
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        if self.words.made > MOST_TRANSITIONS:
            self.words.reset()
        out = []
        for word in words:
            n = memo.get(word)
            if n is None:
                n = count(word)
                if len(word) <= runs.LONGEST:
                    memo[word] = n
            out.append(n)
        return np.array(out, np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        parts, sizes, owner = [], [], []
        special = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            for part, token in vocabulary.ordinary(text, self.special):
                if token >= 0:
                    special[k] += 1
                else:
                    parts.append(part)
                    sizes.append(len(part))
                    owner.append(k)
        if not parts:
            return special
        joined = "".join(parts)
        raw = joined.encode("utf-8", "surrogatepass")
        points = np.insert(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), np.cumsum(sizes), 0x110000)
        kind = self.kind[points]
        mark = np.flatnonzero(word_starts(kind, self.following, self.output, self.start))
        width = (1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)) * (kind != END)
        at = np.append(0, np.cumsum(width))[mark]
        real = np.flatnonzero(kind[mark] != END)
        begin, end = at[real], at[real + 1]
        part = np.searchsorted(np.flatnonzero(kind == END), mark[real])
        origin = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), np.array(sizes) + 1), width, len(sizes)).astype(np.int64)))
        # words inside one chunk count for it; those that run over its end are left to the chunk maps
        first_chunk, last_chunk = (begin - origin[part]) // self.chunk, (end - 1 - origin[part]) // self.chunk
        whole = np.flatnonzero(first_chunk == last_chunk)
        first, kinds = runs.distinct(raw, begin[whole], end[whole])
        starts, stops = begin[whole][first], end[whole][first]
        counts = self._counts([raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())])[kinds]
        total = np.bincount(part[whole], counts, len(sizes)).astype(np.int64)
        split = np.flatnonzero(first_chunk != last_chunk)
        of_split, at_whole, of_whole = part[split], part[whole], first_chunk[whole]
        for k in np.unique(of_split).tolist():  # words are in order of their parts
            mine = split[slice(*np.searchsorted(of_split, [k, k + 1]))]
            own = slice(*np.searchsorted(at_whole, [k, k + 1]))
            chunks = -(-int(origin[k + 1] - origin[k]) // self.chunk)
            added = np.bincount(of_whole[own], counts[own], chunks).astype(np.int64)
            spans = list(zip(begin[mine].tolist(), end[mine].tolist()))
            total[k] = self._chunked(raw, int(origin[k]), int(origin[k + 1]), added.tolist(), spans)
        return special + np.bincount(np.array(owner), total, len(texts)).astype(np.int64)

    def _chunked(self, raw: bytes, start: int, stop: int, added: list[int], spans: list[tuple[int, int]]) -> int:
        """Tokens of a text from the maps of its chunks; ``spans`` are the words that run over chunk ends."""
        maps, words = [], iter(spans)
        inside, ahead = None, next(words, None)
        for k, count in enumerate(added):
            low, high = start + k * self.chunk, min(start + (k + 1) * self.chunk, stop)
            head = b""
            if inside is not None:
                head = raw[low : min(inside[1], high)]
                if inside[1] > high:
                    maps.append(CountMap(head, True))
                    continue
                inside = None
            state = more = 0
            if ahead is not None and ahead[0] < high:
                inside, ahead = ahead, next(words, None)
                state, more = self.words.run(0, raw[inside[0] : high])
            maps.append(CountMap(head, False, count + more, state))
        return composed(maps, self.words)[-1].added


def compile_tables(path: str) -> dict:
    """What executors need: as large as the vocabulary file and the code points, whatever the data."""
    return vocabulary.load(path) | {"classes": character_classes(), "scanner": scanner()}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_bytes (UTF-8) and n_tokens. Null texts are empty: zeros.

    Special strings inside texts count as their one token. Other columns are ignored, whatever
    their names; repeated rows give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compile_tables(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        if "counter" not in tables:
            tables["counter"] = Counter(tables)
        for ids, texts in blocks(batches, 2 << 20):
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tables["counter"].count(texts))], ["id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, _SCHEMA).withColumnRenamed("id", id_col)
