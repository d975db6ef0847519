"""Toxicity by a weighted lexicon.

Texts are folded (compatibility forms, diacritics, look-alike letters of other scripts, digits and
signs that stand for letters) and cut into words. An Aho-Corasick automaton finds the lexicon's
words, and its stems at word starts. A hit inside an exception phrase doesn't count. The weights of
the hits, in all and for each word of the text, give a score between 0 and 1.

Lexicon, exception phrases and the two score coefficients are trained on labelled documents: at
most ``SAMPLE`` of each label, those with the smallest hashes of their identifier, one text of each.
A word that clean texts have too, but mostly inside one phrase, gets that phrase as an exception
first and is weighed by what it does elsewhere.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boursecraft.session import materialise

#: Bound of training: documents of each label.
SAMPLE = 6000
#: A phrase that holds this share of a word's clean documents is an exception before words are weighed.
PHRASE_SHARE = 0.25
#: An entry is in this share of the toxic sample and in five documents at least; there are at most a
#: hundred times as many as a toxic document has features.
LEAST_SHARE = 0.01
LEAST_DOCUMENTS = 5
LEAST_WEIGHT = math.log(20)
STEMS = (4, 5, 6)

# Letters of other scripts that look like Latin ones, and signs that replace letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ⅼ": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l",
}
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}

_FOLD = {ord(k): v for k, v in (LOOK_ALIKES | DIGITS).items()} | {ord("l"): "i"} | {c: None for c in range(0x300, 0x370)} | {0xAD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None, 0xFEFF: None}
_SIGN = re.compile(r"(?<=\w)[@$!|€]+(?=\w)")
_WORD = re.compile(r"\w+")

_SCORES = "id long, score double, hits long, words long"


def fold(text: str) -> list[str]:
    """Folded words. l, i and 1 fold to one letter, as do a digit and the letter it stands for."""
    text = unicodedata.normalize("NFKD", text).lower()
    if not text.isascii() or any(c in text for c in "@$!|"):
        text = _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    return _WORD.findall(text.translate(_FOLD))


@dataclass
class Lexicon:
    """Folded entries and their weights: whole words as they are, stems with a star behind."""

    weights: dict[str, float]
    exceptions: set[tuple[str, str]] = field(default_factory=set)
    coefficients: tuple[float, float, float] = (-3.0, 0.5, 0.5)

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """A lexicon's automaton, built where it is used."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            key = f" {entry[:-1]}" if entry.endswith("*") else f" {entry} "
            self.automaton.add_word(key, (len(key), weight, entry))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, words: list[str]) -> dict[int, float]:
        """Weight of the best entry at each matched word, by the word's place."""
        if not words or not len(self.automaton):
            return {}
        line = f" {' '.join(words)} "
        best: dict[int, float] = {}
        for end, (size, weight, _) in self.automaton.iter(line):
            start = end - size + 1
            best[start] = max(best.get(start, weight), weight)
        if not best:
            return {}
        found, at, place = {}, 0, 0
        for start in sorted(best):
            place += line.count(" ", at, start)
            at = start
            found[place] = best[start]
        return found

    def entries(self, words: list[str]) -> set[str]:
        """All entries that match somewhere."""
        if not words or not len(self.automaton):
            return set()
        return {entry for _, (_, _, entry) in self.automaton.iter(f" {' '.join(words)} ")}

    def measure(self, text: str) -> tuple[float, int, int]:
        """(sum of weights outside exception phrases, hits, words)."""
        words = fold(text)
        found = self.hits(words)
        if found and self.lexicon.exceptions:
            found = {k: w for k, w in found.items() if not any(p in self.lexicon.exceptions for p in phrases(words, k))}
        return sum(found.values()), len(found), len(words)

    def score(self, total: float, words: int) -> float:
        a, b, c = self.lexicon.coefficients
        x = a + b * math.log1p(total) + c * density(total, words)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def density(total: float, words: int) -> float:
    """Weight for each thousand words, on a log scale."""
    return math.log1p(1000 * total / max(words, 20))


def phrases(words: list[str], k: int) -> list[tuple[str, str]]:
    """The pairs of adjacent words that the word at k is in."""
    return [tuple(words[j : j + 2]) for j in (k - 1, k) if 0 <= j < len(words) - 1]


def _count_rows(counts: Counter, names: list[str]) -> Iterator[pa.RecordBatch]:
    rows = list(counts.items())
    for k in range(0, len(rows), 1 << 16):
        part = rows[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in part]), pa.array([r[0][1] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int64())], names)


def _features(words: list[str], exceptions: set[tuple[str, str]]) -> set[str]:
    """Words outside exception phrases, and their stems."""
    if exceptions:
        held = {w for p in exceptions for w in p}
        words = [w for k, w in enumerate(words) if w not in held or not any(p in exceptions for p in phrases(words, k))]
    kinds = set(words)
    return kinds | {f"{w[:n]}*" for w in kinds for n in STEMS if len(w) > n}


def _by_label(rows: DataFrame, features: Callable[[str], set[str]]) -> DataFrame:
    """(feature, t, c): in how many toxic and clean documents each feature is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((f, label) for f in features(text))
                if len(counts) > 1_000_000:
                    yield from _count_rows(counts, ["feature", "label", "n"])
                    counts = Counter()
        yield from _count_rows(counts, ["feature", "label", "n"])

    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    return rows.mapInArrow(count, "feature string, label int, n long").groupBy("feature").agg(of(1).alias("t"), of(0).alias("c"))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text and label of at most ``size`` documents of either label, stored once. Of rows that share
    an identifier one takes part, the one whose text has the smallest hash."""
    rows = labels.where(F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    chosen = [rows.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(size) for v in (0, 1)]
    both = chosen[0].unionByName(chosen[1])  # twice ``size`` rows at most
    held = docs.select("id", "text").join(F.broadcast(both), "id")
    one = held.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return materialise(one.select("text", "label"), "labelled")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", size: int = SAMPLE) -> Lexicon:
    """Fit a lexicon on the labelled rows given; null labels and null identifiers are left out.

    Without a toxic and a clean document the lexicon is empty and every score is low.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = sample(texts, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")), size)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({})
    t, c = F.col("t"), F.col("c")
    weight = F.log((t + 0.5) / (toxic - t + 0.5)) - F.log((c + 0.5) / (clean - c + 0.5))

    def weighed(exceptions: set[tuple[str, str]]) -> DataFrame:
        counted = _by_label(rows, lambda text: _features(fold(text), exceptions))
        return counted.withColumn("w", weight).where((t >= max(LEAST_DOCUMENTS, LEAST_SHARE * toxic)) & (F.col("w") > 0))

    first = weighed(set()).collect()
    early = _early_exceptions(rows, {r["feature"]: r["c"] for r in first if r["w"] < LEAST_WEIGHT and not r["feature"].endswith("*")})
    # words apart from their exceptions; the others keep their weights
    found = {r["feature"]: r["w"] for r in (weighed(early).collect() if early else first) if r["w"] >= LEAST_WEIGHT}
    stems = {f[:-1]: w for f, w in found.items() if f.endswith("*")}
    # an entry that a shorter stem covers as well is not needed
    kept = {f: w for f, w in found.items() if not any(stems.get(f.rstrip("*")[:n], 0) >= w - 0.5 for n in range(1, len(f.rstrip("*"))))}
    lexicon = Lexicon({f: w for f, w in kept.items() if not (f + "*" in kept and kept[f + "*"] >= w - 0.5)})
    lexicon = _cover(rows, lexicon, max(2, LEAST_SHARE * toxic / 2))
    matcher = lexicon.matcher()
    lexicon.exceptions = {p for p in early if matcher.hits([*p])} | _learn_exceptions(rows, lexicon)
    lexicon.coefficients = _learn_coefficients(rows, lexicon)
    return lexicon


def _cover(rows: DataFrame, lexicon: Lexicon, least: float) -> Lexicon:
    """The entries that toxic documents need: the next one taken is in most of the documents that
    fewer than two entries explain so far, until it would explain too few. Words that only share
    documents with others, as those of a text with many near copies do, are left out.

    The driver gets the entries of each toxic document of the sample, and nothing of the others.
    """

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            found = [sorted(matcher.entries(fold(t))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["entries"])

    toxic = rows.where("label = 1").select("text").distinct()
    documents = [set(r["entries"]) for r in toxic.mapInArrow(matched, "entries array<string>").collect()]
    documents = [d for d in documents if d]
    chosen: dict[str, float] = {}
    explained = [0] * len(documents)
    while True:
        gain = Counter(e for d, n in zip(documents, explained) if n < 2 for e in d if e not in chosen)
        if not gain:
            break
        entry, n = max(gain.items(), key=lambda x: (x[1] * lexicon.weights[x[0]], x[0]))
        if n < least:
            break
        chosen[entry] = lexicon.weights[entry]
        explained = [m + (entry in d) for d, m in zip(documents, explained)]
    return Lexicon(chosen)


def _early_exceptions(rows: DataFrame, doubtful: dict[str, int]) -> set[tuple[str, str]]:
    """Word pairs that hold much of a doubtful word's clean documents, and hardly any toxic ones.

    ``doubtful`` gives the clean documents of words that are likelier in toxic texts, but not by enough.
    """
    if not doubtful:
        return set()

    def around(text: str) -> set[str]:
        words = fold(text)
        return {" ".join((w, *p)) for k, w in enumerate(words) if w in doubtful for p in phrases(words, k)}

    counted = _by_label(rows, around).where((F.col("c") >= LEAST_DOCUMENTS) & (F.col("t") * 20 <= F.col("c")))
    found = [(*r["feature"].split(" "), r["c"]) for r in counted.collect()]
    return {(a, b) for word, a, b, n in found if n >= PHRASE_SHARE * doubtful[word]}


def _learn_exceptions(rows: DataFrame, lexicon: Lexicon) -> set[tuple[str, str]]:
    """Word pairs around a hit that clean documents have and toxic ones hardly do."""
    held: list[Matcher] = []

    def around(text: str) -> set[str]:
        if not held:  # built where it is used
            held.append(lexicon.matcher())
        words = fold(text)
        return {" ".join(p) for k in held[0].hits(words) for p in phrases(words, k)}

    found = _by_label(rows, around).where((F.col("c") >= LEAST_DOCUMENTS) & (F.col("t") * 20 <= F.col("c")))
    return {tuple(r["feature"].split(" ")) for r in found.collect()}


def _learn_coefficients(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Ridge logistic regression on two numbers of each sampled document, by Newton steps."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            found = [matcher.measure(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64()), batch.column(1)], ["total", "words", "label"])

    found = rows.mapInArrow(measure, "total double, words long, label int").collect()  # twice the sample size at most
    x = np.array([[1.0, math.log1p(r["total"]), density(r["total"], r["words"])] for r in found])
    y = np.array([r["label"] for r in found], float)
    each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    beta, ridge = np.zeros(3), np.diag([0.01, 0.1, 0.1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (each * (y - p)) - ridge @ beta
        hessian = (x * (each * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        beta = beta + np.linalg.solve(hessian, gradient)
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, score, hits, words. Null texts are empty: the lowest score.

    Other columns are ignored, whatever their names; repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            found = [matcher.measure(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([matcher.score(f[0], f[2]) for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
            ], ["id", "score", "hits", "words"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, _SCORES).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, rows and columns as they are."""
    names = docs.columns
    row = docs.select(F.struct(*names).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            found = (matcher.measure(t) for t in batch.column(1).to_pylist())
            yield batch.select([0]).filter(pa.array([matcher.score(f[0], f[2]) < threshold for f in found], pa.bool_()))

    kept = row.mapInArrow(run, f"_row {row.schema['_row'].dataType.simpleString()}")
    return kept.select(*[F.col("_row")[c].alias(c) for c in names])
