"""Secret scans: fixed patterns, and two character Markov models compared by likelihood.

Everything is DataFrame expressions. The fixed patterns give the base spans. Beyond them, every
stretch of twenty or more key characters outside the base spans is scored by the log-likelihood ratio of
two first-order character models: one of random strings, one of ordinary identifiers. Both are
trained from labelled samples: generated random strings and the values that the fixed patterns
catch, against the words of a documented number of documents.

A text is scanned in parts of some thousand characters, cut where nothing can match across: behind a
character that no pattern has, or behind a single blank between two others. Work is linear in the
length of a text and the number of its spans, whatever their kind.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base scan, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the longest run behind AKIA, twenty characters with it
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the models judge; what a ratio must reach in all and for each transition.
TOKEN_LENGTH = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{TOKEN_LENGTH},}}"
LEAST_RATIO = 12.0
LEAST_MEAN = 0.6

#: Characters of a part, and what parts a text into such: as much as fits up to a safe place, else up to
#: the next one however far.
PART = 4000
_SAFE = r"""(?:(?<=[^A-Za-z0-9+/_.=\-"':\x20])|(?<=[^\x20:="']\x20)(?=[^\x20:="']))"""
_PARTS = rf"(?s).{{1,{PART}}}{_SAFE}|.+?(?:{_SAFE}|\z)"

#: Bounds of the training samples: generated strings, and documents whose words are taken.
RANDOM_STRINGS = 4096
IDENTIFIER_DOCUMENTS = 2048

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIZE = len(_ALPHABET)
_NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class MarkovRatio:
    """log P(next | this, random) - log P(next | this, ordinary), row by row over the alphabet."""

    ratios: tuple[float, ...]

    def score(self, token: Column) -> Column:
        """Sum over the transitions of a token that is made of the alphabet."""
        table = F.split(F.lit(",".join(f"{r:.5f}" for r in self.ratios)), ",").cast("array<double>")
        codes = F.transform(F.regexp_extract_all(token, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(_ALPHABET), c) - 1)
        return F.aggregate(
            codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("total")),
            lambda seen, c: F.struct(
                c.alias("last"), (seen["total"] + F.when(seen["last"] >= 0, F.coalesce(F.get(table, seen["last"] * _SIZE + c), F.lit(0.0))).otherwise(F.lit(0.0))).alias("total"),
            ),
            lambda seen: seen["total"],
        )


def _pairs(tokens: DataFrame) -> DataFrame:
    """Counts of adjacent characters; at most the alphabet squared rows."""
    at = tokens.where(F.length("token") >= 2).select("token", F.explode(F.expr("sequence(1, length(token) - 1)")).alias("i"))
    pair = at.select(F.col("token").substr(F.col("i"), F.lit(2)).alias("pair"))
    return pair.groupBy("pair").count()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", random_strings: int = RANDOM_STRINGS, documents: int = IDENTIFIER_DOCUMENTS) -> MarkovRatio:
    """Fit both models. The driver gets two tables of at most the alphabet squared counts.

    The documents are those with the smallest hashes of their identifier; null texts give no words.
    """
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    made = spark.range(random_strings).select(F.explode(F.array(
        F.rtrim(F.base64(digest), F.lit("=")), F.lower(F.hex(digest)), F.substring(F.regexp_replace(F.upper(F.base64(digest)), "[^A-Z0-9]", ""), 1, 20),
    )).alias("token"))
    sample = docs.select(F.col(id_col).cast("long").alias("id")).orderBy(F.xxhash64("id"), "id").limit(documents)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample.distinct()), "id", "left_semi")
    caught = texts.select(F.explode(F.concat(
        F.filter(F.expr(f"regexp_extract_all(text, {_sql(ASSIGN)}, 2)"), lambda v: F.length(v) >= 16), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
    )).alias("token"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), HEX, " "), ACCESS, " ")
    words = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(r"[A-Za-z][A-Za-z0-9_]+"), F.lit(0))).alias("token"))
    both = _pairs(made.unionByName(caught)).withColumn("random", F.lit(True)).unionByName(_pairs(words).withColumn("random", F.lit(False)))
    place = {c: k for k, c in enumerate(_ALPHABET)}
    counts = {kind: [[0] * _SIZE for _ in _ALPHABET] for kind in (True, False)}
    for pair, n, random in both.collect():
        a, b = place.get(pair[0]), place.get(pair[1])
        if a is not None and b is not None:
            counts[random][a][b] += n
    logs = {kind: _smoothed(rows) for kind, rows in counts.items()}
    return MarkovRatio(tuple(x - y for x, y in zip(logs[True], logs[False])))


def _smoothed(counts: list[list[int]], weight: float = 20.0) -> list[float]:
    """log P(b | a) for all pairs: each row leans on the overall share of b with the given weight."""
    ends = [sum(row[b] for row in counts) + 1 for b in range(_SIZE)]
    share = [n / sum(ends) for n in ends]
    return [math.log((row[b] + weight * share[b]) / (sum(row) + weight)) for row in counts for b in range(_SIZE)]


def _sql(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


def _found(text: Column, pattern: str, kind: int, value: Column | None = None) -> Column:
    """Spans of a pattern, leftmost and not overlapping, as (start, kind, end) in code points.

    The text is split at the matches: a match starts behind all earlier parts and matches.
    ``value`` gives for the k-th match whether it counts.
    """
    spans = F.aggregate(
        F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, 1 << 30).alias("part"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")),
        F.struct(F.lit(0).alias("at"), F.lit(None).cast(_NO_SPANS).alias("spans")),
        lambda seen, x: F.struct(
            (seen["at"] + F.length(x["part"]) + F.coalesce(F.length(x["match"]), F.lit(0))).alias("at"),
            F.when(x["match"].isNull(), seen["spans"]).otherwise(F.concat(
                F.coalesce(seen["spans"], F.array().cast(_NO_SPANS)),
                F.array(F.struct(
                    (seen["at"] + F.length(x["part"])).alias("start"), F.lit(kind).alias("kind"),
                    (seen["at"] + F.length(x["part"]) + F.length(x["match"])).alias("end"),
                )),
            )).alias("spans"),
        ),
        lambda seen: F.coalesce(seen["spans"], F.array().cast(_NO_SPANS)),
    )
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_NO_SPANS))


def _stretches(token: Column, base: Column) -> Column:
    """Spans of the parts of a token outside the sorted base spans that are long enough to be judged."""
    none = F.array().cast(_NO_SPANS)

    def added(seen: Column, end: Column) -> Column:
        span = F.struct(seen["at"].alias("start"), token["kind"].alias("kind"), end.alias("end"))
        return F.when(end - seen["at"] >= TOKEN_LENGTH, F.concat(F.coalesce(seen["spans"], none), F.array(span))).otherwise(seen["spans"])

    return F.aggregate(
        F.filter(base, lambda b: (b["start"] < token["end"]) & (token["start"] < b["end"])),
        F.struct(token["start"].alias("at"), F.lit(None).cast(_NO_SPANS).alias("spans")),
        lambda seen, b: F.struct(F.greatest(seen["at"], b["end"]).alias("at"), added(seen, b["start"]).alias("spans")),
        lambda seen: F.coalesce(added(seen, token["end"]), none),
    )


def _base_of(text: Column) -> Column:
    """Sorted spans of the fixed patterns in a part."""
    none = F.array().cast(_NO_SPANS)
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.filter(F.arrays_zip(_found(text, ASSIGN, 0).alias("span"), values.alias("value")), lambda x: F.length(x["value"]) >= ASSIGN_VALUE)
    assign = F.when(text.rlike(ASSIGN), F.transform(assign, lambda x: x["span"])).otherwise(none)
    return F.array_sort(F.concat(assign, _found(text, ACCESS, 1), _found(text, HEX, 2)))


def _markov_of(text: Column, base: Column, model: MarkovRatio) -> Column:
    """Spans of a part outside its base spans that are likelier random than ordinary."""
    token = lambda x: text.substr(x["start"] + 1, x["end"] - x["start"])
    outside = F.flatten(F.transform(_found(text, TOKEN, 3), lambda x: _stretches(x, base)))
    judged = F.transform(outside, lambda x: F.struct(x.alias("span"), model.score(token(x)).alias("ratio"), (x["end"] - x["start"] - 1).alias("steps")))
    judged = F.filter(judged, lambda x: (x["ratio"] >= LEAST_RATIO) & (x["ratio"] >= LEAST_MEAN * x["steps"]))
    return F.when(text.rlike(TOKEN), F.transform(judged, lambda x: x["span"])).otherwise(F.array().cast(_NO_SPANS))


def _scanned(rows: DataFrame, model: MarkovRatio) -> DataFrame:
    """``rows`` with ``_parts``: the parts of ``_text``, where each begins, and the spans within it."""
    text = F.col("_text")
    some = text.rlike(f"{ASSIGN}|(?-i:{ACCESS}|{HEX}|{TOKEN})")  # texts without a match are not parted
    rows = rows.withColumn("_cut", F.when(some, F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0))).otherwise(F.array().cast("array<string>")))
    ends = F.aggregate("_cut", F.array(F.lit(0)), lambda at, part: F.concat(at, F.array(F.element_at(at, -1) + F.length(part))))
    rows = rows.withColumn("_at", ends).withColumn("_base", F.transform("_cut", _base_of))
    markov = F.transform(F.arrays_zip("_cut", "_base"), lambda x: _markov_of(x["_cut"], x["_base"], model))
    rows = rows.withColumn("_markov", markov)
    return rows.withColumn("_parts", F.arrays_zip(F.col("_cut").alias("text"), F.slice("_at", 1, F.size("_cut")).alias("at"), F.col("_base").alias("base"), F.col("_markov").alias("markov"))).drop("_cut", "_at", "_base", "_markov")


def _spans(name: str) -> Column:
    """The spans of all parts, as places in the whole text."""
    moved = lambda x, part: F.struct((x["start"] + part["at"]).alias("start"), x["kind"].alias("kind"), (x["end"] + part["at"]).alias("end"))
    return F.flatten(F.transform("_parts", lambda part: F.transform(part[name], lambda x: moved(x, part)))).cast(_NO_SPANS)


def scan(docs: DataFrame, model: MarkovRatio, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``id_col``, base and markov spans as sorted (start, kind, end) arrays.

    ``kind`` is a position in ``KINDS``; ends are exclusive; code points. Null texts are empty and
    have no spans. Only the columns named in ``carry`` come along.
    """
    rows = docs.select(F.col(id_col), *carry, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return _scanned(rows, model).select(F.col(id_col), *carry, "_text", _spans("base").alias("base"), _spans("markov").alias("markov"))


def described(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, model: MarkovRatio, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by ``mark``; other columns as they are.

    Documents without a span are untouched, null texts among them.
    """
    row = docs.select(F.struct(*docs.columns).alias("_row"))
    found = _scanned(row.select("_row", F.coalesce(F.col(f"_row.{text_col}"), F.lit("")).alias("_text")), model)

    def made(part: Column) -> Column:
        text, end = part["text"], F.length(part["text"])
        return F.aggregate(
            F.array_sort(F.concat(part["base"], part["markov"])), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda seen, x: F.struct(
                F.greatest(seen["at"], x["end"]).alias("at"),
                F.when(x["start"] < seen["at"], seen["out"]).otherwise(F.concat(seen["out"], text.substr(seen["at"] + 1, x["start"] - seen["at"]), F.lit(mark))).alias("out"),
            ),
            lambda seen: F.concat(seen["out"], text.substr(seen["at"] + 1, end - seen["at"])),
        )

    hit = F.exists("_parts", lambda part: F.size(part["base"]) + F.size(part["markov"]) > 0)
    clean = F.when(hit, F.array_join(F.transform("_parts", made), "")).otherwise(F.col("_row")[text_col])
    return found.select(*[clean.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
