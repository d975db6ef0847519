"""Sinks and table maintenance: append-once, upsert, replace, publish.

Every merge is a function from the stored and the incoming rows to the new rows, and every write
replaces whole partitions or appends: a task that is lost and run again cannot leave half a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boursecraft.functions import values as V
from boursecraft.operators import latest as L
from boursecraft.operators.reconcile import active_equities
from boursecraft.session import discard, materialise

OBSERVATION_KEY = ("instrument_id", "field", "provider", "observed_at")
BAR_KEY = ("ticker", "ts", "interval", "provider")
#: Buckets of a bar table: tasks of a merge; and of an archive table: what one import rewrites.
BAR_BUCKETS = 64
#: Bars that one task of a merge reads and sorts.
BUCKET_ROWS = 2_000_000
ARCHIVE_BUCKETS = 256


# ---- raw envelopes --------------------------------------------------------------------------------

def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys: a variant stores object fields in key order."""
    return F.to_json(F.parse_json(text))


def envelopes(df: DataFrame) -> DataFrame:
    """Hash the canonical payload, hide secrets in the request, add the storage partition."""
    return df.withColumns(
        {
            "content_sha256": F.sha2(canonical_json(F.col("payload")), 256),
            "request_params": V.redact("request_params"),
            "received_date": F.to_date("received_at"),
        }
    )


def write_envelopes(df: DataFrame, root: str) -> None:
    envelopes(df).write.mode("append").partitionBy("provider", "received_date").json(root)


# ---- observations -----------------------------------------------------------------------------------

def split_value(value: Column, kind: Column) -> dict[str, Column]:
    """Tagged union to (numeric, text): booleans become lowercase text, numbers stay numbers."""
    return {
        "numeric_value": F.when(kind == "number", V.to_double(value)),
        "text_value": F.when(kind == "boolean", F.lower(value)).when(kind == "string", value),
    }


def new_observations(incoming: DataFrame, stored_keys: DataFrame, instruments: DataFrame) -> DataFrame:
    """Rows to append: one per key, known active equities only, keys not stored yet."""
    unique = L.pick(incoming, OBSERVATION_KEY, [-F.col("id")])
    known = unique.join(active_equities(instruments).select("instrument_id"), "instrument_id", "left_semi")
    return known.join(stored_keys.select(*OBSERVATION_KEY), list(OBSERVATION_KEY), "left_anti").select(*incoming.columns)


def dated_observations(incoming: DataFrame) -> DataFrame:
    timed = F.when(F.col("observed_at").isNull(), F.raise_error(F.lit("an observation needs observed_at"))).otherwise(F.col("observed_at"))
    return incoming.withColumn("observed_at", timed).withColumn("observed_date", F.to_date("observed_at"))


def append_new_observations(incoming: DataFrame, path: str, instruments: DataFrame) -> None:
    """Append rows whose keys are known to be new: nothing stored is read."""
    known = dated_observations(incoming).join(active_equities(instruments).select("instrument_id"), "instrument_id", "left_semi")
    known.write.mode("append").partitionBy("provider", "observed_date").parquet(path)


def append_observations(incoming: DataFrame, path: str, instruments: DataFrame) -> None:
    """Idempotent append. Only the incoming days are read from the table: the semi join on its
    partition column prunes partitions at run time. A row without ``observed_at`` has no key and
    is refused."""
    spark = incoming.sparkSession
    dated = dated_observations(incoming)
    stored = _read_or_empty(spark, path, dated)
    stored = stored.join(dated.select("observed_date").distinct(), "observed_date", "left_semi")
    fresh = new_observations(dated, stored, instruments)
    fresh.write.mode("append").partitionBy("provider", "observed_date").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], like.schema)


# ---- bars ------------------------------------------------------------------------------------------

def merge_bars(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = BAR_KEY, order: Sequence[str] = ("ingested_at",)) -> DataFrame:
    """Last write wins per bar key."""
    return L.pick(stored.unionByName(incoming), list(keys), list(order)).select(*stored.columns)


def bar_buckets(rows: int, least: int = 2) -> int:
    """Buckets of a table that will hold about ``rows`` bars: a task's share stays the same as it grows."""
    return max(least, -(-rows // BUCKET_ROWS))


def bars_table(spark: SparkSession, path: str, like: DataFrame, keys: Sequence[str], buckets: int) -> str:
    """The table stored at ``path``, by month and bucketed and sorted by its keys; made if it isn't there.

    The session's catalog holds its name only; a new session finds the months that are stored.
    """
    name = f"bars_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (month) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
        if _exists(spark, path):
            spark.catalog.recoverPartitions(name)
    return name


def merged_bars(incoming: DataFrame, path: str, keys: Sequence[str] = BAR_KEY, order: Sequence[str] = ("ingested_at",), buckets: int = BAR_BUCKETS) -> tuple[str, DataFrame]:
    """(table, new contents of the months that receive bars): the later of stored and incoming row per key.

    The stored side is read by its buckets and not shuffled; incoming rows are shuffled to them. Months
    without incoming rows are pruned at run time.
    """
    spark, keys = incoming.sparkSession, list(keys)
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    refused = F.when(missing, F.raise_error(F.lit(f"a bar needs {', '.join(keys)}"))).otherwise(F.col(keys[0]))
    dated = incoming.withColumn(keys[0], refused).withColumn("month", F.date_format("ts", "yyyy-MM"))
    table = bars_table(spark, path, dated, keys, buckets)
    rest = [c for c in dated.columns if c not in keys]
    new = L.pick(dated, keys, list(order)).select(*keys, F.struct(*rest).alias("_new"))
    stored = spark.table(table)
    # pruning at run time asks for a predicate on the pruning side
    months = dated.select("month").distinct().filter(F.col("month") > F.lit(""))
    old = stored.join(F.broadcast(months), "month", "left_semi").select(*keys, F.struct(*rest).alias("_old"))  # a few bytes a month
    place = lambda side: F.struct(*[F.col(side)[c] for c in order])
    later = F.when(F.col("_old").isNull() | (place("_new") >= place("_old")), F.col("_new")).otherwise(F.col("_old"))
    both = old.join(new.hint("merge"), keys, "full").select(*keys, F.coalesce(later, F.col("_old")).alias("_row"))
    return table, both.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*stored.columns)


def upsert_bars(incoming: DataFrame, path: str, keys: Sequence[str] = BAR_KEY, order: Sequence[str] = ("ingested_at",), buckets: int = BAR_BUCKETS) -> None:
    """Merge into a bucketed table partitioned by month, rewriting only the months that received bars.

    A row without a part of its key is refused. New months replace old ones when all are written, so the
    stored rows are read whole before any is replaced. Incoming rows are shuffled into as many partitions
    as there are buckets: stored rows stay where they are, and one task writes a bucket, one file a month.
    """
    spark = incoming.sparkSession
    table, merged = merged_bars(incoming, path, keys, order, buckets)
    wanted = {"spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.shuffle.partitions": str(buckets)}
    kept = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        merged.write.insertInto(table, overwrite=True)
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


# ---- instruments, runs, mirror -----------------------------------------------------------------------

def upsert_instruments(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Full outer merge on (ticker, exchange); incoming name and sector win where present.

    Incoming rows of one key, however it is spelt, act one after another: by name, then sector. The
    last name stays, and the last sector that is there. Stored keys are unique.
    """
    given = incoming.select(
        V.ticker_norm("ticker").alias("ticker"), F.coalesce("exchange", F.lit("NSE")).alias("exchange"),
        F.trim(F.coalesce(F.nullif("shortName", F.lit("")), F.col("ticker"))).alias("_name"), F.col("sector").alias("_sector"),
    ).filter("ticker IS NOT NULL AND ticker <> ''")
    cleaned = given.groupBy("ticker", "exchange").agg(F.max("_name").alias("_name"), F.max_by("_sector", F.when(F.col("_sector").isNotNull(), F.struct("_name", "_sector"))).alias("_sector"))
    return stored.join(cleaned, ["ticker", "exchange"], "full").select(
        "ticker", "exchange", F.coalesce("_name", "company_name").alias("company_name"), F.coalesce("_sector", "sector").alias("sector")
    )


def ranked_rows_to_store(run_id: str, scored: DataFrame, instruments: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Scored rows as stored: unknown tickers dropped, factors as a map of the non-null ones."""
    known = scored.join(instruments.select("ticker", "instrument_id"), "ticker")
    pairs = F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("key"), F.col(f).cast("double").alias("value"))) for f in factors])
    return known.select(
        F.lit(run_id).alias("run_id"), "instrument_id", "rank", F.col("final_score").alias("score"), "score_status",
        F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull())).alias("factors"), F.col("data_cov").alias("data_coverage"),
    )


def publish_run(rows: DataFrame, path: str) -> None:
    """Append one run as its own partition; running it again replaces that partition."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def mirror(stored: DataFrame, incoming: DataFrame, key: str = "observation_id") -> DataFrame:
    """Insert or replace by id: the incoming row wins."""
    tagged = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return L.pick(tagged, [key], ["_new"]).select(*stored.columns)


# ---- archive -----------------------------------------------------------------------------------------

def upsert_archive(incoming_rows: DataFrame, path: str, buckets: int = ARCHIVE_BUCKETS) -> None:
    """``replace_archive`` on a table stored by file buckets; buckets without an incoming file are not read."""
    spark = incoming_rows.sparkSession
    bucket = F.pmod(F.xxhash64("source_path", "content_sha256"), F.lit(buckets)).cast("int")
    # stored: the files are parsed once for their buckets, their keys and their rows
    incoming = materialise(incoming_rows.withColumn("bucket", bucket), "incoming")
    stored = _read_or_empty(spark, path, incoming)
    touched = stored.join(F.broadcast(incoming.select("bucket").distinct().filter("bucket >= 0")), "bucket", "left_semi")  # ``buckets`` rows at most
    # the table being replaced is also being read
    kept = materialise(kept_archive(touched.select(*incoming.columns), incoming), "archive")
    kept.unionByName(incoming).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    discard(incoming, kept)


def kept_archive(stored_rows: DataFrame, incoming_rows: DataFrame) -> DataFrame:
    """Stored rows of files, (path, hash), that are not imported again. A file of most rows is left to the
    adaptive skew join: repeating every key for salts costs more than the rows where files are short."""
    keys = ["source_path", "content_sha256"]
    return stored_rows.join(incoming_rows.select(*keys).distinct(), keys, "left_anti")


def replace_archive(stored_rows: DataFrame, incoming_rows: DataFrame) -> DataFrame:
    """Rows of every imported (path, hash) are replaced as a whole."""
    return kept_archive(stored_rows, incoming_rows).unionByName(incoming_rows)


# ---- exports and contracts -----------------------------------------------------------------------------

def dashboard_rows(wide: DataFrame) -> DataFrame:
    """Ticker-ordered export rows with a schema version."""
    return wide.withColumn("schema_version", F.lit(1)).orderBy("ticker")


def write_dashboard(wide: DataFrame, path: str) -> None:
    dashboard_rows(wide).write.mode("overwrite").json(path)


def payload_contract(df: DataFrame, declared: int) -> DataFrame:
    """One row of checks from one aggregation. Duplicates are found by grouping, not by a distinct set."""
    per_ticker = df.groupBy("ticker").agg(F.count("*").alias("n"), F.max("schema_version").alias("v"), F.min("schema_version").alias("u"))
    return per_ticker.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.coalesce((F.max("v") == 1) & (F.min("u") == 1), F.lit(False)).alias("version_ok"),
        (F.coalesce(F.sum("n"), F.lit(0)) > 0).alias("non_empty"),
        (F.coalesce(F.sum("n"), F.lit(0)) == declared).alias("count_ok"),
        ((F.count_if(F.col("n") > 1) + F.count_if(F.col("ticker").isNull() | (F.col("ticker") == ""))) == 0).alias("unique_tickers"),
    )


SNAPSHOT_COLUMNS = ("ticker", "rank", "final_score")


def snapshot_contract(df: DataFrame, label: str) -> DataFrame:
    """Required columns (checked on the schema) and one problem row per duplicated ticker."""
    missing = [c for c in SNAPSHOT_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"{label} lacks {', '.join(sorted(missing))}")
    named = df.filter(~V.is_blank_text("ticker"))
    return L.duplicate_keys(named.withColumn("ticker", F.trim("ticker")), ["ticker"]).withColumn("label", F.lit(label))


# ---- price and fundamentals caches ----------------------------------------------------------------------

def merge_price_cache(stored: DataFrame, incoming: DataFrame, symbols: DataFrame, as_of, days: int = 400) -> DataFrame:
    """Requested symbols, recent days, one row per (ticker, day): the incoming row wins."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    recent = both.filter(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days)).join(symbols.select("ticker"), "ticker", "left_semi")
    return L.pick(recent, ["ticker", "day"], ["_new", "seq"]).select(*stored.columns)


def incremental_plan(stored: DataFrame, symbols: DataFrame, minimum: int = 10, overlap: int = 10) -> DataFrame:
    """Per symbol: incremental from (newest cached day - overlap) with enough history, else backfill."""
    newest = stored.agg(F.max("day").alias("d"))
    counts = stored.groupBy("ticker").agg(F.count("*").alias("cached"))
    plan = symbols.join(counts, "ticker", "left")
    enough = F.coalesce(F.col("cached"), F.lit(0)) >= minimum
    return plan.select(
        "ticker", F.when(enough, "incremental").otherwise("backfill").alias("mode"),
        F.when(enough, F.date_sub(newest.scalar(), overlap)).alias("start_day"),
    )


def merge_fundamentals(cached: DataFrame, fresh: DataFrame, symbols: DataFrame, fields: Sequence[str], minimum: float | None = 0.80) -> DataFrame:
    """Fresh non-null values over cached ones for every requested symbol; refuse poor coverage."""
    if minimum is not None:
        wanted = symbols.count()
        got = fresh.join(symbols, "ticker", "left_semi").count()
        if got < minimum * max(1, wanted):
            raise RuntimeError(f"fresh values for {got / max(1, wanted):.1%} of the symbols; the cached ones stay")
    new = fresh.select("ticker", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = symbols.select("ticker").join(cached, "ticker", "left").join(new, "ticker", "left")
    return joined.select("ticker", *[F.coalesce(f"_{f}", f).alias(f) for f in fields])


def append_audit(previous: DataFrame, changes: DataFrame) -> DataFrame:
    """Audit of recovered cells: one row per (ticker, field), the newest."""
    both = previous.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return L.pick(both, ["ticker", "field"], ["_new", "fetched_at"]).select(*previous.columns)


def promote_baseline(ranking: DataFrame, root: str, run_date: str | None = None) -> None:
    """Store the ranking as the history partition of its date; without a date, rows name their own."""
    publish = ranking if run_date is None else ranking.withColumn("run_date", F.lit(run_date))
    publish.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(root)


def read_history(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", root).parquet(root).withColumn("run_date", F.col("run_date").cast("string"))


def baseline(history: DataFrame, before: str) -> DataFrame:
    """The newest stored ranking older than ``before``."""
    older = history.filter(F.col("run_date") < before)
    return older.filter(F.col("run_date") == older.agg(F.max("run_date").alias("d")).scalar())
