"""Tables that one stage publishes and many queries read: the ranking run and current metrics.

They are computed from the given tables once per session and scale directory and stored, the way
a scheduled job would publish them; consumers read the stored table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boursecraft.session import materialise, tables_dir

_PUBLISHED: dict[tuple[str, str, str, tuple], DataFrame] = {}


def _listing(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the folder's tables: a table that changes is published anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def published(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name, _listing(spark, sf_dir))
    if key not in _PUBLISHED:
        _PUBLISHED[key] = materialise(build(), name)
    return _PUBLISHED[key]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own, in the shared place, for a query that writes and reads back."""
    return f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


def forget() -> None:
    """Drop the references, so that the next reader publishes afresh."""
    _PUBLISHED.clear()
