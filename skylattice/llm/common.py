"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from skylattice.sources.shared import shared_dir
from skylattice.sources.shared import written as persisted

__all__ = ["persisted", "shared_dir", "stored", "table", "worker_cache"]

T = TypeVar("T")
_CACHES: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], T]) -> T:
    """One operator's cache in this Python worker, kept between its tasks; asking for it drops those of other operators."""
    for other in [k for k in _CACHES if k != name]:
        del _CACHES[other]
    if name not in _CACHES:
        _CACHES[name] = make()
    return _CACHES[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table and read back: for large tables, of which ``persisted`` takes more disk."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
