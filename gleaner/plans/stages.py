"""Materialised pipeline stages.

A stage that several plans reuse (the phrase units feed term counts,
vocabulary, coherence windows and the corpus) is written once as Parquet
under the shared checkpoint folder (``spark.checkpoint.dir``) and read back,
which cuts the lineage, survives executor loss, and lets later scans prune
columns and push filters.  Stages are memoised per application and input
directory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.session import checkpoint_dir

_MEMO: dict[tuple[str, str, str], DataFrame] = {}


def stage(spark: SparkSession, sf_dir: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    app = spark.sparkContext.applicationId
    memo_key = (app, sf_dir, key)
    if memo_key not in _MEMO:
        root = checkpoint_dir(spark).rstrip("/")
        tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:12]
        path = f"{root}/gleaner-stages/{app}/{key}-{tag}"
        build().write.mode("overwrite").parquet(path)
        _MEMO[memo_key] = spark.read.parquet(path)
    return _MEMO[memo_key]


def scratch_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder for sink outputs under the shared checkpoint folder."""
    root = checkpoint_dir(spark).rstrip("/")
    tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:12]
    return f"{root}/gleaner-out/{spark.sparkContext.applicationId}/{name}-{tag}"


def clear() -> None:
    _MEMO.clear()
