"""Queries over the reference tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bundle_queries import BUNDLE
from .ledger_queries import LEDGER

_ALL = BUNDLE | LEDGER
#: Counted columns: long in SQL, whatever a Spark function gives.
_LONG = {"rank", "quota_rank", "pos", "n_chars"}


def _counted(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("long") for c in df.columns if c in _LONG})

    return run


QUERIES = {name: _counted(q) for name, (q, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
