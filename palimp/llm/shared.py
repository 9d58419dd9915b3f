"""What the operators share: tables of the shared folder, and the input tables."""

from __future__ import annotations

import ctypes

from pyspark.sql import DataFrame, SparkSession

from palimp.session import ship
from palimp.storage import drop_path, forget, fresh_dir, shared_dir, written

__all__ = ["drop_path", "forget", "fresh_dir", "give_back", "shared_dir", "table", "written"]


def give_back() -> None:
    """Returns memory that this process has freed to the system, where its C library can; training on the driver frees some hundred MB."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
