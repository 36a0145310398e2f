"""Helpers shared by the corpus operators: tables, Arrow rows, splits, held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from charlascope.functions.arrow import batched, raw, rows_of  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels no model may see: crc32 of the id as text leaves 2 modulo 4; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
