"""CSV scans with every column as text and the file order as an explicit column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charlascope.operators.order import number_rows


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file or folder; reads one header line, no data."""
    return spark.read.option("header", True).csv(path, multiLine=True, escape='"', encoding="UTF-8").columns


def has_long_cells(spark: SparkSession, path: str) -> bool:
    """Whether some quoted cell may hold a line break: its first line has an odd number of quotes."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not lines.where(quotes % 2 == 1).isEmpty()


def scan_csv(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """Rows as written, all columns as strings, empty cells as null; blank lines are skipped.

    Files whose cells are all on one line are read in splits, by as many tasks as their size asks for; others by one task
    a file. Unless told by ``multiline``, a pass over the lines finds out.
    """
    if multiline is None:
        multiline = has_long_cells(spark, path)
    names = header_of(spark, path)
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    return spark.read.schema(schema).csv(
        path,
        header=True,
        multiLine=multiline,
        quote='"',
        escape='"',
        encoding="UTF-8",
        enforceSchema=False,
    )


def scan_csv_in_order(spark: SparkSession, path: str, out: str = "ord", multiline: bool | None = None) -> DataFrame:
    """The same rows with their zero-based position over all files, in path order."""
    rows = scan_csv(spark, path, multiline)
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return number_rows(placed, ["_path", "_start", "_at"], out=out).select(*rows.columns, out)
