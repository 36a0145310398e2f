"""Row order as data: dense numbering and forward fill without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charlascope.session import cut_lineage, work_partitions
from charlascope.settings import HOT_ROWS


def number_rows(
    frame: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    out: str = "row_id",
    start: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Dense positions from ``start``, per key or over the whole table; ``order`` must be unique within a key.

    Ordinary keys use one window. Keys of more than ``hot_rows`` rows, and the key-less case, are range partitioned on
    the order itself, so that no task ever holds more than its share.
    """
    if not keys:
        return _number_runs(frame, [], list(order), out, start)
    numbered = lambda part: part.withColumn(
        out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint") + F.lit(start - 1)
    )
    # At most (all rows / hot_rows) keys qualify, so the list is safe to broadcast.
    hot = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).drop("_n")
    if hot.isEmpty():
        return numbered(frame)
    cold_part = frame.join(F.broadcast(hot), list(keys), "left_anti")
    hot_part = frame.join(F.broadcast(hot), list(keys), "left_semi")
    return numbered(cold_part).unionByName(_number_runs(hot_part, list(keys), list(order), out, start))


def _number_runs(frame: DataFrame, keys: list[str], order: list[str], out: str, start: int) -> DataFrame:
    """Number rows through sorted runs: position inside the run plus the rows of the key in earlier runs."""
    sort_key = [*keys, *order]
    runs = cut_lineage(
        frame.repartitionByRange(*sort_key)
        .sortWithinPartitions(*sort_key)
        .withColumn("_pos", F.monotonically_increasing_id())
    ).withColumn("_run", F.shiftright("_pos", 33))
    # One row per run and key: no more than runs plus hot keys.
    sizes = runs.groupBy("_run", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        runs.join(F.broadcast(offsets), ["_run", *keys])
        .withColumn(out, F.col("_pos") - F.col("_first") + F.col("_base") + F.lit(start))
        .drop("_run", "_pos", "_first", "_base")
        .select(*frame.columns, out)
    )


def forward_fill(frame: DataFrame, columns: Sequence[str], order: str, runs: int | None = None) -> DataFrame:
    """Replace nulls by the last earlier value over the whole table, in the order of a column without nulls or ties.

    A prefix scan over narrow rows: the order and the columns to fill are sorted into ``runs`` ranges, each range fills
    itself, and a table with the last values of every range carries them over its border. Other columns, such as texts,
    are joined once by the order. The order need not be dense.
    """
    ranges = runs or work_partitions(frame.sparkSession)
    sorted_rows = frame.select(order, *columns).repartitionByRange(ranges, order).sortWithinPartitions(order)
    stored = cut_lineage(sorted_rows.withColumn("_run", F.spark_partition_id()))
    inside = Window.partitionBy("_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(f"_tail_{name}")

    # One row per range: ``ranges`` at most, whatever the size of the table.
    tails = stored.groupBy("_run").agg(*[latest(name) for name in columns])
    carry = tails.select(
        "_run", *[F.last(f"_tail_{name}", ignorenulls=True).over(before).alias(f"_carry_{name}") for name in columns]
    )
    filled = stored.join(F.broadcast(carry), "_run", "left").select(
        order, *[F.coalesce(F.last(name, ignorenulls=True).over(inside), f"_carry_{name}").alias(name) for name in columns]
    )
    rest = [name for name in frame.columns if name not in columns]
    whole = filled if rest == [order] else frame.select(*rest).join(filled, order)
    return whole.select(*frame.columns)
