"""Rows of Arrow batches in tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType


def raw(column: pa.Array) -> pa.Array:
    """A text column as UTF-8 bytes."""
    return column.cast(pa.binary())


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as Python values; a column named ``name:raw`` comes as bytes."""
    for batch in batches:
        columns = []
        for name in names:
            column = batch.column(name.removesuffix(":raw"))
            columns.append(raw(column) if name.endswith(":raw") else column)
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def packed_texts(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with a text column packed, equal texts alike: whole texts take about a third of their size in shuffles."""

    def task(batches):
        for batch in batches:
            texts = raw(batch.column(name)).to_pylist()
            packed = pa.array([None if t is None else zlib.compress(t, 1) for t in texts], pa.binary())
            yield batch.set_column(batch.schema.get_field_index(name), name, packed)

    fields = [StructField(f.name, BinaryType()) if f.name == name else f for f in rows.schema.fields]
    return rows.mapInArrow(task, StructType(fields))


def unpacked_text(packed: bytes) -> bytes:
    """A text of ``packed_texts`` as UTF-8."""
    return zlib.decompress(packed)
