"""Nearest utterances over precomputed embeddings, and intent scores from them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from charlascope.operators.products import SIM_SCALE
from charlascope.session import cut_lineage, work_partitions

NEAREST = 50
# Cells: the square root of the number of vectors, within these bounds. At most MOST_PIVOTS vectors reach the driver.
PIVOTS = 32
MOST_PIVOTS = 1024
PART_ROWS = 10_000
# Distances near zero are off by up to 1e-7, as they are roots of differences.
_SLACK = 1e-6
# Rows of a batch, and queries that are multiplied with a part at a time.
_BATCH = 1000
_MET = 100
# Bytes of the queries of one share and their results.
SHARE_BYTES = 128_000_000


@dataclass(frozen=True)
class Cells:
    """Cells around pivots: per cell its pivot, number of vectors, least and greatest distance from it, and parts."""

    centers: np.ndarray
    sizes: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    parts: np.ndarray

    def distances(self, units: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2.0 - 2.0 * (units @ self.centers.T), 0.0))

    def first(self, away: np.ndarray, k: int) -> np.ndarray:
        """Which cells each query visits first: the nearest ones that hold ``k`` vectors together."""
        order = np.argsort(away, axis=1, kind="stable")
        sizes = self.sizes[order]
        mask = np.zeros(away.shape, bool)
        np.put_along_axis(mask, order, (np.cumsum(sizes, axis=1) - sizes < k) & (sizes > 0), axis=1)
        return mask

    def within(self, away: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which cells can hold a vector within ``reach`` of each query.

        By the triangle inequality over the pivot, and by the plane halfway to the query's own pivot, beyond which all
        vectors of the other cell lie.
        """
        own = np.argmin(away, axis=1)
        apart = self.distances(self.centers)[own]
        gap = away**2 - np.take_along_axis(away, own[:, None], axis=1) ** 2
        plane = np.divide(gap, 2.0 * apart, out=np.zeros_like(gap), where=apart > 1e-3)
        least = np.maximum(np.maximum(away - self.outer, self.inner - away), plane)
        return (least <= reach[:, None] + _SLACK) & (self.sizes > 0)


def nearest_vectors(
    queries: DataFrame, corpus: DataFrame, k: int = NEAREST, pivots: int = PIVOTS, part_rows: int = PART_ROWS
) -> DataFrame:
    """The ``k`` most similar corpus vectors of each query by cosine, ties by ``vec_id``; exact.

    ``queries(query_id, embedding)``, one row per id, and ``corpus(vec_id, label, embedding)`` hold arrays of one
    length; vectors of length zero have no direction and are left out. The search takes two steps. A query first meets
    the nearest cells that hold ``k`` vectors; the k-th of those bounds the distance of its true k-th neighbour. Then
    it meets only cells that can hold something nearer, and in them only vectors whose distance from the pivot allows
    it. The number of cells grows with the corpus (at least ``pivots``), and cells are dealt into parts of about
    ``part_rows`` vectors.
    """
    cells, placed = build_cells(corpus, pivots, part_rows)
    if cells is None:
        kind = lambda name: corpus.schema[name].dataType
        return queries.limit(0).select(
            "query_id",
            F.lit(None).cast(kind("vec_id")).alias("vec_id"),
            F.lit(None).cast(kind("label")).alias("label"),
            F.lit(0.0).alias("sim"),
        )
    asked = _directed(queries).select("query_id", _unit(F.col("embedding")).alias("q"))
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    top = lambda pairs: pairs.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).drop("_rank")
    near = cut_lineage(top(_meet(first_visits(cells, asked, k), placed, k)))
    return top(near.unionByName(_meet_all(cells, reached(asked, near, k), placed, k)))


def build_cells(
    corpus: DataFrame, pivots: int = PIVOTS, part_rows: int = PART_ROWS
) -> tuple[Cells | None, DataFrame | None]:
    """The cells and ``(vec_id, label, u, cell, away, part)``, stored; nothing if no vector has a direction.

    Every vector lies in the cell of its nearest pivot. Pivots are the different vectors of least hash, so copies of one
    vector give one pivot.
    """
    directed = _directed(corpus).withColumn("_hash", F.xxhash64("embedding"))
    wanted = min(max(math.isqrt(directed.count()), pivots), MOST_PIVOTS)
    least = directed.select("_hash").distinct().orderBy("_hash").limit(wanted)
    chosen = directed.join(F.broadcast(least), "_hash", "left_semi").groupBy("_hash").agg(F.first("embedding").alias("e"))
    # At most MOST_PIVOTS rows.
    centers = np.array([row.u for row in chosen.orderBy("_hash").select(_unit(F.col("e")).alias("u")).collect()])
    if not len(centers):
        return None, None
    bare = Cells(centers, *[np.zeros(len(centers))] * 4)
    narrow = directed.select("vec_id", "label", _unit(F.col("embedding")).alias("u"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            away = bare.distances(_matrix(batch.column("u")))
            cell = np.argmin(away, axis=1)
            nearest = away[np.arange(len(cell)), cell]
            yield _with(batch, cell=cell.astype("int32"), away=nearest)

    located = cut_lineage(narrow.mapInArrow(place, _schema(narrow, cell=IntegerType(), away=DoubleType())))
    # One row per cell.
    found = located.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("away").alias("inner"), F.max("away").alias("outer")
    )
    sizes, inner, outer = (np.zeros(len(centers)) for _ in range(3))
    for row in found.collect():
        sizes[row.cell], inner[row.cell], outer[row.cell] = row.n, row.inner, row.outer
    parts = np.maximum(-(-sizes // part_rows), 1).astype("int64")
    of_cell = F.get(F.lit(parts.tolist()), F.col("cell"))
    placed = located.withColumn("part", F.pmod(F.xxhash64("vec_id"), of_cell).cast("int"))
    return Cells(centers, sizes, inner, outer, parts), placed


def first_visits(cells: Cells, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, q, reach, cell, part, away) for the nearest cells that hold ``k`` vectors; nothing bounds them yet."""
    return _visits(cells, asked.withColumn("reach", F.lit(math.inf)), lambda away, reach: cells.first(away, k))


def later_visits(cells: Cells, asked: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """The same for the other cells in reach of each query, given what the first ones held."""
    return _visits(cells, reached(asked, near, k), lambda away, reach: cells.within(away, reach) & ~cells.first(away, k))


def reached(asked: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(query_id, q, reach): the distance within which all of a query's ``k`` best lie, given what its first cells held."""
    # Similarities are steps of 1 / SIM_SCALE: a vector that ties lies at most half a step lower.
    reach = F.sqrt(F.greatest(2.0 - 2.0 * F.min("sim") + 4.0 / SIM_SCALE, F.lit(0.0)))
    # A query that met fewer than k vectors has met all cells.
    bounds = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), reach.alias("reach")).filter(F.col("n") >= k)
    return asked.join(bounds.drop("n"), "query_id")


def _visits(cells: Cells, asked: DataFrame, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            away = cells.distances(_matrix(batch.column("q")))
            row, cell = np.nonzero(chosen(away, batch.column("reach").to_numpy()))
            times = cells.parts[cell]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            for at in range(0, len(row), _BATCH):
                r, c = row[at : at + _BATCH], cell[at : at + _BATCH]
                found = {"cell": c.astype("int32"), "part": part[at : at + _BATCH].astype("int32"), "away": away[r, c]}
                yield _with(batch.take(pa.array(r)), **found)

    return asked.mapInArrow(visit, _schema(asked, cell=IntegerType(), part=IntegerType(), away=DoubleType()))


def _meet(visits: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """The ``k`` best vectors of each part that a query visits, among those whose distance from the pivot is in reach.

    A task holds the vectors of one part and multiplies them with the queries that visit it, some at a time.
    """
    side = lambda frame, kind, *names: frame.select("cell", "part", "away", F.lit(kind).alias("kind"), *names)
    vectors = side(placed, 0, "vec_id", "label", F.col("u").alias("v"))
    asked = side(visits, 1, "query_id", "reach", F.col("q").alias("v"))
    dealt = vectors.unionByName(asked, allowMissingColumns=True)
    dealt = dealt.repartition(work_partitions(placed.sparkSession), "cell", "part").sortWithinPartitions("cell", "part", "kind")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, None
        for batch in _sliced(batches):
            keys = np.stack([batch.column(n).to_numpy() for n in ("cell", "part", "kind")])
            cuts = (np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist()
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                key, rows = tuple(keys[:2, start]), batch.slice(start, stop - start)
                if key != at:
                    at, part = key, []
                if keys[2, start] == 0:
                    part.append(rows)
                elif part:
                    if isinstance(part, list):
                        part = _Part(part)
                    for some in range(0, len(rows), _MET):
                        yield part.best(rows.slice(some, _MET), k)

    kinds = {f.name: f.dataType for f in dealt.schema.fields}
    schema = StructType()
    for name in ("query_id", "vec_id", "label"):
        schema = schema.add(name, kinds[name])
    return dealt.mapInArrow(task, schema.add("sim", DoubleType()))


def _meet_all(cells: Cells, bounded: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """The ``k`` best vectors of each query among the cells of ``later_visits``.

    Visits would repeat a query in every cell in its reach. Here a task holds a share of the queries and their ``k`` best so
    far, and reads all vectors, a part at a time; it multiplies a part only with the queries that have its cell in reach. Vectors
    are sent once to each share, queries once, and a query's results are one share's.
    """
    bounded = cut_lineage(bounded)
    # A query takes its vector, twice k results and a bit for each cell. More shares than cores would only repeat vectors.
    count, width = bounded.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    held = count * (8 * width + 64 * k + len(cells.centers) // 8 + 100)
    shares = max(placed.sparkSession.sparkContext.defaultParallelism, -(-held // SHARE_BYTES))
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    vectors = placed.select(every, F.lit(1).alias("kind"), "cell", "part", "away", "vec_id", "label", F.col("u").alias("v"))
    share = F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int").alias("share")
    queries = bounded.select(share, F.lit(0).alias("kind"), F.lit(-1).alias("cell"), F.lit(-1).alias("part"), "query_id", "reach", F.col("q").alias("v"))
    dealt = queries.unionByName(vectors, allowMissingColumns=True).repartitionById(shares, "share")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wait, at, part = [], None, None, []
        for batch in _sliced(batches):
            keys = np.stack([batch.column(n).to_numpy() for n in ("kind", "cell", "part")])
            cuts = (np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist()
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                key, rows = tuple(keys[:, start].tolist()), batch.slice(start, stop - start)
                if key[0] == 0:
                    asked.append(rows)
                    continue
                if not asked:
                    continue
                wait = wait or _Asked(asked, cells, k)
                if key != at:
                    if part:
                        wait.meet(_Part(part), at[1])
                    at, part = key, []
                part.append(rows)
        if part:
            wait.meet(_Part(part), at[1])
        if wait:
            yield from wait.found()

    kinds = {f.name: f.dataType for f in dealt.schema.fields}
    schema = StructType()
    for name in ("query_id", "vec_id", "label"):
        schema = schema.add(name, kinds[name])
    ordered = dealt.sortWithinPartitions("share", "kind", "cell", "part")
    return ordered.mapInArrow(task, schema.add("sim", DoubleType()))


class _Asked:
    """Queries of one share with their reach, which shrinks, and the best vectors found so far."""

    def __init__(self, held: list[pa.RecordBatch], cells: Cells, k: int):
        table = pa.Table.from_batches(held).combine_chunks()
        self.k, self.ids = k, table["query_id"].combine_chunks()
        self.units = np.concatenate([_matrix(rows.column("v")) for rows in held])
        self.reach = table["reach"].to_numpy().copy()
        parts = [slice(i, i + _BATCH) for i in range(0, len(self.reach), _BATCH)]
        self.cells, wanted = cells, []
        for p in parts:
            away = cells.distances(self.units[p])
            wanted.append(np.packbits(cells.within(away, self.reach[p]) & ~cells.first(away, k), axis=1))
        self.wanted = np.concatenate(wanted)
        self.held: list[pa.RecordBatch] = []
        self.rows = 0

    def meet(self, part: _Part, cell: int) -> None:
        rows = np.flatnonzero(self.wanted[:, cell >> 3] & (128 >> (cell & 7)))
        center = self.cells.centers[cell]
        for at in range(0, len(rows), _MET):
            some = rows[at : at + _MET]
            away = np.sqrt(np.maximum(2.0 - 2.0 * (self.units[some] @ center), 0.0))
            r, c, sims = part.nearest(self.units[some], away, self.reach[some], self.k)
            if len(r):
                arrays = [pa.array(some[r]), part.ids.take(pa.array(c)), part.labels.take(pa.array(c)), pa.array(sims[r, c])]
                self.held.append(pa.RecordBatch.from_arrays(arrays, names=["row", "vec_id", "label", "sim"]))
                self.rows += len(r)
        if self.rows > max(2 * self.k * len(self.reach), 1_000_000):
            self._merge()

    def _merge(self) -> None:
        """Only the ``k`` best of each query stay, and bound its reach."""
        if not self.held:
            return
        table = pa.Table.from_batches(self.held).combine_chunks()
        row, sim = table["row"].to_numpy(), table["sim"].to_numpy()
        ids = table["vec_id"].combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy()
        order = np.lexsort((ids, -sim, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        kth = order[place == self.k - 1]
        least = np.sqrt(np.maximum(2.0 - 2.0 * sim[kth] + 4.0 / SIM_SCALE, 0.0))
        at = row[place == self.k - 1]
        self.reach[at] = np.minimum(self.reach[at], least)
        kept = table.take(pa.array(order[place < self.k])).combine_chunks()
        self.held, self.rows = kept.to_batches(), kept.num_rows

    def found(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for batch in self.held:
            for some in _sliced([batch]):
                arrays = [self.ids.take(some.column("row")), *(some.column(n) for n in ("vec_id", "label", "sim"))]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "label", "sim"])


class _Part:
    """The vectors of one part of a cell."""

    def __init__(self, held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        self.ids, self.labels = (table[n].combine_chunks() for n in ("vec_id", "label"))
        # Ids in their order, nulls first; the sorts below are stable.
        self.order = table["vec_id"].combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy()
        self.away = table["away"].to_numpy()
        self.units = np.concatenate([_matrix(rows.column("v")) for rows in held])

    def __len__(self) -> int:
        return len(self.away)

    def best(self, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
        away, reach = asked.column("away").to_numpy(), asked.column("reach").to_numpy()
        rows, columns, sims = self.nearest(_matrix(asked.column("v")), away, reach, k)
        arrays = [asked.column("query_id").take(pa.array(rows)), self.ids.take(pa.array(columns)),
                  self.labels.take(pa.array(columns)), pa.array(sims[rows, columns])]
        return pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "label", "sim"])

    def nearest(self, units: np.ndarray, away: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and columns of the ``k`` best vectors of each query within its reach, and all similarities."""
        sims = np.floor(units @ self.units.T * SIM_SCALE + 0.5) / SIM_SCALE
        near = np.abs(away[:, None] - self.away[None, :]) <= reach[:, None] + _SLACK
        # Unit vectors within reach of each other are at least so similar.
        near &= sims >= (1.0 - reach**2 / 2.0 - _SLACK)[:, None]
        for row in np.flatnonzero(near.sum(axis=1) > k).tolist():
            found = np.flatnonzero(near[row])
            least = np.partition(sims[row, found], -k)[-k]
            found = found[sims[row, found] >= least]
            near[row] = False
            near[row, found[np.lexsort((self.order[found], -sims[row, found]))[:k]]] = True
        rows, columns = np.nonzero(near)
        return rows, columns, sims


def _directed(vectors: DataFrame) -> DataFrame:
    return vectors.filter(_length(F.col("embedding")) > 0)


def _sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH):
            yield batch.slice(at, _BATCH)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _with(batch: pa.RecordBatch, **columns: np.ndarray) -> pa.RecordBatch:
    arrays = [*batch.columns, *(pa.array(c) for c in columns.values())]
    return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *columns])


def _schema(frame: DataFrame, **columns) -> StructType:
    schema = StructType(list(frame.schema.fields))
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return schema


def vector_intents(nearest: DataFrame) -> DataFrame:
    """Score per query and label over its nearest vectors: best, mean of the five best, and number of hits."""
    best = Window.partitionBy("query_id", "label").orderBy(F.desc("sim"), "vec_id")
    return (
        nearest.withColumn("place", F.row_number().over(best))
        .groupBy("query_id", "label")
        .agg(
            F.max("sim").alias("max_sim"),
            (F.sum(F.when(F.col("place") <= 5, F.col("sim")).otherwise(0.0)) / F.least(F.lit(5), F.count(F.lit(1)))).alias("mean5"),
            F.count(F.lit(1)).alias("hits"),
        )
        .select(
            "query_id",
            "label",
            "hits",
            F.round(0.65 * F.col("max_sim") + 0.25 * F.col("mean5") + 0.10 * F.log(1 + F.col("hits")), 4).alias("score"),
        )
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _length(vector: Column) -> Column:
    return F.coalesce(
        F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(0.0)
    )


def _unit(vector: Column) -> Column:
    length = _length(vector)
    return F.transform(vector, lambda x: x.cast("double") / length)
