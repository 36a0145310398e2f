"""Nearest vectors by cosine: one navigable small-world graph per shard, stored as flat neighbour arrays.

Distinct vectors are dealt over shards; each shard's task builds a hierarchical graph and stores it as one row of flat
arrays (ids, vectors, levels, neighbours). Every query is searched in every shard, the shards' finds are merged, and the
merged candidates are scored again on the original vectors in double precision. The number of shards follows the
cluster's cores until shards reach ``SHARD_VECTORS``, so the work of a search grows with the queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from charlascope.llm.base import batched
from charlascope.session import cut_lineage

NEIGHBOURS = 5
QUERY_MODULUS = 50
# Links of a vector on upper levels (twice as many on the lowest), and candidates held while building and searching.
LINKS = 16
BUILD_WIDTH = 80
SEARCH_WIDTH = 128
# Vectors of a shard at most: with 64 components about 100 MB in a task.
SHARD_VECTORS = 250_000
SEED = 11


class Graph:
    """A hierarchical small-world graph over unit vectors; nearness is the inner product."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS):
        self.vectors, self.links = vectors, links
        n = len(vectors)
        rng = np.random.default_rng(SEED)
        self.levels = np.minimum((-np.log(1 - rng.random(n)) / math.log(links)).astype(int), 12)
        self.near: list[list[list[int]]] = [[[] for _ in range(k + 1)] for k in self.levels]
        self.entry = 0
        for i in range(1, n):
            self._insert(i)

    def _descend(self, q: np.ndarray, at: int, level: int) -> int:
        best = float(self.vectors[at] @ q)
        while True:
            around = self.near[at][level]
            if not around:
                return at
            sims = self.vectors[around] @ q
            k = int(sims.argmax())
            if sims[k] <= best:
                return at
            at, best = around[k], float(sims[k])

    def _search(self, q: np.ndarray, start: int, level: int, width: int) -> list[tuple[float, int]]:
        """The ``width`` nearest reached from ``start``, as a heap of (nearness, number)."""
        first = float(self.vectors[start] @ q)
        seen = {start}
        open_, best = [(-first, start)], [(first, start)]
        while open_:
            nearness, at = heapq.heappop(open_)
            if -nearness < best[0][0] and len(best) >= width:
                break
            fresh = [x for x in self.near[at][level] if x not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for sim, x in zip((self.vectors[fresh] @ q).tolist(), fresh):
                if len(best) < width:
                    heapq.heappush(best, (sim, x))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, x))
                else:
                    continue
                heapq.heappush(open_, (-sim, x))
        return best

    def _chosen(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Near vectors in different directions first; the rest fills up."""
        order = [x for _, x in sorted(found, reverse=True)]
        sims = dict((x, s) for s, x in found)
        cross = self.vectors[order] @ self.vectors[order].T
        kept: list[int] = []
        for k, x in enumerate(order):
            if len(kept) == most:
                break
            if not kept or cross[k, kept].max() < sims[x]:
                kept.append(k)
        out = [order[k] for k in kept]
        out.extend([x for x in order if x not in set(out)][: most - len(out)])
        return out

    def _insert(self, i: int) -> None:
        q, top, at = self.vectors[i], int(self.levels[i]), self.entry
        highest = int(self.levels[self.entry])
        for level in range(highest, top, -1):
            at = self._descend(q, at, level)
        for level in range(min(top, highest), -1, -1):
            found = self._search(q, at, level, BUILD_WIDTH)
            most = self.links * (2 if level == 0 else 1)
            self.near[i][level] = self._chosen(found, self.links)
            for x in self.near[i][level]:
                back = self.near[x][level]
                back.append(i)
                if len(back) > most:
                    sims = self.vectors[back] @ self.vectors[x]
                    self.near[x][level] = self._chosen(list(zip(sims.tolist(), back)), most)
            at = max(found)[1]
        if top > highest:
            self.entry = i

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Neighbour numbers of all vectors and levels in one array, and where each list ends."""
        lists = [around for levels in self.near for around in levels]
        ends = np.cumsum([len(x) for x in lists])
        return np.array([x for around in lists for x in around], np.int32), ends.astype(np.int64)

    @classmethod
    def of(cls, vectors: np.ndarray, levels: np.ndarray, neighbours: np.ndarray, ends: np.ndarray, entry: int) -> Graph:
        graph = cls.__new__(cls)
        graph.vectors, graph.levels, graph.entry, graph.links = vectors, levels, entry, LINKS
        lists = iter([x.tolist() for x in np.split(neighbours, ends[:-1])] if len(ends) else [])
        graph.near = [[next(lists) for _ in range(k + 1)] for k in levels.tolist()]
        return graph

    def nearest(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        at = self.entry
        for level in range(int(self.levels[at]), 0, -1):
            at = self._descend(q, at, level)
        return self._search(q, at, 0, width)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id whose vector is not null, not zero and has only finite components."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(e, lambda x: x != 0)
    return vectors.where("vec_id is not null and embedding is not null").where(~bad & some).select("vec_id", "embedding")


_DISTINCT = pa.schema([("embedding", pa.list_(pa.float32())), ("ids", pa.list_(pa.int64()))])


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """Each distinct vector with the ``keep`` smallest of its ids; no query can need more of equal ones.

    Ids are cut to ``keep`` within each batch and again in each merge, so a vector that many rows share is never gathered.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    values = pa.float64() if kind == "double" else pa.float32()
    schema = pa.schema([("embedding", pa.list_(values)), ("ids", pa.list_(pa.int64()))])

    def task(batches):
        for batch in batches:
            held: dict[bytes, list] = {}
            lists = batch.column("embedding")
            for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                vector = np.asarray(lists[i].values)
                ids = held.setdefault(vector.tobytes(), [vector])
                ids.append(vec_id)
            rows = ((v[0], sorted(v[1:])[:keep]) for v in held.values())
            yield from batched(rows, schema, 4096)

    partial = vectors.mapInArrow(task, f"embedding array<{kind}>, ids array<long>")
    salted = partial.groupBy("embedding", (F.rand(SEED) * 8).cast("int").alias("salt")).agg(_smallest("ids", keep))
    return salted.groupBy("embedding").agg(_smallest("ids", keep))


def _smallest(ids: str, keep: int):
    """The ``keep`` smallest of the ids in arrays, each of at most ``keep``."""
    return F.slice(F.array_sort(F.flatten(F.collect_list(ids))), 1, keep).alias(ids)


INDEX_COLUMNS = (
    "shard int, members array<array<long>>, vectors binary, width int, levels array<int>, neighbours array<int>, "
    "ends array<long>, entry int"
)
_INDEX = pa.schema(
    [
        ("shard", pa.int32()),
        ("members", pa.list_(pa.list_(pa.int64()))),
        ("vectors", pa.binary()),
        ("width", pa.int32()),
        ("levels", pa.list_(pa.int32())),
        ("neighbours", pa.list_(pa.int32())),
        ("ends", pa.list_(pa.int64())),
        ("entry", pa.int32()),
    ]
)


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return (wide / np.sqrt((wide**2).sum(axis=1, keepdims=True))).astype(np.float32)


def build_index(vectors: DataFrame, keep: int = NEIGHBOURS + 1, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """Graphs over all usable vectors, stored: one row per shard and vector length."""
    distinct = cut_lineage(distinct_vectors(usable(vectors), keep))
    count = distinct.count()
    cores = distinct.sparkSession.sparkContext.defaultParallelism
    shards = max(1, min(cores, count // 500), math.ceil(count / shard_vectors))
    place = F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")
    dealt = distinct.withColumn("shard", place).withColumn("width", F.size("embedding"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "width", "embedding")

    def task(batches):
        held: list = []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("shard", "width", "embedding", "ids"))):
                key = (row[0].as_py(), row[1].as_py())
                if held and held[0][0] != key:
                    yield from batched(iter([_shard(held)]), _INDEX)
                    held = []
                held.append((key, np.asarray(row[2].values), row[3].as_py()))
        if held:
            yield from batched(iter([_shard(held)]), _INDEX)

    return cut_lineage(dealt.select("shard", "width", "embedding", "ids").mapInArrow(task, INDEX_COLUMNS))


def _shard(rows: list) -> tuple:
    (shard, width), vectors = rows[0][0], np.stack([v for _, v, _ in rows])
    graph = Graph(_unit(vectors))
    neighbours, ends = graph.flat()
    stored = vectors.astype("<f8").tobytes()
    return shard, [ids for *_, ids in rows], stored, width, graph.levels, neighbours, ends, graph.entry


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows of others in double precision, safe from overflow."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max(axis=1, keepdims=True)
    return (b * a).sum(axis=1) / (math.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))


def search(index: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query row (vec_id, embedding), itself left out.

    Ties go to the smaller vec_id. Queries go to each shard in turn, behind the shard's graph in the same partition, and
    are read as a stream. Each shard hands on at most k finds of a query.
    """
    shards = index.select("shard", "width").distinct()
    asked = usable(queries).withColumn("width", F.size("embedding")).join(F.broadcast(shards), "width")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema if f.name not in ("shard", "width")]
    asked = asked.select("shard", "width", F.lit(1).alias("kind"), "vec_id", F.col("embedding").cast("array<double>"), *blank)
    none = [F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding")]
    rest = [f.name for f in index.schema if f.name not in ("shard", "width")]
    graphs = index.select("shard", "width", F.lit(0).alias("kind"), *none, *rest)
    both = graphs.unionByName(asked)
    dealt = both.repartition("shard", "width").sortWithinPartitions("shard", "width", "kind")

    def task(batches):
        yield from batched(_finds(batches, k, width), _FOUND)

    finds = dealt.mapInArrow(task, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = finds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _finds(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[tuple]:
    graph, vectors, members = None, None, None
    for batch in batches:
        column = {name: batch.column(name) for name in batch.schema.names}
        for i, kind in enumerate(column["kind"].to_pylist()):
            if kind == 0:
                size = column["width"][i].as_py()
                vectors = np.frombuffer(column["vectors"][i].as_py(), "<f8").reshape(-1, size)
                arrays = (np.asarray(column[c][i].values) for c in ("levels", "neighbours", "ends"))
                members = column["members"][i]
                graph = Graph.of(_unit(vectors), *arrays, column["entry"][i].as_py())
                continue
            query = np.asarray(column["embedding"][i].values)
            own = column["vec_id"][i].as_py()
            near = np.array([x for _, x in graph.nearest(_unit(query[None])[0], width)])
            scores = cosine(query, vectors[near])
            found = [(-s, v) for s, x in zip(scores.tolist(), near.tolist()) for v in members[x].as_py() if v != own]
            for score, vec_id in heapq.nsmallest(k, found):
                yield own, vec_id, -score


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, modulus: int = QUERY_MODULUS) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by ``modulus``, among all other rows.

    Vectors null, zero or with null or non-finite components, and rows without an id, take no part. Vectors of different
    lengths are never compared. Ids are expected to be unique: a repeated query id is searched once per row, and its rows
    share the k places. An empty table gives no rows.
    """
    queries = vectors.where(F.col("vec_id") % modulus == 0)
    return search(build_index(vectors, k + 1), queries, k)
