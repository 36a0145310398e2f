"""SimHash near-duplicates found through a table of Hamming distances to reference fingerprints.

The 64 bits are cut into five blocks. Each block has a family of references, one for every bit of the block; two
fingerprints are equally far from all references of a block only if they agree there, and every bit in which they differ
moves some coordinate. So fingerprints at three bits or fewer have equal coordinates in at least two blocks: the
coordinates of two blocks are the join key, ten keys for a fingerprint. Inside a key, pairs whose distances to the
references common to all (``PIVOTS``) differ by more than three in some coordinate are discarded, and the survivors are
verified on all bits. A table of unrelated references alone cannot be joined on: at 64 bits one coordinate passes about
half of all pairs.

Equal fingerprints are one node from the start, so groups of copies cost nothing. A crowded key gives the links of a
spanning forest instead of all its pairs; a key beyond ``HOT_KEY`` fingerprints is cut into ten finer keys of its own,
after which at most 2**23 fingerprints can share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlascope.llm.base import batched, rows_of
from charlascope.llm.components import components
from charlascope.session import cut_lineage

SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 3
BLOCKS = 5
# Fingerprints of one key up to which all its pairs are compared at once.
CROWD = 64
# Fingerprints of one key beyond which Spark cuts it into finer keys.
HOT_KEY = 20_000
# Reference fingerprints: multiples of the 64-bit golden ratio, spread over all bits.
PIVOTS = np.array([(i * 0x9E3779B97F4A7C15) & (2**64 - 1) for i in range(1, 17)], np.uint64)
# Shingles whose bits are counted at once.
SLICE = 1 << 16


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Bits set in more than half of the hashes of a text's shingles, repeats included; 0 without words."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    n, digest = max(1, len(tokens) - words + 1), xxhash.xxh64_intdigest
    ends = ends[min(words, len(ends)) - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        part = zip(starts[at : at + SLICE], ends[at : at + SLICE])
        hashes = np.array([digest(joined[s:e], SEED) for s, e in part], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = (counts * 2 > n).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, which are long columns, and fp per row; fp is a signed 64-bit number."""
    schema = pa.schema([(c, pa.int64()) for c in (*keys, "fp")])

    def task(batches):
        rows = rows_of(batches, *keys, "text:raw")
        yield from batched(((*r[:-1], _signed(fingerprint(r[-1], words))) for r in rows), schema)

    return docs.select(*keys, "text").mapInArrow(task, ", ".join(f"{c} long" for c in (*keys, "fp")))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def block_masks(mask: int, blocks: int = BLOCKS, equal: int = BLOCKS - MAX_DISTANCE) -> list[int]:
    """Masks that keep ``equal`` of ``blocks`` parts of the bits in ``mask``; three errors spare at least one of them."""
    bits = [i for i in range(64) if mask >> i & 1]
    parts = [sum(1 << i for i in bits[p::blocks]) for p in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, equal)]


FULL = (1 << 64) - 1
MASKS = block_masks(FULL)
FINE = [m | finer for m in MASKS for finer in block_masks(FULL ^ m)]


def distances(fps: np.ndarray) -> np.ndarray:
    """The table: Hamming distance of each fingerprint to each reference of ``PIVOTS``."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def survivors(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) are links: the table discards first, all bits decide."""
    near = (np.abs(table[i] - table[j]) <= MAX_DISTANCE).all(axis=1)
    near[near] = np.bitwise_count(fps[i[near]] ^ fps[j[near]]) <= MAX_DISTANCE
    return near


def forest(fps: np.ndarray, free: int) -> list[tuple[int, int]]:
    """Links that span the groups among distinct fingerprints which differ in bits of ``free`` only."""
    parent = np.arange(len(fps))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    table, links = distances(fps), []

    def visit(members: np.ndarray, bits: int) -> None:
        if len(members) <= 2048 or bits.bit_count() < 2 * BLOCKS:
            for at, one in enumerate(members[:-1]):
                rest = members[at + 1 :]
                rest = rest[parent[rest] != parent[one]]
                for other in rest[survivors(fps, table, np.full(len(rest), one), rest)]:
                    x, y = find(int(one)), find(int(other))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        links.append((int(fps[one]), int(fps[other])))
            return
        for mask in block_masks(bits):
            keys = fps[members] & np.uint64(mask)
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.diff(keys[order])) + 1
            for part in np.split(members[order], cuts):
                if len(part) > 1:
                    visit(part, bits & ~mask)

    visit(np.arange(len(fps)), free)
    return links


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_MASKED = {n: m for n, m in enumerate([*MASKS, *FINE])}


def _key_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each key, from rows sorted by key; a key may run over several batches."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def done(kind, key, fp) -> pa.RecordBatch:
        links: list[tuple[int, int]] = []
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(key) != 0) | (np.diff(kind) != 0))))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        group = np.repeat(np.arange(len(starts)), sizes)
        small = sizes <= CROWD
        table = distances(fp)
        for step in range(1, int(sizes[small].max(initial=1))):
            i = np.flatnonzero((group[:-step] == group[step:]) & small[group[:-step]])
            near = survivors(fp, table, i, i + step)
            links.extend(zip(fp[i[near]].view(np.int64).tolist(), fp[i[near] + step].view(np.int64).tolist()))
        for g in np.flatnonzero(~small):
            part = slice(starts[g], starts[g] + sizes[g])
            free = FULL ^ _MASKED[int(kind[starts[g]])]
            links.extend((_signed(a), _signed(b)) for a, b in forest(np.unique(fp[part]), free))
        return pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], schema=_LINKS
        )

    for batch in batches:
        kind, key, fp = (np.asarray(batch.column(c)) for c in ("kind", "key", "fp"))
        if not len(kind):
            continue
        fp = fp.view(np.uint64)
        change = np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0))
        same = held and held[-1][0][-1] == kind[0] and held[-1][1][-1] == key[0]
        if held and not same:
            yield done(*(np.concatenate(x) for x in zip(*held)))
            held = []
        if len(change):
            cut = change[-1] + 1
            held.append((kind[:cut], key[:cut], fp[:cut]))
            yield done(*(np.concatenate(x) for x in zip(*held)))
            held = [(kind[cut:], key[cut:], fp[cut:])]
        else:
            held.append((kind, key, fp))
    if held:
        yield done(*(np.concatenate(x) for x in zip(*held)))


def _keyed(fps: DataFrame, masks: dict[int, int]) -> DataFrame:
    """One row per fingerprint and mask; ``key`` holds the coordinates in the mask's blocks.

    A block's references are zero and each single bit of the block. The distance to bit i differs from that to zero by
    minus one if bit i is set, else by one, so the coordinates are written as the bits they stand for.
    """
    keys = F.array(
        *[
            F.struct(F.lit(n).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for n, m in masks.items()
        ]
    )
    return fps.select("fp", F.explode(keys).alias("k")).select("k.kind", "k.key", "fp")


def near_links(fps: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Links ``(a, b)`` that connect distinct fingerprints ``fp`` at ``MAX_DISTANCE`` bits or fewer."""
    keyed = _keyed(fps, {n: _MASKED[n] for n in range(len(MASKS))})
    sizes = keyed.groupBy("kind", "key").count()
    hot = cut_lineage(sizes.where(F.col("count") > hot_key).select("kind", "key"))
    if hot.isEmpty():
        return _linked(keyed)
    crowded = keyed.join(hot, ["kind", "key"], "left_semi")
    per = len(FINE) // len(MASKS)
    finer = F.explode(F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.col("kind") * per + i))
    masks = F.array(*[F.lit(_signed(m)) for m in FINE])
    fine = crowded.select("fp", finer.alias("n")).select(
        (F.col("n") + len(MASKS)).alias("kind"),
        F.col("fp").bitwiseAND(F.get(masks, F.col("n"))).alias("key"),
        "fp",
    )
    return _linked(keyed.join(hot, ["kind", "key"], "left_anti").unionByName(fine))


def _linked(keyed: DataFrame) -> DataFrame:
    dealt = keyed.repartition("kind", "key").sortWithinPartitions("kind", "key", "fp")
    return dealt.mapInArrow(_key_links, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row: the smallest doc_id reachable over links of equal or near fingerprints.

    A text without words, null or empty, has fingerprint zero and links like any other; a text of fewer than ``words``
    words is one shingle. Repeated rows stay rows of their own and share a component. A null doc_id keeps its row; it
    names a component only if no linked row has an id. Other columns are ignored; an empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, words))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    placed = _rooted(nodes)
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = placed.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def _rooted(nodes: DataFrame) -> DataFrame:
    """``nodes``, one row per fingerprint ``fp``, with the smallest fingerprint reachable as ``root``."""
    roots = components(near_links(nodes.select("fp")))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return placed.withColumn("root", F.coalesce("root", "fp"))


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each component of ``docs``, its columns unchanged, whatever their names.

    The row with the smallest doc_id stays; rows without an id come last, equal ids are ordered by a hash of the text, and
    rows that agree in both are copies of which any one stays. A row is told from others by a key of its own, so repeated
    ids with different texts lose nothing but near copies. Texts without words are one component. An empty table stays empty.
    """
    key = "row_key"
    while key.lower() in {c.lower() for c in docs.columns}:
        key += "_"
    stored = cut_lineage(docs.withColumn(key, F.monotonically_increasing_id()))
    keyed = stored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("digest"),
        F.col(key).alias("row"),
        "text",
    )
    prints = fingerprints(keyed, words, ("doc_id", "digest", "row"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "row")
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min(order).alias("first")))
    kept = _rooted(nodes).groupBy("root").agg(F.min("first").alias("first"))
    return stored.join(kept.select(F.col("first.row").alias(key)), key, "left_semi").select(*docs.columns)
