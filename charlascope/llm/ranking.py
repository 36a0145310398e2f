"""Ranked lexical search over posting lists with range-maximum sparse tables.

Documents are indexed in shards, each the postings that one task read in a row, so postings are never shuffled and no
term is a hot key. A posting list is a run of (document, impact) in a shard's flat arrays; a sparse table over it names the
largest impact of any range in two look-ups. A query starts with the interval of all documents of a shard. The sum of its
terms' range maxima bounds every score inside. The intervals with the largest bounds are split first, each at the document
of its largest weighted impact, which is scored; the intervals left and right of it get bounds of their own, and those
below the score of the last wanted place are dropped. Several intervals are split at a time. Shard results are merged.

Documents of a shard with equal length and equal counts of the queries' terms score alike: they are one entry.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from charlascope.llm.base import batched, rows_of
from charlascope.session import cut_lineage, spread

TOP = 20
# A shard ends with the document that reaches one of these; a sparse table takes 4 bytes a posting and level.
SHARD_POSTINGS = 1 << 20
SHARD_DOCS = 1 << 16
# Terms, with repeats, of the items that one pass over the documents serves.
PASS_TERMS = 500_000
# Intervals split at a time: few at first, then more.
FIRST_SPLITS, MOST_SPLITS = 8, 1024
SLICE = 1 << 20

# Digits, letters and all bytes of other scripts stay, letters in lower case; the rest separates.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def term_counts(text: bytes | None) -> Counter:
    """How often a text holds each term."""
    folded, found, at = (text or b"").translate(_FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


# ---- Index ----

_ARRAYS = ("terms", "df", "starts", "positions", "tfs", "lengths", "doc_starts", "doc_ids", "named")
_SHARD = pa.schema([("docs", pa.int64()), ("tokens", pa.int64()), *((a, pa.binary()) for a in _ARRAYS)])
_SHARD_SQL = ", ".join(["docs long", "tokens long", *(f"{a} binary" for a in _ARRAYS)])


class _Open:
    """A shard while it is read."""

    def __init__(self):
        self.docs = self.tokens = self.postings = 0
        self.entries: dict[bytes, int] = {}
        self.terms, self.tfs, self.lengths, self.members = [], [], [], []

    def add(self, doc_id: int | None, length: int, terms: np.ndarray, tfs: np.ndarray) -> None:
        self.docs += 1
        self.tokens += length
        if not len(terms):
            return
        order = np.argsort(terms)
        terms, tfs = terms[order], tfs[order]
        key = xxhash.xxh128_digest(terms.tobytes() + tfs.tobytes() + length.to_bytes(8, "little"))
        entry = self.entries.setdefault(key, len(self.lengths))
        if entry == len(self.lengths):
            self.terms.append(terms)
            self.tfs.append(tfs)
            self.lengths.append(length)
            self.members.append([])
            self.postings += len(terms)
        self.members[entry].append((doc_id is None, doc_id or 0))

    def full(self) -> bool:
        return self.postings >= SHARD_POSTINGS or self.docs >= SHARD_DOCS

    def row(self) -> tuple:
        """Counts and flat arrays: lists by term, each by place; places follow the entries' rarest terms."""
        if not self.lengths:
            return self.docs, self.tokens, *[b""] * len(_ARRAYS)
        sizes = np.array([len(t) for t in self.terms])
        copies = np.array([len(m) for m in self.members])
        flat, tfs = np.concatenate(self.terms), np.concatenate(self.tfs)
        seen = np.bincount(flat)
        starts = np.cumsum(sizes) - sizes
        rare = np.lexsort((flat, seen[flat], np.repeat(np.arange(len(sizes)), sizes)))
        firsts = flat[rare[starts]]
        seconds = flat[rare[np.minimum(starts + 1, starts + sizes - 1)]]
        place = np.empty(len(sizes), np.int64)
        by_place = np.lexsort((self.lengths, seconds, firsts))
        place[by_place] = np.arange(len(sizes))
        positions = np.repeat(place, sizes)
        order = np.lexsort((positions, flat))
        flat, positions, tfs = flat[order], positions[order], tfs[order]
        terms, list_starts = np.unique(flat, return_index=True)
        df = np.add.reduceat(copies[by_place][positions], list_starts)
        members = [sorted(self.members[e]) for e in by_place]
        ids = np.array([i for m in members for _, i in m], np.int64)
        named = np.array([not none for m in members for none, _ in m], np.uint8)
        doc_starts = np.concatenate(([0], np.cumsum(copies[by_place])))
        arrays = (
            terms.astype(np.int32), df.astype(np.int64), np.append(list_starts, len(flat)).astype(np.int64),
            positions.astype(np.int32), tfs.astype(np.int64), np.array(self.lengths, np.int64)[by_place],
            doc_starts.astype(np.int64), ids, named,
        )
        return self.docs, self.tokens, *(a.tobytes() for a in arrays)


_KINDS = dict(zip(_ARRAYS, (np.int32, np.int64, np.int64, np.int32, np.int64, np.int64, np.int64, np.int64, np.uint8)))


def index(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """One stored row per shard: its documents with a term, their tokens, and the postings of the terms in ``numbers``."""
    held = docs.sparkSession.sparkContext.broadcast(numbers)

    def task(batches):
        number, shard = held.value, _Open()
        for doc_id, text in rows_of(batches, "doc_id", "text:raw"):
            counts = term_counts(text)
            if not counts:
                continue
            known = [(number[t], n) for t, n in counts.items() if t in number]
            terms, tfs = np.array(known, np.int64).reshape(-1, 2).T
            shard.add(doc_id, sum(counts.values()), terms, tfs)
            if shard.full():
                yield pa.RecordBatch.from_pylist([dict(zip(_SHARD.names, shard.row()))], _SHARD)
                shard = _Open()
        if shard.docs:
            yield pa.RecordBatch.from_pylist([dict(zip(_SHARD.names, shard.row()))], _SHARD)

    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return cut_lineage(rows.mapInArrow(task, _SHARD_SQL))


def _statistics(shards: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the document frequency of every number."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def task(batches):
        for numbers, df in rows_of(batches, "terms", "df"):
            arrays = [pa.array(np.frombuffer(numbers, np.int32)), pa.array(np.frombuffer(df, np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    n, total = shards.agg(F.sum("docs"), F.sum("tokens")).first()
    out = np.zeros(terms, np.int64)
    summed = shards.select("terms", "df").mapInArrow(task, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for term, df in summed.collect():
        out[term] = df
    return n or 0, total or 0, out


# ---- Search ----


class Shard:
    """Posting lists with impacts, and a sparse table over them.

    Level k of the table names, for every posting, the one with the largest impact among the next 2**k. A range of a list
    is covered by two such runs, which lie inside the list, so one flat table serves all lists.
    """

    def __init__(self, arrays: dict[str, np.ndarray], n: int, total: int):
        self.__dict__.update(arrays)
        lengths = 75 + (25 * self.lengths * n) // total
        self.impacts = (10**9 * self.tfs) // (1000 * self.tfs + 12 * lengths[self.positions])
        self.entries = len(self.lengths)
        longest = int(np.diff(self.starts).max(initial=1))
        self.table = np.empty((longest.bit_length(), len(self.positions)), np.int32)
        self.table[0] = np.arange(len(self.positions))
        for k in range(1, len(self.table)):
            half, below = 1 << (k - 1), self.table[k - 1]
            self.table[k] = below
            a, b = below[:-half], below[half:]
            self.table[k, :-half] = np.where(self.impacts[b] > self.impacts[a], b, a)
        self.level = np.zeros(longest + 1, np.int8)
        for k in range(1, len(self.table)):
            self.level[1 << k :] = k
        which = np.repeat(np.arange(len(self.terms)), np.diff(self.starts))
        self.places = which * self.entries + self.positions

    def maxima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The posting with the largest impact in each range, -1 for empty ones."""
        size = high - low
        some = np.flatnonzero(size)
        out = np.full(size.shape, -1, np.int64)
        low, high, level = low.flat[some], high.flat[some], self.level[size.flat[some]]
        a, b = self.table[level, low], self.table[level, high - (1 << level.astype(np.int64))]
        out.flat[some] = np.where(self.impacts[b] > self.impacts[a], b, a)
        return out

    def search(self, numbers: np.ndarray, weights: np.ndarray, top: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Entries and scores: all that can be among the ``top`` documents with a score of ``least`` or more."""
        where = np.searchsorted(self.terms, numbers)
        here = np.flatnonzero((where < len(self.terms)) & (weights > 0))
        here = here[self.terms[where[here]] == numbers[here]]
        lists, weights = where[here], weights[here]
        low, high = self.starts[lists][None, :], self.starts[lists + 1][None, :]
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        open_ = self._bounded(low, high, weights, least) if len(lists) else None
        splits = FIRST_SPLITS
        while open_ is not None and len(open_[0]):
            low, high, bound, split = open_
            if len(bound) > splits:
                first = np.argpartition(-bound, splits)
                first, rest = first[:splits], first[splits:]
            else:
                first, rest = np.arange(len(bound)), np.zeros(0, np.int64)
            splits = min(2 * splits, MOST_SPLITS)
            low1, high1, at = low[first], high[first], split[first]
            cut = np.searchsorted(self.places, lists[None, :] * self.entries + at[:, None])
            hit = (cut < high1) & (cut >= low1)
            hit[hit] = self.positions[cut[hit]] == np.broadcast_to(at[:, None], hit.shape)[hit]
            impact = np.zeros(cut.shape, np.int64)
            impact[hit] = self.impacts[cut[hit]]
            found, scores = np.append(found, at), np.append(scores, impact @ weights)
            found, scores, least = self._best(found, scores, top, least)
            cut = np.clip(cut, low1, high1)
            left = self._bounded(low1, cut, weights, least)
            right = self._bounded(cut + hit, high1, weights, least)
            rest = rest[bound[rest] >= least]
            waiting = low[rest], high[rest], bound[rest], split[rest]
            open_ = tuple(np.concatenate(x) for x in zip(waiting, left, right))
        return found, scores

    def _bounded(self, low, high, weights, least):
        """The intervals that may hold a document of score ``least``: ranges of the lists, bound, and where to split."""
        best = self.maxima(low, high)
        weighted = np.where(best >= 0, self.impacts[best], 0) * weights
        bound = weighted.sum(axis=1)
        keep = np.flatnonzero(bound >= least)
        split = self.positions[best[keep, weighted[keep].argmax(axis=1)]].astype(np.int64)
        return low[keep], high[keep], bound[keep], split

    def _best(self, found, scores, top, least):
        """Entries that can still be among the first ``top`` documents, and the score that the last of these has."""
        order = np.argsort(-scores, kind="stable")
        found, scores = found[order], scores[order]
        enough = np.flatnonzero(np.cumsum(np.diff(self.doc_starts)[found]) >= top)
        if len(enough):
            least = max(least, int(scores[enough[0]]))
        keep = scores >= least
        return found[keep], scores[keep], least

    def documents(self, found, scores, top) -> list[tuple[int | None, int]]:
        """The first ``top`` documents of the entries: id and score, equal scores by id."""
        out = []
        for entry, score in zip(found.tolist(), scores.tolist()):
            part = slice(self.doc_starts[entry], min(self.doc_starts[entry + 1], self.doc_starts[entry] + top))
            out += [(-score, not named, i) for i, named in zip(self.doc_ids[part].tolist(), self.named[part].tolist())]
        return [(None if unnamed else i, -score) for score, unnamed, i in sorted(out)[:top]]


_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _searched(shards: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], n: int, total: int, top: int) -> DataFrame:
    """(row, doc_id, score): for every query what a shard may give to its first ``top`` documents."""
    held = shards.sparkSession.sparkContext.broadcast(queries)

    def rows(batches) -> Iterator[tuple]:
        least: dict[int, int] = {}
        for arrays in rows_of(batches, *_ARRAYS):
            if not arrays[0]:
                continue
            shard = Shard({a: np.frombuffer(x, _KINDS[a]) for a, x in zip(_ARRAYS, arrays)}, n, total)
            for row, numbers, weights in held.value:
                best = shard.documents(*shard.search(numbers, weights, top, least.get(row, 1)), top)
                if len(best) == top:
                    least[row] = max(least.get(row, 1), best[-1][1])
                yield from ((row, doc_id, score) for doc_id, score in best)

    return shards.select(*_ARRAYS).mapInArrow(lambda b: batched(rows(b), _FOUND), "row long, doc_id long, score long")


def _weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of ``items`` the ``top`` rows of ``docs`` with the highest score.

    Equal scores are ordered by doc_id, rows without an id last; repeated rows are documents, or items, of their own. Null
    and empty texts have no terms: such a document is never found and does not count, such an item finds nothing. Other
    columns are ignored; an empty table on either side gives no rows. ``items`` are read in blocks of about ``pass_terms``
    terms, one pass over the documents each.
    """
    spark = docs.sparkSession
    named = items.select(F.col("item_id"), "text").withColumn("row", F.monotonically_increasing_id())
    named = cut_lineage(named)

    def sizes(batches):
        for (text,) in rows_of(batches, "text:raw"):
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(term_counts(text).values())], pa.int64())})

    total = named.select("text").mapInArrow(sizes, "n long").agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // pass_terms))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    parts = [_block(docs, named.where(block == b), top) for b in range(blocks)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(named.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """What one block of items finds; its texts, at most about a pass's terms, are read by the driver."""
    counted = [(r["row"], term_counts((r["text"] or "").encode())) for r in items.select("row", "text").toLocalIterator()]
    numbers = {t: n for n, t in enumerate(sorted({t for _, c in counted for t in c}))}
    shards = index(docs, numbers)
    n, total, df = _statistics(shards, len(numbers))
    weights = _weights(df, n)
    queries = []
    for row, counts in counted:
        chosen = np.array(sorted(numbers[t] for t in counts), np.int64)
        repeats = np.array([c for _, c in sorted((numbers[t], c) for t, c in counts.items())], np.int64)
        queries.append((row, chosen, weights[chosen] * repeats))
    return cut_lineage(_searched(shards, queries, n, total, top))
