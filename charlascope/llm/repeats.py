"""Long repeated passages, removed with a run-length index: a run-compressed Burrows-Wheeler transform with sampled ends.

1. Anchors. Every window of ``length`` bytes is stood for by its smallest hashed gram, so equal windows have equal grams.
   Anchors whose gram occurs once in the corpus cannot lie in a repeated window and go no further.
2. Contexts. The windows of one remaining anchor form a context. Equal contexts are kept once, marked if there are several.
3. Index. Contexts that share a gram meet in one task. It builds the transform over blocks of contexts, keeps its runs with
   the text places at their two ends, compares the neighbours at run borders, and streams the matching statistics from
   these samples: inside a run a match is one byte shorter at each step. Every place where the statistics reach
   ``length`` is marked. A context with copies enters once, and its copies count as a match of all of it. A gram with
   one distinct context has nothing else to be compared with.
4. Marks return to the documents, where the marked bytes are cut out.

A gram with more than ``HOT_GRAM`` contexts is cut into finer grams: of the bytes that a window holds beside it, half lie to
its left or to its right, so a context goes on under the gram lengthened to the left and that lengthened to the right.
This ends at grams that are whole windows, of which one context each is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlascope.llm.base import batched, rows_of
from charlascope.session import cut_lineage

LENGTH = 200
GRAM = 32
# Bytes of contexts in one block of the index; building takes about 60 bytes of memory for each.
BLOCK_BYTES = 3_000_000
# Contexts of one gram that stay together.
HOT_GRAM = 5_000
SLICE = 1 << 20

# ---- Fixed values: an odd multiplier with its inverse modulo 2**64, and a mixing multiplier ----
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_PLACE = np.uint64((1 << 21) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every gram of a byte array of at most ``SLICE`` + ``LENGTH`` bytes."""
    up, down = _power_tables(SLICE + 2 * LENGTH)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    out = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    out ^= out >> np.uint64(33)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def window_anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The place of the smallest gram (leftmost of equal ones) of every window, and all gram hashes.

    Hashes are compared by their upper bits; the lower ones hold the place. Minima of all windows come from running
    minima of blocks, forwards and backwards.
    """
    hashes, width = gram_hashes(data, gram), length - gram + 1
    n = len(data) - length + 1
    padded = np.full(-(-(n + width) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(hashes)] = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (least & _PLACE).astype(np.int64), hashes


def anchors_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, place, first window, last window) of a text's anchors, slice by slice.

    Windows at the border of two slices may give an anchor in each; both stand for other windows.
    """
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(whole) - length + 1), SLICE):
        part = whole[at : at + SLICE + length - 1]
        place, hashes = window_anchors(part, length, gram)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        last = np.concatenate((cuts[1:] - 1, [len(place) - 1]))
        yield hashes[place[cuts]].view(np.int64), place[cuts] + at, cuts + at, last + at


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes of contexts that are laid one after another, each closed by a separator of its own.

    ``text`` holds byte values plus one and 0 for separators, ``ends`` the separators' places. Sorted by seven symbols,
    then by doubling over the places that are still tied.
    """
    n, count = len(text), len(ends)
    stop = np.repeat(ends, np.diff(np.concatenate(([-1], ends)))).astype(np.int64)
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    for step in range(7):
        symbol = np.zeros(n, np.int64)
        symbol[: n - step] = text[step:]
        alive &= np.arange(n) + step <= stop
        key = (key << 9) | np.where(alive, symbol, 0)
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate(([True], np.diff(key[order]) != 0))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[ends] = np.arange(count)
    order[:count] = ends
    fresh[:count] = True
    depth = 7
    while True:
        single = fresh & np.concatenate((fresh[1:], [True]))
        tied = np.flatnonzero(~single)
        if not len(tied):
            return order
        members = order[tied]
        ahead = rank[np.minimum(members + depth, stop[members])]
        pair = rank[members] * np.int64(n + 1) + ahead
        by = np.argsort(pair, kind="stable")
        order[tied] = members[by]
        pair = pair[by]
        fresh[tied] = np.concatenate(([True], pair[1:] != pair[:-1]))
        heads = np.maximum.accumulate(np.where(fresh[tied], tied, 0))
        rank[order[tied]] = heads
        depth *= 2


class RunIndex:
    """Runs of the transform of some contexts, with the text places at both ends of every run."""

    def __init__(self, contexts: list[bytes], several: list[bool] | None = None):
        self.several = np.array(several if several else [False] * len(contexts))
        sizes = np.array([len(c) + 1 for c in contexts], np.int64)
        self.ends = np.cumsum(sizes) - 1
        joined = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
        self.text = joined.astype(np.int16) + 1
        self.text[self.ends] = 0
        order = suffix_array(self.text, self.ends)
        before = self.text[order - 1]
        head = np.concatenate(([True], before[1:] != before[:-1]))
        head |= before == 0
        head[1:] |= before[:-1] == 0
        starts = np.flatnonzero(head)
        self.symbols = before[starts]
        self.lengths = np.diff(np.concatenate((starts, [len(order)])))
        self.first, self.last = order[starts], order[starts + self.lengths - 1]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j; separators never match."""
        out = np.zeros(len(i), np.int64)
        active = np.arange(len(i))
        while len(active):
            a = self.text[i[active] + out[active]]
            same = (a == self.text[j[active] + out[active]]) & (a != 0)
            active = active[same]
            out[active] += 1
        return out

    def matching_statistics(self) -> np.ndarray:
        """For every place, the length of its longest match that starts elsewhere, as far as run borders tell.

        Both neighbours at a border are samples; from a sample the match goes on, one shorter at each place. Where the
        statistics are exact up to this, a window that occurs twice always lies in the match of some sample. A context
        that has copies stands for all of them, so its first place matches to its end.
        """
        i, j = self.last[:-1], self.first[1:]
        size = self.common(i, j)
        reach = np.arange(len(self.text), dtype=np.int64)
        np.maximum.at(reach, i, i + size)
        np.maximum.at(reach, j, j + size)
        first = np.concatenate(([0], self.ends[:-1] + 1))
        reach[first[self.several]] = self.ends[self.several]
        return np.maximum.accumulate(reach) - np.arange(len(self.text))

    def marked(self, length: int) -> list[list[tuple[int, int]]]:
        """Runs of marked bytes of each context: those inside matches of ``length`` bytes or more."""
        stats = self.matching_statistics()
        starts = np.flatnonzero(stats >= length)
        change = np.zeros(len(self.text) + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + stats[starts], -1)
        inside = np.concatenate(([0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]))
        edges = np.diff(inside)
        left, right = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        owner = np.searchsorted(self.ends, left)
        out: list[list[tuple[int, int]]] = [[] for _ in self.ends]
        base = np.concatenate(([0], self.ends[:-1] + 1))
        for o, a, b in zip(owner.tolist(), left.tolist(), right.tolist()):
            out[o].append((a - int(base[o]), b - int(base[o])))
        return out


def _keyed(docs: DataFrame) -> DataFrame:
    """uid, doc_id and text; rows with the same id and text share a uid, and so their result."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "uid", F.xxhash64("doc_id", "text")
    )


_PACKED = pa.schema([("uid", pa.int64()), ("grams", pa.binary()), ("steps", pa.binary()), ("offsets", pa.binary())])
_ANCHORS = pa.schema([("uid", pa.int64()), ("gram", pa.int64()), ("place", pa.int64())])


def packed_anchors(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """One stored row per text with anchors: their hashes, how many windows each has, and how far into its first it lies."""

    def task(batches):
        def rows():
            for uid, text in rows_of(batches, "uid", "text:raw"):
                found = list(anchors_of(text, length, gram))
                if found:
                    hashes, places, first, last = (np.concatenate(x) for x in zip(*found))
                    steps, offsets = (last - first + 1).astype(np.uint16), (places - first).astype(np.uint16)
                    yield uid, hashes.tobytes(), steps.tobytes(), offsets.tobytes()

        yield from batched(rows(), _PACKED, 1024)

    found = keyed.select("uid", "text").mapInArrow(task, "uid long, grams binary, steps binary, offsets binary")
    return cut_lineage(found)


def gram_rows(packed: DataFrame) -> DataFrame:
    """The hash of every anchor."""
    schema = pa.schema([_ANCHORS.field("gram")])

    def task(batches):
        for (grams,) in rows_of(batches, "grams"):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(grams, np.int64))], schema=schema)

    return packed.select("grams").mapInArrow(_grouped(task), "gram long")


def anchor_rows(packed: DataFrame) -> DataFrame:
    """uid, gram and place of every anchor; place holds the first window, the gram's offset there and the windows after it."""

    def task(batches):
        for uid, grams, steps, offsets in rows_of(batches, "uid", "grams", "steps", "offsets"):
            grams = np.frombuffer(grams, np.int64)
            steps, offsets = (np.frombuffer(x, np.uint16).astype(np.int64) for x in (steps, offsets))
            place = ((np.cumsum(steps) - steps) << 32) | (offsets << 16) | (steps - 1)
            arrays = [pa.array(x) for x in (np.full(len(grams), uid, np.int64), grams, place)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_ANCHORS)

    return packed.mapInArrow(_grouped(task), "uid long, gram long, place long")


def _grouped(task):
    """Small batches of a task joined into larger ones."""

    def joined(batches):
        held, rows = [], 0
        for batch in task(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= 20_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return joined


_CONTEXTS = pa.schema([("gram", pa.int64()), ("digest", pa.binary()), ("start", pa.int64()), ("size", pa.int64()),
                       ("anchor", pa.int64()), ("uid", pa.int64())])
CONTEXT_COLUMNS = "gram long, digest binary, start long, size long, anchor long, uid long"


def context_rows(held: DataFrame, length: int) -> DataFrame:
    """The contexts of the anchors in ``places`` of every stored text, as places and digests."""

    def task(batches):
        def found():
            for uid, text, places in rows_of(batches, "uid", "text:raw", "places"):
                for gram, place in {(p["gram"], p["place"]) for p in places}:
                    start, offset, more = place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF
                    size = more + length
                    yield gram, xxhash.xxh3_128_digest(text[start : start + size]), start, size, offset, uid

        yield from batched(found(), _CONTEXTS)

    return held.mapInArrow(task, CONTEXT_COLUMNS)


_TEXTS = pa.schema([("gram", pa.int64()), ("digest", pa.binary()), ("several", pa.bool_()), ("low", pa.int64()),
                    ("high", pa.int64()), ("shift", pa.int64()), ("context", pa.binary())])
TEXT_COLUMNS = "gram long, digest binary, several boolean, low long, high long, shift long, context binary"


def context_texts(held: DataFrame, chosen: DataFrame, gram: int) -> DataFrame:
    """The bytes of one occurrence of each distinct context; low and high bound the gram that it goes by."""
    row = F.struct("gram", "digest", "several", "start", "size", "anchor")
    wanted = chosen.groupBy("uid").agg(F.collect_list(row).alias("wanted"))

    def task(batches):
        def cut():
            for text, contexts in rows_of(batches, "text:raw", "wanted"):
                for c in contexts:
                    part = text[c["start"] : c["start"] + c["size"]]
                    yield c["gram"], c["digest"], c["several"], c["anchor"], c["anchor"] + gram, 0, part

        yield from batched(cut(), _TEXTS, 2048)

    return held.select("uid", "text").join(wanted, "uid").mapInArrow(task, TEXT_COLUMNS)


def _finer(length: int):
    """Contexts under their grams lengthened by half of what a window has left, to the left and to the right."""

    def task(batches):
        def lengthened():
            rows = rows_of(batches, *(f.name for f in _TEXTS))
            for _, digest, several, low, high, shift, context in rows:
                half = (length - (high - low) + 1) // 2
                for a, b in ((low - half, high), (low, high + half)):
                    if a < 0 or b > len(context):
                        continue
                    key = xxhash.xxh3_64_intdigest(context[a:b])
                    key -= (1 << 64) if key >> 63 else 0
                    if b - a == length:
                        yield key, digest, several, 0, length, shift + a, context[a:b]
                    else:
                        yield key, digest, several, a, b, shift, context

        yield from batched(lengthened(), _TEXTS, 2048)

    return task


_SPANS = pa.schema([("digest", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])


def _indexed(length: int, block_bytes: int):
    """Marked spans of contexts, from rows sorted by gram; blocks hold whole grams."""

    def task(batches):
        def marked():
            block: list[tuple] = []
            group: list[tuple] = []
            size = 0
            for row in rows_of(batches, "gram", "digest", "several", "shift", "context", "low", "high"):
                if group and group[0][0] != row[0]:
                    if len({(g[1], g[3]) for g in group}) == 1:
                        yield from _alone(group[0])
                        group = [row]
                        continue
                    extra = sum(len(g[4]) for g in group)
                    if block and size + extra > block_bytes:
                        yield from _block_spans(block, length)
                        block, size = [], 0
                    block, size, group = block + group, size + extra, []
                group.append(row)
            yield from _block_spans(block + group, length)

        yield from batched(marked(), _SPANS)

    return task


def _alone(row: tuple) -> Iterator[tuple]:
    """The only context of a gram: repeated as a whole or not at all."""
    _, digest, several, shift, context, *_ = row
    if several:
        yield digest, shift, shift + len(context)


def _block_spans(block: list[tuple], length: int) -> Iterator[tuple]:
    """Spans of the contexts of a block, each once however many grams led here; whole windows have an index apart."""
    for windows in (False, True):
        chosen = {(r[1], r[3]): r for r in block if (r[6] - r[5] == length) == windows}
        rows = list(chosen.values())
        if not rows:
            continue
        spans = RunIndex([r[4] for r in rows], [r[2] for r in rows]).marked(length)
        for (_, digest, _, shift, *_), found in zip(rows, spans):
            for a, b in found:
                yield digest, a + shift, b + shift


def _split_hot(texts: DataFrame, length: int, hot_gram: int) -> DataFrame:
    """Contexts with every gram cut finer until ``hot_gram`` contexts or fewer share it, or it is a whole window."""
    done = None
    while True:
        sizes = texts.where(F.col("high") - F.col("low") < length).groupBy("gram").count()
        hot = cut_lineage(sizes.where(F.col("count") > hot_gram).select("gram"))
        if hot.isEmpty():
            return texts if done is None else done.unionByName(texts)
        calm = texts.join(hot, "gram", "left_anti")
        done = calm if done is None else done.unionByName(calm)
        finer = texts.join(hot, "gram", "left_semi").select(*[f.name for f in _TEXTS])
        finer = finer.mapInArrow(_finer(length), TEXT_COLUMNS)
        texts = cut_lineage(_distinct_contexts(finer, length))


def _distinct_contexts(finer: DataFrame, length: int) -> DataFrame:
    """Of contexts that are whole windows and equal, two rows at most keep their text; the rest repeat the answer.

    All rows are kept, since each names its own digest and shift; equal windows are marked as several, which makes every
    one of them answer for itself without the others.
    """
    whole = F.col("high") - F.col("low") == length
    finer = finer.dropDuplicates(["gram", "digest", "shift", "low", "high"])
    counts = finer.where(whole).groupBy("gram", "context").agg(
        F.count("*").alias("n"), F.max("several").alias("any")
    )
    single = finer.where(~whole)
    windows = finer.where(whole).drop("several").join(counts, ["gram", "context"])
    salt = F.pmod(F.xxhash64("digest", "shift"), F.lit(1 << 20))
    windows = windows.withColumn("several", (F.col("n") > 1) | F.col("any"))
    windows = windows.withColumn("gram", F.xxhash64("gram", F.when(F.col("several"), salt).otherwise(F.lit(0))))
    return single.unionByName(windows.select(*[f.name for f in _TEXTS]))


_CUT = pa.schema([("uid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _without(batches):
    def cut():
        for uid, text, spans in rows_of(batches, "uid", "text:raw", "spans"):
            kept, at, removed, runs, end = [], 0, 0, 0, -1
            for s in sorted((s["low"], s["high"]) for s in spans):
                if s[0] > end:
                    runs += 1
                    kept.append(text[at : s[0]])
                low = max(s[0], at)
                if s[1] > low:
                    removed += s[1] - low
                    at = s[1]
                end = max(end, s[1])
            kept.append(text[at:])
            yield uid, removed, runs, b"".join(kept)

    yield from batched(cut(), _CUT, 512)


def cut_texts(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_gram: int = HOT_GRAM, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """uid, n_removed, n_spans and the bytes left, one row for each distinct document that loses bytes."""
    keyed = _keyed(docs)
    packed = packed_anchors(keyed, length, gram)
    # Stored, like the spans below, so that a gram or passage found everywhere is a skewed join that Spark can split.
    shared = cut_lineage(gram_rows(packed).groupBy("gram").count().where("count > 1").select("gram"))
    found = anchor_rows(packed).join(shared, "gram")
    places = found.groupBy("uid").agg(F.collect_list(F.struct("gram", "place")).alias("places"))
    held = cut_lineage(keyed.select("uid", "text").join(places, "uid"))
    contexts = cut_lineage(context_rows(held, length))
    occurrence = F.min(F.struct("uid", "start", "size", "anchor"))
    distinct = contexts.groupBy("gram", "digest").agg(occurrence.alias("o"), (F.count("*") > 1).alias("several"))
    once = held.dropDuplicates(["uid"])
    texts = cut_lineage(context_texts(once, distinct.select("gram", "digest", "several", "o.*"), gram))
    dealt = _split_hot(texts, length, hot_gram).repartition("gram").sortWithinPartitions("gram")
    spans = cut_lineage(dealt.mapInArrow(_indexed(length, block_bytes), "digest binary, low long, high long").distinct())
    placed = contexts.join(spans, "digest").select(
        "uid", F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")).alias("s")
    )
    marks = placed.groupBy("uid").agg(F.collect_set("s").alias("spans"))
    cut = once.select("uid", "text").join(marks, "uid")
    return cut.mapInArrow(_without, "uid long, n_removed long, n_spans long, kept binary")


def _counts(base: DataFrame, cut: DataFrame, *columns) -> DataFrame:
    return base.join(cut, "uid", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        *columns,
    )


def _base(docs: DataFrame) -> DataFrame:
    return _keyed(docs).select(
        "doc_id", "uid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, **limits) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left; null where nothing was removed).

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of ``length`` bytes that covers it also starts anywhere
    else, in the same document or another; strings are judged on the input. Repeated rows are places of their own, so
    their long texts go altogether. A null doc_id keeps its row. Other columns are ignored; an empty table gives no rows.
    """
    return _counts(_base(docs), cut_texts(docs, length, **limits), "kept")


def repeats_digest(docs: DataFrame, length: int = LENGTH, **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left."""
    cut = cut_texts(docs, length, **limits).select("uid", "n_removed", "n_spans", F.sha2("kept", 256).alias("left"))
    return _counts(_base(docs), cut, F.coalesce("left", "whole").alias("kept_sha256"))
