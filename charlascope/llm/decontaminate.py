"""Benchmark passages in a corpus, found with a generalised suffix automaton over the words of the test items.

The automaton is built from a bounded block of items and streamed over each document's words: the longest match that ends
at each word gives every window of ``window`` words that some item holds. Tasks deal the items into blocks, and each worker
builds the automaton of one block at a time. A benchmark larger than a block is handled block by block, one pass over the
documents each; the documents are stored with a row number first, and the passes are merged by it. With one block no
document is shuffled or stored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlascope.llm.base import batched, rows_of
from charlascope.session import cut_lineage

WINDOW = 10
# Item words in one automaton: about 100 MB in a Python worker.
BLOCK_WORDS = 200_000
# A document loses its matched spans; at this share of matched words it goes altogether.
MAX_COVERAGE = 0.5
SLICE = 1 << 22

_WORD_BYTES = frozenset((*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)))
_TO_SPACE = bytes(b if b in _WORD_BYTES else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: runs of ASCII letters (lower-cased), digits and all characters beyond ASCII."""
    return text.lower().translate(_TO_SPACE).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items that hold each state's strings of ``window`` words.

    Items of fewer than ``window`` words count as one window each; items without words are left out.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.short: dict[tuple[int, ...], set[str]] = {}
        ends: dict[int, set[str]] = {}
        for item_id, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            names = {item_id} if item_id is not None else set()
            if not words:
                continue
            if len(words) < window:
                self.short.setdefault(tuple(words), set()).update(names)
            state = 0
            for word in words:
                state = self._extend(state, word)
                ends.setdefault(state, set()).update(names)
        self.short_lengths = sorted({len(s) for s in self.short})
        self.shortest = min([window, *self.short_lengths])
        self._spread(ends)

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, word, known)
        state = self._state(self.length[last] + 1, {})
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at == -1:
            self.link[state] = 0
        else:
            target = self.next[at][word]
            exact = self.length[target] == self.length[at] + 1
            self.link[state] = target if exact else self._clone(at, word, target)
        return state

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _clone(self, at: int, word: int, target: int) -> int:
        clone = self._state(self.length[at] + 1, dict(self.next[target]))
        self.link[clone], self.link[target] = self.link[target], clone
        while at != -1 and self.next[at].get(word) == target:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def _spread(self, ends: dict[int, set[str]]) -> None:
        """Item sets by state, and for each state its suffix state that stands for strings of ``window`` words."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(order):
            up = self.link[state]
            if self.length[up] >= self.window and state in ends:
                ends.setdefault(up, set()).update(ends[state])
        self.window_state = [0] * len(self.length)
        for state in order:
            up = self.link[state]
            long = self.length[up] >= self.window
            self.window_state[state] = self.window_state[up] if long else state
        self.items = {s: frozenset(n) for s, n in ends.items() if self.length[s] >= self.window}

    def ids(self, text: bytes) -> np.ndarray:
        """The text's words as vocabulary numbers, -1 for words of no item."""
        get = self.vocabulary.get
        parts = [np.array([get(w, -1) for w in words_of(s)], np.int32) for s in _slices(text)]
        return np.concatenate(parts)

    def hits(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of words inside windows, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        known = np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))
        edges = np.diff(known)
        for start, end in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
            if end - start >= self.shortest:
                self._run(ids[start:end].tolist(), int(start), spans, found)
        return spans, found

    def _run(self, run: list[int], base: int, spans: list, found: set) -> None:
        state = length = 0
        for at, word in enumerate(run):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            reach = 0
            if length >= self.window:
                reach = length
                found |= self.items.get(self.window_state[state], frozenset())
            for size in self.short_lengths:
                if size <= length and (names := self.short.get(tuple(run[at - size + 1 : at + 1]))) is not None:
                    reach = max(reach, size)
                    found |= names
            if reach:
                start, end = base + at - reach + 1, base + at + 1
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, end))


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > SLICE:
        gap = re.compile(rb"[^0-9A-Za-z\x80-\xff]").search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


HIT_COLUMNS = "row long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_HIT_SCHEMA = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", _SPANS),
        ("items", pa.list_(pa.string())),
    ]
)
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("item_id", pa.string()), ("text", pa.binary())])


def _dealt(items: DataFrame, block_words: int) -> DataFrame:
    """Items with the number of their block, dealt by tasks of some ten blocks each."""

    def task(batches):
        block, size = TaskContext.get().partitionId() << 32, 0

        def rows():
            nonlocal block, size
            for item_id, text in rows_of(batches, "item_id", "text:raw"):
                words = len(words_of(text or b""))
                if size and size + words > block_words:
                    block, size = block + 1, 0
                size += words
                yield block, item_id, text or b""

        yield from batched(rows(), _BLOCK_SCHEMA, 1024)

    held = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    n_bytes = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few = held.coalesce(1 + n_bytes // (64 * block_words))
    return few.mapInArrow(task, "block long, item_id string, text binary")


class Block:
    """Items of one block as a broadcast; the worker builds their automaton and holds no other one."""

    held: tuple[str, ItemAutomaton] | None = None

    def __init__(self, items, window: int):
        self.items, self.window, self.name = items, window, uuid.uuid4().hex

    def automaton(self) -> ItemAutomaton:
        if Block.held is None or Block.held[0] != self.name:
            Block.held = None
            Block.held = self.name, ItemAutomaton(self.items.value, self.window)
        return Block.held[1]


def blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[Block]:
    """The blocks of the items, at least one. The driver hands on the texts of one block at a time."""
    context = items.sparkSession.sparkContext
    stored = cut_lineage(_dealt(items, block_words))
    out = []
    for (number,) in stored.select("block").distinct().orderBy("block").collect():
        rows = stored.where(F.col("block") == number).select("item_id", "text").collect()
        out.append(Block(context.broadcast([(r["item_id"], bytes(r["text"])) for r in rows]), window))
    return out or [Block(context.broadcast([]), window)]


def find_windows(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per document: doc_id, n_words, spans of words inside item windows, items whose windows occur.

    Null and empty texts have no words; null and empty items no windows. An item without an id marks words but is not
    listed. Repeated rows and rows without an id give a row each. Other columns are ignored. Without items every document
    is clean.
    """
    held = blocks(items, window, block_words)
    rows = docs.select("doc_id", "text")
    if len(held) == 1:
        return _pass(rows.withColumn("row", F.lit(0).cast("long")), held[0]).drop("row")
    return _all_passes(cut_lineage(rows.withColumn("row", F.monotonically_increasing_id())), held).drop("row")


def _all_passes(rows: DataFrame, held: list[Block]) -> DataFrame:
    """The passes over stored rows with a key ``row``, merged by it; later passes give only rows with hits."""
    merged = _pass(rows, held[0])
    for block in held[1:]:
        merged = merged.unionByName(_pass(rows, block, hits_only=True))
    grouped = merged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return grouped.withColumn("spans", _merged(F.col("spans")))


def _merged(spans):
    """Sorted spans with those that touch joined."""

    def step(held, span):
        last = F.try_element_at(held, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        touches = F.coalesce(last["end"] >= span["start"], F.lit(False))
        return F.when(touches, F.concat(F.slice(held, 1, F.size(held) - 1), F.array(joined))).otherwise(
            F.concat(held, F.array(span))
        )

    return F.aggregate(spans, F.array().cast("array<struct<start:long,end:long>>"), step)


def _pass(rows: DataFrame, block: Block, hits_only: bool = False) -> DataFrame:
    def task(batches):
        found = _found(rows_of(batches, "row", "doc_id", "text:raw"), block.automaton())
        yield from batched((f for f in found if f[3] or not hits_only), _HIT_SCHEMA, 2048)

    return rows.select("row", "doc_id", "text").mapInArrow(task, HIT_COLUMNS)


def _found(rows: Iterator[tuple], automaton: ItemAutomaton) -> Iterator[tuple]:
    for row, doc_id, text in rows:
        ids = automaton.ids(text or b"")
        spans, items = automaton.hits(ids)
        yield row, doc_id, len(ids), [{"start": a, "end": b} for a, b in spans], sorted(items)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest of ``find_windows``: counts of words and hits, items as a SHA-256 over their sorted ids."""
    hits = find_windows(docs, items, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_windows(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Documents without benchmark passages: matched spans are cut out, with their surroundings left as they are.

    A document whose matched words reach ``max_coverage`` of all its words is dropped. Clean documents keep their text,
    byte for byte, and every document keeps its other columns. Null texts stay null.
    """
    held = blocks(items, window, block_words)
    place, columns = docs.columns.index("text"), docs.columns
    many = len(held) > 1
    if many:
        stored = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()))
        rows = stored.select(F.col("__row").alias("row"), F.lit(None).cast("long").alias("doc_id"), "text")
        hits = _all_passes(rows, held).where(F.size("spans") > 0)
        hits = hits.select(F.col("row").alias("__row"), F.col("n_words").alias("__words"), F.col("spans").alias("__spans"))
        given = stored.join(hits, "__row", "left").select(*columns, "__words", "__spans")
    else:
        given = docs

    def matches(batch):
        if many:
            for text, n_words, spans in rows_of(iter([batch]), "text", "__words", "__spans"):
                yield text, [(s["start"], s["end"]) for s in spans or ()], n_words
            return
        automaton = held[0].automaton()
        for (text,) in rows_of(iter([batch]), "text"):
            ids = automaton.ids((text or "").encode())
            yield text, automaton.hits(ids)[0], len(ids)

    def task(batches):
        for batch in batches:
            keep, texts = [], []
            for i, (text, spans, n_words) in enumerate(matches(batch)):
                left = text if text is None else _without(text, spans, n_words, max_coverage)
                if left is not None or text is None:
                    keep.append(i)
                    texts.append(left)
            out = batch.select(columns).take(pa.array(keep, pa.int64()))
            yield out.set_column(place, out.schema.field(place), pa.array(texts, out.schema.field(place).type))

    return given.mapInArrow(task, docs.schema)


def _without(text: str, spans: list[tuple[int, int]], n_words: int, max_coverage: float) -> str | None:
    data = text.encode()
    hit = {at for start, end in spans for at in range(start, end)}
    if not hit:
        return text
    if len(hit) >= max_coverage * n_words:
        return None
    kept, at, start = [], 0, None
    for number, word in enumerate(_WORD.finditer(data.lower())):
        if number in hit and start is None:
            kept.append(data[at : word.start()])
            start = number
        if number in hit:
            at = word.end()
        else:
            start = None
    kept.append(data[at:])
    return b"".join(kept).decode()
