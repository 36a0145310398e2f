"""Tokens of two vocabularies aligned by bytes, and how often the corpus links each pair of ids.

A pass over the texts aligns them and counts, per task, the links of every id pair. The distinct pairs get a minimal
perfect hash: pairs are dealt into segments by their A id, and a segment's hash is a cascade of bit arrays, each holding
the pairs that fell alone into their place there, ranked by popcount. Counts are dense vectors indexed by that hash. They
are summed as a tree: the tasks' counts of a segment inside each branch first, the branches' vectors next. The hash
gives any other pair some place as well, so keys are kept in hash order and verified. A second pass aligns the texts again
and looks the counts up.

Texts are cut at single spaces between two characters that are not white space: no token of either vocabulary reaches over
such a place, so the pieces between are aligned once per task and remembered.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlascope.llm.base import rows_of
from charlascope.session import cut_lineage, spread

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
# A ids of one segment. A segment holds at most so many times the B vocabulary's pairs, 32 MB of counts at 32,000 ids.
SEGMENT_IDS = 128
# First level of the tree of sums.
BRANCHES = 8
# Pieces, and their characters, that a Python worker remembers before it starts anew; a piece takes about 350 bytes.
KNOWN_PIECES = 500_000
KNOWN_CHARS = 16_000_000
# Characters of texts that are taken up, and of new pieces that are tokenized, at once.
BATCH_CHARS = 500_000
RUN_CHARS = 20_000
# Characters of a piece that is encoded on its own, by the vocabulary's own library.
LONG_PIECE = 500
# Pairs a task counts before it hands them on.
HELD_PAIRS = 2_000_000
# Pairs whose counts one second pass holds in memory, about 14 bytes each; beyond it the texts are passed again.
PASS_PAIRS = 8_000_000
# Characters of a long text that are cut up at once.
SLICE = 1 << 20

_BREAK = re.compile(r"(?<=\S) (?=\S)")
# A space beside white space; a pattern that begins with the space is searched faster.
_BESIDE_SPACE = re.compile(r" (?:(?=\s)|(?<=\s ))")
_U64 = np.uint64


def pieces_of(text: str) -> Iterator[list[str]]:
    """Space and text, cut at single spaces, without the space that every piece begins with. Long texts come in several lists."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = cut.start() if cut else len(text)
        part = text[at:end]
        if part[0].isspace() or part[-1] == " " or _BESIDE_SPACE.search(part):
            yield [p[1:] for p in re.split(r"(?<=\S)(?= \S)", " " + part)]
        else:
            yield part.split(" ")
        at = end + 1


class Aligner:
    """Both tokenizers. A pair's key is its A id times the size of the B vocabulary plus its B id, below 2**32."""

    def __init__(self, byte_path: str, piece_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        self.b_size = self.b.get_piece_size()
        letter = {c: n for n, c in _byte_letters().items()}
        self.fast_a = _in_order(byte_path, letter)
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        if len(self.a_bytes) * self.b_size > 1 << 32:
            raise ValueError("pair keys of these vocabularies need more than 32 bits")
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        self.b_bytes = [self._piece_bytes(i) for i in range(self.b_size)]
        self.sides = [np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        names = [str(i) for i in range(max(len(self.a_bytes), self.b_size))]
        self.written = {mark: np.array([n + mark for n in names], object) for mark in ",|;"}
        self.widths = np.array([len(n) + 1 for n in names], np.int64)

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def _ids_of_a(self, text: str, long: bool) -> list[int]:
        if self.fast_a is None or long:
            return self.a.encode(text, add_special_tokens=False).ids
        return self.fast_a.encode_ordinary(text)

    def tokens(self, pieces: list[str]) -> tuple[list[str], list[str], list[int], list[int]]:
        """Pieces whose bytes both sides join to again, the others, and the ids of the former one after the other.

        Pieces that neither begin nor end with white space can follow each other in one text.
        """
        sound, bad, of_a, of_b = [], [], [], []
        runs, held, size = [], [], 0
        for piece in pieces:
            length = len(piece)
            if not length or length > LONG_PIECE or piece.strip() != piece:
                runs.append([piece])
                continue
            held.append(piece)
            size += length
            if size > RUN_CHARS:
                runs.append(held)
                held, size = [], 0
        runs += [held] if held else []
        while runs:
            texts = [" ".join(run) for run in runs]
            again = []
            for run, text, b in zip(runs, texts, self.b.encode(texts, num_threads=1)):
                a = self._ids_of_a(" " + text, max(map(len, run)) > LONG_PIECE)
                raw = b" " + text.encode()
                joined = b"".join(map(self.a_bytes.__getitem__, a)), b"".join(map(self.b_bytes.__getitem__, b))
                if joined == (raw, raw):
                    sound += run
                    of_a += a
                    of_b += b
                elif len(run) == 1:
                    bad += run
                else:
                    again += [run[: len(run) // 2], run[len(run) // 2 :]]
            runs = again
        return sound, bad, of_a, of_b

    def align(self, pieces: list[str], a: list[int], b: list[int], with_groups: bool = True) -> Aligned:
        """The tokens of sound pieces, end to end, aligned in one go: every piece ends with a token of both sides."""
        ends = np.cumsum([1 + (len(p) if p.isascii() else len(p.encode())) for p in pieces])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.sides[0][a]), np.cumsum(self.sides[1][b])
        cuts = np.union1d(end_a, end_b)
        links = a[np.searchsorted(end_a, cuts)] * self.b_size + b[np.searchsorted(end_b, cuts)]
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        each = lambda at: np.bincount(np.searchsorted(ends, at), minlength=len(pieces))
        n_a, n_b = each(end_a), each(end_b)
        found = Aligned(np.column_stack((n_a, n_b, each(shared), each(cuts))), [], links.astype(np.uint32))
        if not with_groups:
            return found
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        last_a, last_b = shared[group_a] == end_a, shared[group_b] == end_b
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        said = np.concatenate((
            np.where(last_a, self.written["|"][a], self.written[","][a]),
            np.where(last_b, self.written[";"][b], self.written[","][b]),
        ))[order]
        width = np.cumsum(np.concatenate((self.widths[a], self.widths[b]))[order])
        stops = width[np.cumsum(n_a + n_b) - 1].tolist()
        whole = "".join(said.tolist())
        found.groups = [whole[i : j - 1] for i, j in zip([0, *stops], stops)]
        return found


@dataclass
class Aligned:
    """Pieces one after the other: numbers of A and B tokens, groups and links of each, its groups as text, all links."""

    numbers: np.ndarray
    groups: list[str]
    links: np.ndarray


def _in_order(path: str, letter: dict[str, int]):
    """The same merges in a quicker encoder, if ids are in the order of merges, as they are in its rank files."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
    if spec["pre_tokenizer"].get("type") != "ByteLevel" or spec.get("normalizer"):
        return None
    if any(vocabulary.get("".join(pair)) != 256 + n for n, pair in enumerate(pairs)):
        return None
    ranks = {bytes(letter[c] for c in t): i for t, i in vocabulary.items() if all(c in letter for c in t)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [n for n in range(256) if n not in set(plain)]
    return {n: chr(n) for n in plain} | {n: chr(256 + k) for k, n in enumerate(others)}


class Memory:
    """Alignments of pieces, each made once: a slot number per piece, -1 for those whose bytes are not joined again."""

    def __init__(self, aligner: Aligner, with_groups: bool = False):
        self.aligner, self.with_groups = aligner, with_groups
        self.start_anew()

    def full(self) -> bool:
        return len(self.slots) > KNOWN_PIECES or self.chars > KNOWN_CHARS

    def start_anew(self) -> None:
        self.slots: dict[str, int] = {}
        self.groups: list[str] = []
        self.parts: list[Aligned] = []
        self.size = self.chars = 0
        self.age = object()

    def places(self, lists: list[list[str]]) -> list[np.ndarray]:
        """The slots of each list's pieces; those not known yet are aligned, together."""
        found = [np.fromiter(map(self.slots.get, pieces, repeat(-2)), np.int64, len(pieces)) for pieces in lists]
        missed = [np.flatnonzero(at == -2) for at in found]
        asked = [list(map(pieces.__getitem__, some.tolist())) for pieces, some in zip(lists, missed)]
        new = set().union(*asked)
        if new:
            self._learn(list(new))
            for at, some, pieces in zip(found, missed, asked):
                at[some] = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        return found

    def _learn(self, new: list[str]) -> None:
        self.chars += sum(map(len, new))
        sound, bad, a, b = self.aligner.tokens(new)
        self.slots.update(dict.fromkeys(bad, -1))
        if sound:
            found = self.aligner.align(sound, a, b, self.with_groups)
            self.slots.update(zip(sound, range(self.size, self.size + len(sound))))
            self.size += len(sound)
            self.groups += found.groups
            found.groups = []
            self.parts.append(found)


_held: dict[tuple, Memory] = {}


def worker_memory(paths: tuple[str, str], with_groups: bool) -> Memory:
    """The memory of a Python worker; tasks of one pass that follow each other share it."""
    if (paths, with_groups) not in _held:
        _held.clear()
        _held[paths, with_groups] = Memory(Aligner(*paths), with_groups)
    return _held[paths, with_groups]


Row = tuple
Places = Iterator[np.ndarray] | None


def placed(rows: Iterable[Row], memory: Memory, make_room: Callable[[], None]) -> Iterator[tuple[Row, Places]]:
    """Rows, whose last value is a text, with the slots of the text's pieces in order; null for texts without tokens.

    Texts come in batches whose pieces are learned together, long ones list by list. ``make_room`` empties a full memory.
    """
    held, chars = [], 0

    def settled() -> Iterator[tuple[Row, Places]]:
        if memory.full():
            make_room()
        lists = [next(pieces_of(r[-1])) if r[-1] else [] for r in held]
        for row, at in zip(held, memory.places(lists)):
            yield row, iter((at,)) if len(at) and at.min() >= 0 else None

    for row in rows:
        if row[-1] and len(row[-1]) >= SLICE:
            yield row, _long(row[-1], memory, make_room)
            continue
        held.append(row)
        chars += len(row[-1] or "")
        if chars > BATCH_CHARS:
            yield from settled()
            held, chars = [], 0
    yield from settled()


def _long(text: str, memory: Memory, make_room: Callable[[], None]) -> Places:
    def lists() -> Iterator[np.ndarray]:
        for pieces in pieces_of(text):
            if memory.full():
                make_room()
            yield memory.places([pieces])[0]

    return lists() if all(at.min() >= 0 for at in lists()) else None


# ---- Minimal perfect hash ----


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """64 mixed bits of each key, other ones at every level."""
    x = keys.astype(_U64) + _U64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words per level and all words of the cascade for distinct ``keys``."""
    sizes, words = [], []
    while len(keys):
        size = (2 * len(keys) + 63) // 64
        place = _mixed(keys, len(sizes)) % _U64(64 * size)
        alone = np.bincount(place.astype(np.int64), minlength=64 * size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        keys = keys[~alone[place.astype(np.int64)]]
    return np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, _U64)


class PairTable:
    """Counts of pairs of one or more segments, behind their hashes."""

    def __init__(self, parts: list[dict], segment_keys: int):
        self.segment_keys = segment_keys
        segments = max((p["segment"] for p in parts), default=-1) + 1
        levels = max((len(p["sizes"]) for p in parts), default=0)
        self.size = np.zeros((levels, segments), np.int64)
        self.start = np.zeros((levels, segments), np.int64)
        at, base, ranks = 0, 0, []
        for p in parts:
            n = len(p["sizes"])
            self.size[:n, p["segment"]] = p["sizes"]
            self.start[:n, p["segment"]] = at + np.cumsum(p["sizes"]) - p["sizes"]
            bits = np.bitwise_count(p["words"]).astype(np.int64)
            ranks.append(base + np.cumsum(bits) - bits)
            at += len(p["words"])
            base += int(bits.sum())
        self.words = np.concatenate([p["words"] for p in parts]) if parts else np.zeros(0, _U64)
        self.ranks = np.concatenate(ranks) if parts else np.zeros(0, np.int64)
        self.keys = np.concatenate([p["keys"] for p in parts]) if parts else np.zeros(0, np.uint32)
        self.counts = np.concatenate([p["counts"] for p in parts]) if parts else np.zeros(0, np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Index of every key; a key that no bit array claims gets -1, one that was not hashed may get any index."""
        segment = keys.astype(np.int64) // self.segment_keys
        out = np.full(len(keys), -1, np.int64)
        open_ = np.flatnonzero(segment < self.size.shape[1])
        for level in range(len(self.size)):
            size = self.size[level, segment[open_]]
            open_ = open_[size > 0]
            size = size[size > 0]
            if not len(open_):
                break
            place = (_mixed(keys[open_], level) % (size * 64).astype(_U64)).astype(np.int64)
            word = self.start[level, segment[open_]] + (place >> 6)
            bit = (place & 63).astype(_U64)
            claimed = (self.words[word] >> bit) & _U64(1) == 1
            below = self.words[word[claimed]] & ((_U64(1) << bit[claimed]) - _U64(1))
            out[open_[claimed]] = self.ranks[word[claimed]] + np.bitwise_count(below)
            open_ = open_[~claimed]
        return out

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The count of every key, 0 for those that the table does not hold."""
        place = self.places(keys)
        held = place >= 0
        held[held] = self.keys[place[held]] == keys[held]
        out = np.zeros(len(keys), np.int64)
        out[held] = self.counts[place[held]]
        return out


# ---- First pass: pairs, their hash and their counts ----

_LOCAL = pa.schema([("segment", pa.int32()), ("branch", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_LOCAL_SQL = "segment int, branch int, keys binary, counts binary"
_PART = pa.schema([("segment", pa.int32()), ("sizes", pa.binary()), ("words", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
_PART_SQL = "segment int, sizes binary, words binary, keys binary, counts binary"


class Counts:
    """Sums by pair key, in sorted arrays."""

    def __init__(self):
        self.keys, self.sums = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = np.concatenate((self.keys, keys)), np.concatenate((self.sums, counts))
        self.keys, where = np.unique(keys, return_inverse=True)
        self.sums = np.zeros(len(self.keys), np.int64)
        np.add.at(self.sums, where, counts)


def local_counts(texts: Iterable[str | None], memory: Memory) -> Iterator[Counts]:
    """Links by pair, in bounded parts."""
    held, uses = Counts(), np.zeros(0, np.int64)

    def settle() -> None:
        nonlocal uses
        first = 0
        for part in memory.parts:
            n = uses[first : first + len(part.numbers)]
            n = np.repeat(n, part.numbers[: len(n), 3])
            held.add(part.links[: len(n)][n > 0], n[n > 0])
            first += len(part.numbers)
        uses = np.zeros(0, np.int64)

    def make_room() -> None:
        settle()
        memory.start_anew()

    for _, places in placed(((t,) for t in texts), memory, make_room):
        for at in places or ():
            if memory.size > len(uses):
                uses = np.concatenate((uses, np.zeros(memory.size - len(uses), np.int64)))
            np.add.at(uses, at, 1)
        if len(held.keys) > HELD_PAIRS:
            yield held
            held = Counts()
    settle()
    yield held


def _first_pass(docs: DataFrame, paths: tuple[str, str], segment_keys: int) -> DataFrame:
    """segment, branch, keys, counts: what each task counted."""

    def task(batches):
        context = TaskContext.get()
        branch = context.partitionId() % BRANCHES if context else 0
        texts = (t for (t,) in rows_of(batches, "text"))
        for held in local_counts(texts, worker_memory(paths, False)):
            cuts = np.flatnonzero(np.diff(held.keys // segment_keys)) + 1
            keys, sums = np.split(held.keys, cuts), np.split(held.sums, cuts)
            rows = [(int(k[0]) // segment_keys, branch, k.tobytes(), s.tobytes()) for k, s in zip(keys, sums) if len(k)]
            yield _record(rows, _LOCAL)

    return docs.select("text").mapInArrow(task, _LOCAL_SQL)


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _runs(rows: Iterator[tuple], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Neighbouring rows with equal first ``width`` values, one by one."""
    from itertools import groupby

    return groupby(rows, key=lambda r: r[:width])


def _hashes(local: DataFrame) -> DataFrame:
    """segment, sizes, words, keys: the hash of each segment's distinct pairs and these in hash order."""

    def task(batches):
        for (segment,), rows in _runs(rows_of(batches, "segment", "keys"), 1):
            keys = np.zeros(0, np.uint32)
            for _, more in rows:
                keys = np.union1d(keys, np.frombuffer(more, np.uint32))
            sizes, words = build_hash(keys)
            part = {"segment": 0, "sizes": sizes, "words": words, "keys": keys, "counts": np.zeros(0, np.int64)}
            ordered = np.empty_like(keys)
            ordered[PairTable([part], 1 << 62).places(keys)] = keys
            yield _record([(segment, sizes.tobytes(), words.tobytes(), ordered.tobytes(), b"")], _PART)

    dealt = local.select("segment", "keys").repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(task, _PART_SQL)


def _part(segment: int, sizes: bytes, words: bytes, keys: bytes, counts: bytes) -> dict:
    return {
        "segment": segment,
        "sizes": np.frombuffer(sizes, np.int64),
        "words": np.frombuffer(words, "<u8"),
        "keys": np.frombuffer(keys, np.uint32),
        "counts": np.frombuffer(counts, np.int64),
    }


def _branch_sums(local: DataFrame, hashes: DataFrame) -> DataFrame:
    """segment, counts: dense vectors, one for each segment and branch, indexed by the segment's hash."""

    def task(batches):
        columns = ("segment", "branch", "kind", "sizes", "words", "keys", "counts")
        for (segment, _), rows in _runs(rows_of(batches, *columns), 2):
            _, _, _, sizes, words, keys, _ = next(rows)
            table = PairTable([_part(0, sizes, words, keys, b"")], 1 << 62)
            vector = np.zeros(len(table.keys), np.int64)
            for *_, more, counts in rows:
                vector[table.places(np.frombuffer(more, np.uint32))] += np.frombuffer(counts, np.int64)
            yield _record([(segment, vector.tobytes())], pa.schema([_PART.field("segment"), _PART.field("counts")]))

    branches = F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))).alias("branch")
    head = hashes.select("segment", branches, F.lit(0).alias("kind"), "sizes", "words", "keys", "counts")
    none = F.lit(None).cast("binary")
    body = local.select(
        "segment", "branch", F.lit(1).alias("kind"), none.alias("sizes"), none.alias("words"), "keys", "counts"
    )
    dealt = head.unionByName(body).repartition("segment", "branch").sortWithinPartitions("segment", "branch", "kind")
    return dealt.mapInArrow(task, "segment int, counts binary")


def _summed(hashes: DataFrame, sums: DataFrame) -> DataFrame:
    """The hashes with the sum of their branches' vectors as counts."""

    def task(batches):
        for (segment,), rows in _runs(rows_of(batches, "segment", "kind", "sizes", "words", "keys", "counts"), 1):
            _, _, sizes, words, keys, _ = next(rows)
            vector = np.zeros(len(keys) // 4, np.int64)
            for *_, counts in rows:
                vector += np.frombuffer(counts, np.int64)
            yield _record([(segment, sizes, words, keys, vector.tobytes())], _PART)

    none = F.lit(None).cast("binary")
    head = hashes.select("segment", F.lit(0).alias("kind"), "sizes", "words", "keys", "counts")
    body = sums.select(
        "segment", F.lit(1).alias("kind"), none.alias("sizes"), none.alias("words"), none.alias("keys"), "counts"
    )
    dealt = head.unionByName(body).repartition("segment").sortWithinPartitions("segment", "kind")
    return dealt.mapInArrow(task, _PART_SQL)


def pair_table(docs: DataFrame, paths: tuple[str, str], segment_keys: int) -> DataFrame:
    """One stored row per segment: its hash, its pairs in hash order and their counts."""
    local = cut_lineage(_first_pass(spread(docs.select("text")), paths, segment_keys))
    hashes = cut_lineage(_hashes(local))
    return cut_lineage(_summed(hashes, _branch_sums(local, hashes)))


def default_paths() -> tuple[str, str]:
    return public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)


def pair_counts(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(a_id, b_id, count) of every pair of ids that some text of ``docs`` links."""
    paths = paths or default_paths()
    b_size = Aligner(*paths).b_size
    schema = pa.schema([("a_id", pa.int32()), ("b_id", pa.int32()), ("count", pa.int64())])

    def task(batches):
        for keys, counts in rows_of(batches, "keys", "counts"):
            keys = np.frombuffer(keys, np.uint32)
            columns = (keys // b_size).astype(np.int32), (keys % b_size).astype(np.int32), np.frombuffer(counts, np.int64)
            for at in range(0, len(keys), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 65_536]) for c in columns], schema=schema)

    return pair_table(docs, paths, SEGMENT_IDS * b_size).mapInArrow(task, "a_id int, b_id int, count long")


# ---- Second pass: documents ----

_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _best(table: DataFrame, b_size: int) -> np.ndarray:
    """The highest count of every B id; as long as the B vocabulary."""
    schema = pa.schema([("b", pa.int32()), ("most", pa.int64())])

    def task(batches):
        for keys, counts in rows_of(batches, "keys", "counts"):
            b = np.frombuffer(keys, np.uint32) % b_size
            most = np.zeros(b_size, np.int64)
            np.maximum.at(most, b, np.frombuffer(counts, np.int64))
            ids = np.flatnonzero(most)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(most[ids])], schema=schema)

    found = table.select("keys", "counts").mapInArrow(task, "b int, most long").groupBy("b").agg(F.max("most").alias("most"))
    out = np.zeros(b_size, np.int64)
    for r in found.collect():
        out[r["b"]] = r["most"]
    return out


def _passes(table: DataFrame, most: int) -> list[list[int]]:
    """Segments of each second pass, together at most ``most`` pairs, or one segment alone."""
    sizes = table.select("segment", (F.octet_length("keys") / 4).cast("long").alias("n")).orderBy("segment").collect()
    passes, held = [[]], 0
    for segment, n in sizes:
        if passes[-1] and held + n > most:
            passes.append([])
            held = 0
        passes[-1].append(segment)
        held += n
    return passes


class Totals:
    """The numbers of a text from those of its pieces."""

    def __init__(self, memory: Memory, table: PairTable, best: np.ndarray, b_size: int):
        self.memory, self.table, self.best, self.b_size = memory, table, best, b_size
        self.age, self.parts, self.rows = None, 0, np.zeros((0, len(_NUMBERS)), np.int64)

    def _follow(self) -> None:
        """Look up the links of pieces that the memory has learned since."""
        if self.age is not self.memory.age:
            self.age, self.parts, self.rows = self.memory.age, 0, self.rows[:0]
        if self.parts == len(self.memory.parts):
            return
        found = [self.rows]
        for part in self.memory.parts[self.parts :]:
            counts = self.table.look_up(part.links)
            top = (counts > 0) & (counts == self.best[part.links % self.b_size])
            sizes = part.numbers[:, 3]
            starts = np.cumsum(sizes) - sizes
            sums = np.add.reduceat(top.astype(np.int64), starts), np.add.reduceat(counts, starts)
            found.append(np.column_stack((part.numbers, *sums)))
        self.rows, self.parts = np.concatenate(found), len(self.memory.parts)

    def __call__(self, rows: Iterable[Row], with_groups: bool) -> Iterator[tuple[Row, np.ndarray, str, str | None]]:
        """Each row with its text's numbers, the hash of its groups and, if wanted, the groups themselves."""
        none = np.zeros(len(_NUMBERS), np.int64)
        for row, places in placed(rows, self.memory, self.memory.start_anew):
            if places is None:
                yield row, none, "", "" if with_groups else None
                continue
            total, digest, kept = none.copy(), hashlib.sha256(), []
            for n, at in enumerate(places):
                self._follow()
                total += self.rows[at].sum(axis=0)
                groups = ";".join(map(self.memory.groups.__getitem__, at.tolist()))
                digest.update((";" + groups if n else groups).encode())
                if with_groups:
                    kept.append(groups)
            yield row, total, digest.hexdigest(), ";".join(kept) if with_groups else None


def align(
    docs: DataFrame, paths: tuple[str, str] | None = None, with_groups: bool = False, pass_pairs: int = PASS_PAIRS
) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if wanted, the groups.

    A null or empty text, and one whose tokens do not join to its bytes again, has no tokens: zeros and an empty string.
    Repeated rows are counted as often as they stand there and get a row each; a null doc_id keeps its row. Other columns
    are ignored; an empty table gives no rows.
    """
    paths = paths or default_paths()
    b_size = Aligner(*paths).b_size
    segment_keys = SEGMENT_IDS * b_size
    table = pair_table(docs, paths, segment_keys)
    context = docs.sparkSession.sparkContext
    best = context.broadcast(_best(table, b_size))
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found, passes = None, _passes(table, pass_pairs)
    for n, segments in enumerate(passes):
        rows = table.where(F.col("segment").between(segments[0], segments[-1])) if segments else table.limit(0)
        held = context.broadcast(PairTable([_part(*r) for r in rows.orderBy("segment").toLocalIterator()], segment_keys))
        last = n == len(passes) - 1
        found = _second_pass(found or texts, paths, held, best, b_size, with_groups and last, found is not None, not last)
        if not last:
            found = cut_lineage(found)
    return found


def _second_pass(texts, paths, held, best, b_size, with_groups: bool, again: bool, keep_text: bool) -> DataFrame:
    """The texts looked up in the pairs held; ``again``: the sums of earlier passes are added."""
    names = ["doc_id", *_NUMBERS, "groups_sha256", *["groups"] * with_groups, *["text"] * keep_text]
    kinds = {"doc_id": pa.int64(), "groups_sha256": pa.string(), "groups": pa.string(), "text": pa.string()}
    schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in names])
    before = ("n_best", "count_sum") if again else ()

    def task(batches):
        totals = Totals(worker_memory(paths, True), held.value, best.value, b_size)
        rows, chars = [], 0
        for (doc_id, *sums, text), numbers, digest, groups in totals(
            rows_of(batches, "doc_id", *before, "text"), with_groups
        ):
            numbers = numbers.tolist()
            if again:
                numbers[-2:] = numbers[-2] + sums[0], numbers[-1] + sums[1]
            rows.append((doc_id, *numbers, digest, *[groups] * with_groups, *[text] * keep_text))
            chars += len(text or "") if with_groups or keep_text else 0
            if len(rows) >= 4096 or chars > SLICE:
                yield _record(rows, schema)
                rows, chars = [], 0
        yield _record(rows, schema)

    sql = {pa.int64(): "long", pa.string(): "string"}
    return texts.select("doc_id", "text", *before).mapInArrow(task, ", ".join(f"{f.name} {sql[f.type]}" for f in schema))
