"""Sequences packed by a dot-product heuristic under limits on tokens, segments and loss-bearing tokens.

Each task packs the rows of its own input split, block by block, so nothing is shuffled. Within a block the open
sequence takes the example whose vector (tokens, one segment, loss tokens), each as a share of its limit, has the largest
dot product with what is left of the limits. When nothing fits whole, the longest example is cut so that the sequence is
full. What stays open at the end of a block is cut into sequences whose lengths are powers of two, so no id is padding.
"""

from __future__ import annotations

import string
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from charlascope.llm.base import batched, rows_of

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MAX_TOKENS = 2048
MAX_SEGMENTS = 256
# Examples and ids that a task holds while it packs a block.
BLOCK_EXAMPLES = 2048
BLOCK_IDS = 4_000_000
# Words and parts of words whose ids a Python worker keeps, twice over; about 200 bytes each.
KNOWN_WORDS = 80_000
SLICE = 1 << 20
SEQUENCE_BITS = 36

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("loss_tokens", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ]
)
COLUMNS = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "loss_tokens long, ids array<int>"
)


class WordTokenizer:
    """Ids of a text as little-endian 32-bit integers, with a memory of words.

    The vocabulary's pre-tokenizer never joins text over white space, so a text's ids are those of its words. Words of
    plain Latin letters go to the library's BPE model directly; all others through its whole chain.
    """

    _PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    _PLAIN = regex.compile(r"[\x21-\x7eÀ-įı-ž]+")
    _CONTROLS = regex.compile(r"[\x1c-\x1f]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.words = _Words(self._word, {})
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(0xC0, 0x180)}

    def __call__(self, text: str) -> bytes:
        if self._CONTROLS.search(text):
            return _packed(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(self._slice(part) for part in text_slices(text))

    def _slice(self, text: str) -> bytes:
        out = b"".join(map(self.words.__getitem__, text.split()))
        if len(self.words) >= KNOWN_WORDS:
            self.words = _Words(self._word, dict(self.words))
        return out

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._part(word.lower())
        letters = word.rstrip(string.punctuation)
        if letters.isalpha() and (letters.isascii() or self._PLAIN.fullmatch(letters)) and "<|" not in word:
            # Signs after letters are one piece.
            signs = word[len(letters) :]
            return self._part(letters.lower()) + self._part(signs) if signs else self._part(letters.lower())
        if "<|" in word or not self._PLAIN.fullmatch(word):
            return _packed(self.whole.encode(word, add_special_tokens=False).ids)
        return b"".join(map(self._part, self._PIECES.findall(word.lower())))

    def _part(self, piece: str) -> bytes:
        """Ids of a part of a word, which as a word has the same ones."""
        found = self.words.get(piece)
        if found is None:
            found = self.words[piece] = self.words.old.get(piece) or self._piece(piece)
        return found

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(mapped)])


class _Words(dict):
    """Ids of the words met since the last full memory, and of those in that one; what is still met moves on, the rest goes."""

    def __init__(self, ids: Callable[[str], bytes], old: dict[str, bytes]):
        super().__init__()
        self.ids, self.old = ids, old

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.ids(word)
        self[word] = found
        return found


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def text_slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Parts of a text cut at white space, so that a very long text is split into words part by part."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str | None = None) -> WordTokenizer:
    """One tokenizer for each path and Python worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


@dataclass
class Piece:
    """Ids ``start`` to ``start + length`` of one example; ids before ``loss_from`` bear no loss."""

    row: int
    start: int
    length: int
    loss_from: int

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.loss_from))

    def cut(self, length: int) -> tuple[Piece, Piece]:
        rest = Piece(self.row, self.start + length, self.length - length, self.loss_from)
        return Piece(self.row, self.start, length, self.loss_from), rest


def pack_block(examples: list[Piece], limits: tuple[int, int, int]) -> list[list[Piece]]:
    """Sequences for the examples of a block; every sequence is full or a power of two long.

    Limits: tokens, segments and loss-bearing tokens of a sequence; the last must be positive. Examples without ids are
    left out. Ties go to the earlier example.
    """
    pieces = [p for p in examples if p.length > 0]
    lengths = np.array([p.length for p in pieces], np.int64)
    losses = np.array([p.loss for p in pieces], np.int64)
    shares = [1.0 / limit for limit in limits]
    waiting = np.ones(len(pieces), bool)
    sequences = []
    while waiting.any():
        left, held = list(limits), []
        while left[0] > 0 and left[1] > 0 and waiting.any():
            fits = np.flatnonzero(waiting & (lengths <= left[0]) & (losses <= left[2]))
            if len(fits):
                weights = [left[0] * shares[0], left[1] * shares[1], left[2] * shares[2]]
                products = (lengths[fits] * shares[0]) * weights[0] + shares[1] * weights[1] + (losses[fits] * shares[2]) * weights[2]
                best = int(fits[np.argmax(products)])
                held.append(pieces[best])
                waiting[best] = False
                left = [left[0] - int(lengths[best]), left[1] - 1, left[2] - int(losses[best])]
                continue
            longest = int(np.argmax(np.where(waiting, lengths, -1)))
            piece = pieces[longest]
            room = min(left[0], piece.length - 1)
            if piece.start + room > piece.loss_from:
                room = min(room, max(0, piece.loss_from - piece.start) + left[2])
            if room <= 0:
                break
            head, pieces[longest] = piece.cut(room)
            held.append(head)
            lengths[longest], losses[longest] = pieces[longest].length, pieces[longest].loss
            left = [left[0] - head.length, left[1] - 1, left[2] - head.loss]
        sequences.extend(_powers(held, limits[0]))
    return sequences


def _powers(held: list[Piece], full: int) -> Iterator[list[Piece]]:
    """The pieces of one open sequence as sequences that are full or a power of two long."""
    total, queue = sum(p.length for p in held), held[::-1]
    while total:
        size = full if total >= full else 1 << (total.bit_length() - 1)
        total, out = total - size, []
        while size:
            piece = queue.pop()
            if piece.length > size:
                piece, rest = piece.cut(size)
                queue.append(rest)
            out.append(piece)
            size -= piece.length
        yield out


def _pack(
    rows: Iterator[tuple], split: int, encode: Callable[[str], tuple[bytes, int]], limits, with_ids: bool
) -> Iterator[tuple]:
    count = split << SEQUENCE_BITS
    block: list[Piece] = []
    texts: list[tuple] = []

    def emit(sequence: list[Piece]) -> Iterator[tuple]:
        nonlocal count
        offset = 0
        for p in sequence:
            doc_id, ids = texts[p.row]
            part = ids[4 * p.start : 4 * (p.start + p.length)]
            values = np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None
            yield doc_id, p.start, p.length, zlib.crc32(part), len(ids) // 4, count, offset, p.loss, values
            offset += p.length
        count += 1

    held = 0
    for doc_id, text in rows:
        ids, loss_from = encode(text or "")
        texts.append((doc_id, ids))
        piece = Piece(len(texts) - 1, 0, len(ids) // 4, loss_from)
        held += piece.length
        while piece.length >= limits[0]:
            head, piece = piece.cut(limits[0])
            if head.loss <= limits[2]:
                yield from emit([head])
            else:
                block.append(head)
        block.append(piece)
        if len(block) >= BLOCK_EXAMPLES or held >= BLOCK_IDS:
            for sequence in pack_block(block, limits):
                yield from emit(sequence)
            block, texts, held = [], [], 0
    for sequence in pack_block(block, limits):
        yield from emit(sequence)


def pack_documents(
    docs: DataFrame,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss_tokens: int = MAX_TOKENS,
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, ids.

    ``max_tokens`` must be a power of two. Each row is a document of its own, repeated rows and null ids included; a
    null or empty text is the end id alone. The first id of a document bears no loss. Columns other than doc_id and text
    are ignored. An empty table gives no pieces. ``ids`` is null if not wanted (``with_ids``).
    """
    if max_tokens & (max_tokens - 1) or min(max_segments, max_loss_tokens) < 1:
        raise ValueError("max_tokens must be a power of two, the other limits positive")
    limits, end = (max_tokens, max_segments, max_loss_tokens), _packed([end_id])

    def task(batches):
        encode = tokenizer(tokenizer_path)
        rows = rows_of(batches, "doc_id", "text")
        packed = _pack(rows, TaskContext.get().partitionId(), lambda text: (encode(text) + end, 1), limits, with_ids)
        yield from batched(packed, SCHEMA, 512)

    return docs.select("doc_id", "text").mapInArrow(task, COLUMNS)
