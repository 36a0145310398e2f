"""Order MinHash fingerprints: sketches of a text that follow edit distance. Built-in functions only.

A text's tokens are its words, in pieces of at most sixteen characters, and single ideographs. Its k-mers are runs of
``K`` tokens, and each carries its occurrence number, so that the second use of a k-mer is another member than the first.
One hash of (k-mer, number) deals all members into ``SLOTS`` slots and orders them there; the ``KEPT`` smallest of a slot
are selected, put back into text order, and their k-mers hashed as a tuple. Texts that agree in a slot hold the same selected
members in the same order, so moved passages cost likeness as well, which sets of shingles do not notice.

All steps work on one array of 64-bit numbers per text. Values that are sorted hold a hash above and the position below, so
that arrays of plain numbers are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charlascope.session import spread, work_partitions

K = 3
KEPT = 2
SLOTS = 64
# Bits of a position, and of the hash above it. Positions beyond would reach into the hash, which stays well defined.
POS_BITS, HASH_BITS = 25, 38
_SLOT_BITS = SLOTS.bit_length() - 1
_SLOT_SHIFT = POS_BITS + HASH_BITS - _SLOT_BITS
TOKEN = r"\p{IsIdeographic}|[^\p{IsWhite_Space}\x00-\x20\p{IsIdeographic}]{1,16}"
LOWEST_ID = -(1 << 63)


def _low(value: Column, bits: int) -> Column:
    return value.bitwiseAND(F.lit((1 << bits) - 1))


def _with(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once per row, however often later expressions refer to it."""
    return frame.select("*", F.explode(F.array(value)).alias(name))


def _numbers(size: Column) -> Column:
    """0, 1, ... below ``size``."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def sketched(frame: DataFrame, text: str, out: str) -> DataFrame:
    """``frame`` with the sketch of a text column: an array of slot << 32 | tuple hash, for the slots that are not empty.

    Texts without tokens, null and empty ones included, have an empty sketch; one of fewer than ``K`` tokens has one k-mer.
    The frame must have no columns that start with two underscores.
    """
    columns = frame.columns
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    rows = _with(frame, "__hashes", F.transform(tokens, lambda t: F.xxhash64(t)))
    members = F.slice("__hashes", F.lit(1), F.greatest(F.size("__hashes") - (K - 1), F.lit(1)))
    following = [lambda i, k=k: F.get("__hashes", i + k) for k in range(1, K)]
    rows = _with(rows, "__kmers", F.transform(members, lambda h, i: F.xxhash64(h, *[f(i) for f in following])))
    packed = F.transform("__kmers", lambda h, i: F.shiftleft(_low(h, HASH_BITS), POS_BITS) + i)
    rows = _with(rows.select(*columns, "__kmers"), "__packed", packed)
    rows = _with(rows.select(*columns, "__kmers", F.sort_array("__packed").alias("__sorted")), "__starts", _starts())
    ends = lambda i: F.coalesce(F.get("__starts", i + 1), F.size("__sorted"))
    runs = F.transform("__starts", lambda start, i: F.sequence(F.lit(0), ends(i) - start - 1))
    rows = _with(rows, "__nth", F.flatten(runs))
    ranked = F.transform("__sorted", _ranked)
    rows = _with(rows.select(*columns, "__kmers", "__sorted", "__nth"), "__ranked", ranked)
    rows = rows.select(*columns, "__kmers", F.sort_array("__ranked").alias("__ranked"))
    rows = _with(rows, "__chosen", F.filter("__ranked", lambda x, i: (i < KEPT) | (_slot(x) != _slot(F.get("__ranked", i - KEPT)))))
    rows = rows.select(*columns, "__kmers", "__chosen")
    heads = F.filter(
        _numbers(F.size("__chosen")),
        lambda i: (i == 0) | (_slot(F.get("__chosen", i)) != _slot(F.get("__chosen", i - 1))),
    )
    return _with(rows, out, F.transform(heads, _entry)).select(*columns, out)


def _starts() -> Column:
    """Where the runs of equal k-mers begin in the sorted array."""
    hashed = lambda i: F.shiftrightunsigned(F.get("__sorted", i), POS_BITS)
    return F.filter(_numbers(F.size("__sorted")), lambda i: (i == 0) | (hashed(i) != hashed(i - 1)))


def _ranked(value: Column, i: Column) -> Column:
    """The rank of a numbered k-mer, its slot foremost, above its position."""
    rank = F.xxhash64(F.shiftrightunsigned(value, POS_BITS), F.get("__nth", i))
    return F.shiftleft(_low(rank, HASH_BITS), POS_BITS) + _low(value, POS_BITS)


def _slot(value: Column) -> Column:
    return F.shiftrightunsigned(value, _SLOT_SHIFT)


def _entry(head: Column) -> Column:
    """The slot whose selected members begin at ``head``, with the hash of their k-mers in text order."""
    first = F.get("__chosen", head)
    here = F.filter(F.slice("__chosen", head + 1, F.lit(KEPT)), lambda x: _slot(x) == _slot(first))
    places = F.sort_array(F.transform(here, lambda x: _low(x, POS_BITS).cast("int")))
    value = F.xxhash64(F.transform(places, lambda p: F.get("__kmers", p)))
    return F.shiftleft(_slot(first), 32) + _low(value, 32)


def likeness(a: str, b: str) -> Column:
    """Share of the slots used by either sketch in which both agree; two empty sketches are alike."""
    slots = lambda c: F.transform(c, lambda x: F.shiftrightunsigned(x, 32))
    used = F.size(F.array_union(slots(a), slots(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def fingerprint(sketch: str) -> Column:
    """A sketch as text: ten hexadecimal digits per slot, two for its number and eight for its hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint per row. Null and empty texts, and others without tokens, have an empty one."""
    rows = spread(docs.select("doc_id", F.col("text").alias("text")))
    return sketched(rows, "text", "sketch").select("doc_id", fingerprint("sketch").alias("fingerprint"))


# ---- Each document beside the next one ----


def _bounds(keys: DataFrame, buckets: int) -> list[int]:
    """About equally spaced ids in ascending order, one fewer than ``buckets``; a frequent id occurs several times."""
    shares = [i / buckets for i in range(1, buckets)]
    found = keys.agg(F.percentile_approx("key", shares, max(10_000, 20 * buckets)).alias("b")).first()["b"]
    return sorted(found or [])


def _count_below(key: Column, bounds: list[int], equal: bool) -> Column:
    """How many bounds lie below ``key``, or at it as well, found in two steps of about the root of their number each."""
    if not bounds:
        return F.lit(0)
    width = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    under = (lambda b: b <= key) if equal else (lambda b: b < key)
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    whole = F.size(F.filter(longs([g[-1] for g in groups]), under))
    inside = F.get(F.array(*[longs(g) for g in groups]), whole)
    return whole * width + F.coalesce(F.size(F.filter(inside, under)), F.lit(0))


def _bucketed(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """doc_id, text, and key, tie and bucket, of which each follows the order before it; null ids come first.

    Rows of a very frequent id are dealt over as many buckets as it has bounds, by a hash of the text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _key().alias("key"))
    rows = rows.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 11))
    rows = rows.withColumn("below", _count_below(F.col("key"), bounds, False))
    rows = rows.withColumn("at", _count_below(F.col("key"), bounds, True) - F.col("below"))
    deal = F.floor(F.col("tie") / float(1 << 53) * F.col("at"))
    return rows.withColumn("bucket", (F.col("below") + deal).cast("int")).drop("below", "at")


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST_ID).cast("long"))


def _heads(rows: DataFrame) -> DataFrame:
    """bucket, head_text: for each bucket in use the first text of the next one, for the last bucket that of the first."""
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("f"))
    # At most one row per bucket: the window over them is small, and so is the broadcast.
    all_ = Window.partitionBy(F.lit(1)).orderBy("bucket")
    circle = firsts.withColumn("before", F.coalesce(F.lag("bucket").over(all_), F.max("bucket").over(Window.partitionBy(F.lit(1)))))
    wanted = circle.select(F.col("f.key").alias("key"), F.col("f.tie").alias("tie"), F.col("before"))
    texts = rows.select("key", "tie", "text").join(F.broadcast(wanted), ["key", "tie"])
    return texts.groupBy(F.col("before").alias("bucket")).agg(F.min("text").alias("head_text"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: each document beside the next in the order of ids, the last beside the first.

    Rows without an id come first; equal ids are ordered by a hash of the text. Whole texts are shuffled once, to buckets of
    neighbouring ids.
    """
    rows = spread(docs.select("doc_id", "text"))
    bounds = _bounds(rows.select(_key().alias("key")), 2 * work_partitions(docs.sparkSession))
    rows = _bucketed(rows, bounds)
    order = Window.partitionBy("bucket").orderBy("key", "tie", "text")
    following = sketched(rows, "text", "sketch").select(
        "*", F.lead("text").over(order).alias("lead_text"), F.lead("sketch").over(order).alias("lead_sketch")
    )
    heads = sketched(_heads(rows), "head_text", "head_sketch")
    joined = following.join(heads, "bucket", "left")
    return joined.select(
        "doc_id", "text", "sketch",
        F.coalesce("lead_text", "head_text").alias("next_text"), F.coalesce("lead_sketch", "head_sketch").alias("next_sketch"),
    )


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by the start of the next document. A null text is empty. Repeated rows get
    a row each; a null doc_id keeps its row. Texts without tokens are alike. Other columns are ignored; an empty table gives
    no rows.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.substr("text", F.lit(1), F.col("n_chars").cast("int") - quarter)
    rows = _with(rows, "edited", F.concat(kept, F.substr("next_text", F.lit(1), quarter)))
    rows = sketched(rows.drop("text", "next_text"), "edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("sketch").alias("fingerprint"), fingerprint("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
    )
