"""Near-equal lines, found by SimHash blocks and verified by edit similarity. Built-in functions only.

Lines are normalised (lower case, runs of letters and digits joined by one space), equal ones are one line from the start.
A line's SimHash counts, by one aggregation, the bits of the hashes of its words, each weighted by its length: long words tell
lines of one language apart, short ones are in all of them. Two hashes at ``MAX_BITS`` bits or fewer agree in at least two of
seven blocks, so two blocks at a time are the join key. A link needs that and an edit similarity of ``SIMILARITY`` or more;
how many pairs of that similarity are linked is measured in the README.

Crowded keys do not give all their pairs. Every member is first compared with the key's smallest hash; the links found
merge most of a crowd, and only members of different groups are then compared with each other. No group that the links
of all pairs would form is lost.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charlascope.llm.components import components
from charlascope.session import cut_lineage

MAX_BITS = 5
BLOCKS = 7
SIMILARITY = 0.8
# Most that a word weighs; a word of up to four letters weighs 1, each further letter 1 more.
MOST_WEIGHT = 8
# Words of a line whose counters of four bits share a 64-bit number; longer lines are counted again with wider ones. Their
# weights must stay below 2**15.
PART_WORDS = 4_088
# Neighbouring words that one row of the count holds; divides PART_WORDS.
STEP_WORDS = 8
# Edits tried first: a narrow band proves most links of long lines without the full table.
NARROW_EDITS = (8, 40, 200, 1000)
# Characters that equal beginnings and ends of two lines are shortened by before their edits are counted, most first.
EQUAL_ENDS = tuple(1 << k for k in range(14, 2, -1))
# Bytes of line numbers and digests that may be broadcast to the scan of the texts; more are joined by shuffle.
BROADCAST_BYTES = 32_000_000

_BETWEEN = r"[^\p{L}\p{N}]+"


def normalized(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), _BETWEEN, " "))


def _words(line: Column) -> Column:
    """The words of the normalised line."""
    return F.array_remove(F.split(F.lower(line), _BETWEEN, -1), "")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def block_masks() -> list[int]:
    parts = [sum(1 << i for i in range(p, 64, BLOCKS)) for p in range(BLOCKS)]
    return [_signed(a | b) for a, b in combinations(parts, BLOCKS - MAX_BITS)]


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of both: repeated rows are one document and share its result."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))


def _once(value: Column) -> Column:
    """A value that is computed once per row, however often the plan above refers to it."""
    return F.explode(F.array(value))


def _counters(width: int) -> list[Column]:
    """Sums of the bits of ``h0``, ``h1``, ..., times ``w0``, ``w1``, ..., each in ``width`` bits of a 64-bit number: bits i, i + width, ... in ``c{i}``."""
    lanes = sum(1 << b for b in range(0, 64, width))

    def bits(i: int) -> Column:
        return reduce(add, [F.shiftright(f"h{k}", i).bitwiseAND(F.lit(lanes)) * F.col(f"w{k}") for k in range(STEP_WORDS)])

    return [F.sum(bits(i)).alias(f"c{i}") for i in range(width)]


def _majority(width: int) -> Column:
    """Bits set in more than half of the weight ``n``.

    Each counter gets its distance to the half of n added, so that its last bit but one tells the majority.
    """
    lanes = sum(1 << b for b in range(0, 64, width))
    rest = (F.lit((1 << (width - 2)) - 1) - F.shiftright("n", 1)) * F.lit(lanes)
    out = F.lit(0).cast("long")
    for i in range(width):
        top = F.shiftrightunsigned(F.col(f"c{i}") + rest, width - 2).bitwiseAND(F.lit(lanes))
        out = out.bitwiseOR(F.shiftleft(top, i))
    return out


def _counted(documents: DataFrame, width: int, part_words: int) -> DataFrame:
    """uid, doc_id, line_no, node, part and the hash of that part of a line's words."""
    lines = documents.select("uid", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    place = ("uid", "doc_id", "line_no")
    split = lines.select(*place, _once(_words(F.col("line"))).alias("words")).where(F.size("words") > 0)
    keyed = split.select(*place, "words", _once(F.md5(F.array_join("words", " "))).alias("digest"))
    halves = [F.conv(F.substr("digest", F.lit(at), F.lit(16)), 16, -10).cast("long") for at in (1, 17)]
    keyed = keyed.select(*place, "words", F.size("words").alias("size"), F.array(*halves).alias("node"))
    steps = keyed.select(*place, F.col("node")[0].alias("n0"), F.col("node")[1].alias("n1"), "words", "size",
                         F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(STEP_WORDS))).alias("pos"))
    part = F.floor(F.col("pos") / part_words).cast("int").alias("part")
    words = [F.get("words", F.col("pos") + k) for k in range(STEP_WORDS)]
    hashes = [F.xxhash64(w).alias(f"h{k}") for k, w in enumerate(words)]
    weight = lambda w: F.greatest(F.lit(1), F.least(F.lit(MOST_WEIGHT), F.length(w) - 3))
    weights = [F.when(w.isNull(), 0).otherwise(weight(w)).cast("long").alias(f"w{k}") for k, w in enumerate(words)]
    hashed = steps.select(*place, "n0", "n1", part, *hashes, *weights)
    total = F.sum(reduce(add, [F.col(f"w{k}") for k in range(STEP_WORDS)])).alias("n")
    counted = hashed.groupBy(*place, "n0", "n1", "part").agg(total, *_counters(width))
    node = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("n0", "n1")])).alias("node")
    return counted.select(*place, node, "part", _majority(width).alias("hash"))


def line_rows(docs: DataFrame) -> DataFrame:
    """uid, doc_id, line_no, node (a digest of the normalised line) and hash, for lines with a letter or digit.

    The hash is an aggregation over words: partial sums leave one row per line before the shuffle. Documents with a line
    too long for narrow counters are counted again with counters of 32 bits. Repeated rows of a document are one row here.
    """
    rows = cut_lineage(_counted(_documents(docs), 16, PART_WORDS))
    again = cut_lineage(rows.where("part > 0").select("uid").distinct())
    count = again.count()
    if not count:
        return rows.drop("part")
    few = 64 * count <= BROADCAST_BYTES
    side = F.broadcast(again) if few else again
    # Stored, as the rows are read many times and the texts must not be joined each time.
    wide = cut_lineage(_counted(_documents(docs).join(side, "uid", "left_semi"), 32, 1 << 30))
    out = rows.join(side, "uid", "left_anti").unionByName(wide).drop("part")
    return out if few else cut_lineage(out)


def _crowds(lines: DataFrame) -> DataFrame:
    """(key, hash, least): hashes that share two blocks with one at ``MAX_BITS`` bits or fewer, and the least such hash there.

    The bits outside the blocks are set in the key. Should two pairs of blocks give one key, hashes are compared in vain.
    Both sides of the join are the same rows, so that they are shuffled once; only hashes with a neighbour are stored.
    """
    keys = F.array(*[F.col("hash").bitwiseOR(F.lit(~m)) for m in block_masks()])
    keyed = lines.select("hash").distinct().select("hash", F.explode(F.array_distinct(keys)).alias("key"))
    x, y = keyed.alias("x"), keyed.alias("y")
    close = (F.col("x.hash") != F.col("y.hash")) & (_bits("x.hash", "y.hash") <= MAX_BITS)
    near = cut_lineage(x.join(y, (F.col("x.key") == F.col("y.key")) & close, "left_semi"))
    return near.withColumn("least", F.min("hash").over(Window.partitionBy("key")))


def _bits(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _middles(a: Column, b: Column) -> Column:
    """Two different lines without most of their equal beginnings and ends, as ``x`` and ``y``; as many edits apart."""
    sizes = F.array(*[F.lit(n) for n in EQUAL_ENDS])
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def start(m: Column, n: Column) -> Column:
        cut = pair(F.substr(m["x"], n + 1), F.substr(m["y"], n + 1))
        return F.when(F.left(m["x"], n) == F.left(m["y"], n), cut).otherwise(m)

    def end(m: Column, n: Column) -> Column:
        cut = pair(F.left(m["x"], F.length(m["x"]) - n), F.left(m["y"], F.length(m["y"]) - n))
        return F.when(F.right(m["x"], n) == F.right(m["y"], n), cut).otherwise(m)

    return F.aggregate(sizes, F.aggregate(sizes, pair(a, b), start), end)


def _most_edits(x: Column, y: Column) -> Column:
    """Edits that surely suffice for lines of equally many words: each word that differs is replaced. Null for other lines."""
    x, y = F.split(x, " ", -1), F.split(y, " ", -1)
    edits = F.zip_with(x, y, lambda v, w: F.when(v == w, 0).otherwise(F.greatest(F.length(v), F.length(w))))
    return F.when(F.size(x) == F.size(y), F.aggregate(edits, F.lit(0), lambda n, e: n + e))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes whose normalised lines are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("norm").alias("norm_a"))
    right = texts.select(F.col("node").alias("b"), F.col("norm").alias("norm_b"))
    size = "greatest(length(norm_a), length(norm_b))"
    allowed = f"cast(floor({1 - similarity:.6f} * {size} + 0.000001) as int)"
    short = f"abs(length(norm_a) - length(norm_b)) <= {allowed}"
    both = pairs.join(left, "a").join(right, "b").where(short)
    middles = _once(_middles(F.col("norm_a"), F.col("norm_b"))).alias("m")
    both = both.select("a", "b", F.expr(allowed).alias("most"), middles).select("a", "b", "most", "m.x", "m.y")
    proved = F.coalesce(_most_edits(F.col("x"), F.col("y")) <= F.col("most"), F.lit(False))
    narrow = " or ".join(f"({n} < most and levenshtein(x, y, {n}) >= 0)" for n in NARROW_EDITS)
    near = F.expr(f"{narrow} or levenshtein(x, y, most) >= 0")
    return both.where(proved | near).select("a", "b")


def _small(rows: DataFrame, items: str, item_bytes: int) -> bool:
    """Whether rows with a list column may be broadcast."""
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(items)), F.lit(0))).first()
    return 64 * count + item_bytes * total <= BROADCAST_BYTES


def _lookup(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts joined with one row per document; the rows are broadcast while they are small."""
    side = F.broadcast(wanted) if _small(wanted, "wanted", 40) else wanted
    return _documents(docs).join(side, ["uid"], "inner")


def groups(docs: DataFrame, lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of lines that links join with others; ``lines`` are the stored rows of ``docs``."""
    crowds = cut_lineage(_crowds(lines))
    by_hash = lines.select("hash", "node", "uid", "line_no")
    twins = by_hash.groupBy("hash").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    twins = twins.where("first < last").select("hash")
    involved = crowds.select("hash").unionByName(twins).distinct()
    one = F.min(F.struct("uid", "line_no")).alias("o")
    members = cut_lineage(by_hash.join(involved, "hash").groupBy("hash", "node").agg(one))
    texts = cut_lineage(_norms(docs, members))
    leaders = members.groupBy("hash").agg(F.min("node").alias("a"))
    stars = crowds.where("hash <> least").select("least", "hash").distinct().where(_bits("least", "hash") <= MAX_BITS)
    stars = stars.join(leaders.withColumnRenamed("hash", "least"), "least").select("a", "hash")
    stars = stars.unionByName(leaders.select("a", "hash")).join(members.select("hash", F.col("node").alias("b")), "hash")
    links = cut_lineage(_verified(stars.where("a <> b").select("a", "b").distinct(), texts, similarity))
    found = components(links)
    grouped = members.select("hash", "node").join(found, "node", "left")
    grouped = cut_lineage(grouped.select("hash", "node", F.coalesce("root", "node").alias("part")))
    more = cut_lineage(_verified(_across(crowds, grouped), texts, similarity))
    return found if more.isEmpty() else components(links.unionByName(more))


def _across(crowds: DataFrame, grouped: DataFrame) -> DataFrame:
    """Pairs of near nodes that the first links left in different groups.

    A hash meets its nodes once, with the list of its keys, of which it has as many as there are pairs of blocks at most.
    """
    keys = crowds.groupBy("hash").agg(F.collect_list("key").alias("keys"))
    listed = grouped.join(keys, "hash", "left").withColumn("keys", F.concat(F.coalesce("keys", F.array()), F.array("hash")))
    keyed = listed.select(F.explode("keys").alias("key"), "hash", "node", "part")
    x = keyed.select("key", *[F.col(c).alias(f"{c}_a") for c in ("hash", "node", "part")])
    y = keyed.select("key", *[F.col(c).alias(f"{c}_b") for c in ("hash", "node", "part")])
    apart = x.join(y, "key").where("part_a < part_b").where(_bits("hash_a", "hash_b") <= MAX_BITS)
    return apart.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _norms(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, norm): the normalised lines of the members, cut from their documents."""
    wanted = members.select("node", "o.uid", "o.line_no").groupBy("uid").agg(
        F.collect_list(F.struct("line_no", "node")).alias("wanted")
    )
    found = _lookup(docs, cut_lineage(wanted)).select(_once(F.split("text", "\n", -1)).alias("lines"), "wanted")
    one = F.transform("wanted", lambda w: F.struct(w["node"].alias("node"), F.get("lines", w["line_no"]).alias("line")))
    rows = found.select(F.explode(one).alias("w"))
    return rows.select("w.node", normalized(F.col("w.line")).alias("norm")).dropDuplicates(["node"])


def removals(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(uid, gone): numbers of the lines to drop. Of a group the occurrence with the smallest doc_id and line stays."""
    lines = line_rows(docs)
    roots = groups(docs, lines, similarity)
    placed = lines.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = placed.select("root", F.struct("doc_id", "uid", "line_no").alias("place"))
    first = placed.groupBy("root").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    shared = first.where("first < last").select("root", "first")
    gone = placed.join(shared, "root").where("place > first")
    return gone.groupBy("place.uid").agg(F.collect_set("place.line_no").alias("gone"))


def _with_gone(docs: DataFrame, similarity: float) -> DataFrame:
    """``docs`` with its lines and the numbers of those to drop, as ``__lines`` and ``__gone``."""
    gone = cut_lineage(removals(docs, similarity))
    few = _small(gone, "gone", 8)
    side = gone.select(F.col("uid").alias("__uid"), F.col("gone").alias("__gone"))
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    joined = keyed.join(F.broadcast(side) if few else side, F.col("__key") == F.col("__uid"), "left")
    return joined.select("*", _once(F.split("text", "\n", -1)).alias("__lines"))


def _kept_text() -> Column:
    numbers = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    kept = F.array_join(F.transform(numbers, lambda i: F.get("__lines", i)), "\n")
    return F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)


def drop_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with near-equal lines dropped from ``text``, all columns kept.

    Lines without a letter or digit always stay, and so does a document that loses every line, with an empty text. A null
    text has no lines and stays null. Rows with the same id and text are one document and get the same text. Rows without
    an id come first, then smaller ids. An empty table stays empty.
    """
    found = _with_gone(docs, similarity)
    return found.select(*[_kept_text().alias(c) if c == "text" else F.col(c) for c in docs.columns])


def line_counts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text_sha256 of the text left (a null text counts as empty)."""
    found = _with_gone(docs.select("doc_id", "text"), similarity)
    return found.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(_kept_text(), F.lit("")), 256).alias("text_sha256"),
    )
