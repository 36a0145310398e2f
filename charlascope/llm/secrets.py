"""Secrets in texts, by a trigram inverted index and regular expressions. Built-in functions only.

For every rule a Boolean trigram query is derived from its regular expression: alternatives, each a set of trigrams; every
match holds all of one of them. The index keeps postings (trigram, document) of the trigrams that some query names. Postings of an
alternative are intersected by counting, candidates are read again and verified with the regular expression. A rule that
has no mandatory trigram is matched against every text in the same pass that makes the postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charlascope.llm.trigrams import trigram_query
from charlascope.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """A pattern in the syntax that Java and Python share. ``group`` and ``least``: code points this group must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    def trigrams(self) -> list[tuple[str, ...]]:
        """The Boolean query: any of these sets must be there whole. Empty if no trigram is mandatory."""
        return trigram_query(self.pattern)


# ---- Fixed values: patterns of secrets; the first three are the base kinds ----
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6, True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
BASE = tuple(r.kind for r in RULES if r.base)


def _places(rule: Rule) -> Column:
    """Array of (piece length, match length, length of the tested group) for all matches, from left to right.

    Splitting by the pattern gives the text between the matches; with the matches' own lengths it gives their places.
    """
    pattern = F.lit(rule.pattern)
    pieces = F.split(F.col("text"), rule.pattern, -1)
    matches, tested = F.regexp_extract_all("text", pattern, 0), F.regexp_extract_all("text", pattern, rule.group)
    sizes = F.arrays_zip(
        F.transform(pieces, lambda x: F.length(x).cast("long")).alias("gap"),
        F.transform(matches, lambda x: F.length(x).cast("long")).alias("size"),
        F.transform(tested, lambda x: F.length(x)).alias("tested"),
    )
    return F.filter(sizes, lambda x: x["size"].isNotNull())


def _match_rows(texts: DataFrame, rule: Rule) -> DataFrame:
    """uid, doc_id, kind, ord and the lengths of every match of a rule."""
    hit = texts.where(F.col("text").rlike(rule.pattern))
    rows = hit.select("uid", "doc_id", F.posexplode(_places(rule)).alias("ord", "m"))
    return rows.select(
        "uid", "doc_id", F.lit(rule.kind).alias("kind"), "ord", "m.gap", "m.size",
        (F.col("m.tested") >= rule.least).alias("holds"),
    )


def _spans(matches: DataFrame) -> DataFrame:
    """uid, doc_id, kind, start, end of the matches that hold, in code points."""
    before = Window.partitionBy("uid", "doc_id", "kind").orderBy("ord")
    ends = F.sum(F.col("gap") + F.col("size")).over(before)
    placed = matches.withColumn("end", ends).withColumn("start", F.col("end") - F.col("size"))
    return placed.where("holds").select("uid", "doc_id", "kind", "start", "end")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of both: repeated rows share it, and so share their result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))


def _trigram_rows(rules: tuple[Rule, ...]) -> list[tuple[str, int, str, int]]:
    return [
        (rule.kind, number, trigram, len(chosen))
        for rule in rules
        for number, chosen in enumerate(rule.trigrams())
        for trigram in chosen
    ]


def _any_of(trigrams: list[str]) -> str:
    """A pattern for any of these, letters in either case, by first, second and then third characters."""
    spelled = lambda c: c + c.upper() if c.isalpha() else c if c.isdigit() else "\\" + c
    firsts: dict[str, dict[str, str]] = {}
    for a, b, c in trigrams:
        seconds = firsts.setdefault(a, {})
        seconds[b] = seconds.get(b, "") + spelled(c)
    return "|".join(
        f"[{spelled(a)}](?:{'|'.join(f'[{spelled(b)}][{third}]' for b, third in seconds.items())})"
        for a, seconds in firsts.items()
    )


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index: (trigram, uid, doc_id), for the trigrams of the rules' queries. Letters count in either case."""
    wanted = sorted({t for _, _, t, _ in _trigram_rows(rules)})
    pattern = F.lit(f"(?=({_any_of(wanted)}))")
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", pattern, 1), F.lower))
    return _texts(docs).select(F.explode(found).alias("trigram"), "uid", "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(kind, uid, doc_id) of documents that hold all trigrams of some alternative of a rule."""
    spark = index.sparkSession
    queries = spark.createDataFrame(_trigram_rows(rules), "kind string, number int, trigram string, size int")
    joined = index.distinct().join(F.broadcast(queries), "trigram")
    counted = joined.groupBy("kind", "number", "size", "uid", "doc_id").count()
    return counted.where("count = size").select("kind", "uid", "doc_id").distinct()


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """uid, doc_id, kind, start, end (code points, end exclusive) of every secret; repeated rows give one set."""
    texts = _texts(docs)
    indexed = tuple(r for r in rules if r.trigrams())
    found = [_match_rows(texts, r) for r in rules if not r.trigrams()]
    if indexed:
        chosen = candidates(postings(docs, indexed), indexed)
        kinds = cut_lineage(chosen.groupBy("uid", "doc_id").agg(F.collect_set("kind").alias("kinds")))
        same = texts["uid"].eqNullSafe(kinds["uid"]) & texts["doc_id"].eqNullSafe(kinds["doc_id"])
        verify = texts.join(kinds, same).select(texts["uid"], texts["doc_id"], "text", "kinds")
        verify = cut_lineage(verify)
        found += [_match_rows(verify.where(F.array_contains("kinds", r.kind)), r) for r in indexed]
    matches = found[0]
    for more in found[1:]:
        matches = matches.unionByName(more)
    return _spans(matches.distinct())


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists all kinds as kind:start:end by start and then in the order of the rules; ``base_sha256`` is the hash
    of the base kinds' part of it. A null text is empty. Repeated rows get the same result each; a null doc_id keeps its
    row. Other columns are ignored; an empty table gives no rows.
    """
    place = F.lit(len(rules))
    for n, rule in enumerate(rules):
        place = F.when(F.col("kind") == rule.kind, n).otherwise(place)
    one = F.concat_ws(":", "kind", "start", "end")
    entry = F.struct("start", place.alias("place"), one.alias("name"))
    grouped = secret_spans(docs, rules).groupBy("uid", "doc_id").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
        F.array_sort(F.collect_list(F.when(F.col("kind").isin(*BASE), entry))).alias("base"),
        F.array_sort(F.collect_list(entry)).alias("all"),
    )
    named = grouped.select(
        F.col("uid").alias("g_uid"), F.col("doc_id").alias("g_doc"), *[f"n_{k}" for k in BASE],
        F.array_join(F.col("base.name"), ",").alias("base"), F.array_join(F.col("all.name"), ",").alias("spans"),
    )
    keys = _texts(docs).select("doc_id", "uid")
    same = keys["uid"].eqNullSafe(named["g_uid"]) & keys["doc_id"].eqNullSafe(named["g_doc"])
    return keys.join(named, same, "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
