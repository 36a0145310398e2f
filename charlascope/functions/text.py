"""Text folding, tokens and slot signals as column expressions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlascope.settings import SLOT_PATTERNS

_EDGE_SPACE = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


@lru_cache(maxsize=1)
def fold_tables() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition leaves one ASCII character, and those that leave several."""
    one, several = {}, {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if c < "\x80")
        if plain:
            (one if len(plain) == 1 else several)[chr(code)] = plain
    return one, several


@lru_cache(maxsize=1)
def _several_class() -> str:
    """A character class that covers all characters of the second table, as a few ranges; it may match others too."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, fold_tables()[1])):
        if ranges and code - ranges[-1][1] < 16:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in ranges) + "]"


def normalize_text(text: Column) -> Column:
    """Accent-free, ASCII-only, lower-case, trimmed text; null becomes the empty string."""
    one, several = fold_tables()
    folded = F.translate(text, "".join(one), "".join(one.values()))
    # Only the few characters still beyond ASCII decide whether the slower expansion is needed.
    leftover = F.regexp_replace(folded, r"[\x00-\x7F]+", "")
    expansions = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    expanded = F.array_join(
        F.transform(
            F.split(folded, ""),
            lambda c: F.when(c < "\x80", c).otherwise(F.coalesce(F.try_element_at(expansions, c), F.lit(""))),
        ),
        "",
    )
    ascii_only = F.when(leftover == "", folded).when(leftover.rlike(_several_class()), expanded).otherwise(
        F.regexp_replace(folded, r"[^\x00-\x7F]+", "")
    )
    return F.coalesce(F.regexp_replace(F.lower(ascii_only), _EDGE_SPACE, ""), F.lit(""))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def tokens(norm: Column) -> Column:
    """Word runs of two or more characters, in order."""
    return F.regexp_extract_all(norm, F.lit(r"\w\w+"), F.lit(0))


def with_terms(frame: DataFrame, norm: str, out: str = "terms") -> DataFrame:
    """Add the tokens followed by the pairs of neighbouring tokens; the text is scanned once."""
    words = F.col("_words")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return (
        frame.withColumn("_words", tokens(F.col(norm)))
        .withColumn(out, F.concat(words, F.array_compact(pairs)))
        .drop("_words")
    )


def slot_signals(norm: Column, patterns: Mapping[str, Sequence[str]] = SLOT_PATTERNS) -> Column:
    """Names of the slots that any of their patterns finds, in the order of the dictionary."""
    hits = []
    for slot, expressions in patterns.items():
        found = F.lit(False)
        for expression in expressions:
            found = found | norm.rlike(expression)
        hits.append(F.when(found, F.lit(slot)))
    return F.array_compact(F.array(*hits))


def word_count_at_most(text: Column, limit: int) -> Column:
    return F.size(F.split(strip(text), r"(?U)\s+")) <= limit


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found
