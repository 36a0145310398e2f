"""Boolean trigram queries from regular expressions: what every match must hold, as alternatives of trigram sets."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as parser

# Strings kept of one part, characters of a class that are spelled out, and alternatives of a query. Beyond these a part
# says less, which admits more candidates and loses none.
MOST_STRINGS = 32
MOST_CHARACTERS = 8
MOST_ALTERNATIVES = 64

# A query holds if all trigrams of one of its sets are there; the empty set always holds.
Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Part:
    """What is known of a pattern's matches: all of them (``exact``), or how they begin and end, and a query."""

    exact: frozenset[str] | None
    prefix: frozenset[str]
    suffix: frozenset[str]
    query: Query


def trigram_query(pattern: str) -> list[tuple[str, ...]]:
    """The alternatives of a pattern, in lower case; none if some match needs no trigram or the syntax is unknown.

    The pattern is in the syntax that Java and Python share. ASCII letters count in either case, so flags of case change
    nothing; other characters, back references and conditions are taken as unknown.
    """
    try:
        part = _sequence(parser.parse(pattern))
    except re.error:
        return []
    query = part.query if part.exact is None else _both(part.query, _strings_query(part.exact))
    return [] if query == ALWAYS else sorted(tuple(sorted(s)) for s in query)


def _strings_query(strings: frozenset[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return ALWAYS
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _least(sets) -> Query:
    """Without alternatives that ask for more than another one does."""
    kept: list[frozenset[str]] = []
    for s in sorted(set(sets), key=len):
        if not any(k <= s for k in kept):
            kept.append(s)
    return frozenset(kept) if len(kept) <= MOST_ALTERNATIVES else ALWAYS


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_ALTERNATIVES:
        return a if a != ALWAYS else b
    return _least(x | y for x, y in product(a, b))


def _exactly(strings) -> Part:
    strings = frozenset(strings)
    return Part(strings, strings, strings, _strings_query(strings))


_UNKNOWN = Part(None, frozenset([""]), frozenset([""]), ALWAYS)


def _ends(strings: frozenset[str], cut) -> frozenset[str]:
    """Two characters of each string, fewer if they are too many."""
    for n in (2, 1):
        short = frozenset(cut(s, n) for s in strings)
        if len(short) <= MOST_STRINGS:
            return short
    return frozenset([""])


def _open(prefix: frozenset[str], suffix: frozenset[str], query: Query) -> Part:
    last = lambda s, n: s[max(len(s) - n, 0) :]
    return Part(None, _ends(prefix, lambda s, n: s[:n]), _ends(suffix, last), query)


def _cross(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    return frozenset(x + y for x, y in product(a, b))


def _then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _exactly(_cross(a.exact, b.exact))
    query = _both(_both(a.query, b.query), _strings_query(_cross(a.suffix, b.prefix)))
    prefix = a.prefix if a.exact is None else _cross(a.exact, b.prefix)
    suffix = b.suffix if b.exact is None else _cross(a.suffix, b.exact)
    return _open(prefix, suffix, query)


def _either(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts):
        strings = frozenset().union(*(p.exact for p in parts))
        if len(strings) <= MOST_STRINGS:
            return _exactly(strings)
    query = _least(s for p in parts for s in p.query)
    return _open(frozenset().union(*(p.prefix for p in parts)), frozenset().union(*(p.suffix for p in parts)), query)


def _sequence(nodes) -> Part:
    part = _exactly([""])
    for node in nodes:
        part = _then(part, _node(*node))
    return part


def _character(code: int) -> str | None:
    return chr(code).lower() if code < 128 else None


def _class(items) -> Part:
    codes: set[int] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            codes.add(value)
        elif kind is op.RANGE and value[1] - value[0] < 2 * MOST_CHARACTERS:
            codes.update(range(value[0], value[1] + 1))
        else:
            return _UNKNOWN
    characters = {_character(c) for c in codes}
    return _UNKNOWN if None in characters or len(characters) > MOST_CHARACTERS else _exactly(characters)


def _node(kind, value) -> Part:
    if kind is op.LITERAL:
        character = _character(value)
        return _UNKNOWN if character is None else _exactly([character])
    if kind is op.IN:
        return _class(value)
    if kind is op.BRANCH:
        return _either([_sequence(p) for p in value[1]])
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.ATOMIC_GROUP:
        return _sequence(value)
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return _exactly([""])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, body = value
        part = _sequence(body)
        if (least, most) == (0, 1):
            return _either([part, _exactly([""])])
        if least == 0:
            return _UNKNOWN
        return part if (least, most) == (1, 1) else _open(part.prefix, part.suffix, part.query)
    return _UNKNOWN
