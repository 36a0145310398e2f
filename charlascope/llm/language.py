"""Language by steps: the family first, then one-versus-one linear support vector machines inside the family.

Features are relative frequencies of hashed byte n-grams over the letters of the text. Families are told apart by
one-versus-one machines as well. The models are fitted on a bounded sample of labelled rows (``SAMPLE`` per language);
prediction is one pass over whole texts in which every n-gram adds its weights, so memory does not grow with a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlascope.llm.base import batched, held_out, rows_of
from charlascope.session import cut_lineage

UNDETERMINED = "und"
# Labelled rows of each language that the models are fitted on, and languages that they tell apart at most.
SAMPLE = 500
LANGUAGES = 200
BUCKETS = 1 << 12
SIZES = (2, 3)
SLICE = 1 << 18
ROUNDS = 60
SEED = 29

# ---- Fixed values: families of languages; a language not listed is a family of its own ----
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}

_OTHER = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def _letters(data: bytes) -> np.ndarray:
    return np.frombuffer(b" " + _OTHER.sub(b" ", data.lower()).strip() + b" ", np.uint8)


def grams(data: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's byte n-grams, slice by slice; non-letters of ASCII count as one space."""
    for at in range(0, max(1, len(data)), SLICE):
        bytes_ = _letters(data[at : at + SLICE]).astype(np.uint32)
        for size in SIZES:
            if len(bytes_) >= size:
                code = np.zeros(len(bytes_) - size + 1, np.uint32)
                for i in range(size):
                    code = code * np.uint32(257) + bytes_[i : len(bytes_) - size + 1 + i]
                code = (code + np.uint32(size)) * np.uint32(2654435761)
                yield code >> np.uint32(32 - BUCKETS.bit_length() + 1)


def frequencies(text: str | None) -> np.ndarray:
    counts = np.zeros(BUCKETS)
    for part in grams((text or "").encode()):
        counts += np.bincount(part, minlength=BUCKETS)
    return counts / max(1.0, np.sqrt((counts**2).sum()))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit_machine(
    x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, rounds: int = ROUNDS, cost: float = 1e-4
) -> tuple[np.ndarray, float]:
    """A linear machine with hinge loss by stochastic subgradient steps; y is +1 or -1. Classes weigh the same.

    ``rows`` are the rows of ``x`` that take part, all by default; only those of one step are copied.
    """
    rows = np.arange(len(x)) if rows is None else rows
    rng = np.random.default_rng(SEED)
    weights, bias, step = np.zeros(x.shape[1]), 0.0, 0
    mean_weights, mean_bias, added = np.zeros(x.shape[1]), 0.0, 0
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for turn in range(rounds):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            step += 1
            rate = 1.0 / (1.0 + cost * step * 100)
            held = x[rows[part]].astype(float)
            off = y[part] * (held @ weights + bias) < 1
            wrong, held = part[off], held[off]
            pull = (y[wrong] * share[wrong])[:, None]
            weights = weights * (1 - rate * cost) + rate / len(part) * (pull * held).sum(axis=0)
            bias += rate / len(part) * pull.sum()
            if turn >= rounds // 2:
                mean_weights, mean_bias, added = mean_weights + weights, mean_bias + bias, added + 1
    return mean_weights / max(1, added), mean_bias / max(1, added)


@dataclass
class Machines:
    """One machine for each pair of classes; the class with most won pairs is taken, margins break ties."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, names: list[str]) -> Machines:
        classes = sorted(set(names))
        labels = np.array([classes.index(n) for n in names], int)
        pairs = list(combinations(range(len(classes)), 2))
        weights, bias = np.zeros((len(pairs), BUCKETS)), np.zeros(len(pairs))
        for k, (a, b) in enumerate(pairs):
            rows = np.flatnonzero((labels == a) | (labels == b))
            weights[k], bias[k] = fit_machine(x, np.where(labels[rows] == a, 1.0, -1.0), rows)
        return cls(classes, pairs, weights, bias)

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        """The class for margins of all pairs, and a score from the smallest margin of its pairs."""
        if not self.pairs:
            return self.classes[0], 1.0
        margins = margins + self.bias
        votes, sums = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        for (a, b), m in zip(self.pairs, margins, strict=True):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(range(len(self.classes)), key=lambda c: (votes[c], sums[c], -c))
        least = min(m if a == best else -m for (a, b), m in zip(self.pairs, margins) if best in (a, b))
        return self.classes[best], float(1 / (1 + np.exp(-2 * np.clip(least, -20, 20))))


@dataclass
class LanguageModel:
    families: Machines
    members: dict[str, Machines]

    def __post_init__(self):
        self.parts = [self.families, *self.members.values()]
        self.table = np.concatenate([p.weights for p in self.parts]).T.copy()
        self.places = np.cumsum([0, *(len(p.pairs) for p in self.parts)])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return UNDETERMINED, 0.0
        counts = np.zeros(BUCKETS)
        for part in grams(text.encode()):
            counts += np.bincount(part, minlength=BUCKETS)
        margins = counts @ self.table / max(1.0, np.sqrt(counts @ counts))
        of = {id(p): margins[a:b] for p, a, b in zip(self.parts, self.places, self.places[1:])}
        family, sure = self.families.decide(of[id(self.families)])
        lang, inside = self.members[family].decide(of[id(self.members[family])])
        return lang, sure * inside


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled rows of each language, those with the smallest id hashes; held-out rows are left out.

    The rank needs no group in one place: ids below a hash bound that leaves a few times the sample are ranked alone.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(~held_out())
    mixed = rows.withColumn("mixed", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 40)))
    sizes = mixed.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    bound = F.least(F.lit(1.0), F.lit(3.0 * sample + 50) / F.col("count")) * (1 << 40)
    near = mixed.join(F.broadcast(sizes.select("lang", bound.alias("bound"))), "lang").where("mixed < bound")
    ranked = cut_lineage(near.select("lang", "doc_id", "mixed", "text").where(F.length(F.trim("text")) > 0))
    place = "row_number() over (partition by lang order by mixed, doc_id, xxhash64(text))"
    return ranked.withColumn("place", F.expr(place)).where(F.col("place") <= sample).select("lang", "text")


_DENSE = pa.schema([("lang", pa.string()), ("x", pa.binary())])


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """The models, or nothing without labelled rows. The driver gets ``sample`` frequency vectors per language."""

    def task(batches):
        rows = rows_of(batches, "lang", "text")
        # Frequencies are not negative: their big-endian bytes sort as they do.
        vectors = ((g, frequencies(t).astype(">f4").tobytes()) for g, t in rows if has_letter(t))
        yield from batched(vectors, _DENSE, 256)

    rows = training_rows(docs, sample).mapInArrow(task, "lang string, x binary")
    found = sorted((r["lang"], bytes(r["x"])) for r in rows.toLocalIterator())
    if not found:
        return None
    names, x = [n for n, _ in found], np.stack([np.frombuffer(v, ">f4") for _, v in found]).astype(np.float32)
    groups = [family_of(n) for n in names]
    members = {}
    for family in sorted(set(groups)):
        inside = [i for i, g in enumerate(groups) if g == family]
        members[family] = Machines.fit(x[inside], [names[i] for i in inside])
    return LanguageModel(Machines.fit(x, groups), members)


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) for every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if no row is labelled. Repeated rows
    get a row each. Only text takes part in a prediction.
    """
    model = fit(docs, sample)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        def predicted():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                yield doc_id, *(held.value.predict(text) if held.value else (UNDETERMINED, 0.0))

        yield from batched(predicted(), _PREDICTED)

    out = docs.select("doc_id", "text").mapInArrow(task, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
