"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: stems that occur in toxic training documents far more often than in others. Features of a text
are its lexicon densities, how near lexicon words stand to words of address, and its rates of capitals, punctuation and
obfuscated letters. Training reads labelled rows that are not held out, at most ``SAMPLE`` of each label (the smallest
id hashes); a fifth of them is kept from the trees for the calibration. Scoring is one pass over whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from charlascope.llm.base import batched, held_out, rows_of
from charlascope.session import cut_lineage

THRESHOLD = 0.3
# Labelled rows of each label that the model is fitted on.
SAMPLE = 4000
# Stems in the lexicon, and the toxic documents that must hold one.
LEXICON = 1500
LEAST_DOCS = 5
STEMS = (4, 5, 6)
SLICE = 1 << 20
SEED = 17

# ---- Fixed values: words of address by language, and look-alike characters ----
ADDRESS = (
    "you your yours yourself u ur du dich dir dein deine deiner euch ihr tu te toi ton ta tes vous votre vos "
    "usted ustedes ti tus vosotros os"
).split()
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

_ADDRESS = frozenset(ADDRESS)
_FOLD = str.maketrans(LOOK_ALIKES)
_TOKEN = re.compile(r"[^\s]+")
_INNER = re.compile(r"[^\W\d_](?:[.*_\-+~][^\W\d_]){2,}")
_LETTERS = re.compile(r"[^\W\d_]+")
FEATURES = (
    "hits", "density", "distinct", "best_weight", "plain_hits", "masked_hits", "closest_run",
    "near_address", "address_rate", "capitals", "shouting", "exclaims", "punctuation", "digits_in_words", "log_words",
)


def words_of(text: str) -> Iterator[tuple[str, bool]]:
    """Lower-case words and whether their letters were obfuscated: look-alikes inside a word, or letters pulled apart."""
    for token in _TOKEN.findall(text):
        lowered = token.lower()
        if lowered.isalpha():
            yield lowered, False
            continue
        if _INNER.fullmatch(lowered.strip("\"'()[]{}.,;:?!")):
            yield "".join(c for c in lowered if c.isalpha()), True
            continue
        folded = lowered.strip("\"'()[]{}.,;:?!").translate(_FOLD)
        if folded.isalpha():
            masked = not lowered.strip("\"'()[]{}.,;:?!").isalpha() and any(c.isalpha() for c in lowered)
            yield folded, masked
        else:
            for part in _LETTERS.findall(lowered):
                yield part, False


def stems_of(word: str) -> list[str]:
    """The whole word, marked at its end, and its beginnings."""
    return [word + "$", *(word[:n] for n in STEMS if len(word) >= n)]


@dataclass
class Lexicon:
    """Weights by stem; a word weighs as much as its heaviest stem, 0 if it has none."""

    weights: dict[str, float]

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def __call__(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            found = max((self.weights.get(s, 0.0) for s in stems_of(word)), default=0.0)
            if len(self.known) < 300_000:
                self.known[word] = found
        return found


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The features of one text, all 0 without words; a long text is read slice by slice."""
    n = hits = weight = plain = masked = address = near = shouting = digits = 0
    best, last_hit, last_address, closest = 0.0, -math.inf, -math.inf, math.inf
    seen: set[str] = set()
    letters = capitals = exclaims = marks = 0
    for part in _parts(text or ""):
        bare = part.encode()
        upper = sum(map(str.isupper, part)) if not part.isascii() else len(re.findall(r"[A-Z]", part))
        capitals += upper
        letters += len(part) - bare.count(b" ")
        exclaims += bare.count(b"!")
        marks += bare.count(b".") + bare.count(b",") + bare.count(b"?") + bare.count(b"*") + bare.count(b"#")
        shouting += len(re.findall(r"\b[A-ZÀ-Þ]{3,}\b", part))
        digits += len(re.findall(r"[A-Za-z][0-9@$]+[A-Za-z]", part))
        for word, hidden in words_of(part):
            n += 1
            if word in _ADDRESS:
                address += 1
                last_address = n
                near += n - last_hit <= 5
                continue
            value = lexicon(word)
            if value <= 0:
                continue
            hits += 1
            weight += value
            best = max(best, value)
            plain += not hidden
            masked += hidden
            seen.add(word)
            closest = min(closest, n - last_hit)
            near += n - last_address <= 5
            last_hit = n
    if not n:
        return [0.0] * len(FEATURES)
    run = 0.0 if closest == math.inf else 1.0 / closest
    return [
        math.log1p(hits), weight / n, math.log1p(len(seen)), best, math.log1p(plain), math.log1p(masked), run,
        math.log1p(near), address / n, capitals / max(1, letters), shouting / n, exclaims / n, marks / n, digits / n,
        math.log(n),
    ]


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows of each label, not held out: doc_id, text, toxic, fit (false: kept for calibration).

    Null labels, null ids and ids without a document are left out. Of contradicting labels of one id the larger counts.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    mixed = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    ranked = known.withColumn("mixed", mixed)
    chosen = ranked.where("toxic = 1").orderBy("mixed").limit(sample)
    chosen = chosen.unionByName(ranked.where("toxic = 0").orderBy("mixed").limit(sample))
    chosen = cut_lineage(chosen.select("doc_id", "toxic", (F.pmod("mixed", F.lit(5)) > 0).alias("fit")))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")
    return cut_lineage(texts.groupBy("doc_id", "toxic", "fit").agg(F.max("text").alias("text")))


_COUNTS = pa.schema([("stem", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def learn_lexicon(rows: DataFrame, size: int = LEXICON, least: int = LEAST_DOCS) -> Lexicon:
    """The ``size`` stems with the largest log ratio of document shares, among those in ``least`` toxic documents."""

    def task(batches):
        counts = (Counter(), Counter())
        for toxic, text in rows_of(batches, "toxic", "text"):
            stems = {s for part in _parts(text or "") for w, _ in words_of(part) for s in stems_of(w)}
            counts[toxic].update(stems)
        yield from batched(((s, counts[1][s], counts[0][s]) for s in counts[0].keys() | counts[1].keys()), _COUNTS)

    totals = rows.groupBy().agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = totals["t"] or 0, (totals["n"] or 0) - (totals["t"] or 0)
    counted = rows.select("toxic", "text").mapInArrow(task, "stem string, toxic long, clean long")
    stems = counted.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    top = (
        stems.where(F.col("toxic") >= least)
        .withColumn("ratio", ratio)
        .where("ratio > 1.5")
        .orderBy(F.desc("ratio"), F.desc("toxic"), "stem")
        .limit(size)
    )
    return Lexicon({r["stem"]: float(r["ratio"]) for r in top.select("stem", "ratio").collect()})


def _featured(frame: DataFrame, lexicon: Lexicon, keys: tuple[str, ...], text: int | None = None) -> DataFrame:
    """Key columns with the feature vector of ``text``; lexicons have at most ``LEXICON`` entries.

    ``text`` is the place of the text inside the key column, if that is a whole row.
    """
    held = frame.sparkSession.sparkContext.broadcast(lexicon.weights)

    def task(batches):
        words = Lexicon(held.value)
        for batch in batches:
            texts = batch.column("text") if text is None else batch.column(keys[0]).field(text)
            dense = pa.array([features(t.as_py(), words) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), dense], [*keys, "dense"])
            del batch, texts, dense
        # Workers outlive their tasks; what whole rows took goes back to the system.
        pa.default_memory_pool().release_unused()

    kept = frame.select(*keys)
    out = frame.select(*keys, *["text"] * (text is None)).mapInArrow(
        task, StructType([*kept.schema.fields, StructField("dense", ArrayType(DoubleType()))])
    )
    return out.withColumn("features", array_to_vector("dense")).drop("dense")


@dataclass
class Model:
    """A lexicon, boosted trees and a calibration; without examples of both labels, the share of label 1."""

    lexicon: Lexicon
    trees: object = None
    steps: tuple[np.ndarray, np.ndarray] | None = None
    share: float = 0.0

    def score(self, docs: DataFrame) -> DataFrame:
        """One row per document: doc_id, held_out, score, predicted."""
        scored = self._scored(docs, ("doc_id",))
        return scored.select("doc_id", held_out().alias("held_out"), "score", _predicted().alias("predicted"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that are not rejected, whatever their other columns are called."""
        packed = docs.select(F.struct("*").alias("row"))
        return self._scored(packed, ("row",), [c.lower() for c in docs.columns].index("text")).where(_predicted() == 0).select("row.*")

    def _scored(self, frame: DataFrame, keys: tuple[str, ...], text: int | None = None) -> DataFrame:
        rows, score = _featured(frame, self.lexicon, keys, text), F.lit(float(self.share))
        if self.trees is not None:
            rows = self.trees.transform(rows)
            score = _steps(vector_to_array("probability")[1], *self.steps)
        return rows.select(*keys, score.alias("score"))


def _predicted():
    return (F.col("score") >= THRESHOLD).cast("int")


def _steps(value, bounds, levels):
    """The calibration as an expression: linear between its boundaries, level beyond them.

    The boundary below a value is counted, so that the expression stays flat however many boundaries there are.
    """
    xs, ys = [float(b) for b in bounds], [float(v) for v in levels]
    at = F.size(F.filter(F.array(*map(F.lit, xs)), lambda b: b <= value))
    x = lambda n: F.get(F.array(*map(F.lit, xs)), n)
    y = lambda n: F.get(F.array(*map(F.lit, ys)), n)
    inside = y(at - 1) + (value - x(at - 1)) / (x(at) - x(at - 1)) * (y(at) - y(at - 1))
    return F.when(at == 0, ys[0]).when(at == len(xs), ys[-1]).otherwise(inside)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = training_rows(docs, labels, sample)
    lexicon = learn_lexicon(rows.where("fit"))
    dense = cut_lineage(_featured(rows, lexicon, ("doc_id", "toxic", "fit")))
    sizes = {(r["fit"], r["toxic"]): r["count"] for r in dense.groupBy("fit", "toxic").count().collect()}
    total = sum(sizes.values())
    share = sum(n for (_, toxic), n in sizes.items() if toxic) / total if total else 0.0
    if not (sizes.get((True, 0)) and sizes.get((True, 1))):
        return Model(lexicon, share=share)
    ready = dense.withColumn("label", F.col("toxic").cast("double")).coalesce(1).sortWithinPartitions("doc_id")
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, maxBins=32, seed=SEED, minInstancesPerNode=3)
    trees = trees.fit(ready.where("fit"))
    held = trees.transform(ready.where("not fit")).select(
        "label", vector_to_array("probability")[1].alias("p")
    )
    if held.isEmpty():
        return Model(lexicon, trees, (np.array([0.0, 1.0]), np.array([0.0, 1.0])), share)
    line = IsotonicRegression(featuresCol="p", labelCol="label").fit(held)
    bounds, levels = line.boundaries.toArray(), line.predictions.toArray()
    return Model(lexicon, trees, (bounds, np.clip(levels, 0.0, 1.0)), share)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score of 0.3 or more) for every row of ``docs``.

    Null and empty texts have no words and get the score of a text without features. Repeated rows get a row each.
    Columns other than doc_id and text play no part. Without labelled rows of both kinds every score is the share of
    label 1, 0 without any.
    """
    return fit(docs, labels, sample).score(docs)


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows that the model does not reject, with all their columns.

    Every row is judged by its own text: a null id or an id that other rows share plays no part. Null texts stay.
    """
    return fit(docs, labels, sample).clean(docs)
