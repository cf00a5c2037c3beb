"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebank.llm.common import give_back, slices, staged

SAMPLE_ROWS = 6000  # labelled rows that a model learns from, at most
LEXICON_SIZE = 3000  # entries, at most
LEAST_G2 = 18.0
LEAST_DOCS = 3
PREFIXES = range(3, 8)
NEAR = 5  # words around a hit in which a second person counts
THRESHOLD = 0.7
CACHE_WORDS = 150_000  # distinct words that a task keeps the features of
FEATURES = ("weight", "hits", "strongest", "log_hits", "near_you", "capitals", "punctuation", "shouting", "obfuscated",
            "uncovered")

# Second person in the languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen tu te toi ton ta tes vous "
    "votre vos ti tus usted ustedes vosotros".split())
# Signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil", "*.-_'")

_core = re.compile(r"^\W+|\W+$")
_odd = re.compile(r"[^\W\d_][0-9@$!|*._]+[^\W\d_]")

Lexicon = dict[str, float]


def entries(word: str) -> list[str]:
    """Lexicon entries that a word may match: itself, and its beginnings marked by a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if k < len(word))]


def _in_label_fold(fold: int):
    return F.crc32(F.col("doc_id").cast("string")) % 3 == fold


def held_out():
    """Rows that no model may learn from."""
    return _in_label_fold(1)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``most`` labelled documents in hash order: ``doc_id``, ``text``, ``toxic``, ``fold`` (0 or 2)."""
    some = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    some = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.withColumn("fold", F.when(_in_label_fold(0), F.lit(0)).otherwise(F.lit(2)))
    return staged(rows, "toxic-sample")


def _clean(chunk: str) -> str:
    return _core.sub("", chunk).lower()


def learn_lexicons(sample: DataFrame) -> dict[int, Lexicon]:
    """Words and word beginnings that mark toxic documents, from fold 0, from fold 2, and from both (key -1).

    An entry is weighed by its log odds; it needs LEAST_DOCS toxic documents and a likelihood ratio of LEAST_G2. Documents
    are counted once an entry, inside the tasks first. At most LEXICON_SIZE entries, the strongest, come back.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns)):
                found = {e for w in {_clean(c) for c in text.split()} if w for e in entries(w)}
                seen.update((e, fold, toxic) for e in found)
        keys = list(seen)
        for lo in range(0, len(keys), 100_000):
            some = keys[lo:lo + 100_000]
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in some]), pa.array([k[1] for k in some], pa.int32()),
                pa.array([k[2] for k in some], pa.int32()), pa.array([seen[k] for k in some], pa.int64())],
                names=["entry", "fold", "toxic", "n"])

    rows = sample.select("text", F.col("toxic").cast("int"), F.col("fold").cast("int"))
    counts = rows.mapInArrow(count, "entry string, fold int, toxic int, n long")
    of = lambda fold, toxic: F.sum(F.when((F.col("fold") == fold) & (F.col("toxic") == toxic), F.col("n"))
                                   .otherwise(0))
    counts = counts.groupBy("entry").agg(*[of(f, t).alias(f"n{f}{t}") for f in (0, 2) for t in (0, 1)])
    counts = staged(counts.where(f"n01 + n21 >= {LEAST_DOCS}"), "toxic-entries")
    docs = {(r["fold"], r["toxic"]): r["n"] for r in
            sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    out = {}
    for key, folds in ((0, (0,)), (2, (2,)), (-1, (0, 2))):
        n1, n0 = (sum(docs.get((f, t), 0) for f in folds) for t in (1, 0))
        if not n1 or not n0:
            out[key] = {}
            continue
        a = sum(F.col(f"n{f}1") for f in folds)
        b = sum(F.col(f"n{f}0") for f in folds)
        part = lambda x, share: F.when(x > 0, x * F.log(x / ((a + b) * share))).otherwise(0.0)
        g2 = 2 * (part(a, n1 / (n0 + n1)) + part(b, n0 / (n0 + n1)))
        odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
        top = (counts.where(a >= LEAST_DOCS).select("entry", odds.alias("w"), g2.alias("g"))
               .where(f"w > 1 AND g >= {LEAST_G2}").orderBy(F.desc("g"), "entry").limit(LEXICON_SIZE))
        out[key] = {r["entry"]: r["w"] for r in top.collect()}
    return out


_chunks: dict[str, dict[str, tuple]] = {}  # by digest of the lexicon; kept by the worker process


def _chunk_features(chunk: str, lexicon: Lexicon) -> tuple:
    word = _clean(chunk)
    weight = max((lexicon.get(e, 0.0) for e in entries(word)), default=0.0) if word else 0.0
    odd = bool(_odd.search(chunk))
    plain = word.translate(LOOKALIKES) if odd else word
    hidden = max(lexicon.get(e, 0.0) for e in entries(plain)) if odd and plain and not weight else 0.0
    letters = sum(map(str.isalpha, chunk))
    return (weight, word in SECOND_PERSON, letters, sum(map(str.isupper, chunk)), len(chunk) - letters,
            chunk.count("!"), odd, hidden)


def digest(lexicon: Lexicon) -> str:
    """The same for equal lexicons."""
    return hashlib.sha256(repr(sorted(lexicon.items())).encode()).hexdigest()


def feature_rows(texts: pa.Array, lexicon: Lexicon, key: str) -> np.ndarray:
    """One row of FEATURES per text; rates are per word or per character, all 0 for an empty text."""
    if key not in _chunks or len(_chunks[key]) > CACHE_WORDS:
        _chunks.clear()
    known = _chunks.setdefault(key, {})
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[ \t\n\r\x0b\x0c]")
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    for c in distinct:
        if c not in known:
            known[c] = _chunk_features(c, lexicon)
    table = np.array([known[c] for c in distinct], np.float64).reshape(-1, 8)
    rows = table[coded.indices.to_numpy()]
    starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    stops = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
    full = (rows[:, 2] + rows[:, 4]) > 0
    doc = np.repeat(np.arange(len(starts)), stops - starts)
    you = np.concatenate([[0], np.cumsum(rows[:, 1])])
    at = np.arange(len(rows))
    near = you[np.minimum(at + NEAR + 1, stops[doc])] - you[np.maximum(at - NEAR, starts[doc])]
    hit = rows[:, 0] > 0
    total = lambda x: np.add.reduceat(x.astype(np.float64), starts) if len(rows) else np.zeros(0)
    n = np.maximum(total(full), 1)
    letters = np.maximum(total(rows[:, 2]), 1)
    hits = total(hit)
    strongest = np.maximum.reduceat(rows[:, 0], starts) if len(rows) else np.zeros(0)
    return np.stack([
        total(rows[:, 0]) / n, hits / n, strongest, np.log1p(hits), total(hit & (near > 0)) / n,
        total(rows[:, 3]) / letters, total(rows[:, 4]) / n, total(rows[:, 5]) / n, total(rows[:, 6]) / n,
        total(rows[:, 7]) / n], axis=1)


def add_features(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``rows`` with the vector ``features`` of their text. Only the text goes to Python, and only the vector comes back."""
    key = digest(lexicon)

    @F.arrow_udf("array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                whole = pa.RecordBatch.from_arrays([texts], names=["text"])
                parts = [feature_rows(part.column(0), lexicon, key) for part in slices([whole], 0)]
                got = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(got.reshape(-1)), len(FEATURES))
                yield lists.cast(pa.list_(pa.float64()))
        finally:
            _chunks.clear()
            give_back()

    return rows.withColumn("features", array_to_vector(features("text")))


@dataclass
class ToxicityModel:
    """Lexicon, trees and calibration; without both classes in the sample, a constant score."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float = 0.0

    def _scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` (``text`` and any others) with ``score`` for the text."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.constant))
        raw = _raw_scores(self.trees, add_features(rows, self.lexicon))
        calibrated = self.calibration.transform(raw)
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction")))
        return calibrated.withColumn("score", score).drop("raw", "features", "prediction")

    def score(self, docs: DataFrame) -> DataFrame:
        """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row; a null text counts as empty."""
        scored = self._scored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
        return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                             (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

    def accepted(self, docs: DataFrame) -> DataFrame:
        """The rows whose text scores below the threshold, with all their columns."""
        rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct("*").alias("row"))
        return self._scored(rows).where(F.col("score") < THRESHOLD).select("row.*")


def _raw_scores(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    scored = trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction")


def _fit(rows: DataFrame) -> GBTClassificationModel:
    return GBTClassifier(labelCol="label", maxIter=20, maxDepth=3, stepSize=0.2, seed=7).fit(rows)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from at most ``most`` labelled rows outside the held-out third.

    Two folds: each fold's features use the lexicon of the other, and the calibration is fitted on scores of trees
    that have not seen the row. The trees that score the corpus learn from both folds.
    """
    sample = labelled_sample(docs, labels, most)
    classes = {(r["fold"], r["toxic"]): r["n"] for r in
               sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = (sum(n for (_, t), n in classes.items() if t == x) for x in (1, 0))
    if not all(classes.get((f, t)) for f in (0, 2) for t in (0, 1)):
        return ToxicityModel({}, None, None, n1 / (n0 + n1) if n0 + n1 else 0.0)
    lexicons = learn_lexicons(sample)
    rows = {f: add_features(sample.where(F.col("fold") == f).select(
        "doc_id", "text", F.col("toxic").cast("double").alias("label")), lexicons[2 - f]) for f in (0, 2)}
    # The sample is bounded, so one sorted partition holds it; trees then don't depend on how rows were dealt.
    rows = {f: staged(r.coalesce(1).sortWithinPartitions("doc_id"), "toxic-rows") for f, r in rows.items()}
    unseen = [_raw_scores(_fit(rows[2 - f]), rows[f]) for f in (0, 2)]
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(
        staged(unseen[0].union(unseen[1]).select("raw", "label"), "toxic-unseen"))
    return ToxicityModel(lexicons[-1], _fit(rows[0].union(rows[2]).coalesce(1)), calibration)
