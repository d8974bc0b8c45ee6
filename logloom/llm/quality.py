"""Quality classifier: ordinal cumulative-link regression on hashed text.

Ratings are grades 0..K-1. All grades share one weight per hashed text
feature; ordered thresholds cut the score s into grades:
P(grade <= k) = 1 / (1 + exp(s - threshold_k)). The model gives an expected
grade and, for selection, the tail probability P(grade >= K-1).

The model is fitted on a bounded sample of the rated documents (``max_rated``,
the smallest hashes of doc_id): their features, at most ``1 << HASH_BITS``
per document, are the only thing that reaches the driver. Scoring reads every
document once and shuffles nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import text_of

HASH_BITS = 18
MAX_RATED = 8000
GRADES = 3
KEEP_TAIL = 0.45
RATE = 0.3
PENALTY = 2e-3
ROUNDS = 150  # ending early keeps the weights of frequent features from shrinking
MIN_RATED_WITH_FEATURE = 8
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STARTS = (4, 6)
SHARES = (0.02, 0.05, 0.1, 0.2, 0.4)


def features(text: bytes) -> np.ndarray:
    """Distinct hashed features: lower-cased words without outer marks, their
    first bytes (inflected and compound forms), the marks after them, and the
    binned shares of repeated and of capital words."""
    words = text.split()
    found = set()
    for word in set(words):
        core = word.strip(MARKS)
        if len(core) != len(word):
            tail = word[len(word.rstrip(MARKS)):] if core else word
            if len(tail) > 1 or not core:
                found.add(b"marks " + tail)
        if core:
            core = core.lower()
            found.add(core)
            found.update(b"start " + core[:n] for n in STARTS)
    if len(words) > 1:
        repeats = sum(map(bytes.__eq__, words, words[1:])) / (len(words) - 1)
        capitals = sum(map(bytes.isupper, words)) / len(words)
        found.add(b"repeats %d" % sum(repeats > s for s in SHARES))
        found.add(b"capitals %d" % sum(capitals > s for s in SHARES))
    mask = (1 << HASH_BITS) - 1
    return np.unique(np.fromiter((zlib.crc32(f) & mask for f in found), np.int32, len(found)))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score):
        """P(grade >= k) for k = 1..K-1, one column each."""
        return _sigmoid(np.asarray(score)[..., None] - self.thresholds)

    def score(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum())


def fit_ordinal(found: np.ndarray, sizes: np.ndarray, grades: np.ndarray, n_grades: int = GRADES) -> OrdinalModel:
    """Proximal AdaGrad on the mean negative log likelihood with an L1 penalty.

    ``found`` holds the features of all rows end to end, ``sizes`` their numbers.
    No rated rows: every document gets the top grade."""
    weights, n, k = np.zeros(1 << HASH_BITS), len(sizes), n_grades - 1
    if not n:
        return OrdinalModel(weights, np.linspace(-31, -30, k))
    use = np.bincount(found, minlength=1 << HASH_BITS) >= MIN_RATED_WITH_FEATURE
    kept = use[found]
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)[kept]
    col = (np.cumsum(use, dtype=np.int32) - 1)[found[kept]]
    below = np.array([(np.sum(grades <= g) + 0.5) / (n + 1.0) for g in range(k)])
    cuts = np.log(below / (1 - below))
    w, gw, gc = np.zeros(use.sum()), np.full(use.sum(), 1e-8), np.full(k, 1e-8)
    above = grades[:, None] == np.arange(k)  # the threshold above the grade
    under = grades[:, None] == np.arange(1, k + 1)  # the one under it
    for _ in range(ROUNDS):
        s = np.bincount(row, w[col], n)
        cum = _sigmoid(cuts - s[:, None])
        upper = np.where(above.any(1), (cum * above).sum(1), 1.0)
        lower = (cum * under).sum(1)
        p = np.maximum(upper - lower, 1e-12)
        dw = np.bincount(col, ((1 - upper - lower) / n)[row], len(w))
        dc = ((cum * (1 - cum) / p[:, None]) * (under.astype(float) - above)).sum(0) / n
        gw += dw * dw
        gc += dc * dc
        step = RATE / np.sqrt(gw)
        w = w - step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY, 0.0)
        cuts = np.maximum.accumulate(cuts - RATE * dc / np.sqrt(gc) + 1e-6 * np.arange(k))
    weights[use] = w
    return OrdinalModel(weights, cuts)


def rated(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the label table: 0 poor, 1 fair but toxic, 2 clean.
    Rows with a null are left out; of repeated doc_ids the lowest grade counts."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return (labels.where("doc_id is not null and quality is not null and toxic is not null")
            .groupBy("doc_id").agg(F.min(grade).alias("grade")))


def fit_quality(docs: DataFrame, ratings: DataFrame, max_rated: int = MAX_RATED,
                n_grades: int = GRADES) -> OrdinalModel:
    """Fit on at most ``max_rated`` rated documents, the first by the hash of
    their id, and on at most twice as many rows where ids repeat."""
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)  # bounded, so broadcast
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(batch.column("grade"), pa.int32()), pa.array(found, pa.list_(pa.int32()))],
                ["doc_id", "grade", "found"])

    # Repeated doc_ids may give more rows; which of them count does not depend on the files.
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.size("found"), F.xxhash64("found")]
    rows = (sample.select("doc_id", "text", F.col("grade").cast("int").alias("grade"))
            .mapInArrow(run, "doc_id long, grade int, found array<int>").orderBy(*order).limit(2 * max_rated).toArrow())
    lists, grades = rows["found"].combine_chunks(), rows["grade"].to_numpy().astype(np.int64)
    return fit_ordinal(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), grades, n_grades)


def score_quality(docs: DataFrame, model: OrdinalModel, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The columns of ``docs`` and expected_grade, p_top, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB whatever the input
    own = [c for c in docs.columns if c not in ("expected_grade", "p_top", "kept")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            scores = np.array([m.score(features(t.as_py() or b"")) for t in texts])
            tails = m.at_least(scores) if len(scores) else np.zeros((0, len(m.thresholds)))
            arrays = [batch.column(c) for c in own]
            arrays += [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep_tail)]
            yield pa.RecordBatch.from_arrays(arrays, [*own, "expected_grade", "p_top", "kept"])

    shape = docs.select(*own).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
    return docs.select(*own).mapInArrow(run, f"{out}, expected_grade double, p_top double, kept boolean")


def quality_scores(docs: DataFrame, labels: DataFrame, max_rated: int = MAX_RATED,
                   keep_tail: float = KEEP_TAIL) -> DataFrame:
    """Every row of ``docs`` with expected_grade (0 to 2), p_top =
    P(grade >= 2) and kept = p_top >= ``keep_tail``.

    A null text is scored as an empty one, which has no feature but the
    thresholds. Columns named like the results are replaced; others pass
    through. Repeated rows are scored alike. An empty table gives an empty
    result; with no ratings every document gets the top grade."""
    return score_quality(docs, fit_quality(docs, rated(labels), max_rated), keep_tail)
