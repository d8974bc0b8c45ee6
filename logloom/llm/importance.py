"""Importance resampling towards a target text collection.

Features are the runs of one to three consecutive words, hashed into buckets.
Two array counts (all documents, all target texts) give every bucket a gain;
a document's weight is the sum of the gains of its features, looked up as an
array, and its score adds Gumbel noise drawn from its id, so the highest
scores are a sample in proportion to the weights.

The cutoff of the draw is found without sorting the scores: a quantile sketch
proposes a bracket around it, exact counts above and inside the bracket
validate it or widen it, and only the bracket is sorted.

Hashes: crc32 is linear, so the checksum of a run of words follows from those
of its words, ``crc(a + b) = shift(crc(a), len(b)) ^ crc(b)``; the shift by a
number of bytes is a 32-bit matrix over GF(2), kept as four byte tables. Each
distinct word of a worker is hashed once, runs are array look-ups.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import text_of, write_once
from logloom.operators.ranking import range_rank

BUCKETS = 10_000
LONGEST = 3
SEED = 42
PERCENT = 5
MIN_WORDS = 20
# Largest number of bytes with shift tables of its own; longer words are shifted in steps.
SHIFT_BYTES = 64
CACHE_WORDS = 1 << 19
CACHE_BYTES = 64 << 20
STEP_BYTES = 1 << 20
SPACE_CRC = zlib.crc32(b" ")
# Rank error of the sketch as a share of the rows, and the first half width of the bracket.
SKETCH = 10_000
HALF_WIDTH = 0.002

# Bytes of words stand for themselves, A-Z for a-z, all others for a space.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """[bytes][4][256]: what a checksum becomes when that many bytes follow it,
    by the value of each of its four bytes."""
    byte = np.zeros(256, np.uint32)  # the checksum register's step for one low byte
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        byte[i] = c
    value = np.arange(256, dtype=np.uint32)
    out = np.empty((SHIFT_BYTES + 1, 4, 256), np.uint32)
    out[0] = [value << (8 * k) for k in range(4)]
    for n in range(1, SHIFT_BYTES + 1):
        out[n] = (out[n - 1] >> 8) ^ byte[out[n - 1] & 0xFF]
    return out


def _followed(crc: np.ndarray, size: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Checksums of strings of which ``crc`` is the front's checksum, ``tail``
    the back's and ``size`` the back's bytes."""
    tables, left = _shifts(), size
    while True:
        step = np.minimum(left, SHIFT_BYTES)
        crc = (tables[step, 0, crc & 0xFF] ^ tables[step, 1, crc >> 8 & 0xFF]
               ^ tables[step, 2, crc >> 16 & 0xFF] ^ tables[step, 3, crc >> 24])
        left = left - step
        if not left.any():
            return crc ^ tail


class Features:
    """Buckets of the features of texts; one per worker process."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        # For each word met: checksum, checksum with a space before it, bytes with that space.
        self.facts = np.zeros((1024, 3), np.int64)

    def _learn(self, words: set[bytes]) -> None:
        at = len(self.place)
        while at + len(words) > len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        for i, word in enumerate(words, at):
            self.place[word] = i
            self.held += len(word)
            self.facts[i] = zlib.crc32(word), zlib.crc32(word, SPACE_CRC), len(word) + 1

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all features of some UTF-8 texts, the text each belongs
        to, words per text."""
        if len(self.place) > CACHE_WORDS or self.held > CACHE_BYTES:
            self._forget()
        split = [t.translate(WORD_BYTES).split() for t in texts]
        n_words = np.array([len(w) for w in split], np.int64)
        words = list(chain.from_iterable(split))
        places = list(map(self.place.get, words))
        if None in places:
            self._learn(set(words).difference(self.place))
            places = list(map(self.place.__getitem__, words))
        ids = np.array(places, np.int64)
        owner = np.repeat(np.arange(len(texts)), n_words)
        first, spaced, size = self.facts[ids].astype(np.uint32).T
        crc, buckets, owners = first, [first % BUCKETS], [owner]
        for n in range(1, LONGEST):
            whole = owner[n:] == owner[:-n] if len(owner) > n else np.zeros(0, bool)
            crc = _followed(crc[:len(owner) - n], size[n:], spaced[n:]) if len(whole) else np.zeros(0, np.uint32)
            buckets.append(crc[whole] % BUCKETS)
            owners.append(owner[:len(whole)][whole])
        return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), n_words


@lru_cache(maxsize=1)
def _features() -> Features:
    return Features()


def _steps(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most about STEP_BYTES of text, or one row."""
    for batch in batches:
        sizes = batch.column(column).nbytes
        rows = max(1, min(batch.num_rows, STEP_BYTES * batch.num_rows // max(1, sizes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): occurrences of features per bucket in column ``text``. A task
    adds up one array, so at most BUCKETS rows per task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in _steps(batches, 0):
            total += np.bincount(_features()(part.column(0).to_pylist())[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    parts = texts.select(text_of().cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of every bucket's smoothed shares, in doubles."""
    every, wanted = float(documents.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (every + BUCKETS) / ((s + 1.0) * (wanted + BUCKETS))))
                     for s, t in zip(documents.tolist(), target.tolist())], np.int64)


def _array(counts: DataFrame) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for r in counts.collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def _noise(doc_id: Column, seed: int) -> Column:
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((drawn.cast("double") + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _steps(batches, 1):
            buckets, owner, n_words = _features()(part.column(1).to_pylist())
            n = part.num_rows
            weight = np.bincount(owner, gain[buckets], n).astype(np.int64)  # whole numbers, exact in doubles
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.bincount(owner, minlength=n)), pa.array(n_words), pa.array(weight)],
                ["doc_id", "n_features", "n_words", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_features long, n_words long, weight long")
    return rows.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


def bracket(table: DataFrame, wanted: int, total: int, sketch: int = SKETCH,
            half_width: float = HALF_WIDTH) -> tuple[int | None, int | None, int]:
    """(low, high, above): ``above`` of the rows score over ``high``, and the
    ``wanted``-th highest score lies within low..high (None: no bound).

    The sketch (mergeable summaries, combined before the shuffle) proposes the
    scores at ranks beside the wanted one; the counts are exact, and a side
    that fails is moved outwards, without a bound at last."""
    width_low = width_high = half_width
    share = 1.0 - wanted / total
    while True:
        at = [max(0.0, share - width_low), min(1.0, share + width_high)]
        low, high = table.agg(F.percentile_approx("score", at, sketch).alias("q")).head()["q"]
        low, high = low if at[0] > 0 else None, high if at[1] < 1 else None
        over = F.lit(False) if high is None else F.col("score") > high
        within = ~over if low is None else ~over & (F.col("score") >= low)
        r = table.agg(F.count_if(over).alias("above"), F.count_if(within).alias("inside")).head()
        if r["above"] < wanted <= r["above"] + r["inside"]:
            return low, high, r["above"]
        if r["above"] >= wanted:
            width_high = 4 * width_high + 1 / sketch
        else:
            width_low = 4 * width_low + 1 / sketch


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
             seed: int = SEED) -> DataFrame:
    """Every row of ``docs``: doc_id, n_features, weight, score, rank.

    Of the N rows with at least ``min_words`` words, floor(percent * N / 100)
    with the highest scores are drawn; rank is 1, 2, 3... among them (highest
    score first, ties to the smaller doc_id, a null one first), null for the
    others. Rows that tie in both are ranked by weight and n_features; what
    still ties is equal in every column. Null texts have no words, in ``docs``
    and in ``target`` (column text); their weight is 0. A null doc_id draws its
    noise as an empty string. Both tables are read whole; an empty target gives
    every bucket the gain of its rarity among the documents. Further columns
    are ignored; no documents give no rows."""
    spark = docs.sparkSession
    gain = gains(_array(bucket_counts(docs)), _array(bucket_counts(target)))
    table = write_once(scored(docs, gain, seed), "scored")
    eligible = table.where(F.col("n_words") >= min_words)
    total = eligible.count()
    wanted = percent * total // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return table.select(*shown, unranked)
    low, high, above = bracket(eligible, wanted, total)
    over = F.lit(False) if high is None else F.col("score") > high
    within = ~over if low is None else ~over & (F.col("score") >= low)
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("weight").asc(), F.col("n_features").asc()]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = range_rank(eligible.where(over).select(*shown), [], order, num_partitions=tasks)
    inside = range_rank(eligible.where(within).select(*shown), [], order, num_partitions=tasks).withColumn(
        "rank", F.col("rank") + above)
    inside = inside.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = table.where((F.col("n_words") < min_words) | ~(over | within)).select(*shown, unranked)
    return taken.select(*shown, "rank").unionByName(inside.select(*shown, "rank")).unionByName(rest)
