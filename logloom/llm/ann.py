"""Approximate nearest neighbours by adaptive dimension scan.

An inverted-list index: centroids are fitted on a bounded sample, every row is
put into the list of its nearest centroid. Vectors are turned by one random
rotation, after which any ``d`` of the ``D`` dimensions give an unbiased estimate of
a distance. A probed list is scanned in blocks of columns: after each block a
candidate whose estimate lies above the query's current k-th distance by more
than the error bound of ``d`` random dimensions, (1 + EPSILON / sqrt(d)), is
abandoned. Survivors are scored exactly on the original vectors.

How many lists a query probes is measured: the true neighbours of a sample of
queries (all, up to ``SAMPLE_QUERIES``) are found by brute force, and the lists
that hold them give the least number of probes with a mean recall of ``RECALL``.

A list is dealt out in blocks of about ``BLOCK_ROWS`` rows, so a list that holds
a third of all rows is scanned by many tasks; each reports its k best per
query, and the k best of those are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import empty_like, tasks_for, write_once

K = 10
PROBES = 24  # at least
RECALL = 0.95  # of the sample of queries
SAMPLE_QUERIES = 256
ROWS_PER_LIST = 400
MAX_LISTS = 1024
MAX_SAMPLE = 20_000
BLOCK_ROWS = 1024
COLUMNS = 16
CHUNK = 256
EPSILON = 2.1
ROUNDS = 10
RESULT = "query_id long, rank int, vec_id long, score double"


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v): rows with an id and a vector that is neither null nor zero
    and holds no null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return (table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .where(F.forall("v", finite) & F.exists("v", lambda x: x != 0)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _centroids(sample: np.ndarray, count: int, rng) -> np.ndarray:
    """Lloyd's algorithm from distinct sample points; an empty list keeps its centroid."""
    start = np.unique(sample, axis=0)
    centres = start[rng.permutation(len(start))[:count]]
    for _ in range(ROUNDS):
        near = _nearest(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        sizes = np.bincount(near, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest centroids of each row, nearest first."""
    out = []
    for at in range(0, len(rows), 4096):
        part = rows[at:at + 4096]
        d = (centres * centres).sum(1) - 2 * part @ centres.T
        out.append(d.argmin(1)[:, None] if count == 1 else np.argsort(d, axis=1, kind="stable")[:, :count])
    return np.concatenate(out) if out else np.zeros((0, count), np.int64)


class _Best:
    """The k nearest candidates of one query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    @property
    def bound(self) -> float:
        return self.score[-1] if len(self.score) == self.k else np.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, score))
        _, first = np.unique(ids[order], return_index=True)  # a repeated id counts once
        order = order[np.sort(first)[:self.k]]
        self.score, self.ids = score[order], ids[order]


def scan_list(query: np.ndarray, turned_query: np.ndarray, own: int, ids: np.ndarray, original: np.ndarray,
              turned: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k nearest candidates; ``turned`` holds one row per
    dimension of the rotated vectors."""
    best, width = _Best(k), len(turned_query)
    for at in range(0, len(ids), CHUNK):
        live = np.arange(at, min(at + CHUNK, len(ids)))
        live = live[ids[live] != own]
        partial = np.zeros(len(live))
        for d in range(0, width, COLUMNS):
            if np.isinf(best.bound) or not len(live):
                break
            columns = turned[d:d + COLUMNS, live] - turned_query[d:d + COLUMNS, None]
            partial += (columns * columns).sum(0)
            done = min(d + COLUMNS, width)
            slack = 1 + (EPSILON / np.sqrt(done) if done < width else 1e-9)
            keep = np.sqrt(partial * (width / done)) <= best.bound * slack + 1e-12
            live, partial = live[keep], partial[keep]
        if len(live):
            gaps = original[live] - query
            best.add(np.sqrt((gaps * gaps).sum(1)), ids[live])
    return best.score, best.ids


def _scan(width: int, k: int):
    """Runs of (list, block): candidates first, then the queries against them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, block = None, [], None
        for batch in batches:
            lists, blocks = batch.column("list").to_numpy(), batch.column("block").to_numpy()
            asks, ids = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("vec_id").to_numpy()
            v, t = _matrix(batch.column("v"), width), _matrix(batch.column("turned"), width)
            key = np.stack([lists, blocks, asks.astype(np.int64)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
            rows = []
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                if (lists[s], blocks[s]) != here:
                    here, parts, block = (lists[s], blocks[s]), [], None
                if not asks[s]:
                    parts.append((ids[s:e], v[s:e], t[s:e]))
                    continue
                if block is None and parts:
                    block = (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]),
                             np.ascontiguousarray(np.concatenate([p[2] for p in parts]).T))
                if block is not None:
                    for i in range(s, e):
                        score, found = scan_list(v[i], t[i], ids[i], *block, k)
                        rows.append((np.full(len(found), ids[i]), found, score))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)],
                                                 ["query_id", "vec_id", "score"])

    return run


def _exact(queries, width: int, k: int):
    """A task's k nearest rows of each sampled query (broadcast: ids, vectors) by
    brute force, with the list that holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q = queries.value
        best, held = [_Best(k) for _ in asked], {}
        for batch in batches:
            ids, lists, v = batch.column("vec_id").to_numpy(), batch.column("list").to_numpy(), _matrix(batch.column("v"), width)
            for at in range(0, len(ids), 4096):
                part = slice(at, at + 4096)
                square = (v[part] * v[part]).sum(1)[None, :] - 2 * q @ v[part].T + (q * q).sum(1)[:, None]
                for b, own, d in zip(best, asked, np.sqrt(np.maximum(square, 0))):
                    near = np.flatnonzero((d <= b.bound) & (ids[part] != own))
                    b.add(d[near], ids[part][near])
                    for i in np.flatnonzero(np.isin(ids[part], b.ids)):
                        held[int(ids[part][i])] = int(lists[part][i])
        rows = [(int(own), int(i), float(s), held[int(i)]) for own, b in zip(asked, best) for i, s in zip(b.ids, b.score)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["query_id", "vec_id", "score", "list"])

    return run


def probes_for(stored: DataFrame, centres: np.ndarray, queries_every: int, k: int, least: int, recall: float = RECALL) -> int:
    """The least number of probes, ``least`` or more, that gives the sampled
    queries (those with the smallest hashes) this mean recall."""
    if least >= len(centres):
        return least
    spark, width = stored.sparkSession, centres.shape[1]
    sample = (stored.where(F.col("vec_id") % queries_every == 0).orderBy(F.xxhash64("vec_id"), "vec_id")
              .limit(SAMPLE_QUERIES).select("vec_id", "v").toArrow())
    if not sample.num_rows:
        return least
    ids, q = sample["vec_id"].to_numpy(), np.array(sample["v"].to_pylist())
    ids, first = np.unique(ids, return_index=True)
    q = q[first]
    rank = np.argsort(_nearest(q, centres, len(centres)), axis=1)  # of each list, for each query
    found = stored.select("vec_id", "v", "list").mapInArrow(
        _exact(spark.sparkContext.broadcast((ids, q)), width, k), "query_id long, vec_id long, score double, list long")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = (found.groupBy("query_id", "vec_id").agg(F.min_by("list", "score").alias("list"), F.min("score").alias("score"))
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "list").collect())
    if not found:
        return least
    place = {int(x): i for i, x in enumerate(ids)}
    needed = np.sort([rank[place[r["query_id"]], r["list"]] + 1 for r in found])
    return max(least, int(needed[int(np.ceil(recall * len(needed))) - 1]))


def nearest(table: DataFrame, queries_every: int = 100, k: int = K, probes: int = PROBES, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows found for
    each row whose vec_id is divisible by ``queries_every``, by Euclidean
    distance, ties to the smaller vec_id; all candidates, if there are fewer.

    Rows without an id and vectors that are null, empty, zero, hold null or
    non-finite components, or differ in length from the sample's most usual
    one take no part. Rows with the query's vec_id are not its candidates; rows
    that repeat another vec_id are one candidate, at its least distance. An
    empty table gives an empty result; further columns are ignored. ``probes``
    is the least number of lists probed, ``probes_for`` the number."""
    spark = table.sparkSession
    rows = valid_vectors(table)
    # A bounded sample, the smallest hashes, reaches the driver.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MAX_SAMPLE).select("v").toArrow()["v"].to_pylist()
    if not sample:
        return empty_like(spark, RESULT)
    lengths = np.bincount([len(x) for x in sample])
    width = int(lengths.argmax())
    sample = np.array([x for x in sample if len(x) == width])
    rows = rows.where(F.size("v") == width)
    total = rows.count()
    rng = np.random.default_rng(seed)
    centres = _centroids(sample, max(1, min(MAX_LISTS, total // ROWS_PER_LIST)), rng)
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    index = spark.sparkContext.broadcast((centres, rotation))  # at most MAX_LISTS rows, and width by width

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, rotation = index.value
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            turned = pa.FixedSizeListArray.from_arrays(pa.array((v @ rotation).ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), turned, pa.array(_nearest(v, centres, 1)[:, 0].astype(np.int32))],
                ["vec_id", "v", "turned", "list"])

    stored = write_once(rows.mapInArrow(place, "vec_id long, v array<double>, turned array<double>, list int"), "lists")
    sizes = np.zeros(len(centres), np.int64)
    for r in stored.groupBy("list").count().collect():  # at most MAX_LISTS rows
        sizes[r["list"]] = r["count"]
    blocks = spark.createDataFrame(
        [(i, int(-(-n // BLOCK_ROWS))) for i, n in enumerate(sizes.tolist()) if n], "list int, blocks int")
    blocks = F.broadcast(blocks)
    probes = probes_for(stored, centres, queries_every, k, probes)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _ = index.value
        for batch in batches:
            order = _nearest(_matrix(batch.column("v"), width), centres, len(centres))
            # The first ``probes`` lists, and on until k candidates are sure to be found.
            held = np.cumsum(sizes[order], axis=1) - sizes[order]
            wanted = (np.arange(order.shape[1]) < probes) | (held < k + 1)
            lists = [o[w & (sizes[o] > 0)].astype(np.int32) for o, w in zip(order, wanted)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), batch.column("turned"), pa.array(lists, pa.list_(pa.int32()))],
                ["vec_id", "v", "turned", "lists"])

    shape = ["list", "block", "asks", "vec_id", "v", "turned"]
    asked = (stored.where(F.col("vec_id") % queries_every == 0).select("vec_id", "v", "turned")
             .mapInArrow(probe, "vec_id long, v array<double>, turned array<double>, lists array<int>")
             .withColumn("list", F.explode("lists")).join(blocks, "list")
             .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("asks", F.lit(True)).select(*shape))
    held = (stored.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
            .withColumn("asks", F.lit(False)).select(*shape))
    both = held.unionByName(asked)
    found = (both.repartition(tasks_for(both), "list", "block").sortWithinPartitions("list", "block", "asks", "vec_id")
             .mapInArrow(_scan(width, k), "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
