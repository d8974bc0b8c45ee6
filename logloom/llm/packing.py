"""Lexical retrieval packing: sequences filled with BM25 neighbours.

Documents are tokenized once into a table of two-byte ids; the same pass
counts in how many documents each id occurs (one vector per task, summed over
the vocabulary), so BM25 weights rest on the whole corpus. The inverted index
is sharded by content: documents are ordered by the rarest of their ids among
those that at least a shard's worth of documents hold (behind these come ids
that fewer documents share, the most held first), then by the next two, and a
shard is a stretch of that order that holds a bounded number of tokens.
Documents that share rare ids lie together, wherever they are stored, and the
shards do not depend on files or partitions. In a shard each seed document
queries the index with all its terms, and its unused neighbours fill its window
in score order. A document that does not fit is cut, its rest seeds the next
window, so every window but a shard's last is full; the last is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import empty_like, text_of, write_once
from logloom.llm.tokens import chunk_ids
from logloom.operators.ranking import range_cumsum

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 4 << 20
SHARD_DOCS = 1 << 16  # a document counts as shard_tokens / SHARD_DOCS ids at least
MAX_TASKS = 1 << 14  # beyond so many shards a task packs several, one after the other
ROUTE_TERMS = 3
FIRST_NEIGHBOURS = 64  # sorted at first; more if they do not fill the window
K1, B = 1.2, 0.75
DENSE = 4  # ids held by one document in so many are a row of a matrix, the others a list
VOCABULARY = 1 << 16
STEP_TEXTS, STEP_BYTES = 4096, 4 << 20  # worked on at once; a longer text by itself

PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
         "sequence_id long, offset long")


def _steps(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with a bounded number of rows and of bytes in ``column``."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = int(np.searchsorted(upto, before + STEP_BYTES, side="right"))
            end = min(max(end, at + 1), at + STEP_TEXTS)
            yield batch.slice(at, end - at)
            at = end


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(rid, doc_id, ids, seen): a row per document with its number and its ids,
    and a row per task whose ``seen`` counts the task's documents that hold each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = chunk_ids(tokenizer)
        seen = np.zeros(VOCABULARY, np.int64)
        rid = TaskContext.get().partitionId() << 36
        for part in _steps(batches, 1):
            plain, counts = tokens.flat(part.column(1))
            upto = np.concatenate([[0], np.cumsum(counts + 1)])
            ids = np.full(upto[-1], end_id, "<u2")
            inside = np.ones(len(ids), bool)
            inside[upto[1:] - 1] = False
            ids[inside] = plain
            # Each (text, id) once, by one sort of the step's ids.
            key = ids.astype(np.uint32)
            key |= np.repeat(np.arange(part.num_rows, dtype=np.uint32) << 16, counts + 1)
            key.sort()
            first = np.concatenate([[True], key[1:] != key[:-1]])
            seen += np.bincount(key[first] & 0xFFFF, minlength=VOCABULARY)
            held = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), part.num_rows, [None, pa.py_buffer(upto * 2), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rid, rid + part.num_rows)), part.column(0), held.cast(pa.binary()),
                 pa.nulls(part.num_rows, pa.binary())], ["rid", "doc_id", "ids", "seen"])
            rid += part.num_rows
        if seen.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.tobytes()])],
                ["rid", "doc_id", "ids", "seen"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "rid long, doc_id long, ids binary, seen binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.frombuffer(x.as_py(), np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "docs"])


def _routes(docs: list[np.ndarray], rank: np.ndarray) -> np.ndarray:
    """For each document the smallest ranks of its ids, most significant first, in one number."""
    begin = np.cumsum([0] + [len(d) for d in docs[:-1]])
    ranks, key = rank[np.concatenate(docs)], np.zeros(len(docs), np.int64)
    for _ in range(ROUTE_TERMS):
        least = np.minimum.reduceat(ranks, begin)
        key = key << 16 | least
        ranks[ranks == np.repeat(least, np.diff(np.append(begin, len(ranks))))] = VOCABULARY - 1
    return key


def _places(key, doc_id, digest, rid) -> np.ndarray:
    """Places in the order of documents, as byte strings that compare alike."""
    columns = np.stack([np.asarray(c, np.int64) for c in (key, doc_id, digest, rid)], axis=1)
    return (columns.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view("S32").ravel()


def sharded(table: DataFrame, seen: np.ndarray, mean_length: float, shard_tokens: int, end_id: int) -> DataFrame:
    """(shard, doc_id, ids): the documents of a shard in one task, in order.

    The order is total: routing ids, doc_id, digest of the ids, row number
    (which tells only equal documents apart). The driver holds 32 bytes for every
    ``shard_tokens`` ids of the corpus, the first place of each shard."""
    spark = table.sparkSession
    held = seen.copy()
    held[end_id] = 0
    shared, enough = np.flatnonzero(held > 1), shard_tokens / mean_length
    rank = np.full(VOCABULARY, VOCABULARY - 1, np.int64)
    few = held[shared] < enough
    rank[shared[np.lexsort((np.where(few, -held[shared], held[shared]), few))]] = np.arange(len(shared))
    ranks = spark.sparkContext.broadcast(rank.astype(np.uint16))  # one number per vocabulary id

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in _steps(batches, 3):
            ids = [np.frombuffer(x, "<u2") for x in part.column(3).to_pylist()]
            yield part, ids, _routes(ids, ranks.value)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, key in steps(batches):
            size = [max(-(-shard_tokens // SHARD_DOCS), len(x)) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(key), *part.columns[:3], pa.array(size, pa.int64())],
                                             ["key", "doc_id", "digest", "rid", "size"])

    docs = table.where("ids is not null").select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("ids").alias("digest"), "rid", "ids",
        F.col("doc_id").alias("own_id"))
    # Written, as the sort reads its input twice.
    small = write_once(docs.mapInArrow(keyed, "key long, doc_id long, digest long, rid long, size long"), "routes")
    order = ["key", "doc_id", "digest", "rid"]
    summed = range_cumsum(small, [], order, F.col("size"), "upto")
    first = (summed.groupBy(F.floor((F.col("upto") - F.col("size")) / shard_tokens).alias("shard"))
                   .agg(F.min(F.struct(*order)).alias("p")).select("p.*").orderBy(*order).collect())
    firsts = spark.sparkContext.broadcast(_places(*zip(*first)))
    tasks = max(1, min(len(first), MAX_TASKS))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, key in steps(batches):
            place = _places(key, *part.columns[:3])
            shard = np.searchsorted(firsts.value, place, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard * tasks // len(first), pa.int32()), pa.array(shard), pa.array(key), *part.columns],
                ["task", "shard", "key", "doc_id", "digest", "rid", "ids", "own_id"])

    return (docs.mapInArrow(dealt, "task int, shard long, key long, doc_id long, digest long, rid long, ids binary, own_id long")
                .repartitionById(tasks, "task").sortWithinPartitions("shard", *order)
                .select("shard", F.col("own_id").alias("doc_id"), "ids"))


class _Shard:
    """BM25 index over some documents and the windows packed from them.

    The index holds the documents that were unused when it was last drawn up,
    which is done again when a third of them are used. Ids that many of them
    hold are rows of a matrix, the others lists of postings."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        lengths = np.array([len(d) for d in docs])
        self.docs, self.count, self.lengths = docs, len(docs), lengths
        # Postings in (id, document) order.
        key = np.concatenate([d.astype(np.uint32) for d in docs]) << 16
        key |= np.repeat(np.arange(self.count, dtype=np.uint32), lengths)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.append(first, len(key)))
        key = key[first]
        term, doc = (key >> 16).astype(np.int64), (key & 0xFFFF).astype(np.int64)
        norm = K1 * (1 - B + B * lengths[doc] / mean_length)
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
        kept = weight > 0
        term, doc, weight = term[kept], doc[kept], weight[kept]
        order = np.argsort(doc, kind="stable")
        self.own_terms, self.doc_begin = term[order], np.searchsorted(doc[order], np.arange(self.count + 1))
        self._draw_up(np.arange(self.count), term, doc, weight)

    def _draw_up(self, live: np.ndarray, term: np.ndarray, column: np.ndarray, weight: np.ndarray) -> None:
        """Index the documents ``live``; postings name them by their number in it."""
        self.live, self.term, self.column, self.weight = live, term, column, weight
        held = np.bincount(term, minlength=VOCABULARY)
        dense = np.flatnonzero(held * DENSE >= max(2, len(live)))
        self.row = np.full(VOCABULARY, -1)
        self.row[dense] = np.arange(len(dense))
        self.matrix = np.zeros((len(dense), len(live)), np.float32)
        inside = self.row[term] >= 0
        self.matrix[self.row[term[inside]], column[inside]] = weight[inside]
        self.begin = np.concatenate([[0], np.cumsum(held)])

    def neighbours(self, seed: int, used: np.ndarray, tokens: int) -> np.ndarray:
        """Unused documents by score, then place: all, or as many as hold ``tokens``."""
        taken = used[self.live]
        if 3 * np.count_nonzero(taken) > len(self.live):
            number = np.cumsum(~taken) - 1
            stay = ~taken[self.column]
            self._draw_up(self.live[~taken], self.term[stay], number[self.column[stay]], self.weight[stay])
            taken = np.zeros(len(self.live), bool)
        terms = self.own_terms[self.doc_begin[seed]:self.doc_begin[seed + 1]]
        rows = self.row[terms]
        score = self.matrix.take(rows[rows >= 0], axis=0).sum(axis=0)
        lists = terms[rows < 0]
        at = [slice(b, e) for b, e in zip(self.begin[lists].tolist(), self.begin[lists + 1].tolist()) if e > b]
        if at:
            score += np.bincount(np.concatenate([self.column[x] for x in at]),
                                 np.concatenate([self.weight[x] for x in at]), len(self.live)).astype(np.float32)
        score[taken] = 0
        found = np.flatnonzero(score > 0)
        best, first = found, FIRST_NEIGHBOURS
        while first < len(found):
            least = -np.partition(-score[found], first - 1)[first - 1]
            best = found[score[found] >= least]  # with all that tie
            if self.lengths[self.live[best]].sum() >= tokens:
                break
            best, first = found, first * 4
        return self.live[best[np.lexsort((best, -score[best]))]]

    def windows(self, window: int) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (document, start, length) that fill a window exactly; the
        last list may be shorter."""
        used = np.zeros(self.count, bool)
        pieces, free, fresh = [], window, 0
        doc, start, wanted = -1, 0, []
        while True:
            if doc < 0:  # the next neighbour of the seed, else a new seed
                while wanted and used[wanted[-1]]:
                    wanted.pop()
                if wanted:
                    doc = wanted.pop()
                else:
                    while fresh < self.count and used[fresh]:
                        fresh += 1
                    if fresh == self.count:
                        break
                    doc = fresh
                    used[doc] = True
                    if len(self.docs[doc]) < free:
                        wanted = list(self.neighbours(doc, used, window)[::-1])
                used[doc], start = True, 0
            take = min(free, len(self.docs[doc]) - start)
            pieces.append((doc, start, take))
            free, start = free - take, start + take
            cut = start < len(self.docs[doc])
            if not free:
                yield pieces
                pieces, free = [], window
                if cut and len(self.docs[doc]) - start < window:  # the rest seeds the next window
                    wanted = list(self.neighbours(doc, used, window)[::-1])
                elif not cut:
                    wanted = []
            if not cut:
                doc = -1
        if pieces:
            yield pieces


def _powers(pieces: list[tuple[int, int, int]], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Cut a list of pieces into lists whose lengths are powers of two."""
    left, total = list(pieces[::-1]), sum(p[2] for p in pieces)
    size = window
    while total:
        if size > total:
            size //= 2
            continue
        out, free = [], size
        while free:
            doc, start, length = left.pop()
            take = min(free, length)
            out.append((doc, start, take))
            free -= take
            if take < length:
                left.append((doc, start + take, length - take))
        total -= size
        yield out


def bm25_pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID,
              with_ids: bool = True, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with ``with_ids``, ids (two bytes each).

    Every id of every document lies in exactly one piece; the pieces of a
    sequence follow each other from offset 0. A null or empty text is the end
    id alone. Rows that repeat a doc_id are documents of their own. Equal
    scores go to the earlier document of the shard. An empty table gives an
    empty result; further columns are ignored."""
    spark = docs.sparkSession
    table = write_once(tokenized(docs, tokenizer, end_id), "tokens")
    # At most one row per vocabulary id reaches the driver.
    seen = (table.where("seen is not null").select("seen").mapInArrow(_summed, "id long, docs long")
            .groupBy("id").agg(F.sum("docs").alias("docs")).collect())
    totals = table.where("ids is not null").agg(
        F.count("*").alias("docs"), F.sum(F.octet_length("ids")).alias("size")).head()
    count, mean = totals["docs"], max(1.0, (totals["size"] or 0) / 2 / max(1, totals["docs"]))
    if not count:
        return empty_like(spark, PIECE + (", ids binary" if with_ids else ""))
    held = np.zeros(VOCABULARY)
    for r in seen:
        held[r["id"]] = r["docs"]
    idf = np.where(held > 0, np.log1p((count - held + 0.5) / (held + 0.5)), 0.0)
    idf[end_id] = 0.0
    shared = spark.sparkContext.broadcast(idf)  # one number per vocabulary id

    def packed(doc_ids: list, ids: list[np.ndarray], number: int) -> pa.RecordBatch:
        rows = []
        for full in _Shard(ids, shared.value, mean).windows(window):
            size = sum(p[2] for p in full)
            for pieces in [full] if size == window else _powers(full, window):
                offset = 0
                for doc, start, length in pieces:
                    part = ids[doc][start:start + length]
                    row = (doc_ids[doc], start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids[doc]), number, offset)
                    rows.append((*row, part.tobytes()) if with_ids else row)
                    offset += length
                number += 1
        names = [c.split()[0] for c in PIECE.split(", ")] + ["ids"] * with_ids
        types = [pa.int64()] * 7 + [pa.binary()] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, ids, current = [], [], None
        for batch in batches:
            for shard, doc_id, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if ids and shard != current:
                    yield packed(doc_ids, ids, current << 32)
                    doc_ids, ids = [], []
                current = shard
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(x, "<u2"))
        if ids:
            yield packed(doc_ids, ids, current << 32)

    return sharded(table, held, mean, shard_tokens, end_id).mapInArrow(
        run, PIECE + (", ids binary" if with_ids else ""))
