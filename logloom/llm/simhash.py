"""SimHash near-duplicates by segment bit counts.

A 64-bit fingerprint is cut into 32 segments of two bits. The vector of bit
counts per segment (each 0, 1 or 2) is the embedding: the Manhattan distance of
two vectors never exceeds the number of differing bits. Two fingerprints
within ``max_bits`` therefore have vectors within ``max_bits`` in Manhattan
distance, and in one half of the segments within ``max_bits // 2``.

The range join runs on a grid over each half: a fingerprint enters the cell of
its vector and the cells one step away in one coordinate, so two vectors
within two steps meet in at least one cell. Inside a cell the candidates are
verified exactly on their bits. Equal fingerprints are one class before the
join. A cell with more members than a block is dealt out as pairs of blocks,
and a task reports a spanning forest of the links in its blocks rather than
all pairs, which leaves the reachable sets the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import components, tasks_for, text_of, write_once

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BLOCK = 2048
# Cells up to this size are compared all at once, larger ones member by member.
SMALL_CELL = 16
ODD_BITS = 0x55555555


def _fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # bytes: A-Z only, and [\x20\x09-\x0D]
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    count = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(rid, doc_id, fp): the SimHash of every whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = pa.array((_fingerprint(t.as_py(), shingle) for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["rid", "doc_id", "fp"])

    return (docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                        text_of().alias("text"))
            .mapInArrow(run, "rid long, doc_id long, fp long"))


def segment_counts(half: Column) -> Column:
    """The embedding of 32 bits: 16 lanes of two bits, each the bit count of
    its segment."""
    return half.bitwiseAND(F.lit(ODD_BITS)) + F.shiftright(half, 1).bitwiseAND(F.lit(ODD_BITS))


def grid_cells(classes: DataFrame) -> DataFrame:
    """(cell, fp): per half, the cell of the counts and those one step away."""
    halves = classes.select("fp", F.posexplode(F.array(
        F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))).alias("half", "bits")).select(
        "fp", "half", segment_counts(F.col("bits")).alias("v"))
    steps = F.expr("""
        concat(array(v),
          flatten(transform(sequence(0, 15), k -> filter(array(
            if((shiftright(v, 2 * k) & 3) < 2, v + shiftleft(1L, 2 * k), -1L),
            if((shiftright(v, 2 * k) & 3) > 0, v - shiftleft(1L, 2 * k), -1L)), x -> x >= 0))))""")
    return halves.select(F.explode(steps).alias("code"), "half", "fp").select(
        F.shiftleft(F.col("half").cast("long"), 32).bitwiseOR(F.col("code")).alias("cell"), "fp")


def _differing(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64))  # of a signed value it would count the bits of -x


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fps`` (every pair is decided)."""
    links, rest = [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _differing(rest, at) <= max_bits
            if near.any():
                found = rest[near]
                links.extend((int(at), int(x)) for x in found)
                queue.extend(found)
                rest = rest[~near]
    return links


def _verified(max_bits: int):
    """Links in each run of equal (cell, i, j) of a sorted partition."""

    def whole_runs(tables: Iterator[np.ndarray]):
        rest = None
        for rows in tables:
            rows = rows if rest is None else np.concatenate([rest, rows])
            if not len(rows):
                continue
            ends = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            if not len(ends):
                rest = rows
                continue
            yield rows[:ends[-1]]
            rest = rows[ends[-1]:]
        if rest is not None:
            yield rest

    def links(rows: np.ndarray) -> np.ndarray:
        new = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(rows)))
        run = np.cumsum(new) - 1
        fps = rows[:, 3]
        out = [np.empty((0, 2), np.int64)]
        small = sizes[run] <= SMALL_CELL
        f, r = fps[small], run[small]
        for gap in range(1, SMALL_CELL):
            same = np.flatnonzero(r[gap:] == r[:-gap])
            if not len(same):
                break
            near = same[_differing(f[same], f[same + gap]) <= max_bits]
            out.append(np.stack([f[near], f[near + gap]], axis=1))
        for k in np.flatnonzero(sizes > SMALL_CELL):
            found = _forest(fps[starts[k]:starts[k] + sizes[k]], max_bits)
            if found:
                out.append(np.array(found, np.int64))
        return np.unique(np.concatenate(out), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = (np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) for b in batches)
        for rows in whole_runs(arrays):
            found = links(rows)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def fingerprint_links(classes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b) links that connect exactly the fingerprints (one row each in
    ``classes``) reachable over pairs within ``max_bits`` differing bits."""
    if not 0 <= max_bits <= 5:
        raise ValueError("the grid covers up to 5 differing bits")
    cells = grid_cells(classes)
    hot = write_once(cells.groupBy("cell").count().where(F.col("count") > block)
                     .select("cell", F.ceil(F.col("count") / block).cast("long").alias("blocks")), "hotcells")
    dealt = (cells.join(hot, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
             .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
             .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))
    return (dealt.repartition(tasks_for(dealt), "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "fp")
            .mapInArrow(_verified(max_bits), "a long, b long"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id;
    also rid, the row's number in reading order, and keep_rid, that of the row
    that stands for its component.

    Words are split on ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z; a text of fewer
    words than a shingle is one shingle, a text of none (a null one too) has
    fingerprint zero and is linked like any other. component_id is the smallest
    doc_id reachable over links (nulls aside; null if there is no other).
    Repeated rows and doc_ids stay rows of their own. An empty table gives an
    empty result; further columns are ignored."""
    fps = write_once(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    classes = write_once(fps.groupBy("fp").agg(first.alias("least")), "classes")
    joined = components(fingerprint_links(classes.select("fp"), max_bits))
    # Both sides of the join below are written, so it deals them out itself and
    # adaptive execution can split the side of a component of very many classes.
    linked = write_once(classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")), "linked")
    least = write_once(linked.groupBy("component").agg(F.min("least").alias("top")), "least")
    by_fp = write_once(linked.join(least, "component").select(
        "fp", F.col("top.doc_id").alias("component_id"), F.col("top.rid").alias("keep_rid")), "byfp")
    # Many copies meet one row of ``by_fp``; adaptive execution splits their side.
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "rid", "keep_rid")
