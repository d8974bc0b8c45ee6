"""Line de-duplication by pairwise alignment.

1. Every line is hashed. Each shortest run of successive lines that
   reaches ``MIN_BLOCK_CHARS``, from each line on and up to each line, gets a
   name; every block of that length consists of such runs.
2. A later document becomes a partner of the first holder of each run it holds.
   So a block of any number of holders is found, each member paired with first
   holders only, never with each other.
3. For a pair only the lines both documents hold are brought together (joined
   on document and line), and aligned by patience diff.
4. Aligned blocks of ``MIN_BLOCK_CHARS`` code points or more are deleted from
   the later document (larger doc_id).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import tasks_for, text_of, write_once

MIN_BLOCK_CHARS = 100
# Odd factors of the names of runs, and their inverses modulo 2**64.
BASES = [(b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def patience_matches(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j) of equal elements, aligned by patience diff: equal ends,
    then the longest increasing run of elements unique on both sides, and the
    same again between them."""
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        alo, ahi, blo, bhi = stack.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        once = {x for x, n in Counter(a[alo:ahi]).items() if n == 1} & {x for x, n in Counter(b[blo:bhi]).items() if n == 1}
        where = {x: i for i, x in enumerate(a[alo:ahi], alo) if x in once}
        pairs = [(where[x], j) for j, x in enumerate(b[blo:bhi], blo) if x in once]
        # Longest increasing run of the places in ``a``.
        tails, last, before = [], [], [-1] * len(pairs)
        for k, (i, _) in enumerate(pairs):
            at = bisect_left(tails, i)
            before[k] = last[at - 1] if at else -1
            tails[at:at + 1], last[at:at + 1] = [i], [k]
        chain, k = [], last[-1] if last else -1
        while k >= 0:
            chain.append(pairs[k])
            k = before[k]
        if not chain:
            continue
        i, j = alo, blo
        for x, y in chain[::-1]:
            out.append((x, y))
            stack.append((i, x, j, y))
            i, j = x + 1, y + 1
        stack.append((i, ahi, j, bhi))
    return sorted(out)


def aligned_blocks(lines: list[tuple[int, list, list, int]], min_chars: int) -> list[tuple[int, int]]:
    """Blocks (first line, lines) of the later document to delete. ``lines``:
    per common line its number, its places in the earlier and in the later
    document, and its length."""
    a = sorted((p, k) for k, pa_, _, _ in lines for p in pa_)
    b = sorted((p, k) for k, _, pb, _ in lines for p in pb)
    length = {k: n for k, _, _, n in lines}
    out, run = [], []

    def same(i, j, step):
        x, y = i + step, j + step
        return (0 <= x < len(a) and 0 <= y < len(b) and a[x] == (a[i][0] + step, b[y][1]) and b[y][0] == b[j][0] + step)

    def close():
        if not run:
            return
        # A line before or after may have been aligned with another equal one.
        (i, j), (k, end) = run[0], run[-1]
        while same(i, j, -1):
            i, j = i - 1, j - 1
        while same(k, end, 1):
            k, end = k + 1, end + 1
        if sum(length[x] for _, x in b[j:end + 1]) >= min_chars and (b[j][0], end + 1 - j) not in out[-1:]:
            out.append((b[j][0], end + 1 - j))

    for i, j in patience_matches([k for _, k in a], [k for _, k in b]):
        if run and (a[i][0] != a[run[-1][0]][0] + 1 or b[j][0] != b[run[-1][1]][0] + 1):
            close()
            run = []
        run.append((i, j))
    close()
    return out


def _align(min_chars: int):
    def of_pair(rows: pa.Table) -> list[tuple[int, int, int]]:
        lines = list(zip(range(rows.num_rows), rows["pa"].to_pylist(), rows["pb"].to_pylist(), rows["chars"].to_pylist()))
        rid = rows["b"][0].as_py()
        return [(rid, at, n) for at, n in aligned_blocks(lines, min_chars)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            key = np.stack([table["a"].to_numpy(), table["b"].to_numpy()], axis=1)
            ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            starts = np.concatenate([[0], ends])
            found = [x for s, e in zip(starts[:-1], ends) for x in of_pair(table.slice(s, e - s))]
            rest = table.slice(starts[-1])
            if found:
                yield emit(found)
        if rest is not None and rest.num_rows:
            found = of_pair(rest)
            if found:
                yield emit(found)

    def emit(found):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["rid", "at", "lines"])

    return run


def _lines(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, lines): the lines of each document, short ones included."""
    lines = F.transform(F.split(text_of(), "\n", -1), lambda x: F.struct(
        F.length(x).alias("chars"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")))
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), lines.alias("lines"))


def line_table(docs: DataFrame) -> DataFrame:
    """(rid, at, chars, h1, h2): every line; ``at`` counts those of the document."""
    return _lines(docs).select("rid", F.posexplode("lines").alias("at", "l")).select("rid", "at", "l.*")


def window_names(sizes: np.ndarray, chars: np.ndarray, hashes: list[np.ndarray], min_chars: int) -> tuple[np.ndarray, ...]:
    """(document, name, ...) of every shortest run of lines that reaches
    ``min_chars``: the one from each line on, and the one up to each line.
    ``sizes`` counts the lines of each document, the rest is flat."""
    total, doc = len(chars), np.repeat(np.arange(len(sizes)), sizes)
    end = np.cumsum(sizes)
    start = end - sizes
    before = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    at = np.arange(total)
    to = np.searchsorted(before, before[:-1] + min_chars, "left")
    since = np.searchsorted(before, before[1:] - min_chars, "right") - 1
    on, back = to <= end[doc], since >= start[doc]
    first, last = np.concatenate([at[on], since[back]]), np.concatenate([to[on], at[back] + 1])
    names = []
    for h, (base, inverse) in zip(hashes, BASES):
        power, undo = np.full(total + 1, base, np.uint64), np.full(total + 1, inverse, np.uint64)
        power[0] = undo[0] = 1
        power, undo = np.cumprod(power), np.cumprod(undo)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h.astype(np.uint64) * power[:-1], dtype=np.uint64)])
        names.append(((sums[last] - sums[first]) * undo[first]).astype(np.int64))
    return doc[first], *names


def _windows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("chars").offsets.to_numpy())
            chars, h1, h2 = (batch.column(c).flatten().to_numpy() for c in ("chars", "h1", "h2"))
            doc, w1, w2 = window_names(sizes, chars, [h1, h2], min_chars)
            order = np.lexsort((w2, w1, doc))
            doc, w1, w2 = doc[order], w1[order], w2[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            at = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays([batch.column("rid").take(at), batch.column("doc_id").take(at), pa.array(w1[new]), pa.array(w2[new])],
                                             ["rid", "doc_id", "w1", "w2"])

    return run


def window_table(docs: DataFrame, min_block_chars: int) -> DataFrame:
    """(rid, doc_id, w1, w2): each name of a run of lines once per document."""
    rows = _lines(docs).select("rid", "doc_id", *[F.col(f"lines.{c}").alias(c) for c in ("chars", "h1", "h2")])
    return rows.mapInArrow(_windows(min_block_chars), "rid long, doc_id long, w1 long, w2 long")


def _first_holder(held: DataFrame, keys: list[str]) -> DataFrame:
    """Per key held by two rows or more: the first."""
    return (held.groupBy(*keys).agg(F.count("*").alias("holders"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")).alias("f"))
            .where("holders > 1").select(*keys, F.col("f.rid").alias("first")))


def removed_blocks(docs: DataFrame, min_block_chars: int = MIN_BLOCK_CHARS) -> DataFrame:
    """(rid, partner count, blocks, lines): the lines to delete per document."""
    key = ["h1", "h2"]
    windows = write_once(window_table(docs, min_block_chars), "windows")
    pairs = write_once(windows.join(_first_holder(windows, ["w1", "w2"]), ["w1", "w2"]).where("rid <> first")
                       .select(F.col("first").alias("a"), F.col("rid").alias("b")).distinct(), "pairs")
    table = line_table(docs)
    # Only lines of documents that are in a pair are brought together.
    paired = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    held = table.join(paired, "rid", "left_semi").groupBy("rid", *key).agg(
        F.sort_array(F.collect_list("at")).alias("places"), F.first("chars").alias("chars"))
    shared = write_once(held, "shared")
    of_b = pairs.join(shared.select(F.col("rid").alias("b"), *key, F.col("places").alias("pb"), "chars"), "b")
    of_a = shared.select(F.col("rid").alias("a"), *key, F.col("places").alias("pa"))
    both = of_b.join(of_a, ["a", *key]).select("a", "b", "pa", "pb", "chars")
    blocks = (both.repartition(tasks_for(both), "a", "b").sortWithinPartitions("a", "b", F.col("pb")[0])
              .mapInArrow(_align(min_block_chars), "rid long, at long, lines long"))
    blocks = write_once(blocks, "blocks")
    counted = blocks.groupBy("rid").agg(F.count("*").alias("blocks"))
    lines = (blocks.select("rid", F.explode(F.expr("sequence(int(at), int(at + lines - 1))")).alias("line")).distinct()
             .groupBy("rid").agg(F.sort_array(F.collect_list("line")).alias("gone")))
    return lines.join(counted, "rid")


def line_dedup(docs: DataFrame, rare: int | None = None, min_block_chars: int = MIN_BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed (lines), n_blocks
    (aligned blocks, a line may lie in several) and text, the lines that stay.

    Later means larger doc_id, then later row; a null doc_id comes last. A null
    text is empty. Rows that repeat a doc_id are documents of their own, so of
    two equal rows the second one loses its lines. An empty table gives an
    empty result; further columns are ignored. ``docs`` is read three times and must
    give its rows in the same order each time, as a stored table does. ``rare``
    has no effect: a line finds its partners whatever the number of holders."""
    gone = removed_blocks(docs, min_block_chars)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # Merged at every size: a broadcast of ``gone`` holds for small tables only.
    joined = rows.join(gone.hint("merge"), "rid", "left").withColumn("parts", F.split("text", "\n", -1))
    total = F.size("parts")
    # The stretches between deleted lines.
    edges = F.arrays_zip(F.concat(F.array(F.lit(-1)), "gone").alias("p"), F.concat("gone", F.array(total)).alias("q"))
    kept = F.flatten(F.transform(edges, lambda x: F.slice("parts", x["p"] + 2, x["q"] - x["p"] - 1)))
    return joined.select(
        "doc_id", total.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("blocks", F.lit(0).cast("long")).alias("n_blocks"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
