"""Exact de-duplication by deterministic block naming.

The white-space-free text of every document is cut into blocks of a fixed
number of characters. All blocks are sorted and equal ones get the same
integer name; then adjacent pairs of names are sorted and named in the same
way, level by level, until each document is down to one name. Names come from
ranks in a sort and equal blocks are compared character by character, so no
identity rests on a hash.

The sort order is (128-bit hash of the block, row, position): only short keys
are sampled for the range bounds, and the row in the key lets a block shared
by a third of all documents spread over many partitions. Each task numbers the
distinct blocks of its slice; the first and last block of every slice (one row
a task) say where a run of equal blocks crosses a slice border. Two different
blocks with one hash would show up as neighbours in the sort; the naming is
then repeated under another hash seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import tasks_for, text_of, write_once

BLOCK = 4096
SPACES = " \t\n\x0b\x0c\r"


def _ranker(keys: list[str], keep: list[str], check: str | None):
    """Number the distinct ``keys`` of a sorted partition from 0, batch by
    batch: a row per input row, and at the end two rows with ``edge`` set that
    hold the partition's first and last key (and ``check`` value).

    ``check``: a column that must be equal where the keys are."""
    cols = [*keys, *([check] if check else [])]

    def differs(table: pa.Table, names: list[str]) -> pa.Array:
        size = table.num_rows
        out = pa.array([False] * (size - 1), pa.bool_())
        for c in names:
            col = table[c].combine_chunks()
            out = pc.or_(out, pc.not_equal(col.slice(1), col.slice(0, size - 1)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        first = last = None
        name, clashed = -1, False
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            n = rows.num_rows
            if not n:
                continue
            first = rows.slice(0, 1).select(cols) if first is None else first
            joint = rows.select(cols) if last is None else pa.concat_tables([last, rows.select(cols)])
            new = differs(joint, keys)
            if check:
                clash = pc.and_(pc.invert(new), differs(joint, [check]))
                clashed = clashed or bool(pc.any(clash, min_count=0).as_py())
            step = pc.cast(new, pa.int64())
            if last is None:
                step = pa.concat_arrays([pa.array([1], pa.int64()), step])
            names = pc.add(pc.cumulative_sum(step), name)
            name, last = names[-1].as_py(), joint.slice(joint.num_rows - 1)
            yield emit(rows.select(keep), n, slot, names, None, None, None)
        if first is not None:
            for edge, local in ((first, 0), (last, name)):
                blank = pa.Table.from_arrays([pa.nulls(1, rows.schema.field(c).type) for c in keep], keep)
                for k in keys:
                    blank = blank.set_column(keep.index(k), k, edge[k])
                yield emit(blank, 1, slot, pa.array([local], pa.int64()), "first" if local == 0 and edge is first else "last",
                           edge[check][0].as_py() if check else None, clashed)

    def emit(table, n, slot, names, edge, text, clash):
        arrays = [table[c].combine_chunks() for c in keep]
        arrays += [pa.array([slot] * n, pa.int32()), names, pa.array([edge] * n, pa.string()),
                   pa.array([text] * n, pa.string()), pa.array([clash] * n, pa.bool_())]
        arrays = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays]
        return pa.RecordBatch.from_arrays(arrays, [*keep, "slot", "local", "edge", "edge_text", "clash"])

    return run


def _named(rows: DataFrame, keys: list[str], keep: list[str], check: str | None = None) -> tuple[DataFrame, bool]:
    """Add ``name``: the rank of the row's ``keys`` among all distinct keys.

    ``rows`` needs ``rid`` and ``idx`` (they only split long runs of equal
    keys). Returns the rows and whether two equal keys differed in ``check``."""
    spark = rows.sparkSession
    order = [*keys, "rid", "idx"]
    kept = list(dict.fromkeys([*keep, *order]))
    shape = rows.schema
    out = ", ".join(f"{c} {shape[c].dataType.simpleString()}" for c in kept)
    local = write_once(
        rows.select(*kept, *([check] if check else []))
            .repartitionByRange(tasks_for(rows), *order).sortWithinPartitions(*order)
            .mapInArrow(_ranker(keys, kept, check),
                        f"{out}, slot int, local long, edge string, edge_text string, clash boolean"), "names")
    edges = local.where("edge is not null")
    # Two rows per task: its first and last key, and how many names it gave.
    ends: dict[int, dict] = {}
    for e in edges.select("slot", "edge", "local", "clash", *keys).collect():
        ends.setdefault(e["slot"], {})[e["edge"]] = e
    offsets, crossing, total, prev, clash = [], [], 0, None, False
    for slot in sorted(ends):
        lo, hi = ends[slot]["first"], ends[slot]["last"]
        shared = prev is not None and all(lo[k] == prev[k] for k in keys)
        base = total - 1 if shared else total
        if shared:
            crossing.append((prev["slot"], slot))
        offsets.append((slot, base))
        total, prev, clash = base + hi["local"] + 1, hi, clash or bool(hi["clash"])
    if check and crossing:
        pairs = F.broadcast(spark.createDataFrame(crossing, "before int, after int"))  # at most a row per task
        left = edges.where("edge = 'last'").select(F.col("slot").alias("before"), F.col("edge_text").alias("x"))
        right = edges.where("edge = 'first'").select(F.col("slot").alias("after"), F.col("edge_text").alias("y"))
        clash = clash or pairs.join(left, "before").join(right, "after").where("x <> y").limit(1).count() > 0
    table = spark.createDataFrame(offsets or [(0, 0)], "slot int, base long")  # one row per task
    named = (local.where("edge is null").join(F.broadcast(table), "slot")
             .withColumn("name", F.col("base") + F.col("local")))
    return named.select(*keep, "name"), clash


def block_names(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rid, doc_id, chars, text_sha256, n_blocks, identity): one row per input
    row; two rows have equal (n_blocks, identity) exactly when their texts
    without white space are equal."""
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text_of()).cast("long").alias("chars"),
        F.translate(text_of(), SPACES, "").alias("body"))
    cut = base.select(
        "rid", "doc_id", "chars", F.sha2("body", 256).alias("text_sha256"),
        F.when(F.length("body") <= block, F.array("body"))
         .otherwise(F.regexp_extract_all("body", F.lit("(?s).{1,%d}" % block), F.lit(0))).alias("blocks"))
    rows = cut.select("rid", "doc_id", "chars", "text_sha256", F.size("blocks").alias("n_blocks"),
                      F.posexplode("blocks").alias("idx", "block"))
    head = F.col("idx") == 0
    for seed in range(8):
        keyed = rows.select(
            "rid", "idx", "n_blocks", "block",
            *[F.when(head, F.col(c)).alias(c) for c in ("doc_id", "chars", "text_sha256")],
            F.xxhash64("block", F.lit(seed)).alias("h1"), F.xxhash64(F.lit(seed), "block").alias("h2"))
        named, clash = _named(keyed, ["h1", "h2"], ["rid", "idx", "n_blocks", "doc_id", "chars", "text_sha256"], "block")
        if not clash:
            break
    else:
        raise RuntimeError("no hash seed separates the blocks")
    facts = named.where("idx = 0").select("rid", "doc_id", "chars", "text_sha256", "n_blocks",
                                          F.when(F.col("n_blocks") == 1, F.col("name")).alias("identity"))
    done = []
    level = write_once(named.where("n_blocks > 1").select("rid", "idx", "name", F.col("n_blocks").alias("left")), "level")
    while level.limit(1).count():
        # Adjacent pairs; a last single name pairs with -1.
        pairs = (level.groupBy("rid", (F.col("idx") / 2).cast("int").alias("at"), F.ceil(F.col("left") / 2).cast("int").alias("left"))
                 .agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
                      F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("b"))
                 .withColumnRenamed("at", "idx"))
        named, _ = _named(pairs, ["a", "b"], ["rid", "idx", "left"])
        done.append(named.where("left = 1").select("rid", F.col("name").alias("final")))
        level = write_once(named.where("left > 1").select("rid", "idx", "name", "left"), "level")
    if not done:
        return facts
    final = done[0]
    for more in done[1:]:
        final = final.unionByName(more)
    return (facts.join(final, "rid", "left")
            .select("rid", "doc_id", "chars", "text_sha256", "n_blocks", F.coalesce("identity", "final").alias("identity")))


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of texts that are equal without white space ``[\\x20\\x09-\\x0D]``, the row with
    the most code points stays, then the smallest doc_id (a null doc_id last,
    then the first row). A null text is empty; all empty texts form one group.
    Rows that repeat a doc_id are rows of their own, of which one stays. An
    empty table gives an empty result; further columns are ignored."""
    names = write_once(block_names(docs, block), "identities")
    order = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("nul"),
                     F.col("doc_id").alias("d"), F.col("rid").alias("r"))
    # Written first, so the join deals out both sides itself and adaptive
    # execution can split the side of a group that holds a third of all rows.
    groups = write_once(names.groupBy("n_blocks", "identity").agg(
        F.min(order).alias("best"), F.count("*").alias("group_size")), "groups")
    return (names.join(groups, ["n_blocks", "identity"])
            .select("doc_id", F.col("best.d").alias("keep_id"), "group_size",
                    (F.col("rid") == F.col("best.r")).alias("kept"), "text_sha256", "rid"))
