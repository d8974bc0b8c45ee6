"""Exact per-group ranking that never puts a whole group into one task.

Two strategies, both exact:

* ``top_rows_per_group`` – rows ranked ``lo < rank <= hi`` inside each group,
  for bounded ``hi`` (a page): a tree of map-side partial top-k steps, so a
  group holding a third of all rows is cut down to ``k`` rows per input
  partition before anything is shuffled. Wider windows go to ``range_rank``.
* ``range_rank`` – a global rank per group from a range-partitioned sort:
  count rows per (group, partition), prefix-sum the counts per group (a tiny
  table), add the position inside the partition. No group is gathered.
* ``range_cumsum``, ``range_last`` – the same layout for a running sum, or the
  last value so far, per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import shared_dir

# Buckets merged per level of the top-k tree.
FANOUT = 64
# Largest helper table broadcast without further checks (rows).
BROADCAST_MAX_ROWS = 2_000_000


def _partitions(df: DataFrame) -> int:
    """Range partitions: the shuffle setting, or more when the input is larger."""
    from logloom.session import partitions_for

    spark = df.sparkSession
    return partitions_for(spark, df, floor=int(spark.conf.get("spark.sql.shuffle.partitions")))


def _cols(cs: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def group_limit_threshold(spark) -> int:
    """Largest literal k for which Spark plans a map-side partial top-k."""
    return int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def top_rows_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                       lo: Column, hi: Column, k: int, rank_col: str = "rank",
                       fanout: int = FANOUT, parts: int | None = None) -> DataFrame:
    """Rows with ``lo < rank <= hi`` per group, where every group's ``hi <= k``.

    A tree of partial top-k steps: rows are bucketed by the partition they
    sit in; each level keeps the first ``k`` rows per (group, bucket) and
    merges ``fanout`` buckets into one, with Spark's map-side partial limit
    (``WindowGroupLimit``) before every shuffle. A group is never gathered
    whole: each task holds at most ``fanout * k`` rows of a group. ``order``
    must be a total order within a group; ``k`` must not exceed
    ``group_limit_threshold``. ``parts`` is the number of partitions ``df``
    arrives in (estimated from its input when not given).
    """
    order = _cols(order)
    spark = df.sparkSession
    if k > group_limit_threshold(spark):
        raise ValueError("k above the partial-limit threshold; use range_rank")
    cur = (df.withColumn("__lo", lo).withColumn("__hi", hi)
             .withColumn("__b", F.spark_partition_id().cast("long")))
    levels, parts = 0, parts or _partitions(df)
    while fanout ** (levels + 1) < parts:
        levels += 1
    for i in range(1, levels + 1):
        bucket = F.floor(F.col("__b") / F.lit(fanout ** i))
        w = Window.partitionBy(*group, bucket).orderBy(*order)
        cur = cur.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= F.lit(k)).drop("__r")
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = cur.withColumn(rank_col, F.row_number().over(w).cast("long")).where(F.col(rank_col) <= F.lit(k))
    return (ranked.where((F.col(rank_col) > F.col("__lo")) & (F.col(rank_col) <= F.col("__hi")))
                  .drop("__lo", "__hi", "__b"))


def range_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
               rank_col: str = "rank", num_partitions: int | None = None,
               checkpoint: bool = True) -> DataFrame:
    """Dense rank 1..n inside each group by ``order`` (a total order), at any group size.

    The sorted layout is checkpointed (reliably, in the shared folder) so the
    count pass and the numbering pass see the same partitions even if an
    executor is lost in between.
    """
    spark = df.sparkSession
    order = _cols(order)
    n = num_partitions or _partitions(df)
    keys = [F.col(g) for g in group] + order
    laid = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__pos", F.monotonically_increasing_id()))
    if checkpoint:
        shared_dir(spark)  # make sure a checkpoint folder is set
        laid = laid.checkpoint(eager=True)
    counts = laid.groupBy(*group, "__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__first"))
    w = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    # Without groups the table has at most ``n`` rows (one per partition): a
    # proven bound. With groups, its rows and bytes are checked first.
    if not group or _small(offsets):
        offsets = F.broadcast(offsets)
    joined = laid.join(offsets, [*group, "__pid"])
    rank = F.col("__before") + (F.col("__pos") - F.col("__first")) + 1
    return joined.withColumn(rank_col, rank.cast("long")).drop("__pid", "__pos", "__first", "__before")


def _small(df: DataFrame) -> bool:
    from logloom.operators.joins import fits_broadcast

    return fits_broadcast(df)


def _running(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: Column,
             add, inclusive: bool, num_partitions: int | None, checkpoint: bool) -> DataFrame:
    """A running ``add`` (an aggregate that composes: sum, max) of ``value``
    inside each group in ``order``, at any group size: a range-partitioned sort,
    per-(group, partition) totals composed in a tiny table, then a running
    aggregate inside each partition. Null where there is nothing before."""
    order = _cols(order)
    n = num_partitions or _partitions(df)
    keys = [F.col(g) for g in group] + order
    laid = (df.withColumn("__v", value)
              .repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__pos", F.monotonically_increasing_id()))
    if checkpoint:
        shared_dir(df.sparkSession)  # make sure a checkpoint folder is set
        laid = laid.checkpoint(eager=True)
    totals = laid.groupBy(*group, "__pid").agg(add("__v").alias("__t"))
    w = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__before", add("__t").over(w)).drop("__t")
    # Inside one (group, partition) slice the rows are already in order; the
    # window below is partitioned by the slice, which is bounded by the
    # partition size, never by the group size.
    inner = Window.partitionBy(*group, "__pid").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    # Rows whose group is null are a group, too.
    offsets = offsets.select(F.col("__pid").alias("__part"), "__before", *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)])
    if not group or _small(offsets):
        offsets = F.broadcast(offsets)
    same = F.col("__pid") == F.col("__part")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    run = laid.withColumn("__run", add("__v").over(inner)).join(offsets, same)
    return run.drop("__part", *[f"__g{i}" for i in range(len(group))])


def range_cumsum(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: Column,
                 out_col: str = "cumsum", num_partitions: int | None = None,
                 checkpoint: bool = True) -> DataFrame:
    """Running sum of ``value`` inside each group in ``order`` (inclusive), at
    any group size."""
    run = _running(df, group, order, value, F.sum, True, num_partitions, checkpoint)
    return (run.withColumn(out_col, F.coalesce("__before", F.lit(0)) + F.col("__run"))
               .drop("__v", "__pid", "__pos", "__before", "__run"))


def range_last(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: Column,
               out_col: str = "last", num_partitions: int | None = None,
               checkpoint: bool = True) -> DataFrame:
    """The largest ``value`` of the rows before each row of its group in
    ``order`` (null: none), at any group size. With a value that grows with the
    order (a struct that starts with it), this is the last one that is not null."""
    run = _running(df, group, order, value, F.max, False, num_partitions, checkpoint)
    return (run.withColumn(out_col, F.greatest("__before", "__run"))
               .drop("__v", "__pid", "__pos", "__before", "__run"))
