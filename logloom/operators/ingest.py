"""Appending decoded events to the stored table, and checking what was written."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.ranking import range_rank
from logloom.schema import LOG_COLUMNS
from logloom.sources import store, versions


def next_id_base(spark: SparkSession, path: str, exclude_batch: int | None = None) -> int:
    """The largest id stored in any batch other than ``exclude_batch`` (0 for
    a new table). Rewriting the latest batch therefore gets the same base
    again (a retried micro-batch keeps its ids); rewriting an older batch
    after newer ones gives it new ids above them (still unique); a new batch
    starts above every id already stored, whatever its number. Answered from
    the table's newest version file.
    """
    return versions.load(spark, path).largest_id(exclude_batch)


def now_millis() -> dt.datetime:
    """The ingest time, once per batch on the driver, cut to milliseconds."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return now.replace(microsecond=now.microsecond // 1000 * 1000)


# Rows per file of an append.
ROWS_PER_FILE = 250_000


def assign_ids(rows: DataFrame, base: int, added: dt.datetime,
               order: tuple[str, ...] = ("batch_id", "pos"), num_partitions: int | None = None) -> DataFrame:
    """Dense increasing ids ``base+1 ..`` in ``order`` (exact, no global
    window: a range-partitioned sort plus per-partition offsets) and one
    ``added`` time for the whole batch."""
    ranked = range_rank(rows, [], list(order), "__rank", num_partitions=num_partitions)
    return (ranked.withColumn("id", (F.lit(base) + F.col("__rank")).cast("long"))
                  .withColumn("added", F.lit(added).cast("timestamp_ntz"))
                  .drop("__rank"))


def append_rows(rows: DataFrame, path: str, batch: int, added: dt.datetime | None = None,
                base: int | None = None, n_rows: int | None = None) -> DataFrame:
    """Append as ``append_logs`` does, and return the rows as they were
    stamped (batch_id, pos and the 12 columns), from their checkpoint; the
    table is not read back."""
    spark = rows.sparkSession
    kept = None
    if n_rows is None:
        kept = rows = rows.persist()
        n_rows = rows.count()
    while True:
        start = next_id_base(spark, path, exclude_batch=batch) if base is None else base
        stamped = assign_ids(rows, start, added or now_millis(), num_partitions=max(1, -(-n_rows // ROWS_PER_FILE)))
        try:
            # The id assignment leaves the rows range-partitioned and balanced.
            store.write_logs(stamped, path, batch=batch, cluster=False, max_id=start + n_rows, base=start)
            break
        except versions.StaleIds:
            if base is not None:
                raise
    if kept is not None:
        kept.unpersist()
    return stamped.select("batch_id", "pos", *LOG_COLUMNS)


def append_logs(rows: DataFrame, path: str, batch: int, added: dt.datetime | None = None,
                base: int | None = None, n_rows: int | None = None) -> DataFrame:
    """Append enriched events (batch_id, pos, app, address, timestamp, message,
    logger, thread, level, client, user_agent, stacktrace) as ingest batch
    ``batch``: ids increase in (batch_id, pos) order, ``added`` is the ingest
    time. An empty input writes no rows. Returns the rows as stored, read back
    by id, with their batch_id and pos.

    The rows become visible at once, with the table's next version. Replaying
    the same ``batch`` replaces its rows, also inside a merged folder, so a
    retried micro-batch never duplicates rows. If another batch is published
    meanwhile, the ids are taken anew above its own (an error when the caller
    gave ``base``). The batch is decoded once: unless the caller gives
    ``n_rows`` (and holds the rows already), they are kept while they are
    counted, laid out and written. Its size sets the number of files.
    """
    stamped = append_rows(rows, path, batch, added, base, n_rows)
    return written_rows(read_batch(rows.sparkSession, path, batch), stamped.select("batch_id", "pos", "id"))


def read_batch(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The rows of one ingest batch (only its folders are opened)."""
    df = store.read_batch(spark, path, batch)
    return df.where(store.valid_rows(df)).select(*LOG_COLUMNS)


def written_rows(logs: DataFrame, ids: DataFrame) -> DataFrame:
    """Re-read rows by id (``ids``: id plus any columns to carry, e.g. batch_id, pos)."""
    carry = [c for c in ids.columns if c != "id"]
    return logs.join(ids, "id").select(*carry, *LOG_COLUMNS)


def write_check(inputs: DataFrame, written: DataFrame, key: str = "batch_id") -> DataFrame:
    """Per batch: events given, rows read back, and whether they agree."""
    n_in = inputs.groupBy(key).agg(F.count(F.lit(1)).alias("n_in"))
    n_out = written.groupBy(key).agg(F.count(F.lit(1)).alias("n_out"))
    j = n_in.join(n_out, key, "full_outer")
    return j.select(key, F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"),
                    (F.coalesce("n_in", F.lit(0)) == F.coalesce("n_out", F.lit(0))).alias("ok"))
