"""The stored log table: Parquet in folders of one day each, under versions.

A bulk load range-partitions the rows on (added_date, app, added, id) before
the write, so a hot day or app spreads over many tasks; appends keep the
balanced partitions of their id assignment. Either way every file is sorted
on the columns the searches filter and order by, so row-group statistics
skip most of a file for an app/time filter. Appends, replays and merges publish
a new version of the table (``versions``); a scan reads one version.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.levels import LEVEL_INTS
from logloom.schema import BATCH_COLUMN, LOG_COLUMNS, LOGS_STORED, PARTITION_COLUMN, WRITE_COLUMN
from logloom.session import list_names, partitions_for, path_exists, remove, shared_dir, size_stamp
from logloom.sources import fixtures, versions

# Bumped whenever the on-disk layout changes, so old folders are never mixed in.
STORE_VERSION = "v4"


def with_partition_column(df: DataFrame) -> DataFrame:
    return df.withColumn(PARTITION_COLUMN, F.to_date(F.col("added")))


def replace_batch(df: DataFrame, path: str, batch: int, day: str = PARTITION_COLUMN) -> None:
    """Write ``df`` as batch ``batch`` of a table laid out ``<day>=.../batch=<n>``.
    What an earlier attempt left of the batch, on any day, is deleted first."""
    spark = df.sparkSession
    for name in list_names(spark, path):
        if name.startswith(f"{day}="):
            remove(spark, f"{path}/{name}/{BATCH_COLUMN}={batch}")
    df.withColumn(BATCH_COLUMN, F.lit(batch).cast("long")).write.mode("append").partitionBy(day, BATCH_COLUMN).parquet(path)


def write_logs(df: DataFrame, path: str, batch: int = 0, num_files: int | None = None,
               cluster: bool = True, max_id: int | None = None, base: int | None = None) -> versions.Version:
    """Write rows of the 12-column schema as batch ``batch`` of the table at
    ``path`` and publish them, in place of what an earlier attempt wrote of the
    batch. Its largest id is read back from the batch when the caller does not
    know it; with ``base``, ids that another batch took meanwhile are an error.

    ``cluster`` range-partitions the rows first (a bulk load: each file holds
    one slice of (date, app, added, id)). Without it the rows keep their
    partitions, which must already be balanced (an append right after the id
    assignment), and are only sorted within each file, which still gives
    row-group statistics on app and time. A bulk load is also counted by cell."""
    spark = df.sparkSession
    df = with_partition_column(df.select(*LOG_COLUMNS))
    if cluster:
        if num_files is None:
            num_files = partitions_for(spark, df)
        df = df.repartitionByRange(num_files, PARTITION_COLUMN, "app", "added", "id")
    write = versions.new_write()
    (df.sortWithinPartitions(PARTITION_COLUMN, "app", "added", "id").withColumn(BATCH_COLUMN, F.lit(batch).cast("long"))
       .write.partitionBy(PARTITION_COLUMN).parquet(f"{path}/{write}"))
    folders = versions.written_folders(spark, path, write, {batch: max_id}, cells=cluster)
    if folders and cluster:
        _write_cells(spark, path, write, folders)
    if folders and max_id is None:
        max_id = _read_folders(spark, path, folders).agg(F.max("id")).first()[0]
        folders = [replace(f, batches={batch: max_id}) for f in folders]
    return versions.publish_batch(spark, path, batch, folders, base)


def compact_logs(spark: SparkSession, path: str, day, batch: int) -> int:
    """Merge a day's folders of batches up to ``batch`` into one set of files;
    returns the number of folders merged. Safe beside readers and writers: the
    merged folder is complete before the version that names it is published,
    the old ones stay for the readers of older versions (see ``expire``), and
    when a batch among them is replayed meanwhile, the merge starts again."""
    while True:
        cur = versions.load(spark, path)
        old = [f for f in cur.folders.values() if f.day == str(day) and all(b <= batch for b in f.batches)]
        if not any(f.dropped for f in old) and len(old) < 2:
            return 0
        rows = _read_folders(spark, path, old).drop(WRITE_COLUMN)
        write = versions.new_write()
        (rows.repartitionByRange(partitions_for(spark, rows, floor=1), "app", "added", "id")
             .sortWithinPartitions("app", "added", "id").write.partitionBy(PARTITION_COLUMN).parquet(f"{path}/{write}"))
        batches: dict[int, int | None] = {}
        for f in old:
            batches |= f.batches
        merged = versions.written_folders(spark, path, write, batches, cells=True)
        if merged:
            _write_cells(spark, path, write, merged)
        try:
            versions.publish_merge(spark, path, old, merged)
            return len(old)
        except versions.Changed:
            continue


def expire(spark: SparkSession, path: str, keep: int = 8, grace_seconds: float = versions.GRACE_SECONDS) -> list[str]:
    """Delete the folders that none of the newest ``keep`` versions holds."""
    return versions.expire(spark, path, keep, grace_seconds)


@dataclass(frozen=True)
class Cut:
    """A point between the stored rows and those to come: a version of the
    table, and the largest id in it. Ids grow from batch to batch, so a row is
    in the version or has an id above the mark."""

    version: int
    high_id: int


def cut(spark: SparkSession, path: str) -> Cut:
    cur = versions.load(spark, path)
    return Cut(cur.number, cur.largest_id())


def valid_rows(df: DataFrame) -> Column:
    """Rows the reader accepts: a known level and a non-negative id."""
    return F.col("level").isin(LEVEL_INTS) & (F.col("id") >= 0)


def _read_folders(spark: SparkSession, path: str, folders: list[versions.Folder]) -> DataFrame:
    """The rows of some folders but those of batches that were replaced."""
    if not folders:
        return spark.createDataFrame([], LOGS_STORED)
    df = spark.read.schema(LOGS_STORED).option("basePath", path).parquet(*[f"{path}/{f.path}" for f in folders])
    for f in folders:
        if f.dropped:
            df = df.where((F.col(WRITE_COLUMN) != f.write) | ~F.col(BATCH_COLUMN).isin(list(f.dropped)))
    return df


def read_stored(spark: SparkSession, path: str, version: int | None = None,
                days: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """The raw rows of a version (the newest by default), no checks; with
    ``days`` (first, last as yyyy-mm-dd), folders of other days are not listed."""
    cur, (first, last) = versions.load(spark, path, version), days
    return _read_folders(spark, path, [f for f in cur.folders.values()
                                       if (first is None or f.day >= first) and (last is None or f.day <= last)])


def read_batch(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The raw rows of one ingest batch; only the folders that hold it are opened."""
    return _read_folders(spark, path, versions.load(spark, path).of_batch(batch)).where(F.col(BATCH_COLUMN) == batch)


def scan_logs(spark: SparkSession, path: str, keep_partition: bool = True, version: int | None = None,
              days: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Read the stored columns in their fixed order; invalid rows are dropped
    (see ``invalid_logs`` for them). The partition column is kept so that
    time filters can prune dates. The version is fixed when the scan is made:
    later appends and merges do not change what it reads."""
    df = read_stored(spark, path, version, days)
    cols = LOG_COLUMNS + ([PARTITION_COLUMN] if keep_partition else [])
    return df.where(valid_rows(df)).select(*cols)


# A cell: the rows of a batch with one app, one level and one hour of ``added``.
CELL = [PARTITION_COLUMN, "hour", "app", "level", BATCH_COLUMN]


def _counted(rows: DataFrame, *more: str) -> DataFrame:
    hour = F.date_trunc("hour", F.col("added")).cast("timestamp_ntz").alias("hour")
    return rows.where(valid_rows(rows)).select(*more, PARTITION_COLUMN, hour, "app", "level", BATCH_COLUMN).groupBy(
        *more, *CELL).agg(F.count(F.lit(1)).alias("n"))


def _write_cells(spark: SparkSession, path: str, write: str, folders: list[versions.Folder]) -> None:
    rows = _read_folders(spark, path, folders)
    _counted(rows).write.mode("overwrite").parquet(f"{path}/{versions.CELLS}/{write}")


def cell_counts(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(added_date, hour, app, level, n): the valid rows of a version by cell.
    Bulk loads and merges leave these counts beside their rows; the folders of
    small appends since are counted here (three columns of them are read)."""
    cur = versions.load(spark, path, version)
    kept = [f for f in cur.folders.values() if f.cells]
    parts = _counted(_read_folders(spark, path, [f for f in cur.folders.values() if not f.cells]))
    writes = sorted({f.path.split("/")[0] for f in kept})
    if writes:
        root = f"{path}/{versions.CELLS}"
        stored = spark.read.option("basePath", root).parquet(*[f"{root}/{w}" for w in writes])
        live = spark.createDataFrame([(f.write, f.day) for f in kept], f"{WRITE_COLUMN} string, day string")
        day = F.coalesce(F.col(PARTITION_COLUMN).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
        stored = stored.withColumn("day", day).join(live, [WRITE_COLUMN, "day"], "left_semi")
        for f in kept:
            if f.dropped:
                stored = stored.where((F.col(WRITE_COLUMN) != f.write) | ~F.col(BATCH_COLUMN).isin(list(f.dropped)))
        parts = parts.unionByName(stored.select(*CELL, "n"))
    return parts.groupBy(PARTITION_COLUMN, "hour", "app", "level").agg(F.sum("n").alias("n"))


def invalid_logs(spark: SparkSession, path: str) -> DataFrame:
    """Rows the reader rejects (unknown level or negative id)."""
    df = read_stored(spark, path)
    return df.where(~valid_rows(df)).select(*LOG_COLUMNS)


def _source_tag(spark: SparkSession, sf_dir: str, table: str) -> str:
    stamp = size_stamp(spark, f"{sf_dir.rstrip('/')}/{table}.parquet")
    return hashlib.sha1(stamp.encode()).hexdigest()[:12]


def materialized_view(spark: SparkSession, sf_dir: str, name: str = "logs") -> str:
    """Write a log-shaped fixture view (``logs`` or ``doc_logs``) to the shared
    folder once and return its path; later calls reuse it."""
    base = fixtures.DEPENDS[name][0]
    path = f"{shared_dir(spark)}/logloom-store/{STORE_VERSION}/{name}-{_source_tag(spark, sf_dir, base)}"
    if not path_exists(spark, f"{path}/_done/_SUCCESS"):
        write_logs(fixtures.view(spark, sf_dir, name), path, batch=0)
        spark.createDataFrame([(1,)], "done int").coalesce(1).write.mode("overwrite").parquet(f"{path}/_done")
    return path


# Scans of written-once stores, per session: the DataFrame keeps its file
# index, so repeated queries do not list the partition folders again.
_SCANS: dict[tuple[int, str], DataFrame] = {}


def logs_table(spark: SparkSession, sf_dir: str, name: str = "logs") -> DataFrame:
    """The stored ``logs`` (or ``doc_logs``) table for ``sf_dir``, scanned.

    These stores are written once and never appended to, so the scan is
    reused within a session."""
    key = (id(spark._jsparkSession), f"{sf_dir.rstrip('/')}:{name}")
    df = _SCANS.get(key)
    if df is None:
        df = scan_logs(spark, materialized_view(spark, sf_dir, name))
        _SCANS[key] = df
    return df


def materialized_raw(spark: SparkSession, sf_dir: str, num_files: int = 16) -> str:
    """The raw JSON batches of ``sf_dir`` written once as Parquet files (an
    inbox of messages, as sources would leave them); later calls reuse it."""
    path = f"{shared_dir(spark)}/logloom-store/{STORE_VERSION}/raw{num_files}-{_source_tag(spark, sf_dir, 'events')}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        fixtures.raw_batches(spark, sf_dir).repartition(num_files, "batch_id").write.mode("overwrite").parquet(path)
    return path


def raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(materialized_raw(spark, sf_dir))


def fixture_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A non-log fixture view (``presence``, ``apps``, ``admins``) written once
    to the shared folder and read from there (scan reused per session)."""
    key = (id(spark._jsparkSession), f"{sf_dir.rstrip('/')}:{name}")
    df = _SCANS.get(key)
    if df is None:
        base = fixtures.DEPENDS[name][0]
        base = fixtures.DEPENDS[base][0] if base in fixtures.TEMPLATES else base
        path = f"{shared_dir(spark)}/logloom-store/{STORE_VERSION}/{name}-{_source_tag(spark, sf_dir, base)}"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            view = fixtures.view(spark, sf_dir, name)
            view.repartition(partitions_for(spark, view)).write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
        _SCANS[key] = df
    return df
