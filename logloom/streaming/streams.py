"""Structured Streaming forms: ingest, live tail, history-then-tail, de-dup, presence.

Every query writes to a file sink or through ``foreachBatch`` into folders
that are replaced per micro-batch, with a checkpoint in the shared folder, so
a restarted or retried micro-batch never duplicates output.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.operators import decode as dec
from logloom.operators import ingest as ing
from logloom.operators.filters import SearchSpec, append_token_index, search_gate_value
from logloom.operators.presence import JOINED
from logloom.operators.registry import with_known_apps
from logloom.operators.search import history_search
from logloom.functions.levels import levels_at_least
from logloom.functions.text import clean_name
from logloom.schema import BATCH_COLUMN, PARTITION_COLUMN
from logloom.session import create_once, list_names, partitions_for, path_exists, read_bytes, remove
from logloom.sources import store


def file_stream(spark: SparkSession, folder: str, name: str | None = None,
                max_files: int | None = None, schema=None) -> DataFrame:
    """A Parquet folder as a stream (optionally only the file ``<name>.parquet``)."""
    if schema is None:
        probe = f"{folder.rstrip('/')}/{name}.parquet" if name else folder
        schema = spark.read.parquet(probe).schema
    reader = spark.readStream.schema(schema)
    if name:
        reader = reader.option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def _start(df_writer, available_now: bool) -> StreamingQuery:
    if available_now:
        df_writer = df_writer.trigger(availableNow=True)
    return df_writer.start()


# ---------------------------------------------------------------------------
# ingest

def ingest_stream(raw_stream: DataFrame, table: str, updates: str, checkpoint: str,
                  legacy: str = "strict", available_now: bool = False,
                  apps: DataFrame | None = None, index: str | None = None) -> StreamingQuery:
    """Raw JSON batches → decode → enrich → append to ``table`` → publish the
    stored rows to ``updates`` (one folder per micro-batch). With ``apps``, a
    message of an app that is not registered is rejected; with ``index``, the
    token index there gets the words of the stored rows.

    The micro-batch id is the table's ingest batch: a replayed micro-batch
    rewrites the same folders with the same ids (its base excludes its own
    batch). The stream should own the table's batch numbers.
    Rejected messages go to ``updates/_rejected``.
    """
    def each(batch: DataFrame, epoch: int) -> None:
        # Decoded once per micro-batch and reused by every write below; the
        # source files can always be re-read if a cached block is lost.
        decoded = dec.decode_batches(batch, "raw", legacy)
        if apps is not None:
            named = decoded.withColumn("app", clean_name("app"))
            known = with_known_apps(named, apps, salt_key=["batch_id"])
            reason = F.coalesce("reason", F.when(~F.col("known"), F.lit(dec.UNKNOWN_APP)))
            decoded = known.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).drop("known")
        decoded = decoded.persist()
        try:
            rejected = decoded.where(~F.col("ok")).drop("decoded", "ok", "n_events")
            rejected.write.mode("overwrite").parquet(f"{updates}/_rejected/epoch={epoch}")
            rows = dec.enrich_source(dec.explode_decoded(decoded, [c for c in batch.columns if c != "raw"]))
            n = decoded.agg(F.sum(F.when(F.col("ok"), F.col("n_events")).otherwise(0))).first()[0] or 0
            # The stamped rows are at hand: what is published is not read back from the table.
            stored = ing.append_rows(rows, table, batch=epoch, n_rows=int(n))
            stored.write.mode("overwrite").parquet(f"{updates}/epoch={epoch}")
            if index is not None:
                stored = batch.sparkSession.read.parquet(f"{updates}/epoch={epoch}")
                append_token_index(store.with_partition_column(stored), index, batch=epoch)
        finally:
            decoded.unpersist()

    writer = raw_stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return _start(writer, available_now)


# ---------------------------------------------------------------------------
# live tail

def live_filter(stream: DataFrame, spec: SearchSpec) -> DataFrame:
    """The live rows one viewer receives: level ≥ minimum, app in the list (any
    when empty); nothing for a viewer with a text query or an offset. The time
    range is not applied to live rows."""
    if spec.offset > 0 or search_gate_value(spec.query) is not None:
        return stream.where(F.lit(False))
    out = stream.where(F.col("level").isin(levels_at_least(spec.level)))
    if spec.apps:
        out = out.where(F.col("app").isin(list(spec.apps)))
    return out


def live_tail(stream: DataFrame, spec: SearchSpec, out: str, checkpoint: str,
              available_now: bool = False) -> StreamingQuery:
    """Unbounded filtered feed of new rows for one viewer, appended to ``out``."""
    writer = (live_filter(stream, spec).writeStream.format("parquet").outputMode("append")
              .option("path", out).option("checkpointLocation", checkpoint))
    return _start(writer, available_now)


def history_head(logs: DataFrame, spec: SearchSpec) -> DataFrame:
    """What a viewer gets before the tail: a ``loading`` marker (part 0), then
    the history page reversed (part 1, seq 1 = last row of the page) or one
    ``noData`` marker. Columns: part, seq, kind, id."""
    spark = logs.sparkSession
    page = history_search(logs, spec).select("id", "added")
    # The page is at most ``limit`` rows (the viewer's page); its reversal is a
    # rank over the page only.
    reverse = [F.col("added").asc(), F.col("id").asc()] if spec.order == "desc" else \
        [F.col("added").desc(), F.col("id").desc()]
    from logloom.operators.ranking import range_rank
    hist = range_rank(page, [], reverse, "seq").select(
        F.lit(1).alias("part"), F.col("seq").cast("long").alias("seq"), F.lit("events").alias("kind"), "id")
    loading = spark.range(1).select(F.lit(0).alias("part"), F.lit(1).cast("long").alias("seq"),
                                    F.lit("loading").alias("kind"), F.lit(None).cast("long").alias("id"))
    if not hist.isEmpty():
        return loading.unionByName(hist)
    nodata = spark.range(1).select(F.lit(1).alias("part"), F.lit(1).cast("long").alias("seq"),
                                   F.lit("noData").alias("kind"), F.lit(None).cast("long").alias("id"))
    return loading.unionByName(nodata)


def hand_over(spark: SparkSession, table: str, out: str) -> store.Cut:
    """The point where a subscription's history ends and its tail begins: the
    table's newest version when it is first asked for, kept with the output, so
    a restarted subscription goes on from the same point."""
    made = store.cut(spark, table)
    if create_once(spark, f"{out}/_cut", json.dumps([made.version, made.high_id]).encode()):
        return made
    return store.Cut(*json.loads(read_bytes(spark, f"{out}/_cut")))


def after_cut(stream: DataFrame, cut: store.Cut) -> DataFrame:
    """The rows that came after the cut. The bound reaches the file scan, which
    skips older files by their statistics."""
    return stream.where(F.col("id") > cut.high_id)


def history_then_tail(spark: SparkSession, table: str, stream: DataFrame, spec: SearchSpec, out: str, checkpoint: str,
                      available_now: bool = False) -> StreamingQuery:
    """``loading``, history (or ``noData``), then the rows stored after it. The
    history (``out/head``) is read from one version of the table, the tail
    (``out/tail``) takes the rows of ``stream`` with ids above that version's:
    rows that were stored before and are not on the page never come as live
    ones, rows stored between the two reads come once, and no page is looked up
    for them. ``part`` orders head and tail."""
    cut = hand_over(spark, table, out)
    if not path_exists(spark, f"{out}/head/_SUCCESS"):
        head = history_head(store.scan_logs(spark, table, version=cut.version), spec)
        head.write.mode("overwrite").parquet(f"{out}/head")
    tail = after_cut(live_filter(stream, spec), cut).select(
        F.lit(2).alias("part"), F.lit(None).cast("long").alias("seq"), F.lit("events").alias("kind"), "id")
    writer = (tail.writeStream.format("parquet").outputMode("append")
              .option("path", f"{out}/tail").option("checkpointLocation", checkpoint))
    return _start(writer, available_now)


# ---------------------------------------------------------------------------
# de-duplication and presence

# Folders of keys that are merged into one of the next level.
KEYS_MERGED = 32


def _key_folders(spark: SparkSession, path: str) -> dict[int, list[str]]:
    """The complete folders of an index of keys, by level, oldest first."""
    levels: dict[int, list[str]] = {}
    for name in sorted(list_names(spark, path), key=lambda n: int(n.split("-")[1])):
        if path_exists(spark, f"{path}/{name}/_SUCCESS"):
            levels.setdefault(int(name.split("-")[0]), []).append(name)
    return levels


def _add_keys(keys: DataFrame, path: str, epoch: int) -> None:
    """Add a micro-batch's keys (with their batch) to the index, and merge a
    level that is full into a folder of the next: each key is rewritten a
    number of times that grows with the logarithm of the micro-batches."""
    spark = keys.sparkSession
    first = keys.columns[0]
    keys.coalesce(1).sortWithinPartitions(first).write.mode("overwrite").parquet(f"{path}/0-{epoch}")
    for level in range(64):
        full = _key_folders(spark, path).get(level, [])
        if len(full) < KEYS_MERGED:
            return
        rows = spark.read.parquet(*[f"{path}/{name}" for name in full]).distinct()
        parts = partitions_for(spark, rows, floor=1)
        (rows.repartitionByRange(parts, first).sortWithinPartitions(first)
             .write.mode("overwrite").parquet(f"{path}/{level + 1}-{epoch}"))
        for name in full:
            remove(spark, f"{path}/{name}")


def tail_dedupe(stream: DataFrame, out: str, checkpoint: str, keys: Sequence[str] = ("id",),
                event_time: str = "added", available_now: bool = False) -> StreamingQuery:
    """Every row once by ``keys``, however late or often it arrives, and
    whatever day it is of.

    A micro-batch keeps its rows whose keys no other micro-batch has written.
    The keys that were written are an index beside the rows (``out/_keys``), in
    folders sorted by key that are merged level by level; a micro-batch reads
    the key range it has itself, of that index only, so no state is held and
    nothing is dropped for being late. ``out`` is laid out by day, then
    micro-batch; a replayed micro-batch replaces its own folders, and its own
    keys do not count.
    """
    keys = list(keys)
    index = f"{out}/_keys"

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        day = F.coalesce(F.to_date(event_time), F.lit("1970-01-01").cast("date"))
        rows = batch.dropDuplicates(keys).withColumn(PARTITION_COLUMN, day).persist()
        try:
            first, last = rows.agg(F.min(keys[0]), F.max(keys[0])).first()
            fresh = rows
            folders = [f"{index}/{name}" for names in _key_folders(spark, index).values() for name in names]
            if folders and first is not None:
                sent = spark.read.parquet(*folders).where(
                    (F.col(BATCH_COLUMN) != epoch) & F.col(keys[0]).between(F.lit(first), F.lit(last)))
                fresh = rows.join(sent.select(*keys), keys, "left_anti")
            fresh = fresh.persist()
            store.replace_batch(fresh.select(*batch.columns, PARTITION_COLUMN), out, epoch)
            _add_keys(fresh.select(*keys, F.lit(epoch).cast("long").alias(BATCH_COLUMN)), index, epoch)
            fresh.unpersist()
        finally:
            rows.unpersist()

    return _start(stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint), available_now)


# Bases of the presence state kept, with the changes since; older ones are deleted.
BASES_KEPT = 2
# Changes may hold this many rows more than the base before a new base is written.
CHANGES_SLACK = 1024


def presence_changes_of(events: DataFrame) -> DataFrame:
    """What some events change, per connection: conn_id, app, joined_seq, left_seq."""
    return events.groupBy("conn_id").agg(
        F.min_by("app", "seq").alias("app"),
        F.min(F.when(F.col("action") == JOINED, F.col("seq"))).alias("joined_seq"),
        F.max(F.when(F.col("action") != JOINED, F.col("seq"))).alias("left_seq"))


def presence_merge(parts: DataFrame) -> DataFrame:
    """A base and the changes since as one state. A connection that has joined
    and left is gone from it; a leave read before its join waits for it."""
    merged = parts.groupBy("conn_id").agg(
        F.min_by("app", F.coalesce("joined_seq", "left_seq")).alias("app"),
        F.min("joined_seq").alias("joined_seq"), F.max("left_seq").alias("left_seq"))
    gone = F.col("joined_seq").isNotNull() & F.col("left_seq").isNotNull() & (F.col("left_seq") > F.col("joined_seq"))
    return merged.where(~gone)


PRESENCE = "conn_id long, app string, joined_seq long, left_seq long"


def _epochs(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Micro-batches whose ``kind`` folder is complete."""
    found = [int(n.split("=")[1]) for n in list_names(spark, folder) if n.startswith(f"{kind}=")]
    return sorted(e for e in found if path_exists(spark, f"{folder}/{kind}={e}/_SUCCESS"))


def presence_state(spark: SparkSession, out: str, upto: int | None = None) -> tuple[DataFrame, int | None, list[int]]:
    """The newest base (of micro-batch ``upto`` at the latest) with the changes
    since, unmerged; the base's micro-batch and those of the changes."""
    bases = [e for e in _epochs(spark, f"{out}/state", "base") if upto is None or e <= upto]
    base = bases[-1] if bases else None
    changes = [e for e in _epochs(spark, f"{out}/state", "change")
               if (base is None or e > base) and (upto is None or e <= upto)]
    paths = [f"{out}/state/base={base}"] * (base is not None) + [f"{out}/state/change={e}" for e in changes]
    state = spark.read.schema(PRESENCE).parquet(*paths) if paths else spark.createDataFrame([], PRESENCE)
    return state, base, changes


def presence_current(spark: SparkSession, out: str) -> DataFrame:
    """The connected set after the last complete micro-batch: conn_id, app,
    joined_seq. Folders are complete before they can be read, and none is
    overwritten while it may be in use."""
    merged = presence_merge(presence_state(spark, out)[0])
    return merged.where("joined_seq is not null").select("conn_id", "app", "joined_seq")


def presence_stream(stream: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keeps the connected set for ``presence_current`` to read.

    A micro-batch writes what its events change and nothing else; reading
    merges the changes with the last base. When the changes since outgrow the
    base, the merged state is written as a new one, which holds the open
    connections only (and leaves that wait for their join), so what is written
    follows the events. Events may arrive in any order across micro-batches; a
    replayed micro-batch writes the same change again.
    """
    def each(events: DataFrame, epoch: int) -> None:
        spark, state = events.sparkSession, f"{out}/state"
        presence_changes_of(events).write.mode("overwrite").parquet(f"{state}/change={epoch}")
        parts, base, changes = presence_state(spark, out, epoch)
        held = spark.read.schema(PRESENCE).parquet(f"{state}/base={base}").count() if base is not None else 0
        if parts.count() - held <= held + CHANGES_SLACK:  # row counts of the files' footers
            return
        presence_merge(parts).write.mode("overwrite").parquet(f"{state}/base={epoch}")
        bases = _epochs(spark, state, "base")
        if len(bases) <= BASES_KEPT:
            return
        oldest = bases[-BASES_KEPT]
        for kind in ("base", "change"):
            for old in _epochs(spark, state, kind):
                if old < oldest:
                    remove(spark, f"{state}/{kind}={old}")

    return _start(stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint), available_now)


# ---------------------------------------------------------------------------
# many viewers

def route_stream(stream: DataFrame, specs: DataFrame | Callable[[], DataFrame], out: str, checkpoint: str,
                 available_now: bool = False) -> StreamingQuery:
    """Live fan-out of new events to a whole table of viewers, as (spec_id,
    event columns) rows in one folder of ``out`` per micro-batch.

    ``specs`` may be a function that gives the viewers as they are now; it is
    called for every micro-batch, so viewers may come and go while it runs.
    A table of sessions (with connected and disconnected event numbers) gives
    each viewer what came while it was connected, whenever the micro-batch runs.
    The join is planned for each micro-batch from the viewers' current number.
    """
    from logloom.operators.routing import route_events, route_sessions

    def each(batch: DataFrame, epoch: int) -> None:
        viewers = specs() if callable(specs) else specs
        route = route_sessions if "connected" in viewers.columns else route_events
        route(batch, viewers).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return _start(stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint), available_now)


def tail_many(spark: SparkSession, table: str, stream: DataFrame, specs: DataFrame, out: str, checkpoint: str,
              available_now: bool = False) -> StreamingQuery:
    """History then tail for a whole table of viewers, with one cut for all:
    each viewer's history page, of the version at the cut, is written once to
    ``out/history``; the live fan-out of the rows above its mark streams into
    ``out/tail``."""
    from logloom.operators.routing import route_events
    from logloom.operators.search import history_many

    cut = hand_over(spark, table, out)
    if not path_exists(spark, f"{out}/history/_SUCCESS"):
        history = history_many(store.scan_logs(spark, table, version=cut.version), specs)
        history.write.mode("overwrite").parquet(f"{out}/history")
    tail = route_events(after_cut(stream, cut), specs)
    writer = (tail.writeStream.format("parquet").outputMode("append")
              .option("path", f"{out}/tail").option("checkpointLocation", checkpoint))
    return _start(writer, available_now)
