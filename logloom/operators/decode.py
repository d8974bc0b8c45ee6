"""Decoding JSON batches of log events (the wire format of sources).

A batch is ``{"events": [...]}``. Each event is tried, in order, as:

1. *typed*: ``timestamp`` is an ISO-instant string, the level is known and the
   text fields are strings (``isoTimestamp`` is then ignored);
2. *current*: optional ``isoTimestamp`` (must parse; no fallback),
   optional ``timestamp`` in epoch ms (a whole number or a string of digits;
   not a boolean, not a fraction), known level; no usable time → ``No
   timestamp.``;
3. *legacy*: ``timeStamp`` (capital S) in ms, ``timeFormatted``, level text
   (unknown → info). It is tried only when the current shape does not decode,
   so a legacy event with a *known* level is rejected (``legacy='strict'``,
   the reference's behaviour); ``legacy='lenient'`` takes its ``timeStamp``.

A batch is all-or-nothing: one undecodable event rejects the whole message, and
so does a blank ``app`` column where the batches carry one. Of a key that an
object repeats, the last value counts (a session setting, see session.py).
Everything is a per-row projection over Spark's variant type: no shuffle, no
Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.levels import LEVEL_BY_NAME, level_int
from logloom.functions.text import clean_agent, clean_name, is_blank
from logloom.functions.timefmt import iso_instant_parse, millis_to_ts, truncate_millis
from logloom.functions.variants import kind, long_of, text

# Rejection reasons.
MALFORMED, MISSING_EVENTS = "Malformed JSON.", "Missing events."
INVALID_EVENT, INVALID_TIMESTAMP, NO_TIMESTAMP = "Invalid event.", "Invalid timestamp.", "No timestamp."
BLANK_APP, UNKNOWN_APP = "App name must not be blank.", "Unknown app."

EVENT_FIELDS = ["pos", "timestamp", "message", "logger", "thread", "level", "stacktrace"]


def _extract(e: Column) -> Column:
    """Stage 1: each field looked up once (its variant type, and its value)."""
    return F.struct(
        kind(e, "$.message").alias("t_message"), kind(e, "$.loggerName").alias("t_logger"),
        kind(e, "$.threadName").alias("t_thread"), kind(e, "$.stackTrace").alias("t_stack"),
        kind(e, "$.level").alias("t_level"), kind(e, "$.timestamp").alias("t_ts"),
        kind(e, "$.isoTimestamp").alias("t_iso"), kind(e, "$.timeFormatted").alias("t_formatted"),
        text(e, "$.message").alias("message"), text(e, "$.loggerName").alias("logger"),
        text(e, "$.threadName").alias("thread"), text(e, "$.stackTrace").alias("stacktrace"),
        text(e, "$.level").alias("level_text"), text(e, "$.timestamp").alias("ts_text"),
        text(e, "$.isoTimestamp").alias("iso_text"),
        long_of(e, "$.timestamp").alias("ms"),
        long_of(e, "$.timeStamp").alias("legacy_ms"),
    )


def _classify(x: Column, legacy: str) -> Column:
    """Stage 2: which decoder applies (typed, current, legacy) and its values."""
    def is_(field: str, *types: str) -> Column:
        """Null-safe: false when the field is absent."""
        return F.coalesce(x[field].isin(*types), F.lit(False))

    def optional_string(field: str) -> Column:
        return x[field].isNull() | is_(field, "STRING", "VOID")

    strings_ok = is_("t_message", "STRING") & is_("t_logger", "STRING") & is_("t_thread", "STRING") & \
        optional_string("t_stack")
    level = level_int(F.when(is_("t_level", "STRING"), x["level_text"]))
    typed_ts = iso_instant_parse(F.when(is_("t_ts", "STRING"), x["ts_text"]))
    ts_field_ok = x["t_ts"].isNull() | is_("t_ts", "VOID") | x["ms"].isNotNull()
    plain_ms = x["ms"] if legacy == "strict" else F.coalesce(x["ms"], x["legacy_ms"])
    return F.struct(
        (strings_ok & level.isNotNull() & typed_ts.isNotNull()).alias("typed_ok"),
        (strings_ok & level.isNotNull() & optional_string("t_iso") & optional_string("t_formatted")
         & ts_field_ok).alias("current_ok"),
        (strings_ok & x["legacy_ms"].isNotNull() & is_("t_formatted", "STRING") & is_("t_level", "STRING"))
        .alias("legacy_ok"),
        is_("t_iso", "STRING").alias("iso_present"),
        iso_instant_parse(x["iso_text"]).alias("iso_ts"),
        typed_ts.alias("typed_ts"), plain_ms.alias("plain_ms"), x["legacy_ms"].alias("legacy_ms"),
        level.alias("level"), x["message"].alias("message"), x["logger"].alias("logger"),
        x["thread"].alias("thread"), x["stacktrace"].alias("stacktrace"),
    )


def _finish(y: Column, i: Column) -> Column:
    """Stage 3: the first decoder that applies wins; its time and level."""
    use_typed = y["typed_ok"]
    use_current = ~use_typed & y["current_ok"]
    use_legacy = ~use_typed & ~y["current_ok"] & y["legacy_ok"]
    current_err = (F.when(y["iso_present"] & y["iso_ts"].isNull(), F.lit(INVALID_TIMESTAMP))
                    .when(~y["iso_present"] & y["plain_ms"].isNull(), F.lit(NO_TIMESTAMP)))
    current_ts = F.when(y["iso_present"], y["iso_ts"]).otherwise(millis_to_ts(y["plain_ms"]))
    ok = use_typed | (use_current & current_err.isNull()) | use_legacy
    ts = (F.when(use_typed, y["typed_ts"]).when(use_current, current_ts)
           .when(use_legacy, millis_to_ts(y["legacy_ms"])))
    lvl = F.when(use_legacy, F.coalesce(y["level"], F.lit(LEVEL_BY_NAME["info"]))).otherwise(y["level"])
    reason = F.when(ok, F.lit(None)).when(use_current, current_err).otherwise(F.lit(INVALID_EVENT))
    return F.struct(
        ok.alias("ok"), reason.cast("string").alias("reason"), i.cast("long").alias("pos"),
        truncate_millis(ts).alias("timestamp"), y["message"].alias("message"), y["logger"].alias("logger"),
        y["thread"].alias("thread"), lvl.cast("int").alias("level"), y["stacktrace"].alias("stacktrace"),
    )


def decode_batches(raw: DataFrame, col: str = "raw", legacy: str = "strict") -> DataFrame:
    """Adds ``ok``, ``reason``, ``decoded`` (array of event structs) and
    ``n_events`` to each raw batch row.

    Higher-order functions run interpreted, so the work is split into three
    small stages whose results are kept as columns (each stage is computed
    once, not re-inlined into the next).
    """
    if legacy not in ("strict", "lenient"):
        raise ValueError("legacy must be 'strict' or 'lenient'")
    df = raw.withColumn("__v", F.try_parse_json(F.col(col)))
    df = df.withColumn("__events", F.try_variant_get(F.col("__v"), "$.events", "array<variant>"))
    df = df.withColumn("__f", F.transform("__events", _extract))
    df = df.withColumn("__g", F.transform("__f", lambda x: _classify(x, legacy)))
    df = df.withColumn("decoded", F.transform("__g", _finish))
    first_bad = F.try_element_at(F.filter("decoded", lambda x: ~x["ok"]), F.lit(1))["reason"]
    reason = (F.when(F.col("__v").isNull(), F.lit(MALFORMED))
               .when(F.col("__events").isNull(), F.lit(MISSING_EVENTS))
               .otherwise(first_bad))
    if "app" in raw.columns:
        reason = F.coalesce(reason, F.when(F.coalesce(is_blank("app"), F.lit(True)), F.lit(BLANK_APP)))
    return (df.withColumn("reason", reason)
              .withColumn("ok", F.col("reason").isNull())
              .withColumn("n_events", F.size(F.coalesce("decoded", F.array())))
              .drop("__v", "__events", "__f", "__g"))


def rows_where(df: DataFrame, cond: Column) -> DataFrame:
    """Keep the rows where ``cond`` holds, through a generator instead of a
    Filter. A Filter on a decoded column is pushed below the decoding
    projection with the whole decode inlined into it, so every batch would be
    decoded twice; a generator is not moved."""
    packed = F.when(cond, F.array(F.struct(*[F.col(c) for c in df.columns])))
    return df.select(F.inline(packed))


def decode_events(raw: DataFrame, col: str = "raw", legacy: str = "strict") -> DataFrame:
    """One row per event of every accepted batch: the batch's other columns,
    then pos, timestamp, message, logger, thread, level, stacktrace."""
    return explode_decoded(decode_batches(raw, col, legacy), [c for c in raw.columns if c != col])


def explode_decoded(decoded: DataFrame, keep: list[str]) -> DataFrame:
    """Batches from ``decode_batches`` → one row per event of the accepted ones
    (a rejected batch explodes to nothing)."""
    exploded = decoded.select(*keep, F.explode(F.when(F.col("ok"), F.col("decoded"))).alias("e"))
    return exploded.select(*keep, *[F.col("e")[f].alias(f) for f in EVENT_FIELDS])


def reject_batches(raw: DataFrame, col: str = "raw", legacy: str = "strict") -> DataFrame:
    """Rejected batches with their text and the first reason (dead letters)."""
    d = decode_batches(raw, col, legacy).drop("decoded")
    return rows_where(d, ~F.col("ok")).drop("ok", "n_events")


def published_counts(raw: DataFrame, col: str = "raw", key: str = "batch_id", legacy: str = "strict") -> DataFrame:
    """Events accepted per accepted batch (what the caller is told)."""
    d = decode_batches(raw, col, legacy).select(key, "ok", "n_events")
    return rows_where(d, F.col("ok")).select(key, F.col("n_events").cast("long").alias("event_count"))


def enrich_source(events: DataFrame, connections: DataFrame | None = None, key: str = "batch_id") -> DataFrame:
    """Stamp each event with its connection's app, address, client id and agent.

    Without ``connections`` the columns are already carried by the events (the
    batch's own columns); otherwise they are joined on ``key``. App and client
    id are trimmed (blank → null); the agent is trimmed and cut to 100 chars.
    """
    if connections is not None:
        events = events.join(connections.select(key, "app", "address", "client", "user_agent"), key)
    return events.select(
        key, "pos", clean_name("app").alias("app"), F.col("address"), "timestamp", "message", "logger",
        "thread", "level", clean_name("client").alias("client"), clean_agent("user_agent").alias("user_agent"),
        "stacktrace",
    )
