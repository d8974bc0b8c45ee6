"""Row shapes for consumers: nested events, compact/verbose views, wire JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.labels import LANGUAGES
from logloom.functions.levels import LEVEL_INTS, level_int, level_name
from logloom.functions.text import is_blank
from logloom.functions.timefmt import display_time, iso_instant_format, ts_to_millis
from logloom.functions.variants import is_string, kind as field_kind, long_of, optional_string, text
from logloom.operators.filters import ORDERS

TO_JSON_OPTS = {"ignoreNullFields": "false"}


def event_struct() -> Column:
    """The nested output event of one stored row."""
    return F.struct(
        F.col("id"),
        F.struct(F.col("app").alias("name"), F.col("address").alias("remoteAddress"),
                 F.col("client").alias("clientId"), F.col("user_agent").alias("userAgent")).alias("source"),
        F.struct(
            iso_instant_format("timestamp").alias("isoTimestamp"),
            ts_to_millis("timestamp").alias("timestamp"),
            display_time("timestamp").alias("timeFormatted"),
            F.col("message"), F.col("logger").alias("loggerName"), F.col("thread").alias("threadName"),
            level_name("level").alias("level"), F.col("stacktrace").alias("stackTrace"),
        ).alias("event"),
        ts_to_millis("added").alias("added"),
        display_time("added").alias("addedFormatted"),
    )


def to_event(df: DataFrame) -> DataFrame:
    """Stored rows → one ``event`` struct column (id, source, event, added ms, added text)."""
    return df.select(event_struct().alias("event"))


def flat_event(df: DataFrame) -> DataFrame:
    """``to_event`` with every leaf as its own column."""
    e = to_event(df)
    return e.select(
        F.col("event.id").alias("id"),
        F.col("event.source.name").alias("source_name"),
        F.col("event.source.remoteAddress").alias("source_address"),
        F.col("event.source.clientId").alias("source_client_id"),
        F.col("event.source.userAgent").alias("source_user_agent"),
        F.col("event.event.isoTimestamp").alias("iso_timestamp"),
        F.col("event.event.timestamp").alias("timestamp_ms"),
        F.col("event.event.timeFormatted").alias("time_formatted"),
        F.col("event.event.message").alias("message"),
        F.col("event.event.loggerName").alias("logger_name"),
        F.col("event.event.threadName").alias("thread_name"),
        F.col("event.event.level").alias("level"),
        F.col("event.event.stackTrace").alias("stack_trace"),
        F.col("event.added").alias("added_ms"),
        F.col("event.addedFormatted").alias("added_formatted"),
    )


def to_wire(df: DataFrame) -> DataFrame:
    """Each stored row as the JSON text of one output event (nulls printed)."""
    return df.select("id", F.to_json(event_struct(), TO_JSON_OPTS).alias("json"))


def wire_meta(event: str, apps: Column | str, level: Column | str, from_: Column | str, to: Column | str,
              limit: Column | str, offset: Column | str, q: Column | str) -> Column:
    """A ``loading`` / ``noData`` frame echoing the search: apps, level name,
    time range as Helsinki minutes, limits and query (nulls printed)."""
    from logloom.functions.timefmt import helsinki_minute

    def c(x):
        return F.col(x) if isinstance(x, str) else x

    meta = F.struct(
        F.coalesce(c(apps), F.array().cast("array<string>")).alias("apps"),
        level_name(c(level)).alias("level"),
        F.struct(helsinki_minute(c(from_)).alias("from"), helsinki_minute(c(to)).alias("to")).alias("timeRange"),
        F.struct(c(limit).alias("limit"), c(offset).alias("offset")).alias("limits"),
        c(q).alias("query"),
    )
    return F.to_json(F.struct(F.lit(event).alias("event"), meta.alias("meta")), TO_JSON_OPTS)


def source_struct() -> Column:
    """One connected source as the admin feed shows it."""
    return F.struct(
        F.col("app").alias("name"), F.col("address").alias("remoteAddress"),
        F.col("user_agent").alias("userAgent"), F.col("conn_id").cast("string").alias("id"),
        ts_to_millis("joined").alias("joined"), iso_instant_format("joined").alias("joinedFormatted"),
        display_time("joined").alias("timeJoined"),
    )


def wire_batch(events_json: Column) -> Column:
    """An array of event JSON texts → the tagged batch ``{"events":[...],"event":"events"}``."""
    return F.concat(F.lit('{"events":['), F.array_join(events_json, ","), F.lit('],"event":"events"}'))


def wire_batches(rows: DataFrame, key: str = "batch_id", order: str = "pos") -> DataFrame:
    """One tagged ``events`` frame per ingest message, events in message order.
    A group is one message, so its size is bounded by the message size."""
    per_event = rows.select(key, order, F.to_json(event_struct(), TO_JSON_OPTS).alias("json"))
    grouped = per_event.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "json"))).alias("items"))
    return grouped.select(key, wire_batch(F.transform("items", lambda x: x["json"])).alias("json"))


def severity_class(c: Column | str = "level") -> Column:
    """error → danger, warn → warning, everything else → info."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == 50, "danger").when(c == 40, "warning").otherwise("info")


def view_columns(df: DataFrame, verbose: bool = False) -> DataFrame:
    """Compact view (app, time, message, level); verbose adds logger, thread,
    client, agent. A missing display time shows as ``-``."""
    cols = [F.col("id"), F.col("app"), F.coalesce(display_time("timestamp"), F.lit("-")).alias("time"),
            F.col("message")]
    if verbose:
        cols += [F.col("logger"), F.col("thread"), F.col("client"), F.col("user_agent")]
    cols += [level_name("level").alias("level"), severity_class("level").alias("row_class")]
    return df.select(*cols)


def detail_rows(df: DataFrame) -> DataFrame:
    """One ``main`` row per event plus a ``detail`` row for a stack trace."""
    items = F.array(
        F.struct(F.lit("main").alias("kind"), F.col("message").alias("text")),
        F.struct(F.lit("detail").alias("kind"), F.col("stacktrace").alias("text")),
    )
    kept = F.filter(items, lambda x: (x["kind"] == "main") | x["text"].isNotNull())
    return df.select("id", F.inline(kept))


def mobile_rows(df: DataFrame) -> DataFrame:
    """The mobile list: one entry per event with the stack trace inline
    (app, time or ``-``, message, stack trace, level, logger, thread)."""
    return df.select(
        "id", "app", F.coalesce(display_time("timestamp"), F.lit("-")).alias("time"), "message",
        F.col("stacktrace").alias("stack"), level_name("level").alias("level"), "logger", "thread",
    )


def source_view(presence: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Presence table columns: app, address, agent (or ``Unknown``), id, joined time."""
    return presence.select(
        F.col("app"), F.col("address"), F.coalesce("user_agent", F.lit(unknown)).alias("agent"),
        F.col("conn_id").alias("id"), display_time("joined").alias("joined"),
    )


def validate_domains(df: DataFrame) -> DataFrame:
    """Per-row domain errors (blank app/client/agent, negative id, unknown level,
    negative limit/offset, unknown order or language) joined into ``errors``."""
    def blank(c: str) -> Column:
        return F.coalesce(is_blank(c), F.lit(False))

    # The error sentences.
    checks = []
    present = set(df.columns)
    if "app" in present:
        checks.append(F.when(F.col("app").isNull() | blank("app"), F.lit("App name must not be blank.")))
    if "client" in present:
        checks.append(F.when(blank("client"), F.lit("Client ID must not be blank.")))
    if "user_agent" in present:
        checks.append(F.when(blank("user_agent"), F.lit("User agent must not be blank.")))
    if "id" in present:
        checks.append(F.when(F.col("id") < 0, F.lit("Log entry ID must be non-negative.")))
    if "level" in present:
        checks.append(F.when(~F.col("level").isin(LEVEL_INTS),
                             F.concat(F.lit("Invalid level: '"), F.col("level").cast("string"), F.lit("'."))))
    for c in ("lim", "off"):
        if c in present:
            checks.append(F.when(F.col(c) < 0, F.lit(f"{c} must be non-negative.")))
    if "ord" in present:
        checks.append(F.when(~F.col("ord").isin(*ORDERS), F.concat(F.lit("Invalid order: '"), F.col("ord"), F.lit("'."))))
    if "language" in present:
        checks.append(F.when(~F.col("language").isin(*LANGUAGES),
                             F.concat(F.lit("Invalid language: '"), F.col("language"), F.lit("'."))))
    errors = F.array_compact(F.array(*checks))
    return df.withColumn("errors", F.when(F.size(errors) > 0, F.array_join(errors, " ")))


def _named(v: Column, path: str, required: bool = True) -> Column:
    """A string that is not blank; where not required, also absent or null."""
    ok = is_string(v, path) & ~is_blank(text(v, path))
    return ok if required else F.when(is_string(v, path), ok).otherwise(optional_string(v, path))


def _long(v: Column, path: str, least: int | None = None) -> Column:
    n = long_of(v, path)
    return n.isNotNull() if least is None else F.coalesce(n >= least, F.lit(False))


def _known_level(v: Column, path: str) -> Column:
    return F.coalesce(level_int(F.when(is_string(v, path), text(v, path))).isNotNull(), F.lit(False))


def _valid_event(v: Column) -> Column:
    """One element of an ``events`` frame: id, source, event (current or legacy
    shape) and added time, every required field with its type."""
    e = "$.event."
    texts = (is_string(v, e + "message") & is_string(v, e + "loggerName") & is_string(v, e + "threadName")
             & optional_string(v, e + "stackTrace"))
    no_time = field_kind(v, e + "timestamp").isNull() | (field_kind(v, e + "timestamp") == "VOID")
    current = (optional_string(v, e + "isoTimestamp") & (no_time | _long(v, e + "timestamp"))
               & optional_string(v, e + "timeFormatted") & _known_level(v, e + "level"))
    legacy = _long(v, e + "timeStamp") & is_string(v, e + "timeFormatted") & is_string(v, e + "level")
    return (_long(v, "$.id", 0) & _named(v, "$.source.name") & is_string(v, "$.source.remoteAddress")
            & _named(v, "$.source.clientId", False) & _named(v, "$.source.userAgent", False)
            & texts & (current | legacy) & _long(v, "$.added") & is_string(v, "$.addedFormatted"))


def _valid_source(v: Column) -> Column:
    """One element of a ``sources`` frame."""
    return (_named(v, "$.name") & is_string(v, "$.remoteAddress") & _named(v, "$.userAgent", False)
            & is_string(v, "$.id") & _long(v, "$.joined") & is_string(v, "$.joinedFormatted")
            & is_string(v, "$.timeJoined"))


def _valid_meta(v: Column) -> Column:
    """The query that a ``loading`` or ``noData`` frame echoes."""
    apps = F.try_variant_get(v, "$.meta.apps", "array<variant>")
    time_range = F.coalesce(field_kind(v, "$.meta.timeRange").startswith("OBJECT"), F.lit(False))
    return (F.coalesce(F.forall(apps, lambda a: is_string(a, "$")), F.lit(False)) & _known_level(v, "$.meta.level")
            & time_range & optional_string(v, "$.meta.timeRange.from") & optional_string(v, "$.meta.timeRange.to")
            & _long(v, "$.meta.limits.limit", 0) & _long(v, "$.meta.limits.offset", 0)
            & optional_string(v, "$.meta.query"))


def decode_frames(frames: DataFrame, col: str = "json", admin: bool = False) -> DataFrame:
    """Consumer side: drop pings and undecodable frames, classify the rest.

    Viewer frames: ``events`` (a batch), ``meta`` (loading / noData with its
    query), ``simple`` (any other ``event`` string). Admin frames: ``sources``
    or ``simple``. First match wins; a frame matches only if every element
    holds all required fields with their types. Output adds ``kind`` and
    ``n_items``.
    """
    v = F.col("__v")
    frames = frames.withColumn("__v", F.try_parse_json(F.col(col)))
    event = F.when(is_string(v, "$.event"), text(v, "$.event"))

    def all_of(path: str, valid) -> Column:
        return F.coalesce(F.forall(F.try_variant_get(v, path, "array<variant>"), valid), F.lit(False))

    if admin:
        many = all_of("$.sources", _valid_source)
        kind = F.when(many, "sources").when(event.isNotNull(), "simple")
        items = F.try_variant_get(v, "$.sources", "array<variant>")
    else:
        many = F.coalesce(event == "events", F.lit(False)) & all_of("$.events", _valid_event)
        kind = (F.when(many, "events").when(event.isNotNull() & _valid_meta(v), "meta")
                 .when(event.isNotNull(), "simple"))
        items = F.try_variant_get(v, "$.events", "array<variant>")
    out = (frames.withColumn("frame_event", event).withColumn("kind", kind)
                 .withColumn("n_items", F.when(F.col("kind").isin("events", "sources"), F.size(items))).drop("__v"))
    return out.where(F.col("kind").isNotNull() & ~F.coalesce(F.col("frame_event") == "ping", F.lit(False)))
