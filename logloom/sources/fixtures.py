"""Stand-in inputs derived from the driver's tables.

These views only give rows in the schemas the operators expect (a log table,
a registry, viewer specs, raw JSON batches); they do none of the operators'
work. Each view is one SQL template rendered for Spark and for DuckDB, so the
oracle queries see exactly the same input rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.timefmt import iso_instant_format, display_time, ts_to_millis

SPARK_MACROS = {
    "S": "string",
    "N": "timestamp_ntz",
    "L": "timestamp_ntz",
    "K": "get_json_object(props, '$.k')",
}
DUCK_MACROS = {
    "S": "varchar",
    "N": "timestamp",
    "L": "timestamp",
    "K": "json_extract_string(props, '$.k')",
}

TEMPLATES = {
    "logs": """
select event_id as id, concat('app', cast(user_id % 7 as {S})) as app,
  concat('10.0.0.', cast(user_id % 256 as {S})) as address,
  cast(date_trunc('millisecond', ts) as {N}) as timestamp,
  concat(event_type, ' k', {K}) as message, concat('com.example.', event_type) as logger,
  concat('pool-', cast(user_id % 4 as {S})) as thread,
  case when event_id % 97 = 0 then 60 when event_type='error' then 50 when event_type='purchase' then 40
       when event_type='signup' then 30 when event_type='click' then 20 else 10 end as level,
  case when user_id % 3 = 0 then concat('cl', cast(user_id as {S})) end as client,
  case when user_id % 4 = 0 then null else concat('agent/', cast(user_id % 5 as {S})) end as user_agent,
  case when event_type='error' then concat('java.lang.RuntimeException: k', {K}) end as stacktrace,
  cast(date_trunc('hour', ts) as {N}) as added
from {events}""",
    "doc_logs": """
select doc_id as id, source as app, '127.0.0.1' as address, {L} '2024-01-01 00:00:00' as timestamp,
  text as message, concat('doc.', lang) as logger, 'main' as thread,
  cast(10 * (doc_id % 6) + 10 as int) as level, cast(null as {S}) as client,
  cast(null as {S}) as user_agent, cast(null as {S}) as stacktrace,
  cast(concat('2024-01-', lpad(cast(doc_id % 20 + 1 as {S}), 2, '0'), ' 00:00:00') as {N}) as added
from {documents}""",
    "apps": """
select app, md5(concat(app, ':', 'pw', app)) as pass_hash
from (select distinct app from {logs} where app <> 'app5') t""",
    "admins": """
select concat('c', cast(c_custkey as {S}), '@example.com') as email,
  case c_custkey % 3 when 0 then 'en-US' when 1 then 'sv-SE' else 'fi-FI' end as language,
  {L} '2024-01-01 00:00:00' as created_at
from {customer} where c_custkey % 2 = 1""",
    "presence": """
select event_id as seq, case when rn % 2 = 1 then event_id else prev end as conn_id,
  concat('app', cast(user_id % 7 as {S})) as app,
  case when rn % 2 = 1 then 'joined' else 'left' end as action
from (select event_id, user_id,
        row_number() over (partition by user_id order by event_id) as rn,
        lag(event_id) over (partition by user_id order by event_id) as prev from {events}) t""",
    "specs": """
select * from (values
  (1, 'app1,app3', 30, {L} '2024-01-05 00:00:00', cast(null as {N}), 20, 5, 'desc'),
  (2, '', 50, {L} '2024-01-01 00:00:00', {L} '2024-01-10 00:00:00', 500, 0, 'asc'),
  (3, 'app99', 10, {L} '2024-01-01 00:00:00', cast(null as {N}), 10, 0, 'desc')
) as t(spec_id, apps, min_level, from_ts, to_ts, lim, off, ord)""",
}

# Which base tables (or other views) each view reads.
DEPENDS = {
    "logs": ["events"],
    "doc_logs": ["documents"],
    "apps": ["logs"],
    "admins": ["customer"],
    "presence": ["events"],
    "specs": [],
}


def render(name: str, engine: str) -> str:
    """The view's SQL for ``spark`` (DataFrame placeholders) or ``duckdb``."""
    macros = dict(SPARK_MACROS if engine == "spark" else DUCK_MACROS)
    for dep in DEPENDS[name]:
        macros[dep] = "{" + dep + "}" if engine == "spark" else dep
    return TEMPLATES[name].format(**macros).strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a Spark DataFrame over the tables in ``sf_dir``."""
    args = {}
    for dep in DEPENDS[name]:
        args[dep] = view(spark, sf_dir, dep) if dep in TEMPLATES else table(spark, sf_dir, dep)
    df = spark.sql(render(name, "spark"), **args)
    if name == "specs":
        df = specs_table(df)
    return df


def specs_table(df: DataFrame) -> DataFrame:
    """Fixture specs → the library's spec schema (apps as an array, no text query)."""
    apps = F.filter(F.split(F.col("apps"), ","), lambda a: a != "")
    return df.select(
        F.col("spec_id").cast("long").alias("spec_id"),
        apps.alias("apps"),
        F.col("min_level").cast("int").alias("min_level"),
        F.col("from_ts").cast("timestamp_ntz").alias("from_ts"),
        F.col("to_ts").cast("timestamp_ntz").alias("to_ts"),
        F.col("lim").cast("int").alias("lim"),
        F.col("off").cast("int").alias("off"),
        F.col("ord"),
        F.lit(None).cast("string").alias("q"),
    )


def duck_cte(*names: str) -> str:
    """``with`` clause defining the given views (and what they read) for DuckDB."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for dep in DEPENDS.get(n, []):
            if dep in TEMPLATES:
                visit(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    return "with " + ",\n".join(f"{n} as ({render(n, 'duckdb')})" for n in ordered)


# ---------------------------------------------------------------------------
# Raw JSON batches (FIXTURES §4): wire input for the decoder.

# Mixed-case level names per position; ``id % 50 = 7`` sends an unknown one.
_LEVEL_CASES = ["lower", "upper", "title"]

# Hand-written wire messages (batch ids below zero), each with its connection.
HAND_WRITTEN = [
    (-1, '{"events": [', "malformed text"),
    (-2, '{"items": []}', "events missing"),
    (-3, '{"events": []}', "empty events"),
    (-4, '{"events": [{"message": "m4", "loggerName": "l", "threadName": "t", "level": "info"}]}',
     "event without timestamp"),
    (-5, '{"events": [{"isoTimestamp": "not-a-time", "timestamp": 1704067200000, "message": "m5", '
         '"loggerName": "l", "threadName": "t", "level": "info"}]}', "bad isoTimestamp next to a good timestamp"),
    (-6, '{"events": [{"timestamp": "2024-01-02T03:04:05.678Z", "message": "typed", '
         '"loggerName": "l", "threadName": "t", "level": "WARN"}]}', "typed timestamp string"),
    (-7, '{"events": [{"timeStamp": 1704067200000, "timeFormatted": "x", "message": "legacy", '
         '"loggerName": "l", "threadName": "t", "level": "error"}]}', "legacy event, valid level"),
    (-8, '{"events": [{"timeStamp": 1704067200000, "timeFormatted": "x", "message": "legacy2", '
         '"loggerName": "l", "threadName": "t", "level": "fatal"}]}', "legacy event, unknown level"),
    (-9, '{"events": [{"timestamp": true, "message": "m9", "loggerName": "l", "threadName": "t", "level": "info"}]}',
     "boolean timestamp"),
    (-10, '{"events": [{"timestamp": 1.5, "message": "m10", "loggerName": "l", "threadName": "t", "level": "info"}]}',
     "timestamp with a fraction"),
    (-11, '{"events": [{"timeStamp": true, "timeFormatted": "x", "message": "m11", "loggerName": "l", '
          '"threadName": "t", "level": "fatal"}]}', "legacy event, boolean time"),
    (-12, '{"events": [{"timestamp": 1704067200000, "message": "m12", "loggerName": "l", "threadName": "t", '
          '"level": "info"}]}', "blank app"),
    (-13, '{"events": [{"timestamp": 1704067200000.0, "message": "m13", "loggerName": "l", "threadName": "t", '
          '"level": "info"}]}', "whole decimal timestamp, app between tabs"),
]
# Apps of messages that do not come from ``HAND_APP``.
HAND_APPS = {-12: "\t\n ", -13: "\tapp1\n"}
HAND_APP, HAND_ADDRESS, HAND_AGENT = "app1", "10.0.0.1", "  agent/hand  "


def raw_batches(spark: SparkSession, sf_dir: str, hand_written: bool = True) -> DataFrame:
    """One JSON envelope per ``floor(id / 10)`` of ``logs`` plus the hand-written ones.

    Columns: batch_id, raw, app, address, client, user_agent (the connection).
    """
    logs = view(spark, sf_dir, "logs")
    name = F.element_at(F.array(F.lit("trace"), F.lit("debug"), F.lit("info"),
                                F.lit("warn"), F.lit("error"), F.lit("other")),
                        (F.col("level") / 10).cast("int"))
    case = F.pmod(F.col("id"), F.lit(len(_LEVEL_CASES)))
    level_text = (
        F.when(F.pmod(F.col("id"), F.lit(50)) == 7, F.lit("bogus"))
        .when(case == 1, F.upper(name))
        .when(case == 2, F.initcap(name))
        .otherwise(name)
    )
    iso = F.pmod(F.col("id"), F.lit(3)) == 0
    event = F.struct(
        F.when(iso, iso_instant_format("timestamp")).alias("isoTimestamp"),
        F.when(~iso, ts_to_millis("timestamp")).alias("timestamp"),
        display_time("timestamp").alias("timeFormatted"),
        F.col("message"),
        F.col("logger").alias("loggerName"),
        F.col("thread").alias("threadName"),
        level_text.alias("level"),
        F.col("stacktrace").alias("stackTrace"),
    )
    per_event = logs.select(
        F.floor(F.col("id") / 10).alias("batch_id"),
        F.col("id"),
        F.to_json(event).alias("json"),
        F.struct("app", "address", "client", "user_agent").alias("conn"),
    )
    batches = per_event.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("id", "json"))).alias("items"),
        F.min_by("conn", "id").alias("conn"),
    )
    gen = batches.select(
        F.col("batch_id").cast("long").alias("batch_id"),
        F.concat(F.lit('{"events":['), F.array_join(F.transform("items", lambda x: x["json"]), ","),
                 F.lit("]}")).alias("raw"),
        F.col("conn.app").alias("app"),
        F.col("conn.address").alias("address"),
        F.col("conn.client").alias("client"),
        F.col("conn.user_agent").alias("user_agent"),
    )
    if not hand_written:
        return gen
    hand = spark.createDataFrame(
        [(b, raw, HAND_APPS.get(b, HAND_APP), HAND_ADDRESS, None, HAND_AGENT) for b, raw, _ in HAND_WRITTEN],
        "batch_id long, raw string, app string, address string, client string, user_agent string",
    )
    return gen.unionByName(hand)


def view_over(spark: SparkSession, name: str, **inputs: DataFrame) -> DataFrame:
    """A fixture view over given DataFrames (e.g. a stream of ``events``)."""
    return spark.sql(render(name, "spark"), **inputs)
