"""Registered queries: predicates, sort, paging, composed searches."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import filters as flt
from logloom.operators import postings as post
from logloom.operators import search as srch
from logloom.operators.cells import history_by_cells
from logloom.operators.filters import SearchSpec
from logloom.operators.ranking import range_rank
from logloom.plans.oracle import (
    LEVELS_SQL, LOG_COLS_SQL, cte, levels_from_sql, search_text_sql, tokens_sql,
)
from logloom.plans.registry import query
from logloom.schema import LOG_COLUMNS
from logloom.session import fresh_path, path_exists
from logloom.sources import fixtures, store

# Query parameters (like a benchmark query's substitution values).
FLAGSHIP = SearchSpec(apps=("app1", "app3"), level=30, from_=dt.datetime(2024, 1, 5),
                      limit=20, offset=5, order="desc")
TIME_FROM, TIME_TO = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12, 12)
DOC_QUERY = "orantion thatin"
DOC_PREFIX = "inor"
ALL_SPEC = SearchSpec(apps=("app1", "app3", "app4"), level="warn", from_=dt.datetime(2024, 1, 3),
                      to=dt.datetime(2024, 1, 25), limit=100, offset=10, order="asc",
                      query="purchase error")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.logs_table(spark, sf_dir, "logs")


def doc_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.logs_table(spark, sf_dir, "doc_logs")


def _ts(t: dt.datetime) -> str:
    return f"timestamp '{t:%Y-%m-%d %H:%M:%S}'"


@query("scan_logs", f"""{cte('logs')}
select {LOG_COLS_SQL} from logs where level in {LEVELS_SQL} and id >= 0""")
def q_scan_logs(spark, sf_dir):
    return logs(spark, sf_dir).select(*LOG_COLUMNS)


@query("filter_level", f"""{cte('logs')}
select id, app, level from logs where level in {levels_from_sql(40)}""")
def q_filter_level(spark, sf_dir):
    return flt.filter_level(logs(spark, sf_dir), "warn").select("id", "app", "level")


@query("filter_apps", f"""{cte('logs')}
select id, app, level from logs where app in ('app2', 'app4', 'app5')""")
def q_filter_apps(spark, sf_dir):
    return flt.filter_apps(logs(spark, sf_dir), ["app2", "app4", "app5"]).select("id", "app", "level")


@query("filter_time", f"""{cte('logs')}
select id, app, added from logs where added >= {_ts(TIME_FROM)} and added <= {_ts(TIME_TO)}""")
def q_filter_time(spark, sf_dir):
    return flt.filter_time(logs(spark, sf_dir), TIME_FROM, TIME_TO).select("id", "app", "added")


@query("filter_search", f"""{cte('doc_logs')}
select id, app, logger, level from doc_logs
where list_has_any({tokens_sql(search_text_sql())}, {tokens_sql(repr(DOC_QUERY))})""")
def q_filter_search(spark, sf_dir):
    return flt.filter_search(doc_logs(spark, sf_dir), DOC_QUERY).select("id", "app", "logger", "level")


@query("filter_search_prefix", f"""{cte('doc_logs')}
select id, app, logger, level from doc_logs
where len(list_filter({tokens_sql(search_text_sql())}, lambda t: starts_with(t, '{DOC_PREFIX}'))) > 0""")
def q_filter_search_prefix(spark, sf_dir):
    return flt.filter_search(doc_logs(spark, sf_dir), DOC_PREFIX, mode="prefix").select("id", "app", "logger", "level")


@query("search_gate", f"""{cte('logs')}
select id, q, case when length(q) >= 3 then q end as gated_q
from (select id, case id % 4 when 0 then thread when 1 then concat('k', cast(id % 10 as varchar))
                 when 2 then '' else message end as q from logs) t""")
def q_search_gate(spark, sf_dir):
    df = logs(spark, sf_dir)
    q = (F.when(F.col("id") % 4 == 0, F.col("thread"))
          .when(F.col("id") % 4 == 1, F.concat(F.lit("k"), (F.col("id") % 10).cast("string")))
          .when(F.col("id") % 4 == 2, F.lit(""))
          .otherwise(F.col("message")))
    return df.select("id", q.alias("q")).select("id", "q", flt.search_gate("q").alias("gated_q"))


@query("token_index", f"""{cte('logs')}
select distinct token, id from (select id, unnest({tokens_sql(search_text_sql())}) as token from logs) t""")
def q_token_index(spark, sf_dir):
    return flt.token_index(logs(spark, sf_dir)).select("token", "id")


def doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token index of ``doc_logs``, written once to the shared folder."""
    src = store.materialized_view(spark, sf_dir, "doc_logs")
    path = src.rstrip("/") + "-tokens2"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        flt.write_token_index(flt.token_index(store.scan_logs(spark, src)), path)
    return spark.read.parquet(path)


@query("search_index", f"""{cte('doc_logs')}
select id, app, logger, level from doc_logs
where list_has_any({tokens_sql(search_text_sql())}, {tokens_sql(repr(DOC_QUERY))})""")
def q_search_index(spark, sf_dir):
    return flt.search_index(doc_index(spark, sf_dir), doc_logs(spark, sf_dir), DOC_QUERY) \
              .select("id", "app", "logger", "level")


@query("filter_all", f"""{cte('logs')}
select id, app, level, added from logs
where app in ('app1', 'app3', 'app4') and level in {levels_from_sql(40)}
  and added >= {_ts(ALL_SPEC.from_)} and added <= {_ts(ALL_SPEC.to)}
  and list_has_any({tokens_sql(search_text_sql())}, {tokens_sql(repr(ALL_SPEC.query))})""")
def q_filter_all(spark, sf_dir):
    return flt.filter_all(logs(spark, sf_dir), ALL_SPEC).select("id", "app", "level", "added")


@query("sort_added", f"""{cte('logs')}
select id, app, added from logs""")
def q_sort_added(spark, sf_dir):
    """Full-table order by (added, id) desc; the order itself is checked in the tests."""
    return srch.sort_added(logs(spark, sf_dir).select("id", "app", "added"), "desc")


@query("sort_severity", f"""{cte('logs')}
select id, level from logs""")
def q_sort_severity(spark, sf_dir):
    return srch.sort_severity(logs(spark, sf_dir).select("id", "level"))


@query("position_added", f"""{cte('logs')}
select row_number() over (order by added desc, id desc) as pos, id, app, added from logs""")
def q_position_added(spark, sf_dir):
    """The exact position of every row in (added, id) order, desc, computed
    without gathering the table into one task."""
    df = logs(spark, sf_dir).select("id", "app", "added")
    return range_rank(df, [], [F.col("added").desc(), F.col("id").desc()], "pos") \
        .select("pos", "id", "app", "added")


@query("page", f"""{cte('logs')}
select {LOG_COLS_SQL} from logs order by added desc, id desc limit 500 offset 1000""")
def q_page(spark, sf_dir):
    return srch.page(srch.sort_added(logs(spark, sf_dir).select(*LOG_COLUMNS), "desc"), 500, 1000)


def derived_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewer requests derived from the log rows: (spec_id, lim, off)."""
    return logs(spark, sf_dir).select(
        F.col("id").alias("spec_id"),
        (F.col("id") % 7 * 100).cast("int").alias("lim"),
        (F.col("id") % 13 * 250).cast("int").alias("off"),
    )


@query("page_links", f"""{cte('logs')}
select spec_id, lim, off, case when off >= 500 then off - 500 end as prev_offset, off + 500 as next_offset
from (select id as spec_id, cast(id % 7 * 100 as int) as lim, cast(id % 13 * 250 as int) as off from logs) t""")
def q_page_links(spark, sf_dir):
    return srch.page_links(derived_offsets(spark, sf_dir))


@query("history_search", f"""{cte('logs')}
select {LOG_COLS_SQL} from logs
where app in ('app1', 'app3') and level in {levels_from_sql(30)} and added >= {_ts(FLAGSHIP.from_)}
order by added desc, id desc limit {FLAGSHIP.limit} offset {FLAGSHIP.offset}""")
def q_history_search(spark, sf_dir):
    return srch.history_search(logs(spark, sf_dir), FLAGSHIP)


# The fixture specs plus one with a text query.
EXTRA_SPEC = (4, "app2,app4", 20, dt.datetime(2024, 1, 2), None, 50, 10, "asc", "purchase error")


def specs(spark: SparkSession, sf_dir: str, extra: bool = True) -> DataFrame:
    s = fixtures.view(spark, sf_dir, "specs")
    if extra:
        spec_id, apps, lvl, f, t, lim, off, ord_, q = EXTRA_SPEC
        row = spark.createDataFrame(
            [(spec_id, apps.split(","), lvl, f, t, lim, off, ord_, q)],
            "spec_id long, apps array<string>, min_level int, from_ts timestamp_ntz, "
            "to_ts timestamp_ntz, lim int, off int, ord string, q string")
        s = s.unionByName(row)
    return s


SPECS_SQL = f"""
s as (select cast(spec_id as bigint) as spec_id, list_filter(string_split(apps, ','), lambda a: a <> '') as apps, min_level,
        from_ts, to_ts, lim, off, ord, cast(null as varchar) as q from specs
      union all
      select 4, ['app2', 'app4'], 20, timestamp '2024-01-02 00:00:00', cast(null as timestamp), 50, 10, 'asc',
             'purchase error'),
m as (select s.spec_id, s.lim, s.off, s.ord, l.* from s join logs l
        on (len(s.apps) = 0 or list_contains(s.apps, l.app)) and l.level >= s.min_level
       and l.level in {LEVELS_SQL}
       and (s.from_ts is null or l.added >= s.from_ts) and (s.to_ts is null or l.added <= s.to_ts)
       and (s.q is null or length(s.q) < 3
            or list_has_any({tokens_sql(search_text_sql('l.'))}, {tokens_sql('s.q')}))),
r as (select *, row_number() over (partition by spec_id order by
        case when ord = 'asc' then epoch_us(added) else -epoch_us(added) end,
        case when ord = 'asc' then id else -id end) as rank from m),
h as (select * from r where rank > off and rank <= off + lim)"""


@query("history_many", f"""{cte('logs', 'specs')},{SPECS_SQL}
select spec_id, rank, {LOG_COLS_SQL} from h""")
def q_history_many(spark, sf_dir):
    return srch.history_many(logs(spark, sf_dir), specs(spark, sf_dir))


@query("history_or_nodata", f"""{cte('logs', 'specs')},{SPECS_SQL},
n as (select spec_id, count(*) as cnt from h group by spec_id)
select h.spec_id, n.cnt + h.off - h.rank + 1 as seq, 'events' as kind, h.id, h.app, h.level, h.added, h.message
from h join n on h.spec_id = n.spec_id
union all
select s.spec_id, 1 as seq, 'noData' as kind, null, null, null, null, null
from s where s.spec_id not in (select spec_id from n)""")
def q_history_or_nodata(spark, sf_dir):
    return srch.history_or_nodata(logs(spark, sf_dir), specs(spark, sf_dir))


# A page wider than the partial limits: ranked over range partitions instead.
WIDE_SPECS_SQL = SPECS_SQL.replace("lim, off, ord, cast(null", "lim + 2000 as lim, off, ord, cast(null").replace("null as timestamp), 50, 10", "null as timestamp), 2050, 10")


@query("history_many_wide", f"""{cte('logs', 'specs')},{WIDE_SPECS_SQL}
select spec_id, rank, {LOG_COLS_SQL} from h""")
def q_history_many_wide(spark, sf_dir):
    """Pages of more than 2,000 rows per viewer."""
    wide = specs(spark, sf_dir).withColumn("lim", F.col("lim") + 2000)
    return srch.history_many(logs(spark, sf_dir), wide)


# One viewer for every tenth row: its app and the next one (or all apps), a time
# range from around the row, either order, pages at several offsets.
CROWD_SQL = """
s as (select id as spec_id,
        case v % 3 when 0 then cast([] as varchar[]) else [app, concat('app', v % 7)] end as apps,
        level as min_level, case when v % 4 > 0 then added - interval 90 minute end as from_ts,
        case when v % 5 > 2 then added + cast(v % 300 as int) * interval 1 hour end as to_ts,
        cast(v % 6 * 4 as int) as lim, cast(v % 8 * 9 as int) as off,
        case when v % 2 = 0 then 'asc' else 'desc' end as ord, cast(null as varchar) as q
      from (select *, id // 10 as v from logs where id % 10 = 1) t)"""


def crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.floor(F.col("id") / 10)
    hours = F.make_dt_interval(F.lit(0), (i % 300).cast("int"))
    return logs(spark, sf_dir).where("id % 10 = 1").select(
        F.col("id").alias("spec_id"),
        F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(
            F.array("app", F.concat(F.lit("app"), (i % 7).cast("string")))).alias("apps"),
        F.col("level").alias("min_level"),
        F.when(i % 4 > 0, F.col("added") - F.expr("interval 90 minutes")).alias("from_ts"),
        F.when(i % 5 > 2, F.col("added") + hours).alias("to_ts"),
        (i % 6 * 4).cast("int").alias("lim"), (i % 8 * 9).cast("int").alias("off"),
        F.when(i % 2 == 0, "asc").otherwise("desc").alias("ord"), F.lit(None).cast("string").alias("q"))


CROWD_PAGES_SQL = CROWD_SQL + SPECS_SQL[SPECS_SQL.index(",\nm as ("):]


@query("history_many_viewers", f"""{cte('logs')},{CROWD_PAGES_SQL}
select spec_id, rank, {LOG_COLS_SQL} from h""")
def q_history_many_viewers(spark, sf_dir):
    """The pages of a crowd of viewers, found by counts per day, app and level."""
    return history_by_cells(logs(spark, sf_dir), crowd(spark, sf_dir))


DEEP = SearchSpec(apps=("app0", "app1", "app3", "app6"), level="debug", from_=dt.datetime(2024, 1, 2), limit=70, order="asc")


@query("history_search_deep", f"""{cte('logs')},
hits as (select * from logs where app in ('app0', 'app1', 'app3', 'app6') and level in {levels_from_sql(20)}
         and added >= {_ts(DEEP.from_)})
select {LOG_COLS_SQL} from hits order by added, id limit 70 offset (select count(*) * 7 // 10 from hits)""")
def q_history_search_deep(spark, sf_dir):
    """A page behind seven tenths of a viewer's rows, through the table's
    stored counts per hour."""
    rows, path = logs(spark, sf_dir), store.materialized_view(spark, sf_dir, "logs")
    hits = flt.filter_all(rows, DEEP).count()
    return srch.deep_page(rows, dataclasses.replace(DEEP, offset=hits * 7 // 10), store.cell_counts(spark, path))


INDEXED = SearchSpec(apps=(), level="info", from_=dt.datetime(2024, 1, 3), to=dt.datetime(2024, 1, 9), limit=40,
                     query=DOC_QUERY)


@query("history_search_indexed", f"""{cte('doc_logs')}
select {LOG_COLS_SQL} from doc_logs where level in {levels_from_sql(30)}
  and added >= {_ts(INDEXED.from_)} and added <= {_ts(INDEXED.to)}
  and list_has_any({tokens_sql(search_text_sql())}, {tokens_sql(repr(DOC_QUERY))})
order by added desc, id desc limit 40""")
def q_history_search_indexed(spark, sf_dir):
    """A text search answered through the stored token index."""
    return srch.history_search(doc_logs(spark, sf_dir), INDEXED, index=doc_index(spark, sf_dir))


@query("token_index_appended", f"""{cte('logs')}
select distinct token, id from (select id, unnest({tokens_sql(search_text_sql())}) as token from logs) t""")
def q_token_index_appended(spark, sf_dir):
    """The index kept by appends: the rows arrive in two batches, the second
    one twice (a replay)."""
    rows, path = logs(spark, sf_dir), fresh_path(spark, "tokens")
    for batch, keep in ((1, "id % 3 = 0"), (2, "id % 3 <> 0"), (2, "id % 3 <> 0")):
        flt.append_token_index(rows.where(keep), path, batch)
    return spark.read.parquet(path).select("token", "id")


def log_postings(spark: SparkSession, sf_dir: str, name: str = "logs") -> DataFrame:
    """The postings of a stored view, written once to the shared folder."""
    src = store.materialized_view(spark, sf_dir, name)
    path = src.rstrip("/") + "-postings"
    if not path_exists(spark, f"{path}/batch=0/_SUCCESS"):
        post.append_postings(store.scan_logs(spark, src), path, batch=0)
    return post.read_postings(spark, path)


HOT = SearchSpec(apps=("app1", "app2", "app6"), level="debug", to=dt.datetime(2024, 1, 27), limit=300, offset=20,
                 query="purchase click unheard")


@query("history_search_hot_words", f"""{cte('logs')}
select {LOG_COLS_SQL} from logs where app in ('app1', 'app2', 'app6') and level in {levels_from_sql(20)}
  and added <= {_ts(HOT.to)} and list_has_any({tokens_sql(search_text_sql())}, {tokens_sql(repr(HOT.query))})
order by added desc, id desc limit 300 offset 20""")
def q_history_search_hot_words(spark, sf_dir):
    """A page of words held by large parts of the rows, through their newest blocks."""
    return srch.history_search(logs(spark, sf_dir), HOT, postings=log_postings(spark, sf_dir))


PREFIXES = SearchSpec(level="trace", from_=dt.datetime(2024, 1, 9), limit=200, order="asc", query="purch Runtime k7")


@query("history_search_prefix", f"""{cte('logs')}
select {LOG_COLS_SQL} from logs where level in {levels_from_sql(10)} and added >= {_ts(PREFIXES.from_)}
  and len(list_filter({tokens_sql(search_text_sql())}, lambda t: starts_with(t, 'purch') or starts_with(t, 'runtime'))) > 0
order by added, id limit 200""")
def q_history_search_prefix(spark, sf_dir):
    """A page of rows with words that start with a query word of three letters
    or more, by key ranges of the index."""
    return srch.history_search(logs(spark, sf_dir), PREFIXES, mode="prefix", postings=log_postings(spark, sf_dir))


@query("search_prefix_indexed", f"""{cte('doc_logs')}
select id, app, logger, level from doc_logs
where len(list_filter({tokens_sql(search_text_sql())}, lambda t: starts_with(t, '{DOC_PREFIX}'))) > 0""")
def q_search_prefix_indexed(spark, sf_dir):
    """Every row with a word of a prefix, by a key range of the index."""
    return post.search_postings(log_postings(spark, sf_dir, "doc_logs"), doc_logs(spark, sf_dir), DOC_PREFIX, "prefix") \
               .select("id", "app", "logger", "level")


# The crowd again, each with a text query: its row's event type and a word of no row.
TEXT_CROWD_SQL = CROWD_SQL.replace("cast(null as varchar) as q", "concat(split_part(message, ' ', 1), ' nowhere') as q")


@query("history_many_texts", f"""{cte('logs')},{TEXT_CROWD_SQL}{SPECS_SQL[SPECS_SQL.index(",\nm as ("):]}
select spec_id, rank, {LOG_COLS_SQL} from h""")
def q_history_many_texts(spark, sf_dir):
    """The pages of a crowd of viewers who all search for words."""
    rows = logs(spark, sf_dir).select(F.col("id").alias("spec_id"), F.concat(
        F.split_part("message", F.lit(" "), F.lit(1)), F.lit(" nowhere")).alias("q"))
    return srch.history_many(logs(spark, sf_dir), crowd(spark, sf_dir).drop("q").join(rows, "spec_id"))
