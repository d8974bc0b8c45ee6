"""Registered queries: Structured Streaming runs.

Each run reads a table of ``sf_dir`` (``events``), or one written once from
it (the raw message inbox, the presence events), as a file stream, runs with
``trigger(availableNow=True)`` into new folders under the shared folder, and
returns what the sink holds afterwards.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from logloom.operators.filters import SearchSpec
from logloom.plans.ingest_plans import ACCEPTED_SQL, ENRICHED_COLS
from logloom.plans.registry import query
from logloom.plans.routing_plans import ROUTE_SQL, live_viewers
from logloom.plans.search_plans import logs
from logloom.session import fresh_path
from logloom.sources import fixtures, store
from logloom.streaming import streams as st

LIVE_SPEC = SearchSpec(apps=("app2", "app6"), level="warn", from_=dt.datetime(2024, 1, 20),
                       limit=50, offset=0, order="desc")
TIMEOUT_S = 1800


def _run(q) -> None:
    q.awaitTermination(TIMEOUT_S)
    if q.isActive:
        q.stop()
        raise TimeoutError("stream did not finish")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def logs_stream(spark, sf_dir, copies: int = 1):
    ev = st.file_stream(spark, sf_dir, "events")
    for _ in range(copies - 1):
        ev = ev.unionByName(st.file_stream(spark, sf_dir, "events"))
    return fixtures.view_over(spark, "logs", events=ev)


@query("ingest_stream", f"""{ACCEPTED_SQL}
select {', '.join(ENRICHED_COLS)} from enr""")
def q_ingest_stream(spark, sf_dir):
    """Raw batches land as files; the stream decodes, appends (one ingest
    batch per micro-batch) and publishes the stored rows, read back here."""
    inbox = store.materialized_raw(spark, sf_dir)
    table, updates, ckpt = fresh_path(spark, "table"), fresh_path(spark, "updates"), fresh_path(spark, "ckpt")
    _run(st.ingest_stream(st.file_stream(spark, inbox, max_files=8), table, updates, ckpt, available_now=True,
                          apps=logs(spark, sf_dir).select("app").distinct()))
    return spark.read.parquet(updates).select(*ENRICHED_COLS)


@query("live_tail", f"""{fixtures.duck_cte('logs')}
select id, app, level from logs where app in ('app2', 'app6') and level in (40, 50, 60)""")
def q_live_tail(spark, sf_dir):
    out, ckpt = fresh_path(spark, "tail"), fresh_path(spark, "ckpt")
    _run(st.live_tail(logs_stream(spark, sf_dir), LIVE_SPEC, out, ckpt, available_now=True))
    return spark.read.parquet(out).select("id", "app", "level")


# The rows stored when a viewer subscribes: the lower three quarters of the ids.
MARK_SQL = "mark as (select max(id) * 3 // 4 as m from logs)"


def partly_stored(spark, sf_dir, out: str) -> str:
    """A table of the lower three quarters of the rows, the subscription's cut
    in ``out``, then the next eighth appended behind it."""
    rows, table = logs(spark, sf_dir), fresh_path(spark, "table")
    mark = rows.agg(F.floor(F.max("id") * 3 / 4)).first()[0]
    store.write_logs(rows.where(F.col("id") <= mark), table, batch=0)
    st.hand_over(spark, table, out)
    store.write_logs(rows.where((F.col("id") > mark) & (F.col("id") <= mark + mark // 6)), table, batch=1)
    return table


@query("history_then_tail", f"""{fixtures.duck_cte('logs')}, {MARK_SQL},
page as (select id, added from logs, mark where id <= m and app in ('app2', 'app6') and level in (40, 50, 60)
           and added >= timestamp '2024-01-20 00:00:00' order by added desc, id desc limit 50),
head as (select row_number() over (order by added, id) as seq, 'events' as kind, id from page
         union all select 1, 'noData', null where (select count(*) from page) = 0)
select 0 as part, cast(1 as bigint) as seq, 'loading' as kind, cast(null as bigint) as id
union all select 1, seq, kind, id from head
union all select 2, null, 'events', id from logs, mark where app in ('app2', 'app6') and level in (40, 50, 60) and id > m""")
def q_history_then_tail(spark, sf_dir):
    """Three quarters of the rows are stored when the viewer subscribes, an eighth
    is stored before its history is read; the stream brings all rows again."""
    out, ckpt = fresh_path(spark, "htt"), fresh_path(spark, "ckpt")
    table = partly_stored(spark, sf_dir, out)
    _run(st.history_then_tail(spark, table, logs_stream(spark, sf_dir), LIVE_SPEC, out, ckpt, available_now=True))
    return spark.read.parquet(f"{out}/head").unionByName(spark.read.parquet(f"{out}/tail"))


@query("tail_dedupe", f"""{fixtures.duck_cte('logs')}
select id, app from logs""")
def q_tail_dedupe(spark, sf_dir):
    """The rows arrive in four micro-batches, each holding repeats of others
    and rows of days long before those already seen."""
    inbox, rows = fresh_path(spark, "dedupe-in"), logs(spark, sf_dir).select("id", "app", "added")
    for part, keep in enumerate(("id % 3 <> 0", "id % 3 <> 1", "id % 2 = 0", "id % 3 <> 2")):
        rows.where(keep).write.parquet(f"{inbox}/part{part}")
    out, ckpt = fresh_path(spark, "dedupe"), fresh_path(spark, "ckpt")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 3).parquet(inbox)
    _run(st.tail_dedupe(stream, out, ckpt, available_now=True))
    return spark.read.parquet(out).select("id", "app")


@query("presence_stream", f"""{fixtures.duck_cte('presence')}
select conn_id, arg_min(app, seq) as app, min(case when action = 'joined' then seq end) as joined_seq
from presence group by conn_id having arg_max(action, seq) = 'joined'""")
def q_presence_stream(spark, sf_dir):
    """Connection events stream in (files of presence events); every
    micro-batch publishes the full connected set; the last one is returned."""
    inbox = fresh_path(spark, "presence-in")
    store.fixture_table(spark, sf_dir, "presence").repartitionByRange(4, "seq").write.parquet(inbox)
    out, ckpt = fresh_path(spark, "presence"), fresh_path(spark, "ckpt")
    _run(st.presence_stream(st.file_stream(spark, inbox, max_files=1), out, ckpt, available_now=True))
    return st.presence_current(spark, out)


@query("route_stream", f"""{ROUTE_SQL}
select spec_id, id, app, level from live""")
def q_route_stream(spark, sf_dir):
    """New events stream in and fan out to every live viewer of the table."""
    out, ckpt = fresh_path(spark, "route"), fresh_path(spark, "ckpt")
    _run(st.route_stream(logs_stream(spark, sf_dir).select("id", "app", "level"), live_viewers(spark, sf_dir),
                         out, ckpt, available_now=True))
    return spark.read.parquet(out).select("spec_id", "id", "app", "level")


STORED_LOGS_SQL = ROUTE_SQL.replace("join logs l", "join stored l", 1).replace(
    "\ns as (", f"\n{MARK_SQL},\nstored as (select logs.* from logs, mark where id <= m),\ns as (", 1)


@query("tail_many", f"""{STORED_LOGS_SQL}
select 1 as part, spec_id, id from h
union all select 2, spec_id, id from live, mark where id > m""")
def q_tail_many(spark, sf_dir):
    """Every viewer's history page of the stored rows, then the live rows
    above it; the stream brings all rows again."""
    out, ckpt = fresh_path(spark, "tails"), fresh_path(spark, "ckpt")
    table = partly_stored(spark, sf_dir, out)
    _run(st.tail_many(spark, table, logs_stream(spark, sf_dir).select("id", "app", "level"),
                      live_viewers(spark, sf_dir), out, ckpt, available_now=True))
    history = spark.read.parquet(f"{out}/history").select(F.lit(1).alias("part"), "spec_id", "id")
    return history.unionByName(spark.read.parquet(f"{out}/tail").select(F.lit(2).alias("part"), "spec_id", "id"))
