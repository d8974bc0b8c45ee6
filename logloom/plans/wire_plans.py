"""Registered queries: wire frames for viewers and admins, presence counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import presence as pr
from logloom.operators import views as vw
from logloom.plans.function_plans import ENCODE_IN, ENCODE_IN_DUCK, _hm
from logloom.plans.ingest_plans import APPENDED_SQL, _append
from logloom.plans.inputs import duck_with, spark_input
from logloom.plans.oracle import display_sql, iso_sql, level_name_sql
from logloom.plans.registry import query
from logloom.plans.search_plans import logs
from logloom.sources import fixtures, store


@query("to_wire_meta", f"""{duck_with(['logs'], ei=(ENCODE_IN_DUCK, ['logs']))}
select id, cast(to_json(struct_pack(event := case when id % 2 = 0 then 'loading' else 'noData' end,
  meta := struct_pack(apps := apps, level := {level_name_sql('level')},
    timeRange := struct_pack("from" := {_hm('f')}, "to" := {_hm('t')}),
    limits := struct_pack("limit" := lim, "offset" := off), query := q))) as varchar) as json from ei""")
def q_to_wire_meta(spark, sf_dir):
    """``loading`` (even ids) or ``noData`` frames echoing each request."""
    df = spark_input(spark, sf_dir, ENCODE_IN.replace("{LB}{RB}", "cast(array() as array<string>)"), ["logs"])
    loading = vw.wire_meta("loading", "apps", "level", "f", "t", "lim", "off", "q")
    nodata = vw.wire_meta("noData", "apps", "level", "f", "t", "lim", "off", "q")
    return df.select("id", F.when(F.col("id") % 2 == 0, loading).otherwise(nodata).alias("json"))


def _event_json_sql(p: str = "") -> str:
    return (f"to_json(struct_pack(id := {p}id, source := struct_pack(name := {p}app, remoteAddress := {p}address, "
            f"clientId := {p}client, userAgent := {p}user_agent), event := struct_pack(isoTimestamp := "
            f"{iso_sql(p + 'timestamp')}, timestamp := epoch_ms({p}timestamp), timeFormatted := "
            f"{display_sql(p + 'timestamp')}, message := {p}message, loggerName := {p}logger, threadName := "
            f"{p}thread, level := {level_name_sql(p + 'level')}, stackTrace := {p}stacktrace), "
            f"added := epoch_ms({p}added), addedFormatted := {display_sql(p + 'added')}))")


@query("to_wire_batch", f"""{APPENDED_SQL}
select batch_id, concat('{{"events":[', string_agg({_event_json_sql()}, ',' order by pos), '],"event":"events"}}') as json
from app_rows group by batch_id""")
def q_to_wire_batch(spark, sf_dir):
    """Decode, enrich and append the raw messages, then publish each stored
    message as one tagged ``events`` frame."""
    _, written, _ = _append(spark, sf_dir)
    return vw.wire_batches(written)


SOURCES_SQL = f"""{fixtures.duck_cte('presence', 'logs')},
now_open as (select conn_id, arg_min(app, seq) as app from presence group by conn_id
             having arg_max(action, seq) = 'joined')"""


def _open_sources(spark, sf_dir):
    open_now = pr.presence_now(store.fixture_table(spark, sf_dir, "presence")).select("conn_id", "app")
    rows = logs(spark, sf_dir).select(F.col("id").alias("conn_id"), "address", "user_agent",
                                      F.col("timestamp").alias("joined"))
    return open_now.join(rows, "conn_id")


@query("wire_sources", f"""{SOURCES_SQL}
select n.conn_id, cast(to_json(struct_pack(name := n.app, remoteAddress := l.address, userAgent := l.user_agent,
  id := cast(n.conn_id as varchar), joined := epoch_ms(l.timestamp), joinedFormatted := {iso_sql('l.timestamp')},
  timeJoined := {display_sql('l.timestamp')})) as varchar) as json
from now_open n join logs l on l.id = n.conn_id""")
def q_wire_sources(spark, sf_dir):
    """Each connected source as an element of the admins' ``sources`` frame."""
    return _open_sources(spark, sf_dir).select("conn_id", F.to_json(vw.source_struct(), vw.TO_JSON_OPTS).alias("json"))


@query("presence_changes", f"""{fixtures.duck_cte('presence')}
select seq, conn_id, app, action,
  cast(sum(case when action = 'joined' then 1 else -1 end) over (order by seq
      rows between unbounded preceding and current row) as bigint) as n_connected from presence""")
def q_presence_changes(spark, sf_dir):
    """Size of the whole connected set after each join/leave (what each admin
    snapshot holds), as a running count without a single-task window."""
    return pr.presence_changes(store.fixture_table(spark, sf_dir, "presence")) \
             .select("seq", "conn_id", "app", "action", "n_connected")


# Admin frames by id: which of them decode, and as what, follows from how each is made.
SOURCE = """'{{"name":"', app, '","remoteAddress":"', address, '","userAgent":null,"id":"', cast(id as {V}), '","joined":', cast(id as {V}), ',"joinedFormatted":"x","timeJoined":"y"}}'"""
ADMIN_FRAMES = f"""
select id, case id % 9
  when 0 then '{{{{"event":"ping"}}}}'
  when 1 then concat('{{{{"sources":[', {SOURCE}, ']}}}}')
  when 2 then concat('{{{{"event":"', app, '"}}}}')
  when 3 then concat('{{{{"sources":', cast(id as {{V}}), '}}}}')
  when 4 then '{{{{"sources":[]}}}}'
  when 5 then concat('{{{{"sources":[', {SOURCE}, ',', {SOURCE}, '],"event":"x"}}}}')
  when 6 then '{{{{"sources":[{{{{"bogus":1}}}}]}}}}'
  when 7 then concat('{{{{"sources":[', {SOURCE}, ',{{{{"name":"', app, '"}}}}],"event":"partly"}}}}')
  else concat('{{{{"sources":[{{{{"name":" ","remoteAddress":"a","id":"1","joined":true}}}}]', '}}}}') end as json from {{logs}}"""


@query("decode_frames_admin", f"""{duck_with(['logs'], fr=(ADMIN_FRAMES, ['logs']))},
app_of as (select id, app from logs)
select fr.id, json, case when fr.id % 9 in (1, 4, 5) then 'sources' else 'simple' end as kind,
  cast(case fr.id % 9 when 1 then 1 when 4 then 0 when 5 then 2 end as int) as n_items,
  case fr.id % 9 when 2 then app when 5 then 'x' when 7 then 'partly' end as frame_event
from fr join app_of on fr.id = app_of.id where fr.id % 9 in (1, 2, 4, 5, 7)""")
def q_decode_frames_admin(spark, sf_dir):
    df = spark_input(spark, sf_dir, ADMIN_FRAMES, ["logs"])
    return vw.decode_frames(df, admin=True).select("id", "json", "kind", "n_items", "frame_event")
