"""Registered queries: decode, reject, enrich, append and check."""

from __future__ import annotations

import datetime as dt

from logloom.operators import decode as dec
from logloom.operators import ingest as ing
from logloom.plans.oracle import LOG_COLS_SQL, cte
from logloom.plans.registry import query
from logloom.session import fresh_path
from logloom.sources import store

INGEST_TIME = dt.datetime(2024, 2, 1)
ENRICHED_COLS = ["batch_id", "pos", "app", "address", "timestamp", "message", "logger", "thread", "level",
                 "client", "user_agent", "stacktrace"]

# Oracle: which generated batches decode (none of their ids has id % 50 = 7,
# the unknown level), and the hand-written messages that decode.
ACCEPTED_SQL = f"""{cte('logs')},
bad as (select distinct id // 10 as batch_id from logs where id % 50 = 7),
acc as (select id // 10 as batch_id, id % 10 as pos, timestamp, message, logger, thread, level, stacktrace
        from logs where id // 10 not in (select batch_id from bad)),
hand as (select * from (values
   (-6, 0, timestamp '2024-01-02 03:04:05.678', 'typed', 'l', 't', 40, cast(null as varchar)),
   (-8, 0, timestamp '2024-01-01 00:00:00', 'legacy2', 'l', 't', 30, cast(null as varchar)),
   (-13, 0, timestamp '2024-01-01 00:00:00', 'm13', 'l', 't', 30, cast(null as varchar)))
   t(batch_id, pos, timestamp, message, logger, thread, level, stacktrace)),
dec as (select * from acc union all select * from hand),
first_ids as (select id // 10 as batch_id, min(id) as mid from logs group by 1),
conn as (select f.batch_id, l.app, l.address, l.client, l.user_agent from first_ids f join logs l on l.id = f.mid
         union all select b, 'app1', '10.0.0.1', cast(null as varchar), 'agent/hand' from (values (-6), (-8), (-13)) t(b)),
enr as (select d.batch_id, d.pos, c.app, c.address, d.timestamp, d.message, d.logger, d.thread, d.level, c.client,
          case when trim(c.user_agent) <> '' then substr(trim(c.user_agent), 1, 100) end as user_agent, d.stacktrace
        from dec d join conn c on c.batch_id = d.batch_id)"""


def raw(spark, sf_dir):
    """The raw messages (written once from the fixture batches, then read)."""
    return store.raw_table(spark, sf_dir)


def enriched(spark, sf_dir):
    return dec.enrich_source(dec.decode_events(raw(spark, sf_dir)))


@query("decode_events", f"""{ACCEPTED_SQL}
select batch_id, pos, timestamp, message, logger, thread, level, stacktrace from dec""")
def q_decode_events(spark, sf_dir):
    return dec.decode_events(raw(spark, sf_dir)).select(
        "batch_id", "pos", "timestamp", "message", "logger", "thread", "level", "stacktrace")


@query("reject_batches", f"""{ACCEPTED_SQL}
select batch_id, 'Invalid event.' as reason from bad
union all select * from (values (-1, 'Malformed JSON.'), (-2, 'Missing events.'), (-4, 'No timestamp.'),
  (-5, 'Invalid timestamp.'), (-7, 'No timestamp.'), (-9, 'Invalid event.'), (-10, 'Invalid event.'),
  (-11, 'Invalid event.'), (-12, 'App name must not be blank.')) t(batch_id, reason)""")
def q_reject_batches(spark, sf_dir):
    return dec.reject_batches(raw(spark, sf_dir)).select("batch_id", "reason")


@query("enrich_source", f"""{ACCEPTED_SQL}
select {', '.join(ENRICHED_COLS)} from enr""")
def q_enrich_source(spark, sf_dir):
    return enriched(spark, sf_dir)


@query("published_counts", f"""{ACCEPTED_SQL}
select batch_id, count(*) as event_count from acc group by batch_id
union all select * from (values (-3, 0), (-6, 1), (-8, 1), (-13, 1)) t(batch_id, event_count)""")
def q_published_counts(spark, sf_dir):
    return dec.published_counts(raw(spark, sf_dir))


APPENDED_SQL = f"""{ACCEPTED_SQL},
app_rows as (select batch_id, pos, row_number() over (order by batch_id, pos) as id, app, address, timestamp,
  message, logger, thread, level, client, user_agent, stacktrace, timestamp '2024-02-01 00:00:00' as added from enr)"""


def _append(spark, sf_dir):
    path = fresh_path(spark, "append")
    rows = enriched(spark, sf_dir)
    return rows, ing.append_logs(rows, path, batch=1, added=INGEST_TIME), path


@query("append_logs", f"""{APPENDED_SQL}
select batch_id, pos, {LOG_COLS_SQL} from app_rows""")
def q_append_logs(spark, sf_dir):
    """Decode, enrich and append to a new table (ids from 1 in batch/position
    order, one ingest time); the result is read back from the table."""
    return _append(spark, sf_dir)[1]


@query("written_rows", f"""{APPENDED_SQL}
select batch_id, pos, {LOG_COLS_SQL} from app_rows""")
def q_written_rows(spark, sf_dir):
    """Append, then re-read the whole table by the ids just assigned."""
    rows, written, path = _append(spark, sf_dir)
    return ing.written_rows(store.scan_logs(spark, path), written.select("id", "batch_id", "pos"))


@query("write_check", f"""{APPENDED_SQL}
select batch_id, count(*) as n_in, count(*) as n_out, true as ok from enr group by batch_id""")
def q_write_check(spark, sf_dir):
    rows, written, _ = _append(spark, sf_dir)
    return ing.write_check(rows, written)


@query("decode_events_lenient", f"""{ACCEPTED_SQL}
select batch_id, pos, timestamp, message, logger, thread, level, stacktrace from dec
union all select -7, 0, timestamp '2024-01-01 00:00:00', 'legacy', 'l', 't', 50, cast(null as varchar)""")
def q_decode_events_lenient(spark, sf_dir):
    """``legacy='lenient'``: a legacy event with a known level takes its ``timeStamp``."""
    return dec.decode_events(raw(spark, sf_dir), legacy="lenient").select(
        "batch_id", "pos", "timestamp", "message", "logger", "thread", "level", "stacktrace")
