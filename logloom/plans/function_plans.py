"""Registered queries: scalar functions and row views (§2.B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import labels as lab
from logloom.functions import levels as lv
from logloom.functions import query as qf
from logloom.functions import text as tx
from logloom.functions import timefmt as tf
from logloom.operators import requests as rq
from logloom.operators import views as vw
from logloom.plans.inputs import duck_with, spark_input
from logloom.plans.oracle import display_sql, iso_sql, level_name_sql
from logloom.plans.registry import query
from logloom.plans.search_plans import logs

NOW_SQL = "{L} '2024-02-01 00:00:00'"

# ---------------------------------------------------------------------------
# levels

LEVEL_TEXT = """
select id, level, case when id % 50 = 7 then 'bogus'
  when id % 3 = 1 then upper(n) when id % 3 = 2 then concat(upper(substr(n, 1, 1)), substr(n, 2)) else n end as level_text
from (select id, level, case level when 10 then 'trace' when 20 then 'debug' when 30 then 'info'
        when 40 then 'warn' when 50 then 'error' else 'other' end as n from {logs}) t"""


@query("levels", f"""{duck_with(['logs'], lt=(LEVEL_TEXT, ['logs']))}
select id, level, {level_name_sql('level')} as level_name, level_text,
  case lower(level_text) when 'trace' then 10 when 'debug' then 20 when 'info' then 30
    when 'warn' then 40 when 'error' then 50 when 'other' then 60 end as level_int
from lt""")
def q_levels(spark, sf_dir):
    df = spark_input(spark, sf_dir, LEVEL_TEXT, ["logs"])
    return df.select("id", "level", lv.level_name("level").alias("level_name"), "level_text",
                     lv.level_int("level_text").alias("level_int"))


LIB_LEVEL = """
select id, case when id % 2 = 0 then
  case level when 10 then 'TRACE' when 20 then 'debug' when 30 then 'INFO' when 40 then 'WARN' when 50 then 'ERROR' else 'FATAL' end
  else case level when 10 then '5000' when 20 then '10000' when 30 then '20000' when 40 then '30000' when 50 then '40000' else '50000' end
  end as lib_level from {logs}"""


@query("logback_level", f"""{duck_with(['logs'], ll=(LIB_LEVEL, ['logs']))}
select id, lib_level, case upper(trim(lib_level)) when 'TRACE' then 10 when '5000' then 10 when 'DEBUG' then 20
  when '10000' then 20 when 'INFO' then 30 when '20000' then 30 when 'WARN' then 40 when '30000' then 40
  when 'ERROR' then 50 when '40000' then 50 else 60 end as level6 from ll""")
def q_logback_level(spark, sf_dir):
    df = spark_input(spark, sf_dir, LIB_LEVEL, ["logs"])
    return df.select("id", "lib_level", lv.logback_level("lib_level").alias("level6"))


# ---------------------------------------------------------------------------
# instants

@query("millis", f"""{duck_with(['logs'])}
select id, epoch_ms(timestamp) as ms, epoch_ms(epoch_ms(timestamp)) as back from logs""")
def q_millis(spark, sf_dir):
    df = logs(spark, sf_dir).select("id", tf.ts_to_millis("timestamp").alias("ms"))
    return df.select("id", "ms", tf.millis_to_ts("ms").alias("back"))


@query("iso_instant", f"""{duck_with(['logs'])}
select id, {iso_sql('timestamp')} as iso, timestamp as parsed, {iso_sql('added')} as iso_added from logs""")
def q_iso_instant(spark, sf_dir):
    df = logs(spark, sf_dir).select("id", tf.iso_instant_format("timestamp").alias("iso"),
                                    tf.iso_instant_format("added").alias("iso_added"))
    return df.select("id", "iso", tf.iso_instant_parse("iso").alias("parsed"), "iso_added")


@query("display_time", f"""{duck_with(['logs'])}
select id, {display_sql('timestamp')} as shown, length({display_sql('timestamp')}) > 10 as long_enough,
  contains({display_sql('timestamp')}, ' ') as has_space from logs""")
def q_display_time(spark, sf_dir):
    d = tf.display_time("timestamp")
    return logs(spark, sf_dir).select("id", d.alias("shown"), (F.length(d) > 10).alias("long_enough"),
                                      d.contains(" ").alias("has_space"))


@query("helsinki_minute", f"""{duck_with(['logs'])}
select id, strftime(timezone('Europe/Helsinki', timezone('UTC', timestamp)), '%Y-%m-%d %H:%M') as local_minute from logs""")
def q_helsinki_minute(spark, sf_dir):
    return logs(spark, sf_dir).select("id", tf.helsinki_minute("timestamp").alias("local_minute"))


BOUND_TEXT = """
select id, case id % 5 when 0 then concat(replace(cast(added as {V}), ' ', 'T'), 'Z')
  when 1 then substr(cast(added as {V}), 1, 10)
  when 2 then concat(replace(substr(cast(added as {V}), 1, 19), ' ', 'T'), '+02:00')
  when 3 then concat('garbage', cast(id as {V})) end as text from {logs}"""


@query("parse_bound", f"""{duck_with(['logs'], bt=(BOUND_TEXT, ['logs']))}
select id, text, case id % 5 when 0 then cast(rtrim(text, 'Z') as timestamp)
  when 1 then timezone('UTC', timezone('Europe/Helsinki', cast(text as date)::timestamp))
  when 2 then timezone('UTC', cast(text as timestamptz)) end as value,
  case when id % 5 = 3 then concat('Invalid instant: ''', text, '''.') end as error from bt""")
def q_parse_bound(spark, sf_dir):
    df = spark_input(spark, sf_dir, BOUND_TEXT, ["logs"])
    b = tf.parse_bound("text")
    return df.select("id", "text", b["value"].alias("value"), b["error"].alias("error"))


RANGE_IN = """
select id, case when id % 2 = 0 then added end as f,
  case when id % 3 = 0 then added + interval 1 day end as t, {L} '2024-02-01 00:00:00' as now from {logs}"""


@query("default_range", f"""{duck_with(['logs'], ri=(RANGE_IN, ['logs']))}
select id, coalesce(f, now - interval 48 hours) as from_ts, t as to_ts from ri""")
def q_default_range(spark, sf_dir):
    df = spark_input(spark, sf_dir, RANGE_IN, ["logs"])
    r = tf.default_range("f", "t", "now")
    return df.select("id", r["from"].alias("from_ts"), r["to"].alias("to_ts"))


@query("range_text", f"""{duck_with(['logs'], ri=(RANGE_IN, ['logs']))}
select id, case when f is not null and t is not null then concat('[', {iso_sql('f')}, ' - ', {iso_sql('t')}, ']')
  when t is not null then concat('(- ', {iso_sql('t')}, ']') when f is not null then concat('[', {iso_sql('f')}, ' -)')
  else '' end as text from ri""")
def q_range_text(spark, sf_dir):
    df = spark_input(spark, sf_dir, RANGE_IN, ["logs"])
    return df.select("id", tf.range_text("f", "t").alias("text"))


def _label_values_sql() -> str:
    rows = []
    for lang_code, key, text in lab.label_rows():
        t = text.replace("'", "''")
        rows.append(f"('{lang_code}', '{key}', '{t}')")
    return "labels as (select * from (values " + ", ".join(rows) + ") t(language, key, text))"


def _label_sql(lang_expr: str, key: str) -> str:
    return f"(select text from labels where labels.language = {lang_expr} and labels.key = '{key}')"


PHRASE_IN = """
select id, case id % 3 when 0 then 'en-US' when 1 then 'sv-SE' else 'fi-FI' end as language,
  case when id % 2 = 0 then added end as f, case when id % 3 = 0 then added + interval 1 day end as t from {logs}"""


def _hm(expr: str) -> str:
    return f"strftime(timezone('Europe/Helsinki', timezone('UTC', {expr})), '%Y-%m-%d %H:%M')"


@query("range_phrase", f"""{duck_with(['logs'], pi=(PHRASE_IN, ['logs']))}, {_label_values_sql()}
select id, language, case
  when f is not null and t is not null then concat(' ', {_label_sql('pi.language', 'queryTime')}, ' ', {_label_sql('pi.language', 'between')}, ' ', {_hm('f')}, ' - ', {_hm('t')})
  when t is not null then concat(' ', {_label_sql('pi.language', 'queryTime')}, ' ', {_label_sql('pi.language', 'until')}, ' ', {_hm('t')})
  when f is not null then concat(' ', {_label_sql('pi.language', 'queryTime')}, ' ', {_label_sql('pi.language', 'starting')}, ' ', {_hm('f')})
  else '' end as phrase from pi""")
def q_range_phrase(spark, sf_dir):
    df = spark_input(spark, sf_dir, PHRASE_IN, ["logs"])
    df = lab.localized_labels(df, lab.labels_table(spark), "language")
    words = {k: F.col(f"label_{k}") for k in ("queryTime", "between", "until", "starting")}
    return df.select("id", "language", qf.range_phrase("f", "t", words).alias("phrase"))


SUMMARY_IN = """
select id, case id % 3 when 0 then {LB}app{RB} when 1 then {LB}app, 'app0'{RB} else {LB}{RB} end as apps,
  level, cast(id % 7 * 100 as int) as lim, cast(id % 5 * 500 as int) as off,
  case when id % 4 = 0 then message end as q from {logs}"""
SUMMARY_IN_DUCK = SUMMARY_IN.replace("{LB}{RB}", "cast([] as varchar[])")


@query("query_summary", f"""{duck_with(['logs'], si=(SUMMARY_IN_DUCK, ['logs']))}
select id, concat(case when q is not null then concat('query ''', q, ''' ') else '' end,
  case when len(apps) > 0 then concat('apps ', array_to_string(apps, ', '), ' ') else '' end,
  'level ', {level_name_sql('level')}, ' limit ', cast(lim as varchar), ' offset ', cast(off as varchar)) as summary
from si""")
def q_query_summary(spark, sf_dir):
    df = spark_input(spark, sf_dir, SUMMARY_IN.replace("{LB}{RB}", "cast(array() as array<string>)"), ["logs"])
    words = {k: F.lit(lab.LABELS[lab.DEFAULT_LANGUAGE][k]) for k in ("apps", "query", "queryLevel", "limit", "offset")}
    return df.select("id", qf.query_summary("apps", "level", "lim", "off", "q", words).alias("summary"))


ENCODE_IN = """
select id, case id % 3 when 0 then {LB}app{RB} when 1 then {LB}app, 'app0'{RB} else {LB}{RB} end as apps,
  level, case when id % 2 = 0 then added end as f, case when id % 5 = 0 then added + interval 1 day end as t,
  cast(id % 7 * 100 as int) as lim, cast(id % 5 * 500 as int) as off,
  case when id % 2 = 0 then 'asc' else 'desc' end as ord, case when id % 4 = 0 then message end as q from {logs}"""
ENCODE_IN_DUCK = ENCODE_IN.replace("{LB}{RB}", "cast([] as varchar[])")


@query("encode_query", f"""{duck_with(['logs'], ei=(ENCODE_IN_DUCK, ['logs']))}
select id, k as key, unnest(v) as value from (
  select id, unnest([
    {{'k': 'q', 'v': case when q is null then cast([] as varchar[]) else [q] end}},
    {{'k': 'app', 'v': apps}},
    {{'k': 'level', 'v': [{level_name_sql('level')}]}},
    {{'k': 'from', 'v': case when f is null then cast([] as varchar[]) else [{iso_sql('f')}] end}},
    {{'k': 'to', 'v': case when t is null then cast([] as varchar[]) else [{iso_sql('t')}] end}},
    {{'k': 'limit', 'v': [cast(lim as varchar)]}},
    {{'k': 'offset', 'v': [cast(off as varchar)]}},
    {{'k': 'order', 'v': [ord]}}], recursive := true) from ei) t""")
def q_encode_query(spark, sf_dir):
    df = spark_input(spark, sf_dir, ENCODE_IN.replace("{LB}{RB}", "cast(array() as array<string>)"), ["logs"])
    m = qf.encode_query("apps", "level", "f", "t", "lim", "off", "ord", "q")
    return (df.select("id", F.explode(m).alias("key", "values"))
              .select("id", "key", F.explode("values").alias("value")))


@query("toggle_param", f"""{duck_with(['logs'], ei=(ENCODE_IN_DUCK, ['logs']))}
select id, key, value from (
  select id, 'app' as key, unnest(apps) as value from ei where len(apps) > 0
  union all select id, 'level', {level_name_sql('level')} from ei
  union all select id, 'q', 'k' || cast(id as varchar) from ei where id % 3 <> 0) t""")
def q_toggle_param(spark, sf_dir):
    df = spark_input(spark, sf_dir, ENCODE_IN.replace("{LB}{RB}", "cast(array() as array<string>)"), ["logs"])
    base = F.create_map(F.lit("app"), F.col("apps"), F.lit("level"), F.array(lv.level_name("level")))
    base = F.map_filter(base, lambda k, v: F.size(v) > 0)
    newq = F.when(F.col("id") % 3 != 0, F.concat(F.lit("k"), F.col("id").cast("string")))
    m = qf.toggle_param(qf.toggle_param(base, "q", F.lit("stale")), "q", newq)
    return (df.select("id", F.explode(m).alias("key", "values"))
              .select("id", "key", F.explode("values").alias("value")))


@query("toggle_apps", f"""{duck_with(['logs'], ei=(ENCODE_IN_DUCK, ['logs']))}
select id, array_to_string(list_sort(list_distinct(list_concat(apps, ['app5']))), ',') as with_app,
  array_to_string(list_sort(list_filter(apps, lambda a: a <> 'app0')), ',') as without_app0 from ei""")
def q_toggle_apps(spark, sf_dir):
    df = spark_input(spark, sf_dir, ENCODE_IN.replace("{LB}{RB}", "cast(array() as array<string>)"), ["logs"])
    return df.select("id", F.array_join(qf.toggle_apps("apps", F.lit("app5"), True), ",").alias("with_app"),
                     F.array_join(qf.toggle_apps("apps", F.lit("app0"), False), ",").alias("without_app0"))


HOSTS = r"""
select page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host from {pages}"""


def _top_domain_sql(expr: str) -> str:
    p = f"string_split(regexp_replace({expr}, '\\.+$', ''), '.')"
    return (f"regexp_extract(array_to_string(case when len({p}) >= 2 then {p}[-2:] else {p} end, '.'), "
            f"'^[^:/]*', 0)")


@query("top_domain", f"""{duck_with([], h=(HOSTS, ['pages']))}
select page_id, host, {_top_domain_sql('host')} as domain, {_top_domain_sql('url')} as url_domain from h""")
def q_top_domain(spark, sf_dir):
    df = spark_input(spark, sf_dir, HOSTS, ["pages"])
    return df.select("page_id", "host", tx.top_domain("host").alias("domain"), tx.top_domain("url").alias("url_domain"))


@query("source_label", f"""{duck_with(['logs'])}
select id, case when client is null then app else concat(app, ' (', client, ')') end as label from logs""")
def q_source_label(spark, sf_dir):
    return logs(spark, sf_dir).select("id", tx.source_label("app", "client").alias("label"))


def _localized_sql() -> str:
    keys = list(lab.LABELS[lab.DEFAULT_LANGUAGE])
    cols = ", ".join(f"{_label_sql('a.language', k)} as label_{k.replace('.', '_')}" for k in keys)
    return f"""{duck_with(['admins'])}, {_label_values_sql()}
select a.email, a.language, {cols} from admins a"""


@query("localized_labels", _localized_sql())
def q_localized_labels(spark, sf_dir):
    from logloom.sources import store
    admins = store.fixture_table(spark, sf_dir, "admins").select("email", "language")
    return lab.localized_labels(admins, lab.labels_table(spark), "language")


# ---------------------------------------------------------------------------
# row views

def _event_cols_sql(p: str = "") -> str:
    return (f"{p}id as id, {p}app as source_name, {p}address as source_address, {p}client as source_client_id, "
            f"{p}user_agent as source_user_agent, {iso_sql(p + 'timestamp')} as iso_timestamp, "
            f"epoch_ms({p}timestamp) as timestamp_ms, {display_sql(p + 'timestamp')} as time_formatted, "
            f"{p}message as message, {p}logger as logger_name, {p}thread as thread_name, "
            f"{level_name_sql(p + 'level')} as level, {p}stacktrace as stack_trace, "
            f"epoch_ms({p}added) as added_ms, {display_sql(p + 'added')} as added_formatted")


@query("to_event", f"""{duck_with(['logs'])}
select {_event_cols_sql()} from logs""")
def q_to_event(spark, sf_dir):
    return vw.flat_event(logs(spark, sf_dir))


@query("to_wire", f"""{duck_with(['logs'])}
select id, cast(to_json(struct_pack(id := id,
  source := struct_pack(name := app, remoteAddress := address, clientId := client, userAgent := user_agent),
  event := struct_pack(isoTimestamp := {iso_sql('timestamp')}, timestamp := epoch_ms(timestamp),
    timeFormatted := {display_sql('timestamp')}, message := message, loggerName := logger, threadName := thread,
    level := {level_name_sql('level')}, stackTrace := stacktrace),
  added := epoch_ms(added), addedFormatted := {display_sql('added')})) as varchar) as json from logs""")
def q_to_wire(spark, sf_dir):
    return vw.to_wire(logs(spark, sf_dir))


@query("view_columns", f"""{duck_with(['logs'])}
select id, app, coalesce({display_sql('timestamp')}, '-') as time, message, logger, thread, client, user_agent,
  {level_name_sql('level')} as level,
  case level when 50 then 'danger' when 40 then 'warning' else 'info' end as row_class from logs""")
def q_view_columns(spark, sf_dir):
    return vw.view_columns(logs(spark, sf_dir), verbose=True)


@query("detail_rows", f"""{duck_with(['logs'])}
select id, 'main' as kind, message as text from logs
union all select id, 'detail', stacktrace from logs where stacktrace is not null""")
def q_detail_rows(spark, sf_dir):
    return vw.detail_rows(logs(spark, sf_dir))


@query("severity_class", f"""{duck_with(['logs'])}
select id, level, case level when 50 then 'danger' when 40 then 'warning' else 'info' end as row_class from logs""")
def q_severity_class(spark, sf_dir):
    return logs(spark, sf_dir).select("id", "level", vw.severity_class("level").alias("row_class"))


DOMAIN_IN = """
select id, case when id % 41 = 0 then ' ' else app end as app, case when id % 43 = 0 then '' else client end as client,
  case when id % 47 = 0 then '   ' else user_agent end as user_agent,
  case when id % 59 = 0 then -id else id end as id2,
  case when id % 53 = 0 then 70 else level end as level,
  cast(case when id % 61 = 0 then -1 else 500 end as int) as lim, cast(case when id % 67 = 0 then -5 else 0 end as int) as off,
  case when id % 71 = 0 then 'sideways' else 'desc' end as ord,
  case id % 4 when 0 then 'en-US' when 1 then 'sv-SE' when 2 then 'fi-FI' else 'de-DE' end as language from {logs}"""


@query("validate_domains", f"""{duck_with(['logs'], di=(DOMAIN_IN, ['logs']))}
select id, nullif(array_to_string(list_filter([
  case when app is null or trim(app) = '' then 'App name must not be blank.' end,
  case when client is not null and trim(client) = '' then 'Client ID must not be blank.' end,
  case when user_agent is not null and trim(user_agent) = '' then 'User agent must not be blank.' end,
  case when id2 < 0 then 'Log entry ID must be non-negative.' end,
  case when level not in (10, 20, 30, 40, 50, 60) then concat('Invalid level: ''', cast(level as varchar), '''.') end,
  case when lim < 0 then 'lim must be non-negative.' end,
  case when off < 0 then 'off must be non-negative.' end,
  case when ord not in ('asc', 'desc') then concat('Invalid order: ''', ord, '''.') end,
  case when language not in ('en-US', 'sv-SE', 'fi-FI') then concat('Invalid language: ''', language, '''.') end
  ], lambda e: e is not null), ' '), '') as errors from di""")
def q_validate_domains(spark, sf_dir):
    df = spark_input(spark, sf_dir, DOMAIN_IN, ["logs"])
    out = vw.validate_domains(df.withColumnRenamed("id", "row_id").withColumnRenamed("id2", "id"))
    return out.select(F.col("row_id").alias("id"), "errors")


ORIGINS_IN = r"""
select page_id, concat(case when page_id % 3 = 0 then 'http' else 'https' end, '://',
  regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as origin from {pages}"""
ORIGIN_DOMAINS = r"""
select distinct regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as domain from {pages} where page_id % 4 = 0"""


@query("allowed_origins", f"""{duck_with([], o=(ORIGINS_IN, ['pages']), d=(ORIGIN_DOMAINS, ['pages']))}
select page_id, origin, exists(select 1 from d where concat('https://', d.domain) = o.origin) as allowed from o""")
def q_allowed_origins(spark, sf_dir):
    origins = spark_input(spark, sf_dir, ORIGINS_IN, ["pages"])
    domains = spark_input(spark, sf_dir, ORIGIN_DOMAINS, ["pages"])
    return rq.allowed_origins(origins, domains, prod=True).select("page_id", "origin", "allowed")


REQUESTS_IN = r"""
select page_id,
  case when page_id % 3 = 0 then concat('192.168.', cast(page_id % 256 as {V}), '.1, 10.0.0.1') end as x_forwarded_for,
  case when page_id % 5 <> 0 then concat('10.1.0.', cast(page_id % 256 as {V})) end as remote_addr,
  case when page_id % 4 = 0 then regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) end as x_forwarded_host,
  case when page_id % 4 = 1 then concat(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), ':8443') end as uri_host,
  case when page_id % 4 in (1, 2) then concat('h', cast(page_id % 10 as {V}), '.example.org') end as host,
  url like 'https:%' as is_secure,
  case page_id % 6 when 0 then 'https' when 1 then 'http' end as x_forwarded_proto,
  case page_id % 5 when 0 then '  ' when 1 then concat(' c', cast(page_id as {V}), ' ') end as x_client_id,
  case page_id % 4 when 0 then null when 1 then '   '
    else concat(' Mozilla/5.0 ', repeat('x', cast(page_id % 150 as int)), ' ') end as user_agent_header
from {pages}"""


@query("request_attributes", f"""{duck_with([], r=(REQUESTS_IN, ['pages']))}
select page_id, coalesce(x_forwarded_for, remote_addr, 'unknown') as address,
  coalesce(x_forwarded_host, uri_host, host, 'localhost') as host_port,
  coalesce(is_secure, false) or coalesce(x_forwarded_proto = 'https', false) as secure,
  case when trim(x_client_id) <> '' then trim(x_client_id) end as client_id,
  case when trim(user_agent_header) <> '' then substr(trim(user_agent_header), 1, 100) end as user_agent,
  {_top_domain_sql("coalesce(x_forwarded_host, uri_host, host, 'localhost')")} as top_domain from r""")
def q_request_attributes(spark, sf_dir):
    df = spark_input(spark, sf_dir, REQUESTS_IN, ["pages"])
    return rq.request_attributes(df).select("page_id", "address", "host_port", "secure", "client_id",
                                            "user_agent", "top_domain")


APP_NAMES = """
select id, concat(app, case id % 5 when 0 then 'ios' when 1 then '-android' when 2 then 'web'
  when 3 then '-server' else 'webx' end) as candidate from {logs}"""


@query("publishable_apps", f"""{duck_with(['logs'], an=(APP_NAMES, ['logs']))}
select id, candidate from an where regexp_matches(candidate, '(ios|android|web)$')""")
def q_publishable_apps(spark, sf_dir):
    df = spark_input(spark, sf_dir, APP_NAMES, ["logs"])
    return rq.publishable_apps(df, "candidate")


def _client_id_sql(key: str) -> str:
    alphabet, digest = rq.CLIENT_ID_ALPHABET, f"md5(concat(cast({key} as varchar), ':7'))"
    return " || ".join(f"substr('{alphabet}', cast(('0x' || substr({digest}, {4 * i + 1}, 4)) as int) % {len(alphabet)} + 1, 1)"
                       for i in range(rq.CLIENT_ID_LENGTH))


@query("assign_client_id", f"""{duck_with(['presence'])}
select conn_id, app, {_client_id_sql('conn_id')} as client_id from presence where action = 'joined'""")
def q_assign_client_id(spark, sf_dir):
    """A 7-char [a-z0-9] id for every source connection (the ``joined`` events
    of ``presence``)."""
    from logloom.sources import store
    joins = store.fixture_table(spark, sf_dir, "presence").where(F.col("action") == "joined")
    return rq.assign_client_id(joins.select("conn_id", "app"), "conn_id", seed=7)


@query("recent", f"""{duck_with(['logs'])}
select id, added - interval 5 minutes as from_ts, cast(null as timestamp) as to_ts from logs""")
def q_recent(spark, sf_dir):
    """The five minutes before each row's ingest time, open at the end."""
    r = tf.recent_range("added")
    return logs(spark, sf_dir).select("id", r["from"].alias("from_ts"), r["to"].alias("to_ts"))


# Viewer frames by id: which of them decode, and as what, follows from how each is made.
EVENT_HEAD = """'{{"id":', cast(id as {V}), ',"source":{{"name":"', app, '","remoteAddress":"', address, '"}},"event":{{'"""
EVENT_TAIL = """',"message":"', message, '","loggerName":"', logger, '","threadName":"', thread, '"}},"added":1,"addedFormatted":"x"}}'"""
EVENT = EVENT_HEAD + """, '"isoTimestamp":null,"timestamp":1704067200000,"level":"Info"', """ + EVENT_TAIL
LEGACY = EVENT_HEAD + """, '"timeStamp":1704067200000,"timeFormatted":"x","level":"fatal"', """ + EVENT_TAIL
BAD_LEVEL = EVENT_HEAD + """, '"timestamp":1704067200000,"level":"fatal"', """ + EVENT_TAIL
BAD_TIME = EVENT_HEAD + """, '"timestamp":1.5,"level":"info"', """ + EVENT_TAIL
META = """'"meta":{{"apps":["', app, '"],"level":"info","timeRange":{{"from":"x","to":null}},"limits":{{"limit":500,"offset":0}},"query":null}}'"""
FRAMES_IN = f"""
select id, case id % 14
  when 0 then '{{{{"event":"ping"}}}}'
  when 1 then concat('{{{{"event":"loading",', {META}, '}}}}')
  when 2 then concat('{{{{"events":[', {EVENT}, '],"event":"events"}}}}')
  when 3 then concat('{{{{"event":"', app, '"}}}}')
  when 4 then concat('{{{{"events":[', {EVENT}, ',', {LEGACY}, '],"event":"events"}}}}')
  when 5 then '{{{{"event":"loading","meta":5}}}}'
  when 6 then '{{{{"event":"events","events":[1,2]}}}}'
  when 7 then concat('{{{{"events":[', {EVENT}, ',', {BAD_LEVEL}, '],"event":"events"}}}}')
  when 8 then concat('{{{{"events":[', {BAD_TIME}, '],"event":"events"}}}}')
  when 9 then concat('{{{{"event":"noData","meta":{{{{"apps":["', app, '"],"level":"info"}}}}}}}}')
  when 10 then '{{{{"event":"events","events":[]}}}}'
  when 11 then concat('{{{{"events":[', {EVENT}, ']}}}}')
  when 12 then concat('{{{{"event":', cast(id as {{V}}), '}}}}')
  else concat('not json ', message) end as json from {{logs}}"""


@query("decode_frames", f"""{duck_with(['logs'], fr=(FRAMES_IN, ['logs']))},
app_of as (select id, app from logs)
select fr.id, json, case when fr.id % 14 in (2, 4, 10) then 'events' when fr.id % 14 = 1 then 'meta' else 'simple' end as kind,
  cast(case fr.id % 14 when 2 then 1 when 4 then 2 when 10 then 0 end as int) as n_items,
  case when fr.id % 14 in (1, 5) then 'loading' when fr.id % 14 = 9 then 'noData' when fr.id % 14 = 3 then app else 'events' end as frame_event
from fr join app_of on fr.id = app_of.id where fr.id % 14 not in (0, 11, 12, 13)""")
def q_decode_frames(spark, sf_dir):
    df = spark_input(spark, sf_dir, FRAMES_IN, ["logs"])
    return vw.decode_frames(df).select("id", "json", "kind", "n_items", "frame_event")


PARSE_IN = r"""
select id, concat('/logs?app=', app, case when id % 3 = 0 then '&app=app0' else '' end,
  case id % 7 when 0 then '&level=WARN' when 1 then '&level=bogus' when 2 then '&level=error' else '' end,
  case id % 4 when 0 then concat('&from=', substr(cast(added as {V}), 1, 10))
              when 1 then concat('&from=', replace(cast(added as {V}), ' ', 'T'), 'Z')
              when 2 then '&from=yesterday' else '' end,
  case when id % 6 = 0 then concat('&to=', replace(substr(cast(added as {V}), 1, 19), ' ', 'T'), '%2B02:00') else '' end,
  case id % 5 when 0 then '&limit=20' when 1 then '&limit=-3' when 2 then '&limit=abc' else '' end,
  case when id % 9 = 0 then '&offset=500' else '' end,
  case id % 8 when 0 then '&order=asc' when 1 then '&order=up' else '' end,
  case id % 10 when 0 then concat('&q=', replace(message, ' ', '+')) when 1 then '&q=ab' when 2 then '&q=why?now&x=?' else '' end) as url,
  {L} '2024-02-01 00:00:00' as now from {logs}"""


def _parse_sql() -> str:
    return f"""{duck_with(['logs'], pin=(PARSE_IN, ['logs']))},
kv as (select id, url, now, list_transform(list_filter(string_split(substr(url, strpos(url, '?') + 1), '&'), lambda p: p <> ''),
         lambda p: {{'k': url_decode(split_part(p, '=', 1)),
                     'v': url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', '%20'))}}) as kv from pin),
f as (select id, now, list_transform(list_filter(kv, lambda x: x.k = 'app'), lambda x: trim(x.v)) as apps,
        coalesce(list_filter(kv, lambda x: x.k = 'level')[1].v, 'info') as level_txt,
        list_filter(kv, lambda x: x.k = 'from')[1].v as from_txt,
        list_filter(kv, lambda x: x.k = 'to')[1].v as to_txt,
        list_filter(kv, lambda x: x.k = 'limit')[1].v as lim_txt,
        list_filter(kv, lambda x: x.k = 'offset')[1].v as off_txt,
        coalesce(list_filter(kv, lambda x: x.k = 'order')[1].v, 'desc') as ord,
        list_filter(kv, lambda x: x.k = 'q')[1].v as q from kv),
g as (select *, case lower(level_txt) when 'trace' then 10 when 'debug' then 20 when 'info' then 30
          when 'warn' then 40 when 'error' then 50 when 'other' then 60 end as lvl,
        case when from_txt is null then null
          when regexp_matches(from_txt, '^\\d{{4}}-\\d\\d-\\d\\d$') then timezone('UTC', timezone('Europe/Helsinki', cast(from_txt as date)::timestamp))
          when regexp_matches(from_txt, 'Z$') then try_cast(rtrim(from_txt, 'Z') as timestamp)
          else timezone('UTC', try_cast(from_txt as timestamptz)) end as from_v,
        case when to_txt is null then null
          else timezone('UTC', try_cast(to_txt as timestamptz)) end as to_v,
        coalesce(try_cast(lim_txt as int), case when lim_txt is null then 500 end) as lim,
        coalesce(try_cast(off_txt as int), case when off_txt is null then 0 end) as off from f),
e as (select *, list_filter([
          case when list_contains(apps, '') then 'App name must not be blank.' end,
          case when lvl is null then concat('Unknown level: ''', level_txt, '''.') end,
          case when from_txt is not null and from_v is null then concat('Invalid instant: ''', from_txt, '''.') end,
          case when to_txt is not null and to_v is null then concat('Invalid instant: ''', to_txt, '''.') end,
          case when lim is null or lim < 0 then concat('Invalid limit: ''', lim_txt, '''.') end,
          case when off is null or off < 0 then concat('Invalid offset: ''', off_txt, '''.') end,
          case when ord not in ('asc', 'desc') then concat('Invalid order: ''', ord, '''.') end], lambda x: x is not null) as errs from g)
select id, case when len(errs) = 0 then array_to_string(apps, ',') end as apps,
  case when len(errs) = 0 then lvl end as min_level,
  case when len(errs) = 0 then coalesce(from_v, now - interval 48 hours) end as from_ts,
  case when len(errs) = 0 then to_v end as to_ts,
  case when len(errs) = 0 then lim end as lim, case when len(errs) = 0 then off end as off,
  case when len(errs) = 0 then ord end as ord, case when len(errs) = 0 and length(q) >= 3 then q end as q,
  case when len(errs) > 0 then array_to_string(errs, ' ') end as error from e"""


@query("parse_query", _parse_sql())
def q_parse_query(spark, sf_dir):
    df = spark_input(spark, sf_dir, PARSE_IN, ["logs"])
    out = qf.parse_query(df.select("id", "url", "now"), "url", "now")
    return out.select("id", F.array_join("apps", ",").alias("apps"), "min_level", "from_ts", "to_ts",
                      "lim", "off", "ord", "q", "error")


NORES_IN = """
select id, case id % 3 when 0 then 'en-US' when 1 then 'sv-SE' else 'fi-FI' end as language,
  case id % 3 when 0 then {LB}app{RB} when 1 then {LB}app, 'app0'{RB} else {LB}{RB} end as apps,
  level, cast(id % 7 * 100 as int) as lim, cast(id % 5 * 500 as int) as off,
  case when id % 4 = 0 then message end as q, case when id % 2 = 0 then added end as f,
  case when id % 3 = 0 then added + interval 1 day end as t,
  case when id % 2 = 0 then 'asc' else 'desc' end as ord from {logs}"""


def _summary_sql(lang: str) -> str:
    def lab_(k):
        return _label_sql(lang, k)
    return (f"concat(case when q is not null then concat({lab_('query')}, ' ''', q, ''' ') else '' end, "
            f"case when len(apps) > 0 then concat({lab_('apps')}, ' ', array_to_string(apps, ', '), ' ') else '' end, "
            f"{lab_('queryLevel')}, ' ', {level_name_sql('level')}, ' ', {lab_('limit')}, ' ', cast(lim as varchar), "
            f"' ', {lab_('offset')}, ' ', cast(off as varchar))")


def _phrase_sql(lang: str) -> str:
    def lab_(k):
        return _label_sql(lang, k)
    return (f"case when f is not null and t is not null then concat(' ', {lab_('queryTime')}, ' ', {lab_('between')}, "
            f"' ', {_hm('f')}, ' - ', {_hm('t')}) when t is not null then concat(' ', {lab_('queryTime')}, ' ', "
            f"{lab_('until')}, ' ', {_hm('t')}) when f is not null then concat(' ', {lab_('queryTime')}, ' ', "
            f"{lab_('starting')}, ' ', {_hm('f')}) else '' end")


@query("no_results_message", f"""{duck_with(['logs'], ni=(NORES_IN.replace('{LB}{RB}', 'cast([] as varchar[])'), ['logs']))},
{_label_values_sql()}
select id, language,
  concat({_label_sql('ni.language', 'noResults')}, ' ', {_summary_sql('ni.language')}, {_phrase_sql('ni.language')}, '.') as message,
  concat({_summary_sql("'en-US'")}, {_phrase_sql("'en-US'")}, ' order ', ord) as describe
from ni""")
def q_no_results_message(spark, sf_dir):
    """The viewer's ``noData`` text in its language, and the server's English
    description line of the same request."""
    df = spark_input(spark, sf_dir, NORES_IN.replace("{LB}{RB}", "cast(array() as array<string>)"), ["logs"])
    df = lab.localized_labels(df, lab.labels_table(spark), "language")
    words = {k: F.col(f"label_{k}") for k in lab.LABELS[lab.DEFAULT_LANGUAGE] if "." not in k}
    english = {k: F.lit(v) for k, v in lab.LABELS[lab.DEFAULT_LANGUAGE].items() if "." not in k}
    return df.select(
        "id", "language",
        qf.no_results_message("apps", "level", "lim", "off", "q", "f", "t", words).alias("message"),
        qf.query_describe("apps", "level", "lim", "off", "q", "f", "t", "ord", english).alias("describe"),
    )


@query("view_columns_compact", f"""{duck_with(['logs'])}
select id, app, coalesce({display_sql('timestamp')}, '-') as time, message, {level_name_sql('level')} as level,
  case level when 50 then 'danger' when 40 then 'warning' else 'info' end as row_class from logs""")
def q_view_columns_compact(spark, sf_dir):
    return vw.view_columns(logs(spark, sf_dir), verbose=False)


@query("mobile_rows", f"""{duck_with(['logs'])}
select id, app, coalesce({display_sql('timestamp')}, '-') as time, message, stacktrace as stack,
  {level_name_sql('level')} as level, logger, thread from logs""")
def q_mobile_rows(spark, sf_dir):
    return vw.mobile_rows(logs(spark, sf_dir))


@query("level_name", f"""{duck_with(['logs'])}
select id, level, {level_name_sql('level')} as level_name from logs""")
def q_level_name(spark, sf_dir):
    return logs(spark, sf_dir).select("id", "level", lv.level_name("level").alias("level_name"))


@query("level_int", f"""{duck_with(['logs'], lt=(LEVEL_TEXT, ['logs']))}
select id, level_text, case lower(level_text) when 'trace' then 10 when 'debug' then 20 when 'info' then 30
    when 'warn' then 40 when 'error' then 50 when 'other' then 60 end as level_int from lt""")
def q_level_int(spark, sf_dir):
    df = spark_input(spark, sf_dir, LEVEL_TEXT, ["logs"])
    return df.select("id", "level_text", lv.level_int("level_text").alias("level_int"))


@query("ts_to_millis", f"""{duck_with(['logs'])}
select id, timestamp, epoch_ms(timestamp) as ms from logs""")
def q_ts_to_millis(spark, sf_dir):
    return logs(spark, sf_dir).select("id", "timestamp", tf.ts_to_millis("timestamp").alias("ms"))


MILLIS_IN = """
select id, cast(id * 86400013 + 1700000000000 as bigint) as ms from {logs}"""


@query("millis_to_ts", f"""{duck_with(['logs'], mi=(MILLIS_IN, ['logs']))}
select id, ms, epoch_ms(ms) as ts from mi""")
def q_millis_to_ts(spark, sf_dir):
    df = spark_input(spark, sf_dir, MILLIS_IN, ["logs"])
    return df.select("id", "ms", tf.millis_to_ts("ms").alias("ts"))
