"""Registered queries: registry upkeep, known/unknown apps."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import registry as reg
from logloom.plans.inputs import duck_with, spark_input
from logloom.plans.registry import query
from logloom.plans.search_plans import logs
from logloom.sources import store

NEW_APPS = """
select concat('app', cast(id % 11 as {V})) as app, concat('pw', cast(id % 13 as {V})) as password, id as seq from {logs}"""


def apps(spark, sf_dir):
    return store.fixture_table(spark, sf_dir, "apps")


ADD_SQL = f"""{duck_with(['apps'], n=(NEW_APPS, ['logs']))},
first as (select app, arg_min(password, seq) as password, min(seq) as seq from n group by app),
added as (select f.app, md5(concat(f.app, ':', f.password)) as pass_hash, f.seq from first f
          where f.app not in (select app from apps)),
after_add as (select app, pass_hash from apps union all select app, pass_hash from added)"""


@query("registry_add", f"""{ADD_SQL}
select 'table' as kind, app, pass_hash, cast(null as bigint) as seq, cast(null as varchar) as status from after_add
union all
select 'request', n.app, null, n.seq, case when n.seq in (select seq from added) then 'Added' else 'AlreadyExists' end from n""")
def q_registry_add(spark, sf_dir):
    new = spark_input(spark, sf_dir, NEW_APPS, ["logs"])
    return reg.registry_add(apps(spark, sf_dir), new)


UPDATES = """
select concat('app', cast(id % 9 as {V})) as app, concat('new', cast(id as {V})) as password, id as seq from {logs}"""


@query("registry_update", f"""{duck_with(['apps'], u=(UPDATES, ['logs']))},
last as (select app, arg_max(password, seq) as password from u group by app)
select 'table' as kind, a.app, coalesce(md5(concat(a.app, ':', l.password)), a.pass_hash) as pass_hash,
  cast(null as bigint) as seq, cast(null as varchar) as status from apps a left join last l on a.app = l.app
union all
select 'request', u.app, null, u.seq, case when u.app in (select app from apps) then 'Updated' else 'DoesNotExist' end from u""")
def q_registry_update(spark, sf_dir):
    upd = spark_input(spark, sf_dir, UPDATES, ["logs"])
    return reg.registry_update(apps(spark, sf_dir), upd)


REMOVALS = """
select concat('app', cast(id % 12 as {V})) as app, id as seq from {logs}"""


@query("registry_remove", f"""{ADD_SQL}, r as ({REMOVALS.format(V='varchar', logs='logs')}),
chk as (select r.app, r.seq, r.app in (select app from after_add) as known,
          r.app in (select app from logs) as has_logs from r),
st as (select app, seq, case when not known then 'DoesNotExist' when has_logs then 'HasLogs' else 'Removed' end as status from chk)
select 'table' as kind, app, pass_hash, cast(null as bigint) as seq, cast(null as varchar) as status from after_add
  where app not in (select app from st where status = 'Removed')
union all select 'request', app, null, seq, status from st""")
def q_registry_remove(spark, sf_dir):
    """Adds the new apps first (as in ``registry_add``), then removes by name:
    the new apps have no logs and go; the others are blocked or unknown."""
    new = spark_input(spark, sf_dir, NEW_APPS, ["logs"])
    added = reg.registry_add(apps(spark, sf_dir), new).where(F.col("kind") == "table").select("app", "pass_hash")
    names = spark_input(spark, sf_dir, REMOVALS, ["logs"])
    return reg.registry_remove(added, names, logs(spark, sf_dir))


# Apps 0 to 6 have logs, 7 to 16 have none; app5 is not registered.
REQUESTS = """
select id as seq, case (id * 7) % 10 when 0 then 'add' when 1 then 'add' when 2 then 'update' when 3 then 'update' when 4 then 'remove'
  when 5 then 'remove' when 6 then 'add' when 7 then 'update' when 8 then 'remove' else 'check' end as op,
  concat('app', cast(case when id % 3 = 0 then 9 else (id * 13) % 17 end as {V})) as app, concat('pw', cast(id as {V})) as password from {logs}"""


@query("registry_apply", f"""{duck_with(['apps'], q=(REQUESTS, ['logs']))},
f as (select q.*, q.app in (select app from apps) as known, q.app in (select app from logs) as has_logs from q),
t as (select *, max(case when op = 'add' then seq * 2 + 1 when op = 'remove' and not has_logs then seq * 2 end)
        over (partition by app order by seq rows between unbounded preceding and 1 preceding) as turn from f),
p as (select *, case when turn is null then known else turn % 2 = 1 end as present from t),
st as (select seq, app, password, case
    when op = 'add' then case when present then 'AlreadyExists' else 'Added' end
    when op = 'update' then case when present then 'Updated' else 'DoesNotExist' end
    when op = 'remove' then case when not present then 'DoesNotExist' when has_logs then 'HasLogs' else 'Removed' end end as status from p),
last as (select app, arg_max(status, seq) as last, arg_max(password, seq) filter (status <> 'Removed') as password
         from st where status in ('Added', 'Updated', 'Removed') group by app)
select 'table' as kind, coalesce(a.app, l.app) as app,
  case when l.last is null then a.pass_hash else md5(concat(l.app, ':', l.password)) end as pass_hash,
  cast(null as bigint) as seq, cast(null as varchar) as status
from apps a full outer join last l on a.app = l.app where l.last is null or l.last <> 'Removed'
union all select 'request', app, null, seq, status from st""")
def q_registry_apply(spark, sf_dir):
    """Additions, updates, removals and unknown operations in one log; a third
    of them are for one app."""
    return reg.registry_apply(apps(spark, sf_dir), spark_input(spark, sf_dir, REQUESTS, ["logs"]), logs(spark, sf_dir))


RENAMES_SQL = "select * from (values ('app1', 'app1-renamed'), ('app3', 'three')) t(app, new_app)"


@query("registry_rename", f"""{duck_with(['logs'])}, rn as ({RENAMES_SQL})
select l.id, coalesce(rn.new_app, l.app) as app, l.level from logs l left join rn on l.app = rn.app""")
def q_registry_rename(spark, sf_dir):
    renames = spark.createDataFrame([("app1", "app1-renamed"), ("app3", "three")], "app string, new_app string")
    return reg.registry_rename(logs(spark, sf_dir).select("id", "app", "level"), renames)


@query("app_list", f"""{duck_with(['apps'])}
select app from apps""")
def q_app_list(spark, sf_dir):
    return reg.app_list(apps(spark, sf_dir))


@query("known_apps", f"""{duck_with(['logs', 'apps'])}
select id, app from logs where app in (select app from apps)""")
def q_known_apps(spark, sf_dir):
    return reg.known_apps(logs(spark, sf_dir).select("id", "app"), apps(spark, sf_dir))


@query("unknown_apps", f"""{duck_with(['logs', 'apps'])}
select id, app from logs where app not in (select app from apps)""")
def q_unknown_apps(spark, sf_dir):
    return reg.unknown_apps(logs(spark, sf_dir).select("id", "app"), apps(spark, sf_dir))


CREDS = """
select id as seq, case when id % 5 = 4 then 'app5' else app end as user,
  case id % 3 when 0 then concat('pw', app) when 1 then 'wrong' else concat('pw', app, 'x') end as password from {logs}"""


@query("credential_check", f"""{duck_with(['apps'], c=(CREDS, ['logs']))}
select seq, user, password,
  exists(select 1 from apps a where a.app = c.user and a.pass_hash = md5(concat(c.user, ':', c.password))) as valid from c""")
def q_credential_check(spark, sf_dir):
    reqs = spark_input(spark, sf_dir, CREDS, ["logs"])
    return reg.credential_check(reqs, apps(spark, sf_dir)).select("seq", "user", "password", "valid")


EMAILS = """
select concat('c', cast(c_custkey as {V}), '@example.com') as email from {customer}"""


@query("admin_lookup", f"""{duck_with(['admins'], e=(EMAILS, ['customer']))}
select e.email, a.language, a.created_at, case when a.email is null then 'NoSuchEmail' else 'Ok' end as status
from e left join admins a on a.email = e.email""")
def q_admin_lookup(spark, sf_dir):
    emails = spark_input(spark, sf_dir, EMAILS, ["customer"])
    return reg.admin_lookup(emails, store.fixture_table(spark, sf_dir, "admins"))


CHANGES = """
select concat('c', cast(c_custkey as {V}), '@example.com') as email,
  case c_custkey % 4 when 0 then 'en-US' when 1 then 'fi-FI' when 2 then 'sv-SE' else 'xx-XX' end as language,
  c_custkey as seq from {customer}"""


@query("admin_language", f"""{duck_with(['admins'], ch=(CHANGES, ['customer']))}
select ch.seq, ch.email, case when a.email is not null and ch.language <> 'xx-XX' then ch.language end as language,
  case when ch.language <> 'xx-XX' then a.created_at end as created_at,
  case when ch.language = 'xx-XX' then 'InvalidLanguage' when a.email is null then 'NoSuchEmail' else 'Ok' end as status
from ch left join admins a on a.email = ch.email""")
def q_admin_language(spark, sf_dir):
    changes = spark_input(spark, sf_dir, CHANGES, ["customer"])
    return reg.admin_language(store.fixture_table(spark, sf_dir, "admins"), changes)
