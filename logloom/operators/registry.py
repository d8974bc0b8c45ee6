"""Registry (dimension) upkeep: apps with password hashes, and admins.

Every operation is a set operation over request tables, so any number of
requests is applied in one job. Results come back as (kind, ...) rows:
``table`` rows are the registry after the change, ``request`` rows report
each request's outcome. Requests apply in ``seq`` order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.labels import LANGUAGES
from logloom.operators.joins import checked_join
from logloom.operators.ranking import range_last
from logloom.session import fresh_path

# Outcome names of the registry operations.
ALREADY_EXISTS, DOES_NOT_EXIST, NO_SUCH_EMAIL, HAS_LOGS = "AlreadyExists", "DoesNotExist", "NoSuchEmail", "HasLogs"
ADDED, UPDATED, REMOVED, OK = "Added", "Updated", "Removed", "Ok"
INVALID_LANGUAGE = "InvalidLanguage"


def pass_hash(app: Column | str, password: Column | str) -> Column:
    """md5 hex of ``app:password``."""
    app = F.col(app) if isinstance(app, str) else app
    password = F.col(password) if isinstance(password, str) else password
    return F.md5(F.concat(app, F.lit(":"), password))


def _table_rows(apps: DataFrame) -> DataFrame:
    return apps.select(F.lit("table").alias("kind"), "app", "pass_hash",
                       F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("status"))


def _request_rows(df: DataFrame, status: Column) -> DataFrame:
    return df.select(F.lit("request").alias("kind"), "app", F.lit(None).cast("string").alias("pass_hash"),
                     F.col("seq").cast("long").alias("seq"), status.alias("status"))


def registry_add(apps: DataFrame, new: DataFrame) -> DataFrame:
    """Insert apps not yet present (``new``: app, password, seq). The first
    request per app wins; every other request, and every request for an app
    already registered, reports ``AlreadyExists``."""
    first = new.groupBy("app").agg(F.min_by("password", "seq").alias("password"), F.min("seq").alias("first"))
    fresh = checked_join(first, apps.select("app"), ["app"], "left_anti", salt_key=["first"])
    added = fresh.select("app", pass_hash("app", "password").alias("pass_hash"), "first")
    table = apps.select("app", "pass_hash").unionByName(added.select("app", "pass_hash"))
    outcome = checked_join(new, added.select("app", "first"), ["app"], "left", salt_key=["seq"])
    status = F.when(F.col("first") == F.col("seq"), F.lit(ADDED)).otherwise(F.lit(ALREADY_EXISTS))
    return _table_rows(table).unionByName(_request_rows(outcome, status))


def registry_update(apps: DataFrame, upd: DataFrame) -> DataFrame:
    """Replace the hash of registered apps (last request per app wins);
    requests for unknown apps report ``DoesNotExist``."""
    last = upd.groupBy("app").agg(F.max_by("password", "seq").alias("password"))
    table = (apps.join(last, "app", "left")  # one row per app on both sides
                 .select("app", F.coalesce(pass_hash("app", "password"), F.col("pass_hash")).alias("pass_hash")))
    known = with_known_apps(upd, apps, salt_key=["seq"])
    status = F.when(F.col("known"), F.lit(UPDATED)).otherwise(F.lit(DOES_NOT_EXIST))
    return _table_rows(table).unionByName(_request_rows(known, status))


def registry_remove(apps: DataFrame, names: DataFrame, logs: DataFrame) -> DataFrame:
    """Delete apps (``names``: app, seq). Unknown apps report ``DoesNotExist``;
    apps that still have log rows cannot go (``HasLogs``).

    The status is worked out once per requested app and written to the shared
    folder, then joined to the requests and to the registry."""
    wanted = names.select("app").distinct()
    # Which requested apps still have logs: only the app column is scanned.
    with_logs = logs.select("app").distinct().select("app", F.lit(True).alias("__logs"))
    status = (F.when(F.col("__known").isNull(), F.lit(DOES_NOT_EXIST))
               .when(F.col("__logs"), F.lit(HAS_LOGS))
               .otherwise(F.lit(REMOVED)))
    per_app = (wanted.join(apps.select("app", F.lit(True).alias("__known")), "app", "left")
                     .join(with_logs, "app", "left").select("app", status.alias("status")))
    path = fresh_path(names.sparkSession, "removals")
    per_app.write.parquet(path)
    per_app = names.sparkSession.read.parquet(path)
    table = apps.join(per_app.where(F.col("status") == REMOVED), "app", "left_anti")
    outcome = checked_join(names, per_app, ["app"], "left", salt_key=["seq"])
    return _table_rows(table).unionByName(_request_rows(outcome, F.col("status")))


# The operations of a request log.
ADD, UPDATE, REMOVE = "add", "update", "remove"


def registry_apply(apps: DataFrame, requests: DataFrame, logs: DataFrame) -> DataFrame:
    """Additions, updates and removals in one log (``requests``: seq, op, app,
    password), each with the outcome it has after all earlier ones; then the
    registry as the log leaves it. Unknown operations and requests without an
    app have no outcome and change nothing.

    A request maps the state of its app, absent or present with a hash, to the
    next: an addition makes it present, a removal absent (unless the app has
    logs), an update changes the hash only. Whether an app is present before a
    request thus follows from the last addition or removal before it, a running
    maximum over range partitions, so that an app with a third of all requests
    is not gathered; its hash is that of the last request that took effect."""
    facts = requests.select("app").distinct().join(logs.select("app").distinct(), "app", "left_semi").withColumn(
        "has_logs", F.lit(True))
    asked = checked_join(requests.select("seq", "op", "app", "password"), facts, ["app"], "left", salt_key=["seq"])
    asked = with_known_apps(asked, apps, salt_key=["seq"]).withColumn("has_logs", F.coalesce("has_logs", F.lit(False)))
    adds, removes = F.col("op") == ADD, (F.col("op") == REMOVE) & ~F.col("has_logs")
    turn = F.when(adds | removes, F.struct(F.col("seq").alias("seq"), adds.alias("present")))
    run = range_last(asked, ["app"], ["seq"], turn, "turn")
    present = F.coalesce(F.col("turn.present"), F.col("known"))
    status = (F.when(F.col("app").isNull(), F.lit(None))
               .when(F.col("op") == ADD, F.when(present, ALREADY_EXISTS).otherwise(ADDED))
               .when(F.col("op") == UPDATE, F.when(present, UPDATED).otherwise(DOES_NOT_EXIST))
               .when(F.col("op") == REMOVE, F.when(~present, DOES_NOT_EXIST).when(F.col("has_logs"), HAS_LOGS).otherwise(REMOVED)))
    path = fresh_path(requests.sparkSession, "registry")
    run.select("seq", "app", "password", status.alias("status")).write.parquet(path)
    done = requests.sparkSession.read.parquet(path)
    set_ = F.col("status").isin(ADDED, UPDATED)
    last = done.where(F.col("status").isin(ADDED, UPDATED, REMOVED)).groupBy("app").agg(
        F.max_by("status", "seq").alias("last"), F.max_by("password", F.when(set_, F.col("seq"))).alias("password"))
    table = apps.select("app", "pass_hash").join(last, "app", "full_outer").where(F.coalesce(F.col("last") != REMOVED, F.lit(True))).select(
        "app", F.when(F.col("last").isNotNull(), pass_hash("app", "password")).otherwise(F.col("pass_hash")).alias("pass_hash"))
    return _table_rows(table).unionByName(_request_rows(done, F.col("status")))


def registry_rename(logs: DataFrame, renames: DataFrame) -> DataFrame:
    """Renaming an app cascades to its logs (``renames``: app, new_app)."""
    joined = checked_join(logs, renames.select("app", "new_app"), ["app"], "left")
    cols = [F.coalesce("new_app", "app").alias("app") if c == "app" else F.col(c) for c in logs.columns]
    return joined.select(*cols)


def app_list(apps: DataFrame) -> DataFrame:
    """All apps sorted by name."""
    return apps.select("app").orderBy("app")


def with_known_apps(df: DataFrame, apps: DataFrame, salt_key: tuple[str, ...] | list[str] = ("id",)) -> DataFrame:
    """``known``: whether the row's app is registered."""
    listed = apps.select("app").distinct().withColumn("known", F.lit(True))
    return checked_join(df, listed, ["app"], "left", salt_key=salt_key).withColumn(
        "known", F.coalesce("known", F.lit(False)))


def known_apps(df: DataFrame, apps: DataFrame) -> DataFrame:
    """Rows whose app is registered."""
    return checked_join(df, apps.select("app"), ["app"], "left_semi")


def unknown_apps(df: DataFrame, apps: DataFrame) -> DataFrame:
    """Rows whose app is not registered (the rejected complement)."""
    return checked_join(df, apps.select("app"), ["app"], "left_anti")


def credential_check(reqs: DataFrame, apps: DataFrame) -> DataFrame:
    """``valid`` when (user, md5(user:password)) is stored (``reqs``: user, password, seq, ...)."""
    stored = apps.select(F.col("app").alias("user"), F.col("pass_hash").alias("__stored"))
    joined = checked_join(reqs, stored, ["user"], "left", salt_key=["seq"])
    valid = F.coalesce(F.col("__stored") == pass_hash("user", "password"), F.lit(False))
    return joined.withColumn("valid", valid).drop("__stored")


def admin_lookup(emails: DataFrame, admins: DataFrame) -> DataFrame:
    """email → admin row, or status ``NoSuchEmail``."""
    a = admins.select("email", "language", "created_at", F.lit(True).alias("__found"))
    joined = emails.select("email").join(a, "email", "left")
    return joined.select("email", "language", "created_at",
                         F.when(F.col("__found"), F.lit(OK)).otherwise(F.lit(NO_SUCH_EMAIL)).alias("status"))


def admin_language(admins: DataFrame, changes: DataFrame) -> DataFrame:
    """Set an admin's language (``changes``: email, language, seq). Every change
    gets a row: the admin as it is after that change, or ``NoSuchEmail``, or
    ``InvalidLanguage`` for a language that is not supported."""
    found = admins.select("email", "created_at", F.lit(True).alias("__found"))
    joined = checked_join(changes.select("seq", "email", "language"), found, ["email"], "left", salt_key=["seq"])
    supported = F.coalesce(F.col("language").isin(list(LANGUAGES)), F.lit(False))
    ok = F.col("__found").isNotNull() & supported
    status = (F.when(~supported, F.lit(INVALID_LANGUAGE)).when(F.col("__found").isNull(), F.lit(NO_SUCH_EMAIL))
               .otherwise(F.lit(OK)))
    return joined.select("seq", "email", F.when(ok, F.col("language")).alias("language"),
                         F.when(ok, F.col("created_at")).alias("created_at"), status.alias("status"))
