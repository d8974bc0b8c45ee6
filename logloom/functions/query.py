"""Search-spec scalars: summaries, range phrases, query-string encoding and parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.levels import DEFAULT_LEVEL, level_int, level_name
from logloom.functions.text import is_blank, trimmed
from logloom.functions.timefmt import default_range, helsinki_minute, iso_instant_format, parse_bound

# Query-parameter names.
KEY_APP, KEY_LEVEL, KEY_FROM, KEY_TO = "app", "level", "from", "to"
KEY_LIMIT, KEY_OFFSET, KEY_ORDER, KEY_QUERY = "limit", "offset", "order", "q"
PARAM_KEYS = (KEY_QUERY, KEY_APP, KEY_LEVEL, KEY_FROM, KEY_TO, KEY_LIMIT, KEY_OFFSET, KEY_ORDER)
REQUEST_LIMIT, REQUEST_OFFSET = 500, 0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def range_phrase(from_: Column | str, to: Column | str, lab: dict[str, Column]) -> Column:
    """`` time between f - t`` / `` time until t`` / `` time starting f`` / empty,
    with the bounds shown as Helsinki minutes. ``lab`` maps label keys to Columns."""
    f, t = helsinki_minute(_col(from_)), helsinki_minute(_col(to))
    qt = F.concat(F.lit(" "), lab["queryTime"], F.lit(" "))
    return (
        F.when(f.isNotNull() & t.isNotNull(), F.concat(qt, lab["between"], F.lit(" "), f, F.lit(" - "), t))
        .when(t.isNotNull(), F.concat(qt, lab["until"], F.lit(" "), t))
        .when(f.isNotNull(), F.concat(qt, lab["starting"], F.lit(" "), f))
        .otherwise(F.lit(""))
    )


def query_summary(apps: Column | str, level: Column | str, limit: Column | str, offset: Column | str,
                  q: Column | str, lab: dict[str, Column]) -> Column:
    """``query 'q' apps a, b level L limit N offset M`` (query/apps parts only when set)."""
    apps, q = _col(apps), _col(q)
    apps_part = F.when(F.size(F.coalesce(apps, F.array().cast("array<string>"))) > 0,
                       F.concat(lab["apps"], F.lit(" "), F.array_join(apps, ", "), F.lit(" "))).otherwise(F.lit(""))
    q_part = F.when(q.isNotNull(), F.concat(lab["query"], F.lit(" '"), q, F.lit("' "))).otherwise(F.lit(""))
    return F.concat(q_part, apps_part, lab["queryLevel"], F.lit(" "), level_name(_col(level)),
                    F.lit(" "), lab["limit"], F.lit(" "), _col(limit).cast("string"),
                    F.lit(" "), lab["offset"], F.lit(" "), _col(offset).cast("string"))


def no_results_message(apps, level, limit, offset, q, from_, to, lab: dict[str, Column]) -> Column:
    """What a viewer sees for ``noData``: ``<noResults> <summary><range phrase>.``"""
    return F.concat(lab["noResults"], F.lit(" "), query_summary(apps, level, limit, offset, q, lab),
                    range_phrase(from_, to, lab), F.lit("."))


def query_describe(apps, level, limit, offset, q, from_, to, order, lab: dict[str, Column]) -> Column:
    """The server's one-line description: summary, range phrase, `` order O``."""
    return F.concat(query_summary(apps, level, limit, offset, q, lab), range_phrase(from_, to, lab),
                    F.lit(" order "), _col(order))


def encode_query(apps: Column | str, level: Column | str, from_: Column | str, to: Column | str,
                 limit: Column | str, offset: Column | str, order: Column | str, q: Column | str) -> Column:
    """Spec → ``map<string, array<string>>`` of query parameters; empty lists dropped."""
    def one(c: Column) -> Column:
        return F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))

    entries = {
        KEY_QUERY: one(_col(q)),
        KEY_APP: F.coalesce(_col(apps), F.array().cast("array<string>")),
        KEY_LEVEL: one(level_name(_col(level))),
        KEY_FROM: one(iso_instant_format(_col(from_))),
        KEY_TO: one(iso_instant_format(_col(to))),
        KEY_LIMIT: one(_col(limit).cast("string")),
        KEY_OFFSET: one(_col(offset).cast("string")),
        KEY_ORDER: one(_col(order)),
    }
    flat = []
    for k, v in entries.items():
        flat += [F.lit(k), v]
    return F.map_filter(F.create_map(*flat), lambda k, v: F.size(v) > 0)


def toggle_param(params: Column | str, key: str, value: Column | str | None) -> Column:
    """Set ``key`` to ``[value]``, or remove it when the value is null."""
    params = _col(params)
    value = F.lit(None).cast("string") if value is None else _col(value)
    removed = F.map_filter(params, lambda k, v: k != F.lit(key))
    added = F.map_concat(removed, F.create_map(F.lit(key), F.array(value)))
    return F.when(value.isNull(), removed).otherwise(added)


def toggle_apps(apps: Column | str, app: Column | str, on: Column | bool) -> Column:
    """Add (``on``) or remove an app in a spec's app set (set semantics, sorted)."""
    apps = F.coalesce(_col(apps), F.array().cast("array<string>"))
    one = F.array(_col(app))
    on = F.lit(on) if isinstance(on, bool) else _col(on)
    return F.array_sort(F.when(on, F.array_union(apps, one)).otherwise(F.array_except(apps, one)))


def _params(query_string: Column) -> Column:
    """``a=1&b=2`` → array<struct<k, v>> with URL-decoded keys and values."""
    parts = F.filter(F.split(query_string, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
        F.try_url_decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v"),
    ))


def parse_query(df: DataFrame, url_col: str, now: Column | str) -> DataFrame:
    """Request URLs → spec columns plus ``error`` (null when the request is valid).

    Parameters: repeated ``app``, ``level`` (default info), ``from``, ``to``
    (instant, date in Helsinki, or offset date-time; missing ``from`` = now −
    48 h), ``limit`` (500), ``offset`` (0), ``order`` (desc) and ``q`` (kept
    only from 3 chars). The first value of a single-valued key is used.

    Staged: the parameter list, then each parameter, then the checks are kept
    as columns, so the split/decode lambdas run once per row.
    """
    url = F.regexp_replace(F.col(url_col), "(?s)#.*$", "")
    qs = F.regexp_replace(url, r"(?s)^[^?]*\?", "")  # after the first question mark
    staged = df.withColumn("__kv", _params(F.regexp_replace(qs, r"\+", "%20")))

    def values(key: str) -> Column:
        return F.transform(F.filter("__kv", lambda x: x["k"] == key), lambda x: x["v"])

    def first(key: str) -> Column:
        return F.try_element_at(values(key), F.lit(1))

    staged = staged.select(
        "*",
        F.transform(values(KEY_APP), lambda a: F.when(is_blank(a), F.lit("")).otherwise(trimmed(a))).alias("__apps"),
        F.coalesce(first(KEY_LEVEL), F.lit(DEFAULT_LEVEL)).alias("__level_txt"),
        first(KEY_FROM).alias("__from_txt"), first(KEY_TO).alias("__to_txt"),
        first(KEY_LIMIT).alias("__lim_txt"), first(KEY_OFFSET).alias("__off_txt"),
        F.coalesce(first(KEY_ORDER), F.lit("desc")).alias("__order"), first(KEY_QUERY).alias("__q"),
    ).drop("__kv")
    lim_txt, off_txt = F.col("__lim_txt"), F.col("__off_txt")
    staged = staged.select(
        "*",
        level_int("__level_txt").alias("__lvl"),
        parse_bound("__from_txt").alias("__f"), parse_bound("__to_txt").alias("__t"),
        F.coalesce(lim_txt.try_cast("int"), F.when(lim_txt.isNull(), F.lit(REQUEST_LIMIT))).alias("__lim"),
        F.coalesce(off_txt.try_cast("int"), F.when(off_txt.isNull(), F.lit(REQUEST_OFFSET))).alias("__off"),
    )
    lvl, lim, off, order = F.col("__lvl"), F.col("__lim"), F.col("__off"), F.col("__order")
    errors = F.array_compact(F.array(
        F.when(F.exists("__apps", lambda a: a == ""), F.lit("App name must not be blank.")),
        F.when(lvl.isNull(), F.concat(F.lit("Unknown level: '"), F.col("__level_txt"), F.lit("'."))),
        F.col("__f")["error"], F.col("__t")["error"],
        F.when(lim.isNull() | (lim < 0), F.concat(F.lit("Invalid limit: '"), lim_txt, F.lit("'."))),
        F.when(off.isNull() | (off < 0), F.concat(F.lit("Invalid offset: '"), off_txt, F.lit("'."))),
        F.when(~order.isin("asc", "desc"), F.concat(F.lit("Invalid order: '"), order, F.lit("'."))),
    ))
    staged = staged.withColumn("__errors", errors)
    rng = default_range(F.col("__f")["value"], F.col("__t")["value"], _col(now))
    ok = F.size("__errors") == 0
    out = staged.select(
        "*",
        F.when(ok, F.col("__apps")).alias("apps"),
        F.when(ok, lvl).alias("min_level"),
        F.when(ok, rng["from"]).alias("from_ts"),
        F.when(ok, rng["to"]).alias("to_ts"),
        F.when(ok, lim).alias("lim"),
        F.when(ok, off).alias("off"),
        F.when(ok, order).alias("ord"),
        F.when(ok & (F.length("__q") >= 3), F.col("__q")).alias("q"),
        F.when(~ok, F.array_join("__errors", " ")).alias("error"),
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])
