"""Sort, paging and the composed searches (one spec, or a table of specs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.levels import LEVEL_INTS, to_level_int
from logloom.functions.text import search_text, tokens
from logloom.operators.filters import (
    MIN_QUERY_LENGTH, PAGE_STEP, SearchSpec, filter_all, time_predicate,
)
from logloom.operators.joins import checked_join
from logloom.operators.ranking import group_limit_threshold, range_rank, top_rows_per_group
from logloom.schema import LOG_COLUMNS, PARTITION_COLUMN


def sort_added(df: DataFrame, order: str = "desc") -> DataFrame:
    """Order by ``added`` then ``id``, both in the same direction (default desc)."""
    if order == "asc":
        return df.orderBy(F.col("added").asc(), F.col("id").asc())
    return df.orderBy(F.col("added").desc(), F.col("id").desc())


def sort_severity(df: DataFrame, ascending: bool = True) -> DataFrame:
    """Levels have a total order by their int; ``id`` breaks ties."""
    if ascending:
        return df.orderBy(F.col("level").asc(), F.col("id").asc())
    return df.orderBy(F.col("level").desc(), F.col("id").desc())


# An offset from here on is found by counts and ranks instead of a top-(L+O) of one task.
DEEP_OFFSET = 10_000


def page(df: DataFrame, limit: int = 1000, offset: int = 0, order: Sequence[Column] | None = None) -> DataFrame:
    """``limit L offset O`` of an ordered frame: a top-k of L+O rows in the
    plan. A deep offset of a frame with a total ``order`` is ranked over range
    partitions instead, so that no task holds more than its share and the page."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must be non-negative")
    if order is not None and offset >= DEEP_OFFSET:
        ranked = range_rank(df, [], list(order), "__rank")
        rows = ranked.where((F.col("__rank") > offset) & (F.col("__rank") <= offset + limit))
        return rows.orderBy("__rank").drop("__rank")
    if order is not None:
        df = df.orderBy(*order)
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def page_links(specs: DataFrame, off: str = "off") -> DataFrame:
    """Previous/next offsets: ±500 whatever the limit; no previous below zero."""
    o = F.col(off)
    return specs.withColumn("prev_offset", F.when(o >= PAGE_STEP, o - PAGE_STEP)) \
                .withColumn("next_offset", o + PAGE_STEP)


def history_search(df: DataFrame, spec: SearchSpec, mode: str = "natural", index: DataFrame | None = None,
                   cells: DataFrame | None = None, postings: DataFrame | None = None) -> DataFrame:
    """One viewer's history: filters, order by (added, id), one page; 12
    columns. A text query goes through the ``postings`` of the table when there
    are any (both modes, with an early stop), else through its token ``index``.

    A page at a deep offset is found by counting (``history_by_cells``): the
    counts per hour, app and level say in which hours it lies, and only their
    rows are read and ranked. ``cells`` are the table's stored counts
    (``store.cell_counts``); without them three columns are counted."""
    if spec.offset >= DEEP_OFFSET and spec.gated_query is None and not spec.apps_ignore_case:
        return deep_page(df, spec, cells)
    if postings is not None and spec.gated_query is not None:
        from logloom.operators.postings import text_page

        return text_page(df, postings, spec, mode)
    rows = filter_all(df, spec, mode, index).select(*LOG_COLUMNS)
    if spec.offset >= DEEP_OFFSET:
        up = spec.order == "asc"
        return page(rows, spec.limit, spec.offset, [F.col(c).asc() if up else F.col(c).desc() for c in ("added", "id")])
    return page(sort_added(rows, spec.order), spec.limit, spec.offset)


SPEC = ("spec_id long, apps array<string>, min_level int, from_ts timestamp_ntz, to_ts timestamp_ntz, "
        "lim long, off long, ord string, q string")


def deep_page(df: DataFrame, spec: SearchSpec, cells: DataFrame | None = None) -> DataFrame:
    """One viewer's page at any offset, from counts per hour, app and level."""
    from logloom.operators.cells import history_by_cells

    one = df.sparkSession.createDataFrame([(1, list(spec.apps), to_level_int(spec.level), spec.from_, spec.to, spec.limit,
                                            spec.offset, spec.order, None)], SPEC)
    if cells is not None:
        cells = cells.withColumnRenamed("hour", "span").groupBy("span", "app", "level").agg(F.sum("n").alias("n"))
    return history_by_cells(df, one, cells, unit="hour").orderBy("rank").select(*LOG_COLUMNS)


# ---------------------------------------------------------------------------
# A table of specs (one row per viewer) in one job.

def spec_keys(specs: DataFrame) -> DataFrame:
    """Each spec as the equi-join keys it accepts: (spec_id, app, any_app,
    level) for every accepted level, with each listed app, or with ``any_app``
    and an empty name for a spec without apps. Theta → equi join."""
    levels = F.filter(F.array(*[F.lit(n) for n in LEVEL_INTS]),
                      lambda x: x >= F.coalesce(F.col("min_level"), F.lit(LEVEL_INTS[0])))
    apps = F.array_distinct(F.coalesce(F.col("apps"), F.array().cast("array<string>")))
    return (specs.select("spec_id", levels.alias("levels"), (F.size(apps) == 0).alias("any_app"),
                         F.when(F.size(apps) == 0, F.array(F.lit(""))).otherwise(apps).alias("apps"))
                 .select("spec_id", "any_app", "levels", F.explode("apps").alias("app"))
                 .select("spec_id", "any_app", "app", F.explode("levels").alias("level")))


def match_keys(rows: DataFrame, specs: DataFrame, stats) -> DataFrame:
    """Every (spec, row) pair with an accepted app and level, in one pass over
    ``rows``: a row is looked up by (app, level), by (any app, level), or, when
    there are specs of both kinds, by both. Adds ``spec_id``."""
    keys = spec_keys(specs)
    size = (int(stats["n_keyed"] or 0) + int(stats["n_unkeyed"] or 0), int(stats["key_bytes"] or 0))
    if not stats["n_unkeyed"]:
        return checked_join(rows, keys.drop("any_app"), ["app", "level"], size=size)
    if not stats["n_keyed"]:
        return checked_join(rows, keys.drop("any_app", "app"), ["level"], size=size)
    probes = F.array(F.struct(F.col("app").alias("app"), F.lit(False).alias("any_app")),
                     F.struct(F.lit("").alias("app"), F.lit(True).alias("any_app")))
    probed = rows.withColumn("__p", F.explode(probes)).withColumns(
        {"__app": F.col("__p.app"), "__any": F.col("__p.any_app")}).drop("__p")
    keys = keys.withColumnsRenamed({"app": "__app", "any_app": "__any"})
    return checked_join(probed, keys, ["__app", "__any", "level"], size=size).drop("__app", "__any")


def spec_stats(specs: DataFrame):
    """One aggregate over the (small) spec table: the time envelope, the sizes
    of both kinds of join keys, the widest page, and the text queries."""
    n_levels = F.size(F.filter(F.array(*[F.lit(n) for n in LEVEL_INTS]),
                               lambda x: x >= F.coalesce(F.col("min_level"), F.lit(LEVEL_INTS[0]))))
    n_apps = F.size(F.array_distinct(F.coalesce(F.col("apps"), F.array().cast("array<string>"))))
    return specs.agg(
        F.min("from_ts").alias("lo"), F.max(F.col("from_ts").isNull().cast("int")).alias("open_lo"),
        F.max("to_ts").alias("hi"), F.max(F.col("to_ts").isNull().cast("int")).alias("open_hi"),
        F.sum(n_apps * n_levels).alias("n_keyed"),
        F.sum(F.when(n_apps == 0, n_levels).otherwise(0)).alias("n_unkeyed"),
        F.sum(F.greatest(n_apps, F.lit(1)) * n_levels * (
            F.lit(32) + F.coalesce(F.array_max(F.transform("apps", lambda a: F.octet_length(a))), F.lit(0)))).alias("key_bytes"),
        F.max(F.coalesce(F.col("off"), F.lit(0)) + F.coalesce(F.col("lim"), F.lit(0))).alias("widest"),
        F.count(F.when(F.length("q") >= MIN_QUERY_LENGTH, 1)).alias("n_text"),
        F.count(F.lit(1)).alias("n_specs"),
        F.sum(F.lit(64) + 3 * F.coalesce(F.octet_length("q"), F.lit(0))).alias("spec_bytes"),
    ).first()


def spec_matches(logs: DataFrame, specs: DataFrame, apply_text: bool = True, stats=None) -> DataFrame:
    """Every (spec, row) pair where the row passes the spec's filters.

    Output: the 12 log columns plus the spec columns (spec_id, from_ts, to_ts,
    lim, off, ord). The log is scanned once. Only keys and spec ids fan out;
    the specs' other columns join them by spec_id. A row is split into words
    once, before the fan-out, and only when some spec has a text query, whose
    words are split once per spec. From ``MANY_TEXTS`` text queries on, their
    words are joined with the rows' words instead (``text_matches``).
    """
    stats = stats or spec_stats(specs)
    text = apply_text and bool(stats["n_text"])
    if text and int(stats["n_text"]) >= MANY_TEXTS:
        from logloom.operators.postings import text_matches

        pairs = text_matches(_envelope_filter(logs, stats), specs)
        if int(stats["n_text"]) == int(stats["n_specs"]):
            return pairs
        plain = specs.where(~F.coalesce(F.length("q") >= MIN_QUERY_LENGTH, F.lit(False)))
        return pairs.unionByName(spec_matches(logs, plain).select(*pairs.columns))
    logs = _envelope_filter(logs, stats).select(
        *LOG_COLUMNS, *([tokens(search_text()).alias("__words")] if text else []))
    about = specs.select("spec_id", "from_ts", "to_ts", "lim", "off", "ord", *([
        F.when(F.length("q") >= MIN_QUERY_LENGTH, tokens("q")).alias("__wanted")] if text else []))
    m = checked_join(match_keys(logs, specs, stats), about, ["spec_id"],
                     size=(int(stats["n_specs"]), int(stats["spec_bytes"] or 0)))
    in_time = (F.col("from_ts").isNull() | (F.col("added") >= F.col("from_ts"))) & \
              (F.col("to_ts").isNull() | (F.col("added") <= F.col("to_ts")))
    m = m.where(in_time)
    if text:
        m = m.where(F.col("__wanted").isNull() | F.arrays_overlap("__words", "__wanted")).drop("__words", "__wanted")
    return m


def _envelope_filter(logs: DataFrame, env) -> DataFrame:
    """Push the envelope of all specs' time ranges into the scan: rows older
    than every spec's ``from`` (or newer than every ``to``) match no spec.
    On the stored table this prunes whole date partitions."""
    if env is None or env["open_lo"] is None:
        return logs
    lo = env["lo"] if not env["open_lo"] else None
    hi = env["hi"] if not env["open_hi"] else None
    pred = time_predicate(lo, hi, PARTITION_COLUMN in logs.columns)
    return logs if pred is None else logs.where(pred)


def _order_keys() -> list[Column]:
    """Per-spec direction as sort keys: ascending keys, negated for desc."""
    sign = F.when(F.col("ord") == "asc", F.lit(1)).otherwise(F.lit(-1))
    return [sign * F.unix_micros(F.col("added").cast("timestamp")), sign * F.col("id")]


# Text queries from which on their words are a table that the rows' words join.
MANY_TEXTS = 16
# Viewers from which on pages are found by counting; fewer are cheaper row by row.
MANY_VIEWERS = 1024


def history_many(logs: DataFrame, specs: DataFrame) -> DataFrame:
    """Each spec's page of history in one job: rows ranked ``off < rank <= off+lim``
    by (added, id) in the spec's direction. Output: spec_id, rank, 12 columns.

    Pages up to the partial-limit threshold (1000 rows by default) use the
    map-side top-k tree; wider ones use an exact global rank. Neither gathers
    a spec's matches into one task. Both form every (spec, row) pair that
    passes; from ``MANY_VIEWERS`` specs without a text query on, these are
    answered from counts per day, app and level instead (``history_by_cells``),
    and from ``MANY_TEXTS`` text queries on these are, per word (``history_by_words``).
    """
    stats = spec_stats(specs)
    if int(stats["n_specs"]) - int(stats["n_text"]) >= MANY_VIEWERS:
        from logloom.operators.cells import history_by_cells

        has_text = F.coalesce(F.length("q") >= MIN_QUERY_LENGTH, F.lit(False))
        plain = history_by_cells(logs, specs.where(~has_text))
        return plain.unionByName(history_many(logs, specs.where(has_text))) if stats["n_text"] else plain
    if int(stats["n_text"]) >= MANY_TEXTS:
        from logloom.operators.cells import history_by_words

        # Viewers that come more than once share their pages: pair by pair below.
        twice = specs.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("spec_id")
        some = not twice.isEmpty()
        once = specs.join(twice, "spec_id", "left_anti") if some else specs
        has_text = F.coalesce(F.length("q") >= MIN_QUERY_LENGTH, F.lit(False))
        out = history_by_words(logs, once.where(has_text))
        if int(stats["n_specs"]) > int(stats["n_text"]):
            out = out.unionByName(history_many(logs, once.where(~has_text)))
        if not some:
            return out
        again = specs.join(twice, "spec_id", "left_semi")
        return out.unionByName(_history_by_pairs(logs, again, spec_stats(again)))
    return _history_by_pairs(logs, specs, stats)


def _history_by_pairs(logs: DataFrame, specs: DataFrame, stats) -> DataFrame:
    """The pages out of every (spec, row) pair that passes."""
    m = spec_matches(logs, specs, stats=stats)
    hi = F.coalesce(F.col("off"), F.lit(0)) + F.coalesce(F.col("lim"), F.lit(0))
    lo = F.coalesce(F.col("off"), F.lit(0))
    widest = int(stats["widest"] or 0)
    out_cols = ["spec_id", "rank", *LOG_COLUMNS]
    if widest <= group_limit_threshold(logs.sparkSession):
        # Matches stay in the log scan's partitions (the spec side is broadcast
        # or salted-replicated), so the scan sizes the top-k tree.
        from logloom.session import partitions_for
        parts = partitions_for(logs.sparkSession, logs,
                               floor=int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        top = top_rows_per_group(m, ["spec_id"], _order_keys(), lo.cast("long"), hi.cast("long"),
                                 k=max(widest, 1), parts=parts)
        return top.select(*out_cols)
    ranked = range_rank(m, ["spec_id"], _order_keys())
    return ranked.where((F.col("rank") > lo) & (F.col("rank") <= hi)).select(*out_cols)


def history_or_nodata(logs: DataFrame, specs: DataFrame) -> DataFrame:
    """What a viewer is sent after ``loading``: the history page reversed
    (newest-first for desc, always reversed), or one ``noData`` marker that
    echoes the spec. Output: spec_id, seq, kind, id, app, level, added, message.

    The history is computed once; the page size is counted over the page.
    """
    page_of = Window.partitionBy("spec_id")
    hist = history_many(logs, specs).select(
        "spec_id", "rank", "id", "app", "level", "added", "message",
        F.count(F.lit(1)).over(page_of).alias("__n"))
    joined = specs.select("spec_id", F.coalesce("off", F.lit(0)).alias("__off")).join(hist, "spec_id", "left")
    # rank runs off+1 .. off+n; the replay position of the reversed page runs 1 .. n.
    seq = F.coalesce(F.col("__n") + F.col("__off") - F.col("rank") + 1, F.lit(1)).cast("long")
    kind = F.when(F.col("id").isNull(), F.lit("noData")).otherwise(F.lit("events"))
    return joined.select("spec_id", seq.alias("seq"), kind.alias("kind"), "id", "app", "level", "added", "message")
