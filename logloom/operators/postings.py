"""The full-text index as postings in blocks: pages of hot words that read the
first blocks only, prefixes as key ranges, and many text viewers in one join.

A block holds up to ``BLOCK`` rows of one word in (added, id) order, with what
a search filters by (app and level), and its time bounds beside it. A page of
the newest rows needs no block that ends before its horizon: the bounds of the
newest few blocks give a horizon, the blocks that reach it are read, and only
if their rows do not fill the page are more blocks taken.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import DEFAULT_STOPWORDS, MIN_TOKEN_LENGTH, distinct_tokens, search_text, tokens
from logloom.operators.filters import (
    MIN_QUERY_LENGTH, SearchSpec, _and, apps_predicate, level_predicate, query_words, search_gate_value, time_predicate,
)
from logloom.operators.joins import checked_join
from logloom.operators.ranking import range_rank
from logloom.schema import LOG_COLUMNS, PARTITION_COLUMN
from logloom.session import INDEX_PARTITION_BYTES, fresh_path, partitions_for

BLOCK = 1024
# Blocks whose bounds give the first horizon; the next one takes GROWTH times as many.
FIRST_BLOCKS = 4
GROWTH = 4
# Small row groups, so that few blocks are read around the wanted ones.
ROW_GROUP_BYTES = 4 << 20


def _index_parts(df: DataFrame) -> int:
    """Partitions of the rows' words, so that a task's share of them is bounded
    whatever the table's size."""
    return partitions_for(df.sparkSession, df, floor=1, target_bytes=INDEX_PARTITION_BYTES)


def postings(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """(token, block, n, lo, hi, rows): the rows of each word in blocks of
    (added, id) order. A word is ranked over range partitions, so that one held
    by a third of all rows is never gathered; a block is a bounded group."""
    words = df.select(F.explode(distinct_tokens(search_text())).alias("token"), "added", "id", "app", "level").where(
        F.length("token") >= MIN_TOKEN_LENGTH)
    spark, parts = df.sparkSession, _index_parts(df)
    ranked = range_rank(words, ["token"], ["added", "id"], "place",
                        max(parts, partitions_for(spark, df, floor=int(spark.conf.get("spark.sql.shuffle.partitions")))))
    # Dealt by range before the blocks are made: they are grouped and stored where they lie.
    placed = ranked.withColumn("block", F.floor((F.col("place") - 1) / block)).repartitionByRange(parts, "token", "block")
    return placed.groupBy("token", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("added").alias("lo"), F.max("added").alias("hi"),
        F.sort_array(F.collect_list(F.struct("added", "id", "app", "level"))).alias("rows"))


def append_postings(df: DataFrame, path: str, batch: int, block: int = BLOCK) -> None:
    """Write the postings of newly stored rows as one batch of the index at
    ``path``, sorted by word; a replayed batch replaces its own."""
    (postings(df, block).sortWithinPartitions("token", "block")
          .write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/batch={batch}"))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def word_predicate(q: str, mode: str = "natural") -> Column:
    """The words of a query as a condition on ``token`` that the scan of the
    sorted index takes: equal words, or words in the key ranges of prefixes."""
    if mode not in ("natural", "prefix"):
        raise ValueError(f"unknown search mode {mode!r}")
    words = query_words(q, DEFAULT_STOPWORDS)
    if not words:
        return F.lit(False)
    if mode == "natural":
        return F.col("token").isin(words)
    return functools.reduce(lambda a, b: a | b, [F.col("token").startswith(w) for w in words])


def _ids(blocks: DataFrame) -> DataFrame:
    """(added, id, app, level) of the rows in some blocks, each once."""
    return blocks.select(F.explode("rows").alias("r")).select("r.*").dropDuplicates(["id"])


def _of_rows(logs: DataFrame, ids: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """The log rows of ``ids`` (added, id); their dates prune the scan."""
    keys = ids.select("id")
    if PARTITION_COLUMN in logs.columns:
        keys = ids.select("id", F.to_date("added").alias(PARTITION_COLUMN))
    return checked_join(logs, keys, keys.columns, "left_semi", size=size)


def search_postings(index: DataFrame, logs: DataFrame, q: str | None, mode: str = "natural") -> DataFrame:
    """Every row of ``logs`` with a word of ``q`` (or with a prefix there), by
    the index; all rows when the query is too short to count."""
    q = search_gate_value(q)
    if q is None:
        return logs
    return _of_rows(logs, _ids(index.where(word_predicate(q, mode))))


def horizon(blocks: DataFrame, k: int, newest: bool):
    """The time up to which ``k`` blocks reach (from the newest or the oldest
    end), None when there are no more than these; the bounds alone are read."""
    edge, order = ("lo", F.col("lo").desc()) if newest else ("hi", F.col("hi").asc())
    first = blocks.select(edge).orderBy(order).limit(k + 1).agg(
        F.count(F.lit(1)).alias("n"), (F.min(edge) if newest else F.max(edge)).alias("edge")).first()
    return first["edge"] if first["n"] > k else None


def page_ids(index: DataFrame, spec: SearchSpec, mode: str = "natural", first_blocks: int = FIRST_BLOCKS) -> tuple[DataFrame, int]:
    """The first ``offset + limit`` rows of a text search in the page's order,
    as (added, id), and their number. Rows beyond the horizon are left out of a
    round, so what a round finds is complete; when it is too little, the next
    round's horizon is further off."""
    newest, wanted = spec.order == "desc", spec.offset + spec.limit
    blocks = index.where(word_predicate(spec.query, mode))
    bounds = [F.col("hi") >= F.lit(spec.from_).cast("timestamp_ntz") if spec.from_ else None,
              F.col("lo") <= F.lit(spec.to).cast("timestamp_ntz") if spec.to else None]
    if _and(bounds) is not None:
        blocks = blocks.where(_and(bounds))
    kept = _and([apps_predicate(spec.apps, spec.apps_ignore_case), level_predicate(spec.level), time_predicate(spec.from_, spec.to)])
    order = [F.col(c).desc() if newest else F.col(c).asc() for c in ("added", "id")]
    k = first_blocks
    while True:
        edge, part = horizon(blocks, k, newest), blocks
        inside = F.lit(True)
        if edge is not None:
            at = F.lit(edge).cast("timestamp_ntz")
            part = blocks.where(F.col("hi") >= at if newest else F.col("lo") <= at)
            inside = F.col("added") >= at if newest else F.col("added") <= at
        found = _ids(part).where(inside & kept).select("added", "id").orderBy(*order).limit(wanted)
        path = fresh_path(index.sparkSession, "page")
        found.write.parquet(path)
        found = index.sparkSession.read.schema(found.schema).parquet(path)
        n = found.count()
        if edge is None or n >= wanted:
            return found, n
        k *= GROWTH


def text_page(logs: DataFrame, index: DataFrame, spec: SearchSpec, mode: str = "natural") -> DataFrame:
    """One viewer's page of a text search, by the index: 12 columns in order."""
    from logloom.operators.search import page, sort_added

    found, n = page_ids(index, spec, mode)
    ids = page(sort_added(found, spec.order), spec.limit, spec.offset)
    return sort_added(_of_rows(logs, ids, size=(n, 24 * n)).select(*LOG_COLUMNS), spec.order)


def text_matches(logs: DataFrame, specs: DataFrame) -> DataFrame:
    """Every (spec, row) pair of viewers with a text query: the queries' words
    are a table of their own, which the rows' words join, so a viewer meets
    only rows that hold one of its words. A pair that shares several words is
    kept at the smallest of them, without a distinct over the pairs. Output:
    the 12 columns and the specs' spec_id, from_ts, to_ts, lim, off, ord."""
    wanted = F.array_distinct(tokens("q"))
    queries = specs.where(F.length("q") >= MIN_QUERY_LENGTH).select(
        "spec_id", "from_ts", "to_ts", "lim", "off", "ord", wanted.alias("wanted"),
        F.coalesce("apps", F.array().cast("array<string>")).alias("apps"), F.coalesce("min_level", F.lit(0)).alias("min_level"))
    words = queries.select("spec_id", F.explode("wanted").alias("word"))
    rows = logs.select(*LOG_COLUMNS, F.array_distinct(tokens(search_text())).alias("words"))
    rows = rows.select("*", F.explode("words").alias("word"))
    met = checked_join(checked_join(rows, words, ["word"]), queries.withColumnRenamed("apps", "wanted_apps"), ["spec_id"])
    fits = ((F.size("wanted_apps") == 0) | F.expr("array_contains(wanted_apps, app)")) & (F.col("level") >= F.col("min_level"))
    in_time = (F.col("from_ts").isNull() | (F.col("added") >= F.col("from_ts"))) & (F.col("to_ts").isNull() | (F.col("added") <= F.col("to_ts")))
    once = F.col("word") == F.array_min(F.array_intersect("words", "wanted"))
    return met.where(fits & in_time & once).select(*LOG_COLUMNS, "spec_id", "from_ts", "to_ts", "lim", "off", "ord")
