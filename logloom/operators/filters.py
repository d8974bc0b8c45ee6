"""Search predicates over the log table (apps, level, time, text).

Each filter returns a DataFrame with the predicate added; absent filters add
nothing. Predicates stay plain Column expressions so Catalyst pushes them to
the Parquet scan (``PushedFilters``) and prunes ``added_date`` partitions.
"""

from __future__ import annotations

import datetime as dt
import functools
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.levels import DEFAULT_LEVEL, levels_at_least, to_level_int
from logloom.functions.text import DEFAULT_STOPWORDS, MIN_TOKEN_LENGTH, SEARCH_COLUMNS, distinct_tokens, search_text, tokens
from logloom.schema import PARTITION_COLUMN

# The paging and search constants of the reference.
DEFAULT_LIMIT = 1000          # programmatic default page size
DEFAULT_REQUEST_LIMIT = 500   # page size of a request without ``limit``
PAGE_STEP = 500               # next/previous move by this, whatever the limit
MIN_QUERY_LENGTH = 3          # shorter text queries are ignored
ORDERS = ("asc", "desc")
DEFAULT_ORDER = "desc"


@dataclass(frozen=True)
class SearchSpec:
    """One viewer's search: apps, minimum level, time range, page, order, text."""

    apps: tuple[str, ...] = ()
    level: str | int = DEFAULT_LEVEL
    from_: dt.datetime | None = None
    to: dt.datetime | None = None
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    order: str = DEFAULT_ORDER
    query: str | None = None
    apps_ignore_case: bool = False

    def __post_init__(self):
        if self.limit < 0 or self.offset < 0:
            raise ValueError("limit and offset must be non-negative")
        if self.order not in ORDERS:
            raise ValueError(f"order must be one of {ORDERS}")
        to_level_int(self.level)
        object.__setattr__(self, "apps", tuple(self.apps))

    @property
    def gated_query(self) -> str | None:
        return search_gate_value(self.query)


def search_gate_value(q: str | None) -> str | None:
    """Driver-side gate: queries shorter than 3 chars count as absent."""
    return q if q is not None and len(q) >= MIN_QUERY_LENGTH else None


def search_gate(q: Column | str) -> Column:
    """Column gate: text queries shorter than 3 chars become null (absent)."""
    q = F.col(q) if isinstance(q, str) else q
    return F.when(F.length(q) >= MIN_QUERY_LENGTH, q)


def level_predicate(level: str | int) -> Column:
    """``level >= n`` folded into an IN list over the known levels."""
    return F.col("level").isin(levels_at_least(level))


def apps_predicate(apps: Sequence[str] | None, ignore_case: bool = False) -> Column | None:
    """``app IN (...)``; empty list = no filter. Case-sensitive by default (as
    the live routing compares); ``ignore_case`` compares lower-cased names (as
    a case-insensitive database collation would), which cannot be pushed down."""
    if not apps:
        return None
    if ignore_case:
        return F.lower(F.col("app")).isin(sorted({a.lower() for a in apps}))
    return F.col("app").isin(list(apps))


def time_predicate(from_: dt.datetime | None, to: dt.datetime | None,
                   partitioned: bool = False) -> Column | None:
    """``added >= from`` and ``added <= to`` (inclusive, each optional).

    On the stored table the same bounds are also put on the date partition
    column, so whole days are pruned before any file is opened.
    """
    preds = []
    if from_ is not None:
        preds.append(F.col("added") >= F.lit(from_).cast("timestamp_ntz"))
        if partitioned:
            preds.append(F.col(PARTITION_COLUMN) >= F.lit(from_.date()))
    if to is not None:
        preds.append(F.col("added") <= F.lit(to).cast("timestamp_ntz"))
        if partitioned:
            preds.append(F.col(PARTITION_COLUMN) <= F.lit(to.date()))
    return _and(preds)


def text_predicate(q: str | Column | None, mode: str = "natural",
                   stopwords: Sequence[str] = DEFAULT_STOPWORDS,
                   columns: Sequence[str] = SEARCH_COLUMNS) -> Column | None:
    """Full-text match over the indexed columns.

    ``natural``: any query word equals any word of the row (the reference's
    MATCH ... AGAINST without boolean mode; the trailing ``*`` is no wildcard).
    ``prefix``: some word of the row starts with a query word.
    A query with no word left after tokenizing matches nothing.
    """
    if q is None:
        return None
    if mode not in ("natural", "prefix"):
        raise ValueError(f"unknown search mode {mode!r}")
    q_col = F.lit(q) if isinstance(q, str) else q
    text = search_text(columns)
    row_words = tokens(text, stopwords)
    q_words = tokens(q_col, stopwords)
    if mode == "natural":
        exact = F.arrays_overlap(row_words, q_words)
    else:
        exact = F.exists(row_words, lambda t: F.exists(q_words, lambda w: t.startswith(w)))
    if not isinstance(q, str):
        return exact
    # A row word equal to (or starting with) a query word is a substring of
    # the row's lower-cased text, so this cheap check never drops a match and
    # spares tokenizing the rows that cannot match.
    words = query_words(q, stopwords)
    if not words:
        return F.lit(False)
    lowered = F.lower(text)
    maybe = functools.reduce(lambda a, b: a | b, [F.instr(lowered, w) > 0 for w in words])
    return maybe & exact


def query_words(q: str, stopwords: Sequence[str] = DEFAULT_STOPWORDS) -> list[str]:
    """The words of one query string, as the column tokenizer splits a row:
    lower-cased runs of letters, digits and underscores, long enough and not a
    stop word. Plain Python on one string; no job is started."""
    spaced = "".join(ch if ch == "_" or unicodedata.category(ch)[0] in "LN" else " " for ch in q.lower())
    return sorted({w for w in spaced.split() if len(w) >= MIN_TOKEN_LENGTH and w not in stopwords})


def _and(preds: Sequence[Column | None]) -> Column | None:
    preds = [p for p in preds if p is not None]
    return functools.reduce(lambda a, b: a & b, preds) if preds else None


def _where(df: DataFrame, pred: Column | None) -> DataFrame:
    return df if pred is None else df.where(pred)


def filter_level(df: DataFrame, level: str | int = DEFAULT_LEVEL) -> DataFrame:
    return df.where(level_predicate(level))


def filter_apps(df: DataFrame, apps: Sequence[str] | None, ignore_case: bool = False) -> DataFrame:
    return _where(df, apps_predicate(apps, ignore_case))


def filter_time(df: DataFrame, from_: dt.datetime | None = None, to: dt.datetime | None = None) -> DataFrame:
    return _where(df, time_predicate(from_, to, PARTITION_COLUMN in df.columns))


def filter_search(df: DataFrame, q: str | None, mode: str = "natural",
                  stopwords: Sequence[str] = DEFAULT_STOPWORDS) -> DataFrame:
    return _where(df, text_predicate(search_gate_value(q), mode, stopwords))


def filter_all(df: DataFrame, spec: SearchSpec, mode: str = "natural", index: DataFrame | None = None) -> DataFrame:
    """AND of only the filters the spec sets; none → all rows. With the token
    ``index`` of the table, a natural text query is looked up there and only
    the dates that hold matches are scanned."""
    use_index = index is not None and mode == "natural" and spec.gated_query is not None
    dated = PARTITION_COLUMN in df.columns
    pred = _and([
        apps_predicate(spec.apps, spec.apps_ignore_case),
        level_predicate(spec.level),
        time_predicate(spec.from_, spec.to, dated),
        None if use_index else text_predicate(spec.gated_query, mode),
    ])
    out = _where(df, pred)
    if not use_index:
        return out
    days = _and([F.col(PARTITION_COLUMN) >= F.lit(spec.from_.date()) if spec.from_ else None,
                 F.col(PARTITION_COLUMN) <= F.lit(spec.to.date()) if spec.to else None])
    if PARTITION_COLUMN in index.columns:
        index = _where(index, days)
    return search_index(index, out, spec.query)


def token_index(df: DataFrame, stopwords: Sequence[str] = DEFAULT_STOPWORDS) -> DataFrame:
    """The full-text index as a table: one (token, id) row per distinct word of
    a row, plus the row's date partition when the input has one (so lookups
    can prune the log table's partitions)."""
    extra = [F.col(PARTITION_COLUMN)] if PARTITION_COLUMN in df.columns else []
    return df.select(
        F.explode(distinct_tokens(search_text(), stopwords)).alias("token"),
        F.col("id"), *extra,
    ).where(F.length("token") >= MIN_TOKEN_LENGTH)


def write_token_index(index: DataFrame, path: str, num_files: int | None = None) -> None:
    """Store the index range-partitioned and sorted by token, so a lookup of a
    few tokens reads only the row groups whose token range covers them."""
    if num_files is None:
        from logloom.session import INDEX_PARTITION_BYTES, partitions_for
        num_files = partitions_for(index.sparkSession, index, target_bytes=INDEX_PARTITION_BYTES)
    (index.repartitionByRange(num_files, "token", "id").sortWithinPartitions("token", "id")
          .write.mode("overwrite").parquet(path))


def append_token_index(rows: DataFrame, path: str, batch: int) -> None:
    """Add the words of newly stored ``rows`` (with their date partition) to the
    index at ``path`` as one batch, laid out by date like the log table and
    sorted by token within each file. A replayed batch replaces its own part."""
    from logloom.session import INDEX_PARTITION_BYTES, partitions_for
    from logloom.sources.store import replace_batch

    index = token_index(rows)
    parts = partitions_for(index.sparkSession, rows, floor=1, target_bytes=INDEX_PARTITION_BYTES)
    replace_batch(index.repartitionByRange(parts, PARTITION_COLUMN, "token", "id")
                       .sortWithinPartitions(PARTITION_COLUMN, "token", "id"), path, batch)


def search_index(index: DataFrame, logs: DataFrame, q: str | None,
                 stopwords: Sequence[str] = DEFAULT_STOPWORDS) -> DataFrame:
    """Rows of ``logs`` matching ``q`` (natural mode) through the index.

    The query's words are a handful of literals, so the lookup is an IN filter
    pushed into the index scan; the matching ids then semi-join the logs, on
    (added_date, id) when both sides carry the date, so dynamic partition
    pruning limits the log scan to the dates that hold matches.
    """
    q = search_gate_value(q)
    if q is None:
        return logs
    keys = ["id"] + ([PARTITION_COLUMN] if PARTITION_COLUMN in index.columns and PARTITION_COLUMN in logs.columns
                     else [])
    ids = index.where(F.col("token").isin(query_words(q, stopwords))).select(*keys).distinct()
    return logs.join(ids, keys, "left_semi")
