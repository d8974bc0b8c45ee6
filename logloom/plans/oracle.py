"""DuckDB SQL fragments for the oracle queries (the fixture views inlined as CTEs)."""

from __future__ import annotations

from logloom.functions.levels import LEVEL_INTS
from logloom.functions.text import DEFAULT_STOPWORDS, MIN_TOKEN_LENGTH, SEARCH_COLUMNS
from logloom.sources.fixtures import duck_cte

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in DEFAULT_STOPWORDS) + "]"
LEVELS_SQL = "(" + ", ".join(str(n) for n in LEVEL_INTS) + ")"
WORD_SPLIT_SQL = r"'[^\p{L}\p{N}_]+'"


def cte(*names: str) -> str:
    return duck_cte(*names)


def tokens_sql(expr: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({expr}), {WORD_SPLIT_SQL}), "
            f"lambda w: length(w) >= {MIN_TOKEN_LENGTH} and not list_contains({STOP_SQL}, w))")


def search_text_sql(prefix: str = "") -> str:
    return "concat_ws(' ', " + ", ".join(prefix + c for c in SEARCH_COLUMNS) + ")"


def levels_from_sql(n: int) -> str:
    return "(" + ", ".join(str(x) for x in LEVEL_INTS if x >= n) + ")"


LOG_COLS_SQL = "id, app, address, timestamp, message, logger, thread, level, client, user_agent, stacktrace, added"


def iso_sql(expr: str) -> str:
    """ISO instant text of a ms-or-µs timestamp (no fraction when zero)."""
    return (f"case when {expr} is null then null "
            f"when epoch_us({expr}) % 1000000 = 0 then strftime({expr}, '%Y-%m-%dT%H:%M:%SZ') "
            f"when epoch_us({expr}) % 1000 = 0 then strftime({expr}, '%Y-%m-%dT%H:%M:%S.%gZ') "
            f"else strftime({expr}, '%Y-%m-%dT%H:%M:%S.%fZ') end")


def display_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def level_name_sql(expr: str) -> str:
    return (f"case {expr} when 10 then 'trace' when 20 then 'debug' when 30 then 'info' "
            f"when 40 then 'warn' when 50 then 'error' when 60 then 'other' end")
