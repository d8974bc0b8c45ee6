"""Severity levels as Column expressions (no UDFs)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference): the six level names and their
# integers, in order. Names are matched case-insensitively on input.
LEVELS = [
    ("trace", 10),
    ("debug", 20),
    ("info", 30),
    ("warn", 40),
    ("error", 50),
    ("other", 60),
]

# Fixed values (logging-library constants, public): TRACE, DEBUG, INFO, WARN,
# ERROR integers of the logging library mapped onto the six-level domain.
LIBRARY_LEVELS = [
    ("TRACE", 5000, 10),
    ("DEBUG", 10000, 20),
    ("INFO", 20000, 30),
    ("WARN", 30000, 40),
    ("ERROR", 40000, 50),
]

LEVEL_INTS = [n for _, n in LEVELS]
LEVEL_BY_NAME = dict(LEVELS)
NAME_BY_LEVEL = {n: name for name, n in LEVELS}
DEFAULT_LEVEL = "info"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_level_int(level: str | int) -> int:
    """Driver-side: a level name (any case) or int to its int; error if unknown."""
    if isinstance(level, int):
        if level not in NAME_BY_LEVEL:
            raise ValueError(f"Invalid log level: '{level}'. Must be one of {LEVEL_INTS}")
        return level
    key = str(level).lower()
    if key not in LEVEL_BY_NAME:
        raise ValueError(f"Unknown level: '{level}'.")
    return LEVEL_BY_NAME[key]


def levels_at_least(level: str | int) -> list[int]:
    """The known level ints ≥ ``level``; the search folds ``level >= n`` into this IN list."""
    floor = to_level_int(level)
    return [n for n in LEVEL_INTS if n >= floor]


def _literal_map(pairs: Iterable[tuple]) -> Column:
    flat = []
    for k, v in pairs:
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)


def level_name(c: Column | str) -> Column:
    """Level int → name; unknown ints → null."""
    return _literal_map((n, name) for name, n in LEVELS)[_col(c)]


def level_int(c: Column | str) -> Column:
    """Level name (case-insensitive) → int; unknown names → null."""
    return _literal_map(LEVELS)[F.lower(_col(c))]


def logback_level(c: Column | str) -> Column:
    """Logging-library level (name or int) → the six-level domain; anything else → other (60)."""
    c = _col(c)
    as_text = F.upper(F.trim(c.cast("string")))
    out = F.when(F.lit(False), F.lit(None))
    for name, lib_int, n in LIBRARY_LEVELS:
        out = out.when((as_text == name) | (as_text == str(lib_int)), F.lit(n))
    return out.otherwise(F.lit(LEVEL_BY_NAME["other"]))

