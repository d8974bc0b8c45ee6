"""Joins against a request-side table whose size is only known at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.ranking import BROADCAST_MAX_ROWS

DEFAULT_SALTS = 64
# Largest table broadcast (bytes of its values and of a hash table's entry for
# each row): the driver holds a few copies of it while it is built and sent.
BROADCAST_MAX_BYTES = 48 * 1024 * 1024
ROW_BYTES = 64


def table_size(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes of the values), in one aggregate."""
    width = F.lit(8 * len(df.columns)).cast("long")
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind == "string":
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind == "array<string>":
            sizes = F.aggregate(f.name, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
            width = width + F.coalesce(sizes, F.lit(0).cast("long"))
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return int(row[0]), int(row[1])


def fits_broadcast(df: DataFrame, size: tuple[int, int] | None = None) -> bool:
    rows, size_bytes = size or table_size(df)
    return rows <= BROADCAST_MAX_ROWS and size_bytes + rows * ROW_BYTES <= BROADCAST_MAX_BYTES


# Rows of the large side from which on a join key is dealt to several tasks.
HOT_ROWS = 200_000


def _salted(big: DataFrame, small: DataFrame, on: list[str], how: str, salt_key: Sequence[str], salts: int) -> DataFrame:
    """The join with copies of the hot keys' rows only. The hint keeps the
    planner, which sees compressed bytes, from a broadcast."""
    # At most one key for each HOT_ROWS rows.
    hot = big.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_ROWS)
    found = hot.select(*on, F.least(F.lit(salts), F.ceil(F.col("__n") / HOT_ROWS)).cast("int").alias("__copies")).collect()
    if not found:
        return big.join(small.hint("merge"), on, how)
    copies = F.broadcast(big.sparkSession.createDataFrame(found, hot.select(*on).schema.add("__copies", "int")))
    n = F.coalesce("__copies", F.lit(1))
    salted_small = small.join(copies, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("__copies")
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_key]), n).cast("int")
    salted_big = big.join(copies, on, "left").withColumn("__salt", salt).drop("__copies")
    return salted_big.join(salted_small.hint("merge"), on + ["__salt"], how).drop("__salt")


def checked_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                 salt_key: Sequence[str] = ("id",), salts: int = DEFAULT_SALTS,
                 max_rows: int = BROADCAST_MAX_ROWS, size: tuple[int, int] | None = None) -> DataFrame:
    """Join ``big`` with a request-side table ``small`` on ``on``.

    ``small`` is broadcast only after its rows and bytes are checked. Past the
    bounds both sides are shuffled, and the hot keys are salted: a key that more
    than ``HOT_ROWS`` rows of ``big`` hold (a level, an app holding a third of
    them) spreads over up to ``salts`` buckets, one for each ``HOT_ROWS``; its
    rows of ``small`` are copied into each of them and each ``big`` row goes to
    one (by a hash of ``salt_key``). Rows of other keys are not copied. ``big``
    is counted by key first; a stream, which cannot be, has all keys salted. Valid for inner, left, left-semi and left-anti
    joins (every big row meets every small row of its key exactly once).
    ``size`` passes the (rows, bytes) that the caller already knows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    on = list(on)
    size = size or table_size(small)
    if size[0] <= max_rows and fits_broadcast(small, size):
        return big.join(F.broadcast(small), on, how)
    if not big.isStreaming:
        return _salted(big, small, on, how, salt_key, salts)
    salted_small = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted_big = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in salt_key]), F.lit(salts)).cast("int"))
    return salted_big.join(salted_small, on + ["__salt"], how).drop("__salt")
