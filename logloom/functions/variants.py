"""Typed reads of variant fields, as strict as the wire format's readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(v: Column, path: str) -> Column:
    """The variant type of a field (``VOID`` for a JSON null; null when absent)."""
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def long_of(v: Column, path: str) -> Column:
    """A field read as a long: an integer, a decimal or double without a
    fraction, or a string of digits; anything else (a boolean too) is null."""
    t = kind(v, path)
    number = F.try_variant_get(v, path, "decimal(38,6)")
    digits = text(v, path)
    return (F.when(t == "BIGINT", F.try_variant_get(v, path, "bigint"))
             .when((t == "DOUBLE") | t.startswith("DECIMAL"),
                   F.when(number == F.floor(number), number.try_cast("bigint")))
             .when((t == "STRING") & digits.rlike(r"^[+-]?\d+$"), digits.try_cast("bigint")))


def is_string(v: Column, path: str) -> Column:
    return F.coalesce(kind(v, path) == "STRING", F.lit(False))


def optional_string(v: Column, path: str) -> Column:
    """Absent, null or a string."""
    t = kind(v, path)
    return t.isNull() | t.isin("STRING", "VOID")
