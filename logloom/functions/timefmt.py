"""Instant parsing and formatting as Column expressions.

All instants are ``timestamp_ntz`` values holding UTC wall-clock time; the
session time zone is pinned to UTC (see ``logloom.session``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The time zone of the date bounds and the live display, and
# the default look-back of a search without ``from``.
HELSINKI = "Europe/Helsinki"
DEFAULT_LOOKBACK_HOURS = 48
RECENT_MINUTES = 5

# An ISO-8601 instant as the JVM's instant parser accepts it (a date alone
# is not an instant, although the string-to-timestamp cast would take it).
ISO_INSTANT_RE = r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)$"
ISO_LOCAL_DATE_RE = r"^\d{4}-\d\d-\d\d$"
ISO_OFFSET_DATE_TIME_RE = r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:\d\d(:\d\d)?)$"

DISPLAY_FORMAT = "yyyy-MM-dd HH:mm:ss"
MINUTE_FORMAT = "yyyy-MM-dd HH:mm"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def millis_to_ts(c: Column | str) -> Column:
    """Epoch milliseconds → instant."""
    return F.timestamp_millis(_col(c)).cast("timestamp_ntz")


def ts_to_millis(c: Column | str) -> Column:
    """Instant → epoch milliseconds."""
    return F.unix_millis(_col(c).cast("timestamp"))


def truncate_millis(c: Column | str) -> Column:
    """Cut an instant to millisecond precision (the stored precision)."""
    return F.date_trunc("millisecond", _col(c)).cast("timestamp_ntz")


def iso_instant_parse(c: Column | str) -> Column:
    """ISO instant text → instant; anything else → null."""
    c = _col(c)
    parsed = F.try_to_timestamp(c).cast("timestamp_ntz")
    return F.when(c.rlike(ISO_INSTANT_RE), parsed)


def iso_instant_format(c: Column | str) -> Column:
    """Instant → ISO text: no fraction when it is zero, else 3 or 6 digits."""
    c = _col(c)
    micros = F.unix_micros(c.cast("timestamp"))
    frac = F.pmod(micros, F.lit(1_000_000))
    return (
        F.when(c.isNull(), F.lit(None))
        .when(frac == 0, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.pmod(frac, F.lit(1000)) == 0, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    )


def display_time(c: Column | str) -> Column:
    """Human display time (longer than 10 chars, contains a space)."""
    return F.date_format(_col(c), DISPLAY_FORMAT)


def helsinki_minute(c: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm`` of the instant in Helsinki time."""
    local = F.from_utc_timestamp(_col(c).cast("timestamp"), HELSINKI)
    return F.date_format(local, MINUTE_FORMAT)


def parse_bound(c: Column | str, zone: str = HELSINKI) -> Column:
    """A range bound from text: ISO instant, else ISO date (start of that day
    in ``zone``), else ISO date-time with offset. Absent → value and error null;
    present but unparseable → value null and an error message.
    """
    c = F.trim(_col(c))
    as_instant = iso_instant_parse(c)
    as_date = F.when(
        c.rlike(ISO_LOCAL_DATE_RE),
        F.to_utc_timestamp(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), zone).cast("timestamp_ntz"),
    )
    as_offset = F.when(c.rlike(ISO_OFFSET_DATE_TIME_RE), F.try_to_timestamp(c).cast("timestamp_ntz"))
    value = F.coalesce(as_instant, as_date, as_offset)
    error = F.when(c.isNotNull() & value.isNull(), F.concat(F.lit("Invalid instant: '"), c, F.lit("'.")))
    return F.struct(value.alias("value"), error.alias("error"))


def default_range(from_: Column | str, to: Column | str, now: Column | str) -> Column:
    """Missing ``from`` → now − 48 h (even when only ``to`` is given); ``to`` stays open."""
    now = _col(now)
    start = F.coalesce(_col(from_), now - F.expr(f"INTERVAL {DEFAULT_LOOKBACK_HOURS} HOURS"))
    return F.struct(start.cast("timestamp_ntz").alias("from"), _col(to).alias("to"))


def recent_range(now: Column | str) -> Column:
    """The last five minutes: from = now − 5 min, open end."""
    start = _col(now) - F.expr(f"INTERVAL {RECENT_MINUTES} MINUTES")
    return F.struct(start.cast("timestamp_ntz").alias("from"), F.lit(None).cast("timestamp_ntz").alias("to"))


def range_text(from_: Column | str, to: Column | str) -> Column:
    """``[f - t]``, ``(- t]``, ``[f -)`` or empty, with ISO instants."""
    f, t = iso_instant_format(_col(from_)), iso_instant_format(_col(to))
    return (
        F.when(f.isNotNull() & t.isNotNull(), F.concat(F.lit("["), f, F.lit(" - "), t, F.lit("]")))
        .when(t.isNotNull(), F.concat(F.lit("(- "), t, F.lit("]")))
        .when(f.isNotNull(), F.concat(F.lit("["), f, F.lit(" -)")))
        .otherwise(F.lit(""))
    )
