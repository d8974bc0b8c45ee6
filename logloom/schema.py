"""Schemas of the stored log table and the in-flight records."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of the stored table; every read returns exactly these.
LOG_COLUMNS = [
    "id", "app", "address", "timestamp", "message", "logger", "thread",
    "level", "client", "user_agent", "stacktrace", "added",
]

LOGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("app", T.StringType(), False),
    T.StructField("address", T.StringType(), True),
    T.StructField("timestamp", T.TimestampNTZType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("logger", T.StringType(), True),
    T.StructField("thread", T.StringType(), True),
    T.StructField("level", T.IntegerType(), True),
    T.StructField("client", T.StringType(), True),
    T.StructField("user_agent", T.StringType(), True),
    T.StructField("stacktrace", T.StringType(), True),
    T.StructField("added", T.TimestampNTZType(), True),
])

# On disk the table is ``<table>/write=<name>/added_date=<yyyy-mm-dd>/``: a write
# fills a folder of its own, and the versions of the table say which day folders
# are live (see sources/versions.py). Rows carry the number of their ingest
# batch, so that a replayed batch is found inside a merged folder too.
PARTITION_COLUMN = "added_date"
BATCH_COLUMN = "batch"
WRITE_COLUMN = "write"
LOGS_STORED = T.StructType(list(LOGS.fields) + [
    T.StructField(BATCH_COLUMN, T.LongType(), True),
    T.StructField(WRITE_COLUMN, T.StringType(), True),
    T.StructField(PARTITION_COLUMN, T.DateType(), True),
])
