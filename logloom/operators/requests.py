"""Per-request attributes of sources: address, host, client id, agent, origins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import clean_agent, clean_name, top_domain

# App-name endings that may get a client token, and the id alphabet.
PUBLISHABLE_SUFFIXES = ("ios", "android", "web")
CLIENT_ID_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
CLIENT_ID_LENGTH = 7


def request_attributes(df: DataFrame) -> DataFrame:
    """Connection attributes from header columns.

    Input columns (strings, null when absent; a header's first value taken
    whole): x_forwarded_for, remote_addr, x_forwarded_host, uri_host, host,
    is_secure (bool), x_forwarded_proto, x_client_id, user_agent_header.
    """
    address = F.coalesce(F.col("x_forwarded_for"), F.col("remote_addr"), F.lit("unknown"))
    host = F.coalesce(F.col("x_forwarded_host"), F.col("uri_host"), F.col("host"), F.lit("localhost"))
    secure = F.coalesce(F.col("is_secure"), F.lit(False)) | F.coalesce(F.col("x_forwarded_proto") == "https", F.lit(False))
    return df.select(
        "*",
        address.alias("address"),
        host.alias("host_port"),
        secure.alias("secure"),
        clean_name("x_client_id").alias("client_id"),
        clean_agent("user_agent_header").alias("user_agent"),
        top_domain(host).alias("top_domain"),
    )


def publishable(app: Column | str) -> Column:
    app = F.col(app) if isinstance(app, str) else app
    return app.rlike("(" + "|".join(PUBLISHABLE_SUFFIXES) + ")$")


def publishable_apps(df: DataFrame, app_col: str = "app") -> DataFrame:
    """Only apps whose name ends with ios, android or web may get a client token."""
    return df.where(publishable(app_col))


def client_id(key: Column | str, seed: int = 0) -> Column:
    """A 7-char id over ``[a-z0-9]``: the i-th character is picked by the i-th
    four hex digits of md5(``key``:``seed``) (repeatable for the same seed; a
    new seed gives new ids)."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    chars = [F.substring(F.lit(CLIENT_ID_ALPHABET),
                         F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("int") % len(CLIENT_ID_ALPHABET) + 1, F.lit(1))
             for i in range(CLIENT_ID_LENGTH)]
    return F.concat(*chars)


def assign_client_id(df: DataFrame, key_col: str, seed: int = 0) -> DataFrame:
    return df.withColumn("client_id", client_id(key_col, seed))


def allowed_origins(df: DataFrame, domains: DataFrame | Sequence[str], prod: bool = True,
                    origin_col: str = "origin") -> DataFrame:
    """Flag requests whose origin is ``https://<listed domain>``; outside
    production every origin is allowed. ``domains`` is a list or a one-column
    (``domain``) table; a table is semi-joined (broadcast only when small)."""
    if not prod:
        return df.withColumn("allowed", F.lit(True))
    if not isinstance(domains, DataFrame):
        allowed = F.col(origin_col).isin([f"https://{d}" for d in domains])
        return df.withColumn("allowed", F.coalesce(allowed, F.lit(False)))
    keys = domains.select(F.concat(F.lit("https://"), F.col("domain")).alias("__origin")).distinct() \
                  .withColumn("__hit", F.lit(True))
    if keys.count() <= 1_000_000:
        keys = F.broadcast(keys)
    joined = df.join(keys, F.col(origin_col) == F.col("__origin"), "left")
    return joined.withColumn("allowed", F.coalesce("__hit", F.lit(False))).drop("__origin", "__hit")
