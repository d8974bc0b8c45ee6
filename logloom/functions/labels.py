"""Localized labels as a small table (language, key, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values (must equal the reference): supported languages and the default.
LANGUAGES = ("en-US", "sv-SE", "fi-FI")
DEFAULT_LANGUAGE = "en-US"
# Finnish has no texts of its own and falls back to English.
FALLBACK = {"fi-FI": "en-US"}

# Fixed values (must equal the reference): result-table, query-summary,
# paging and source-table labels in English and Swedish, in the order
# app, time, message, logger, thread, client, userAgent, level, noResults,
# query, apps, queryLevel, limit, offset, queryTime, starting, until, between,
# navigation, next, previous, servers title, servers app, address, userAgent,
# id, joined, unknown.
LABELS = {
    "en-US": {
        "app": "App", "time": "Time", "message": "Message", "logger": "Logger", "thread": "Thread",
        "client": "Client", "userAgent": "User Agent", "level": "Level", "noResults": "No results for",
        "query": "query", "apps": "apps", "queryLevel": "level", "limit": "limit", "offset": "offset",
        "queryTime": "time", "starting": "starting", "until": "until", "between": "between",
        "navigation": "Navigation", "next": "Next", "previous": "Previous",
        "servers.title": "Servers", "servers.app": "App", "servers.address": "Address",
        "servers.userAgent": "User-Agent", "servers.id": "ID", "servers.joined": "Joined",
        "servers.unknown": "Unknown",
    },
    "sv-SE": {
        "app": "App", "time": "Tid", "message": "Meddelande", "logger": "Loggare", "thread": "Tråd",
        "client": "Klient", "userAgent": "Agent", "level": "Nivå", "noResults": "Inga resultat för",
        "query": "sökord", "apps": "appar", "queryLevel": "nivå", "limit": "högst", "offset": "hoppa över",
        "queryTime": "tid", "starting": "från", "until": "tills", "between": "mellan",
        "navigation": "Navigering", "next": "Följande", "previous": "Föregående",
        "servers.title": "Servrar", "servers.app": "App", "servers.address": "Adress",
        "servers.userAgent": "User-Agent", "servers.id": "ID", "servers.joined": "Kopplade",
        "servers.unknown": "Okänd",
    },
}


def label_rows() -> list[tuple[str, str, str]]:
    """(language, key, text) for every supported language, fallbacks resolved."""
    out = []
    for lang in LANGUAGES:
        texts = LABELS[FALLBACK.get(lang, lang)]
        out += [(lang, k, v) for k, v in texts.items()]
    return out


def labels_table(spark: SparkSession) -> DataFrame:
    """The label table: a fixed, small set of rows (safe to broadcast)."""
    return spark.createDataFrame(label_rows(), "language string, key string, text string")


def language_or_default(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(list(LANGUAGES)), c).otherwise(F.lit(DEFAULT_LANGUAGE))


def localized_labels(df: DataFrame, labels: DataFrame, lang_col: str = "language",
                     prefix: str = "label_") -> DataFrame:
    """Attach the label texts of each row's language (unknown → English) as columns.

    ``labels`` is the fixed label table (a few dozen rows), broadcast.
    """
    keys = sorted(LABELS[DEFAULT_LANGUAGE])
    wide = labels.groupBy("language").pivot("key", keys).agg(F.first("text"))
    wide = wide.select(F.col("language").alias("__lang"),
                       *[F.col(f"`{k}`").alias(prefix + k.replace(".", "_")) for k in keys])
    keyed = df.withColumn("__lang", language_or_default(lang_col))
    return keyed.join(F.broadcast(wide), "__lang", "left").drop("__lang")
