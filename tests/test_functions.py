"""Scalar functions: host names, display time, levels, instants, bounds."""

import datetime as dt

from pyspark.sql import functions as F

from logloom.functions import levels as lv
from logloom.functions import text as tx
from logloom.functions import timefmt as tf


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("out")).first()[0]


def test_top_domain_examples(spark):
    cases = {"": "", "aa.b.com": "b.com", "aaa": "aaa", "ok.dom.com:443/aaa": "dom.com", "a.b.c..": "b.c"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = dict(df.select("x", tx.top_domain("x").alias("d")).collect())
    assert got == cases


def test_display_time_is_long_and_spaced(spark):
    out = one(spark, tf.display_time("x"), dt.datetime(2024, 3, 4, 5, 6, 7), "x timestamp_ntz")
    assert len(out) > 10 and " " in out


def test_level_names_round_trip(spark):
    df = spark.createDataFrame([(n, name.upper()) for name, n in lv.LEVELS] + [(70, "bogus")], "n int, s string")
    rows = df.select(lv.level_name("n").alias("name"), lv.level_int("s").alias("int"), "n").collect()
    for r in rows:
        if r.n == 70:
            assert r["name"] is None and r["int"] is None
        else:
            assert r["int"] == r.n and lv.LEVEL_BY_NAME[r["name"]] == r.n


def test_levels_at_least_is_an_in_list():
    assert lv.levels_at_least("warn") == [40, 50, 60]
    assert lv.levels_at_least(10) == [10, 20, 30, 40, 50, 60]


def test_iso_instant_parse_rejects_plain_dates(spark):
    assert one(spark, tf.iso_instant_parse("x"), "2024-01-01") is None
    assert one(spark, tf.iso_instant_parse("x"), "2024-01-01T10:00:00Z") == dt.datetime(2024, 1, 1, 10)
    assert one(spark, tf.iso_instant_parse("x"), "2024-01-01T10:00:00+02:00") == dt.datetime(2024, 1, 1, 8)


def test_iso_format_fraction(spark):
    assert one(spark, tf.iso_instant_format("x"), dt.datetime(2024, 1, 1, 1, 2, 3), "x timestamp_ntz") == \
        "2024-01-01T01:02:03Z"
    assert one(spark, tf.iso_instant_format("x"), dt.datetime(2024, 1, 1, 1, 2, 3, 45000), "x timestamp_ntz") == \
        "2024-01-01T01:02:03.045Z"


def test_parse_bound_date_is_helsinki_midnight(spark):
    b = one(spark, tf.parse_bound("x"), "2024-07-01")
    assert b["value"] == dt.datetime(2024, 6, 30, 21) and b["error"] is None
    b = one(spark, tf.parse_bound("x"), "nope")
    assert b["value"] is None and "nope" in b["error"]
    b = one(spark, tf.parse_bound("x"), None)
    assert b["value"] is None and b["error"] is None


def test_tokens_drop_short_and_stop_words(spark):
    out = one(spark, tx.tokens("x"), "The quick-brown fox, at www.example.com")
    assert out == ["quick", "brown", "fox", "example"]


def test_source_label(spark):
    df = spark.createDataFrame([("app", "c1"), ("app", None)], "a string, c string")
    assert [r[0] for r in df.select(tx.source_label("a", "c")).collect()] == ["app (c1)", "app"]


def test_clean_agent_trims_and_cuts(spark):
    assert one(spark, tx.clean_agent("x"), "   ") is None
    assert one(spark, tx.clean_agent("x"), "  " + "y" * 150) == "y" * 100
    assert one(spark, F.lit(1) + 1, "x") == 2


def test_filter_apps_case_option(spark):
    from logloom.operators.filters import filter_apps

    df = spark.createDataFrame([("App1",), ("app1",), ("app2",)], "app string")
    assert sorted(r.app for r in filter_apps(df, ["app1"]).collect()) == ["app1"]
    assert sorted(r.app for r in filter_apps(df, ["APP1"], ignore_case=True).collect()) == ["App1", "app1"]
    assert filter_apps(df, []).count() == 3
