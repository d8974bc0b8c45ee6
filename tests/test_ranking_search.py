"""Ranking helpers against brute force (with a hot group), and searches."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from logloom.operators import ranking as rk
from logloom.operators import search as srch
from logloom.operators.filters import SearchSpec


def skewed(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{rnd.randrange(20)}"  # a third of the rows in one group
        rows.append((i, g, rnd.randrange(50), rnd.randrange(-5, 6)))
    return spark.createDataFrame(rows, "id long, g string, k long, v long")


def test_range_rank_matches_row_number(spark):
    df = skewed(spark)
    got = rk.range_rank(df, ["g"], [F.col("k"), F.col("id")], "r").toPandas()
    pdf = df.toPandas().sort_values(["g", "k", "id"])
    pdf["r"] = pdf.groupby("g").cumcount() + 1
    m = got.merge(pdf, on=["id"], suffixes=("", "_ref"))
    assert len(m) == len(pdf) and (m["r"] == m["r_ref"]).all()


def test_range_cumsum_matches_pandas(spark):
    df = skewed(spark)
    got = rk.range_cumsum(df, ["g"], [F.col("id")], F.col("v"), "c").toPandas()
    pdf = df.toPandas().sort_values(["g", "id"])
    pdf["c"] = pdf.groupby("g")["v"].cumsum()
    m = got.merge(pdf, on="id", suffixes=("", "_ref"))
    assert len(m) == len(pdf) and (m["c"] == m["c_ref"]).all()


def test_top_rows_per_group_matches_brute_force(spark):
    df = skewed(spark).withColumn("lo", F.when(F.col("g") == "hot", 5).otherwise(0)) \
                      .withColumn("hi", F.when(F.col("g") == "hot", 40).otherwise(3))
    got = rk.top_rows_per_group(df.repartition(40), ["g"], [F.col("k").desc(), F.col("id")], F.col("lo"),
                                F.col("hi"), k=40, rank_col="r", fanout=3).toPandas()
    pdf = df.toPandas().sort_values(["g", "k", "id"], ascending=[True, False, True])
    pdf["r"] = pdf.groupby("g").cumcount() + 1
    ref = pdf[(pdf.r > pdf.lo) & (pdf.r <= pdf.hi)]
    assert sorted(zip(got.id, got.r)) == sorted(zip(ref.id, ref.r))


def logs_frame(spark):
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        rows.append((i, f"app{i % 3}", "10.0.0.1", base + dt.timedelta(minutes=i), f"msg k{i % 7}", "lg", "t",
                     [10, 20, 30, 40, 50, 60][i % 6], None, None, None, base + dt.timedelta(hours=i // 30)))
    schema = ("id long, app string, address string, timestamp timestamp_ntz, message string, logger string, "
              "thread string, level int, client string, user_agent string, stacktrace string, added timestamp_ntz")
    return spark.createDataFrame(rows, schema)


def brute(pdf: pd.DataFrame, apps, min_level, f, t, lim, off, order):
    d = pdf[pdf.level >= min_level]
    if apps:
        d = d[d.app.isin(apps)]
    if f is not None:
        d = d[d.added >= f]
    if t is not None:
        d = d[d.added <= t]
    d = d.sort_values(["added", "id"], ascending=order == "asc")
    return list(d.id.iloc[off:off + lim])


def test_history_search_and_many_match_brute_force(spark):
    logs = logs_frame(spark)
    pdf = logs.toPandas()
    specs = [
        (1, ["app1"], 30, dt.datetime(2024, 1, 1, 2), None, 7, 2, "desc"),
        (2, [], 10, None, dt.datetime(2024, 1, 1, 9), 500, 0, "asc"),
        (3, ["nope"], 10, None, None, 10, 0, "desc"),
        (4, ["app0", "app2"], 50, None, None, 0, 0, "asc"),
    ]
    sdf = spark.createDataFrame([s + (None,) for s in specs],
                                "spec_id long, apps array<string>, min_level int, from_ts timestamp_ntz, "
                                "to_ts timestamp_ntz, lim int, off int, ord string, q string")
    many = srch.history_many(logs, sdf).toPandas()
    for sid, apps, lvl, f, t, lim, off, order in specs:
        ref = brute(pdf, apps, lvl, f, t, lim, off, order)
        got = list(many[many.spec_id == sid].sort_values("rank").id)
        assert got == ref, sid
        one = srch.history_search(logs, SearchSpec(apps=tuple(apps), level=lvl, from_=f, to=t, limit=lim,
                                                   offset=off, order=order)).toPandas()
        assert list(one.id) == ref, sid
    seq = srch.history_or_nodata(logs, sdf).toPandas()
    assert list(seq[seq.spec_id == 3].kind) == ["noData"]
    s1 = seq[seq.spec_id == 1].sort_values("seq")
    assert list(s1.id) == list(reversed(brute(pdf, ["app1"], 30, dt.datetime(2024, 1, 1, 2), None, 7, 2, "desc")))


def test_page_links_step_is_fixed(spark):
    df = spark.createDataFrame([(1, 0), (2, 499), (3, 500), (4, 1200)], "spec_id long, off int")
    got = {r.spec_id: (r.prev_offset, r.next_offset) for r in srch.page_links(df).collect()}
    assert got == {1: (None, 500), 2: (None, 999), 3: (0, 1000), 4: (700, 1700)}


def test_salted_join_equals_broadcast_join(spark):
    from logloom.operators.joins import checked_join

    big = skewed(spark).withColumnRenamed("g", "key")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("g3", 3), ("zz", 4)], "key string, tag long")
    for how in ("inner", "left_semi", "left_anti"):
        a = checked_join(big, small, ["key"], how).toPandas()
        b = checked_join(big, small, ["key"], how, max_rows=0, salts=5).toPandas()
        cols = sorted(a.columns)
        assert sorted(map(tuple, a[cols].values.tolist())) == sorted(map(tuple, b[cols].values.tolist())), how


def test_history_head_loading_then_history_or_nodata(spark):
    from logloom.streaming.streams import history_head

    logs = logs_frame(spark)
    head = history_head(logs, SearchSpec(apps=("app1",), level=30, limit=3, order="desc")).toPandas()
    assert list(head.sort_values(["part", "seq"]).kind) == ["loading", "events", "events", "events"]
    newest = brute(logs.toPandas(), ["app1"], 30, None, None, 3, 0, "desc")
    assert list(head[head.part == 1].sort_values("seq").id) == list(reversed(newest))
    empty = history_head(logs, SearchSpec(apps=("nope",))).toPandas()
    assert list(empty.sort_values("part").kind) == ["loading", "noData"]


def test_route_events_matches_brute_force(spark):
    from logloom.operators.routing import route_events

    logs = logs_frame(spark).select("id", "app", "level")
    specs = [
        (1, ["app1"], 30, 0, None),       # app list, level floor
        (2, [], 50, 0, None),             # every app
        (3, ["APP1"], 10, 0, None),       # app names match case-sensitively
        (4, ["app2"], 10, 5, None),       # an offset: no live rows
        (5, ["app2"], 10, 0, "msg k3"),   # a text query: no live rows
    ]
    sdf = spark.createDataFrame([(i, a, lv, None, None, 10, off, "desc", q) for i, a, lv, off, q in specs],
                                "spec_id long, apps array<string>, min_level int, from_ts timestamp_ntz, "
                                "to_ts timestamp_ntz, lim int, off int, ord string, q string")
    got = sorted((r.spec_id, r.id) for r in route_events(logs, sdf).collect())
    pdf = logs.toPandas()
    want = []
    for i, apps, lv, off, q in specs:
        if off > 0 or (q is not None and len(q) >= 3):
            continue
        for r in pdf.itertuples():
            if r.level >= lv and (not apps or r.app in apps):
                want.append((i, r.id))
    assert got == sorted(want)
