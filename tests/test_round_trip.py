"""Ids, files, compaction, streams over several micro-batches, names and frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logloom.functions.text import clean_agent, clean_name, is_blank
from logloom.operators import filters as flt
from logloom.operators import ingest as ing
from logloom.operators import search as srch
from logloom.operators import views as vw
from logloom.operators.joins import checked_join, fits_broadcast, table_size
from logloom.session import fresh_path, list_names
from logloom.sources import store
from logloom.streaming import streams as st

DAY = dt.datetime(2024, 2, 1)
ROW = "batch_id long, pos long, app string, address string, timestamp timestamp_ntz, message string, logger string, " \
      "thread string, level int, client string, user_agent string, stacktrace string"


def events(spark, batch, n, app="a"):
    return spark.createDataFrame([(batch, i, app, "x", DAY, f"m{i}", "l", "t", 30, None, None, None) for i in range(n)], ROW)


def run(q):
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None


def data_files(spark, path):
    return store.read_stored(spark, path).select(F.input_file_name()).distinct().count()


def test_ids_stay_unique_around_a_bulk_load(spark):
    path = fresh_path(spark, "t")
    ing.append_logs(events(spark, 1, 4), path, batch=1, added=DAY)
    bulk = events(spark, 0, 4).select((F.col("pos") + 100).alias("id"), "*").withColumn("added", F.lit(DAY))
    store.write_logs(bulk, path, batch=7)
    assert ing.next_id_base(spark, path) == 103
    out = ing.append_logs(events(spark, 2, 3), path, batch=2, added=DAY).collect()
    assert sorted(r.id for r in out) == [104, 105, 106]
    ids = [r.id for r in store.scan_logs(spark, path).collect()]
    assert len(ids) == len(set(ids)) == 11


def test_small_appends_write_one_file_and_compact(spark):
    path, days = fresh_path(spark, "t"), (DAY, DAY + dt.timedelta(days=1))
    for b in range(6):
        ing.append_logs(events(spark, b, 10), path, batch=b, added=days[b % 2])
    assert data_files(spark, path) == 6
    before = sorted(map(tuple, store.scan_logs(spark, path).collect()))
    assert store.compact_logs(spark, path, DAY.date(), 4) == 3
    assert store.compact_logs(spark, path, DAY.date(), 4) == 0
    assert data_files(spark, path) == 4
    assert sorted(map(tuple, store.scan_logs(spark, path).collect())) == before
    plan = store.scan_logs(spark, path).where(F.col("added_date") == F.lit(DAY.date()))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(added_date" in plan


def test_a_replayed_batch_on_another_day_leaves_nothing_behind(spark):
    path = fresh_path(spark, "t")
    ing.append_logs(events(spark, 1, 5), path, batch=1, added=DAY)
    ing.append_logs(events(spark, 1, 5), path, batch=1, added=DAY + dt.timedelta(days=1))
    assert sorted(r.id for r in store.scan_logs(spark, path).collect()) == [1, 2, 3, 4, 5]


def test_ingest_stream_ids_and_rejects(spark):
    inbox, table, updates, index = (fresh_path(spark, k) for k in ("in", "t", "u", "i"))
    event = '{"timestamp": 1704067200000, "message": "hello %s", "loggerName": "l", "threadName": "t", "level": "info"}'
    apps = ["a", " a\t", "\t \n", "nobody", "a", "a"]
    for k, app in enumerate(apps):
        raw = '{"events": [' + ", ".join(event % f"word{k}x{i}" for i in range(3)) + "]}"
        spark.createDataFrame([(k, raw, app, "x", None, None)],
                              "batch_id long, raw string, app string, address string, client string, user_agent string") \
            .coalesce(1).write.mode("append").parquet(inbox)
    known = spark.createDataFrame([("a",)], "app string")
    run(st.ingest_stream(st.file_stream(spark, inbox, max_files=2), table, updates, fresh_path(spark, "c"),
                         available_now=True, apps=known, index=index))
    rows = spark.read.parquet(updates).withColumn("epoch", F.col("epoch")).collect()
    assert sorted(r.id for r in rows) == list(range(1, 13))
    ordered = sorted(rows, key=lambda r: r.id)
    assert [r.epoch for r in ordered] == sorted(r.epoch for r in rows)
    for e in {r.epoch for r in rows}:
        mine = [(r.batch_id, r.pos) for r in ordered if r.epoch == e]
        assert mine == sorted(mine)
    assert {r.app for r in rows} == {"a"}
    rejected = {r.batch_id: r.reason for r in spark.read.parquet(f"{updates}/_rejected").collect()}
    assert rejected == {2: "App name must not be blank.", 3: "Unknown app."}
    found = flt.search_index(spark.read.parquet(index), store.scan_logs(spark, table), "word1x2").collect()
    assert [r.message for r in found] == ["hello word1x2"]
    spec = flt.SearchSpec(query="word5x0", limit=5)
    assert [r.message for r in srch.history_search(store.scan_logs(spark, table), spec, index=spark.read.parquet(index)).collect()] \
        == ["hello word5x0"]


def test_tail_dedupe_keeps_late_rows(spark):
    inbox, out, ckpt = (fresh_path(spark, k) for k in ("in", "o", "c"))
    batches = [[(1, DAY)], [(2, DAY)], [(3, DAY - dt.timedelta(days=1))], [(2, DAY), (4, None), (3, DAY - dt.timedelta(days=1))], [(4, None)]]
    for b in batches:
        spark.createDataFrame(b, "id long, added timestamp_ntz").coalesce(1).write.mode("append").parquet(inbox)
        run(st.tail_dedupe(st.file_stream(spark, inbox, max_files=1), out, ckpt, available_now=True))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_tail_dedupe_across_days_and_replays(spark, monkeypatch):
    """An id comes again with another time; the index of keys is merged; the
    last micro-batch is replayed after its keys were merged."""
    monkeypatch.setattr(st, "KEYS_MERGED", 3)
    inbox, out, ckpt = (fresh_path(spark, k) for k in ("in", "o", "c"))
    step = dt.timedelta(days=1)
    batches = [[(1, DAY), (2, DAY)], [(1, DAY + step), (3, DAY)], [(9, DAY), (3, DAY - step)], [(2, DAY + 2 * step)],
               [(4, None), (9, None)], [(5, DAY)], [(5, DAY + step), (6, DAY)], [(1, DAY), (7, DAY)], [(8, DAY)], [(8, DAY), (10, DAY)]]
    for b in batches:
        spark.createDataFrame(b, "id long, added timestamp_ntz").coalesce(1).write.mode("append").parquet(inbox)
        run(st.tail_dedupe(st.file_stream(spark, inbox, max_files=1), out, ckpt, available_now=True))
    rows = spark.read.parquet(out).collect()
    assert sorted(r.id for r in rows) == list(range(1, 11))
    assert next(r for r in rows if r.id == 1).added == DAY
    names = list_names(spark, f"{out}/_keys")
    assert len(names) <= 6 and any(n.startswith("2-") for n in names)
    # The last micro-batch again, with nothing of its commit left.
    fs, last = spark.sparkContext._jvm.org.apache.hadoop.fs, len(batches) - 1
    for name in (str(last), f".{last}.crc"):
        path = fs.Path(f"{ckpt}/commits/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)
    run(st.tail_dedupe(st.file_stream(spark, inbox, max_files=1), out, ckpt, available_now=True))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(1, 11))


def test_presence_state_shrinks(spark):
    inbox, out, ckpt = (fresh_path(spark, k) for k in ("in", "o", "c"))
    schema = "seq long, conn_id long, app string, action string"
    steps = [([(1, 1, "a", "joined"), (3, 3, "a", "joined")], {1, 3}), ([(4, 1, "a", "left"), (6, 5, "b", "left")], {3}),
             ([(5, 5, "b", "joined"), (7, 7, "b", "joined")], {3, 7}), ([(8, 3, "a", "left"), (9, 7, "b", "left")], set())]
    for rows, connected in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        run(st.presence_stream(st.file_stream(spark, inbox, max_files=1), out, ckpt, available_now=True))
        assert {r.conn_id for r in st.presence_current(spark, out).collect()} == connected
    state, base, _ = st.presence_state(spark, out)
    assert base is None and st.presence_merge(state).count() == 0


def test_presence_bases_replace_changes(spark, monkeypatch):
    """Bytes written follow the events: a base is written only when the changes
    outgrow the one before, and holds open connections only."""
    monkeypatch.setattr(st, "CHANGES_SLACK", 8)
    inbox, out, ckpt = (fresh_path(spark, k) for k in ("in", "o", "c"))
    schema, seq, bases = "seq long, conn_id long, app string, action string", 0, []
    open_now = set()
    for step in range(12):
        rows = []
        for conn in range(step * 5, step * 5 + 5):
            rows.append((seq := seq + 1, conn, "a", "joined"))
            open_now.add(conn)
        for conn in [c for c in sorted(open_now) if c % 5 < 3 and c < step * 5]:
            rows.append((seq := seq + 1, conn, "a", "left"))
            open_now.discard(conn)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        run(st.presence_stream(st.file_stream(spark, inbox, max_files=1), out, ckpt, available_now=True))
        assert {r.conn_id for r in st.presence_current(spark, out).collect()} == open_now
        bases.append(st.presence_state(spark, out)[1])
    written = [b for b in dict.fromkeys(bases) if b is not None]
    assert 2 <= len(written) <= 6
    names = list_names(spark, f"{out}/state")
    assert sum(n.startswith("base=") for n in names) <= st.BASES_KEPT
    assert min(int(n.split("=")[1]) for n in names) >= written[-2]
    assert spark.read.parquet(f"{out}/state/base={written[-1]}").where("left_seq is not null").count() == 0


def test_viewers_may_join_later(spark):
    inbox, out, ckpt, viewers = (fresh_path(spark, k) for k in ("in", "o", "c", "v"))
    schema = "spec_id long, apps array<string>, min_level int, from_ts timestamp_ntz, to_ts timestamp_ntz, lim int, off int, ord string, q string"
    for step, viewer in enumerate(((1, ["a"]), (2, []))):
        spark.createDataFrame([(viewer[0], viewer[1], 10, None, None, 10, 0, "desc", None)], schema).write.mode("append").parquet(viewers)
        spark.createDataFrame([(10 * step + i, app, 30) for i, app in enumerate(("a", "b"))], "id long, app string, level int") \
            .coalesce(1).write.mode("append").parquet(inbox)
        run(st.route_stream(st.file_stream(spark, inbox), lambda: spark.read.parquet(viewers), out, ckpt, available_now=True))
    got = sorted((r.spec_id, r.id) for r in spark.read.parquet(out).collect())
    assert got == [(1, 0), (1, 10), (2, 10), (2, 11)]


def test_one_scan_for_many_viewers(spark):
    import __spark_entry__ as entry
    from conftest import SF_SMALL

    for name, scans in (("history_many", 1), ("route_events", 1)):
        plan = entry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("] parquet") == scans, plan


def test_sort_operators_order_rows(spark):
    df = spark.createDataFrame([(i, i * 7 % 5 * 10 + 10, DAY + dt.timedelta(hours=i * 3 % 4)) for i in range(40)],
                               "id long, level int, added timestamp_ntz")
    for order in ("asc", "desc"):
        keys = [(r.added, r.id) for r in srch.sort_added(df, order).collect()]
        assert keys == sorted(keys, reverse=order == "desc")
    for up in (True, False):
        keys = [(r.level, r.id) for r in srch.sort_severity(df, up).collect()]
        assert keys == sorted(keys, reverse=not up)


def test_names_are_trimmed_like_the_protocol(spark):
    texts = ["\tapp\n", "\t", " ", "", None, "a b", " ", "\x01x\x1f", " x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(clean_name("t").alias("n"), is_blank("t").alias("b"), clean_agent(F.repeat("t", 60)).alias("a")).collect()
    assert [r.n for r in got] == ["app", None, None, None, None, "a b", None, "x", " x"]
    assert [r.b for r in got] == [False, True, True, True, None, False, True, False, False]
    assert all(r.a is None or len(r.a) <= 100 for r in got)


@pytest.mark.parametrize("admin", [False, True])
def test_frames_with_wrong_fields(spark, admin):
    frames = ['{"sources":[{"bogus":1}]}', '{"event":"events","events":[1,2]}', '{"event":"loading","meta":5}', '{"event":5}', "x", None]
    out = vw.decode_frames(spark.createDataFrame([(f,) for f in frames], "json string"), admin=admin).collect()
    assert [(r.kind, r.frame_event) for r in out] == [("simple", "events"), ("simple", "loading")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_one(spark, how):
    big = spark.range(500).withColumn("k", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7))
    small = spark.createDataFrame([(0, "x"), (0, "y"), (3, "z")], "k long, v string")
    want = sorted(map(repr, big.join(small, ["k"], how).collect()))
    assert sorted(map(repr, checked_join(big, small, ["k"], how, max_rows=1).select(
        *big.join(small, ["k"], how).columns).collect())) == want


def test_broadcasts_are_bounded_in_bytes(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.lit("yy")).alias("a"))
    rows, size = table_size(wide)
    assert rows == 10 and 10_000 <= size <= 11_000
    assert fits_broadcast(wide) and not fits_broadcast(wide, (10, 1 << 40))
