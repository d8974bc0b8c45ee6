"""Versions of the stored table: replays before, during and after merges,
writers that meet, readers of older versions, failures at every step, and the
hand-over from history to tail."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logloom.operators import ingest as ing
from logloom.operators.filters import SearchSpec
from logloom.session import create_once, fresh_path, list_names, read_bytes
from logloom.sources import store, versions
from logloom.streaming import streams as st

DAY = dt.datetime(2024, 2, 1)
ROW = "batch_id long, pos long, app string, address string, timestamp timestamp_ntz, message string, logger string, " \
      "thread string, level int, client string, user_agent string, stacktrace string"


def events(spark, batch, n, app="a", level=30):
    return spark.createDataFrame([(batch, i, app, "x", DAY, f"{batch}-{i}", "l", "t", level, None, None, None) for i in range(n)], ROW)


def append(spark, path, batch, n=5, day=DAY, **more):
    return ing.append_logs(events(spark, batch, n, **more), path, batch=batch, added=day)


def messages(spark, path, **more):
    rows = store.scan_logs(spark, path, **more).collect()
    assert len({r.id for r in rows}) == len(rows)
    return sorted(r.message for r in rows)


def expected(*batches, n=5):
    return sorted(f"{b}-{i}" for b in batches for i in range(n))


@pytest.mark.parametrize("replayed", [1, 2, 3])
def test_replay_after_a_merge_keeps_each_row_once(spark, replayed):
    path = fresh_path(spark, "t")
    for b in (1, 2, 3):
        append(spark, path, b)
    assert store.compact_logs(spark, path, DAY.date(), 3) == 3
    for _ in range(2):
        append(spark, path, replayed)
        assert messages(spark, path) == expected(1, 2, 3)
    assert sorted(r.message for r in ing.read_batch(spark, path, replayed).collect()) == expected(replayed)
    # The next merge takes the replaced rows off the disk, too.
    assert store.compact_logs(spark, path, DAY.date(), 3) == 2
    assert messages(spark, path) == expected(1, 2, 3)
    assert not any(f.dropped for f in versions.load(spark, path).folders.values())
    append(spark, path, replayed, n=2)
    assert messages(spark, path) == sorted(expected(*{1, 2, 3} - {replayed}) + expected(replayed, n=2))


def test_a_replay_with_fewer_or_no_rows_or_on_another_day(spark):
    path = fresh_path(spark, "t")
    for b in (1, 2):
        append(spark, path, b)
    store.compact_logs(spark, path, DAY.date(), 2)
    append(spark, path, 1, n=0)
    assert messages(spark, path) == expected(2)
    append(spark, path, 1, day=DAY + dt.timedelta(days=3))
    assert messages(spark, path) == expected(1, 2)
    only = store.scan_logs(spark, path, days=("2024-02-02", None))
    assert sorted(r.message for r in only.collect()) == expected(1)


def test_a_replay_during_a_merge(spark, monkeypatch):
    """The batch is replayed when the merged folder is written, before it is published."""
    path, real, met = fresh_path(spark, "t"), versions.publish_merge, []
    for b in (1, 2, 3):
        append(spark, path, b)

    def meanwhile(*args):
        if not met:
            met.append(append(spark, path, 2))
        return real(*args)

    monkeypatch.setattr(versions, "publish_merge", meanwhile)
    assert store.compact_logs(spark, path, DAY.date(), 3) == 3
    assert met and messages(spark, path) == expected(1, 2, 3)


def test_an_append_during_a_merge_stays(spark, monkeypatch):
    path, real, met = fresh_path(spark, "t"), versions.publish_merge, []
    for b in (1, 2):
        append(spark, path, b)

    def meanwhile(*args):
        if not met:
            met.append(append(spark, path, 3))
        return real(*args)

    monkeypatch.setattr(versions, "publish_merge", meanwhile)
    assert store.compact_logs(spark, path, DAY.date(), 2) == 2
    assert messages(spark, path) == expected(1, 2, 3)
    assert len(versions.load(spark, path).folders) == 2


def test_two_writers_get_different_ids(spark, monkeypatch):
    path, real, met = fresh_path(spark, "t"), versions.publish_batch, []
    append(spark, path, 1)

    def meanwhile(spark_, path_, batch, *more):
        if batch == 2 and not met:
            met.append(append(spark, path, 3))
        return real(spark_, path_, batch, *more)

    monkeypatch.setattr(versions, "publish_batch", meanwhile)
    out = append(spark, path, 2).collect()
    assert met and messages(spark, path) == expected(1, 2, 3)
    assert sorted(r.id for r in out) == list(range(11, 16))
    with pytest.raises(versions.StaleIds):
        ing.append_logs(events(spark, 4, 2), path, batch=4, added=DAY, base=3)
    assert messages(spark, path) == expected(1, 2, 3)


@pytest.mark.parametrize("step", ["new_write", "written_folders", "publish_merge", "create_once"])
def test_a_merge_killed_at_any_step_changes_nothing(spark, monkeypatch, step):
    path = fresh_path(spark, "t")
    for b in (1, 2, 3):
        append(spark, path, b)
    append(spark, path, 2)

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, step, killed)
        with pytest.raises(KeyboardInterrupt):
            store.compact_logs(spark, path, DAY.date(), 3)
    assert messages(spark, path) == expected(1, 2, 3)
    append(spark, path, 3)
    assert store.compact_logs(spark, path, DAY.date(), 3) == 3
    assert messages(spark, path) == expected(1, 2, 3)


@pytest.mark.parametrize("step", ["written_folders", "publish_batch", "create_once"])
def test_an_append_killed_at_any_step_leaves_nothing(spark, monkeypatch, step):
    path = fresh_path(spark, "t")
    append(spark, path, 1)

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, step, killed)
        with pytest.raises(KeyboardInterrupt):
            append(spark, path, 2)
    assert messages(spark, path) == expected(1)
    assert sorted(r.id for r in append(spark, path, 2).collect()) == list(range(6, 11))
    gone = store.expire(spark, path, keep=1, grace_seconds=-60)
    assert len(gone) == 1 and messages(spark, path) == expected(1, 2)


def test_readers_keep_their_version(spark):
    path = fresh_path(spark, "t")
    for b in (1, 2):
        append(spark, path, b)
    opened, number = store.scan_logs(spark, path), store.cut(spark, path).version
    store.compact_logs(spark, path, DAY.date(), 2)
    append(spark, path, 3)
    append(spark, path, 1, n=1)
    assert sorted(r.message for r in opened.collect()) == expected(1, 2)
    assert messages(spark, path, version=number) == expected(1, 2)
    # Young folders stay; without grace, those of forgotten versions go.
    assert store.expire(spark, path, keep=1) == []
    assert len(store.expire(spark, path, keep=1, grace_seconds=-60)) == 2
    assert messages(spark, path) == sorted(expected(2, 3) + ["1-0"])


def test_expire_keeps_what_the_kept_versions_hold(spark):
    path, days = fresh_path(spark, "t"), (DAY, DAY + dt.timedelta(days=1))
    both = events(spark, 1, 4).withColumn("added", F.when(F.col("pos") < 2, F.lit(days[0])).otherwise(F.lit(days[1])))
    store.write_logs(both.withColumn("id", F.col("pos") + 1), path, batch=1)
    append(spark, path, 2)
    assert store.compact_logs(spark, path, DAY.date(), 2) == 2
    gone = store.expire(spark, path, keep=1, grace_seconds=-60)
    assert len(gone) == 2 and sum("/" in g for g in gone) == 1  # one day of the first write is still live
    assert messages(spark, path) == sorted(expected(1, n=4) + expected(2))


def test_many_versions_are_read_from_few_files(spark, monkeypatch):
    path, folders = fresh_path(spark, "t"), {}
    for b in range(70):
        f = versions.Folder(f"write=w{b}/added_date=2024-02-01", "2024-02-01", {b: 10 * b})
        versions.publish_batch(spark, path, b, [f])
        folders[f.path] = f
    read = []
    monkeypatch.setattr(versions, "read_bytes", lambda s, p: read.append(p) or read_bytes(s, p))
    cur = versions.load(spark, path)
    assert (cur.number, cur.folders, cur.largest_id(), cur.largest_id(69)) == (70, folders, 690, 680)
    assert len(read) <= versions.FULL_EVERY
    assert len(versions.load(spark, path, 33).folders) == 33
    versions.expire(spark, path, keep=2)
    assert versions.numbers(spark, path)[0] == 64 and versions.load(spark, path).folders == folders
    with pytest.raises(ValueError):
        versions.load(spark, path, 5)


def test_a_file_is_created_once(spark):
    path = f"{fresh_path(spark, 't')}/x/1"
    assert create_once(spark, path, b"one") and not create_once(spark, path, b"two")
    assert read_bytes(spark, path) == b"one" and list_names(spark, path.rsplit("/", 1)[0]) == ["1"]


def test_a_new_table_is_empty(spark):
    path = fresh_path(spark, "t")
    assert store.scan_logs(spark, path).collect() == [] and store.cut(spark, path) == store.Cut(0, 0)
    assert store.compact_logs(spark, path, DAY.date(), 9) == 0 and store.expire(spark, path) == []


# -- from history to tail


def run(q):
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None


def publish(spark, updates, rows):
    rows.coalesce(1).write.mode("append").parquet(updates)


def subscription(spark):
    return tuple(fresh_path(spark, k) for k in ("table", "updates", "out", "ckpt"))


def parts(spark, out):
    rows = spark.read.parquet(f"{out}/head").unionByName(spark.read.parquet(f"{out}/tail")).collect()
    return sorted((r.part, r.seq or 0, r.kind, r.id) for r in rows)


def test_stored_rows_off_the_page_never_come_as_live(spark):
    table, updates, out, ckpt = subscription(spark)
    publish(spark, updates, append(spark, table, 1, n=8))
    stream = st.file_stream(spark, updates)
    run(st.history_then_tail(spark, table, stream, SearchSpec(limit=3), out, ckpt, available_now=True))
    assert parts(spark, out) == [(0, 1, "loading", None), (1, 1, "events", 6), (1, 2, "events", 7), (1, 3, "events", 8)]


def test_rows_between_the_two_reads_come_once(spark, monkeypatch):
    """A batch is stored after the cut and before the page is read, another
    one later; a merge and a restart lie between them."""
    table, updates, out, ckpt = subscription(spark)
    publish(spark, updates, append(spark, table, 1, n=4))
    real, met = store.scan_logs, []

    def meanwhile(*args, **more):
        if not met:
            met.append(publish(spark, updates, append(spark, table, 2, n=2)))
        return real(*args, **more)

    with monkeypatch.context() as m:
        m.setattr(store, "scan_logs", meanwhile)
        run(st.history_then_tail(spark, table, st.file_stream(spark, updates), SearchSpec(limit=2), out, ckpt, available_now=True))
    first = [(0, 1, "loading", None), (1, 1, "events", 3), (1, 2, "events", 4), (2, 0, "events", 5), (2, 0, "events", 6)]
    assert met and parts(spark, out) == first
    store.compact_logs(spark, table, DAY.date(), 2)
    publish(spark, updates, append(spark, table, 3, n=1))
    run(st.history_then_tail(spark, table, st.file_stream(spark, updates), SearchSpec(limit=2), out, ckpt, available_now=True))
    assert parts(spark, out) == [*first, (2, 0, "events", 7)]


def test_no_history_is_no_data_then_live(spark):
    table, updates, out, ckpt = subscription(spark)
    publish(spark, updates, append(spark, table, 1, n=2))
    spec = SearchSpec(apps=("b",), limit=5)
    st.hand_over(spark, table, out)
    publish(spark, updates, append(spark, table, 2, n=1, app="b"))
    run(st.history_then_tail(spark, table, st.file_stream(spark, updates), spec, out, ckpt, available_now=True))
    assert parts(spark, out) == [(0, 1, "loading", None), (1, 1, "noData", None), (2, 0, "events", 3)]


def test_many_viewers_share_one_cut(spark):
    table, updates, out, ckpt = subscription(spark)
    publish(spark, updates, append(spark, table, 1, n=6))
    schema = "spec_id long, apps array<string>, min_level int, from_ts timestamp_ntz, to_ts timestamp_ntz, lim int, off int, ord string, q string"
    viewers = spark.createDataFrame([(1, [], 10, None, None, 2, 0, "desc", None), (2, ["b"], 40, None, None, 9, 0, "asc", None),
                                     (3, ["a"], 30, None, None, 3, 1, "asc", None)], schema)
    st.hand_over(spark, table, out)
    publish(spark, updates, append(spark, table, 2, n=2, app="b", level=50))
    stream = st.file_stream(spark, updates)
    run(st.tail_many(spark, table, stream.select("id", "app", "level"), viewers, out, ckpt, available_now=True))
    history = sorted((r.spec_id, r.id) for r in spark.read.parquet(f"{out}/history").collect())
    assert history == [(1, 5), (1, 6), (3, 2), (3, 3), (3, 4)]
    assert sorted((r.spec_id, r.id) for r in spark.read.parquet(f"{out}/tail").collect()) == [(1, 7), (1, 8), (2, 7), (2, 8)]
    plan = after_cut_plan(spark, updates, table, out)
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,6)" in plan


def after_cut_plan(spark, updates, table, out):
    rows = st.after_cut(spark.read.parquet(updates), st.hand_over(spark, table, out)).select("id", "app")
    return rows._jdf.queryExecution().toString()
