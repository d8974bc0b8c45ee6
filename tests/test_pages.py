"""Pages by counts and by postings, presence sets and sessions, each against
plain Python over the same rows."""

import datetime as dt
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.functions.levels import LEVEL_INTS
from logloom import session as flt_session
from logloom.operators import cells, joins, postings as post, presence as pr, routing as rt, search as srch
from logloom.operators import ingest as ing
from logloom.operators.filters import SearchSpec, query_words
from logloom.schema import LOG_COLUMNS
from logloom.session import fresh_path
from logloom.sources import store

START = dt.datetime(2024, 3, 1)
LOGS = "id long, app string, address string, timestamp timestamp_ntz, message string, logger string, thread string, " \
       "level int, client string, user_agent string, stacktrace string, added timestamp_ntz"
WORDS = ["purchase", "click", "timeout", "retry", "time", "clock", "zebra"]


def rows_of(n=3000, seed=1, untimed=False):
    """Three days; a third of the rows lie in one hour, many share their time."""
    rng, out = random.Random(seed), []
    for i in range(n):
        at = START + dt.timedelta(hours=30, minutes=rng.choice([0, 7, 7, 40])) if rng.random() < 0.33 \
            else START + dt.timedelta(minutes=10 * rng.randint(0, 432))
        if untimed and i % 50 == 0:
            at = None
        text = " ".join(rng.choice(WORDS) if rng.random() < 0.5 else f"n{rng.randint(0, 300)}" for _ in range(4))
        app = "hot" if rng.random() < 0.4 else f"app{rng.randint(0, 5)}"
        out.append((i + 1, app, "x", START, text, "l", "t", rng.choice(LEVEL_INTS), None, None, None, at))
    return out


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def logs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("logs"))
    spark.createDataFrame(rows, LOGS).repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def brute(rows, apps, level, lo, hi, off, lim, order, keep=lambda r: True):
    hits = [r for r in rows if (not apps or r[1] in apps) and r[7] >= level and keep(r)
            and (lo is None or r[11] and r[11] >= lo) and (hi is None or r[11] and r[11] <= hi)]
    hits.sort(key=lambda r: (r[11] or dt.datetime.min, r[0]), reverse=order == "desc")
    return [r[0] for r in hits[off:off + lim]]


def viewers(seed, n=120):
    rng, out = random.Random(seed), []
    at = lambda: START + dt.timedelta(minutes=rng.randint(-300, 4700))
    for i in range(n):
        lo, hi = (at() if rng.random() < 0.6 else None), (at() if rng.random() < 0.5 else None)
        if rng.random() < 0.2:
            lo = START + dt.timedelta(hours=30, minutes=7)  # in the midst of the hot hour
        if rng.random() < 0.2:
            hi = START + dt.timedelta(hours=30, minutes=7)
        out.append((i, rng.choice([[], ["hot"], ["hot", "app1", "hot"], ["app2", "none"], ["none"]]), rng.choice([10, 30, 60, 35]),
                    lo, hi, rng.choice([0, 1, 7, 40, 900]), rng.choice([0, 0, 3, 500, 2500, 9999]), rng.choice(["asc", "desc"]), None))
    out.append((n, None, None, None, None, 50, 5, None, None))
    return out


@pytest.mark.parametrize("unit", ["day", "hour"])
def test_pages_by_cells_equal_brute_force(spark, logs, rows, unit):
    specs = viewers(3)
    got = Counter()
    out = {}
    for r in cells.history_by_cells(logs, spark.createDataFrame(specs, srch.SPEC), unit=unit).collect():
        got[r.spec_id, r.rank] += 1
        out.setdefault(r.spec_id, []).append((r.rank, r.id))
    assert set(got.values()) == {1}
    for spec_id, apps, level, lo, hi, lim, off, order, _ in specs:
        want = brute(rows, apps or [], level or 10, lo, hi, off, lim, order or "desc")
        assert sorted(out.get(spec_id, [])) == [(off + 1 + i, x) for i, x in enumerate(want)], spec_id


def test_rows_without_a_time_come_before_all_others(spark):
    rows = rows_of(300, seed=5, untimed=True)
    logs = store.with_partition_column(spark.createDataFrame(rows, LOGS))
    specs = [(1, [], 10, None, None, 20, 0, "asc", None), (2, [], 10, None, None, 20, 290, "desc", None),
             (3, [], 10, START, None, 500, 0, "asc", None), (4, [], 10, None, START + dt.timedelta(days=9), 500, 0, "asc", None)]
    out = {}
    for r in cells.history_by_cells(logs, spark.createDataFrame(specs, srch.SPEC)).collect():
        out.setdefault(r.spec_id, []).append((r.rank, r.id))
    for spec_id, apps, level, lo, hi, lim, off, order, _ in specs:
        want = brute(rows, apps, level, lo, hi, off, lim, order)
        assert sorted(out[spec_id]) == [(off + 1 + i, x) for i, x in enumerate(want)]


def test_many_viewers_go_by_cells(spark, logs, monkeypatch):
    specs = [(*s[:5], min(s[5], 40), min(s[6], 500), *s[7:]) for s in viewers(4, 40)]
    specs += [(100 + i, [], 30, START, None, 9, 0, "desc", f"zebra n{i}") for i in range(3)]
    specs = spark.createDataFrame(specs, srch.SPEC)
    want = sorted(map(tuple, srch.history_many(logs, specs).collect()))
    monkeypatch.setattr(srch, "MANY_VIEWERS", 10)
    assert sorted(map(tuple, srch.history_many(logs, specs).collect())) == want
    assert srch.history_many(logs, specs.limit(0)).collect() == []
    assert srch.history_many(logs.limit(0), specs).collect() == []


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_deep_pages(spark, rows, monkeypatch, order):
    """The rows read lie around the page, whatever the offset."""
    path = fresh_path(spark, "t")
    store.write_logs(spark.createDataFrame(rows, LOGS), path, batch=0)
    logs, counts = store.scan_logs(spark, path), store.cell_counts(spark, path)
    seen, kept = {}, cells._kept
    monkeypatch.setattr(cells, "_kept", lambda df, kind: seen.setdefault(kind, kept(df, kind)))
    monkeypatch.setattr(srch, "DEEP_OFFSET", 100)
    spec = SearchSpec(apps=("hot", "app1", "app2"), level="debug", from_=START + dt.timedelta(hours=5, minutes=30),
                      limit=30, offset=700, order=order)
    for given in (counts, None):
        seen.clear()
        got = [r.id for r in srch.history_search(logs, spec, cells=given).collect()]
        assert got == brute(rows, spec.apps, 20, spec.from_, None, 700, 30, order)
        assert seen["touched"].count() <= 3 and seen["rows"].count() <= 2 * cells.BLOCK
    seen.clear()
    assert srch.history_search(logs, SearchSpec(level="trace", limit=10, offset=10**6)).collect() == []


def test_a_deep_offset_of_an_ordered_frame(spark, monkeypatch):
    df = spark.range(5000).withColumn("k", F.col("id") * 7919 % 5000)
    want = [r.id for r in srch.page(df, 20, 3000, [F.col("k").desc()]).collect()]
    monkeypatch.setattr(srch, "DEEP_OFFSET", 1000)
    assert [r.id for r in srch.page(df, 20, 3000, [F.col("k").desc()]).collect()] == want and len(want) == 20
    assert srch.page(df, 20, 9000, [F.col("k")]).collect() == []


def test_stored_cells_follow_the_table(spark, rows):
    path = fresh_path(spark, "t")
    frame = spark.createDataFrame(rows, LOGS)
    store.write_logs(frame.where("id <= 1000"), path, batch=0)
    source = frame.withColumns({"batch_id": F.lit(1), "pos": F.col("id")})

    def same():
        got = {(r.hour, r.app, r.level): r.n for r in store.cell_counts(spark, path).collect()}
        hour = F.date_trunc("hour", "added").cast("timestamp_ntz").alias("hour")
        want = {(r.hour, r.app, r.level): r["count"] for r in store.scan_logs(spark, path).groupBy(hour, "app", "level").count().collect()}
        assert got == want and sum(got.values()) == store.scan_logs(spark, path).count() > 0

    same()
    day = START + dt.timedelta(hours=30)
    for batch, k in ((1, 3), (2, 5), (1, 7)):
        ing.append_logs(source.where(f"id % {k} = 0"), path, batch=batch, added=day)
        same()
    assert store.compact_logs(spark, path, day.date(), 2) == 3
    same()
    ing.append_logs(source.where("id % 11 = 0"), path, batch=1, added=day)
    same()
    ing.append_logs(source.where("id < 0"), path, batch=0, added=day)
    same()


# -- postings


@pytest.fixture(scope="module")
def index(spark, logs, tmp_path_factory):
    """Two batches of postings in small blocks, the second one written twice."""
    path = str(tmp_path_factory.mktemp("postings"))
    for batch, keep in ((0, "id <= 2000"), (1, "id > 2000"), (1, "id > 2000")):
        post.append_postings(logs.where(keep), path, batch, block=16)
    return post.read_postings(spark, path)


def has_word(query, mode):
    words = query_words(query)

    def test(r):
        own = query_words(f"{r[1]} {r[2]} {r[4]} {r[5]} {r[6]}")
        return any(w in own if mode == "natural" else any(x.startswith(w) for x in own) for w in words)

    return test


@pytest.mark.parametrize("mode", ["natural", "prefix"])
def test_text_pages_equal_the_scan(logs, rows, index, mode):
    rng = random.Random(6)
    queries = ["purchase", "zebra click", "time", "n17 n23", "clo tim", "nothing here", "the of", "purchase click timeout retry"]
    for i, query in enumerate(queries * 2):
        spec = SearchSpec(apps=rng.choice([(), ("hot",), ("app1", "app3")]), level=rng.choice(["trace", "warn"]),
                          from_=rng.choice([None, START + dt.timedelta(hours=20)]), to=rng.choice([None, START + dt.timedelta(hours=30, minutes=7)]),
                          limit=rng.choice([5, 60]), offset=rng.choice([0, 11]), order=("asc", "desc")[i % 2], query=query)
        got = [r.id for r in srch.history_search(logs, spec, mode, postings=index).collect()]
        level = {"trace": 10, "warn": 40}[spec.level]
        assert got == brute(rows, spec.apps, level, spec.from_, spec.to, spec.offset, spec.limit, spec.order, has_word(query, mode)), spec


@pytest.mark.parametrize("mode", ["natural", "prefix"])
def test_all_matches_by_the_index(logs, rows, index, mode):
    for query in ("purchase zebra", "tim", "n12", "nothing"):
        got = sorted(r.id for r in post.search_postings(index, logs, query, mode).collect())
        assert got == [r[0] for r in rows if has_word(query, mode)(r)]
    assert post.search_postings(index, logs, "no", mode).count() == len(rows)


def test_a_page_of_a_hot_word_reads_its_first_blocks(index, rows):
    blocks = index.where(post.word_predicate("purchase"))
    total = blocks.count()
    assert total > 40 and blocks.agg(F.max("n")).first()[0] == 16
    for newest in (True, False):
        edge = post.horizon(blocks, 8, newest)
        read = blocks.where(F.col("hi") >= F.lit(edge) if newest else F.col("lo") <= F.lit(edge)).count()
        assert read <= 8 + 10 < total / 2
    ids, n = post.page_ids(index, SearchSpec(level="trace", limit=40, query="purchase"), first_blocks=1)
    assert n == 40 == ids.count()
    plan = index.where(post.word_predicate("purch", "prefix"))._jdf.queryExecution().toString()
    assert "StringStartsWith(token,purch)" in plan


def test_postings_of_a_hot_word_are_exact(logs, rows):
    found = post.postings(logs, block=16).where("token = 'purchase'").collect()
    ids = sorted((r.added, r.id) for b in found for r in b["rows"])
    assert ids == sorted((r[11], r[0]) for r in rows if has_word("purchase", "natural")(r))
    assert sorted(b.block for b in found) == list(range(len(found)))


def test_many_text_viewers_join_words(spark, logs, monkeypatch):
    rng = random.Random(8)
    specs = [(i, rng.choice([[], ["hot"], ["app1", "none"]]), rng.choice([10, 40]), rng.choice([None, START + dt.timedelta(hours=9)]),
              None, 30, rng.choice([0, 4]), rng.choice(["asc", "desc"]),
              rng.choice(["purchase click", "zebra purchase zebra", "n5 n6 n7", "the of", "no", None, "unheard"])) for i in range(40)]
    specs = spark.createDataFrame(specs, srch.SPEC)
    assert specs.where("length(q) >= 3").count() >= srch.MANY_TEXTS
    got = sorted(map(tuple, srch.history_many(logs, specs).collect()))
    monkeypatch.setattr(srch, "MANY_TEXTS", 1000)
    assert got == sorted(map(tuple, srch.history_many(logs, specs).collect())) and len(got) > 300


def test_an_index_is_dealt_by_its_words(spark, logs, tmp_path, monkeypatch):
    """A task sorts a bounded share of the words, however well the rows compress."""
    from logloom.operators import filters as flt

    monkeypatch.setattr(flt_session, "INDEX_PARTITION_BYTES", 4096)
    monkeypatch.setattr(post, "INDEX_PARTITION_BYTES", 4096)
    dated = store.with_partition_column(logs)
    post.append_postings(logs, str(tmp_path / "postings"), 0, block=16)
    flt.append_token_index(dated, str(tmp_path / "appended"), 0)
    flt.write_token_index(flt.token_index(logs), str(tmp_path / "written"))
    for name in ("postings", "appended", "written"):
        assert len(list((tmp_path / name).rglob("*.parquet"))) > 12, name
    want = sorted({(w, r[0]) for r in rows_of() for w in query_words(f"{r[1]} {r[2]} {r[4]} {r[5]} {r[6]}")})
    for name in ("appended", "written"):
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).select("token", "id").collect())) == want


# -- presence sets and sessions


def connections(n=800, seed=2, keep=0.3):
    """Joins and leaves of many connections, some of which never leave."""
    rng, out, open_now = random.Random(seed), [], []
    for seq in range(10, 10 + 3 * n, 3):
        if open_now and rng.random() > 0.5 + keep * (len(open_now) < 60) / 2:
            out.append((seq, open_now.pop(rng.randrange(len(open_now))), "a", "left"))
        else:
            out.append((seq, seq, f"app{rng.randint(0, 2)}", "joined"))
            open_now.append(seq)
    return out


@pytest.mark.parametrize("segment_events", [1, 100, 10_000])
def test_members_after_any_event(spark, segment_events):
    rows, path = connections(), fresh_path(spark, "p")
    events = spark.createDataFrame(rows, "seq long, conn_id long, app string, action string")
    pr.write_presence_log(events, path, segment_events)
    got = {}
    for r in pr.members_at(spark, path, events.where("seq % 2 = 0").select("seq")).collect():
        assert r.joined_seq == r.conn_id
        got.setdefault(r.seq, {})[r.conn_id] = r.app
    now, peak = {}, 0
    for seq, conn, app, action in rows:
        now = {**now, conn: app} if action == "joined" else {c: a for c, a in now.items() if c != conn}
        peak = max(peak, len(now))
        assert seq % 2 or got.get(seq, {}) == now
    stored = spark.read.parquet(f"{path}/bases").count()
    assert stored <= len(rows) and spark.read.parquet(f"{path}/deltas").count() == len(rows) and peak > 20


def test_sets_are_not_regrouped(spark):
    """Only what is stored is shuffled, not a row for each member of each set."""
    rows, path = connections(3000), fresh_path(spark, "p")
    events = spark.createDataFrame(rows, "seq long, conn_id long, app string, action string")
    pr.write_presence_log(events, path, 100)
    out = pr.members_at(spark, path, events.select("seq"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "asked" not in [p for line in plan.splitlines() if "hashpartitioning" in line for p in line.split("hashpartitioning(")[1].split("#")]
    assert out.count() > 10 * spark.read.parquet(f"{path}/deltas").count()
    assert sum(r.joined_seq == r.conn_id for r in out.collect()) == out.count()


def test_a_repeated_event_is_asked_once(spark):
    rows = [(s, c, "u", a) for s, c, a in ((1, 1, "joined"), (2, 2, "joined"), (3, 1, "left")) for _ in range(2)]
    path = fresh_path(spark, "p")
    events = spark.createDataFrame(rows, "seq long, conn_id long, app string, action string")
    pr.write_presence_log(events, path, 1)
    assert sorted(map(tuple, pr.members_at(spark, path, events.select("seq")).collect())) == [
        (1, 1, "u", 1), (2, 1, "u", 1), (2, 2, "u", 2), (3, 2, "u", 2)]


def test_snapshots_of_one_connection(spark):
    """No source, one source, no source."""
    path = fresh_path(spark, "p")
    events = spark.createDataFrame([(1, 7, "u", "joined"), (2, 7, "u", "left")], "seq long, conn_id long, app string, action string")
    pr.write_presence_log(events, path)
    assert [tuple(r) for r in pr.members_at(spark, path, events.select("seq")).collect()] == [(1, 7, "u", 1)]
    pr.write_presence_log(events.limit(0), f"{path}-0")
    assert pr.members_at(spark, f"{path}-0", events.select("seq")).collect() == []


def test_members_come_in_runs(spark, monkeypatch):
    """A connection's rows come together, by event, in slices of segments dealt to many tasks."""
    monkeypatch.setattr(pr, "STAYS_PER_TASK", 50)
    monkeypatch.setattr(pr, "SLICE", 16)
    rng, rows, live = random.Random(12), [], {}
    for seq in range(900):
        if live and rng.random() < 0.4:
            c = rng.choice(sorted(live))
            rows.append((seq, c, live.pop(c), "left"))
        else:
            live[seq] = f"app{seq % 3}"
            rows.append((seq, seq, live[seq], "joined"))
    path = fresh_path(spark, "p")
    events = spark.createDataFrame(rows, "seq long, conn_id long, app string, action string")
    pr.write_presence_log(events, path, 64)
    out = pr.members_at(spark, path, events.where("seq % 3 = 0").select("seq"))
    assert out.rdd.getNumPartitions() >= len(rows) // 50
    want, live = [], {}
    for seq, c, app, action in rows:
        if action == "joined":
            live[c] = app
        else:
            live.pop(c)
        want += [(seq, x, a, x) for x, a in live.items() if seq % 3 == 0]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    for part in out.rdd.glom().collect():
        runs = [list(g) for _, g in itertools.groupby(part, key=lambda r: r.conn_id)]
        assert all(a.seq < b.seq for run in runs for a, b in zip(run, run[1:]))
        assert len(runs) <= len(part) / 3 or len(part) < 20
    monkeypatch.setattr(pr, "LIST_EVENTS", 7)
    monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 0)
    assert sorted(map(tuple, pr.members_at(spark, path, events.where("seq % 3 = 0").select("seq")).collect())) == sorted(want)


SESSION = "session_id long, spec_id long, connected long, disconnected long, apps array<string>, min_level int, off int, q string"


def test_sessions_get_what_came_while_connected(spark):
    rng = random.Random(9)
    events = [(i, "hot" if rng.random() < 0.4 else f"app{i % 4}", rng.choice([*LEVEL_INTS, 25])) for i in range(-30, 700) if rng.random() < 0.9]
    sessions = []
    for s in range(150):
        lo = rng.choice([None, rng.randint(-60, 720)])
        hi = rng.choice([None, (lo or 0) + rng.choice([-1, 0, 1, 5, 64, 200, 2000])])
        sessions.append((s, s % 7, lo, hi, rng.choice([[], None, ["hot"], ["app1", "hot", "app1"], ["none"]]), rng.choice([10, 30, None]),
                         rng.choice([0, 0, 0, None, 500]), rng.choice([None, None, "ab", "abc"])))
    got = sorted((r.session_id, r.spec_id, r.id) for r in rt.route_sessions(
        spark.createDataFrame(events, "id long, app string, level int"), spark.createDataFrame(sessions, SESSION)).collect())
    want = sorted((s, v, i) for s, v, lo, hi, apps, level, off, q in sessions for i, app, lev in events
                  if (lo is None or i > lo) and (hi is None or i <= hi) and (not apps or app in apps) and lev in LEVEL_INTS
                  and lev >= (level or 10) and not off and (q is None or len(q) < 3))
    assert got == want and len(want) > 5000
    none = spark.createDataFrame([], "id long, app string, level int")
    assert rt.route_sessions(none, spark.createDataFrame(sessions, SESSION)).collect() == []


def test_a_session_is_cut_into_few_cells(spark):
    rng = random.Random(10)
    spans = [(a, b) for a, b in ((rng.randint(0, 4000), rng.randint(0, 4095)) for _ in range(300)) if a < b] + [(0, 4096), (5, 6), (0, 1)]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", rt._cover(F.col("a"), F.col("b"), 4).alias("c"))
    for r in df.collect():
        places = [p for c in r.c for p in range(c.place * 8 ** c["size"], (c.place + 1) * 8 ** c["size"])]
        assert sorted(places) == list(range(r.a, r.b)) and len(r.c) <= 4 * 16


def test_sessions_past_a_broadcast_are_not_copied(spark, monkeypatch):
    """A session has few cells among many events, and no copies of them when they are shuffled."""
    rng = random.Random(11)
    spans = [(s, s % 9, lo, lo + rng.choice([1, 1500, 9000]), [[], ["a"]][s % 2], 10, 0, None)
             for s, lo in enumerate(rng.randint(0, 60_000) for _ in range(400))]
    events = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("app"), F.lit(30).alias("level"))
    sessions = spark.createDataFrame(spans, SESSION)
    assert rt.session_keys(sessions, 0, 59_999, rt.CELL_EVENTS).count() <= 15 * len(spans)
    want = rt.route_sessions(events, sessions).groupBy("session_id").count().collect()
    monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 0)
    out = rt.route_sessions(events, sessions)
    assert "__salt" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(out.groupBy("session_id").count().collect()) == sorted(want) and len(want) > 300
    got = {r.session_id: r["count"] for r in want}
    for s, _, lo, hi, apps, *_ in spans:
        assert got.get(s, 0) == sum(not apps or i % 3 == 0 for i in range(lo + 1, min(hi, 59_999) + 1))


def test_pairs_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    """Few rows make many pairs: the tasks follow the pairs. Rows that come twice, without an app or a number, and more columns."""
    monkeypatch.setattr(rt, "PAIRS_PER_TASK", 10_000)
    rng = random.Random(13)
    events = [(rng.choice([None, *range(6000)]), rng.choice([None, "a", "b"]), rng.choice([10, 40, None, 45]), f"m{i % 50}") for i in range(3000)]
    spans = [(s, s % 9, rng.choice([None, rng.randint(-5, 5900)]), None, rng.choice([[], ["a"], ["b", "b", "a"]]), rng.choice([10, 30, None]), 0, None)
             for s in range(200)]
    out = rt.route_sessions(spark.createDataFrame(events, "id long, app string, level int, message string"), spark.createDataFrame(spans, SESSION))
    assert out.rdd.getNumPartitions() >= 20
    want = [(s, v, i, a, lev, m) for s, v, lo, _, apps, least, _, _ in spans for i, a, lev, m in events
            if i is not None and i > (-1 if lo is None else lo) and (not apps or a in apps) and lev in LEVEL_INTS and lev >= (least or 10)]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want)) and len(want) > 50_000


def test_sessions_meet_events_in_an_equi_join(spark):
    events = spark.createDataFrame([(1, "a", 30)], "id long, app string, level int")
    out = rt.route_sessions(events, spark.createDataFrame([(1, 1, 0, None, ["a"], 10, 0, None)], SESSION))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(out.columns) == ["app", "id", "level", "session_id", "spec_id"] and set(LOG_COLUMNS) > {"id", "app", "level"}
