"""Reference-style end-to-end checks: a sent event reaches a listener, admins
see presence snapshots, apps authenticate; plus the driver contract."""

import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from logloom.operators import decode as dec
from logloom.operators import ingest as ing
from logloom.operators import presence as pr
from logloom.operators import registry as reg
from logloom.operators.filters import SearchSpec
from logloom.session import fresh_path
from logloom.streaming import streams as st


def test_sent_message_is_received_by_listener(spark):
    """One event sent by app ``u`` is stored and a listener on ``u`` gets it."""
    inbox, table, updates = fresh_path(spark, "in"), fresh_path(spark, "t"), fresh_path(spark, "u")
    msg = ('{"events":[{"message":"hello","loggerName":"lg","threadName":"th","level":"info",'
           '"timestamp":1704067200000}]}')
    spark.createDataFrame([(1, msg, "u", "127.0.0.1", None, "agent")],
                          "batch_id long, raw string, app string, address string, client string, user_agent string") \
        .write.parquet(inbox)
    q = st.ingest_stream(st.file_stream(spark, inbox), table, updates, fresh_path(spark, "c"), available_now=True)
    q.awaitTermination(600)
    stored = spark.read.parquet(updates)
    assert [(r.app, r.message, r.id) for r in stored.collect()] == [("u", "hello", 1)]
    out, ck = fresh_path(spark, "tail"), fresh_path(spark, "c")
    src = st.file_stream(spark, table, schema=stored.drop("batch_id", "pos").schema)
    q = st.live_tail(src, SearchSpec(apps=("u",)), out, ck, available_now=True)
    q.awaitTermination(600)
    got = spark.read.parquet(out).collect()
    assert [(r.app, r.message) for r in got] == [("u", "hello")]


def test_append_is_idempotent_and_ids_continue(spark):
    path = fresh_path(spark, "t")
    rows = spark.createDataFrame(
        [(b, p, "a", "x", dt.datetime(2024, 1, 1), f"m{b}{p}", "l", "t", 30, None, None, None)
         for b in range(3) for p in range(4)],
        "batch_id long, pos long, app string, address string, timestamp timestamp_ntz, message string, "
        "logger string, thread string, level int, client string, user_agent string, stacktrace string")
    first = ing.append_logs(rows, path, batch=0, added=dt.datetime(2024, 2, 1))
    assert sorted(r.id for r in first.collect()) == list(range(1, 13))
    again = ing.append_logs(rows, path, batch=0, added=dt.datetime(2024, 2, 1))
    assert sorted(r.id for r in again.collect()) == list(range(1, 13))
    nxt = ing.append_logs(rows.where("batch_id = 1"), path, batch=1, added=dt.datetime(2024, 2, 1))
    assert sorted(r.id for r in nxt.collect()) == list(range(13, 17))
    # a lower batch number written later still starts above every stored id
    low = ing.append_logs(rows.where("batch_id = 2"), path, batch=-5, added=dt.datetime(2024, 2, 1))
    assert sorted(r.id for r in low.collect()) == list(range(17, 21))
    # replaying the latest batch (as a retried micro-batch is), with the row
    # count known, writes the same ids and the same mark
    again = ing.append_logs(rows.where("batch_id = 2"), path, batch=-5, added=dt.datetime(2024, 2, 1), n_rows=4)
    assert sorted(r.id for r in again.collect()) == list(range(17, 21))
    assert ing.next_id_base(spark, path) == 20
    # replaying an older batch after newer ones keeps ids unique (new ones)
    old = ing.append_logs(rows.where("batch_id = 1"), path, batch=1, added=dt.datetime(2024, 2, 1))
    assert sorted(r.id for r in old.collect()) == list(range(21, 25))
    from logloom.sources.store import scan_logs
    assert scan_logs(spark, path).count() == 20
    assert scan_logs(spark, path).select("id").distinct().count() == 20


def test_admin_presence_snapshots_empty_one_empty(spark):
    ev = spark.createDataFrame([(1, 1, "u", "joined"), (2, 1, "u", "left")], "seq long, conn_id long, app string, action string")
    sizes = [r.n_connected for r in pr.presence_changes(ev).orderBy("seq").collect()]
    assert [0] + sizes == [0, 1, 0]
    assert pr.presence_now(ev).count() == 0
    assert pr.presence_now(ev.where("seq = 1")).count() == 1


def test_credentials(spark):
    apps = spark.createDataFrame([("u", None)], "app string, pass_hash string")
    added = reg.registry_add(apps.limit(0), spark.createDataFrame([("u", "pw", 1)], "app string, password string, seq long"))
    table = added.where("kind = 'table'").select("app", "pass_hash")
    reqs = spark.createDataFrame([("u", "pw"), ("u", "bad"), ("u1", "pw")], "user string, password string")
    got = {(r.user, r.password): r.valid for r in reg.credential_check(reqs, table).collect()}
    assert got == {("u", "pw"): True, ("u", "bad"): False, ("u1", "pw"): False}


def test_one_log_of_registry_requests(spark):
    """Every outcome, and the registry after it, equal applying the requests one by one."""
    rng = random.Random(11)
    known = {f"a{i}": f"h{i}" for i in range(4)}
    with_logs = {"a1", "a2", "a7"}
    requests = [(seq * 3, rng.choice(["add", "update", "remove", "remove", "check", None]), rng.choice(["a1", "hot", "hot", f"a{rng.randint(0, 9)}", None]),
                 f"p{seq}") for seq in range(600)]
    state, want = dict(known), []
    for seq, op, app, password in requests:
        new = hashlib.md5(f"{app}:{password}".encode()).hexdigest()
        if app is None or op not in ("add", "update", "remove"):
            continue
        if op == "add":
            outcome = "AlreadyExists" if app in state else "Added"
            state.setdefault(app, new)
        elif app not in state:
            outcome = "DoesNotExist"
        elif op == "update":
            outcome, state[app] = "Updated", new
        elif app in with_logs:
            outcome = "HasLogs"
        else:
            outcome = "Removed"
            del state[app]
        want.append((seq, app, outcome))
    out = reg.registry_apply(spark.createDataFrame(list(known.items()), "app string, pass_hash string"),
                             spark.createDataFrame(rng.sample(requests, len(requests)), "seq long, op string, app string, password string"),
                             spark.createDataFrame([(a,) for a in with_logs for _ in range(3)], "app string")).collect()
    assert len([r for r in out if r.kind == "request"]) == len(requests)
    assert sorted((r.seq, r.app, r.status) for r in out if r.kind == "request" and r.status) == want
    assert {r.app: r.pass_hash for r in out if r.kind == "table"} == state
    assert {w[2] for w in want} == {"Added", "AlreadyExists", "Updated", "DoesNotExist", "Removed", "HasLogs"}


def test_the_last_value_of_a_repeated_key_counts(spark):
    raw = ('{"events": [], "events": [{"message": 5, "message": "m", "loggerName": "l", "threadName": "t", "level": "bogus", '
           '"level": "warn", "timestamp": 1, "timestamp": 1704067200000}]}')
    rows = dec.decode_events(spark.createDataFrame([(1, raw)], "batch_id long, raw string")).collect()
    assert [(r.message, r.level, r.timestamp) for r in rows] == [("m", 40, dt.datetime(2024, 1, 1))]


def test_entry_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() >= 0 and "id" in df.columns
    qs, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(qs) and len(qs) >= 70
    assert F is not None
