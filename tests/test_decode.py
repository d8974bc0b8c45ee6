"""Wire decoding: precedence rules and all-or-nothing batches."""

import datetime as dt

from logloom.operators import decode as dec
from logloom.sources.fixtures import HAND_APP, HAND_APPS, HAND_WRITTEN


def hand(spark):
    return spark.createDataFrame([(b, raw, HAND_APPS.get(b, HAND_APP)) for b, raw, _ in HAND_WRITTEN],
                                 "batch_id long, raw string, app string")


def test_hand_written_outcomes(spark):
    got = {r.batch_id: r.reason for r in dec.decode_batches(hand(spark)).select("batch_id", "reason").collect()}
    assert got == {
        -1: dec.MALFORMED, -2: dec.MISSING_EVENTS, -3: None, -4: dec.NO_TIMESTAMP,
        -5: dec.INVALID_TIMESTAMP, -6: None, -7: dec.NO_TIMESTAMP, -8: None, -9: dec.INVALID_EVENT,
        -10: dec.INVALID_EVENT, -11: dec.INVALID_EVENT, -12: dec.BLANK_APP, -13: None,
    }


def test_typed_and_legacy_values(spark):
    rows = {r.batch_id: r for r in dec.decode_events(hand(spark)).collect()}
    assert set(rows) == {-6, -8, -13}
    assert rows[-6].timestamp == dt.datetime(2024, 1, 2, 3, 4, 5, 678000) and rows[-6].level == 40
    assert rows[-8].timestamp == dt.datetime(2024, 1, 1) and rows[-8].level == 30


def test_lenient_legacy_takes_timestamp(spark):
    rows = {r.batch_id: r for r in dec.decode_events(hand(spark), legacy="lenient").collect()}
    assert rows[-7].level == 50 and rows[-7].timestamp == dt.datetime(2024, 1, 1)


def test_one_bad_event_rejects_whole_batch(spark):
    good = '{"message":"m","loggerName":"l","threadName":"t","level":"info","timestamp":1000}'
    bad = '{"message":"m","loggerName":"l","threadName":"t","level":"nope","timestamp":1000}'
    df = spark.createDataFrame([(1, f'{{"events":[{good},{bad}]}}'), (2, f'{{"events":[{good},{good}]}}')],
                               "batch_id long, raw string")
    assert [r.batch_id for r in dec.reject_batches(df).collect()] == [1]
    out = dec.decode_events(df).collect()
    assert [(r.batch_id, r.pos) for r in sorted(out, key=lambda r: r.pos)] == [(2, 0), (2, 1)]


def test_numeric_string_timestamp_and_precedence(spark):
    ev = ('{"events":[{"message":"m","loggerName":"l","threadName":"t","level":"Debug",'
          '"timestamp":"77","isoTimestamp":"2024-01-01T00:00:01.5Z"}]}')
    r = dec.decode_events(spark.createDataFrame([(1, ev)], "batch_id long, raw string")).first()
    # isoTimestamp wins over the numeric timestamp in the current shape
    assert r.timestamp == dt.datetime(2024, 1, 1, 0, 0, 1, 500000) and r.level == 20


def test_enrich_trims_connection_fields(spark):
    ev = '{"events":[{"message":"m","loggerName":"l","threadName":"t","level":"info","timestamp":0}]}'
    df = spark.createDataFrame([(1, ev, " app ", "1.2.3.4", "  ", "  ua  ")],
                               "batch_id long, raw string, app string, address string, client string, user_agent string")
    r = dec.enrich_source(dec.decode_events(df)).first()
    assert (r.app, r.client, r.user_agent) == ("app", None, "ua")
