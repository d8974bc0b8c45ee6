"""Randomized check of the decoder against a plain-Python statement of the rules."""

import datetime as dt
import json
import random

from logloom.operators import decode as dec

LEVELS = {"trace": 10, "debug": 20, "info": 30, "warn": 40, "error": 50, "other": 60}
EPOCH = dt.datetime(1970, 1, 1)

# (text, instant or None): ISO-instant samples with their values.
ISO = [
    ("2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02T03:04:05.123Z", dt.datetime(2024, 1, 2, 3, 4, 5, 123000)),
    ("2024-01-02T03:04:05.123456Z", dt.datetime(2024, 1, 2, 3, 4, 5, 123000)),
    ("2024-01-02T05:04:05+02:00", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02", None),
    ("not-a-time", None),
]


def ms_value(v):
    """How a number-typed field reads: an int, or a string holding an int."""
    if isinstance(v, bool):
        return None
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return int(v) if v.is_integer() else None
    if isinstance(v, str) and v.lstrip("-").isdigit():
        return int(v)
    return None


def iso_value(v):
    for text, value in ISO:
        if v == text:
            return value
    return None


def reference(event, legacy="strict"):
    """(ok, reason, timestamp, level) for one event, by the documented rules."""
    if not isinstance(event, dict):
        return False, dec.INVALID_EVENT, None, None

    def is_str(k):
        return isinstance(event.get(k), str)

    def opt_str(k):
        return k not in event or event[k] is None or isinstance(event[k], str)

    strings_ok = is_str("message") and is_str("loggerName") and is_str("threadName") and opt_str("stackTrace")
    level = LEVELS.get(event["level"].lower()) if is_str("level") else None
    ts = event.get("timestamp")
    typed = iso_value(ts) if isinstance(ts, str) else None
    if strings_ok and level and typed:
        return True, None, typed, level
    ms = ms_value(ts)
    legacy_ms = ms_value(event.get("timeStamp"))
    ts_ok = "timestamp" not in event or ts is None or ms is not None
    current_ok = strings_ok and level and opt_str("isoTimestamp") and opt_str("timeFormatted") and ts_ok
    if current_ok:
        if is_str("isoTimestamp"):
            v = iso_value(event["isoTimestamp"])
            return (True, None, v, level) if v else (False, dec.INVALID_TIMESTAMP, None, None)
        plain = ms if legacy == "strict" or ms is not None else legacy_ms
        if plain is None:
            return False, dec.NO_TIMESTAMP, None, None
        return True, None, EPOCH + dt.timedelta(milliseconds=plain), level
    if strings_ok and legacy_ms is not None and is_str("timeFormatted") and is_str("level"):
        return True, None, EPOCH + dt.timedelta(milliseconds=legacy_ms), level or 30
    return False, dec.INVALID_EVENT, None, None


def random_event(rnd):
    if rnd.random() < 0.04:
        return rnd.choice([1, "x", None, [1]])
    if rnd.random() < 0.15:  # legacy shape: timeStamp, timeFormatted, any level text
        return {"timeStamp": 1704067200000 + rnd.randrange(10**6), "timeFormatted": "2024-01-01 00:00",
                "message": "m", "loggerName": "l", "threadName": "t",
                "level": rnd.choice(["info", "ERROR", "fatal", "bogus", "severe"])}
    e = {}
    for k in ("message", "loggerName", "threadName"):
        r = rnd.random()
        if r < 0.9:
            e[k] = f"{k}-{rnd.randrange(100)}"
        elif r < 0.95:
            e[k] = rnd.randrange(10)
    r = rnd.random()
    if r < 0.85:
        e["level"] = rnd.choice(["info", "WARN", "Error", "debug", "trace", "other", "fatal", "bogus"])
    elif r < 0.9:
        e["level"] = 30
    for k, p in (("timestamp", 0.6), ("isoTimestamp", 0.3), ("timeStamp", 0.2), ("timeFormatted", 0.5),
                 ("stackTrace", 0.2)):
        if rnd.random() < p:
            if k in ("timestamp", "timeStamp"):
                e[k] = rnd.choice([1704067200000 + rnd.randrange(10**6), str(1704067200000 + rnd.randrange(1000)),
                                   ISO[rnd.randrange(len(ISO))][0], None, True, False, 1.5, 1704067200000.0,
                                   1.7040672005e12, "1.5", "", {}])
            elif k == "isoTimestamp":
                e[k] = rnd.choice([t for t, _ in ISO] + [None])
            else:
                e[k] = rnd.choice(["x", None, 5]) if k == "stackTrace" else rnd.choice(["2024-01-01 00:00", None])
    return e


def test_decoder_matches_reference_rules(spark):
    rnd = random.Random(11)
    batches = []
    for b in range(400):
        events = [random_event(rnd) for _ in range(rnd.randrange(0, 4))]
        batches.append((b, json.dumps({"events": events})))
    df = spark.createDataFrame(batches, "batch_id long, raw string")
    for legacy in ("strict", "lenient"):
        got = {r.batch_id: r for r in dec.decode_batches(df, legacy=legacy).collect()}
        for b, raw in batches:
            events = json.loads(raw)["events"]
            ref = [reference(e, legacy) for e in events]
            r = got[b]
            first_bad = next((x[1] for x in ref if not x[0]), None)
            assert r.reason == first_bad, (legacy, raw, r.reason)
            if first_bad is None:
                assert [(d.timestamp, d.level) for d in r.decoded] == [(x[2], x[3]) for x in ref], (legacy, raw)
