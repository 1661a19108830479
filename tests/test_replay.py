"""The archive: both layouts, rejects, and tables that live storing and a rebuild both give."""

from __future__ import annotations

import gzip
import json
import random
from datetime import datetime, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from punctual.operators import ingest
from punctual.sources import realtime
from punctual.streaming import replay

T = 1_800_000_000
LINES = "feed string, header_timestamp timestamp, text string"


def utc(s):
    return datetime.fromtimestamp(s, timezone.utc)


def message(feed, header, **more):
    """One entity of each kind; predictions of three stops that change now and then."""
    step = (header - T) // 30
    trip = {"trip_id": f"T{step % 2}", "start_date": "20270115"}
    stops = [{"stop_sequence": i, "stop_id": f"S{i}", "arrival": {"time": header - header % (90 * i) + 600}} for i in (1, 2, 3)]
    entity = {
        "trip_updates": {"id": "u", "trip_update": {"trip": trip, "stop_time_update": stops}},
        "vehicle_positions": {"id": "v", "vehicle": {"vehicle": {"id": f"b{step % 3}"}, "trip": trip, "timestamp": header - header % 60,
                                                     "position": {"latitude": 44.0 + step / 100, "longitude": -123.0}}},
        "alerts": {"id": f"a{step % 4}", "alert": {"header_text": {"translation": [{"text": "Detour"}]}}},
    }[feed]
    return (feed, utc(header), json.dumps({"header": {"timestamp": header}, "entity": [entity]} | more))


def day_of_messages(n=40):
    return [message(feed, T + 30 * i) for i in range(n) for feed in realtime.FEEDS]


def prints(tables):
    return rows(ingest.fingerprint({n: df.withColumn("archive_path", F.lit("")) if n == "fetch" else df for n, df in tables.items()}))


def store_of(spark, folder, parts, late, **how):
    store = replay.LiveStore(spark, f"{folder}/tables", late=late, buckets=2)
    for part in parts:
        realtime.write_archive(spark.createDataFrame(part, LINES), f"{folder}/raw", **how)
        replay.follow(replay.scan_feeds(spark, f"{folder}/raw", streaming=True, files_per_trigger=3), store, f"{folder}/checkpoint")
    return store


def rebuilt(spark, folder, **how):
    return replay.rebuild(realtime.archived_messages(replay.scan_feeds(spark, f"{folder}/raw", **how)))


def test_live_tables_equal_the_rebuilt_ones_whatever_the_order(spark, tmp_path):
    lines = day_of_messages()
    mixed = sorted(lines, key=lambda m: m[1].timestamp() + random.Random(m[2]).randrange(600))
    parts = [mixed[:70] + mixed[60:70], mixed[70:]]  # some messages are archived twice
    store = store_of(spark, str(tmp_path), parts, late=3600)
    store.finish()
    live = prints(store.tables())
    assert live == prints(rebuilt(spark, str(tmp_path))) and len(live) == 6 and all(r[1] > 0 for r in live)
    realtime.write_archive(spark.createDataFrame(lines, LINES), str(tmp_path / "ordered" / "raw"))
    assert live == prints(rebuilt(spark, str(tmp_path / "ordered")))


def test_a_position_is_stored_once_over_batches(spark, tmp_path):
    lines = [message("vehicle_positions", T + 30 * i) for i in range(6)]
    again = [("vehicle_positions", utc(T + 31 + 30 * i), lines[i][2].replace(str(T + 30 * i), str(T + 31 + 30 * i), 1)) for i in range(6)]
    store = store_of(spark, str(tmp_path), [lines, again], late=0)
    got = store.tables()["vehicle_position"]
    assert got.count() == got.select("vehicle_id", "position_timestamp").distinct().count() == 6
    assert store.tables()["fetch"].count() == 12


def test_a_failed_batch_is_run_again(spark, tmp_path, monkeypatch):
    lines = day_of_messages(20)
    store = store_of(spark, str(tmp_path), [lines[:30]], late=60)

    def stop(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.states, "commit", stop)  # after the predictions were committed
        realtime.write_archive(spark.createDataFrame(lines[30:], LINES), f"{tmp_path}/raw")
        stream = replay.scan_feeds(spark, f"{tmp_path}/raw", streaming=True)
        with pytest.raises(Exception, match="lost"):
            replay.follow(stream, store, f"{tmp_path}/checkpoint")
    replay.follow(replay.scan_feeds(spark, f"{tmp_path}/raw", streaming=True), store, f"{tmp_path}/checkpoint")
    store.finish()
    assert prints(store.tables()) == prints(rebuilt(spark, str(tmp_path)))


def test_what_cannot_be_read_is_told_apart(spark, tmp_path):
    good = message("alerts", T + 10)
    odd = [
        ("alerts", utc(T + 30), good[2][:-5]),
        ("alerts", utc(T + 60), "not json at all"),
        ("alerts", utc(T + 90), '{"header":{"timestamp":1800000090}}'),
        ("alerts", utc(T + 120), good[2].replace(f'"timestamp": {T + 10}', '"timestamp": "soon"')),
        ("alerts", utc(T + 150), json.dumps({"entity": []})),
        ("alerts", utc(T + 180), ""),
    ]
    store = store_of(spark, str(tmp_path), [[good, *odd]], late=0)
    told = rows(store.rejects().groupBy("problem").count())
    assert told == [("no entities", 1), ("not a message", 3)]
    assert store.rejects().filter("filed_at is null").count() == 0
    # a message without a time takes that of its period, an empty line is nothing
    times = [r[0] for r in rows(store.tables()["fetch"].select(F.unix_seconds("header_timestamp")))]
    assert times == [T, T + 10]


def test_files_named_by_time_and_a_start(spark, tmp_path):
    folder = tmp_path / "raw" / "alerts" / "2027" / "01"
    folder.mkdir(parents=True)
    with gzip.open(folder / f"{T + 7}.json.gz", "wt") as f:
        f.write(message("alerts", T)[2])
    later = [message("alerts", T + 3600 * h) for h in (0, 5, 6)]
    realtime.write_archive(spark.createDataFrame(later, LINES), str(tmp_path / "raw"))
    scan = realtime.scan_archive(spark, str(tmp_path / "raw"), "alerts")
    assert [r[0] - T for r in rows(scan.select(F.unix_seconds("header_timestamp")))] == [0, 7, 5 * 3600, 6 * 3600]
    late = realtime.scan_archive(spark, str(tmp_path / "raw"), "alerts", since=utc(T + 5 * 3600))
    assert [r[0] - T for r in rows(late.select(F.unix_seconds("header_timestamp")))] == [5 * 3600, 6 * 3600]
    assert not [f for f in late.inputFiles() if "hour=2027-01-15-08" in f]
    assert realtime.scan_archive(spark, str(tmp_path / "raw"), "alerts", since=utc(T + 900_000)).count() == 0
