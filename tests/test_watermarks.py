"""Streams under a watermark, stopped and gone on with; silences of feeds."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from conftest import rows
from pyspark.sql import functions as F

from punctual.streaming import predictions as streaming
from punctual.streaming.silence import SilenceStore, silences

POLL = "feed string, header_timestamp timestamp, fetched_at timestamp, poll_id long"
T0 = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def poll(i, minutes, feed="a"):
    return feed, T0 + timedelta(minutes=minutes // 30 * 30), at(minutes), i


def told(spark, folder, make, parts):
    """What a stream tells over the parts, stopping and going on after each."""
    for part in parts:
        spark.createDataFrame(part, POLL).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = make(spark.readStream.schema(POLL).parquet(f"{folder}/in"))
        streaming.run_available(out, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def minute(ts):
    return int((ts.astimezone(timezone.utc) - T0).total_seconds() // 60)


def test_counts_of_late_polls(spark, tmp_path):
    make = lambda s: streaming.counts(s, "30 minutes", "10 minutes")
    first = [poll(i, m) for i, m in enumerate([1, 2, 31, 35])]
    # 8 minutes behind the newest: its window is still open; 34 behind: told already, so it is not counted
    second = [poll(10, 27), poll(11, 45)]
    third = [poll(20, 29), poll(21, 75)]
    got = told(spark, str(tmp_path), make, [first, second, third])
    assert sorted((minute(r["window_start"]), r["n"]) for r in got.collect()) == [(0, 3), (30, 3)]


def test_first_messages_wait_for_the_watermark(spark, tmp_path):
    make = lambda s: streaming.first_messages(s, "40 minutes")
    first = [poll(5, 7), poll(6, 35)]
    second = [poll(1, 3), poll(2, 66)]  # an earlier poll of a header still open
    third = [poll(0, 1), poll(3, 120)]  # the header 0 is behind the watermark
    got = told(spark, str(tmp_path), make, [first, second, third])
    assert sorted((minute(r["header_timestamp"]), r["poll_id"]) for r in got.collect()) == [(0, 1), (30, 6), (60, 2)]


def test_stopping_changes_nothing(spark, tmp_path):
    rnd = random.Random(7)
    polls = [poll(i, i * 3 // 2, rnd.choice("ab")) for i in range(150)]
    for name, make in (("counts", streaming.counts), ("first", streaming.first_messages)):
        found = [
            rows(told(spark, str(tmp_path / f"{name}{size}"), make, [polls[i : i + size] for i in range(0, 150, size)]))
            for size in (40, 150)
        ]
        assert found[0] == found[1] and found[0]


def brute_silences(heard, limit):
    out = []
    now = max((t for _, t in heard), default=None)
    for feed in {f for f, _ in heard}:
        times = sorted({t for f, t in heard if f == feed})
        out += [(feed, a, b, (b - a).total_seconds()) for a, b in zip(times, times[1:], strict=False) if (b - a).total_seconds() > limit]
        if (now - times[-1]).total_seconds() > limit:
            out.append((feed, times[-1], None, (now - times[-1]).total_seconds()))
    return sorted(out, key=repr)


def found_silences(store):
    utc = lambda v: v and v.astimezone(timezone.utc)
    both = store.closed().unionByName(store.silent_now()).collect()
    return sorted(((r["feed"], utc(r["silent_from"]), utc(r["silent_to"]), r["gap_s"]) for r in both), key=repr)


def test_silences_do_not_depend_on_batches_or_order(spark, tmp_path):
    rnd = random.Random(3)
    heard = [(rnd.choice("abc"), at(rnd.randrange(600))) for _ in range(150)] + [("quiet", at(5)), ("quiet", at(9))]
    heard.sort(key=lambda r: r[1])
    late = sorted(heard, key=lambda r: r[1] + timedelta(minutes=rnd.randrange(25)))
    for size, order in ((40, late), (1000, late)):
        store = SilenceStore(spark, str(tmp_path / str(size)), limit_s=600, late=1500)
        for number, i in enumerate(range(0, len(order), size)):
            part = [*order[i : i + size], (None, at(1)), ("a", None)]
            store.apply(spark.createDataFrame(part, "feed string, at timestamp"), number)
        store.finish()
        assert found_silences(store) == brute_silences(heard, 600)
    assert ("quiet", at(9), None) in [s[:3] for s in found_silences(store)]


def test_a_feed_is_silent_before_its_next_message(spark, tmp_path):
    store = SilenceStore(spark, str(tmp_path), limit_s=600)
    steps = [[("a", at(0)), ("b", at(1))], [("b", at(8))], [("b", at(20))], [("a", at(30))]]
    open_ = []
    for number, part in enumerate(steps):
        store.apply(spark.createDataFrame(part, "feed string, at timestamp"), number)
        open_.append([r["feed"] for r in store.silent_now().collect()])
    assert open_ == [[], [], ["a"], []]
    assert found_silences(store) == brute_silences([r for s in steps for r in s], 600)


def test_batch_silences(spark):
    df = spark.createDataFrame([("a", at(m)) for m in (0, 5, 30)], "feed string, at timestamp")
    assert [r["gap_s"] for r in silences(df, 600).collect()] == [1500.0]
    assert silences(df.filter(F.lit(False)), 600).count() == 0
