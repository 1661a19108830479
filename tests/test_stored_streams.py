"""Stored streams: units touched, restarts, expiry by event time, arrivals out of order."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta, timezone
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from punctual.streaming import keyed
from punctual.streaming.predictions import IntervalStore

SNAP = "trip_id string, start_date date, stop_sequence int, told int, scheduled_time timestamp, header_timestamp timestamp, fetch_id long"
HISTORY = ("trip_id string, start_date date, stop_sequence int, told int, scheduled_time timestamp, "
           "first_seen_at timestamp, last_seen_at timestamp, first_fetch_id long, closed_at timestamp")  # fmt: skip
DAY = date(2024, 3, 1)
T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)


def snapshots(n, days=1, keys=5, seed=1, values=3):
    """n snapshots in header order, spread over the days after their own service day and the ones that follow."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        header = T0 + timedelta(seconds=i * days * 86400 / n)
        day = DAY + timedelta(days=min(int(i * days / n), days - 1) - rnd.choice([0, 0, 0, 1, 4]))
        out.append((f"t{rnd.randrange(keys)}", day, 1, rnd.randrange(values), header, header, i))
    return out


def brute(snaps, stale_days=None, until=None):
    """(key, told, first, last, first id, closed) of all intervals, in header order."""
    now, out = {}, []
    over = lambda day: datetime(day.year, day.month, day.day, tzinfo=timezone.utc) + timedelta(days=stale_days + 1)
    for trip, day, seq, told, _, header, i in sorted(snaps, key=lambda s: (s[5], s[6])):
        if stale_days is not None and header >= over(day):
            continue
        at = now.get((trip, day, seq))
        if at and header <= at[2]:
            continue
        if at and at[0] == told:
            at[2] = header
        else:
            if at:
                out.append(((trip, day, seq), *at, header))
            now[trip, day, seq] = [told, header, header, i]
    for key, at in now.items():
        closed = over(key[1]) if stale_days is not None and until >= over(key[1]) else None
        out.append((key, *at, closed))
    return sorted(out, key=repr)


def stored(store):
    both = store.current().withColumn("closed_at", F.lit(None).cast("timestamp")).unionByName(store.history())
    columns = ("told", "first_seen_at", "last_seen_at", "first_fetch_id", "closed_at")
    utc = lambda v: v.astimezone(timezone.utc) if isinstance(v, datetime) else v
    return sorted((((r["trip_id"], r["start_date"], r["stop_sequence"]), *[utc(r[c]) for c in columns]) for r in both.collect()), key=repr)


def fed(spark, folder, parts, finish=False, **how):
    store = IntervalStore(spark, str(folder), HISTORY, ["told"], **how)
    for number, part in enumerate(parts):
        store.apply(spark.createDataFrame(part, SNAP), number)
    if finish:
        store.finish()
    return store


def parts_of(snaps, size):
    return [snaps[i : i + size] for i in range(0, len(snaps), size)]


def test_a_small_batch_writes_only_its_units(spark, tmp_path):
    snaps = [(f"t{i}", DAY, 1, 0, T0, T0, i) for i in range(2000)]
    later = T0 + timedelta(minutes=5)
    few = [(f"t{i}", DAY, 1, 1, later, later, 2000 + i) for i in range(0, 2000, 200)]
    store = fed(spark, tmp_path, [snaps, few], buckets=64)
    touched = store.table.units(spark.createDataFrame(few, SNAP))
    files = [p for p in (tmp_path / "current" / "batch=1").rglob("*.parquet")]
    assert len(touched) <= 10 and len(files) <= len(touched)
    assert stored(store) == brute(snaps + few)
    # the units that batch 1 rewrote go from batch 0's folder with the batch after it, the others stay
    store.apply(spark.createDataFrame(few[:1], SNAP), 2)
    left = {str(p.parent.relative_to(tmp_path / "current" / "batch=0")) for p in (tmp_path / "current" / "batch=0").rglob("*.parquet")}
    assert left == {u for u, n in store.states.before().units.items() if n == 0} and len(left) == 64 - len(touched)


def test_storage_does_not_grow_with_batches(spark, tmp_path):
    snaps = [("t", DAY, 1, i % 2, T0 + timedelta(seconds=i), T0 + timedelta(seconds=i), i) for i in range(5)]
    store = fed(spark, tmp_path, parts_of(snaps, 1))
    assert stored(store) == brute(snaps)
    assert len(list((tmp_path / "current").iterdir())) <= 2 and len(list((tmp_path / "arrived").iterdir())) <= 2
    assert len(store.states.numbers()) == 2


@pytest.mark.parametrize("place", ["history", "current", "state"])
def test_a_failed_batch_is_run_again(spark, tmp_path, monkeypatch, place):
    snaps = snapshots(120)
    whole = stored(fed(spark, tmp_path / "whole", parts_of(snaps, 40)))
    folder = str(tmp_path / "broken")
    (tmp_path / "in").mkdir()
    for k, part in enumerate(parts_of(snaps, 40)):
        spark.createDataFrame(part, SNAP).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store = IntervalStore(spark, folder, HISTORY, ["told"])
        source = spark.readStream.schema(SNAP).parquet(str(tmp_path / "in"))
        if k == 1:
            broken = IntervalStore(spark, folder, HISTORY, ["told"])

            def stop(*_, **__):
                raise RuntimeError("lost")

            if place == "history":
                monkeypatch.setattr(broken.table, "write", stop)
            elif place == "current":
                monkeypatch.setattr(broken.states, "commit", stop)
            else:
                monkeypatch.setattr(broken.states, "commit", lambda state: broken.states.files.write(f"{broken.states.folder}/{state.number:010d}.json", '{"number": '))
                monkeypatch.setattr(broken.held, "clean", stop)
            with pytest.raises(Exception, match="lost"):
                keyed.run_batches(source, broken.apply, str(tmp_path / "checkpoint"))
        keyed.run_batches(source, store.apply, str(tmp_path / "checkpoint"))
    assert stored(store) == whole == brute(snaps)


@pytest.mark.parametrize("size", [13, 1000])
def test_expiry_does_not_depend_on_batches(spark, tmp_path, size):
    snaps = snapshots(90, days=8, keys=3)
    store = fed(spark, tmp_path, parts_of(snaps, size), stale_days=2)
    expected = brute(snaps, 2, max(s[5] for s in snaps))
    assert stored(store) == expected
    # the live table holds live days only
    assert {u.split("/")[0] for u in store.states.before().units} == {f"part_day={r[0][1]}" for r in expected if r[-1] is None}


def test_arrival_order_does_not_matter_within_the_lateness(spark, tmp_path):
    snaps = snapshots(300, keys=4)
    gap = 86400 / 300
    shuffled = sorted(snaps, key=lambda s: s[5].timestamp() + random.Random(s[6]).random() * gap * 20)
    assert shuffled != snaps
    store = fed(spark, tmp_path, parts_of(shuffled, 50), finish=True, late=gap * 21)
    assert stored(store) == brute(snaps)
    # finishing again changes nothing, and the stream can still go on from where it was
    store.finish()
    assert stored(store) == brute(snaps)
    more = [("t9", DAY, 1, 5, T0, snaps[-1][5] + timedelta(seconds=1), 999)]
    store.apply(spark.createDataFrame(more, SNAP), 6)
    store.finish()
    assert stored(store) == brute(snaps + more)


def test_an_unfinished_state_file_is_no_state(spark, tmp_path):
    states = keyed.States(spark, str(tmp_path))
    states.commit(keyed.State(0, 5, 5, {"a": 0}))
    Path(tmp_path / "state" / "0000000001.json").write_text('{"number": 1, "clo')
    assert states.before() == keyed.State(0, 5, 5, {"a": 0}) and states.before(0) == keyed.State()


def test_repeated_messages_and_no_rows(spark, tmp_path):
    snaps = snapshots(40)
    store = fed(spark, tmp_path, [[], snaps + snaps, snaps, []])
    assert stored(store) == brute(snaps)
    assert rows(fed(spark, tmp_path / "none", [[]]).current()) == []
