"""Change-only storage: the four-polls scenario, order safety, and the streaming form."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from conftest import rows
from pyspark.sql import functions as F

from punctual.operators import changes, ingest
from punctual.operators.chunked import number_chunk, time_chunk, with_previous, with_running_max, with_running_sum
from punctual.streaming import predictions as streaming

T = 1_800_000_000
DAY = date(2026, 9, 16)
SNAP = (
    "trip_id string, start_date date, stop_sequence int, stop_id string, arrival_time timestamp, departure_time timestamp, "
    "arrival_delay int, departure_delay int, schedule_relationship int, scheduled_time timestamp, header_timestamp timestamp, fetch_id long, ingest_seq long"
)


def at(s):
    return datetime.fromtimestamp(s, tz=timezone.utc)


def message(header, arrivals, n):
    return [("T1", DAY, seq, f"S{seq}", at(a), None, 0, None, None, at(a), at(header), n, n) for seq, a in arrivals.items()]


def four_polls():
    first = {1: T + 100, 2: T + 500, 3: T + 900}
    return message(T, first, 1) + message(T + 30, first, 2) + message(T + 60, {1: T + 100, 2: T + 560, 3: T + 960}, 3)


def summary(df):
    s = lambda c: (F.unix_seconds(c) - T).alias(c)
    return rows(df.select("stop_sequence", s("arrival_time"), s("first_seen_at"), s("last_seen_at"), s("closed_at"), "first_fetch_id"))


EXPECTED = sorted(
    [(1, 100, 0, 60, None, 1), (2, 500, 0, 30, 60, 1), (2, 560, 60, 60, None, 3), (3, 900, 0, 30, 60, 1), (3, 960, 60, 60, None, 3)], key=repr
)


def test_intervals_of_four_polls(spark):
    runs = changes.intervals(spark.createDataFrame(four_polls(), SNAP), chunk_s=7)
    assert summary(runs) == EXPECTED
    current, history = changes.split(runs)
    assert current.count() == 3 and history.count() == 2


def test_older_message_moves_nothing(spark):
    late = four_polls() + message(T + 45, {1: T + 111, 2: T + 555, 3: T + 999}, 4)
    kept = changes.in_header_order(spark.createDataFrame(late, SNAP), "ingest_seq", chunk_rows=2)
    assert summary(changes.intervals(kept)) == EXPECTED


def test_value_missing_for_a_while_bridges_the_gap(spark):
    polls = message(T, {1: T + 9}, 1) + message(T + 30, {2: T + 5}, 2) + message(T + 60, {1: T + 9}, 3)
    got = [r for r in summary(changes.intervals(spark.createDataFrame(polls, SNAP))) if r[0] == 1]
    assert got == [(1, 9, 0, 60, None, 1)]


def test_scheduled_time_is_carried_not_compared(spark):
    a, b = message(T, {1: T + 9}, 1), message(T + 30, {1: T + 9}, 2)
    b = [(*r[:9], at(T + 77), *r[10:]) for r in b]
    run = changes.intervals(spark.createDataFrame(a + b, SNAP)).collect()
    assert len(run) == 1 and run[0]["scheduled_time"].timestamp() == at(T + 77).timestamp()


def test_stream_equals_batch(spark, tmp_path):
    snaps = spark.createDataFrame(four_polls(), SNAP)
    for i in (1, 2, 3):  # one file per message, in order
        streaming.encode(snaps.filter(F.col("fetch_id") == i), changes.VALUE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(streaming.encode(snaps, changes.VALUE).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.run_available(streaming.change_only(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    closed = streaming.decode(
        spark.read.schema(streaming.CLOSED).parquet(str(tmp_path / "out")),
        "stop_id string, arrival_time timestamp, departure_time timestamp, arrival_delay int, departure_delay int, schedule_relationship int",
    )
    assert summary(closed) == [r for r in EXPECTED if r[4] is not None]


def test_close_out_moves_once_and_keeps_columns(spark):
    current, history = changes.split(changes.intervals(spark.createDataFrame(four_polls(), SNAP)))
    as_of = datetime(2026, 9, 25, tzinfo=timezone.utc)
    left, moved = ingest.close_out(current, history, as_of)
    assert left.count() == 0 and moved.count() == 5
    again_left, again = ingest.close_out(current, moved, as_of)
    assert again.count() == 5
    stop3 = moved.filter("stop_sequence = 3 and unix_seconds(arrival_time) = %d" % (T + 960)).first()
    assert stop3["scheduled_time"] == stop3["arrival_time"] and stop3["closed_at"] is not None
    assert ingest.close_out(current, history, at(T) - timedelta(days=300))[0].count() == 3


def test_fingerprint_sees_changes_not_order(spark):
    current, history = changes.split(changes.intervals(spark.createDataFrame(four_polls(), SNAP)))
    one = rows(ingest.fingerprint({"prediction_current": current}))
    assert one == rows(ingest.fingerprint({"prediction_current": current.orderBy(F.col("stop_sequence").desc())}))
    moved = current.withColumn("stop_id", F.lit("other"))
    assert one != rows(ingest.fingerprint({"prediction_current": moved}))


def test_chunked_windows_equal_plain_ones_on_a_hot_key(spark):
    from pyspark.sql import Window

    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.timestamp_seconds(F.col("id") * 37 % 5000 + F.when(F.col("id") % 7 == 0, 90000).otherwise(0)).alias("ts"),
        "id", ((F.col("id") * 7919) % 1000).alias("v"),
    )
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = df.withColumn("p", F.lag("v").over(w)).withColumn("m", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("x", F.lead("v").over(w))
    c = time_chunk(F.col("ts"), 60)
    ours = with_previous(df, ["k"], ["ts", "id"], c, ["v"])
    ours = with_previous(ours, ["k"], ["ts", "id"], c, ["v"], out="nxt", following=True)
    ours = with_running_max(ours, ["k"], ["ts", "id"], c, "v", "m")
    ours = with_running_sum(ours, ["k"], ["ts", "id"], number_chunk(F.unix_seconds("ts"), 77), "v", "s")
    cols = ["id", "p", "m", "s", "x"]
    got = ours.select("id", F.col("prev.v").alias("p"), "m", "s", F.col("nxt.v").alias("x"))
    assert rows(plain.select(*cols)) == rows(got.select(*cols))


def test_stream_does_not_depend_on_pieces(spark, tmp_path):
    rows_ = [("t", None, 1, f"v{(i * 7) % 5 // 2}", T + 10 * i, i) for i in range(200)]
    snaps = spark.createDataFrame(
        [(k, d, s, v, h * 10**6, None, f) for k, d, s, v, h, f in rows_],
        "trip_id string, start_date date, stop_sequence int, told string, header_us long, scheduled_us long, fetch_id long",
    )
    found = []
    for size in ("20", "10000"):
        folder = tmp_path / size
        snaps.orderBy(F.xxhash64("fetch_id")).coalesce(1).write.parquet(str(folder / "in"))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        source = spark.readStream.schema(snaps.schema).parquet(str(folder / "in"))
        streaming.run_available(streaming.change_only(source), str(folder / "out"), str(folder / "cp"))
        found.append(rows(spark.read.schema(streaming.CLOSED).parquet(str(folder / "out"))))
    assert found[0] == found[1]
    told = [r[3] for r in rows_]
    assert len(found[0]) == sum(a != b for a, b in zip(told, told[1:]))


def test_percentile_of_a_value_with_most_rows(spark):
    from punctual.operators.profile import exact_percentiles

    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 10 > 0, 600.0).otherwise(F.col("id") / 7).alias("v"))
    shares = {"a": 0.03, "b": 0.5, "c": 0.99}
    expected = df.groupBy("k").agg(F.count("v").alias("n"), *[F.percentile("v", F.lit(q)).alias(n) for n, q in shares.items()])
    got = exact_percentiles(df, ["k"], "v", shares)
    assert [[round(x, 9) for x in r] for r in rows(got, "k")] == [[round(x, 9) for x in r] for r in rows(expected, "k")]


def test_stream_keeps_a_state_for_a_bucket_of_keys(spark, tmp_path):
    schema = "trip_id string, start_date date, stop_sequence int, told string, header_us long, scheduled_us long, fetch_id long"
    polls = [[(f"t{k}" if k else None, DAY if k % 3 else None, k % 4, f"v{k % 5 if poll else 0}", poll * 10**6, None if k % 2 else k, poll * 1000 + k)
              for k in range(300)] for poll in range(2)]
    for poll in polls:
        spark.createDataFrame(poll, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        told = streaming.change_only(source, buckets=8).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query = told.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert 0 < query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 8
    expected = [(*r[:4], 0, 0, r[6], r[5], 10**6) for r in polls[0] if r[3] != polls[1][r[6]][3]]
    assert rows(spark.read.schema(streaming.CLOSED).parquet(str(tmp_path / "out"))) == sorted(expected, key=repr)


def test_keys_silent_too_long_close_and_leave():
    import pandas as pd

    new = lambda *r: pd.DataFrame(r, columns=["key", "told", "header_us", "scheduled_us", "fetch_id"])
    _, held = streaming._advance(streaming.HELD.empty_table().to_pandas(), new(("a", "x", 1, None, 1), ("b", "x", 2, 5, 2)), now=100, idle=50)
    closed, held = streaming._advance(held, new(("a", "x", 0, None, 3)), now=140, idle=50)  # nothing new, but it was heard of
    assert closed.empty and dict(zip(held["key"], held["until"])) == {"a": 190, "b": 150}
    closed, held = streaming._advance(held, None, now=150, idle=50)
    assert [tuple(None if pd.isna(v) else v for v in r) for r in closed.itertuples(index=False)] == [("b", "x", 2, 2, 2, 5, None)]
    closed, held = streaming._advance(held, new(("b", "y", 9, None, 4)), now=200, idle=50)  # a's time is up beside b's new start
    assert list(closed["key"]) == ["a"] and list(held["key"]) == ["b"]
    assert streaming._advance(held, None, now=250, idle=50)[1].empty


def test_bucket_advances_all_its_keys_as_one_by_one(spark):
    import random

    import pandas as pd

    rnd = random.Random(5)
    held, state, out, slow = streaming.HELD.empty_table().to_pandas(), {}, [], []
    for hour in range(6):
        came = [(rnd.choice("abcdef"), rnd.choice("xyz"), hour * 40 + rnd.randrange(60), rnd.choice([None, 7, 9]), rnd.randrange(1000)) for _ in range(25)]
        new = pd.DataFrame(came, columns=["key", "told", "header_us", "scheduled_us", "fetch_id"])
        closed, held = streaming._advance(held, new, 0, None)
        held = streaming._held(streaming._packed(held))
        out += [tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in closed.itertuples(index=False)]
        for key, told, at, due, fetch in sorted(came, key=lambda r: (r[2], r[4])):
            s = state.get(key)
            if s is None or (at > s[2] and told != s[0]):
                if s:
                    slow.append((key, s[0], s[1], s[2], s[3], s[4], at))
                state[key] = (told, at, at, fetch, due)
            elif at > s[2]:
                state[key] = (told, s[1], at, s[3], due)
    assert sorted(out, key=repr) == sorted(slow, key=repr) and len(out) > 30
    left = {r.key: (r.told, r.first, r.last, r.fetch, None if pd.isna(r.carried) else r.carried) for r in held.itertuples()}
    assert left == state
