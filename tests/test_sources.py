"""Schedule files, realtime messages and logs as typed rows."""

from __future__ import annotations

import gzip
import json
from datetime import date, datetime, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from punctual.sources import gtfs, realtime, weblog

STATIC = {
    "agency.txt": "﻿agency_id,agency_name,agency_url,agency_timezone\nA,Transit,http://x,America/Los_Angeles\n",
    "routes.txt": "route_id,agency_id,route_short_name,route_long_name,route_type\nR1,A,1,Campbell Center,3\n",
    "stops.txt": "stop_id,stop_code,stop_name,stop_lat,stop_lon\nS1,1,One,44.0525,-123.0930\nS2,2,Two,44.0560,-123.0900\nS3,3,Three,44.0510,-123.0910\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nWK,1,1,1,1,1,0,0,20260906,20270201\n",
    "calendar_dates.txt": "service_id,date,exception_type\nWK,20261126,2\n",
    "trips.txt": "route_id,service_id,trip_id,trip_headsign,direction_id\nR1,WK,T1,Outbound,0\n",
    "stop_times.txt": "trip_id, arrival_time ,departure_time,stop_id,stop_sequence,timepoint\nT1,23:50:00,23:50:00,S1,1,1\nT1, 23:58:00,23:58:00,S2,2,0\nT1,24:05:00,24:05:00,S3,3,1\n",
}


@pytest.fixture
def download(tmp_path):
    for name, text in STATIC.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_schedule_times(spark):
    df = spark.createDataFrame([("25:10:00",), ("6:05:09",), ("",), (None,), (" 00:00:01 ",)], "t string")
    assert [r[0] for r in df.select(gtfs.schedule_seconds(F.col("t"))).collect()] == [90600, 21909, None, None, 1]


@pytest.mark.parametrize("bad", ["10:60:00", "10:00", "ten:00:00", "10:00:61"])
def test_malformed_schedule_time_fails(spark, bad):
    df = spark.createDataFrame([(bad,)], "t string").select(gtfs.schedule_seconds(F.col("t")))
    with pytest.raises(Exception, match="malformed schedule time"):
        df.collect()


def test_schedule_dates(spark):
    df = spark.createDataFrame([("20260906",), ("",)], "d string")
    assert [r[0] for r in df.select(gtfs.schedule_date(F.col("d"))).collect()] == [date(2026, 9, 6), None]


def test_reader_types_every_file(spark, download):
    t = gtfs.read_gtfs(spark, download, 4)
    assert rows(t["agency"]) == [(4, "A", "Transit", "http://x", "America/Los_Angeles")]
    times = t["stop_times"].orderBy("stop_sequence").collect()
    assert [r["arrival_seconds"] for r in times] == [85800, 86280, 86700]
    assert [r["timepoint"] for r in times] == [1, 0, 1]
    assert {r["location_type"] for r in t["stops"].collect()} == {0}
    cal = t["calendar"].first()
    assert cal["friday"] and not cal["saturday"] and cal["start_date"] == date(2026, 9, 6)


def test_incomplete_download_is_refused(spark, download, tmp_path):
    with pytest.raises(FileNotFoundError):
        gtfs.check_complete({"agency.txt", "routes.txt"})
    with pytest.raises(FileNotFoundError):
        gtfs.check_complete(set(gtfs.REQUIRED))


def test_same_bytes_are_not_a_new_version(spark):
    at = datetime(2026, 9, 6, tzinfo=timezone.utc)
    have = spark.createDataFrame([("aa",)], "sha256 string")
    seen = spark.createDataFrame([("aa", at, "u", 1), ("bb", at, "u", 1), ("bb", at, "v", 1)], "sha256 string, downloaded_at timestamp, source_url string, byte_size int")
    assert [(r["sha256"], r["feed_version_id"]) for r in gtfs.new_versions(seen, have, 3).collect()] == [("bb", 3)]


def test_versions_append_without_repeating(spark, download, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("gtfs"))
    for fv in (1, 2, 2):
        gtfs.append_version(gtfs.read_gtfs(spark, download, fv), root)
    assert rows(spark.read.parquet(f"{root}/stop_times").groupBy("feed_version_id").count()) == [(1, 3), (2, 3)]


def test_archive_header_time_comes_from_the_name(spark, tmp_path):
    folder = tmp_path / "alerts" / "2026" / "09" / "16"
    folder.mkdir(parents=True)
    message = {"header": {"timestamp": 5}, "entity": [{"id": "a1", "alert": {"header_text": {"translation": [{"text": "Detour"}]}}}]}
    with gzip.open(folder / "1800000000.json.gz", "wt") as f:
        json.dump(message, f)
    got = realtime.read_archive(spark, str(tmp_path), "alerts").withColumn("fetch_id", F.lit(1))
    assert got.select(F.unix_seconds("header_timestamp")).first()[0] == 1_800_000_000
    alert = realtime.alerts(got).first()
    assert alert["alert_id"] == "a1" and json.loads(alert["payload"])["header_text"]["translation"][0]["text"] == "Detour"


def test_access_log_counts_people(spark):
    now = datetime(2026, 10, 20, 12, tzinfo=timezone.utc)

    def line(uri, agent="Mozilla/5.0", referer=None):
        headers = {"User-Agent": [agent]} | ({"Referer": [referer]} if referer else {})
        return (json.dumps({"ts": now.timestamp() - 60, "status": 200, "request": {"uri": uri, "method": "GET", "host": "x.com", "headers": headers}}),)

    lines = [line("/", referer="https://www.reddit.com/r/x"), line("/reports/route/11/"), line("/static/js/main.js"),
             line("/", agent="Googlebot/2.1"), line("/stops", referer="https://x.com/route"), ("{broken",)]
    log = weblog.access_log(spark.createDataFrame(lines, "value string"), now)
    counts = {(r["kind"], r["item"]): r["n"] for r in weblog.access_counts(log).collect()}
    assert counts[("source", "reddit.com")] == 1 and len([k for k in counts if k[0] == "source"]) == 1
    assert counts[("report_page", "/reports/route/11/")] == 1 and counts[("landing", "/")] == 1
