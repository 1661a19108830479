"""Archives written and read back through the index, against plain SQL and on odd pages."""

import zlib

from pyarrow import fs as pafs
from pyspark.sql import functions as F

from punctual.llm import warc

BIG = "<p>" + "x" * 1000


def pages(spark):
    rows = [
        (1, "http://WWW.Example.com:80/a?b=1#f", BIG),
        (2, "https://www.example.com/a", BIG),
        (3, None, BIG + "ü"),
        (4, "no url", None),
        (None, "http://x.org/", BIG),
        (5, "http://x.org/", ""),
        (6, "http://x.org/", "short"),
        (7, "http://x.org:8080/", "short"),
        (8, "ftp://u@h.x/\n", "a\r\n\r\nb" * 400_000),
        (2, "https://www.example.com/a", BIG),
        (1, "http://other/", "same id, other page"),
    ]
    return spark.createDataFrame([(*r, "extra", 0) for r in rows], "page_id long, url string, html string, surt string, offset int")


def test_round_trip(spark):
    got = warc.archive_and_read(pages(spark)).collect()
    by = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=repr)
    size = len(BIG)
    assert by == sorted(
        [
            (1, size, "revisit", 2), (2, size, "response", None), (2, size, "response", None), (3, size + 2, "response", None),
            (4, 0, "response", None), (None, size, "response", None), (5, 0, "response", None), (6, 5, "response", None),
            (7, 5, "response", None), (8, 2_400_000, "response", None), (1, 19, "response", None),
        ],
        key=repr,
    )


def test_keys(spark):
    keys = pages(spark).select("url", warc.surt(F.col("url")).alias("k")).distinct().collect()
    assert {r.url: r.k for r in keys} == {
        "http://WWW.Example.com:80/a?b=1#f": "com,example,www)/a?b=1",
        "https://www.example.com/a": "com,example,www)/a",
        None: "",
        "no url": "no url",
        "http://x.org/": "org,x)/",
        "http://x.org:8080/": "org,x:8080)/",
        "ftp://u@h.x/\n": "x,h)/",
        "http://other/": "other)/",
    }


def test_lookup_over_many_blocks_and_raw_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    many = spark.range(200).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id") % 7).alias("url"), F.col("id").cast("string").alias("html")
    )
    archives, index = f"file://{tmp_path}/a", f"file://{tmp_path}/i"
    parts = warc.write_index(warc.write_archives(many, archives), index)
    assert parts.agg(F.sum("captures")).first()[0] == 200 and parts.agg(F.sum("blocks")).first()[0] > 60
    asked = spark.createDataFrame([("h)/3",), ("h)/zzz",), ("",)], "surt string")
    assert sorted(r.page_id for r in warc.lookup(asked, parts, index, archives).collect()) == list(range(3, 200, 7))
    pair = spark.createDataFrame([("h)/3", 10), ("h)/3", 11)], "surt string, page_id long")
    assert [r.page_id for r in warc.lookup(pair, parts, index, archives).collect()] == [10]
    where = pafs.LocalFileSystem()
    files = where.get_file_info(pafs.FileSelector(f"{tmp_path}/a"))
    records = b"".join(zlib_members(where.open_input_file(f.path).read()) for f in files)
    assert records.count(b"WARC/1.1\r\n") == 200


def zlib_members(data):
    out = b""
    while data:
        unpack = zlib.decompressobj(31)
        out += unpack.decompress(data)
        data = unpack.unused_data
    return out


def test_empty_table(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
