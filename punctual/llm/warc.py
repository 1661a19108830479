"""WARC archives with a two-level capture index.

Writing: pages become WARC 1.1 records, one gzip member each, in archive files of the shared folder. Captures
are indexed by reversed-host URL key: sorted lines in compressed blocks, and a sparse directory with the first
key of every block. Reading: keys are binary-searched in the directory, then in one block, and each capture is
a range read of its archive.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm.common import new_folder, partitions, slices, store

#: Payloads below this size are always written in full.
LEAST_REVISIT_BYTES = 1000
#: Lines of an index block, and about the size of an archive file.
BLOCK_LINES = 3000
ARCHIVE_BYTES = 64 << 20
#: Archive files that a reading task keeps open.
OPEN_FILES = 64
_END = b"\r\n\r\n"

CAPTURE = "surt string, page_id long, archive string, offset long, size long"
PART = "first_key string, first_page long, part string, directory long, blocks int, captures long"
RECORD = "surt string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: F.Column) -> F.Column:
    """Reversed-host key of a URL: ``com,example,www)/path?query``, lower case, without scheme, user or default port.

    A null URL gives the empty key; a text that is no URL is its own key.
    """
    rest = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"[\r\n\t]", "")
    pattern = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)(:\d*)?([^#]*)"
    host = F.concat_ws(",", F.reverse(F.split(F.regexp_extract(rest, pattern, 1), r"\.")))
    port = F.regexp_replace(F.regexp_extract(rest, pattern, 2), r"^:(80|443)?$", "")
    path = F.regexp_extract(rest, pattern, 3)
    key = F.concat(host, port, F.lit(")"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    return F.when(rest.rlike(pattern), key).otherwise(rest)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def record_types(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``(page_id, digest, refers_to)`` of the pages whose payload a page of larger id holds as response."""
    narrow = pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    narrow = narrow.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull())
    narrow = narrow.select("page_id", F.sha1("payload").alias("digest"))
    held = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("other"))
    held = store(held.where("other < refers_to").select("digest", "refers_to"), "held")
    # a third of all rows may share a digest: both sides are plain, so Spark can split such a key
    return narrow.join(held, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def _record(page_id: int | None, url: str, html: str, refers_to: int | None) -> bytes:
    payload = html.encode()
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        f"X-Payload-Bytes: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>",
            f"X-Refers-To-Page: {refers_to}",
        ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + _END
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def _one_line(text: str | None) -> str:
    return (text or "").replace("\r", " ").replace("\n", " ")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and returns their captures ``(surt, page_id, archive, offset, size)``, stored.

    A task writes its own files under names of its own attempt, so a lost task leaves at most files that no
    capture names. Null html is an empty payload, a null url an empty one; equal rows are records of their own.
    """
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest")
    keyed = pages.select("page_id", digest, "url", "html", surt(F.col("url")).alias("surt"))
    joined = keyed.join(record_types(pages), ["page_id", "digest"], "left").drop("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_fs, base = _open(folder)
        out, name, at = None, "", 0
        for batch in slices(batches, "html"):
            rows = batch.to_pylist()
            found: dict[str, list] = {"surt": [], "page_id": [], "archive": [], "offset": [], "size": []}
            for row in rows:
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store_fs.open_output_stream(f"{base}/{name}", compression=None)
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                raw = _record(row["page_id"], _one_line(row["url"]), row["html"] or "", row["refers_to"])
                member = pack.compress(raw) + pack.flush()
                out.write(member)
                for key, value in zip(found, (row["surt"], row["page_id"], name, at, len(member))):
                    found[key].append(value)
                at += len(member)
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), types)], list(found))
        if out is not None:
            out.close()

    _prepare(folder)
    return store(joined.mapInArrow(run, CAPTURE), "captures")


def _prepare(folder: str) -> None:
    where, base = _open(folder)
    where.create_dir(base, recursive=True)


#: What a null page id counts as in the order of keys.
_BEFORE = -(1 << 63)


def _key(surt_key: str, page_id: int | None) -> tuple[bytes, int]:
    return surt_key.encode(), _BEFORE if page_id is None else page_id


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts the captures by (key, page id) over all tasks and writes compressed blocks, then a directory behind them.

    Returns a row for each index file: ``(first_key, first_page, part, directory, blocks, captures)``; there
    are as many as range partitions. A key of very many captures runs over several blocks and files.
    """
    n = partitions(captures.sparkSession)
    ordered = captures.repartitionByRange(n, "surt", "page_id").sortWithinPartitions("surt", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(folder)
        name = f"{uuid.uuid4().hex}.idx"
        out, at, lines, directory, count = None, 0, [], [], 0

        def block() -> None:
            nonlocal at
            text = "".join(json.dumps(x, separators=(",", ":"), ensure_ascii=False) + "\n" for x in lines)
            body = zlib.compress(text.encode(), 6)
            out.write(body)
            directory.append([*lines[0][:2], at, len(body)])
            at += len(body)
            lines.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("surt", "page_id", "archive", "offset", "size"))):
                if out is None:
                    out = where.open_output_stream(f"{base}/{name}", compression=None)
                lines.append(row)
                count += 1
                if len(lines) == BLOCK_LINES:
                    block()
        if out is None:
            return
        if lines:
            block()
        body = zlib.compress(json.dumps(directory, ensure_ascii=False).encode(), 6)
        out.write(body)
        out.close()
        row = [[directory[0][0]], [directory[0][1]], [name], [len(body)], [len(directory)], [count]]
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64())
        names = ["first_key", "first_page", "part", "directory", "blocks", "captures"]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names)

    _prepare(folder)
    return store(ordered.mapInArrow(run, PART), "parts")


class _Index:
    """What a task holds of the index: the list of files, one directory and one block."""

    def __init__(self, folder: str, parts: list[tuple]):
        self.where, self.base = _open(folder)
        self.parts = sorted((*_key(p[0], p[1]), p[2], p[3]) for p in parts)
        self.starts = [p[:2] for p in self.parts]
        self.part, self.block = -1, -1

    def _enter(self, part: int) -> None:
        if part != self.part:
            _, _, name, directory = self.parts[part]
            self.file = self.where.open_input_file(f"{self.base}/{name}")
            tail = self.file.read_at(directory, self.file.size() - directory)
            self.directory = json.loads(zlib.decompress(tail))
            self.firsts = [_key(x[0], x[1]) for x in self.directory]
            self.part, self.block = part, -1

    def _load(self, block: int) -> None:
        if block != self.block:
            _, _, at, size = self.directory[block]
            text = zlib.decompress(self.file.read_at(size, at)).decode()
            self.lines = [json.loads(x) for x in text.split("\n") if x]
            self.keys = [_key(x[0], x[1]) for x in self.lines]
            self.block = block

    def captures(self, low: tuple[bytes, int], high: tuple[bytes, int]) -> Iterator[list]:
        """Index lines from ``low`` to ``high``: file, block and line by binary search, then on while they hold."""
        part = max(0, bisect.bisect_left(self.starts, low) - 1)
        while part < len(self.parts) and self.starts[part] <= high:
            self._enter(part)
            block = max(0, bisect.bisect_left(self.firsts, low) - 1)
            while block < len(self.firsts) and self.firsts[block] <= high:
                self._load(block)
                yield from self.lines[bisect.bisect_left(self.keys, low) : bisect.bisect_right(self.keys, high)]
                block += 1
            part += 1


def _fields(member: bytes) -> dict:
    """Headers of one record; its length and, in a response, its payload are checked against them."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(_END)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != _END:
        raise ValueError("a record does not end where its length says")
    if fields["WARC-Type"] == "response":
        payload = block.partition(_END)[2]
        fields["X-Payload-Bytes"] = len(payload)
        if f"sha1:{hashlib.sha1(payload).hexdigest()}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
    return fields


def _whole(value: object) -> int | None:
    return None if value is None else int(value)


def lookup(keys: DataFrame, parts: DataFrame, index: str, archives: str) -> DataFrame:
    """``keys(surt[, page_id])``, distinct -> the records captured under them, read from the archives.

    With a page id column the key is the pair (a null id finds captures without one), else all captures of the
    URL key are returned. Keys without captures give no row. The keys are sorted over the tasks, so neighbours
    share blocks; a task gets the list of index files (a row for each partition that wrote one).
    """
    n = partitions(keys.sparkSession)
    columns = [c for c in ("surt", "page_id") if c in keys.columns]
    files = [tuple(r) for r in parts.select("first_key", "first_page", "part", "directory").collect()]
    paired = "page_id" in columns
    order = keys.select(*columns).repartitionByRange(n, *columns).sortWithinPartitions(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(archives)
        view, opened = _Index(index, files), {}
        for batch in batches:
            sought = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist() if paired else [None] * batch.num_rows)
            rows = []
            for key, page in sought:
                low = _key(key or "", page)
                for _, _, name, at, size in view.captures(low, low if paired else (low[0], 1 << 63)):
                    if name not in opened:
                        if len(opened) == OPEN_FILES:
                            opened.pop(next(iter(opened))).close()
                        opened[name] = where.open_input_file(f"{base}/{name}")
                    f = _fields(opened[name].read_at(size, at))
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    ids = _whole(f.get("X-Page-ID")), _whole(f.get("X-Refers-To-Page"))
                    rows.append((key or "", ids[0], f["WARC-Target-URI"], int(f["X-Payload-Bytes"]), digest, f["WARC-Type"], ids[1]))
            columns = list(zip(*rows)) or [()] * 7
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = [x.split()[0] for x in RECORD.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names)

    return order.mapInArrow(run, RECORD)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` to indexed archives and reads every record back through the index.

    A row for each page: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``. Of equal payloads
    of at least 1000 bytes the page of largest id is the response and others revisit it; repeated rows of that
    page are all responses, a null page id neither revisits nor is revisited. Other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    archives, index = new_folder(spark, "archives"), new_folder(spark, "index")
    captures = write_archives(pages, archives)
    parts = write_index(captures, index)
    keys = pages.select(surt(F.col("url")).alias("surt"), F.col("page_id").cast("long").alias("page_id")).distinct()
    read = lookup(keys, parts, index, archives)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
