"""WARC archives and a two-level capture index: sorted reversed-host keys in compressed blocks under a sparse directory."""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import operator
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import rebatched
from rollcall.storage import materialize, new_path, ship

CRLF = "\r\n"
#: Records of one archive file at most; index lines of one block.
RECORDS_PER_FILE, LINES = 2000, 512
#: Payload bytes up to which so many records share a file, which keeps files below some 500 MB; larger ones have files of their own.
CLASSES = ((1 << 18, RECORDS_PER_FILE), (1 << 25, 16), (None, 1))
#: Bytes of an archive that a task reads back at a time, and of its buffer while it scans one.
STRETCH, BUFFER = 64 << 20, 1 << 22


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column in upper-case base32: four groups of 40 bits, eight digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _records(pages: DataFrame, min_payload: int, date: str) -> DataFrame:
    """record, the record of each page without the two line ends that close it, and bytes, those of its payload."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.regexp_replace(F.col("url").cast("string"), "[\\r\\n]", ""), F.lit("")).alias("url"), body.alias("payload"))
    p = p.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.length("payload").cast("long"))
    # payloads that occur again, with the page that keeps them; counted before the shuffle, and written so that the size is known
    again = p.where((F.col("size") >= min_payload) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    again = materialize(again.where("first < last").select("digest", "first"), "again")
    p = p.join(again, "digest", "left").withColumn("revisit", (F.col("size") >= min_payload) & F.col("first").isNotNull() & (F.col("page_id") > F.col("first")))
    p = p.withColumn("revisit", F.coalesce("revisit", F.lit(False)))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    content = F.when(F.col("revisit"), http.cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    refers = F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Refers-To: "), name(F.col("first")), F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"))).otherwise(F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: "), name(F.col("page_id")), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), F.col("url"), F.lit(CRLF), refers,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.length(content).cast("string"), F.lit(CRLF + CRLF),
    )
    return p.select(F.concat(head.cast("binary"), content).cast("string").alias("record"), F.col("size").alias("bytes"))


def write_warc(pages: DataFrame, path: str, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int | None = None) -> None:
    """Write a record per row of pages (page_id, url, html) to archive files under path.

    Of records with equal payloads of at least min_payload bytes the one with the smallest page_id holds the payload,
    the others revisit it. Null html is empty, null url an empty target; rows with null page_id are responses, and of
    rows that share a page_id none revisits another. Spark's own writer and committer make the files, so a lost
    executor leaves no torn record, and any file system that Spark writes will do. Files are bounded in records and in
    bytes: see CLASSES.
    """
    records, size = _records(pages, min_payload, date), F.coalesce(F.octet_length("html"), F.lit(0))
    most, low = pages.agg(F.max(size)).first()[0] or 0, -1
    for high, count in CLASSES:
        if low < most or low < 0:
            some = records.where((F.col("bytes") > low) & (F.col("bytes") <= high if high is not None else F.lit(True)))
            some.select("record").write.mode("append").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", min(count, records_per_file or count)).text(path)
        low = high


def _headers(data: bytes) -> dict[str, str]:
    """Fields of a record's head, names in lower case, from its bytes before the empty line."""
    lines = data.decode("utf-8", "replace").split(CRLF)
    if not re.fullmatch(r"WARC/\d+\.\d+", lines[0].strip()):
        raise ValueError(f"no record begins with {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if "warc-target-uri" in headers:  # earlier versions put it in brackets
        headers["warc-target-uri"] = headers["warc-target-uri"].removeprefix("<").removesuffix(">")
    return headers


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, content, place after the record) of the record at a place of an archive that is not compressed."""
    end = data.index(b"\r\n\r\n", at)
    headers = _headers(data[at:end])
    start = end + 4
    stop = start + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is not closed")
    return headers, data[start:stop], stop + 4


def record_at(data: bytes, skip: int) -> tuple[dict[str, str], bytes]:
    """(headers, content) of a record from the bytes of its range, which may be a gzip member that begins `skip` bytes before it."""
    return parse_record(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data, skip)[:2]


def scan_records(f) -> Iterator[tuple[dict[str, str], int, int, int]]:
    """(headers, offset, length, skip) of every record of an open archive, plain or in gzip members, by a buffer of bounded size."""
    f.seek(0, 2)
    size, at = f.tell(), 0
    f.seek(0)
    if f.read(2) == b"\x1f\x8b":
        while at < size:
            member, parts, done = zlib.decompressobj(31), [], at
            f.seek(at)
            while not member.eof:
                chunk = f.read(BUFFER)
                if not chunk:
                    raise ValueError(f"the member at {at} is torn")
                parts.append(member.decompress(chunk))
                done += len(chunk)
            done -= len(member.unused_data)
            data, skip = b"".join(parts), 0
            while skip < len(data):
                headers, _, after = parse_record(data, skip)
                yield headers, at, done - at, skip
                skip = after
            at = done
        return
    buffer, base = b"", 0
    while at < size:
        end = buffer.find(b"\r\n\r\n", at - base) if at < base + len(buffer) else -1
        if end < 0:
            f.seek(at)
            buffer, base = f.read(BUFFER), at
            end = buffer.find(b"\r\n\r\n")
            if end < 0:
                raise ValueError(f"no record at {at}")
        headers = _headers(buffer[at - base : end])
        after = base + end + 8 + int(headers["content-length"])
        if after > size:
            raise ValueError(f"the record at {at} is torn")
        yield headers, at, after - at, 0
        at = after


def reversed_host_key(url: str) -> str:
    """Sort key of a URL: host labels from the last to the first, then the path; scheme, port, fragment and case of the host are dropped."""
    try:
        u = urlsplit(url)
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return f"){url}"
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


ENTRY = "key string, record_id string, file string, offset long, length long, skip long"
#: Types of records that are captures of a URL.
CAPTURES = ("response", "revisit", "resource")


def _captures(opened):
    """Captures of the archives that opened(batch) gives, some thousand a batch."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "record_id", "file", "offset", "length", "skip"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in rebatched(batches):
            for name, file in opened(batch):
                for headers, offset, length, skip in scan_records(file):
                    if headers.get("warc-type") in CAPTURES and "warc-target-uri" in headers:
                        rows.append((reversed_host_key(headers["warc-target-uri"]), headers.get("warc-record-id", ""), name, offset, length, skip))
                    if len(rows) >= 5000:
                        yield table(rows)
                        rows = []
        if rows:
            yield table(rows)

    return f


def _by_name(batch: pa.RecordBatch) -> Iterator[tuple[str, object]]:
    for name in batch.column(0).to_pylist():
        with _open(name) as f:
            yield name, f


def _by_content(batch: pa.RecordBatch) -> Iterator[tuple[str, object]]:
    for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield name, io.BytesIO(data.as_py())


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted index lines to compressed blocks with their first and last key."""
    lines: list[str] = []
    keys: list[str] = []

    def flush() -> pa.RecordBatch:
        block = zlib.compress("\n".join(lines).encode())
        out = pa.RecordBatch.from_arrays([pa.array([keys[0]]), pa.array([keys[-1]]), pa.array([len(lines)], pa.int64()), pa.array([block], pa.binary())], names=["first_key", "last_key", "n", "block"])
        lines.clear()
        keys.clear()
        return out

    for batch in rebatched(batches):
        for key, record, file, offset, length, skip in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key, record = re.sub(r"[\t\n\r]", " ", key), re.sub(r"[\t\n\r]", " ", record)
            keys.append(key)
            lines.append(f"{key}\t{record}\t{offset}\t{length}\t{skip}\t{file}")
            if len(lines) == LINES:
                yield flush()
    if lines:
        yield flush()


def build_index(spark: SparkSession, archives: str) -> DataFrame:
    """The blocks of the capture index of all archives (part-*) under a path: first_key, last_key, n, block; sorted by range of keys.

    Archives may be of WARC/1.0 or 1.1, plain or of gzip members; responses, revisits and resources with a target are
    captures. Without the column `block` it is the sparse directory, one row for every LINES captures.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives)
    found = files.select("path").mapInArrow(_captures(_by_name), ENTRY) if reachable(archives) else files.select("path", "content").mapInArrow(_captures(_by_content), ENTRY)
    ordered = materialize(found, "captures").repartitionByRange("key", "record_id").sortWithinPartitions("key", "record_id", "file", "offset", "skip")
    return materialize(ordered.mapInArrow(_pack_blocks, "first_key string, last_key string, n long, block binary"), "index")


def _unpack(block: bytes) -> list[list[str]]:
    return [line.split("\t", 5) for line in zlib.decompress(block).decode().split("\n")]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri).replace("s3a://", "s3://", 1))


def _open(file: str):
    store, path = _store(file)
    return store.open_input_file(path)


def open_range(file: str, offset: int, length: int) -> bytes:
    """length bytes from a place of a file in any store that pyarrow reaches; nothing else of it is read."""
    with _open(file) as f:
        f.seek(offset)
        return f.read(length)


def page_of(record_id: str) -> int | None:
    """The page that a record id of write_warc() names; None for the ids of others."""
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record_id)
    return int(m[1]) if m else None


def captures_of(index: DataFrame, urls: list[str]) -> DataFrame:
    """key, record_id, file, offset, length, skip of all captures of a few URLs.

    The blocks are sorted, so the key range of the URLs skips whole index files and row groups by their statistics; the
    directory columns then name the blocks, in which lines are found by binary search, where the blocks are.
    """
    keys = sorted({reversed_host_key(u) for u in urls})
    hit = (F.col("last_key") >= keys[0]) & (F.col("first_key") <= keys[-1]) if keys else F.lit(False)
    hit = hit & reduce(operator.or_, (F.lit(k).between(F.col("first_key"), F.col("last_key")) for k in keys), F.lit(False))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 64):
            rows = []
            for block in batch.column(0).to_pylist():
                rest = _unpack(block)
                column = [x[0] for x in rest]
                for key in keys:
                    rows += rest[bisect.bisect_left(column, key) : bisect.bisect_right(column, key)]
            if rows:
                key, record, offset, length, skip, file = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(record), pa.array(file), *(pa.array(map(int, x), pa.int64()) for x in (offset, length, skip))], names=["key", "record_id", "file", "offset", "length", "skip"])

    return index.where(hit).select("block").mapInArrow(lines, ENTRY)


def lookup(index: DataFrame, urls: list[str]) -> Iterator[dict]:
    """All captures of a few URLs, page_id, record_id, headers and content, one after another by page_id, the others last:
    directory, block and archive are each read only where they can hold one, and a capture's bytes when it is asked for.
    """
    order = F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1).try_cast("long").asc_nulls_last()
    for r in captures_of(index, urls).orderBy(order, "record_id", "file", "offset", "skip").toLocalIterator():
        headers, content = record_at(open_range(r.file, r.offset, r.length), r.skip)
        yield {"page_id": page_of(r.record_id), "record_id": r.record_id, "headers": headers, "content": content}


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _digest(record: bytes, skip: int) -> tuple:
    headers, content = record_at(record, skip)
    kind, told = headers["warc-type"], headers.get("warc-payload-digest", "")
    payload, size = content, None
    if kind != "resource":
        head, _, payload = content.partition(b"\r\n\r\n")
        size = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        size = int(size[1]) if size else None
    digest = told.removeprefix("sha1:").upper() if told.lower().startswith("sha1:") else None
    if kind != "revisit":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if page_of(headers.get("warc-record-id", "")) is not None and (len(payload) != size or own != digest):
            raise ValueError(f"damaged record {headers['warc-record-id']}")  # others may digest a decoded payload
        size, digest = len(payload), own
    return page_of(headers.get("warc-record-id", "")), size, digest, kind, page_of(headers.get("warc-refers-to", "")) if kind == "revisit" else None, headers["warc-target-uri"]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of captures of a stretch of a file to records, each read at its own range of the open file."""
    for batch in rebatched(batches):
        for file, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            with _open(file) as f:
                for offset, length, skip in sorted((s["offset"], s["length"], s["skip"]) for s in spans):
                    f.seek(offset)
                    rows.append(_digest(f.read(length), skip))
            yield _table(rows)


def _read_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rebatched(batches):
        for data, spans in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            data = memoryview(data.as_buffer())
            yield _table([_digest(data[s["offset"] : s["offset"] + s["length"]].tobytes(), s["skip"]) for s in spans])


def reachable(uri: str) -> bool:
    """Whether pyarrow opens this kind of store."""
    try:
        _store(uri)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def read_archives(spark: SparkSession, archives: str, index: DataFrame) -> DataFrame:
    """A row per capture in the index, read back from its range of its archive.

    Records of write_warc() are checked against their digests. Those of others have a null page_id; a revisit's payload
    size is null if it does not tell one. Work is dealt by stretches of archives. Where pyarrow can't open the store,
    Spark loads the archives and the ranges are cut from them.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 64):
            for block in batch.column(0).to_pylist():
                x = list(zip(*_unpack(block), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x[5], pa.string()), *(pa.array(map(int, x[i]), pa.int64()) for i in (2, 3, 4))], names=["file", "offset", "length", "skip"])

    ship(spark)
    spans = index.select("block").mapInArrow(lines, "file string, offset long, length long, skip long")
    spans = spans.withColumn("stretch", F.floor(F.col("offset") / STRETCH) if reachable(archives) else F.lit(0).cast("long"))
    # so many tasks, however small the list of ranges is beside what is read for it
    held = index.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, min(-(-held // 500), 100 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    spans = spans.repartition(tasks, "file", "stretch").groupBy("file", "stretch").agg(F.collect_list(F.struct("offset", "length", "skip")).alias("spans"))
    if reachable(archives):
        return spans.select("file", "spans").mapInArrow(_read_ranges, READ)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives).select("path", "content")
    return files.join(spans, files.path == spans.file).select("content", "spans").mapInArrow(_read_contents, READ)


def archive_round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder, index them and read every capture back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url; one row per page, see write_warc() for
    nulls and repeated rows. Columns other than page_id, url and html are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    path = new_path(spark, "warc")
    write_warc(pages, path, min_payload)
    return read_archives(spark, path, build_index(spark, path))
