"""WARC archives and their merged index.

Writing: one WARC/1.1 record per row, as text files whose line separator is the
record separator, so Spark's own writer and commit protocol put the archives in
any store that Spark reaches; files are gzip streams, bounded by records and by
bytes: payloads are written by size, larger ones with fewer in a file, so that a
file holds ``file_bytes`` of them at most, or one record. Of the records with equal
payloads (SHA-256 and length) of at least ``least_revisit`` bytes, the one with
the largest id is a response and the others revisit it, without a body.

Reading: each archive file is decompressed and parsed by its Content-Length
fields, which gives the file's capture run, sorted by URL key (SURT), timestamp
and id. Payloads of responses are checked against their digests.

Index: the runs are dealt into key ranges; within a range, the runs' sorted
segments meet in a k-way merge by a loser tree. The ranges in order are the
globally ordered capture histories. The range key ends in the timestamp and id,
so that a URL with a third of all captures spreads over many ranges, and their
number grows with the index.

Edge cases: null payload counts as empty; a null URL has an empty target and
key; a null id is written without one and comes back as null. Rows that repeat
the largest id of a payload are all responses. An empty table gives an empty
result. Control characters in a URL are percent-encoded, each by its code.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship

LEAST_REVISIT, ROWS_PER_FILE, FILE_BYTES, ROWS_PER_RANGE, MAX_BROADCAST_ROWS = 1000, 2000, 64 << 20, 100_000, 400_000
BASE_DATE = 1_704_067_200  # 2024-01-01T00:00:00Z
END = "\r\n\r\n"
INDEX = "run string, at long, length long, url_key string, url string, captured long, id long, kind string, payload_bytes long, payload_digest string, refers_to long"


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _percent_encoded(url: Column) -> Column:
    """The URL with its control characters by their codes."""
    found = url
    for code in (*range(32), 127):
        found = F.replace(found, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x1F\x7F]"), found).otherwise(url)


def size_classes(rows_per_file: int, file_bytes: int) -> list[tuple[int | None, int]]:
    """(largest payload in bytes, records of a file) from small payloads to unbounded ones."""
    out, rows = [], rows_per_file
    while rows > 1:
        out.append((file_bytes // rows, rows))
        rows //= 8
    return [*out, (file_bytes, 1), (None, 1)]


def records(pages: DataFrame, least_revisit: int = LEAST_REVISIT, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", captured: Column | None = None) -> DataFrame:
    """The text of each row's WARC record (value) and its payload's bytes. captured: seconds since 1970; by default a fixed date plus the id in seconds."""
    scratch = Scratch(pages.sparkSession, "payloads")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).alias("bytes"),
        F.unhex(F.sha2(payload, 256)).alias("same"),
        (F.lit(BASE_DATE) + F.coalesce(F.col(id_col), F.lit(0)) if captured is None else captured).cast("long").alias("captured"),
    )
    large = rows.where(F.col("bytes") >= least_revisit)
    repeated = scratch.table(large.groupBy("same", "bytes").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"), "repeated")
    small = repeated.count() <= MAX_BROADCAST_ROWS
    rows = rows.join(F.broadcast(repeated) if small else repeated, ["same", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda x: F.concat(F.lit("<urn:x-capture:"), x.cast("string"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _header("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.coalesce(name(F.col("id")), F.lit("<urn:x-capture:none>"))),
        _header("WARC-Date", F.date_format(F.timestamp_seconds("captured"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _header("WARC-Target-URI", _percent_encoded(F.col("url"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload"))),
        _header("WARC-Refers-To", F.when(revisit, name(F.col("first")))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return rows.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"), "bytes")


def _class_of(classes: list) -> Column:
    """The number of a payload's size class."""
    kind = F.lit(len(classes) - 1)
    for k, (most, _) in reversed(list(enumerate(classes[:-1]))):
        kind = F.when(F.col("bytes") <= most, k).otherwise(kind)
    return kind


def write_archives(pages: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, file_bytes: int = FILE_BYTES, payload_col: str = "html", **columns) -> None:
    """Archives as gzip streams under path, in a folder for each size class that occurs: of rows_per_file records and file_bytes of payloads at most, or one record."""
    classes = size_classes(rows_per_file, file_bytes)
    sizes = pages.select(F.coalesce(F.octet_length(payload_col), F.lit(0)).alias("bytes"))
    occurring = sorted(r[0] for r in sizes.select(_class_of(classes)).distinct().collect())  # as many as classes at most
    rows = records(pages, payload_col=payload_col, **columns)
    for k in occurring or [0]:
        lines = rows.where(_class_of(classes) == k).select("value").write.mode("overwrite").option("lineSep", END).option("compression", "gzip")
        lines.option("maxRecordsPerFile", classes[k][1]).text(f"{path}/class{k}")


def url_key(url: str | None) -> str:
    """Sort-friendly form: reversed host, port, path and query, lower case, without www and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    host = host.removeprefix("www.")
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


class _Stream:
    """Sequential reads from a gzip stream, of which little is inflated ahead."""

    def __init__(self, data: memoryview):
        self.data, self.fed, self.at, self.buffer, self.inflate = data, 0, 0, bytearray(), zlib.decompressobj(31)

    def _fill(self) -> bool:
        if self.fed >= len(self.data):
            return False
        if self.inflate.eof:  # the next member of the file
            self.inflate = zlib.decompressobj(31)
        chunk = self.data[self.fed : self.fed + 65536]
        self.buffer += self.inflate.decompress(chunk)
        self.fed += len(chunk) - len(self.inflate.unused_data)
        return True

    def until(self, mark: bytes) -> bytes:
        """Bytes before the mark, which is skipped; nothing at the end of the stream."""
        start = 0
        while (k := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self._fill():
                return b""
        return self.take(k + len(mark))[:k]

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._fill():
                raise ValueError("an archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.at += n
        return out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def parse_archive(run: str, content) -> list[tuple]:
    """The file's capture run: index rows sorted by URL key, timestamp and id."""
    import calendar
    import time

    stream, out = _Stream(memoryview(content)), []
    number = lambda x: int(x.rpartition(":")[2].rstrip(">")) if x and x != "<urn:x-capture:none>" else None
    while True:
        at = stream.at
        if not (head := stream.until(END.encode())):
            break
        f = _fields(head)
        block = stream.take(int(f["content-length"]))
        if stream.take(4) != END.encode():
            raise ValueError(f"{run}: the record at {at} isn't followed by its separator")
        http, _, payload = block.partition(END.encode())
        digest = f["warc-payload-digest"].removeprefix("sha1:")
        length = int(_fields(http)["content-length"])
        if f["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{run}: the payload of the record at {at} doesn't match its digest")
        url = f.get("warc-target-uri")
        captured = calendar.timegm(time.strptime(f["warc-date"], "%Y-%m-%dT%H:%M:%SZ"))
        out.append((run, at, stream.at - at, url_key(url), url, captured, number(f["warc-record-id"]), f["warc-type"], length, digest, number(f.get("warc-refers-to"))))
    return sorted(out, key=_order)


def _order(row: tuple) -> tuple:
    return row[3], row[5], row[6] is None, row[6] or 0, row[0], row[1]


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """Merged order of sorted runs, as (run, place in it). Inner nodes hold the losers; a step replays one path to the root."""
    k = len(runs)
    at = [0] * k

    def ahead(a: int, b: int) -> bool:
        """Whether a's head comes before b's; -1 stands for a run that is not yet played, which goes first."""
        if a < 0 or b < 0:
            return a < 0
        if at[a] == len(runs[a]) or at[b] == len(runs[b]):
            return at[b] == len(runs[b]) and (at[a] < len(runs[a]) or a < b)
        x, y = runs[a][at[a]], runs[b][at[b]]
        return x < y or x == y and a < b

    losers = [-1] * max(1, k)

    def replay(run: int) -> None:
        winner, node = run, (run + k) // 2
        while node:
            if ahead(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        losers[0] = winner

    for run in reversed(range(k)):
        replay(run)
    while k and at[losers[0]] < len(runs[losers[0]]):
        run = losers[0]
        yield run, at[run]
        at[run] += 1
        replay(run)


def _parse(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in INDEX.split(", "))])
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows = parse_archive(path.as_py().rpartition("/")[2], content.as_buffer())
            for k in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 5000], strict=True), schema.types, strict=True)], schema=schema)


def _merge(batches: Iterator) -> Iterator:
    import pyarrow as pa

    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    runs: dict[str, list[tuple]] = {}
    place: dict[str, list[int]] = {}
    for k, row in enumerate(zip(*(c.to_pylist() for c in table.columns), strict=True)):
        runs.setdefault(row[0], []).append(_order(row))
        place.setdefault(row[0], []).append(k)
    names = list(runs)
    order = [place[names[run]][k] for run, k in loser_tree([runs[x] for x in names])]
    yield from table.take(order).combine_chunks().to_batches()


def read_index(spark: SparkSession, path: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The merged index of all archives under path, in global order of URL key, timestamp and id."""
    ship(spark)
    scratch = Scratch(spark, "index")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    runs = scratch.table(files.mapInArrow(_parse, INDEX), "runs")
    ranges = max(1, math.ceil(runs.count() / rows_per_range))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "id", "run", "at")
    return dealt.sortWithinPartitions("run", "url_key", "captured", "id", "at").mapInArrow(_merge, INDEX)


def archive(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write the archives and give back their merged index."""
    spark = pages.sparkSession
    path = path or f"{Scratch(spark, 'warc').path}/archives"
    write_archives(pages, path, **columns)
    return read_index(spark, path)
