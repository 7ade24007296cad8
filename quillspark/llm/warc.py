"""WARC archives of pages, and their capture index by external merge.

Writing: a record for each page, in gzipped archives that Spark's text writer makes in any
store it can write to (a record is valid UTF-8 and ends in a line feed). Of records with
equal payloads of at least 1000 bytes, the one with the largest page_id is a response, the
others revisit it.

Index: each archive read back gives a run of captures sorted by URL key, time and page;
runs are written down. The key range is dealt to tasks; each task merges its slices of all
runs with a loser tree, so that tasks in order, and rows in a task, are the captures of all
archives in one order.

Rows: null html is an empty payload; a null url has no target line and an empty URL key; a
page without an id is a response unless a page with an id holds the same payload; rows
that repeat a page_id are records each, and all of them are responses where that id is the
largest of their payload; extra columns are ignored; an empty table gives no archives and
an empty index.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path

#: fixed values: smallest payload that is deduplicated; the day that a page's seconds count from
MIN_PAYLOAD = 1000
EPOCH = "2024-01-01 00:00:00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 20_000

CAPTURE = "urlkey string, ts string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"
_FIELDS = [f.split()[0] for f in CAPTURE.split(", ")]
_ARROW = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (f.split() for f in CAPTURE.split(", "))])


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of every page."""
    payload = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("long"), F.col("url"), payload.alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large = F.col("payload_bytes") >= MIN_PAYLOAD
    chosen = p.where(large).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("chosen"))
    p = p.join(chosen, ["payload_digest", "payload_bytes"], "left")
    again = F.col("chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chosen"))
    return p.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("chosen")).alias("refers_to"))


def write(pages: DataFrame, path: str) -> None:
    """Archives of all pages under path."""
    end = "\r\n"
    r = records(pages)
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("payload_bytes"), F.lit(end + end))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    date = F.date_format(F.timestamp_seconds(F.unix_seconds(F.lit(EPOCH).cast("timestamp")) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # white space and control characters can't stand in a header line
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat_ws(
        end,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{end}WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block")),
    )
    lines = r.withColumn("block", block).select(F.concat(head, F.lit(end + end), "block", F.lit("\r\n\r")).alias("value"))
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def url_key(url: str | None) -> str:
    """Host reversed by commas, then path and query: pages of a site sort together."""
    if not url:
        return ""
    try:
        u = urlsplit(url)
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return url
    host = re.sub(r"^www\d*\.", "", host)
    at = "" if port in (None, 80, 443) else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{at}){u.path or '/'}{'?' + u.query if u.query else ''}"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record of an archive's bytes."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        begin = stop + 4
        end = begin + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it says")
        yield headers, data[begin:end], at, end + 4 - at
        at = end + 4


def _page(urn: str | None) -> int | None:
    name = urn[len("<urn:page:") : -1] if urn else "none"
    return None if name == "none" else int(name)


def captures(data: bytes, file: str) -> list[tuple]:
    """An archive's captures as a sorted run. Payloads are checked against their digests."""
    out = []
    for h, block, offset, length in parse(data):
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{file}: the payload at {offset} isn't the one written")
        out.append((url_key(h.get("WARC-Target-URI")), h["WARC-Date"], _page(h["WARC-Record-ID"]), size, digest, h["WARC-Type"], _page(h.get("WARC-Refers-To")), file, offset, length))
    return sorted(out, key=_order)


def _order(c: tuple) -> tuple:
    return c[0], c[1], c[2] is not None, c[2] or 0, c[7], c[8]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The sorted run of each archive under path: captures and their place in the run."""

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name = file.rsplit("/", 1)[-1]
                rows = captures(zlib.decompress(content.as_buffer(), 31), name)
                for lo in range(0, len(rows), 10_000):
                    part = rows[lo : lo + 10_000]
                    cols = [pa.array([r[i] for r in part], f.type) for i, f in enumerate(_ARROW)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(range(lo, lo + len(part)), pa.int64())], names=[*_FIELDS, "place"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return files.select("path", "content").mapInArrow(run, f"{CAPTURE}, place bigint")


class LoserTree:
    """Merges sorted runs: each inner node holds the run that lost there, the root's winner comes next.
    Replacing the winner replays one path, log2(runs) comparisons."""

    def __init__(self, runs: list[Iterable], key):
        self.key, self.runs = key, [iter(r) for r in runs]
        self.n = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(self.n, 1)
        for i in range(self.n):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        """Does run a's head come before run b's? Runs that have ended come last."""
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, winner: int) -> None:
        node = (winner + self.n) // 2
        while node:
            if self.losers[node] < 0:  # building: waits for the other side
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.n:
            w = self.losers[0]
            head = self.heads[w]
            if head is None:
                return
            yield head
            self.heads[w] = nxt = next(self.runs[w], None)
            self.keys[w] = None if nxt is None else self.key(nxt)
            self._replay(w)


def merged(runs: DataFrame) -> DataFrame:
    """All captures in one order: by shard, then position in the shard."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartitionByRange(parts, "urlkey", "ts", F.col("page_id").asc_nulls_first(), "file", "offset")

    def run(batches):
        slices: dict[str, list[tuple]] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                slices.setdefault(row[7], []).append(row)
        for s in slices.values():
            s.sort(key=lambda r: r[-1])  # a run's rows may come in several pieces
        shard = TaskContext.get().partitionId()
        rows, position = [], 0
        for row in LoserTree([slices[k] for k in sorted(slices)], _order):
            rows.append((*row[:-1], shard, position + len(rows)))
            if len(rows) == 10_000:
                yield _batch(rows)
                position, rows = position + len(rows), []
        if rows:
            yield _batch(rows)

    def _batch(rows):
        kinds = [*(f.type for f in _ARROW), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*_FIELDS, "shard", "position"])

    return dealt.mapInArrow(run, f"{CAPTURE}, shard int, position bigint")


def histories(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes archives of all pages under path (by default in the shared folder), and their merged index."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, f"{path}/archives")
    read_runs(spark, f"{path}/archives").write.parquet(f"{path}/runs")
    return merged(spark.read.schema(f"{CAPTURE}, place bigint").parquet(f"{path}/runs"))


def digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record read back."""
    return histories(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
