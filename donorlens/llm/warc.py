"""Web archives: writing, reading back, and one global capture index.

*Writing.*  One WARC/1.1 record per page, written as gzip files into the
shared folder (at most ``records_per_file`` records each).  Of records with
equal payloads of at least ``revisit_bytes`` bytes the one with the largest
page_id is the response; the others revisit it and carry no payload.

*Reading.*  Every archive is read back; payloads are checked against their
digests.  The captures of one archive, sorted by (URL key, timestamp), are a
run.

*External merge.*  The key space is cut at keys sampled from the runs by hash
(at most ``sample_keys`` of them).  Every run is dealt, already sorted, over these
ranges, and each range merges its k run parts with a loser tree: range by
range the captures are in global order (``range_no``, ``position``).

The capture time is derived from page_id (modulo PERIOD), as the pages have none.  Defined
results: null html or url count as empty; rows that repeat the largest
page_id of a payload are all responses; a null page_id sorts before all
others and gets a record (its payload is a response only if no row with an
id has it).
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.llm.common import written
from donorlens.session import checkpoint_dir

REVISIT_BYTES = 1000
EPOCH, PERIOD = 1_577_836_800, 100_000_000  # capture times: seconds after 2020-01-01
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
BROADCAST_ROWS = 100_000


# --- writing --------------------------------------------------------------------

def _payload():
    return F.coalesce(F.col("html"), F.lit(""))


def repeated_payloads(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """(rep_digest, rep_id): payloads that more than one row has, with their largest page_id."""
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(_payload()).alias("n"), F.sha1(_payload()).alias("digest"))
    return (keys.where(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.max("page_id").alias("rep_id"))
            .where("times > 1").select(F.col("digest").alias("rep_digest"), "rep_id"))


def records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """One column ``value``: the text of a WARC record, less the closing empty lines."""
    repeated = written(repeated_payloads(pages, revisit_bytes), "payloads")
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # checked size; a shuffle join beyond
        repeated = F.broadcast(repeated)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A").alias("url"),
        _payload().alias("payload"), F.octet_length(_payload()).alias("n"), F.sha1(_payload()).alias("digest"))
    rows = rows.join(repeated, (F.col("digest") == F.col("rep_digest")) & (F.col("n") >= revisit_bytes), "left")
    revisit = F.col("rep_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("rep_id"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(PERIOD))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select(F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), name, F.lit(f">{CRLF}WARC-Date: "), date,
        F.lit(f"{CRLF}WARC-Target-URI: "), F.col("url"), F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: <urn:page:"), F.col("rep_id").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), length.cast("string"), F.lit(CRLF + CRLF),
        http, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, records_per_file: int = 2000) -> str:
    """Writes .gz archives; the two empty lines after a record are the text writer's line separator."""
    (records(pages, revisit_bytes).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))
    return path


# --- reading --------------------------------------------------------------------

_HEADER = re.compile(rb"([A-Za-z-]+): ?(.*)")
_URL = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^#]*)")

INDEX = "url_key string, ts long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long"


def url_key(url: str) -> str:
    """Host reversed and lower-cased, then path and query: captures of a site sort together."""
    m = _URL.match(url)
    if not m:
        return url.lower()
    host, _, port = m[1].lower().partition(":")
    return ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (m[2] or "/")


def _headers(block: bytes) -> dict[bytes, bytes]:
    return {m[1].lower(): m[2].rstrip(b"\r") for m in map(_HEADER.match, block.split(b"\n")) if m}


def _page_number(value: bytes | None) -> int | None:
    digits = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(digits) if digits else None


def read_records(data: bytes) -> Iterator[tuple]:
    """(url key, timestamp, page_id, type, refers_to, payload bytes, digest, offset) of every record."""
    at = 0
    while at < len(data):
        split = data.find(b"\r\n\r\n", at)
        head = _headers(data[at:split])
        start = split + 4
        end = start + int(head[b"content-length"])
        body = data.find(b"\r\n\r\n", start) + 4
        size = int(_headers(data[start:body])[b"content-length"])
        digest = head[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
        kind = head[b"warc-type"].decode()
        if kind == "response" and hashlib.sha1(data[body:end]).hexdigest() != digest:
            raise ValueError(f"damaged record at {at}")
        when = datetime.datetime.fromisoformat(head[b"warc-date"].decode())
        yield (url_key(head[b"warc-target-uri"].decode()), int(when.timestamp()), _page_number(head[b"warc-record-id"]), kind,
               _page_number(head.get(b"warc-refers-to")), size, digest, at)
        at = end + 4


def capture_order(entry: tuple) -> tuple:
    """URL key, timestamp, then page_id (null first) and place."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[7]


def _table(entries: list[tuple], more: dict) -> pa.RecordBatch:
    names = [p.split()[0] for p in INDEX.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    cols = {n: pa.array([e[k] for e in entries], kinds[p.split()[1]]) for k, (n, p) in enumerate(zip(names, INDEX.split(", "), strict=True))}
    return pa.RecordBatch.from_pydict(more | cols)


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each archive's captures, sorted: a run."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            entries = sorted(read_records(zlib.decompress(content.as_py(), 31)), key=capture_order)
            if entries:
                yield _table(entries, {"run": [path.rpartition("/")[2]] * len(entries), "place": list(range(len(entries)))})


def read_runs(spark, path: str) -> DataFrame:
    """(run, place, ...): the captures of every archive in the folder, sorted within the archive."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return archives.mapInArrow(_run_batches, f"run string, place long, {INDEX}")


# --- external merge -------------------------------------------------------------

class LoserTree:
    """Merges sorted sequences: inner nodes keep the loser of their match, so
    the next winner needs one match a level."""

    def __init__(self, runs: list[list[tuple]], key: Callable):
        self.runs, self.key, self.k = runs, key, max(len(runs), 1)
        self.at = [0] * len(runs)
        self.heads = [self._head(r) for r in range(len(runs))] or [None]
        self.loser = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _head(self, run: int):
        return self.key(self.runs[run][self.at[run]]) if self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.loser[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.winner] is not None:
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.heads[run] = self._head(run)
            node = (run + self.k) // 2
            while node >= 1 and self.k > 1:
                if self._beats(self.loser[node], run):
                    run, self.loser[node] = self.loser[node], run
                node //= 2
            self.winner = run


def _range_batches(cuts: list[tuple]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("url_key").to_pylist(), batch.column("ts").to_pylist(), strict=True)
            numbers = [bisect.bisect_right(cuts, k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *batch.columns], ["range_no", *batch.schema.names])

    return run


def _merge_range(group: pa.Table) -> pa.Table:
    group = group.sort_by([("run", "ascending"), ("place", "ascending")])
    names = [p.split()[0] for p in INDEX.split(", ")]
    entries = list(zip(*[group.column(n).to_pylist() for n in names], strict=True))
    runs: dict[str, list[tuple]] = {}
    for run, entry in zip(group.column("run").to_pylist(), entries, strict=True):
        runs.setdefault(run, []).append(entry)
    merged = list(LoserTree(list(runs.values()), capture_order))
    number = group.column("range_no")[0].as_py()
    return pa.Table.from_batches([_table(merged, {"range_no": pa.array([number] * len(merged), pa.int32()), "position": list(range(len(merged)))})])


def merge_runs(runs: DataFrame, rows_per_range: int = 25_000, sample_keys: int = 20_000) -> DataFrame:
    """All captures in global order of (range_no, position)."""
    total = runs.count()
    draw = F.pmod(F.xxhash64("run", "place"), F.lit(max(total, 1)))  # every row with the same chance, wherever it stands in its run
    sample = runs.where(draw < 2 * sample_keys).select("url_key", "ts", draw.alias("draw")).orderBy("draw").limit(sample_keys)
    keys = sorted((r["url_key"], r["ts"]) for r in sample.collect())  # at most sample_keys rows
    ranges = max(1, -(-total // rows_per_range))
    cuts = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []
    dealt = runs.mapInArrow(_range_batches(cuts), f"range_no int, run string, place long, {INDEX}")
    return dealt.groupBy("range_no").applyInArrow(_merge_range, f"range_no int, position long, {INDEX}")


def archive_and_index(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes the pages' archives, reads them back and merges their index."""
    spark = pages.sparkSession
    path = write_archives(pages, f"{checkpoint_dir(spark).rstrip('/')}/donorlens-llm/warc-{uuid.uuid4().hex}", revisit_bytes)
    return merge_runs(written(read_runs(spark, path), "capture-runs"))
