"""WARC archives: writing, reading back, and a merged index of captures.

Writing. A record is a header block and its content; two line ends close it. Spark's own
text writer stores the records with exactly that separator, so archives go to whatever
file system the shared folder is on, under Spark's commit protocol, gzip-compressed.
Records are hashed over as many files as keep each near ``FILE_BYTES``.

Deduplication. Of records with equal payloads, the one with the smallest page_id is a
``response``; the others are ``revisit`` records that name it and carry no payload.
Payloads under ``least`` bytes are always stored.

Reading. Each archive is parsed by the content lengths in its headers, digests are
recomputed, and its captures are sorted by URL key, timestamp and page_id: a run. Runs
are dealt out by ranges of that key (so that a hot URL is split too), and inside a range
the runs are merged by a loser tree. Range and position number the captures in global order.

``pages`` has no capture times: a record's date is its page_id in seconds since 1970.

Nulls: a null html is an empty payload; a null url has no target header, an empty URL key
and comes back null; a null page_id has no id header, is always a response and comes back
null. Rows repeated under one page_id are captured each time, with the same type. Line ends and percent signs in URLs are percent-encoded in
headers. An empty table gives no archive rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: Uncompressed bytes meant for an archive file.
FILE_BYTES = 24_000_000
#: Captures meant for a range of the merged index.
RANGE_ROWS = 100_000
END = "\r\n"
RECORD_END = "\r\n\r\n"

#: The digits of base 32 as Java counts them, and as RFC 4648 does.
JAVA_BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RFC_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """RFC 4648 base 32 of 40 hexadecimal digits: ten of them make eight."""
    eights = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*eights), JAVA_BASE32, RFC_BASE32)


def header_safe(url: Column) -> Column:
    for plain, coded in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(plain), F.lit(coded))
    return url


def planned(pages: DataFrame, files: int, least: int = 0) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to; html is the payload, null in revisits."""
    payload = store.text_or_empty("html")
    rows = pages.select(F.col("page_id"), F.col("url"), payload.alias("html")).withColumns(
        {"payload_bytes": F.octet_length("html").cast("long"), "sha": F.unhex(F.sha1("html"))}
    )
    facts = store.stage(rows.select("page_id", "sha", "payload_bytes"), "payloads")
    named = facts.where("page_id IS NOT NULL")
    first = named.groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n")).groupBy("sha").agg(F.min("page_id").alias("first"), F.sum("n").alias("n"))
    first = store.stage(first.where("n > 1"), "repeated-payloads")  # the rest needs no lookup
    total = first.agg(F.sum("n")).first()[0] or 0
    refers = store.attach(named, first, "sha", "n", total).where((F.col("payload_bytes") >= least) & (F.col("page_id") != F.col("first")))
    refers = refers.select(F.col("page_id").alias("id"), F.col("sha").alias("same"), "first").distinct().withColumn("spread", F.lit(0).cast("long"))
    # rows without an id refer to nothing: they only need to be spread
    rows = rows.withColumn("spread", F.when(F.col("page_id").isNull(), F.xxhash64("url", "sha", F.monotonically_increasing_id())).otherwise(F.lit(0).cast("long")))
    # both sides are dealt by id and payload into as many partitions as there will be files, so payloads move once
    keys = (("page_id", "id"), ("sha", "same"), ("spread", "spread"))
    refers = refers.repartition(files, *(r for _, r in keys)).withColumnRenamed("spread", "none")
    out = rows.repartition(files, *(k for k, _ in keys)).join(refers.hint("shuffle_hash"), [F.col("page_id") == F.col("id"), F.col("sha") == F.col("same"), F.col("spread") == F.col("none")], "left")
    again = F.col("first").isNotNull()
    return out.select(
        "page_id",
        "url",
        F.when(~again, F.col("html")).alias("html"),
        "payload_bytes",
        base32(F.hex("sha")).alias("payload_digest"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("first").alias("refers_to"),
    )


def record_text() -> Column:
    """The whole record, without the two line ends that close it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    none = F.lit("")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(END))
    block = F.concat(http, F.coalesce("html", none))
    page = F.col("page_id").cast("string")
    when = F.date_format(F.timestamp_seconds(F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(4_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.col("record_type")),
        F.coalesce(line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))), none),
        line("WARC-Date", when),
        F.coalesce(line("WARC-Target-URI", header_safe(F.col("url"))), none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.coalesce(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), none),
        F.when(F.col("record_type") == "revisit", line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(none),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) below ``path``."""
    size = pages.agg(F.sum(F.octet_length("html")), F.count(F.lit(1))).first()
    # never fewer than Spark's own partitions, else it would deal the payloads out once more for the join
    files = max(store.parallelism(pages.sparkSession), ((size[0] or 0) + 600 * size[1]) // FILE_BYTES)
    # ids spread evenly, so files do; a file is a task's work and no larger at any scale
    planned(pages, int(files), least).select(record_text().alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(END)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        at = start + int(fields["Content-Length"])
        yield fields, data[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record doesn't end at byte {at}")
        at += 4


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query: captures of one site sort together."""
    if url is None:
        return ""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    labels = host.removeprefix("www.").split(".")
    return (",".join(reversed(labels)) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


CAPTURES = (
    "url_key string, captured string, page_id long, url string, record_type string, payload_bytes long,"
    " payload_digest string, refers_to long, archive string, run_pos long"
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive below ``path``; those of one archive form a sorted run."""

    def number(urn: str | None) -> int | None:
        return int(urn[len("<urn:page:") : -1]) if urn else None

    def capture(name: str, fields: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != digest or size != len(payload):
                raise ValueError(f"damaged payload in {name}")
        url = fields.get("WARC-Target-URI")
        url = None if url is None else decode_url(url)
        return (url_key(url), fields["WARC-Date"], number(fields.get("WARC-Record-ID")), url, kind, size, digest, number(fields.get("WARC-Refers-To")), name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [capture(name, fields, block) for fields, block in parse_archive(gzip.decompress(content))]
                rows.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2]))
                names = [c.split()[0] for c in CAPTURES.split(", ")]
                for k in range(0, len(rows), 5000):
                    part = [(*r, k + i) for i, r in enumerate(rows[k : k + 5000])]
                    yield pd.DataFrame(part, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInPandas(run, CAPTURES)


def decode_url(url: str) -> str:
    for plain, coded in (("\n", "%0A"), ("\r", "%0D"), ("%", "%25")):
        url = url.replace(coded, plain)
    return url


class LoserTree:
    """Merges sorted runs: a leaf for each run; each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * self.k
        for leaf in range(len(self.runs)):
            self._play(leaf)

    def _less(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to arrive waits here
                self.losers[node] = winner
                return
            if self._less(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.runs:
            winner = self.losers[0]
            if self.keys[winner] is None:
                return
            yield self.heads[winner]
            head = self.heads[winner] = next(self.runs[winner], None)
            self.keys[winner] = None if head is None else self.key(head)
            self._replay(winner)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self._less(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner


def merge_captures(captures: DataFrame) -> DataFrame:
    """``captures`` with capture_order, their place in the global order by url_key, captured and page_id."""
    spark = captures.sparkSession
    n = max(1, captures.count() // RANGE_ROWS, min(store.parallelism(spark), captures.count() // 1000))
    schema = CAPTURES + ", capture_order long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        keys = list(zip(rows["url_key"], rows["captured"], rows["page_id"].fillna(-1).astype("int64"), strict=True))
        runs = [iter(group) for group in rows.groupby("archive", sort=True).indices.values()]
        order = list(LoserTree(runs, keys.__getitem__))
        out = rows.iloc[order].astype({"page_id": "Int64", "refers_to": "Int64"})
        yield out.assign(capture_order=range(base, base + len(out)))

    ranged = captures.repartitionByRange(n, "url_key", "captured", "page_id").sortWithinPartitions("archive", "run_pos")
    return ranged.mapInPandas(run, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "archives")
    write_archives(store.table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    merged = merge_captures(store.stage(read_archives(spark, path), "captures"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha),
d AS (SELECT sha, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(sha, CAST(1 + 5 * (k // 4) AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - k % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1), '' ORDER BY k) AS digest
  FROM g, range(0, 32) AS r(k) GROUP BY sha)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN p.page_id = g.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> g.first THEN g.first END AS refers_to
FROM p JOIN g USING (sha) JOIN d USING (sha)
"""
