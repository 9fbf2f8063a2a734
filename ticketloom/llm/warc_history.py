"""WARC archives with revisit records, read back into capture histories that are in order over the whole table.

Writing: equal payloads (by SHA-1 and size) are stored once, as the response of the smallest page_id; the others are
revisit records. Records are rows of a text file whose separator is the blank line that ends a WARC record, so Spark's
own writer makes the archives, in the shared folder. Reading: each archive is parsed record by record into a run that
is sorted by URL key and timestamp; runs are dealt by ranges of (key, timestamp, page_id), and a loser tree merges the
runs of each range, whose order makes the history's.

The table has no capture time, so one is made from the id: FIRST_SECOND plus the id modulo SPAN seconds.

Cases: null html is an empty payload; a null url has the key ""; equal keys and times go by page_id; an id that repeats
with the payload's smallest id is a response each time, as nothing can revisit itself, and one that repeats with another
payload is a record for each; rows with a null page_id are kept, as responses that nothing refers to; ids are any 64-bit
integers, and an id of another type is an error that names it; an empty table gives no archive and no row. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, bounded_batches, new_path, table

#: Parameters: bytes of an archive on average, smallest payload that is stored once, first capture's time in Unix seconds, seconds of all captures.
ARCHIVE_BYTES, LEAST_BYTES, FIRST_SECOND, SPAN = 4 << 20, 0, 1_704_067_200, 1_000_000_000
_END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hex digits, without Python: 20 bits give four letters."""
    groups = [F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    return F.concat(*[F.substring(F.lit(_BASE32), F.shiftright(g, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in groups for k in range(4)])


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, record): a WARC record without its closing blank line, for each row."""
    if (kind := dict(pages.dtypes)[page_id]) not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{page_id} is {kind}; record ids are integers of at most 64 bits")
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("body")).withColumn("size", F.octet_length("body").cast("long")).withColumn("sha", F.sha1(F.col("body").cast("binary")))
    # A partial minimum before the shuffle: a payload that fills a third of the table sends one row from each task.
    first = rows.filter(f"page_id is not null and size >= {least}").groupBy("sha", "size").agg(F.min("page_id").alias("first_id"))
    # The one shuffle of the bodies. A payload that many pages share makes a large partition, which Spark splits: only its
    # first record keeps the body.
    rows = rows.join(first, ["sha", "size"], "left")
    revisit = (F.col("first_id") != F.col("page_id")) & F.col("page_id").isNotNull()
    rows = rows.withColumn("refers", F.when(revisit, F.col("first_id")))
    kept = F.when(F.col("refers").isNull(), F.col("body")).otherwise("")
    at = F.lit(FIRST_SECOND) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(SPAN))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("refers").isNull(), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", "")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers").cast("string"), F.lit(">")),
        F.when(F.col("refers").isNotNull(), "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha"))),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("size").cast("string")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(kept).cast("string")),
    )
    return rows.select("page_id", F.concat(head, F.lit(_END), kept).alias("record"))


def write_archives(rows: DataFrame, path: str, most: int) -> None:
    """Files of at most `most` WARC records, gzipped whole, as the rows lie: no further shuffle."""
    rows.select("record").write.option("maxRecordsPerFile", most).option("lineSep", _END).option("compression", "gzip").text(path)


def url_key(url: str | None) -> str:
    """Host labels from the last, then path and query: com,example)/path?query."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (unquote(u.path).lower() or "/") + ("?" + u.query.lower() if u.query else "")


_field = re.compile(rb"([A-Za-z-]+): *([^\r\n]*)").findall
_page = re.compile(rb"<urn:page:(-?[0-9]+)>").fullmatch


def parse(data: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """(fields, block) of each record of an archive, by the lengths that the records state."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        body = data.index(b"\r\n\r\n", at) + 4
        fields = {k.decode().lower(): v for k, v in _field(data[at:body])}
        end = body + int(fields["content-length"])
        yield fields, data[body:end]
        at = end


class LoserTree:
    """Merge of sorted runs: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.tree = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _head(self, i: int) -> tuple:
        run = self.runs[i]
        return (0, run[self.at[i]], i) if self.at[i] < len(run) else (1, (), i)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:  # the first to come waits for its rival
                self.tree[node] = i
                return
            if self._head(other) < self._head(i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and not (head := self._head(self.tree[0]))[0]:
            yield head[1]
            i = head[2]
            self.at[i] += 1
            self._play(i)


def _order(place: tuple) -> tuple:
    """A record's (url_key, capture_ts, page_id) for comparing; a null id comes first, as in Spark's order."""
    return *place[:2], place[2] is not None, place[2] or 0


_RUN = "run long, url_key string, capture_ts long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_NAMES = [c.split()[0] for c in _RUN.split(", ")]


def read_runs(archives: DataFrame) -> DataFrame:
    """A sorted run for each archive (binaryFile rows), with digests of the payloads that it holds."""
    def rows(data: bytes, run: int) -> Iterator[tuple]:
        for f, block in parse(data):
            page, ref = _page(f["warc-record-id"]), _page(f.get("warc-refers-to", b""))
            kind = f["warc-type"].decode()
            if kind == "response":
                size, digest = len(block), base64.b32encode(hashlib.sha1(block).digest()).decode()
            else:
                size, digest = int(f["warc-payload-length"]), f["warc-payload-digest"].decode().removeprefix("sha1:")
            second = int(pd.Timestamp(f["warc-date"].decode()).timestamp())
            yield run, url_key(f.get("warc-target-uri", b"").decode()), second, int(page[1]) if page else None, size, digest, kind, int(ref[1]) if ref else None

    def parsed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for p in parts:
            for path, data in zip(p["path"], p["content"], strict=True):
                run = int.from_bytes(hashlib.sha256(path.encode()).digest()[:7], "big")
                got = sorted(rows(gzip.decompress(data), run), key=lambda r: _order(r[1:4]))
                if got:
                    d = pd.DataFrame(got, columns=_NAMES)
                    yield d.astype({"page_id": "Int64", "refers_to": "Int64"})

    return archives.select("path", "content").mapInPandas(parsed, _RUN)


def merge_runs(runs: DataFrame, ranges: int) -> DataFrame:
    """The runs' rows in order of (url_key, capture_ts, page_id): partitions are ranges, each a merge of its runs' parts."""
    bounded_batches(runs.sparkSession)

    def merged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}
        for p in parts:
            for r in p.astype(object).where(p.notna(), None).itertuples(index=False, name=None):
                held.setdefault(r[0], []).append((*_order(r[1:4]), r))
        out: list[tuple] = []
        for *_, r in LoserTree([held[k] for k in sorted(held)]):
            out.append(r)
            if len(out) == 2000:
                yield pd.DataFrame(out, columns=_NAMES).astype({"page_id": "Int64", "refers_to": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out, columns=_NAMES).astype({"page_id": "Int64", "refers_to": "Int64"})

    dealt = runs.repartitionByRange(ranges, "url_key", "capture_ts", "page_id").sortWithinPartitions("run", "url_key", "capture_ts", "page_id")
    return dealt.mapInPandas(merged, _RUN)


def histories(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Archives of `pages`, written and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, capture_ts)."""
    spark = pages.sparkSession
    sums = pages.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.col(html))).alias("bytes")).first()
    path = new_path(spark, "warc")
    archives = max(1, round((sums["bytes"] or 0) / ARCHIVE_BYTES))
    write_archives(records(pages, page_id, url, html, least), path, max(1, -(-sums["rows"] // archives)))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    with batch_rows(spark, 4):  # rows of a whole archive each
        runs = table(read_runs(files), "runs")
    return merge_runs(runs, max(1, archives // 4)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_ts")
