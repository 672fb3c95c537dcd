"""WARC archives of pages, and the global order of their captures by an external index merge.

Records are written by Spark's own writer, whose line separator is the end of a WARC record, so archives land
in whatever store Spark writes to. Reading back parses records by their lengths. Each archive then gives one
run of captures, sorted where it was read; runs are dealt out by ranges of (URL key, time), and each range
merges its parts of the runs with a tree of losers.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = 1_704_067_200  # captures count seconds from 2024-01-01, one a page_id, over ten years
CAPTURE = "urlkey string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, at long"


def decided(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of at least `least` bytes the largest page_id is the response.

    refers_to is null for responses. Rows that repeat the response's page_id, and groups without any page_id, are
    responses. Null html is the empty payload.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    long = rows.where(F.octet_length("payload") >= least)
    first = written(long.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"))
    return rows.join(first, "digest", "left").withColumn("refers_to", F.when(F.octet_length("payload") >= least, F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))).drop("first")


def record(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A WARC/1.1 record without its end: a response with its payload, or a revisit with the HTTP head only."""
    name = F.coalesce(page_id.cast("string"), F.lit("null"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END))
    block = F.when(refers_to.isNull(), F.concat(http, payload)).otherwise(http)
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(315_360_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(refers_to.isNull(), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), "[\\x00-\\x20]", "%20")),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(refers_to.isNotNull(), F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(END), block)


def write_warc(pages: DataFrame, path: str, least: int = 1000, records_per_file: int = 20_000) -> None:
    """One record per row of pages, into gzip archives of at most records_per_file records under path."""
    rows = decided(pages, least).select(record(*(F.col(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))).alias("value"))
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def url_key(url: str) -> str:
    """The URL with its host turned round, without scheme, www., default port or fragment; in lower case."""
    try:
        x = urlsplit(url.strip().lower())
        host, port = (x.hostname or "").removeprefix("www."), x.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    end = f":{port}" if port and port not in (80, 443) else ""
    query = "?" + "&".join(sorted(x.query.split("&"))) if x.query else ""
    return f"{','.join(reversed(host.split('.')))}{end}){x.path or '/'}{query}"


def records(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers in lower case, block) of each record of an uncompressed archive."""
    at = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}: {line[:40]!r}")
        size, head = len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            k, _, v = line.decode("utf-8").partition(":")
            head[k.lower()] = v.strip()
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut short")
        yield at, head, block
        at += size + len(line) + n + 4


def _captures(name: str, content: bytes) -> list[tuple]:
    """The captures of one archive in order; a response's digest is computed anew and must agree."""
    out = []
    ident = lambda x: None if x == "<urn:page:null>" else int(x.removeprefix("<urn:page:").removesuffix(">"))
    for at, head, block in records(gzip.GzipFile(fileobj=io.BytesIO(content))):
        http, _, payload = block.partition(b"\r\n\r\n")
        digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(http.rpartition(b"Content-Length:")[2])
        kind = head["warc-type"]
        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
            raise ValueError(f"{name}: the payload at {at} is not what its digest says")
        refers = ident(head["warc-refers-to"]) if kind == "revisit" else None
        out.append((url_key(head["warc-target-uri"]), head["warc-date"], ident(head["warc-record-id"]), size, digest, kind, refers, name, at))
    return sorted(out, key=order)


def order(x: tuple) -> tuple:
    """URL key, time, then page_id (null first), archive and offset."""
    return (x[0], x[1], x[2] is not None, x[2] or 0, x[7], x[8])


def _batches(rows: Iterator[tuple], names: list[str], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], schema)


NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
ARROW = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in CAPTURE.split(", "))])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under path; those of one archive are a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for k in range(x.num_rows):
                yield from _batches(iter(_captures(x.column(0)[k].as_py().rsplit("/", 1)[-1], x.column(1)[k].as_py())), NAMES, ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CAPTURE)


def merged(runs: list[list[tuple]], key=order) -> Iterator[tuple]:
    """The rows of sorted runs in order, by a tree of losers: each row costs one comparison a level.

    loser[k] is the run that lost the match at inner node k; leaves k stand at len(runs) + k. Ties go to the
    run that comes first.
    """
    n = len(runs)
    if n < 2:
        yield from (runs[0] if runs else ())
        return
    at = [0] * n
    head = [(0, key(r[0]), k) if r else (1, (), k) for k, r in enumerate(runs)]  # 1: run out
    winner, loser = [0] * n + list(range(n)), [0] * n
    for node in range(n - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if head[a] < head[b] else (b, a)
    first = winner[1]
    while not head[first][0]:
        run = runs[first]
        yield run[at[first]]
        at[first] += 1
        head[first] = (0, key(run[at[first]]), first) if at[first] < len(run) else (1, (), first)
        node = (n + first) // 2
        while node:
            if head[loser[node]] < head[first]:
                loser[node], first = first, loser[node]
            node //= 2


def capture_histories(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """All captures in global order of (urlkey, captured, page_id): partitions follow each other, rows within them too.

    The captures of a frequent host or URL spread over ranges, as time and page_id are part of the key. A task holds
    the index rows (no payloads) of its range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for x in batches:
            for r in zip(*[c.to_pylist() for c in x.columns], strict=True):
                runs.setdefault(r[7], []).append(r)
        for r in runs.values():
            r.sort(key=order)  # a run may arrive in pieces; putting sorted pieces together is linear
        yield from _batches(merged([runs[k] for k in sorted(runs)]), NAMES, ARROW)

    n = partitions or shuffle_partitions(captures.sparkSession)
    return captures.repartitionByRange(n, "urlkey", "captured", "page_id", "run", "at").mapInArrow(run, CAPTURE)
