"""WARC round trips, the merge against sorting, decisions against a plain version."""

import gzip
import hashlib
import random

from loomline.llm.common import shared_dir
from loomline.llm.queries import op9_warc
from loomline.llm.warc import capture_histories, merged, order, read_warc, records, url_key, write_warc

LONG = "é" * 600
ROWS = [
    (1, "http://www.A.example:80/x?b=1&a=2#top", LONG, "x"), (2, "https://a.example/x?a=2&b=1", LONG, "x"), (3, None, LONG, "x"), (3, None, LONG, "x"),
    (4, "http://b.example", "WARC/1.1\r\n\r\nContent-Length: 7\r\n\r\n\r\n\r\n", "x"), (5, "bad url\r\n", None, None), (6, "", "", "x"), (7, "http://[bad", "short", "x"), (8, "http://c.example/", "short", "x"),
    (None, "http://c.example/", LONG, "x"), (9, "http://c.example/", "z" * 1_000_000, "x"), (None, "u", "y" * 1000, "x"), (None, "u", "y" * 1000, "x"), (10, "u", "q" * 999, "x"), (11, "u", "q" * 999, "x"),
]
SCHEMA = "page_id long, url string, html string, digest string"


def want(rows):
    out = []
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        same = [j for j, _, h, *_ in rows if (h or "").encode() == b and j is not None]
        refers = max(same) if len(b) >= 1000 and same and i != max(same) else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_round_trip(spark):
    path = shared_dir(spark)
    write_warc(spark.createDataFrame(ROWS, SCHEMA), path, records_per_file=4)
    got = read_warc(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(ROWS)
    ordered = [tuple(r) for r in capture_histories(read_warc(spark, path), 3).collect()]
    assert ordered == sorted(map(tuple, got), key=order) and len({r[7] for r in ordered}) > 1


def test_offsets_point_at_records(spark, tmp_path):
    write_warc(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("part-*.gz")
    raw = gzip.decompress(file.read_bytes())
    assert raw.endswith(b"\r\n\r\n")
    with gzip.open(file) as f:
        assert all(raw[at:].startswith(b"WARC/1.1\r\nWARC-Type: ") for at, _, _ in records(f))


def test_empty(spark):
    path = shared_dir(spark)
    write_warc(spark.createDataFrame([], SCHEMA), path)
    assert capture_histories(read_warc(spark, path)).collect() == []


def test_merge_equals_sorting():
    rng = random.Random(2)
    for n in [*range(9), 33]:
        runs = [sorted(rng.choices(range(50), k=rng.randrange(12))) for _ in range(n)]
        assert list(merged(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert url_key(ROWS[0][1]) == url_key(ROWS[1][1]) == "example,a)/x?a=2&b=1"


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, op9_warc(spark, sf).collect()), key=str) == want(rows)
