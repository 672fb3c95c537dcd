"""What several operators of this subpackage share: tables, shared storage, split columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MUL = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Only a local session that names none (as in local tests) gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomline-")
    return f"{base.rstrip('/')}/loomline-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read again: lineage ends there and nothing is computed twice."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a frame that written() made and that no later step reads."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(n: int, key: str = "doc_id") -> Column:
    """crc32(key as text) mod n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns whose names (case aside) clash with names."""
    taken = {x.lower() for x in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fit_in_one_task(sample: DataFrame, fit):
    """fit(rows) on an executor, over the rows of a bounded sample in sorted order; the (bounded) model comes back. None without rows.

    Sorting makes the model the same however the rows arrive.
    """
    import pickle

    import pyarrow as pa

    def run(batches):
        rows = [r for x in batches for r in zip(*[c.to_pylist() for c in x.columns], strict=True)]
        if rows:
            rows.sort(key=lambda r: tuple((v is None, v) for v in r))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(frugal(run), "model binary").collect()
    return pickle.loads(found[0][0]) if found else None


def drawn(share: float, salt: str, key: str = "doc_id") -> Column:
    """A repeatable choice of about that share of the rows, by a hash of the key."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


Batches = Iterator[pa.RecordBatch]


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run; a Python worker gives the memory it has freed back to the system at the end of its task, as it may stay and do nothing while others work.

    What a worker has loaded before its first task stays as long as the worker: it is frozen, else this collection and
    the worker's own go through all of it after every task, for longer than a small task itself takes.
    """

    def wrapped(batches: Batches) -> Batches:
        if not gc.get_freeze_count():
            gc.freeze()
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def parts(batches, rows: int = 4096, most: int = 1 << 24, column: int = 1):
    """Arrow batches in slices of so many rows, and about so many bytes of text (in that column), at most; none is empty."""
    for x in batches:
        ends, start = np.cumsum(pc.fill_null(pc.binary_length(x.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < x.num_rows:
            end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
            end = max(start + 1, min(start + rows, end))
            yield x.slice(start, end - start)
            start = end


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing of each value, another for each seed."""
    x = x ^ np.uint64((seed + 1) * int(MUL) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, lower-cased (A-Z) and split at blanks, of all texts, and where each text's begin (and the last's end)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, ends = pc.list_flatten(split), np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # blanks at the ends give empty words
    starts = np.concatenate(([0], np.cumsum(full)))[ends.astype(np.int64)]
    return xxh64(words)[full], starts


def xxh64(words: pa.Array) -> np.ndarray:
    """XXH64 (seed 0) of each string of a string array without nulls; those under 32 bytes by columns, all of one length at once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, at, data = words.buffers()
    at = np.frombuffer(at, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data, sizes, out = np.frombuffer(data or b"", np.uint8), np.diff(at), np.zeros(len(words), np.uint64)
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    by = np.argsort(np.minimum(sizes, 32).astype(np.uint8), kind="stable")
    for size, rows in enumerate(np.split(by, np.searchsorted(sizes[by], np.arange(1, 33)))):
        if not len(rows):
            continue
        if size == 32:
            out[rows] = [xxhash.xxh64_intdigest(data[at[k] : at[k + 1]].tobytes()) for k in rows.tolist()]
            continue
        read, h, k = data[at[rows][:, None] + np.arange(size)], np.full(len(rows), p5 + np.uint64(size)), 0
        while k + 8 <= size:
            h ^= turned(np.ascontiguousarray(read[:, k : k + 8]).view("<u8")[:, 0] * p2, 31) * p1
            h = turned(h, 27) * p1 + p4
            k += 8
        if k + 4 <= size:
            h ^= np.ascontiguousarray(read[:, k : k + 4]).view("<u4")[:, 0].astype(np.uint64) * p1
            h = turned(h, 23) * p2 + p3
            k += 4
        for j in range(k, size):
            h ^= read[:, j].astype(np.uint64) * p5
            h = turned(h, 11) * p1
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        out[rows] = h ^ (h >> np.uint64(32))
    return out


def shingles_of(words: np.ndarray, starts: np.ndarray, width: int = 5) -> np.ndarray:
    """For each word the hash of the run of `width` words from it on; 0 where its text ends before."""
    out = np.zeros(len(words), np.uint64)
    n = len(words) - width + 1
    if n < 1:
        return out
    for k in range(width):
        out[:n] = out[:n] * MUL + words[k : k + n]
    out = mixed(out, 0) | np.uint64(1)
    sizes = np.diff(starts)
    for k in range(1, width):
        out[(starts[1:] - k)[sizes >= k]] = 0
    return out
