"""Packed token files as a Spark data source: token documents in `.bin`, their sizes and places in `.idx`, by shard.

    register(spark)
    docs.write.format("packed_tokens").mode("overwrite").save(path)      # docs(shard int, ord long, tokens array<int>)
    spark.read.format("packed_tokens").load(path)                        # shard, ord, at, size, tokens

Each task appends its documents to files of its own names, so a shard must be whole in one partition and in order
(write_packed_files sees to that). When all tasks are done the driver renames them and writes the manifest, with sizes
and digests, last: readers go by the manifest alone, so a failed write shows nothing, nor does half of one. Paths are
whatever pyarrow.fs opens (file, hdfs, s3, gs), since Python tasks have no other way to a store.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.sequences import CODE_BASE, EOD

# The index file's head: magic, version 1, kind 4 (32-bit numbers), documents, documents + 1.
MAGIC, VERSION, INT32 = b"MMIDIDX\x00\x00", 1, 4
HEAD = struct.Struct("<9sQBQQ")
MANIFEST = "_packed.json"
SCHEMA = "shard int, ord long, at long, size int, tokens array<int>"


def opened(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return pfs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pfs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What a task has put in its own files: (shard, file, documents, tokens, digest) each."""

    shards: list


class PackedWriter(DataSourceArrowWriter):
    """Tasks write `.part` files; commit names them and writes the manifest last."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root)
        done: list = []
        shard = out = sizes = digest = name = None
        tag = uuid.uuid4().hex[:8]  # of this attempt: a second one must not meet the first one's files

        def close() -> None:
            out.close()
            places = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<i4"), dtype=np.int64)))
            index = HEAD.pack(MAGIC, VERSION, INT32, len(sizes), len(sizes) + 1) + sizes.tobytes() + (places[:-1] * 4).astype("<i8").tobytes() + np.arange(len(sizes) + 1, dtype="<i8").tobytes()
            with fs.open_output_stream(f"{root}/{name}.idx.part") as f:
                f.write(index)
            done.append((shard, name, len(sizes), int(places[-1]), digest.hexdigest()))

        for x in iterator:
            if x.num_rows == 0:
                continue
            number = x.column(x.schema.get_field_index("shard")).to_numpy(zero_copy_only=False)
            tokens = x.column(x.schema.get_field_index("tokens"))
            if tokens.null_count:
                raise ValueError("a document has no tokens")
            ends, values = tokens.offsets.to_numpy(), tokens.values.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), x.num_rows], strict=True):
                if number[a] != shard:
                    if out:
                        close()
                    shard = int(number[a])
                    if shard in [d[0] for d in done]:
                        raise ValueError(f"shard {shard} is not in one piece")
                    name, sizes, digest = f"shard-{shard:05d}-{self.run}-{tag}", array("i"), hashlib.sha256()
                    out = fs.open_output_stream(f"{root}/{name}.bin.part")
                part = np.ascontiguousarray(values[ends[a] : ends[b]], "<i4").tobytes()
                out.write(part)
                digest.update(part)
                sizes.frombytes(np.diff(ends[a : b + 1]).astype("<i4").tobytes())
        if out:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        shards = sorted(s for m in messages if m for s in m.shards)
        if len({s[0] for s in shards}) < len(shards):
            self.abort(messages)
            raise ValueError("a shard was written by two tasks; deal rows out by shard first")
        before = manifest(self.path)
        if before and not self.overwrite:
            kept = [s for s in before["shards"] if s["shard"] not in {x[0] for x in shards}]
            if len(kept) < len(before["shards"]):
                self.abort(messages)
                raise ValueError("a shard is there already")
        else:
            kept = []
        new = [dict(zip(("shard", "file", "documents", "tokens", "sha256"), s, strict=True)) for s in shards]
        for s in new:
            for end in ("bin", "idx"):
                fs.move(f"{root}/{s['file']}.{end}.part", f"{root}/{s['file']}.{end}")
        put(fs, f"{root}/{MANIFEST}", {"dtype": "int32", "shards": sorted(kept + new, key=lambda s: s["shard"])})
        self.abort([])  # what attempts that did not end well have left
        if before and self.overwrite:  # readers of the old manifest have had their plan; its files go last
            for s in before["shards"]:
                for end in ("bin", "idx"):
                    fs.delete_file(f"{root}/{s['file']}.{end}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for f in fs.get_file_info(pfs.FileSelector(root, allow_not_found=True)):
            if self.run in f.base_name and f.base_name.endswith(".part"):
                fs.delete_file(f.path)


def put(fs: pfs.FileSystem, path: str, value: dict) -> None:
    """A JSON file in canonical form, whole or not at all: written beside and renamed."""
    beside = f"{path}.{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(beside) as f:
        f.write(json.dumps(value, sort_keys=True, separators=(",", ":")).encode())
    fs.move(beside, path)


def manifest(path: str) -> dict | None:
    fs, root = opened(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pfs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Piece(InputPartition):
    """Documents low to high - 1 of a shard."""

    shard: int
    file: str
    documents: int
    low: int
    high: int


class PackedReader(DataSourceReader):
    """Pieces of shards by document number; shard and ord filters leave shards and documents out before anything is read."""

    def __init__(self, path: str, documents: int, ends_only: bool) -> None:
        self.path, self.most, self.ends_only = path, documents, ends_only
        self.ranges = {"shard": [-(1 << 62), 1 << 62], "ord": [-(1 << 62), 1 << 62]}

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            kinds = {EqualTo: (0, 0), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, -1), LessThanOrEqual: (None, 0)}
            if name not in self.ranges or type(f) not in kinds or not isinstance(f.value, int):
                yield f
                continue
            low, high = kinds[type(f)]
            span = self.ranges[name]
            if low is not None:
                span[0] = max(span[0], f.value + low)
            if high is not None:
                span[1] = min(span[1], f.value + high)

    def partitions(self) -> list[Piece]:
        found = manifest(self.path)
        if found is None:
            raise FileNotFoundError(f"{self.path} holds no complete packed token files")
        out = []
        for s in found["shards"]:
            if self.ranges["shard"][0] <= s["shard"] <= self.ranges["shard"][1]:
                n = s["documents"]
                if self.ends_only:
                    out += [Piece(s["shard"], s["file"], n, k, k + 1) for k in sorted({0, n // 2, n - 1}) if 0 <= k < n]
                    continue
                low, high = max(0, self.ranges["ord"][0]), min(n, self.ranges["ord"][1] + 1)
                out += [Piece(s["shard"], s["file"], n, k, min(k + self.most, high)) for k in range(low, high, self.most)]
        return out or [Piece(0, "", 0, 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.high <= piece.low:
            return
        fs, root = opened(self.path)
        n = piece.high - piece.low
        with fs.open_input_file(f"{root}/{piece.file}.idx") as f:
            magic, version, kind, documents, _ = HEAD.unpack(f.read_at(HEAD.size, 0))
            if (magic, version, kind, documents) != (MAGIC, VERSION, INT32, piece.documents):
                raise ValueError(f"{piece.file}.idx is not the manifest's")
            sizes = np.frombuffer(f.read_at(4 * n, HEAD.size + 4 * piece.low), "<i4")
            places = np.frombuffer(f.read_at(8 * n, HEAD.size + 4 * documents + 8 * piece.low), "<i8") // 4
        with fs.open_input_file(f"{root}/{piece.file}.bin") as f:
            start = 0
            while start < n:  # batches of about 4 million tokens
                end = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:], dtype=np.int64), 1 << 22, side="right")) + start)
                part, many = sizes[start:end], int(sizes[start:end].sum(dtype=np.int64))
                data = f.read_at(4 * many, 4 * int(places[start]))
                if len(data) != 4 * many:
                    raise ValueError(f"{piece.file}.bin is cut off")
                ends = np.concatenate(([0], np.cumsum(part))).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(data, "<i4")))
                ords = np.arange(piece.low + start, piece.low + end, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), piece.shard, np.int32)), pa.array(ords), pa.array(places[start:end]), pa.array(part), tokens], names=["shard", "ord", "at", "size", "tokens"])
                start = end


class PackedTokens(DataSource):
    """Options of the reader: documents (most of a task, 4096), sample=ends (first, middle and last document of each shard)."""

    @classmethod
    def name(cls) -> str:
        return "packed_tokens"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PackedReader:
        return PackedReader(self.options["path"], int(self.options.get("documents", 4096)), self.options.get("sample") == "ends")

    def writer(self, schema: StructType, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedTokens)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_packed_files(docs: DataFrame, tokens: str, shard: str, order: list[str], path: str, mode: str = "append") -> None:
    """docs to packed files: a shard is one task's, its documents in order. Null shards and tokens fail the write."""
    register(docs.sparkSession)
    x = docs.select(F.col(shard).cast("int").alias("shard"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], F.col(tokens).cast("array<int>").alias("tokens"))
    known = F.when(x["shard"].isNull(), F.raise_error(F.lit("a document has no shard"))).otherwise(x["shard"])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_in = x.withColumn("shard", known.cast("int")).repartition(n, "shard").sortWithinPartitions("shard", *[f"__o{k}" for k in range(len(order))])
    sorted_in.select("shard", "tokens").write.format("packed_tokens").mode(mode).save(path)


def read_packed_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("packed_tokens").options(**options).load(path)


def checked_ends(spark: SparkSession, path: str) -> DataFrame:
    """(shard, ord, len, n_text, ctrl, first_codes, tail) of the first, middle and last document of each shard: where its text ends, the three ids there, the first five codes behind, the last two ids. Nothing else is read."""
    d = read_packed_files(spark, path, sample="ends")
    end = F.array_position("tokens", EOD).cast("int") - 1
    codes: Column = F.transform(F.slice("tokens", end + 4, 5), lambda v: v - CODE_BASE)
    return d.select("shard", "ord", F.col("size").alias("len"), end.alias("n_text"), F.slice("tokens", end + 1, 3).alias("ctrl"), codes.alias("first_codes"), F.slice("tokens", F.col("size") - 1, 2).alias("tail"))


def verify_files(spark: SparkSession, path: str) -> DataFrame:
    """(shard, documents, tokens, ok): each shard's bytes against the manifest's digest, streamed by a task each."""
    shards = [(s["shard"], s["file"], s["documents"], s["tokens"], s["sha256"]) for s in (manifest(path) or {"shards": []})["shards"]]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(path)
        for x in batches:
            good = []
            for file, tokens, sha in zip(*[x.column(c).to_pylist() for c in ("file", "tokens", "sha256")], strict=True):
                digest, total = hashlib.sha256(), 0
                with fs.open_input_stream(posixpath.join(root, f"{file}.bin")) as f:
                    while part := f.read(1 << 22):
                        digest.update(part)
                        total += len(part)
                good.append(digest.hexdigest() == sha and total == 4 * tokens)
            yield pa.RecordBatch.from_arrays([*[x.column(c) for c in ("shard", "documents", "tokens")], pa.array(good, pa.bool_())], names=["shard", "documents", "tokens", "ok"])

    df = spark.createDataFrame(shards, "shard int, file string, documents long, tokens long, sha256 string")
    return df.repartition(max(1, len(shards)), "shard").mapInArrow(check, "shard int, documents long, tokens long, ok boolean")
