"""Readers: JSON lines, shards, tar pairs, timed and untimed lyrics, token archives. Lists of files stay with Spark's readers."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# The tags of timed lyrics.
TIME_TAG = r"\[(\d+):(\d+(?:[.:]\d+)?)\]"
OFFSET = r"(?im)^\s*\[offset:\s*([+-]?\d+)\s*\]"
WORD_LINE = r"^\[(\d+),(\d+)\](.*)$"
WORD_TIME = r"\((\d+),(\d+),\d+\)([^(]*)"
WORD_CREDIT = r"(?iU)^\s*(作曲|作词|编曲|制作人|和声|混音|母带|录音|吉他|贝斯|鼓|键盘|弦乐|监制|出品|发行|词|曲|Lyrics|Composer|Producer|Arranged|Arranger|Written|Mixed|Mastered|OP|SP)\b.*[:：]"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with file_name; lines that don't end in } (a writer at work) are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\}\s*$"))
    return lines.select(F.from_json("value", schema).alias("r"), F.col("_metadata.file_name").alias("file_name")).select("r.*", "file_name")


def with_shard(df: DataFrame, pattern: str = r"(\d+)") -> DataFrame:
    return df.withColumn("shard", F.regexp_extract("file_name", pattern, 1).cast("int"))


def shard_spec(text: str) -> list[int] | None:
    """1-18,43-60 as numbers; all is None: no filter."""
    if text.strip() == "all":
        return None
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        a, _, b = part.partition("-")
        out += range(int(a), int(b or a) + 1)
    return out


def in_shards(df: DataFrame, text: str, col: str = "shard") -> DataFrame:
    chosen = shard_spec(text)
    return df if chosen is None else df.where(F.col(col).isin(chosen))


def read_tar_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(archive, stem, ext, content) of each member; pair them by pair_members()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for name, content in zip(x["path"], x["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile():
                            stem, _, ext = m.name.rpartition("/")[2].rpartition(".")
                            yield pd.DataFrame({"archive": [name], "stem": [stem], "ext": [ext.lower()], "content": [tar.extractfile(m).read()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, stem string, ext string, content binary")


def pair_members(members: DataFrame, audio: list[str], info: str = "json") -> DataFrame:
    """(archive, stem, audio, info, paired)."""
    a = F.max(F.when(F.col("ext").isin(audio), F.col("content"))).alias("audio")
    b = F.max(F.when(F.col("ext") == info, F.col("content"))).alias("info")
    return members.groupBy("archive", "stem").agg(a, b).withColumn("paired", F.col("audio").isNotNull() & F.col("info").isNotNull())


def entities(files: DataFrame, audio: str = r"(?i)\.(flac|mp3|m4a|ogg|opus|wav)$", least: int = 100_000) -> DataFrame:
    """From (dir, name, size): a row per directory with its largest audio file over least bytes, its lyric file (names
    without a numeric suffix first), and whether it is complete (has an info file)."""
    sound = F.col("name").rlike(audio) & (F.col("size") > least)
    lyric = F.col("name").rlike(r"(?i)\.lrc$")
    return files.groupBy("dir").agg(
        F.max_by("name", F.when(sound, F.struct("size", "name"))).alias("audio"), F.min_by("name", F.when(lyric, F.struct(F.col("name").rlike(r"[_\-( ]\d+\)?\.lrc$").alias("n"), "name"))).alias("lyric"),
        F.bool_or(F.col("name").rlike(r"(?i)\.json$")).alias("complete"),
    )


def timed_lines(text: Column) -> Column:
    """Array of (t0, text): a line with several time tags once for each; [offset:ms] shows lines earlier, not before 0."""
    off = F.coalesce(F.when(F.regexp_extract(text, OFFSET, 1) != "", F.regexp_extract(text, OFFSET, 1).cast("double") / 1000), F.lit(0.0))

    def of(raw: Column) -> Column:
        tags = F.regexp_extract_all(raw, F.lit(TIME_TAG), F.lit(0))
        body = strip(F.regexp_replace(raw, rf"^.*{TIME_TAG}", ""))
        seconds = lambda t: F.regexp_extract(t, TIME_TAG, 1).cast("double") * 60 + F.replace(F.regexp_extract(t, TIME_TAG, 2), F.lit(":"), F.lit(".")).cast("double")
        return F.transform(tags, lambda t: F.struct(F.greatest(F.lit(0.0), seconds(t) - off).alias("t0"), body.alias("text")))

    return F.flatten(F.transform(F.split(text, r"\r\n|\n|\r"), of))


def untimed_lines(text: Column) -> Column:
    """Lines without JSON, links, leading tags and blanks."""
    kept = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda s: strip(s)), lambda s: (s != "") & ~s.startswith("{") & ~s.rlike("^https?://"))
    return F.filter(F.transform(kept, lambda s: strip(F.regexp_replace(s, r"^\s*\[[^\]]*\]\s*", ""))), lambda s: s != "")


def word_timed_lines(text: Column) -> Column:
    """Array of (t0, t1, text, uniform): lines timed by word, in seconds; credits are out. uniform: three words or more, all as long."""

    def of(raw: Column) -> Column:
        raw = strip(raw)
        body = F.regexp_extract(raw, WORD_LINE, 3)
        part = lambda g: F.regexp_extract_all(body, F.lit(WORD_TIME), F.lit(g))
        words = F.arrays_zip(part(2).alias("d"), part(3).alias("w"))
        lengths = F.transform(F.filter(words, lambda w: strip(w["w"]) != ""), lambda w: w["d"])
        a, b = F.regexp_extract(raw, WORD_LINE, 1).cast("double") / 1000, F.regexp_extract(raw, WORD_LINE, 2).cast("double") / 1000
        return F.struct(a.alias("t0"), (a + b).alias("t1"), strip(F.array_join(part(3), "")).alias("text"), ((F.size(lengths) >= 3) & (F.size(F.array_distinct(lengths)) == 1)).alias("uniform"))

    rows = F.transform(F.filter(F.split(text, r"\r\n|\n|\r"), lambda s: strip(s).rlike(WORD_LINE)), of)
    return F.filter(rows, lambda r: (r["text"] != "") & ~r["text"].rlike(WORD_CREDIT))


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, values array<int>) of each array in NPZ archives, flattened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for name, content in zip(x["path"], x["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    yield pd.DataFrame({"file": name, "id": list(z.keys()), "values": [z[k].astype(np.int32).ravel() for k in z.keys()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, id string, values array<int>")


def read_flat_int32(spark: SparkSession, path: str) -> DataFrame:
    """(file, tokens array<int>) of little-endian int32 files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"file": x["path"], "tokens": [np.frombuffer(c, "<i4") for c in x["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, tokens array<int>")


def has_without(files: DataFrame, has: str, lacks: str) -> DataFrame:
    """Directories of (dir, name) that hold one artefact and not another."""
    return files.where(F.col("name") == has).select("dir").join(files.where(F.col("name") == lacks).select("dir"), "dir", "left_anti")


def songs_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The songs of multi-line JSON files with an array `songs`, flattened, by k."""
    return spark.read.schema(f"songs array<{schema}>").option("multiLine", True).json(path).select(F.inline("songs")).orderBy("k")


def user_lyrics(text: Column) -> Column:
    """Array of (t0, text) of a lyric file by hand: [m:s.ss] lines with their time, other lines that don't open a bracket without; empty ones go."""
    tag = r"^\s*\[(\d+):(\d+(?:\.\d+)?)\]\s*(.*)$"

    def of(raw: Column) -> Column:
        timed = raw.rlike(tag)
        t0 = F.when(timed, F.regexp_extract(raw, tag, 1).cast("double") * 60 + F.regexp_extract(raw, tag, 2).cast("double"))
        body = F.when(timed, strip(F.regexp_extract(raw, tag, 3))).when(~strip(raw).startswith("["), strip(raw)).otherwise("")
        return F.struct(t0.alias("t0"), body.alias("text"))

    return F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), of), lambda s: s["text"] != "")
