"""Publishing on success: a version of its own folder, a manifest with digests, and one pointer that is swapped last.

    path/versions/<version>/<name>/...     what a pass has written
    path/versions/<version>/manifest.json  files with sizes and sha256, and the identity of the whole
    path/current.json                      the version that readers see

Nothing that readers see changes until the pointer is renamed over the old one, which is a single step on the file
systems that Spark writes to. What a pass that ended early has left is a folder without a pointer to it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, MANIFEST = "current.json", "manifest.json"


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks; NaN and infinities are refused."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def identity(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


class Store:
    """The few driver-side steps on small files that publishing needs, on any Hadoop path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        at = self.path("")
        conf = spark._jsc.hadoopConfiguration()
        self.fs = at.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(at).toUri(), conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def replace(self, name: str, value: object) -> None:
        """A JSON file, whole or not at all: written beside and renamed over what is there."""
        beside = f"{name}.{uuid.uuid4().hex[:8]}.tmp"
        out = self.fs.create(self.path(beside), True)
        out.write(bytearray(canonical(value).encode()))
        out.close()
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.valueOf("OVERWRITE")
        self.context.rename(self.path(beside), self.path(name), options)

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, sha256) of all data files below a folder, computed where Spark reads them; a file is a part that a task has written."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def publish(frames: dict[str, DataFrame], path: str, keep: int = 2, checks: dict[str, Callable[[DataFrame], bool]] | None = None, after: Callable[[str], None] = lambda step: None) -> str:
    """Write frames as a new version of path and show it to readers if all goes well; its version.

    checks: by name, what must hold of a frame as written, else nothing is shown. after(step) is called behind each step.
    The last `keep` versions stay, so that readers of the one before can end; files of passes that failed go with older ones.
    """
    spark = next(iter(frames.values())).sparkSession
    store, version = Store(spark, path), uuid.uuid4().hex
    at = f"{store.root}/versions/{version}"
    for name, df in frames.items():
        df.write.parquet(f"{at}/{name}")
        after(f"written {name}")
    for name, good in (checks or {}).items():
        if not good(spark.read.parquet(f"{at}/{name}")):
            raise ValueError(f"{name} does not pass its check; {path} stays as it was")
    after("checked")
    files = {}
    for name, df in frames.items():
        parts = sorted(tuple(r) for r in digests(spark, f"{at}/{name}").collect())  # a row for each file
        files[name] = {"schema": df.schema.simpleString(), "files": [{"name": n, "size": s, "sha256": h} for n, s, h in parts]}
    store.replace(f"versions/{version}/{MANIFEST}", {"identity": identity(files), "frames": files})
    after("manifest")
    before = store.read(POINTER)
    store.replace(POINTER, {"version": version, "number": (before or {"number": 0})["number"] + 1, "older": ([before["version"], *before["older"]] if before else [])[: keep - 1]})
    after("pointer")
    shown = store.read(POINTER)
    for old in store.names("versions"):
        if old not in (shown["version"], *shown["older"]):
            store.delete(f"versions/{old}")
    after("cleaned")
    return version


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A frame of the version that is shown; all frames of one version belong together (see version_of)."""
    return frame_of(spark, path, version_of(spark, path), name)


def version_of(spark: SparkSession, path: str) -> str:
    found = Store(spark, path).read(POINTER)
    if not found:
        raise FileNotFoundError(f"nothing is published at {path}")
    return found["version"]


def frame_of(spark: SparkSession, path: str, version: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/versions/{version}/{name}")


def faults(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with the version shown: files that are missing, new or changed, or a manifest that isn't its identity's."""
    version = version_of(spark, path)
    said = Store(spark, path).read(f"versions/{version}/{MANIFEST}")
    out = [] if identity(said["frames"]) == said["identity"] else ["identity"]
    for name, frame in said["frames"].items():
        there = {r["name"]: (r["size"], r["sha256"]) for r in digests(spark, f"{path.rstrip('/')}/versions/{version}/{name}").collect()}
        want = {f["name"]: (f["size"], f["sha256"]) for f in frame["files"]}
        out += [f"{name}: {f}" for f in sorted(there.keys() | want.keys()) if there.get(f) != want.get(f)]
    return out


def refresh(stages: list[tuple[str, Callable[[], dict[str, DataFrame] | None]]], path: str, spark: SparkSession, passes: int | None = None, stop: str = "stop", wait: Callable[[], None] = lambda: None) -> list[str]:
    """Run passes until the stop file lies in path (looked for before each stage) or so many are done; what happened.

    A stage is a function without arguments; the last one's frames are published. A stage that fails ends its pass and
    leaves what is published untouched; the next pass begins anew.
    """
    store, log, done = Store(spark, path), [], 0
    while passes is None or done < passes:
        frames = None
        for name, run in stages:
            if store.exists(stop):
                return [*log, "stopped"]
            try:
                frames = run()
            except Exception as e:  # noqa: BLE001  whatever a stage raises ends the pass
                log.append(f"{name} failed: {str(e).splitlines()[0][:200]}")
                break
            log.append(name)
        else:
            if frames:
                publish(frames, path)
                log.append("published")
        done += 1
        wait()
    return log
