"""Publishing that ends between any two steps, refresh passes with a stop file, and the pool of ids."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from loomline.sources import publish as P
from loomline.streaming import pool as Q

STEPS = ["written a", "written b", "checked", "manifest", "pointer", "cleaned"]


def frames(spark, n):
    return {"a": spark.range(n).withColumn("v", F.lit(n)), "b": spark.range(2 * n).withColumn("v", F.lit(n))}


@pytest.mark.parametrize("end", STEPS)
def test_readers_see_one_whole_version(spark, tmp_path, end):
    path = str(tmp_path / "p")
    with pytest.raises(FileNotFoundError):
        P.current(spark, path, "a")
    P.publish(frames(spark, 3), path)

    class Killed(Exception):
        pass

    seen = []

    def after(step):
        seen.append(({r.v for n in "ab" for r in P.current(spark, path, n).collect()}, P.current(spark, path, "a").count(), P.current(spark, path, "b").count()))
        if step == end:
            raise Killed

    with pytest.raises(Killed):
        P.publish(frames(spark, 5), path, after=after)
    new = STEPS.index(end) >= STEPS.index("pointer")
    assert all(s in (({3}, 3, 6), ({5}, 5, 10)) for s in seen) and seen[-1][0] == ({5} if new else {3})
    assert P.faults(spark, path) == []
    P.publish(frames(spark, 7), path)  # a later pass is not held up by what is left, and removes it
    assert P.current(spark, path, "b").count() == 14 and len(os.listdir(f"{path}/versions")) <= 2


def test_checks_and_changed_files(spark, tmp_path):
    path = str(tmp_path / "p")
    P.publish(frames(spark, 3), path)
    with pytest.raises(ValueError, match="check"):
        P.publish(frames(spark, 4), path, checks={"a": lambda df: df.count() > 100})
    assert P.current(spark, path, "a").count() == 3
    at = f"{path}/versions/{P.version_of(spark, path)}/a"
    name = sorted(f for f in os.listdir(at) if f.startswith("part-"))[0]
    os.remove(f"{at}/.{name}.crc")  # else the file system itself refuses the file
    with open(f"{at}/{name}", "ab") as f:
        f.write(b"x")
    assert P.faults(spark, path) == [f"a: a/{name}"]


def test_canonical_identity():
    assert P.canonical({"b": 1, "a": [1.5, "é"]}) == '{"a":[1.5,"é"],"b":1}'
    assert P.identity({"x": 1, "y": 2}) == P.identity({"y": 2, "x": 1}) != P.identity({"x": 2, "y": 1})
    with pytest.raises(ValueError):
        P.canonical(float("nan"))


def test_refresh_publishes_on_success_and_stops(spark, tmp_path):
    path, turn = str(tmp_path / "p"), []
    os.makedirs(path)

    def scan():
        turn.append(1)
        if len(turn) == 2:
            raise RuntimeError("no scan")

    index = lambda: {"a": spark.range(len(turn))}
    assert P.refresh([("ingest", lambda: None), ("scan", scan), ("index", index)], path, spark, passes=2) == ["ingest", "scan", "index", "published", "ingest", "scan failed: no scan"]
    assert P.current(spark, path, "a").count() == 1

    def stop():
        open(f"{path}/stop", "w").close()

    assert P.refresh([("ingest", stop), ("scan", scan)], path, spark) == ["ingest", "stopped"]
    assert P.refresh([("ingest", stop)], path, spark) == ["stopped"]


def test_pool_gives_ids_out_once_and_again_after_a_failure(spark, tmp_path):
    put = lambda kind, name, rows: ((tmp_path / kind).mkdir(exist_ok=True), (tmp_path / kind / name).write_text("".join(json.dumps(r) + "\n" for r in rows)))
    at = lambda name: str(tmp_path / name)
    got = []
    use = lambda batch, n: got.append(sorted((r.id, r.attempt, r.payload) for r in batch.collect()))

    def turn():
        got.clear()
        Q.pool_pass(spark, at("offers"), at("failures"), at("out"), at("cp"), "payload <> 'bad'", attempts=2, retry_ms=1)
        Q.consume_pass(spark, at("out"), at("reader"), use)
        return sorted(sum(got, []))

    put("offers", "1.json", [{"id": "x", "payload": "px"}, {"id": "y", "payload": "py"}, {"id": "x", "payload": "again"}, {"id": "z", "payload": "bad"}])
    put("failures", "0.json", [{"id": "never offered"}])
    assert [r[:2] for r in turn()] == [("x", 1), ("y", 1)]
    put("offers", "2.json", [{"id": "y", "payload": "py"}, {"id": "w", "payload": "pw"}])
    put("failures", "1.json", [{"id": "x"}])
    second = turn()
    time.sleep(0.1)
    put("offers", "3.json", [{"id": "x", "payload": "px"}])
    third = turn()
    put("failures", "2.json", [{"id": "x"}])  # its attempts are used up
    turn_four = turn()
    put("offers", "5.json", [{"id": "w", "payload": "pw"}])
    rest = second + third + turn_four + turn()
    assert [r[:2] for r in sorted(rest)] == [("w", 1), ("x", 2)]
    state = spark.read.format("statestore").option("stateVarName", "id").load(at("cp"))
    assert state.count() == 3  # one small row an id, and none for failures of unknown ids
