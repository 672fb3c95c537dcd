"""Crops and ragged arrays by plain loops."""

import random

import numpy as np

from loomline.operators import crops as C
from loomline.operators import ragged as G


def plain_crop(ids, st, tab, c0, n):
    whole = [t for t in tab if t[0] >= c0 and t[1] <= c0 + n]
    mask = np.ones(n, bool)
    for t in tab:
        if t[1] > c0 and t[0] < c0 + n and t not in whole:
            mask[max(0, t[0] - c0) : max(0, min(n, t[1] - c0))] = False
    letters, starts = [], []
    for t in whole:
        if letters:
            letters.append(1)
            starts.append(None)
        letters += ids[t[2] : t[3]]
        starts += [None if s is None else s - c0 for s in st[t[2] : t[3]]]
    after, out, high = None, [], 0.0
    for s in reversed(starts):
        after = s if s is not None else after
        out.append(0.0 if after is None else after)
    for k, s in enumerate(reversed(out)):
        high = max(high, min(max(s, 0.0), n - 1e-3))
        starts[k] = high
    return letters, starts, mask.tolist()


def test_crops_by_loops(spark):
    rng = random.Random(1)
    songs, tables, crops, want = [], [], [], {}
    for song in range(6):
        at, ids, st, tab = 0, [], [], []
        for line in range(30):
            at += rng.randint(0, 30)
            size, last = rng.randint(1, 5), at + rng.randint(0, 25)
            ids += [1] if ids else []
            st += [None] if st else []
            tab.append((at, last, len(ids), len(ids) + size))
            ids += [rng.randint(2, 27) for _ in range(size)]
            st += [None if rng.random() < 0.3 else float(rng.randint(at - 3, at + 20)) for _ in range(size)]
            tables.append((song, line, *tab[-1]))
        songs.append((song, ids, st))
        for crop in range(8):
            c0, n = rng.randint(0, at), rng.choice([1, 40, 100])
            crops.append((song, crop, c0, n))
            want[song, crop] = plain_crop(ids, st, tab, c0, n)
    c = spark.createDataFrame(crops, "song long, crop long, c0 long, n long")
    t = spark.createDataFrame(tables, "song long, line long, f0 long, f1 long, i0 int, i1 int")
    s = spark.createDataFrame(songs, "song long, ids array<int>, starts array<double>")
    for width in (7.0, 100.0):
        letters = {}
        for r in C.crop_letters(c, t, s, "song", width).orderBy("song", "crop", "pos").collect():
            letters.setdefault((r.song, r.crop), []).append((r.letter, r["at"]))
        assert letters == {k: list(zip(v[0], v[1], strict=True)) for k, v in want.items() if v[0]}
        masks = C.crop_masks(c, t, "song", width)
        kept = {}
        for r in C.kept_runs(c, masks, "song").collect():
            kept.setdefault((r.song, r.crop), set()).update(range(r.a, r.b))
        assert {k: v for k, v in kept.items() if v} == {k: {i for i, m in enumerate(v[2]) if m} for k, v in want.items() if any(v[2])}
        for a in masks.collect():
            assert not any(b.a == a.b for b in masks.where(f"song = {a.song} and crop = {a.crop}").collect()) if a.song == 0 else True


def test_lines_up_to_the_first_overrun(spark):
    crops = spark.createDataFrame([(1, 0, 10.0, 10.0)], "song long, crop long, c0 double, n double")
    lines = spark.createDataFrame([(1, 0, 5.0, 12.0), (1, 1, 11.0, 13.0), (1, 2, 12.0, 20.2), (1, 3, 13.0, 21.0), (1, 4, 14.0, 15.0), (1, 5, 20.5, 20.6)], "song long, line long, f0 double, f1 double")
    assert sorted(r.line for r in C.until_first_overrun(C.starting_in(crops, lines, "song", 4.0), "song").collect()) == [1, 2]


def test_ragged_round_trip_and_slices(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k % 3, k // 3, [rng.randint(0, 9) for _ in range(rng.choice([0, 1, 7, 40]))], [rng.random() for _ in range(k % 5)] if k % 4 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "shard int, j int, ids array<int>, times array<double>")
    for chunk in (1, 8, 1000):
        chunks, where = G.chunked(df, "ids", chunk=chunk)
        assert max(len(r["values"]) for r in chunks.collect()) <= chunk
        assert {(r.shard, r.j): r["values"] for r in G.sliced(chunks, where, chunk=chunk).collect()} == {r[:2]: r[2] for r in rows}
    G.write_ragged(df, ["ids", "times"], str(tmp_path / "r"), chunk=8)
    for r in rows[:12]:
        assert G.read_slice(spark, str(tmp_path / "r"), "ids", r[0], r[1], 8).first()["values"] == r[2]
        assert G.read_slice(spark, str(tmp_path / "r"), "times", r[0], r[1], 8).first()["values"] == (r[3] or [])
    assert G.read_slice(spark, str(tmp_path / "r"), "ids", 9, 9, 8).count() == 0
    plan = G.read_slice(spark, str(tmp_path / "r"), "ids", 1, 3, 8)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(chunk" in plan and "EqualTo(shard,1)" in plan


def test_line_table_by_loops(spark):
    rng = random.Random(3)
    lines, want = [], {}
    for song in range(12):
        kept = []
        for k in range(14):
            f0 = rng.randint(-3, 300)
            f1 = f0 + rng.randint(-2, 120)
            ids = [rng.choice([1, 1, 2, 3, 4]) for _ in range(rng.randint(0, 6))]
            lines.append((song, k, f0, f1, ids))
            if ids and 0 <= f0 <= f1:
                kept.append((f0, k, ids, min(f1, f0 + int(25 * (2.0 + 0.2 * len(ids)))), f1))
        table, pos = [], 0
        for f0, k, ids, f1c, f1 in sorted(x for x in kept if x[3] <= 280):
            words = [w for w in "".join(" " if i == 1 else "x" for i in ids).split(" ") if w]
            n = sum(map(len, words)) + max(len(words) - 1, 0)
            pos += 1 if pos else 0
            table.append((song, k, f0, f1, f1c, pos, pos + n))
            pos += n
        want[song] = table
    df = spark.createDataFrame(lines, "song long, k long, f0 long, f1 long, ids array<int>")
    from pyspark.sql import functions as F

    got = G.line_table(df, "song", "k", F.lit(280)).orderBy("song", "f0", "k").collect()
    assert [tuple(r) for r in got] == [t for s in range(12) for t in want[s]]
