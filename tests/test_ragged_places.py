"""Slices of ragged streams with their places."""

from loomline.operators import ragged as G


def test_slices_come_back_with_their_places(spark):
    rows = [(k % 2, k // 2, [k] * (k % 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "shard int, j int, v array<int>")
    chunks, where = G.chunked(df, "v", chunk=7)
    got = {(r.shard, r.j): (r.low, r.high, r["values"]) for r in G.sliced(chunks, where, chunk=7, places=True).collect()}
    at = [0, 0]
    for s, j, v in rows:
        assert got[s, j] == (at[s], at[s] + len(v), v)
        at[s] += len(v)
