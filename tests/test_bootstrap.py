"""Bootstrap intervals against plain resampling."""

import numpy as np
import pytest

from loomline.operators import aggregates as A


def test_exact_counts_are_poisson(spark):
    cells = spark.createDataFrame([(k, n) for k, n in enumerate((1, 2, 7, 30, 31, 500))], "cell long, n long")
    got = A.bootstrap_draws(cells, 4000, "t").groupBy("cell").agg({"w": "avg", "*": "count"}).collect()
    assert {r.cell: r["count(1)"] for r in got} == dict.fromkeys(range(6), 4000)
    w = {k: np.array([r.w for r in A.bootstrap_draws(cells, 4000, "t").where(f"cell = {k}").collect()]) for k in range(6)}
    for k, n in enumerate((1, 2, 7, 30, 31, 500)):
        assert abs(w[k].mean() - n) < 5 * (n / 4000) ** 0.5 and abs(w[k].var() / n - 1) < 0.12 and w[k].min() >= 0


def test_weighted_middles(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(c), int(w)) for g in range(20) for c, w in zip(rng.permutation(50)[: rng.integers(1, 12)], rng.integers(0, 4, 12), strict=False)]
    rows += [(g, 60, 1) for g in range(20)]
    got = {r.g: (r.twice / 2, r.total) for r in A.weighted_middles(spark.createDataFrame(rows, "g int, cell long, w long"), ["g"], "cell", "w").collect()}
    for g in range(20):
        values = np.repeat([c for h, c, _ in rows if h == g], [w for h, _, w in rows if h == g])
        assert got[g] == (np.median(values), len(values))


@pytest.mark.parametrize("scale", [1.0, 0.01])
def test_intervals_are_like_plain_resampling(spark, scale):
    rng = np.random.default_rng(2)
    d = np.round(rng.gamma(2.0, 3.0, 700) - 4, 1) * scale
    df = spark.createDataFrame([(float(x),) for x in d] + [(None,), (float("nan"),)], "d double")
    r = A.bootstrap_intervals(df, "d", 1000, 1000, step=0.1 * scale).first()
    assert (r.n, r.better, r.worse) == (700, (d < 0).sum(), (d > 0).sum())
    assert r["mean"] == pytest.approx(d.mean()) and r["median"] == pytest.approx(np.median(d))
    for name, f in (("mean", np.mean), ("median", np.median)):
        plain = [f(d[rng.integers(0, 700, 700)]) for _ in range(2000)]
        for side, q in (("low", 2.5), ("high", 97.5)):
            assert abs(r[f"{name}_{side}"] - np.percentile(plain, q)) < 0.2 * np.std(plain) + 0.1 * scale


def test_no_rows(spark):
    r = A.bootstrap_intervals(spark.createDataFrame([], "d double"), "d", 10, 10).first()
    assert (r.n, r.better, r["mean"], r.median_low) == (0, 0, None, None)
