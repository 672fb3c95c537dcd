"""Components of an edge table: against a plain search, and what a round costs."""

import random

from loomline.llm.graph import Forest, connected_components


def want(edges):
    forest, nodes = Forest(), {x for e in edges for x in e if None not in e and e[0] != e[1]}
    for a, b in edges:
        if None not in (a, b):
            forest.join(a, b)
    return sorted((x, forest.find(x)) for x in nodes)


def test_components(spark):
    rng = random.Random(5)
    chain = list(range(1000, 1200))
    rng.shuffle(chain)
    edges = [*zip(chain, chain[1:], strict=False), *((-7, k) for k in range(300)), *((k, 5) for k in range(290, 330)), *((rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(230))]
    edges += [*edges[::3], (None, 4), (9, None), (8, 8), (-(1 << 62), 1 << 62)]
    df = spark.createDataFrame(edges, "a long, b long")
    for contracted in (False, True):
        got = sorted((r.node, r.root) for r in connected_components(df.repartition(7), contracted=contracted).collect())
        assert got == want(edges)
    assert connected_components(df.limit(0)).collect() == []


def test_a_round_deals_its_edges_out_twice(spark):
    """The driver keeps something of every job, stage and broadcast: a round is two shuffles, a write and a count."""
    sc, edges = spark.sparkContext, [(k, k + 1) for k in range(64)]
    sc.setJobGroup("round", "")
    try:
        connected_components(spark.createDataFrame(edges, "a long, b long"), contracted=True)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    rounds = 8
    assert len(sc.statusTracker().getJobIdsForGroup("round")) <= 5 * (rounds + 2)
