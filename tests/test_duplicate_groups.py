"""Greedy groups over all points against brute force."""

import numpy as np
import pytest

from tidewell.operators import graph as G
from tidewell.operators import search as S
from tidewell.plans import graphs
from tidewell.plans import search as plans
from tidewell.session import table


def brute(rows, k, least, same):
    """(seed, member) by the reference's loop."""
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scores, taken, out = x @ x.T, set(), set()
    for i in sorted(range(len(rows)), key=lambda i: ids[i]):
        if ids[i] in taken:
            continue
        taken.add(ids[i])
        open_ = [j for j in range(len(rows)) if j != i and scores[i, j] >= least and (not same or rows[i][2] is None or rows[j][2] == rows[i][2])]
        for j in sorted(open_, key=lambda j: (-scores[i, j], ids[j]))[:k]:
            if ids[j] not in taken:
                taken.add(ids[j])
                out.add((ids[i], ids[j]))
    return out


@pytest.mark.parametrize("same", [None, "label"])
def test_groups_in_blocks_match_brute_force(spark, same):
    rng = np.random.default_rng(3)
    hot = rng.normal(size=8)
    # a rare label amid a hot one, and rows without a label
    rows = [(i, (hot + rng.normal(size=8) * 0.6).tolist(), None if i % 41 == 0 else "rare" if i % 20 == 0 else "hot") for i in range(300)]
    points = spark.createDataFrame(rows, "id long, vector array<double>, label string").repartition(3)
    got = G.greedy_groups(S.nearest_of_all(points, 5, 0.8, same=same, block=70), points)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5, 0.8, same)


@pytest.mark.parametrize("query, k, same", [(graphs.g10_greedy_clusters, 10, True), (plans.c7_duplicate_groups, 5, False)])
def test_registered_groups_match_brute_force(spark, sf, query, k, same):
    rows = [tuple(r) for r in table(spark, sf, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert {tuple(r) for r in query(spark, sf).collect()} == brute(rows, k, 0.3, same)
