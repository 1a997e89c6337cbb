import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugewright.functions import nearest as nearest_of
from gaugewright.functions.nearest import Tree, nearest


def brute(places, points):
    d = np.full(len(places), np.inf)
    for p in points:
        d = np.minimum(d, ((places - p) ** 2).sum(1))
    return d


def frames(spark, places, points):
    """Lists by layer to DataFrames."""
    n = places[0].shape[1]
    rows = [(k, i, *map(float, r)) for k, some in enumerate(places) for i, r in enumerate(some)]
    seen = [(k, *map(float, r)) for k, some in enumerate(points) for r in some]
    g = spark.createDataFrame(pd.DataFrame(rows, columns=["layer", "place", *[f"g{i}" for i in range(n)]]))
    schema = "layer long, " + ", ".join(f"n{i} double" for i in range(n))
    return g, spark.createDataFrame(seen, schema).union(spark.createDataFrame([(None, *[0.5] * n), (0, *[None] * n)], schema))


@pytest.mark.parametrize("part", [200_000, 50])
def test_equals_brute_force(spark, part):
    rng = np.random.default_rng(part)
    corner = rng.uniform(0, 0.01, (900, 3))  # one hot bin, far from most places
    points = [np.concatenate([corner, corner[:300], rng.uniform(-2, 3, (6, 3))]), rng.uniform(0, 1, (40, 3)), np.zeros((0, 3)), np.repeat([[0.5, 0.5, 0.5]], 500, 0)]
    places = [rng.uniform(0, 1, (120, 3)) for _ in points]
    g, p = frames(spark, places, points)
    got = {(r.layer, r.place): r.d2 for r in nearest(g, p, 3, len(points), part).collect()}
    assert got == {(k, i): d for k in range(4) for i, d in enumerate(brute(places[k], points[k]))}


def test_no_place_meets_all_points(spark):
    rng = np.random.default_rng(1)
    places, points = [rng.uniform(0, 1, (200, 2))], [rng.uniform(0, 1, (3000, 2))]
    g, p = frames(spark, places, points)
    found = nearest(g, p, 2, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    boxes = nearest_of._Boxes([{"layer": 0, "bin": i, "n": 9, "low0": x, "high0": x + 0.02, "low1": y, "high1": y + 0.02} for i, (x, y) in enumerate(points[0].tolist())], 2, 100)
    pairs, _ = boxes.needed(0, places[0])
    assert len(pairs) < 20 * len(places[0])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(0, 300), st.integers(0, 2**32))
def test_tree(dimensions, n, seed):
    rng = np.random.default_rng(seed)
    points = np.round(rng.normal(size=(n, dimensions)), 1)
    places = np.round(rng.normal(size=(30, dimensions)), 1)
    assert Tree(points).nearest(places).tolist() == brute(places, points).tolist()
