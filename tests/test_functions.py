import json
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugewright.functions.columns import is_close, parsed, quoted, rotated, stripped
from gaugewright.functions.linalg import factor, least_squares
from gaugewright.operators.provenance import compared
from gaugewright.operators.validity import proper_rotation

CELLS = [
    "1", " 1 ", "+1.5", "-.5", "5.", "1e3", "1E-3", "1_000", "1__0", "_1", "1_", "1.0d", "1f", "0x10", "inf", "-Infinity", "nan", "", " ", None, "1,5", "1 2", "\t7\n", "1e400", "--1", "1e", "e1", ".", "\x1c3\x1f", "\u00a04\u3000", "5\u00a0x",
]


def python_number(cell):
    try:
        x = float(cell)
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


def test_numbers_are_read_as_python_reads_them(spark):
    df = spark.createDataFrame([(c,) for c in CELLS], "c string")
    got = [r.v for r in df.select(parsed(F.col("c")).alias("v")).collect()]
    assert got == [python_number(c) for c in CELLS]
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (None,)], "c double")
    assert [r.v for r in df.select(parsed(F.col("c"), "double").alias("v")).collect()] == [1.5, None, None, None]


def test_text(spark):
    cells = [" a ", " b ", None, "c d", "\x1ce\x1d"]
    df = spark.createDataFrame([(c,) for c in cells], "`a.b` string")
    assert [r.v for r in df.select(stripped(quoted("a.b")).alias("v")).collect()] == [(c or "").strip() for c in cells]


def test_rotation(spark):
    turn = [[0.6, -0.8], [0.8, 0.6]]
    r = spark.range(1).select(*[c.alias(f"r{i}") for i, c in enumerate(rotated([F.lit(2.0), F.lit(3.0)], turn))]).first()
    assert tuple(r) == (0.6 * 2 - 0.8 * 3, 0.8 * 2 + 0.6 * 3)
    assert proper_rotation(turn) and not proper_rotation([[0.0, 1.0], [1.0, 0.0]]) and not proper_rotation([[1.0, 0.0], [1.0, 0.0]])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.floats(allow_nan=True, allow_infinity=True), st.floats(allow_nan=True, allow_infinity=True)), min_size=1, max_size=8))
def test_is_close(spark, pairs):
    df = spark.createDataFrame(pairs, "a double, b double")
    got = [r.v for r in df.select(is_close(F.col("a"), F.col("b"), 1e-3, 1e-6).alias("v")).collect()]
    assert got == [math.isclose(a, b, rel_tol=1e-3, abs_tol=1e-6) for a, b in pairs]


def test_factor_and_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    y = x @ [[1.0], [2.0], [-1.0]] + 3 + 0.1 * rng.normal(size=(500, 1))
    rows = np.hstack([x, y])
    df = spark.createDataFrame(rows.tolist(), "a double, b double, c double, y double").repartition(7)
    r, n = factor(df, [F.lit(1.0), F.col("a"), F.col("b"), F.col("c"), F.col("y")])
    design = np.hstack([np.ones((500, 1)), x])
    coefficients, rank, singular = least_squares(r, n, 4)
    want = np.linalg.lstsq(design, y, rcond=None)
    assert n == 500 and rank == want[2] == 4
    np.testing.assert_allclose(coefficients, want[0], rtol=1e-9)
    np.testing.assert_allclose(singular, want[3], rtol=1e-9)
    same = df.withColumn("b", F.col("a"))
    r, n = factor(same, [F.lit(1.0), F.col("a"), F.col("b"), F.col("c"), F.col("y")])
    coefficients, rank, _ = least_squares(r, n, 4)
    design[:, 2] = design[:, 1]
    np.testing.assert_allclose(coefficients, np.linalg.lstsq(design, y, rcond=None)[0], rtol=1e-8, atol=1e-10)
    assert rank == 3
    assert factor(df.where("false"), [F.col("a")])[1] == 0


def test_documents_are_compared_value_by_value(spark):
    a = {"x": [1, 2.0, {"y.z": True}], "w": None, "y": {"z": 1}}
    pairs = {
        "same": (a, {"x": [1.0 + 1e-12, 2, {"y.z": 1}], "w": None, "y": {"z": 1}}, []),
        "values": (a, {"x": [1, 2.1, {"y.z": 0}], "w": 0, "y": {"z": 1}}, ["x.1", "x.2.y.z", "w"]),
        "keys": (a, {"x": [1], "v": 1, "y": {"z": 2}}, ["__keys__"]),
        "lengths": ({"x": [1, [2]]}, {"x": [3, [2, 4]]}, ["x.0", "x.1.__length__"]),
        "kinds": ({"x": {"y": 1}, "z": "1"}, {"x": [1], "z": 1}, ["x", "z"]),
        "nan": (float("nan"), float("nan"), [""]),
    }
    recorded, live = (spark.createDataFrame([(k, json.dumps(p[i])) for k, p in pairs.items()] + [(f"only {i}", "1")], "key string, document string") for i in (0, 1))
    got = {}
    for r in compared(recorded, live, 0.0, 1e-9).orderBy("key", "place").collect():
        got.setdefault(r.key, []).append(r.path)
    assert got == {k: p[2] for k, p in pairs.items() if p[2]} | {"only 0": [""], "only 1": [""]}
