import numpy as np
from pyspark.sql import functions as F

from gaugewright.llm import additive_quant as q


ROWS = "vec_id long, embedding array<float>, label int, rank int, score string, v int"


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "s", 2) for i, v in enumerate(vectors)], ROWS)


def brute(vectors, queries, k=5):
    ok = {i: np.array(v, float) for i, v in vectors.items() if v is not None and None not in v and np.isfinite(np.array(v, np.float32)).all() and any(v)}
    out = {}
    for i in queries:
        if i in ok:
            s = sorted(((-float(v @ ok[i] / (np.linalg.norm(v) * np.linalg.norm(ok[i]))), j) for j, v in ok.items() if j != i))
            out[i] = s[:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(40, 24))
    x = (centers[rng.integers(0, 40, 4000)] + 0.5 * rng.normal(size=(4000, 24))).astype(np.float32)
    x[100:140] = x[100]  # one vector many times
    got = {}
    for r in q.search(frame(spark, x), F.col("vec_id") % 50 == 0, rerank=100, block=30).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute(dict(enumerate(x.tolist())), range(0, 4000, 50))
    assert got.keys() == want.keys() and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hit = sum(len({j for _, j in want[i]} & {v for v, _ in got[i].values()}) for i in want)
    assert hit / (5 * len(want)) > 0.95
    for i, g in got.items():
        for v, score in g.values():
            a, b = x[i].astype(float), x[v].astype(float)
            assert abs(score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    assert [v for v, _ in (got[100][k] for k in range(1, 6))] == [101, 102, 103, 104, 105]  # ties: the smaller ids


def test_odd_vectors(spark):
    vectors = [[1, 0], None, [0, 0], [float("nan"), 1], [float("inf"), 1], [None, 1], [2, 0], [1e-30, 1e-30], [1, 2, 3], [0, 1]]
    got = [(r.query_id, r["rank"], r.vec_id) for r in q.search(frame(spark, vectors), F.col("vec_id") >= 0).orderBy("query_id", "rank").collect()]
    assert {a for a, _, _ in got} == {0, 6, 7, 9}
    assert [v for a, _, v in got if a == 0] == [6, 7, 9]
    assert q.search(frame(spark, vectors).where("false"), F.lit(True)).count() == 0
    assert q.search(frame(spark, vectors[:1]), F.lit(True)).count() == 0
    assert q.search(frame(spark, vectors), F.lit(False)).columns == ["query_id", "rank", "vec_id", "score"]


def test_beam_is_no_worse_than_greedy():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    books = q.fit(x, 4, 32)
    err = []
    for beam in (1, 8):
        codes, norms = q.encode(x, books, beam)
        back = sum(books[m][codes[:, m]] for m in range(4))
        assert np.allclose(np.linalg.norm(back, axis=1), norms, atol=1e-4)
        err.append(float(((x - back) ** 2).sum()))
    assert err[1] <= err[0]
    scores = q.looked_up(x[:7], books, codes, norms)
    assert np.allclose(scores, x[:7] @ (back / norms[:, None]).T, atol=1e-4)


def test_repeated_ids(spark):
    x = np.random.default_rng(3).normal(size=(300, 8)).astype(np.float32)
    once = frame(spark, x)
    plain = sorted(map(tuple, q.search(once, F.col("vec_id") % 50 == 0).collect()))
    repeats = once.union(once.where("vec_id in (0, 7, 194)")).union(once.where("vec_id in (0, 7, 194)"))
    assert sorted(map(tuple, q.search(repeats, F.col("vec_id") % 50 == 0).collect())) == plain
    other = frame(spark, x[:1] * np.linspace(1, 0.5, 8, dtype=np.float32))  # id 0 with another vector
    got = [r for r in q.search(once.union(other), F.col("vec_id") == 0).collect()]
    assert sorted(r["rank"] for r in got) == sorted([1, 2, 3, 4, 5] * 2)
    assert sum(r.vec_id == 0 for r in got) == 2  # each is the other's candidate


def test_best_are_merged_in_steps(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(400, 8)).astype(np.float32)
    df = frame(spark, x)
    want = sorted(map(tuple, q.search(df, F.col("vec_id") % 50 == 0, rerank=20).collect()))
    monkeypatch.setattr(q, "FAN", 2)
    assert sorted(map(tuple, q.search(df, F.col("vec_id") % 50 == 0, rerank=20).collect())) == want
