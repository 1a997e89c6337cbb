import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.llm import lm_trie as m

from . import samples


@pytest.mark.parametrize("bits", [10, 40, 64])
def test_elias_fano(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 1000):
        values = np.sort(rng.integers(0, 2**bits - 1 if bits < 64 else 2**63, n, dtype=np.uint64) * np.uint64(2 if bits == 64 else 1))
        code = m.EliasFano(values, bits)
        assert (code.get(np.arange(n)) == values).all()
        if not n:
            continue
        asked = np.concatenate([values, values + np.uint64(1), np.array([0, int(values[-1])], np.uint64)])
        assert (code.successor(asked) == np.searchsorted(values, asked)).all()
        lo, hi = n // 4, n // 2
        want = np.clip(np.searchsorted(values, asked), lo, hi)
        assert (code.successor(asked, np.full(len(asked), lo), np.full(len(asked), hi)) == want).all()
    assert m.EliasFano(np.sort(rng.integers(0, 1 << 40, 5000, dtype=np.uint64)), 40).lows.nbytes < 5000 * 4


def brute(rows, train):
    tok = [(d, (t or "").encode().lower().split() + [b""]) for d, t in rows]
    used = [t for (d, t) in tok if train(d)]
    c = Counter(w for t in used for w in t)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for t in used for p in zip([b" ", *t], t, strict=False))
    triples = Counter(p for t in used for p in zip([b" ", *t], t, t[1:], strict=False))
    ctx, ctx2 = Counter(h for h, _ in pairs.elements()), Counter(p[:2] for p in triples.elements())
    kinds, kinds2 = Counter(h for h, _ in pairs), Counter(p[:2] for p in triples)
    out = []
    for d, t in tok:
        p = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
        score = 0.0
        for g, h, w in zip([None, b" ", *t], [b" ", *t], t, strict=False):
            q = (max(pairs[h, w] - m.DISCOUNT, 0) + m.DISCOUNT * kinds[h] * p(w)) / ctx[h] if ctx[h] else p(w)
            if ctx2[g, h]:
                q = (max(triples[g, h, w] - m.DISCOUNT, 0) + m.DISCOUNT * kinds2[g, h] * q) / ctx2[g, h]
            score += math.log10(q)
        out.append((d, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p(w)) for w in t), score))
    return out


def fold(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5


@pytest.mark.parametrize("hot", [True, False])
def test_scores_match_brute_force(spark, hot, monkeypatch):
    if not hot:
        monkeypatch.setattr(m, "HOT_MOST", 0)
    else:
        monkeypatch.setattr(m, "HOT_SHARE", 0.05)
    rows = [(i, t) for i, t in samples.ODD] + [(100 + i, ("the " if i % 2 else "") + samples.prose(i % 30, 80)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kind", "'x' AS batch", "2 AS train")
    got = m.scores(df.repartition(3), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], round(r[4], 6))
    want = sorted(brute(rows, lambda d: fold(d) != 1), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-12)
        assert abs(a[5] - b[5]) < 5e-4 * b[1]


def test_empty_and_untrained(spark):
    assert m.scores(samples.empty(spark), F.lit(True)).count() == 0
    got = m.scores(samples.odd(spark), F.lit(False)).collect()
    assert len(got) == len(samples.ODD) and {(r.train_tokens, r.n_known) for r in got} == {(0, 0)} and all(r.base_score == 0 for r in got)
