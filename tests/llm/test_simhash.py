import numpy as np
import pytest
import xxhash

from gaugewright.llm import components, simhash

from . import samples


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return [(doc, f"{prints[i]:016x}", min((d for d in groups[find(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows)]


def key(r):
    return tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)


def near(seed, n):
    base = samples.prose(seed, 400).split()
    out = []
    for i in range(n):
        words = list(base)
        words[(37 * i) % len(words)] = f"edit{i}"
        out.append(" ".join(words))
    return out


def test_matches_brute_force(spark):
    rows = list(samples.ODD) + [(100 + i, t) for i, t in enumerate([*near(1, 25), *near(2, 25), *(samples.prose(s) for s in range(40)), *[samples.prose(7)] * 30])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "'q' AS component_id", "2L AS path")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=key)
    assert got == sorted(brute_components(rows), key=key)
    assert simhash.near_duplicates(samples.empty(spark)).count() == 0
    stay = simhash.one_of_each(df)
    assert stay.columns == df.columns
    want = {(d, t) for (d, t), (_, _, c) in zip(rows, brute_components(rows), strict=True) if d == c}
    assert sorted((r.doc_id or 0, r.text or "") for r in stay.collect()) == sorted((d or 0, t or "") for d, t in want)


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_index_finds_exactly_the_close_pairs(distance):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    many = [base, np.array([0, 2**64 - 1], np.uint64)]
    for _ in range(8):
        x = base.copy()
        for _ in range(rng.integers(1, 5)):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        many.append(x)
    prints = np.unique(np.concatenate(many))
    index = simhash.GrayIndex(prints)
    assert (np.diff(simhash.gray_rank(index.prints).astype(object)) > 0).all()
    got = {(int(index.prints[i]), int(index.prints[j])) for a, b in index.pairs(distance, block=50) for i, j in zip(a, b, strict=True)}
    want = {(int(x), int(y)) for i, x in enumerate(index.prints) for y in index.prints[i + 1 :] if int(x ^ y).bit_count() <= distance}
    assert got == want


def test_full_buckets_are_divided_without_losing_links(spark):
    rng = np.random.default_rng(2)
    seed = np.uint64(rng.integers(0, 2**63))
    x = seed ^ np.left_shift(np.uint64(1), rng.integers(0, 64, 150).astype(np.uint64)) ^ np.left_shift(np.uint64(1), rng.integers(0, 64, 150).astype(np.uint64))
    df = spark.createDataFrame([(int(v),) for v in np.unique(x).view(np.int64)], "fp long")
    one, other = (sorted(map(tuple, components.components(simhash.links(df, 3, full)).collect())) for full in (4096, 40))
    assert one == other and len(one) > 100


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (None, 3), (100, 90), (100, 90)], "a long, b long")
    got = dict(map(tuple, components.components(links).collect()))
    assert got == dict.fromkeys(range(41), 0) | {90: 90, 100: 90}
    assert components.components(links.where("false")).count() == 0
