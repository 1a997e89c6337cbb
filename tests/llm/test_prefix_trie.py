import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gaugewright.llm import prefix_trie


def brute(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in made.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, some in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(some) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if made[c] == p).encode()).hexdigest())
        for p, m in members.items()
    )


def some_rows(seed, n=140):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), 200, 203, 317, 405, -3, -100, -150]:
        for t in range(r.choice((0, 1, 2, 3, 4, 6, 9))):
            rows.append((c, t, r.choice(("user", "assistant")), r.choice(("hi", "yes", "no", "Grüße \U0001f600"))))
    rows += [(7, None, None, None), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "assistant", "tie"), (None, 0, "user", "nobody"), (8, 0, "user", "z" * 40_000)]
    rows += [(100, t, "user", f"hot {t % 7}") for t in range(700)] + [(150, t, "user", f"hot {t % 7}") for t in range(500)]
    r.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def result(df, **kw):
    return sorted(tuple(r) for r in prefix_trie.trie(df, **kw).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 64)
    rows = some_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS split", "2 AS n_convs").repartition(3)
    assert result(df) == brute(rows)
    assert prefix_trie.trie(df.where("false")).count() == 0


@pytest.mark.parametrize("bits", [2, 4, 9])
def test_collisions_are_split(spark, bits):
    rows = some_rows(bits, 30)
    assert result(spark.createDataFrame(rows, SCHEMA), bits=bits) == brute(rows)


def test_conversations_over_many_ranges(spark):
    rows = [(5, t, "user", f"t{t % 3}") for t in range(3000)] + [(100, 0, "user", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    turns, before = prefix_trie.scanned(df)
    assert len(before) >= 2  # one conversation lies in several ranges
    got = prefix_trie.trie(df).where("conv_id = 5").select("depth", "n_convs").collect()
    h = zlib.crc32(b"5") % 6
    assert sorted(r.depth for r in got) == list(range(0, 3000 - h + 1)) and {r.n_convs for r in got if r.depth} == {1}
