import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugewright.llm import decontamination

from . import samples


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window=10):
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for k, item in items:
            own = words(item)
            size = min(window, len(own))
            for a in range(len(own) - size + 1) if own else ():
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == own[a : a + size]:
                        hit |= set(range(p, p + size))
                        found.add("" if k is None else str(k))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=repr)


def fixture():
    r = random.Random(5)
    item = [samples.prose(100 + i, 24) for i in range(6)]
    items = [(i, t) for i, t in enumerate(item)] + [(20, "Only four Words here"), (21, "ONLY"), (22, ""), (23, None), (None, item[0]), (3, "another text of item three, longer than ten words, so it has windows"), (24, item[1])]
    rows = [(i, samples.prose(i, 80)) for i in range(12)]
    for i, t in enumerate(item):
        w = t.split()
        rows.append((50 + i, f"{samples.prose(i, 30)}. {' '.join(w[2:9 + i])}! {samples.prose(i + 9, 30)}, {t.upper()}"))
    rows += [(90, "say: only four, words; HERE"), (90, "say: only four, words; HERE"), (91, " ".join(item) * 40), (92, "é only four words here"), (None, item[2])]
    r.shuffle(rows)
    return rows + samples.ODD, items


DOCS, ITEMS = "doc_id long, text string, items string, runs long", "item_id long, text string, n_words long"


def test_against_brute_force(spark):
    rows, items = fixture()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    tests = spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    want = brute(rows, items)
    assert rows_of(decontamination.contamination(docs, tests)) == want
    assert rows_of(decontamination.contamination(docs, tests, shard_words=100)) == want
    assert rows_of(decontamination.contamination(docs, tests, window=3)) == brute(rows, items, 3)
    clean = decontamination.decontaminated(docs, tests)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in clean.collect()) == sorted((i or 0, t or "") for i, t in rows if not dict.fromkeys(x for x in brute([(i, t)], items)[0][3]))
    assert decontamination.contamination(docs.where("false"), tests).count() == 0
    assert all(r.n_hit == 0 for r in decontamination.contamination(docs, tests.where("false")).collect())


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rows, items = fixture()
    docs, tests = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS), spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (10, 900))
    assert len(list(decontamination.blocks(tests))) > 2
    assert rows_of(decontamination.contamination(docs, tests)) == brute(rows, items)


def test_longest_matches(spark):
    rows, items = fixture()
    docs, tests = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS), spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    got = {(r.doc_id, r.item_id): (r.n_words, r.doc_start, r.item_start) for r in decontamination.matches(docs, tests).collect() if r.doc_id in range(50, 60)}
    texts = {}
    for k, t in items:
        texts.setdefault("" if k is None else str(k), []).append(words(t))
    for i, t in rows:
        w = words(t)
        for k, some in texts.items() if i in range(50, 60) else ():
            best = max(((n, -p, -q) for own in some for p in range(len(w)) for q in range(len(own)) for n in [common(w[p:], own[q:])] if n >= min(10, len(own))), default=None)
            assert got.get((i, k)) == (best and (best[0], -best[1], -best[2])), (i, k)


def common(a, b):
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 40))
def test_suffix_array_is_sorted(numbers, depth):
    text = np.array([*numbers, 0, 0], np.int32)
    order = decontamination.suffix_array(text, depth)

    def suffix(p):
        out = []
        while text[p + len(out)]:
            out.append(int(text[p + len(out)]))
        return out[:depth]

    assert sorted(order.tolist()) == [i for i, x in enumerate(text) if x]
    some = [suffix(p) for p in order.tolist()]
    assert some == sorted(some)
