import math
import random
import zlib

import numpy as np
import pyarrow as pa

from gaugewright.llm import toxicity as t

from . import samples


def events(text):
    """(gram) of every letter of a text's sequence, by the definition."""
    before = ""
    for w in text.lower().split():
        yield t.opening(before, w)
        p = t._START + w + t._END
        for i in range(2, len(p)):
            yield p[max(0, i - t.ORDER + 1) : i + 1]
        before = w


def brute(texts):
    """A function (class, gram) -> probability, straight from the definition, of texts (text, class)."""
    own = [{}, {}]
    for text, c in texts:
        ws = text.lower().split()
        grams = [g for w in set(ws) for g in list(events(w))[1:]] + list({t.opening(a, b) for a, b in zip(["", *ws], ws, strict=False)})
        for g in grams:
            own[c][g] = own[c].get(g, 0) + 1
    pool = {g: own[0].get(g, 0) + own[1].get(g, 0) for g in {*own[0], *own[1]}}
    ends = {g[i:] for g in pool for i in range(len(g))}
    left = {g: sum(1 for x in ends if x[1:] == g) for g in ends}

    def interpolated(counts, g, base):
        same = {x: n for x, n in counts.items() if x[:-1] == g[:-1] and len(x) == len(g)}
        total = sum(same.values())
        if not total:
            return base
        return (max(same.get(g, 0) - t.DISCOUNT, 0) + t.DISCOUNT * sum(n > 0 for n in same.values()) * base) / total

    def lower(g):
        return 1 / (len({x[-1] for x in pool}) + 1) if not g else interpolated(left, g, lower(g[1:]))

    def p(c, g):
        if g not in pool:
            return 1.0
        among = lambda counts: {x: n for x, n in counts.items() if x[:-1] == g[:-1] and len(x) == len(g)}
        both, same = among(pool), among(own[c])
        loose = t.DISCOUNT * len(both) / sum(both.values())
        q = (pool[g] - t.DISCOUNT) / (sum(both.values()) - t.DISCOUNT * len(both))
        top = (max(same.get(g, 0) - t.DISCOUNT, 0) + (t.STRENGTH + t.DISCOUNT * len(same)) * q) / (t.STRENGTH + sum(same.values()))
        return (1 - loose) * top + loose * lower(g[1:])

    return p


def learnt(texts):
    made = [b for b in t._counting(iter([pa.RecordBatch.from_arrays([pa.array([x for x, _ in texts]), pa.array([c for _, c in texts])], ["text", "label"])]))]
    rows = [r for b in made for r in b.to_pylist()]
    rows.sort(key=lambda r: r["opens"])
    counts = np.array([(r["ordinary"], r["toxic"]) for r in rows])
    return t.fitted([r["gram"] for r in rows if not r["opens"]], [r["gram"] for r in rows if r["opens"]], counts)


TEXTS = [("a vile, vilest mild thing", 1), ("vile things\tare vile", 1), ("a mild milder thing 12", 0), ("the mile is mild; extraordinarily so", 0), ("A den", 0), ("", 1)]


def test_values_match_the_definition():
    p, model = brute(TEXTS), learnt(TEXTS)
    for text in ["a vile mild thing", "vile vile", "unseen extraordinarily vilest", "x", "thing a mild vile", "", "  ", "a\0b \0"]:
        want = 0.0
        held = list(events(text.replace("\0", "\1")))
        first = [i for i, g in enumerate(held) if g[0] == t._BEFORE] + [len(held)]
        for a, b in zip(first, first[1:], strict=False):
            ratio = sum(math.log(p(1, g)) - math.log(p(0, g)) for g in held[a:b])
            want += math.log(1 - t.SHARE + t.SHARE * math.exp(ratio))
        value, n = model.values(pa.array([text]), {})[0]
        assert n == len(text.split()) and abs(value - want) < 1e-5, text


def test_order_and_repeats_count_and_no_words_score_the_prior():
    model = learnt(TEXTS)
    model.slope, model.intercept, model.prior = 5.0, -1.0, 0.25
    a, b, c, d, e = model.scores(pa.array(["a vile mild thing", "thing vile mild a", "a vile vile mild thing", "", None]), {})
    assert len({a, b, c}) == 3 and d == e == 0.25


def test_kept_words_do_not_change_scores(monkeypatch):
    model = learnt(TEXTS)
    texts = pa.array([samples.prose(i) + " vile" * (i % 3) for i in range(40)])
    want = model.values(texts, {})
    monkeypatch.setattr(t, "KEPT_WORDS", 20)
    assert model.values(texts, {}, step=1) == want


def test_held_out_accuracy_and_odd_rows(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = samples.prose(i, 4 if i % 7 == 0 else 60).split()
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(("scoundrel", "wretched", "nitwit")))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    model = t.learn(docs, marks)
    got = {x.doc_id: x.predicted for x in t.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] == (i % 6 == 0) for i in held) / len(held) > 0.95
    assert t.accepted(docs, model).count() == sum(not p for p in got.values())
    odd = t.score(samples.odd(spark).drop("score"), model).collect()
    assert len(odd) == len(samples.ODD) and all(0 <= x.score <= 1 for x in odd)
    assert {x.score for x in odd if x.doc_id in (1, 2, 5)} == {model.prior} and 0.1 < model.prior < 0.25
    assert t.score(samples.empty(spark), model).count() == 0
    blank = t.learn(docs, marks.where("false"))
    assert {x.score for x in t.score(docs, blank).collect()} == {0.0}
    small = t.learn(docs, marks, sample_bytes=60_000)  # fewer texts, the same kinds of scores
    assert len(small.ratio.keys) < len(model.ratio.keys)
    assert t.learn(docs.limit(0), marks).prior == 0.0


def test_short_harmless_texts_are_not_called_toxic(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = t.learn(docs.select("doc_id", "text"), labels)
    rows = t.score(docs, model, ("doc_id", "n_chars")).join(labels, "doc_id").where("toxic = 0").select("n_chars", "predicted").collect()
    share = lambda some: sum(r.predicted for r in some) / max(len(some), 1)
    short, long = [r for r in rows if r.n_chars <= 100], [r for r in rows if r.n_chars > 100]
    assert short and share(short) <= max(share(long), 0.02) and share(rows) < 0.05
    assert max(model.scores(pa.array(["", "De.", "the cat sat on the mat", "Thank you for the kind letter"]), {})) < 0.5
