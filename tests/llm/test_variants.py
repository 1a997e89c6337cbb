import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugewright.llm import variants

from . import samples


def brute_words(rows, slip=variants.SLIP, length=6, count=5):
    found = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if slip and h % slip == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            found[r] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, **kw):
    words = brute_words(rows, **kw)
    form, out = {}, {}
    for w in words:
        some = [v for v in words if near(w, v)]
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
        out[w] = len(some)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], out[w], words.get(form[w]))
    return out


def result(df, **kw):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.grouped(df, **kw).collect()}


CHAIN = " ".join(["letter"] * 5 + ["lettre"] * 5 + ["lettler"] * 50 + ["lettlers"] * 260 + ["lettlerx"] * 3 + ["Éclaire"] * 6 + ["éclaire"] * 40 + ["aaaaaa"] * 5 + ["aaaaaaa"] * 30 + ["long" * 60] * 5 + ["long" * 60 + "s"] * 25)


def test_words_forms_and_roots(spark):
    rows = [(1, CHAIN), (2, None), (3, ""), (4, "short words only"), (None, "letter, letter;LETTER"), (5, "x" * 3000 + " " + "y" * 3000), (5, "x" * 3000)]
    rows += [(i, samples.prose(i % 4, 300)) for i in range(10, 60)]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n long")
    for slip in (variants.SLIP, 3):
        got = result(df, slip=slip)
        assert got == brute(rows, slip=slip)
    assert got and max(len(w) for w in got) > 240
    plain = result(df, slip=0)
    assert plain["letter"][:2] == ("lettler", "lettlers") and plain["Éclaire"][0] == "éclaire"
    assert result(df.where("false")) == {} and result(samples.odd(spark)) == brute(samples.ODD)


def test_small_filters_change_nothing(spark):
    rows = [(i, samples.prose(i, 200)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = variants.vocabulary(df)
    whole = sorted(variants.near(words).collect())
    n = words.count()
    for most in (64, 2048):
        loose = variants.filter_of(words, n, most)
        made = variants.candidates(words, b"abehiklmostu", loose)
        joined = made.join(words.selectExpr("word AS near", "n AS near_n"), F.col("candidate") == F.col("near"))
        assert sorted(joined.select("word", "near", "near_n").collect()) == whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=7), min_size=1, max_size=6, unique=True))
def test_neighbours_are_all_and_different(words):
    signs = np.frombuffer("abcé".encode("latin-1"), np.uint8)
    for at, grid in variants.letters(words):
        made = [[] for _ in at]
        for kind, base, h, repeats in variants.neighbours(grid, signs):
            for w, p, c in zip(*np.nonzero(~repeats), strict=True):
                text = variants.edited(words[at[w]], int(p) + base, chr(signs[c]), kind)
                made[w].append(text)
                if text:
                    again = np.frombuffer(text.encode("latin-1"), np.uint8)[None]
                    assert variants.hashes(again)[0] == h[w, p, c]
        for i, some in zip(at, made, strict=True):
            word = words[i]
            every = {word[:p] + word[p + 1 :] for p in range(len(word))}
            every |= {word[:p] + c + word[p + k :] for p in range(len(word) + 1) for c in "abcé" for k in (0, 1) if p + k <= len(word)} - {word}
            assert len(some) == len(set(some)) and set(some) == every
