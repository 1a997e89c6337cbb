import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugewright.llm import packing
from gaugewright.llm.common import tokenizer_file

from . import samples

TOKENIZER = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))


def held(rows, texts, capacity=2048):
    """Pieces cover each document once, and sequences without gaps or excess; returns the padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    ids = {d: TOKENIZER.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts}
    assert docs.keys() == ids.keys()
    for d, pieces in docs.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[d])
    pad = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad


def test_pieces(spark):
    texts = [(i, samples.prose(i, 20 + 37 * i % 1500)) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert held(packing.pack(df.repartition(3)).collect(), texts) == 0
    odd = [(i, t) for i, t in samples.ODD if i is not None and i != 4]
    rows = packing.pack(samples.odd(spark).where("doc_id <> 4"), with_ids=True).collect()
    assert held(rows, odd) == 0
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack(samples.odd(spark)).agg({"length": "sum"}).first()[0] == sum(len(TOKENIZER.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in samples.ODD)
    assert packing.pack(samples.empty(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(1, 12))
def test_differencing_deals_everything(sizes, k):
    dealt = packing.differenced(sizes, k)
    assert len(dealt) == k and sorted(i for w in dealt for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in dealt]
    if sizes:
        assert max(sums) - min(sums) <= max(sizes)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_windows_hold_and_fill(sizes):
    dealt = packing.windows(sizes, 64)
    assert sorted(i for w in dealt for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 64 for w in dealt)
    filled = packing.topped_up(dealt, sizes, 64)
    cover = defaultdict(list)
    for w in filled:
        total = sum(n for _, _, n in w)
        assert total & (total - 1) == 0 and total <= 64
        for i, start, n in w:
            cover[i].append((start, n))
    for i, size in enumerate(sizes):
        at = 0
        for start, n in sorted(cover[i]):
            assert start == at
            at += n
        assert at == size


def test_differencing_beats_or_meets_greedy():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 2048, 600).tolist()
    spread = lambda dealt: max(s := [sum(sizes[i] for i in w) for w in dealt]) - min(s)
    greedy = [[] for _ in range(300)]
    for i in sorted(range(600), key=lambda i: -sizes[i]):
        min(greedy, key=lambda w: sum(sizes[j] for j in w)).append(i)
    assert spread(packing.differenced(sizes, 300)) <= spread(greedy)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ'éÉ,.! \n\x1c"), st.characters(exclude_categories=["Cs"], exclude_characters="\x00")), max_size=40), min_size=1, max_size=4))
def test_ids_equal_the_library(texts):
    import pyarrow as pa

    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = packing.encoder(f.read())
    ids, places = encoder.ids(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[places[i] : places[i + 1]].tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


def test_other_tokenizers_are_refused():
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError, match="lower-case"):
        packing.Encoder(f.read())
