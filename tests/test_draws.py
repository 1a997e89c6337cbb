import numpy as np
import pytest

from gaugewright.functions import draws


@pytest.mark.parametrize("n", [2, 3, 7, 64, 1000, 3_000_000_000, 2**31 + 1, 2**32])
def test_words_stand_for_the_same_numbers(n):
    want = np.random.default_rng(9).integers(0, n, size=5000)
    got = draws.accepted(np.concatenate([draws.words(9, a, 1500) for a in range(0, 15_000, 1500)]), n)
    assert got[:5000].tolist() == want.tolist()


@pytest.mark.parametrize(("n", "repetitions", "stretch"), [(1, 5, 64), (3, 200, 64), (7, 100, 1 << 18), (1000, 9, 512)])
def test_draws_are_those_of_the_generator(spark, n, repetitions, stretch):
    want = np.random.default_rng(20).integers(0, n, size=(repetitions, n))
    got = np.zeros((repetitions, n), int)
    for r in draws.times(spark, n, repetitions, 20, stretch).collect():
        got[r.repetition, r.place] += r.times
    assert got.tolist() == [np.bincount(row, minlength=n).tolist() for row in want]


def test_rejected_words_move_later_stretches(spark):
    n = 3_000_000_000  # three words in ten are rejected
    want = np.random.default_rng(4).integers(0, n, size=20_000)
    begin = draws.counted(spark, 4, n, 20_000, 1024)
    assert begin[-1] >= 20_000 > begin[-2] and len(begin) > 20
    for i in (0, 7, len(begin) - 2):
        own = draws.accepted(draws.words(4, i * 1024, 1024), n)
        k = min(len(own), 20_000 - begin[i])
        assert own[:k].tolist() == want[begin[i] : begin[i] + k].tolist()
