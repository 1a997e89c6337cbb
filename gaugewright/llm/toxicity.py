"""Toxicity by class-conditional Kneser-Ney models.

A text is read as its whole sequence of lower-case words, each letter by letter with an end mark. A letter's context is
its word so far (up to seven characters); a word's first letter has the end of the word before it. Two models, of toxic
and of ordinary texts, have counts c_c of their own for each context and back off to one Kneser-Ney chain P(x | h') of
continuation counts, gathered from both, with one back-off weight l(h) = D T(h) / c(h) from both classes' counts:

    P_c(x | h) = (1 - l(h)) Q_c(x | h) + l(h) P(x | h'),
    Q_c(x | h) = (max(c_c(hx) - D, 0) + (S + D T_c(h)) q(x | h)) / (S + c_c(h)),

T being the different letters after h, q the discounted counts of both classes, and S a strength. An expression that is
rare in a class thus gets nearly the same estimate from either model and tells little; one that no labelled text holds
gets the same and tells nothing. All n-grams, also those seen once, are in the shared counts.

Toxic texts are ordinary ones with toxic words here and there, so their likelihood of a word is (1 - e) P_0 + e P_1. A
text's value is the difference of the two log-likelihoods of its sequence by its length (and PRIOR_WORDS more, so that a
few words don't tell more than they can); one slope and one intercept, fitted on texts that the counts do not know, make
it a probability. A text without words gets the share of toxic labels.

PRIOR_WORDS, and this form rather than others (e = 1, which is the difference of the two whole likelihoods; counts of
occurrences; back-off weights of each class's own), were compared on learning rows alone, split anew into counts, calibration
and test; the README lists what was tried.

Labels are learnt from at most ``sample`` labelled rows and ``sample_bytes`` of their texts (documented bounds; rows are
chosen by a hash of the id), so the model that is sent to the tasks is bounded too. Counts are of documents that hold a
word. Defined results: a null or empty text has no word; very long texts are read whole, in time linear in them; ids
without a label or with a null one are not learnt from; a label given several times counts once, as the highest; without
labels of both classes every score is the share of toxic labels (0 without any); repeated rows are each scored, and
learnt from once; an empty table gives no rows; other columns are ignored (``accepted`` keeps them).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, mapped, released, removed, ship, spread, written

ORDER = 8
DISCOUNT = 0.75
#: S, e and the words added to a text's length.
STRENGTH, SHARE, PRIOR_WORDS = 10.0, 0.01, 20
#: Labelled rows learnt from (on average; rows are chosen by hash), and bytes of their texts, at most.
SAMPLE, SAMPLE_BYTES = 12_000, 96 << 20
#: Words whose ratios a task keeps.
KEPT_WORDS = 150_000
#: Marks that are no letters: a word's start and end, and what stands before the word before.
_START, _END, _BEFORE = "\x02", "\x03", "\x04"


def sequence(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of all texts of a column in a row, and where each text's begin (one more place than texts)."""
    plain = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), "\0", "\1")  # NUL marks absent letters
    split = pc.ascii_split_whitespace(pc.utf8_lower(plain))
    flat, offsets = split.flatten(), split.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), kept[offsets - offsets[0]]


def opening(before: str, word: str) -> str:
    """A word's first letter with its context; ``before``: the word before it, or none."""
    return _BEFORE + (before or _START)[-2:] + _START + word[0]


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of strings in a row, and where each begins (one more place than strings)."""
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.concatenate([[0], np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))])


def _windows(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of words (rows of ORDER code points, zeros first) for every letter but the first, and the word's end; and the
    number of them of each word."""
    points, begin = _codes(["\0" * (ORDER - 3) + _START + w + _END for w in strings])
    size = np.diff(begin) - ORDER + 1
    first = np.repeat(begin[:-1], size)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return points[(first + within)[:, None] + np.arange(ORDER)], size


def _openings(strings: list[str]) -> np.ndarray:
    return _codes([s.rjust(ORDER, "\0") for s in strings])[0].reshape(-1, ORDER)


def _hashed(rows: np.ndarray) -> np.ndarray:
    """64-bit keys of rows of code points."""
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = (h ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Table:
    """Numbers by key: sorted arrays, 12 bytes an entry."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a key is there, its number)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at]


@dataclass
class Model:
    """``ratio``: of a seen n-gram, log P(toxic) - log P(ordinary); others have the same probability in both classes.
    ``prior``: share of toxic labels."""

    ratio: Table
    prior: float = 0.0
    slope: float | None = None
    intercept: float = 0.0

    def ratios(self, rows: np.ndarray) -> np.ndarray:
        """Differences of the log-likelihoods of the grams' last letters."""
        seen, value = self.ratio.get(_hashed(rows))
        return np.where(seen, value, 0.0).astype(np.float64)

    def words(self, some: list[str]) -> np.ndarray:
        """Of words, without their first letter."""
        out = [np.zeros(0)]
        for at in range(0, len(some), 20_000):
            rows, size = _windows(some[at : at + 20_000])
            out.append(np.add.reduceat(self.ratios(rows), np.cumsum(size) - size))
        return np.concatenate(out)

    def values(self, column: pa.Array, known: dict[str, float], step: int = 256) -> list[tuple[float, int]]:
        """Per text: the difference of its sequence's log-likelihoods, and its words. ``known`` keeps what words are worth."""
        out: list[tuple[float, int]] = []
        for at in range(0, len(column), step):
            out += self._values(column.slice(at, step), known)
        return out

    def _values(self, column: pa.Array, known: dict[str, float]) -> list[tuple[float, int]]:
        flat, begin = sequence(column)
        size = np.diff(begin)
        if not len(flat):
            return [(0.0, 0)] * len(size)
        coded = flat.dictionary_encode()
        different, word = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        fresh = [w for w in different if w not in known]
        if len(known) + len(fresh) > KEPT_WORDS:
            known.clear()
            fresh = different
        worth = dict(zip(fresh, self.words(fresh).tolist(), strict=True))
        known.update((w, x) for w, x in worth.items() if len(w) <= 64)  # very long words are not kept
        own = np.array([known[w] if w in known else worth[w] for w in different])
        # openings: the word before's last two characters, and the first one
        tails: dict[str, int] = {_START: 0}
        firsts: dict[str, int] = {}
        tail = np.array([tails.setdefault(w[-2:], len(tails)) for w in different])
        first = np.array([firsts.setdefault(w[0], len(firsts)) for w in different])
        before = np.zeros(len(word), np.int64)
        before[1:] = tail[word[:-1]]
        before[begin[:-1][size > 0]] = 0
        pair, place = np.unique(before * len(firsts) + first[word], return_inverse=True)
        tail_of, first_of = list(tails), list(firsts)
        opens = self.ratios(_openings([opening(tail_of[p // len(firsts)], first_of[p % len(firsts)]) for p in pair.tolist()]))
        value = np.log1p(SHARE * np.expm1(np.minimum(own[word] + opens[place], 50.0)))
        total = np.bincount(np.repeat(np.arange(len(size)), size), weights=value, minlength=len(size))
        return list(zip(total.tolist(), size.tolist(), strict=True))

    def score(self, value: float, n_words: int) -> float:
        if self.slope is None or not n_words:
            return self.prior
        return float(_logistic(self.intercept + self.slope * normalised(value, n_words)))

    def scores(self, column: pa.Array, known: dict[str, float]) -> list[float]:
        return [self.score(v, n) for v, n in self.values(column, known)]


def normalised(value: float, n_words: int) -> float:
    return value / (n_words + PRIOR_WORDS)


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def shared(rows: np.ndarray) -> np.ndarray:
    """P(x | h') of each gram hx (distinct rows), h' being h without its first character: interpolated Kneser-Ney down to
    single letters. A count is the number of different longer grams (among all grams' endings)."""
    length = (rows != 0).sum(1)  # zeros only stand first
    # by length: keys of its grams and their contexts; where their endings are among the next shorter; counts
    keys, contexts, place, continued = [], [], [], []
    now = np.zeros((0, ORDER), rows.dtype)
    for n in range(ORDER, 0, -1):
        if len(now):
            now[:, ORDER - n - 1] = 0
        both = np.concatenate([now, rows[length == n]])
        known, first, inverse = np.unique(_hashed(both), return_index=True, return_inverse=True)
        place.append(inverse[: len(now)].astype(np.int32))
        continued.append(np.bincount(place[-1], minlength=len(first)).astype(np.int32))
        now = both[first]
        del both, inverse, first
        keys.append(known)
        contexts.append(_contexts(now).astype(np.int32))
    letters = len(now) + 1
    lower = np.zeros(0)
    by_length: dict[int, np.ndarray] = {}
    for n in range(1, ORDER + 1):
        at = ORDER - n
        by_length[n] = lower[place[at + 1]] if n > 1 else np.full(len(keys[at]), 1 / letters)
        lower = _interpolated(contexts[at], continued[at], by_length[n])
    base = np.zeros(len(rows))
    for n, of in by_length.items():
        here = length == n
        base[here] = of[np.searchsorted(keys[ORDER - n], _hashed(rows[here]))]
    return base


def _contexts(rows: np.ndarray) -> np.ndarray:
    return np.unique(_hashed(rows[:, :-1]), return_inverse=True)[1]


def _interpolated(context: np.ndarray, counts: np.ndarray, base: np.ndarray) -> np.ndarray:
    if not len(context):
        return np.zeros(0)
    total, kinds = np.bincount(context, weights=counts), np.bincount(context, weights=counts > 0)
    t = total[context]
    return np.where(t > 0, (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds[context] * base) / np.maximum(t, 1), base)


def _tallied(rows: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the distinct rows, the rows, and the sums of their counts."""
    keys, first, inverse = np.unique(_hashed(rows), return_index=True, return_inverse=True)
    return keys, rows[first], np.column_stack([np.bincount(inverse, weights=each[:, c], minlength=len(keys)) for c in (0, 1)])


def _strings(some: list[str] | pa.Array) -> list[str]:
    return some if isinstance(some, list) else some.to_pylist()


def fitted(words: list[str] | pa.Array, openings: list[str] | pa.Array, counts: np.ndarray, prior: float = 0.0) -> Model:
    """The model of words, then openings, with ``counts`` (ordinary, toxic) of documents that hold them."""
    parts = []
    for at in range(0, len(words), 20_000):  # in parts, each counted at once, so that little is held
        rows, size = _windows(_strings(words[at : at + 20_000]))
        parts.append(_tallied(rows, np.repeat(counts[at : at + len(size)], size, axis=0)))
    parts.append(_tallied(_openings(_strings(openings)), counts[len(words) :]))
    keys, rows, each = _tallied(np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
    del parts
    held = [each[:, c] for c in (0, 1)]
    context = _contexts(rows)
    sums = lambda x: np.bincount(context, weights=x)[context]
    pool = held[0] + held[1]
    total, kinds = sums(pool), sums(pool > 0)
    loose = DISCOUNT * kinds / total
    both = (pool - DISCOUNT) / (total - DISCOUNT * kinds)
    below = loose * shared(rows)
    log = [np.log((1 - loose) * (np.maximum(h - DISCOUNT, 0) + (STRENGTH + DISCOUNT * sums(h > 0)) * both) / (STRENGTH + sums(h)) + below) for h in held]
    return Model(Table(keys, log[1] - log[0]), prior)


def calibrated(model: Model, x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> Model:
    """Slope and intercept by logistic regression (Newton's method)."""
    scale = float(np.abs(x).mean()) or 1.0
    a = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(2)
    for _ in range(rounds):
        p = _logistic(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
    model.intercept, model.slope = float(w[0]), float(w[1] / scale)
    return model


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: list[Counter] = [Counter(), Counter()]

    def out() -> pa.RecordBatch:
        keys = list(known[0].keys() | known[1].keys())
        arrays = [pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.string()), *(pa.array([k[g] for g in keys], pa.int64()) for k in known)]
        for k in known:
            k.clear()
        return pa.RecordBatch.from_arrays(arrays, ["opens", "gram", "ordinary", "toxic"])

    for b in batches:
        flat, begin = sequence(b.column(0))
        for i, label in enumerate(b.column(1).to_pylist()):
            found = flat.slice(begin[i], begin[i + 1] - begin[i]).to_pylist()
            known[bool(label)].update((False, w) for w in set(found))
            known[bool(label)].update((True, g) for g in set(map(opening, ["", *found], found)))
            if len(known[0]) + len(known[1]) > 200_000:
                yield out()
    yield out()


def _valued(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = box.value, {}
        for b in batches:
            x = [normalised(v, n) for v, n in model.values(b.column(0), known)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column(1)], ["x", "label"])

    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, text_column: str = "text", learn_fold=lambda f: f != 0) -> Model:
    """Learn from labelled documents whose :func:`fold` passes. Of the bounded sample, four fifths give counts and one
    fifth, which the counts do not know, the calibration (all, if that has labels of one class only)."""
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    marks = marks.where(learn_fold(fold("id"))).groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20))
    n = marks.count()
    if n > sample:
        marks = marks.where(drawn < int((1 << 20) * sample / n))
    # the marks are bounded by the sample, so they are sent to the texts and not the texts to them; an id's rows count once
    rows = docs.select(F.col("doc_id").alias("id"), F.col(text_column).cast("string").alias("text")).join(F.broadcast(marks), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text")).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(5)))
    rows, path = written(rows, "labelled")
    size, n, n_toxic = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if size > sample_bytes:  # the hash's lower end already stands for the sample
        least = (1 << 20) * min(1.0, sample / max(n, 1))
        rows = rows.where(drawn < int(least * sample_bytes / size))
    rows = rows.select("text", "label", "part")
    prior = n_toxic / n if n else 0.0
    if not 0 < n_toxic < n:
        removed(spark, path)
        return Model(Table(np.zeros(0, np.uint64), np.zeros(0)), prior)
    counted = mapped(rows.where("part < 4"), _counting, "opens boolean, gram string, ordinary long, toxic long")
    table = counted.groupBy("opens", "gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).toArrow()  # bounded by the sample
    opens = table["opens"].combine_chunks()
    parts = [table.filter(pc.invert(opens)), table.filter(opens)]
    counts = np.concatenate([np.column_stack([p["ordinary"].to_numpy(), p["toxic"].to_numpy()]) for p in parts]).astype(np.int32)
    grams = [p["gram"].combine_chunks() for p in parts]
    del table, opens, parts
    released()
    model = fitted(*grams, counts, prior)
    del grams, counts
    box = spark.sparkContext.broadcast(model)
    held = mapped(rows.where("part = 4"), _valued(box), "x double, label int").toArrow()
    y = held["label"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        held = mapped(rows.select("text", "label"), _valued(box), "x double, label int").toArrow()
        y = held["label"].to_numpy().astype(float)
    box.unpersist()
    removed(spark, path)
    released()
    return calibrated(model, held["x"].to_numpy(), y)


def _scoring(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = box.value, {}
        for b in batches:
            scores = model.scores(b.column(b.num_columns - 1), known)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*b.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The columns ``keep``, ``score`` and ``predicted`` of every row. No shuffle."""
    box = docs.sparkSession.sparkContext.broadcast(model)
    slim = spread(docs.select(*keep, F.col(text_column).cast("string").alias("__text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", score double"
    return mapped(slim, _scoring(box), schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with all their columns. No shuffle."""
    ship(docs.sparkSession)
    box = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, known = box.value, {}
        for column in batches:
            yield pa.array(model.scores(column, known), pa.float64())
        known.clear()
        released()

    return spread(docs).where(scored(F.col(text_column).cast("string")) < threshold)
