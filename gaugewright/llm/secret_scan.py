"""Secret scans: three patterns, and a linear-chain conditional random field that adds what they miss.

The field tags every lexeme B(egin), I(nside) or O(utside) of a secret. Its features are the lexeme's shape (length, share
of digits, alphabet, changes of class, entropy, marks, first characters), the words beside it (two before, one after), what
separates it from the word before, and features of the whole file; transitions are learnt too; Viterbi decodes. Lexemes
whose score for O is so much better that no sequence through B or I can win (:meth:`Field.open_places`) are O for certain;
the chain falls apart there into short runs, each decoded exactly.

There are no labels: the field learns from what the patterns find in at most ``sample`` documents (a documented bound;
chosen by a hash of the id), and from secrets of other shapes made up by :func:`made_up` and put between the words of these
documents: keys with a vendor's mark, random keys, keys over several lines, pass phrases of several plain words. The rest
of the documents, and made-up harmless texts like addresses and names in code, are the opposite. Training maximises the
likelihood with forward and backward sums on the driver, over windows of lexemes: all windows with a secret of the
patterns, at most ``negatives`` others (chosen by a hash), and MADE made-up ones.

Defined results: a null or empty text has no spans; repeated rows are each scanned; an empty table gives no rows; very long texts
are scanned whole, as one chain; other columns, also such of our names, are ignored. Without any text to learn from, the
field learns from the made-up ones alone. Places count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import operator
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, released, removed, ship, spread, written

#: Spans of the three patterns, of the field, and of what stands beside a pattern's span in one lexeme with it.
KINDS = ("assign", "access", "hex", "field", "rest")
SAMPLE = 4000
#: Windows of lexemes without a secret that the field is trained on, at most; made-up windows; lexemes beside a secret.
RUNS, MADE, BESIDE = 2500, 2500, 4
#: Lexemes after a word that announces several, of its line, that are told of it; windows that hold a feature at least.
REACH, LEAST = 12, 4
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LEXEME = re.compile(r"""[^\x20\x09-\x0D"'`,;:=<>()\[\]{}|]+""")
_APART = re.compile(r"""[\x20\x09-\x0D"'`,;:=<>()\[\]{}|]""")
_GAPS = re.compile(r"""([\x20\x09-\x0D"'`,;:=<>()\[\]{}|]+)""")
_NOT_IN_WORDS = ".*#$%&!?-_"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three patterns, leftmost and non-overlapping per kind, by start and then kind as listed."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class _Classes(dict):
    """Classes of code points for ``str.translate``: 0 digit, A upper, a other letter, marks as they are, ? the rest."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c if c in "@./-_+#$%&*!~=" else "?"
        return k


_CLASSES = _Classes()


def outline(lexeme: str) -> tuple[str, int, bool, bool, str]:
    """All that :func:`shape` reads of a lexeme: classes, different characters, only hex digits, plain, first characters."""
    classes = lexeme.translate(_CLASSES)
    return classes, min(len(set(lexeme)) // 2, 16), "0" in classes and not lexeme.strip("0123456789abcdef"), lexeme.isascii(), lexeme[:4] if len(lexeme) >= 8 else ""


def shape(classes: str, different: int, hex_only: bool, plain: bool, first: str) -> tuple[str, ...]:
    """Features of a lexeme alone; all its characters count."""
    n, digits = len(classes), classes.count("0")
    upper, lower = classes.count("A"), classes.count("a")
    if not upper + lower:
        kind = "dec" if digits else "marks"
    elif hex_only:
        kind = "hex"
    else:
        kind = "upper" if not lower else "lower" if not upper else "name" if upper == 1 and classes[0] == "A" and not digits else "mixed"
        kind += "+digits" if digits else ""
    changes = sum(map(operator.ne, classes, classes[1:]))
    marks = "".join(sorted(set(classes) - set("0Aa?")))[:3]
    return (
        f"len={min(n // 4, 12)}", f"digits={4 * digits // n}", f"kind={kind}", f"different={different}", f"marks={marks}",
        f"changes={min(4 * changes // n, 3)}{min(changes // 3, 4)}", f"kind-len={kind}{min(n // 8, 5)}{plain}", f"first={first}",
    )


def file_features(text: str) -> tuple[str, ...]:
    return (f"file-code={min(text.count('=') + text.count('{'), 3)}", f"file-length={min(int(math.log10(len(text) + 1)), 5)}")


def neighbour(lexeme: str) -> str:
    return lexeme.lower().strip(_NOT_IN_WORDS)[:24]


def gap(between: str) -> str:
    """What stands between two lexemes, as far as it is a feature."""
    return "".join(c for c in "\n=:\"'<(" if c in between)[:3]


def announces(lexeme: str) -> bool:
    """Whether it may announce several words that are a secret together."""
    return neighbour(lexeme) in ("passphrase", "phrase")


def split(text: str) -> tuple[list[str], list[str]]:
    """Lexemes, and what stands before each of them."""
    parts = _GAPS.split(text)
    lexemes, gaps = parts[0::2], ["", *parts[1::2]]
    if lexemes and not lexemes[-1]:
        lexemes.pop(), gaps.pop()
    if lexemes and not lexemes[0]:
        lexemes, gaps = lexemes[1:], gaps[1:]
    return lexemes, gaps


@dataclass
class Run:
    """Neighbouring lexemes: places in the text, and their features."""

    spans: list[tuple[int, int]]
    features: list[tuple[str, ...]]


def runs(text: str) -> list[Run]:
    """All lexemes of a text with their features, as one run; none without lexemes. The plain form of what
    :meth:`Scorer.scores` adds up by tables."""
    lexemes, _ = split(text)
    if not lexemes:
        return []
    of_file = file_features(text)
    spans = [(m.start(), m.end()) for m in _LEXEME.finditer(text)]
    words = ["", "", *map(neighbour, lexemes), ""]
    features, line = [], 0
    for i, (w, (start, _)) in enumerate(zip(lexemes, spans, strict=True)):
        between = text[spans[i - 1][1] if i else 0 : start]
        line = 0 if "\n" in between else line
        features.append((*shape(*outline(w)), *of_file, "one", f"before={words[i + 1]}", f"before2={words[i]}", f"after={words[i + 3]}", f"gap={gap(between)}", f"same={i > 0 and w == lexemes[i - 1]}", f"line={line > 0}"))
        line = REACH if announces(w) else max(line - 1, 0)
    return [Run(spans, features)]


O, B, I = 0, 1, 2  # noqa: E741
_BANNED = -1e4  # I after O, or first


@dataclass
class Field:
    """Weights by feature and tag, and by pair of tags."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 3)))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))

    def scores(self, run: Run) -> np.ndarray:
        out = np.zeros((len(run.features), 3))
        for i, fs in enumerate(run.features):
            at = [self.index[f] for f in fs if f in self.index]
            out[i] = self.weights[at].sum(0)
        out[0, I] += _BANNED
        return out

    def decode(self, run: Run) -> list[int]:
        """The best tags, by Viterbi; ties go to O, then B."""
        return self.best(self.scores(run))

    def best(self, s: np.ndarray, after_o: bool = False, before_o: bool = False) -> list[int]:
        """The best tags for scores by lexeme and tag; the lexeme before or after may be known to be O."""
        t = self.transitions + _banned()
        best, back = s[0] + (t[O] if after_o else 0), []
        for row in s[1:]:
            through = best[:, None] + t
            back.append(through.argmax(0))
            best = through.max(0) + row
        tags = [int((best + (t[:, O] if before_o else 0)).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def open_places(self, s: np.ndarray) -> np.ndarray:
        """Places that may be other than O in a best sequence. A best sequence holds a stretch of B and I only if it is worth
        as much as O throughout. What one place adds to that is ``c`` at most, with the best transition that leads to it; what
        the stretch's end adds, ``end``. So a place is O for certain if no stretch around it sums up to -end."""
        t = self.transitions
        c = np.maximum(s[:, B] + t[:, B].max(), s[:, I] + max(t[B, I], t[I, I])) - s[:, O] - t[O, O]
        c[0] = s[0, B] - s[0, O]
        sums = np.concatenate([[0.0], np.cumsum(c)])
        least = np.minimum.accumulate(sums[:-1])
        most = np.maximum.accumulate(sums[:0:-1])[::-1]
        end = max(0.0, t[B, O] - t[O, O], t[I, O] - t[O, O])
        return np.flatnonzero(most - least + end >= -1e-9 * (1 + np.abs(sums).max()))


def _banned() -> np.ndarray:
    t = np.zeros((3, 3))
    t[O, I] = _BANNED
    return t


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


#: Features that training leaves out by turns, so that shape and neighbours each learn to tell a secret alone.
_ALPHABET = ("kind=", "kind-len=", "marks=", "first=")
_CONTEXT = ("before", "after=", "gap=", "line=")


def _without(run: Run, left_out: tuple[str, ...]) -> Run:
    return Run(run.spans, [tuple("" if f.startswith(left_out) else f for f in fs) for fs in run.features])


def trained(examples: list[tuple[Run, list[int]]], rounds: int = 60, rate: float = 0.4, ridge: float = 1e-4) -> Field:
    """Maximum likelihood by AdaGrad; gradients from forward and backward sums over all runs at once, by length."""
    model = Field()
    if not any(t != O for _, tags in examples for t in tags):
        return model  # nothing to learn: no weights, all O
    examples = examples + [(_without(run, (_ALPHABET, _CONTEXT)[i % 2]), tags) for i, (run, tags) in enumerate(examples)]
    seen = Counter(f for run, _ in examples for fs in run.features for f in fs)
    for f, n in seen.items():
        if n >= LEAST:  # words of few windows tell nothing of others
            model.index[f] = len(model.index)
    absent = model.index.setdefault("", len(model.index))
    model.weights = np.zeros((len(model.index), 3))
    by_length: dict[int, list[tuple[Run, list[int]]]] = {}
    for e in examples:
        by_length.setdefault(len(e[1]), []).append(e)
    packs = []
    for n, some in sorted(by_length.items()):
        ids = np.array([[[model.index.get(f, absent) for f in fs] for fs in r.features] for r, _ in some])
        tags = np.array([t for _, t in some])
        tags[:, 0] = np.where(tags[:, 0] == I, B, tags[:, 0])
        packs.append((n, ids, tags))
    total = sum(len(p[1]) for p in packs)
    every = np.concatenate([ids.ravel() for _, ids, _ in packs])
    width = packs[0][1].shape[2]
    grown = [np.full_like(model.weights, 1e-8), np.full((3, 3), 1e-8)]
    for _ in range(rounds):
        gw, gt = -ridge * model.weights, -ridge * model.transitions
        t = model.transitions + _banned()
        missed = []
        for n, ids, tags in packs:
            s = model.weights[ids].sum(2)
            s[:, 0, I] += _BANNED
            forward = [s[:, 0]]
            for i in range(1, n):
                forward.append(_log_sum(forward[-1][:, :, None] + t, 1) + s[:, i])
            backward = [np.zeros((len(ids), 3))]
            for i in range(n - 1, 0, -1):
                backward.append(_log_sum(t[None] + (s[:, i] + backward[-1])[:, None, :], 2))
            backward.reverse()
            z = _log_sum(forward[-1], 1)
            p = np.exp(np.stack(forward, 1) + np.stack(backward, 1) - z[:, None, None])
            missed.append(((np.eye(3)[tags] - p) / total).reshape(-1, 3))
            for i in range(1, n):
                pair = np.exp(forward[i - 1][:, :, None] + t + (s[:, i] + backward[i])[:, None, :] - z[:, None, None])
                seen = np.bincount(3 * tags[:, i - 1] + tags[:, i], minlength=9).reshape(3, 3)
                gt += (seen - pair.sum(0)) / total
        d = np.concatenate(missed)
        for tag in (O, B, I):
            gw[:, tag] += np.bincount(every, np.repeat(d[:, tag], width), len(gw))
        for w, g, h in ((model.weights, gw, grown[0]), (model.transitions, gt, grown[1])):
            h += g * g
            w += rate * g / np.sqrt(h)
        model.weights[absent] = 0
    return model


def secret_places(text: str) -> list[tuple[int, int]]:
    """Values that the patterns find, without the names before them; one in another, or beside it, is one."""
    out: list[tuple[int, int]] = []
    for kind, a, b in base_spans(text):
        a = _ASSIGN.match(text, a).start(2) if kind == "assign" else a
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def tagged(run: Run, secrets: list[tuple[int, int]]) -> list[int]:
    """Tags of a run's lexemes; secrets are in order and apart."""
    tags, at, before = [], 0, None
    for a, b in run.spans:
        while at < len(secrets) and secrets[at][1] <= a:
            at += 1
        inside = at < len(secrets) and secrets[at][0] < b
        tags.append(O if not inside else I if before == at else B)
        before = at if inside else None
    return tags


def windows(run: Run, tags: list[int], every: int = 24) -> list[tuple[Run, list[int]]]:
    """Windows of a run: each secret with the lexemes beside it, and one of plain lexemes out of ``every``, and around each
    lexeme that has digits or marks."""
    out, taken, n = [], -1, len(tags)

    def take(a: int, b: int) -> None:
        nonlocal taken
        a = max(a, taken + 1)
        while a < n and tags[a] == I:  # no window begins within a secret
            a += 1
        if a < b:
            out.append((Run(run.spans[a:b], run.features[a:b]), tags[a:b]))
            taken = b - 1

    for i, tag in enumerate(tags):
        if tag == B:
            end = i + 1
            while end < n and tags[end] == I:
                end += 1
            take(i - BESIDE, min(end + BESIDE, n, i + 64))
        elif tag == O and i > taken and (i % every == 0 or run.features[i][2] not in _PLAIN):
            end = min(n, i + BESIDE)
            while B in tags[i:end]:
                end -= 1
            take(i - BESIDE, end)
    return out


_PLAIN = ("kind=lower", "kind=name", "kind=upper", "kind=marks")


def examples(text: str) -> list[tuple[Run, list[int]]]:
    """Windows with the tags that the patterns imply."""
    secrets = secret_places(text)
    return [w for run in runs(text) for w in windows(run, tagged(run, secrets))]


#: Marks that vendors' keys begin with, words that announce a secret, and harmless words after them (fixed values).
MARKS = "ghp_ gho_ glpat- xoxb- xoxp- sk_live_ sk- npm_ hf_ AIza ya29. SG. dop_v1_ eyJ".split()
CUES = "password passwd pwd pass secret token key credential credentials auth bearer authorization api_key access_key client_secret private_key".split()
PHRASE_CUES = ("passphrase", "pass phrase", "recovery phrase", "seed phrase", "wallet phrase")
HARMLESS = "is are was that of the for required expired reset manager holder ring board field and to invalid missing policy".split()
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_MIXED = _LOWER + _LOWER.upper() + "0123456789"


def made_up(words: list[str], n: int = MADE, seed: int = 5, marks: list[str] | None = None) -> list[tuple[str, list[tuple[int, int]]]]:
    """``n`` short texts among the given words, with the places of their secrets: five in eight hold one."""
    r = random.Random(seed)
    words = words or ["word", "another"]
    marks = MARKS if marks is None else marks

    def some(alphabet: str, least: int, most: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(r.randint(least, most)))

    def plain(k: int) -> str:
        return " ".join(r.choice(words) for _ in range(k))

    def word() -> str:
        return r.choice(words).strip(_NOT_IN_WORDS).lower() if r.random() < 0.5 else some(_LOWER, 3, 9)

    def announced(value: str, always: bool = False) -> tuple[str, str, str]:
        if not always and r.random() < 0.35:
            return "", value, ""
        quote = r.choice(("", '"', "'"))
        return r.choice(CUES) + r.choice((" = ", "=", ": ", ":", " is ", " ", " -> ")) + quote, value, quote

    def secret() -> tuple[str, str, str]:
        kind = r.randrange(6)
        if kind == 0 and marks:
            return announced(r.choice(marks) + some(_MIXED + "-_" * r.randint(0, 1), 20, 60))
        if kind == 1:
            return announced(some(_MIXED + "+/" * r.randint(0, 1), 24, 64) + r.choice(("", "", "=", "==")))
        if kind == 2:
            return announced(some(_MIXED + "!@#$%^&*?", 8, 20), always=True)
        if kind == 3:
            return r.choice(PHRASE_CUES) + r.choice((": ", " = ", " is ", ' "', ' = "')), r.choice((" ", " ", "-")).join(word() or "word" for _ in range(r.randint(4, 12))), r.choice(('"\n', ".\n", "\n"))
        if kind == 4:
            lines = [some(_MIXED + "+/", 64, 64) for _ in range(r.randint(2, 8))] + [some(_MIXED + "+/", 12, 60) + r.choice(("", "=", "=="))]
            name = r.choice(("RSA PRIVATE", "PRIVATE", "EC PRIVATE", "OPENSSH PRIVATE"))
            return f"-----BEGIN {name} KEY-----\n", "\n".join(lines), f"\n-----END {name} KEY-----\n"
        return announced(some("0123456789ABCDEF" if r.random() < 0.5 else _LOWER.upper() + "0123456789", 20, 48))

    def harmless() -> str:
        digits = "0123456789"
        return r.choice(
            (
                lambda: f"{r.choice(CUES + list(PHRASE_CUES))} {r.choice(HARMLESS)} {word()}",
                lambda: f"https://{word()}.example.com/{word()}/{some(_LOWER + digits, 4, 30)}?{word()}={some(digits, 1, 6)}",
                lambda: f"{word()}.{word()}{some(digits, 1, 3)}@{word()}.example.com",
                lambda: f"{word()}{word().title()}{word().title()}({word()}_{word()})",
                lambda: f"/usr/{word()}/{word()}-{some(digits, 1, 2)}.{some(digits, 1, 2)}.{some(digits, 1, 2)}/{word()}.txt",
                lambda: f"+{some(digits, 1, 3)} ({some(digits, 3, 3)}) {some(digits, 3, 3)}-{some(digits, 4, 4)}",
                lambda: some(digits, 4, 19),
                lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
                lambda: f"{word().upper()}_{word().upper()}-{some(digits, 1, 5)}",
                lambda: f"{some(digits, 4, 4)}-{some(digits, 2, 2)}-{some(digits, 2, 2)}T{some(digits, 2, 2)}:{some(digits, 2, 2)}",
                lambda: " ".join([r.choice(words)] * r.randint(3, 12) + [r.choice(words)] * r.randint(3, 12)),
                lambda: f"{some(_LOWER, 12, 40)} {some(_LOWER, 10, 30).upper()}",
            )
        )()

    out = []
    for i in range(n):
        text, places = plain(r.randint(2, 8)) + r.choice((" ", "\n")), []
        if i % 8 < 5:
            before, value, after = secret()
            places.append((len(text) + len(before), len(text) + len(before) + len(value)))
            text += before + value + after
        else:
            text += harmless()
        if i % 8 in (4, 7):  # nothing follows it
            out.append((text[: places[0][1]] if places and r.random() < 0.5 else text, places))
        else:
            out.append((text + r.choice((" ", "\n", ", ")) + plain(r.randint(2, 8)), places))
    return out


def learn(docs: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", negatives: int = RUNS) -> Field:
    """Train the field on a bounded sample of documents: on all their windows with a secret, at most ``negatives`` others,
    and the made-up ones among their words."""
    n = docs.count()
    some = docs.select(F.col(text_column).cast("string").alias("text"), F.xxhash64(F.lit("field"), F.col(id_column)).alias("h"))
    if n > sample:
        some = some.where(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * sample / n))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = examples(t or "")
                # which windows are kept is decided by a hash of what they hold
                marks = [xxhash.xxh64_intdigest("\t".join(map("\t".join, e[0].features))) >> 1 for e in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h] * len(rows), pa.int64()), pa.array(marks, pa.int64()), pa.array([e[0].features for e in rows], pa.list_(pa.list_(pa.string()))), pa.array([e[1] for e in rows], pa.list_(pa.int32()))],
                    ["h", "mark", "features", "tags"],
                )

    table, path = written(mapped(some, found, "h long, mark long, features array<array<string>>, tags array<int>"), "runs")
    secret = F.exists("tags", lambda t: t != O)
    parts = [table.where(secret).orderBy("mark", "h").toArrow(), table.where(~secret).orderBy("mark", "h").limit(negatives).toArrow()]
    removed(docs.sparkSession, path)
    taken = [(Run([(0, 0)] * len(t), [tuple(f) for f in fs]), t) for p in parts for fs, t in zip(p["features"].to_pylist(), p["tags"].to_pylist(), strict=True)]
    words = sorted({f.removeprefix("before=") for run, tags in taken if not any(tags) for fs in run.features for f in fs if f.startswith("before=")} - {""})
    for text, places in made_up(words):
        for run in runs(text):
            tags = tagged(run, places)
            taken += [w for w in windows(run, tags) if B in w[1]] if B in tags else [(run, tags)]
    return trained(taken)


class Rows:
    """A table of scores by tag that grows."""

    def __init__(self) -> None:
        self.n, self.table = 0, np.zeros((256, 3))

    def add(self, row: np.ndarray) -> int:
        if self.n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.n] = row
        self.n += 1
        return self.n - 1


class Scorer:
    """A field ready to read texts. Lexemes, outlines and gaps are looked up in tables that are emptied once they hold
    ``limit`` entries, or more ``characters`` in all."""

    def __init__(self, model: Field, limit: int = 200_000, characters: int = 8 << 20):
        self.model, self.limit, self.characters = model, limit, characters
        self.nothing = [self._sum((f"{f}=",)) for f in ("before", "before2", "after")]
        self.whether = [self._sum((f,)) for f in ("same=False", "same=True", "line=False", "line=True")]
        # neighbours that the field knows, each with its row of ``beside``; row 0: all others
        known = sorted({f.split("=", 1)[1] for f in model.index if f.startswith(("before=", "before2=", "after="))} | {"passphrase", "phrase"})
        self.words = {w: i + 1 for i, w in enumerate(known)}
        self.beside = np.array([[np.zeros(3)] * 3] + [[self._sum((f"{f}={w}",)) for f in ("before", "before2", "after")] for w in known])
        self.announcing = np.array([False] + [announces(w) for w in known])
        self.firsts = {f.removeprefix("first=") for f in model.index if f.startswith("first=")}
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}  # row of the outline, and of the neighbour below it
        self.outlines: dict[tuple, int] = {}
        self.gaps: dict[str, int] = {}
        self.shapes, self.of_gap = Rows(), Rows()
        self.held = 0

    def _sum(self, features: tuple[str, ...]) -> np.ndarray:
        at = [self.model.index[f] for f in features if f in self.model.index]
        return self.model.weights[at].sum(0)

    def _added(self, lexeme: str) -> int:
        classes, different, hex_only, plain, first = outline(lexeme)
        key = classes, different, hex_only, plain, first if first in self.firsts else "\n"
        at = self.outlines.get(key)
        if at is None:
            self.outlines[key] = at = self.shapes.add(self._sum(shape(*key)))
            self.held += len(lexeme)
        self.known[lexeme] = both = at * len(self.beside) + self.words.get(neighbour(lexeme), 0)
        self.held += len(lexeme)
        return both

    def scores(self, text: str, lexemes: list[str], gaps: list[str]) -> np.ndarray:
        """Scores by lexeme and tag: the same sums as :meth:`Field.scores` over :func:`runs`."""
        if max(len(self.known), len(self.gaps)) > self.limit or self.held > self.characters:
            self._empty()
        known = self.known
        for w in set(lexemes).difference(known):
            self._added(w)
        for g in set(gaps).difference(self.gaps):
            self.gaps[g] = self.of_gap.add(self._sum((f"gap={gap(g)}",)))
            self.held += len(g)
        n = len(lexemes)
        at, word = np.divmod(np.fromiter(map(known.__getitem__, lexemes), np.int64, n), len(self.beside))
        nothing, (alone, same, far, near) = self.nothing, self.whether
        out = self.shapes.table[at]
        out += self.of_gap.table[np.fromiter(map(self.gaps.__getitem__, gaps), np.int64, n)]
        out += self._sum((*file_features(text), "one")) + alone + far
        again = 1 + np.flatnonzero(np.fromiter(map(operator.eq, lexemes[1:], lexemes), bool, n - 1))
        out[again] += same - alone
        announcing = self.announcing[word]
        if announcing.any():
            place = np.arange(n)
            last = np.append(-REACH - 1, np.maximum.accumulate(np.where(announcing, place, -REACH - 1))[:-1])
            line = np.maximum.accumulate(np.where(["\n" in g for g in gaps], place, 0))
            out += ((place - last <= REACH) & (last >= line))[:, None] * (near - far)
        # nothing stands before the first lexemes and after the last one
        out[1:] += self.beside[word[:-1], 0]
        out[0] += nothing[0]
        out[2:] += self.beside[word[:-2], 1]
        out[:2] += nothing[1]
        out[:-1] += self.beside[word[1:], 2]
        out[-1] += nothing[2]
        out[0, I] += _BANNED
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Secrets that the field finds in a text."""
        lexemes, gaps = split(text)
        if not lexemes or not self.model.index:
            return []
        s = self.scores(text, lexemes, gaps)
        places = self.model.open_places(s)
        if not len(places):
            return []
        n, out = len(lexemes), []
        lead = _GAPS.match(text)
        ends = np.cumsum([len(g) + len(w) for g, w in zip(gaps, lexemes, strict=True)]) + (lead.end() - len(gaps[0]) if lead else 0)
        for some in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
            a, b = int(some[0]), int(some[-1]) + 1
            tags = self.model.best(s[a:b], a > 0, b < n)
            at = 0
            while at < len(tags):
                end = at + 1
                if tags[at] != O:
                    while end < len(tags) and tags[end] == I:
                        end += 1
                    out.append((int(ends[a + at]) - len(lexemes[a + at]), int(ends[a + end - 1])))
                at = end
        return out


def completed(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Lexemes that a pattern's span covers only in part: the rest is secret too. Hex runs in paths are left as they are."""
    out, begin, end = [], 0, 0
    for kind, a, b in base:
        if not begin < b <= end:
            begin, end = b, m.start() if (m := _APART.search(text, b)) else len(text)
            while begin and not _APART.match(text, begin - 1):
                begin -= 1
        if (begin < a or b < end) and (begin, end) not in out[-1:] and not (kind == "hex" and text.find("/", begin, end) >= 0):
            out.append((begin, end))
    return out


def scan(text: str, model: Field | Scorer) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The patterns' spans, and all spans; what the field finds within one pattern's span adds nothing. The whole of a lexeme
    that a pattern covers only in part is a span of its own kind (``rest``), which no field has found."""
    scorer = model if isinstance(model, Scorer) else Scorer(model)
    base = base_spans(text)
    extra = [("field", a, b) for a, b in scorer.spans(text) if not any(s[1] <= a and b <= s[2] for s in base)]
    if base:
        extra += [("rest", a, b) for a, b in completed(text, base) if not any(s[1] <= a and b <= s[2] for s in extra)]
    return base, ordered(base + extra)


def _scanned(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Scorer(box.value)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base, every = scan(t or "", model)
                n = Counter(s[0] for s in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(told(base).encode()).hexdigest(), [{"kind": k, "start": s, "end": e} for k, s, e in every]))
            arrays = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays, pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], kind)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return run


def find(df: DataFrame, model: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: counts by pattern, digest of the patterns' spans, and ``found``: all spans (kind, start, end)."""
    box = df.sparkSession.sparkContext.broadcast(model)  # words of a bounded number of windows
    slim = spread(df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")))
    return mapped(slim, _scanned(box), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:string,start:bigint,end:bigint>>")


def span_text(found: str = "found"):
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: list[tuple[str, int, int]], mask: str = MASK) -> str:
    """The text with each stretch of overlapping spans replaced by the mask."""
    out, at, reach = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= reach:
            out += [text[at:a], mask]
        at = reach = max(reach, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, model: Field, text_column: str = "text") -> DataFrame:
    """The rows with secrets masked in their texts; all columns stay, a null text stays null."""
    ship(df.sparkSession)
    box = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Scorer(box.value)
        for column in batches:
            yield pa.array([t if t is None else masked(t, scan(t, model)[1]) for t in column.to_pylist()], pa.string())
        released()

    return spread(df).withColumn(text_column, clean(F.col(text_column).cast("string")))
