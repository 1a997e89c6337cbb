"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context, and only that reply is trained on.
Turns after the last reply form a last example without a target, so that no turn is lost.

The examples of a conversation are prefixes of one formatted stream. :func:`segments` formats each turn (a map, no
shuffle), and :func:`examples` gives each example as places in the stream: where it ends, and where its target lies. That
is linear in the turns, also for a conversation that holds a third of all rows; the windows behind it run in the JVM and
spill. :func:`materialised` writes the texts out, which is quadratic in a conversation's turns by nature.

Template: ``### role: text</turn>`` and a newline per turn. In texts ``\\``, ``###`` and ``</turn>`` get a backslash before
them, in roles ``:`` too; :func:`parsed` reads turns back exactly.

Defined results: null texts and roles are empty; turns are ordered by turn (null first), then role, then text; repeated
rows are turns of their own; a null conv_id is a conversation like any other; an empty table gives no examples; other
columns are ignored. Places count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped

#: The template's fixed strings.
OPEN, CLOSE, TARGET_ROLE = "### ", "</turn>", "assistant"
_ESCAPED = r"(\\|###|</turn>)"
_ESCAPED_ROLE = r"(\\|###|</turn>|:)"
_CONTROL = re.compile(r"\\(?:\\|###|</turn>|:)|###|</turn>|:")


def _escape(column: Column, pattern: str) -> Column:
    return F.regexp_replace(column, pattern, r"\\$1")


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|:)", r"\1", text)


def segments(df: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, its formatted ``segment`` and where the text lies in that. A map."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    head = F.concat(F.lit(OPEN), _escape(role, _ESCAPED_ROLE), F.lit(": "))
    body = _escape(text, _ESCAPED)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"), body.alias("body"))
    return rows.select(
        "conv_id", "turn", "role", "text",
        F.concat("head", "body", F.lit(CLOSE + "\n")).alias("segment"),
        F.length("head").cast("long").alias("text_start"),
        (F.length("head") + F.length("body")).cast("long").alias("text_end"),
    )


_ORDER = ("turn", "role", "text")


def stream(parts: DataFrame) -> DataFrame:
    """Segments with their number and place in their conversation's stream."""
    w = Window.partitionBy("conv_id").orderBy(*_ORDER)
    size = F.length("segment").cast("long")
    return parts.withColumns(
        {
            "number": F.row_number().over(w).cast("long"),
            "stream_start": F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")),
            "is_last": F.lead(F.lit(1)).over(w).isNull(),
        }
    ).withColumn("stream_end", F.col("stream_start") + F.length("segment"))


def with_examples(placed: DataFrame) -> DataFrame:
    """The stream's segments, each with the example that ends with it, if one does: ``n_turns`` and ``n_chars`` that it takes
    from the stream, and its target's place (null for the example of turns that no reply follows)."""
    target = F.col("role") == TARGET_ROLE
    ends = target | F.col("is_last")
    spot = lambda c: F.when(target, F.col("stream_start") + F.col(c))
    return placed.withColumns({"n_turns": F.when(ends, F.col("number")), "n_chars": F.when(ends, F.col("stream_end")), "loss_start": spot("text_start"), "loss_end": spot("text_end")})


def examples(placed: DataFrame) -> DataFrame:
    """One row per example: its conversation, the turns and characters it takes from the stream, and its target's place
    (null for the example of turns that no reply follows)."""
    return with_examples(placed).where(F.col("n_turns").isNotNull()).select("conv_id", "n_turns", "n_chars", "loss_start", "loss_end")


def parsed(formatted: str) -> list[tuple[str, str]]:
    """Turns (role, text) of formatted text: the inverse of the template."""
    out, at, n = [], 0, len(formatted)
    while at < n:
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        begin = at + len(OPEN)
        colon = end = None
        for m in _CONTROL.finditer(formatted, begin):
            if m[0] == ":" and colon is None:
                colon = m.start()
            elif m[0] == CLOSE:
                end = m.start()
                break
        if colon is None or end is None:
            raise ValueError(f"the turn at {at} does not end")
        out.append((unescaped(formatted[begin:colon]), unescaped(formatted[colon + 2 : end])))
        at = end + len(CLOSE) + 1
    return out


def materialised(placed: DataFrame) -> DataFrame:
    """Texts of the examples, one row each: conv_id, n_turns, context, target and tail. Conversations are read turn by turn, in
    order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, so_far = object(), []
        for b in batches:
            rows: list[tuple] = []
            for conv, role, segment, a, z, last in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if conv != now:
                    now, so_far = conv, []
                if role == TARGET_ROLE:
                    rows.append((conv, len(so_far) + 1, "".join(so_far) + segment[:a], segment[a:z], segment[z:]))
                elif last:
                    rows.append((conv, len(so_far) + 1, "".join(so_far) + segment, None, ""))
                so_far.append(segment)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "n_turns", "context", "target", "tail"])

    rows = placed.select("conv_id", "role", "segment", "text_start", "text_end", "is_last", "number").repartition("conv_id").sortWithinPartitions("conv_id", "number")
    return mapped(rows, run, "conv_id long, n_turns long, context string, target string, tail string")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads conversations back from their streams and examples, turn by turn; holds one turn."""
    now, state = object(), None
    rows: list[tuple] = []

    def close() -> None:
        if state is not None:
            rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for b in batches:
        for conv, segment, start, loss_start, loss_end, end in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if state is None or conv != now:
                close()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parsed(segment):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if loss_start is not None:
                target = unescaped(segment[loss_start - start : loss_end - start])
                state[2] += len(target)
                state[3].update(target.encode("utf-8", "surrogatepass"))
            state[4] += end or 0
        yield _rows(rows)
        rows = []
    close()
    yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def digests(df: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: turns and their digest, trained characters and their digest, and
    the characters of all its examples. Contexts are not written out, they are prefixes of the stream."""
    # an example ends with the segment that holds its target, so that the stream and its examples are read side by side;
    # rows already lie by conversation and in order, as the window left them
    rows = with_examples(stream(segments(df))).select("conv_id", "segment", "stream_start", "loss_start", "loss_end", "n_chars")
    return mapped(rows, _digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
