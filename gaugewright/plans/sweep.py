"""Many tasks at once: declarations that rows of a table change, each evaluated where the row lies.

D0, the audit of a register and the roll-up of statuses need no observations, so a table of thousands of tasks is a map: each
row says how its task differs from a base, and tasks evaluate it. Rows that change a base alike are evaluated once a task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from ..declarations import CriterionStatus, DeclarationRegister, TaskBundle
from ..operators import claim
from ..sources.shared import ship
from .assessment import verdict

#: Different rows whose results a task keeps.
_KEPT = 10_000


def changed(document: dict, changes: dict[str, str | None]) -> dict:
    """A document with values (as JSON) at paths by dots; null takes away what stands there."""
    out = json.loads(json.dumps(document))
    for path, value in changes.items():
        *above, last = path.split(".")
        at = out
        for step in above:
            at = at[step]
        at[last] = None if value is None else json.loads(value)
    return out


def _mapped(rows: DataFrame, evaluate: Callable[[Any], tuple], schema: str) -> DataFrame:
    """``rows``: key, and one column that ``evaluate`` takes; ``schema``: what it returns."""
    ship(rows.sparkSession)
    key, given = rows.columns
    whole = f"{key} {rows.schema[key].dataType.simpleString()}, {schema}"
    names = [x.split()[0] for x in whole.split(", ")]
    kinds = [{"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in batches:
            out = []
            for value in b.column(1).to_pylist():
                mark = repr(value)
                if mark not in known:
                    if len(known) >= _KEPT:
                        known.clear()
                    known[mark] = evaluate(value)
                out.append(known[mark])
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]], names=names)

    return rows.mapInArrow(run, whole)


def claims(rows: DataFrame, bundle: TaskBundle) -> DataFrame:
    """D0 of many tasks. ``rows``: a key, and changes to the base's task (a map of paths to JSON); returns the key, status, codes
    (with counts, by name) and missing (in order), joined by commas."""
    base = bundle.model_dump(mode="json")

    def evaluate(changes) -> tuple[str, str, str]:
        r = claim.evaluate(TaskBundle.model_validate(base | {"task": changed(base["task"], dict(changes))}))
        return r.status.value, ",".join(f"{c}:{n}" for c, n in sorted(r.metrics["violations_by_code"].items())), ",".join(r.missing_evidence)

    return _mapped(rows, evaluate, "status string, codes string, missing string")


def registers(rows: DataFrame, bundle: TaskBundle) -> DataFrame:
    """Audits of many registers (as JSON) against one task: the key, aligned, order_matches, task_id_matches, n_listed, unlisted
    and settled paths, joined by commas."""
    base = bundle.model_dump(mode="json")

    def evaluate(document: str) -> tuple:
        a = claim.audit(TaskBundle.model_validate(base), DeclarationRegister.model_validate_json(document))
        return a.aligned, a.order_matches, a.task_id_matches, a.registered_count, ",".join(a.missing_from_register), ",".join(a.no_longer_missing)

    return _mapped(rows, evaluate, "aligned boolean, order_matches boolean, task_id_matches boolean, n_listed int, unlisted string, settled string")


def verdicts(rows: DataFrame) -> DataFrame:
    """Overall statuses. ``rows``: a key, and a struct of d0, undeclared and statuses (of the criteria that apply)."""

    def evaluate(x: dict) -> tuple[str]:
        return (verdict(CriterionStatus(x["d0"]), x["undeclared"], [CriterionStatus(s) for s in x["statuses"]])[0].value,)

    return _mapped(rows, evaluate, "status string")
