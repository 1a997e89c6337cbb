"""Results: what a criterion or a whole assessment found, as documents and as DataFrames."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable
from typing import Any

from pydantic import Field
from pyspark.sql import DataFrame, SparkSession

from .declarations import CriterionStatus, Declared, TaskBundle

#: Violations that a result lists; all are counted.
REPORTED = 50

#: Names of the criteria (fixed values).
NAMES = {
    "D0": "Calibration Claim Completeness",
    "D1": "Measurement and Reference Validity",
    "D2": "Claimed-Domain Coverage",
    "D3": "Informativeness and Identifiability",
    "D4": "Independent Replication and Dependence",
    "D5": "Leakage-Resistant Validation",
    "D6": "Performance Evaluation and Uncertainty",
    "D7": "Reproducibility and Provenance",
}


class Violation(Declared):
    code: str
    message: str
    row_number: int | None = None
    field: str | None = None
    observed: Any | None = None
    expected: str | None = None


class CriterionResult(Declared):
    criterion_id: str
    criterion_name: str
    status: CriterionStatus
    summary: str
    context: dict[str, Any] = Field(default_factory=dict)
    metrics: dict[str, Any] = Field(default_factory=dict)
    missing_evidence: list[str] = Field(default_factory=list)
    violations: list[Violation] = Field(default_factory=list)


class OverallAssessmentResult(Declared):
    status: CriterionStatus
    summary: str
    task_id: str
    criteria: dict[str, CriterionResult]
    calibration_acceptance_status: CriterionStatus | None = None
    missing_evidence: list[str] = Field(default_factory=list)


def unique(items: Iterable[str]) -> list[str]:
    """Each item once, where it first stands."""
    return list(dict.fromkeys(items))


class Findings:
    """Violations in the order they are found: all counted by code, the first ``limit`` listed."""

    def __init__(self, limit: int | None = REPORTED):
        self.limit, self.counts, self.listed = limit, Counter(), []

    def add(self, code: str, message: str, **details: Any) -> None:
        self.counts[code] += 1
        if self.limit is None or self.total <= self.limit:
            self.listed.append(Violation(code=code, message=message, **details))

    def more(self, code: str, n: int) -> None:
        """Count violations that are listed elsewhere or not at all."""
        if n:
            self.counts[code] += n

    @property
    def total(self) -> int:
        return sum(self.counts.values())

    def by_code(self, ordered: bool = True) -> dict[str, int]:
        return dict(sorted(self.counts.items())) if ordered else dict(self.counts)


class Reporter:
    """Makes the results of one criterion; ``context`` goes with each."""

    def __init__(self, criterion: str, context: dict[str, Any]):
        self.criterion, self.context = criterion, context

    def __call__(self, status: str, summary: str, metrics: dict | None = None, missing: Iterable[str] = (), found: Findings | None = None) -> CriterionResult:
        return CriterionResult(
            criterion_id=self.criterion,
            criterion_name=NAMES[self.criterion],
            status=CriterionStatus(status),
            summary=summary,
            context=self.context,
            metrics=metrics or {},
            missing_evidence=unique(missing),
            violations=found.listed if found else [],
        )

    def passed(self, summary: str, metrics: dict) -> CriterionResult:
        return self("PASS", summary, metrics)

    def open(self, summary: str, missing: Iterable[str], metrics: dict | None = None) -> CriterionResult:
        return self("INDETERMINATE", summary, metrics, missing)

    def undeclared(self, missing: list[str]) -> CriterionResult:
        return self.open(f"{self.criterion} stays open: {len(missing)} thing(s) it needs are not declared.", missing)

    def unconfigured(self) -> CriterionResult:
        at = f"task.{self.criterion.lower()}"
        return self.open(f"{self.criterion} stays open: the task has no part for it.", [at])

    def ungated(self, gate: CriterionResult) -> CriterionResult:
        g = gate.criterion_id
        metrics = {f"{g.lower()}_status": gate.status.value, f"{g.lower()}_summary": gate.summary}
        return self.open(f"{self.criterion} waits for {g}, which does not hold.", [f"prerequisite.{g}_PASS"], metrics)


def profile_context(bundle: TaskBundle, **more: Any) -> dict[str, Any]:
    """Ids of a task and its profiles; ``more`` follows the task's id or, from ``after``, the profiles."""
    after = more.pop("after", {})
    return {
        "task_id": bundle.task.task_id, **more, "sensor_profile_id": bundle.sensor.instrument_id,
        "reference_profile_id": bundle.reference.instrument_id, "setup_profile_id": bundle.setup.setup_id, **after,
    }


_ROW = "criterion_id string, criterion_name string, status string, summary string, missing_evidence array<string>, violations array<struct<code:string,message:string,row_number:bigint,field:string,observed:string,expected:string>>, metrics string"


def result_rows(spark: SparkSession, results: Iterable[CriterionResult]) -> DataFrame:
    """One row per criterion; metrics as JSON text."""
    rows = []
    for r in results:
        found = [(v.code, v.message, v.row_number, v.field, None if v.observed is None else str(v.observed), v.expected) for v in r.violations]
        rows.append((r.criterion_id, r.criterion_name, r.status.value, r.summary, r.missing_evidence, found, json.dumps(r.model_dump(mode="json")["metrics"])))
    return spark.createDataFrame(rows, _ROW)
