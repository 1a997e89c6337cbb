"""Assessments: evaluators over one dataset and one task, each criterion evaluated once.

Criteria build on each other (D2 to D5 on D1, D6 on D5, D7 on all), and are pure functions of the data and the
declarations, so an :class:`Assessment` keeps their results. Where observations say so (CSV does), the columns that the
task uses are read once into the block store; ``storage`` of the observations decides.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..declarations import CriterionStatus, TaskBundle
from ..operators import claim, coverage, holdout, identifiability, performance, provenance, replication, validity
from ..results import CriterionResult, OverallAssessmentResult, Reporter, result_rows, unique
from ..sources import observations
from ..sources.observations import Observations

CRITERIA = ("D0", "D1", "D2", "D3", "D4", "D5", "D6", "D7")


class Assessment:
    """A task's criteria over a dataset: a path, a DataFrame, or observations."""

    def __init__(self, dataset: str | os.PathLike | DataFrame | Observations | None, bundle: TaskBundle, spark: SparkSession | None = None):
        self.bundle, self._dataset = bundle, dataset
        self.spark = spark or getattr(dataset, "sparkSession", None) or getattr(dataset, "spark", None) or SparkSession.active()
        self._results: dict[str, CriterionResult] = {}
        self._fit = None

    @cached_property
    def data(self) -> Observations:
        d = self._dataset
        found = d if isinstance(d, Observations) else observations.bound(d) if isinstance(d, DataFrame) else observations.read(self.spark, d)
        if found.cells is not None and found.storage:
            found = found.only(used_columns(self.bundle)).kept()
        return found

    def result(self, criterion: str) -> CriterionResult:
        if criterion not in self._results:
            self._results[criterion] = self._evaluated(criterion)
        return self._results[criterion]

    def _evaluated(self, criterion: str) -> CriterionResult:
        b = self.bundle
        match criterion:
            case "D0":
                return claim.evaluate(b)
            case "D1":
                return validity.evaluate(self.data, b)
            case "D2":
                return coverage.evaluate(self.data, b, self.result("D1"))
            case "D3":
                return identifiability.evaluate(self.data, b, self.result("D1"))
            case "D4":
                return replication.evaluate(self.data, b, self.result("D1"))
            case "D5":
                result, self._fit = holdout.evaluate(self.data, b, self.result("D1"))
                return result
            case "D6":
                gate = self.result("D5")
                return performance.evaluate(self.data, b, gate, self._fit)
            case "D7":
                return provenance.evaluate(self.spark, self.data.label, b, self.result)
        raise KeyError(criterion)

    def overall(self) -> OverallAssessmentResult:
        """All criteria, and the verdict over those that are declared applicable."""
        declared = self.bundle.task.assessment
        results, missing, statuses = {"D0": self.result("D0")}, [] if declared else ["task.assessment"], []
        for c in CRITERIA[1:]:
            says = declared.criteria.get(c) if declared else None
            if says is not None and not says.applicable:
                report = Reporter(c, {"task_id": self.bundle.task.task_id})
                results[c] = report("NOT_APPLICABLE", f"{c} does not apply here: {says.reason}", {"reason": says.reason}).model_copy(update={"criterion_name": "Not Applicable"})
                continue
            results[c] = self.result(c)
            if says is None:
                missing.append(f"task.assessment.criteria.{c}")
            else:
                statuses.append(results[c].status)
        status, summary = verdict(results["D0"].status, bool(missing), statuses)
        acceptance = results["D6"].metrics.get("calibration_acceptance_status")
        return OverallAssessmentResult(
            status=status, summary=summary, task_id=self.bundle.task.task_id, criteria=results,
            calibration_acceptance_status=None if acceptance is None else CriterionStatus(acceptance), missing_evidence=unique(missing),
        )

    def rows(self) -> DataFrame:
        """The criteria's results, one row each."""
        return result_rows(self.spark, self.overall().criteria.values())

    def release(self) -> None:
        """Give the block store back."""
        if "data" in self.__dict__ and self.data.storage and self.data.cells is not None:
            self.data.cells.unpersist()


def used_columns(bundle: TaskBundle) -> list[str]:
    """The columns that a task's criteria read."""
    m, d2 = bundle.task.dataset_mapping, bundle.task.d2
    named = [m.sensor_timestamp_column, m.reference_timestamp_column, m.run_id_column, m.configuration_id_column, *m.sensor_channels.values(), *m.reference_channels.values()]
    named += [c.column for c in ((d2.conditions if d2 else None) or {}).values()]
    return [c for c in named if c is not None]


def verdict(d0: CriterionStatus, undeclared: bool, statuses: list[CriterionStatus]) -> tuple[CriterionStatus, str]:
    """A known failure beats missing evidence; an incomplete or contradictory claim comes before all."""
    s = CriterionStatus
    if d0 == s.FAIL:
        return s.FAIL, "The claim contradicts its own task, so nothing else can support it."
    if d0 != s.PASS:
        return s.INDETERMINATE, "The claim is incomplete, so it is open whether the data support it."
    if undeclared:
        return s.INDETERMINATE, "It is not declared which criteria apply, so the verdict is open."
    if s.FAIL in statuses:
        return s.FAIL, "The data fail a criterion that applies."
    if s.INDETERMINATE in statuses:
        return s.INDETERMINATE, "Evidence for a criterion that applies is missing, so the verdict is open."
    return s.PASS, "The data meet every criterion that applies."


def _one(criterion: str):
    def evaluate(dataset, bundle: TaskBundle, spark: SparkSession | None = None) -> CriterionResult:
        a = Assessment(dataset, bundle, spark)
        try:
            return a.result(criterion)
        finally:
            a.release()

    evaluate.__name__ = f"evaluate_{criterion.lower()}"
    evaluate.__doc__ = f"Evaluate {criterion} of a task over a dataset (a path, a DataFrame, or observations)."
    return evaluate


evaluate_d1, evaluate_d2, evaluate_d3, evaluate_d4, evaluate_d5, evaluate_d6, evaluate_d7 = map(_one, CRITERIA[1:])
evaluate_d0 = claim.evaluate
audit_declaration_register = claim.audit


def evaluate_all(dataset, bundle: TaskBundle, spark: SparkSession | None = None) -> OverallAssessmentResult:
    """Evaluate D0 to D7 and roll up those that are applicable."""
    a = Assessment(dataset, bundle, spark)
    try:
        return a.overall()
    finally:
        a.release()
