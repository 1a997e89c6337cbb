"""Small synthetic calibration tasks, and scenarios: one change to a task or its rows each, with the criterion to evaluate.

What each must give is stated in test_scenarios.py.
"""

from __future__ import annotations

import contextlib
import copy
import csv
import hashlib
import itertools
import json
import math
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from gaugewright.declarations import DeclarationClassification, DeclarationRegister, DeclarationResolutionStage
from gaugewright.results import CriterionResult
from gaugewright.sources.documents import load_task_bundle
from gaugewright.sources.observations import bound
from gaugewright.plans.assessment import Assessment, audit_declaration_register

AXES = ("Fx", "Fy", "Fz")
INPUTS = ("c1", "c2", "c3")

SENSOR = {"instrument_id": "made_up_sensor", "kind": "sensor", "channels": {c: {"unit": "count", "valid_min": -10.0, "valid_max": 10.0} for c in INPUTS}}
REFERENCE = {
    "instrument_id": "made_up_reference", "kind": "reference", "calibration_certificate_id": "certificate-1",
    "channels": {a: {"unit": "N", "valid_min": -20.0, "valid_max": 20.0, "expanded_uncertainty": 0.02} for a in AXES},
}
SETUP = {
    "setup_id": "made_up_rig", "maximum_time_offset_s": 0.002, "sensor_acquisition_bandwidth_hz": 100.0, "reference_acquisition_bandwidth_hz": 100.0,
    "sampling_process_id": "paired-sampling", "reference_to_sensor_rotation": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]],
}
TASK = {
    "task_id": "made_up_task",
    "profiles": {"sensor": "sensor.yaml", "reference": "reference.yaml", "setup": "setup.yaml"},
    "dataset_mapping": {
        "sensor_timestamp_column": "sensor_time_s", "reference_timestamp_column": "reference_time_s",
        "sensor_channels": {c: c for c in INPUTS}, "reference_channels": {a: f"{a}_ref" for a in AXES},
    },
    "d1": {
        "maximum_reference_uncertainty": dict.fromkeys(AXES, 0.05), "invalid_observation_policy_id": "keep-valid", "exclusion_record_id": "none-excluded",
        "exclusions_reviewed": True,
    },
}
D2 = {
    "axes": list(AXES), "domain": {a: {"minimum": -1.0, "maximum": 1.0, "grid_points": 3} for a in AXES}, "conditions": {},
    "excluded_regions": [], "maximum_fill_distance": 0.1,
}
D3 = {
    "model_type": "affine", "input_channels": list(INPUTS), "output_dimension": 3, "normalization": {c: {"minimum": -1.0, "maximum": 1.0} for c in INPUTS},
    "relative_rank_tolerance": 1e-12, "maximum_condition_number": 2.0, "model_specific_test_id": "design-rank", "confounding_review_id": "review-1",
    "condition_handling": "held_fixed",
}
RUNS4 = ("spiral_01", "spiral_02", "lissajous_01", "lissajous_02")
D4 = {
    "dependence_method_id": "lagged-sums", "stationarity_reviewed": True,
    "signals": [{"source": "sensor", "channel": c, "maximum_autocorrelation_lag": 1} for c in INPUTS] + [{"source": "reference", "channel": a, "maximum_autocorrelation_lag": 1} for a in AXES],
    "minimum_independent_runs": 4, "minimum_runs_per_configuration": {"spiral": 2, "lissajous": 2}, "minimum_effective_sample_size": 12.0,
    "initialization_procedure_id": "start-1", "zeroing_procedure_id": "zero-1",
    "run_evidence": [{"run_id": r, "acquisition_id": f"acquisition_{i}", "separate_acquisition": True, "initialization_completed": True, "zeroing_completed": True} for i, r in enumerate(RUNS4)],
}
DEVELOPMENT = ["development_01", "development_02", "development_03"]
D5 = {
    "validation_unit": "run", "model_source": "task.d3", "development_units": DEVELOPMENT, "test_units": ["test_01"], "minimum_test_units": 1,
    "split_manifest_id": "split-1", "split_frozen_before_development": True, "development_selection_method_id": "fixed",
    "data_use": {
        "data_dependent_preprocessing": "development_only", "model_selection": "development_only", "parameter_estimation": "development_only",
        "performance_threshold_selection": "development_only", "final_performance_evaluation": "test_only",
        "model_locked_before_test_evaluation": True, "test_results_used_for_further_development": False,
    },
}
_NEED = {"maximum_interval_half_width": 0.05, "maximum_rmse": 0.1}
D6 = {
    "metric": "rmse", "confidence_level": 0.95, "bootstrap_repetitions": 500, "bootstrap_random_seed": 7, "bootstrap_unit": "run", "minimum_bootstrap_units": 4,
    "uncertainty_method_id": "combined-1", "axes": {a: _NEED | {"calibrated_force_uncertainty": 0.03, "maximum_calibrated_force_uncertainty": 0.05} for a in AXES},
    "regions": [{"region_id": "positive_x", "dimensions": {"Fx": {"minimum": 0.0}}, "minimum_bootstrap_units": 4, "axes": {a: dict(_NEED) for a in AXES}}],
}
CLAIM = {
    "sensor_inputs": list(INPUTS), "reference_outputs": list(AXES), "operating_domain": list(AXES), "operating_conditions": [], "model_family": "affine",
    "performance_metrics": ["rmse", "calibrated_force_uncertainty"],
    "generalization": {"target_description": "later runs", "independent_unit": "run", "sensor_scope": "same_sensor", "operating_conditions": []},
}


def circle(k: int) -> tuple[float, float, float]:
    a = 2 * math.pi * k / 8
    return round(math.cos(a), 10), round(math.sin(a) * math.sqrt(0.75) if k % 2 else math.sin(a), 10), round(math.sin(a), 10)


def row(t: float, c, f, **more) -> dict:
    return {"sensor_time_s": t, "reference_time_s": round(t + 0.001, 6)} | dict(zip(INPUTS, c, strict=True)) | dict(zip([f"{a}_ref" for a in AXES], f, strict=True)) | more


def three_rows() -> list[dict]:
    return [row(i * 0.01, (0.1 * i, 0.2, 0.3), (1.0, 2.0 * i, 3.0)) for i in range(3)]


def factorial() -> list[dict]:
    return [row(i * 0.01, p, p) for i, p in enumerate(itertools.product((-1.0, 0.0, 1.0), repeat=3))]


def octagon(run: str, **more) -> list[dict]:
    out = []
    for k in range(8):
        a = 2 * math.pi * k / 8
        p = (math.cos(a), math.cos(2 * a) + 0.25 * math.sin(a), math.sin(a))
        out.append(row(k * 0.01, p, p, run_id=run) | more)
    return out


def four_runs() -> list[dict]:
    return [r for run in RUNS4 for r in octagon(run, configuration_id=run.split("_")[0])]


def split_runs(tests: int = 1, shift: float = 0.0) -> list[dict]:
    rows = [r for run in DEVELOPMENT for r in octagon(run)]
    for t in range(1, tests + 1):
        for r in octagon(f"test_{t:02d}"):
            rows.append(r | {f"{a}_ref": r[f"{a}_ref"] + shift * (t + i) for i, a in enumerate(AXES)})
    return rows


def task(**blocks) -> dict:
    out = copy.deepcopy(TASK)
    for k, v in blocks.items():
        out[k] = copy.deepcopy(v)
    if any(k in blocks for k in ("d4", "d5", "d6")):
        out["dataset_mapping"]["run_id_column"] = "run_id"
    if "d4" in blocks:
        out["dataset_mapping"]["configuration_id_column"] = "configuration_id"
    return out


def complete() -> dict:
    out = task(d2=D2, d3=D3, d4=D4, d5=D5, d6=D6, claim=CLAIM)
    out["d5"]["test_units"] = [f"test_{t:02d}" for t in range(1, 5)]
    return out


def write(folder: Path, rows: list[dict], declared: dict, sensor=SENSOR, reference=REFERENCE, setup=SETUP) -> tuple[Path, Path]:
    """(dataset, task) paths."""
    for name, document in (("sensor", sensor), ("reference", reference), ("setup", setup), ("task", declared)):
        (folder / f"{name}.yaml").write_text(yaml.safe_dump(document))
    with (folder / "data.csv").open("w", newline="") as f:
        w = csv.DictWriter(f, list(rows[0]))
        w.writeheader()
        w.writerows(rows)
    return folder / "data.csv", folder / "task.yaml"


def whole() -> dict:
    """A complete task that its rows (``split_runs(4, 0.01)``) pass."""
    out = complete()
    out["d2"]["maximum_fill_distance"] = 2.0
    out["d3"]["maximum_condition_number"] = 10.0
    runs = [*DEVELOPMENT, *[f"test_{t:02d}" for t in range(1, 5)]]
    out["d4"]["minimum_runs_per_configuration"] = {}
    out["d4"]["run_evidence"] = [D4["run_evidence"][0] | {"run_id": r, "acquisition_id": f"a-{r}"} for r in runs]
    out["assessment"] = {"criteria": {f"D{i}": {"applicable": True} for i in range(1, 7)} | {"D7": {"applicable": False, "reason": "no package yet"}}}
    return out


# --- scenarios --------------------------------------------------------------------------------------------------------
Case = tuple[str, str, Callable[[], tuple[list[dict], dict, dict]]]  # name, criterion, (rows, task, profiles)


def changed(document: dict, at: str, value: Any) -> dict:
    """A copy with one place (keys joined by dots) set; ``...`` takes the place away."""
    out = copy.deepcopy(document)
    *way, last = at.split(".")
    part = out
    for k in way:
        part = part[int(k) if isinstance(part, list) else k]
    last = int(last) if isinstance(part, list) else last
    if value is ...:
        del part[last]
    else:
        part[last] = value
    return out


def _rows(rows: list[dict], **at: Any) -> list[dict]:
    """Rows with cells changed: ``_3_c1=...`` sets column c1 of row 3."""
    out = copy.deepcopy(rows)
    for k, v in at.items():
        number, column = k[1:].split("_", 1)
        out[int(number)][column] = v
    return out


def _case(name: str, criterion: str, rows: Callable, task: Callable, **profiles: Callable) -> Case:
    return name, criterion, lambda: (rows(), task(), {k: v() for k, v in profiles.items()})


def _d6() -> dict:
    out = task(d2=D2, d3=D3, d5=D5, d6=D6)
    out["d5"]["test_units"] = [f"test_{t:02d}" for t in range(1, 5)]
    return out


def _same_inputs() -> list[dict]:
    return [x | {"c2": x["c1"], "c3": x["c1"]} for x in factorial()]


CASES: tuple[Case, ...] = (
    _case("complete", "D0", three_rows, complete),
    _case("bare", "D0", three_rows, task),
    _case("model_family", "D0", three_rows, lambda: changed(complete(), "claim.model_family", "quadratic")),
    _case("inputs", "D0", three_rows, lambda: changed(complete(), "claim.sensor_inputs", ["c1", "c2"])),
    _case("outputs", "D0", three_rows, lambda: changed(complete(), "claim.reference_outputs", ["Fx"])),
    _case("domain", "D0", three_rows, lambda: changed(complete(), "claim.operating_domain", ["Fx", "Fy", "Fy"])),
    _case("conditions", "D0", three_rows, lambda: changed(complete(), "claim.operating_conditions", ["heat"])),
    _case("metrics", "D0", three_rows, lambda: changed(complete(), "claim.performance_metrics", ["rmse"])),
    _case("unit_open", "D0", three_rows, lambda: changed(complete(), "claim.generalization.independent_unit", None)),
    _case("axis_open", "D0", three_rows, lambda: changed(complete(), "d2.domain.Fy.maximum", None)),
    _case("good", "D1", three_rows, task),
    _case("late", "D1", lambda: _rows(three_rows(), _1_reference_time_s=0.05), task),
    _case("high", "D1", lambda: _rows(three_rows(), _1_c2=12.0), task),
    _case("back", "D1", lambda: _rows(three_rows(), _2_sensor_time_s=0.005), task),
    _case("nan", "D1", lambda: _rows(three_rows(), _0_c1="nan"), task),
    _case("no_run", "D1", lambda: _rows(four_runs(), _3_run_id="  "), lambda: task(d4=D4)),
    _case("no_column", "D1", lambda: [{k: v for k, v in r.items() if k != "Fz_ref"} for r in three_rows()], task),
    _case("policy_open", "D1", three_rows, lambda: changed(task(), "d1.invalid_observation_policy_id", None)),
    _case("unreviewed", "D1", three_rows, lambda: changed(task(), "d1.exclusions_reviewed", False)),
    _case("uncertain", "D1", three_rows, task, reference=lambda: changed(REFERENCE, "channels.Fx.expanded_uncertainty", 0.1)),
    _case("mirrored", "D1", three_rows, task, setup=lambda: changed(SETUP, "reference_to_sensor_rotation.1", [1.0, 0.0, 0.0])),
    _case("unknown", "D1", three_rows, task, sensor=lambda: changed(SENSOR, "channels.c3", ...)),
    _case("grid", "D2", factorial, lambda: task(d2=D2)),
    _case("centre", "D2", lambda: [row(0.0, (0, 0, 0), (0, 0, 0))], lambda: task(d2=D2)),
    _case("gate", "D2", lambda: _rows(factorial(), _3_c1="x"), lambda: task(d2=D2)),
    _case("too_many", "D2", factorial, lambda: changed(task(d2=D2), "d2.domain.Fx.grid_points", 3_000_000)),
    _case("regions_open", "D2", factorial, lambda: changed(task(d2=D2), "d2.excluded_regions", None)),
    _case("region_unknown", "D2", factorial, lambda: changed(task(d2=D2), "d2.excluded_regions", [{"region_id": "r", "reason": "r", "continuous_bounds": {"Fq": {"minimum": 0.0}}}])),
    _case("condition_gone", "D2", factorial, lambda: changed(task(d2=D2), "d2.conditions", {"T": {"kind": "categorical", "source": "column", "column": "gone", "categories": ["a"]}})),
    _case("full_rank", "D3", factorial, lambda: task(d3=D3)),
    _case("same_inputs", "D3", _same_inputs, lambda: task(d3=D3)),
    _case("strict", "D3", factorial, lambda: changed(task(d3=D3), "d3.maximum_condition_number", 1.1)),
    _case("two_outputs", "D3", factorial, lambda: changed(task(d3=D3), "d3.output_dimension", 2)),
    _case("test_open", "D3", factorial, lambda: changed(task(d3=D3), "d3.model_specific_test_id", None)),
    _case("four", "D4", four_runs, lambda: task(d4=D4)),
    _case("five_asked", "D4", four_runs, lambda: changed(task(d4=D4), "d4.minimum_independent_runs", 5)),
    _case("spirals_asked", "D4", four_runs, lambda: changed(task(d4=D4), "d4.minimum_runs_per_configuration", {"spiral": 3})),
    _case("ess_asked", "D4", four_runs, lambda: changed(task(d4=D4), "d4.minimum_effective_sample_size", 1e6)),
    _case("drifting", "D4", four_runs, lambda: changed(task(d4=D4), "d4.stationarity_reviewed", False)),
    _case("shared_acquisition", "D4", four_runs, lambda: changed(task(d4=D4), "d4.run_evidence.1.acquisition_id", "acquisition_0")),
    _case("evidence_open", "D4", four_runs, lambda: changed(task(d4=D4), "d4.run_evidence.3", ...)),
    _case("two_configurations", "D4", lambda: _rows(four_runs(), _9_configuration_id="other"), lambda: task(d4=D4)),
    _case("flat", "D4", lambda: [x | {"c1": 1.0} if x["run_id"] == "spiral_01" else x for x in four_runs()], lambda: task(d4=D4)),
    _case("split", "D5", split_runs, lambda: task(d3=D3, d5=D5)),
    _case("overlap", "D5", split_runs, lambda: changed(task(d3=D3, d5=D5), "d5.test_units", ["test_01", "development_01"])),
    _case("no_test", "D5", split_runs, lambda: changed(task(d3=D3, d5=D5), "d5.test_units", [])),
    _case("unseen", "D5", split_runs, lambda: changed(task(d3=D3, d5=D5), "d5.test_units", ["test_01", "test_09"])),
    _case("unassigned", "D5", split_runs, lambda: changed(task(d3=D3, d5=D5), "d5.development_units", DEVELOPMENT[:2])),
    _case("not_frozen", "D5", split_runs, lambda: changed(task(d3=D3, d5=D5), "d5.split_frozen_before_development", False)),
    _case("leak", "D5", split_runs, lambda: changed(task(d3=D3, d5=D5), "d5.data_use.model_selection", "includes_test")),
    _case("fed_back", "D5", split_runs, lambda: changed(task(d3=D3, d5=D5), "d5.data_use.test_results_used_for_further_development", True)),
    _case("precise", "D6", lambda: split_runs(4, 0.01), _d6),
    _case("too_wide", "D6", lambda: split_runs(4, 0.01), lambda: changed(_d6(), "d6.axes.Fx.maximum_interval_half_width", 0.001)),
    _case("few_units", "D6", lambda: split_runs(4, 0.01), lambda: changed(_d6(), "d6.minimum_bootstrap_units", 5)),
    _case("thin_region", "D6", lambda: split_runs(4, 0.01), lambda: changed(_d6(), "d6.regions.0.dimensions", {"Fx": {"minimum": 10.0}})),
    _case("axes", "D6", lambda: split_runs(4, 0.01), lambda: changed(_d6(), "d6.axes.Fq", _d6()["d6"]["axes"]["Fx"])),
)


@contextlib.contextmanager
def folder():
    """A folder of the driver's own for a scenario's documents; Spark reads its rows from memory."""
    at = Path(tempfile.mkdtemp(prefix="gaugewright-scenario-"))
    try:
        yield at
    finally:
        shutil.rmtree(at, ignore_errors=True)


def observed(spark: SparkSession, rows: list[dict]):
    """Rows as text, in their order, as a CSV file would have them."""
    names = list(rows[0])
    table = [tuple(None if r[n] is None else str(r[n]) for n in names) for r in rows]
    return bound(spark.createDataFrame(table, ", ".join(f"`{n}` string" for n in names)).coalesce(1), "rows")


def outcome(spark: SparkSession, case: Case) -> CriterionResult:
    _, criterion, made = case
    rows, declared, profiles = made()
    with folder() as at:
        _, path = write(at, rows, declared, **profiles)
        return Assessment(observed(spark, rows), load_task_bundle(path), spark).result(criterion)


def outcomes(spark: SparkSession, criterion: str) -> DataFrame:
    """Per scenario: status, codes with their counts (in order of name), and what is missing."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "1")  # a few rows each
    out = []
    for case in CASES:
        if case[1] == criterion:
            r = outcome(own, case)
            codes = r.metrics.get("violations_by_code") or {}
            out.append((case[0], r.status.value, ",".join(f"{k}:{n}" for k, n in sorted(codes.items())), ",".join(r.missing_evidence)))
    return spark.createDataFrame(out, "case string, status string, codes string, missing string")


# --- provenance and register ------------------------------------------------------------------------------------------
_ROLES = {"data.csv": "raw_data", "task.yaml": "task_config", "sensor.yaml": "sensor_profile", "reference.yaml": "reference_profile", "setup.yaml": "setup_profile", "D0.json": "criterion_result", "D1.json": "criterion_result"}


def provenance_outcomes(spark: SparkSession) -> DataFrame:
    """An evidence package as it should be, and with one fault each: case, status, codes, missing. Data are read from CSV."""
    declared = whole() | {
        "d7": {
            "evidence_manifest_path": "manifest.yaml", "evidence_package_id": "package-1", "required_file_roles": ["raw_data"], "required_criterion_results": ["D0", "D1"],
            "numerical_absolute_tolerance": 1e-9, "numerical_relative_tolerance": 1e-9,
        }
    }
    out = []
    with folder() as at:
        data, path = write(at, split_runs(4, 0.01), declared)
        bundle = load_task_bundle(path)
        for c in ("D0", "D1"):
            (at / f"{c}.json").write_text(json.dumps(Assessment(data, bundle, spark).result(c).model_dump(mode="json")))

        def told(case: str, skip: tuple[str, ...] = (), after: Callable[[], None] = lambda: None, **change: Any) -> None:
            files = [{"path": p, "role": change.get("roles", {}).get(p, r), "sha256": hashlib.sha256((at / p).read_bytes()).hexdigest()} for p, r in _ROLES.items() if p not in skip]
            document = {"package_id": "package-1", "files": files, "software_commit": "0000000", "dependency_snapshot_id": "s", "preprocessing_procedure_id": "p", "exclusion_record_id": "e", "partition_manifest_id": "m", "random_seeds": {"d6.bootstrap": 7}, "criterion_results": {"D0": "D0.json", "D1": "D1.json"}}
            (at / "manifest.yaml").write_text(yaml.safe_dump(document | {k: v for k, v in change.items() if k != "roles"}))
            after()
            r = Assessment(data, bundle, spark).result("D7")
            out.append((case, r.status.value, ",".join(f"{k}:{n}" for k, n in sorted((r.metrics.get("violations_by_code") or {}).items())), ",".join(r.missing_evidence)))

        told("as_recorded")
        told("package", package_id="package-2")
        told("not_listed", skip=("D1.json",))
        told("other_role", roles={"sensor.yaml": "setup_profile"})
        told("seed", random_seeds={"d6.bootstrap": 8})
        told("seed_open", random_seeds={})
        told("result_open", criterion_results={"D1": "D1.json"})
        told("edited", after=lambda: (at / "setup.yaml").write_text((at / "setup.yaml").read_text() + "\n"))
        record = json.loads((at / "D1.json").read_text())
        (at / "D1.json").write_text(json.dumps(changed(record, "metrics.rows_evaluated", 1)))
        told("other_result")
        (at / "D1.json").write_text("{")
        told("no_json")
        told("gone", after=(at / "D0.json").unlink)
        (at / "manifest.yaml").unlink()
        r = Assessment(data, bundle, spark).result("D7")
        out.append(("no_manifest", r.status.value, "", ",".join(r.missing_evidence)))
    return spark.createDataFrame(out, "case string, status string, codes string, missing string")


_OPEN = ["task.claim", "task.d2", "task.d3", "task.d6", "task.d4", "task.d5"]


def register_outcomes(spark: SparkSession) -> DataFrame:
    """Registers against the bare task's open declarations: case, whether aligned, and what differs."""
    classes, stages = list(DeclarationClassification), list(DeclarationResolutionStage)
    out = []
    with folder() as at:
        _, path = write(at, three_rows(), task())
        bundle = load_task_bundle(path)

        def told(case: str, paths: list[str], **change: Any) -> None:
            entries = [{"path": p, "criterion": "D2", "classification": classes[i % 2].value, "resolution_stage": stages[i % 3].value, "decision_question": "q", "legitimate_source": "l"} for i, p in enumerate(paths)]
            document = {"register_id": "r", "task_id": "made_up_task", "task_config": "task.yaml", "expected_d0_status": "INDETERMINATE", "expected_missing_count": len(paths), "scope_note": "s", "entries": entries}
            a = audit_declaration_register(bundle, DeclarationRegister.model_validate(document | change))
            counts = a.classification_counts[classes[0].value], a.resolution_stage_counts[stages[0].value]
            out.append((case, a.aligned, a.order_matches, a.task_id_matches, a.actual_missing_count, ",".join(a.missing_from_register), ",".join(a.no_longer_missing), *counts))

        told("aligned", _OPEN)
        told("other_order", _OPEN[::-1])
        told("short", _OPEN[:-1])
        told("settled", [*_OPEN, "task.old"])
        told("other_task", _OPEN, task_id="another")
        told("other_count", _OPEN, expected_missing_count=9)
    return spark.createDataFrame(out, "case string, aligned boolean, order_matches boolean, task_id_matches boolean, n_missing int, unlisted string, settled string, n_first_class int, n_first_stage int")
