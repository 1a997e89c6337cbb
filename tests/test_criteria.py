"""Criteria by scenario: a passing task, and one change at a time."""

from __future__ import annotations

import copy
import json
import math

import numpy as np
import pytest
import yaml

from gaugewright.plans.assessment import Assessment, evaluate_all, evaluate_d0, evaluate_d1, evaluate_d2, evaluate_d3, evaluate_d4, evaluate_d5, evaluate_d6, evaluate_d7
from gaugewright.sources.documents import load_task_bundle

from . import demo


@pytest.fixture
def run(spark, tmp_path):
    def go(evaluate, rows, task, **profiles):
        data, at = demo.write(tmp_path, rows, task, **profiles)
        return evaluate(data, load_task_bundle(at), spark)

    return go


def close(a, b):
    """JSON values that are equal but for the last bits of numbers."""
    if isinstance(a, dict):
        return isinstance(b, dict) and a.keys() == b.keys() and all(close(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(map(close, a, b))
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


def codes(result):
    return [v.code for v in result.violations]


# --- D1 -------------------------------------------------------------------------------------------------------------
def test_d1_passes(run):
    r = run(evaluate_d1, demo.three_rows(), demo.task())
    assert r.status == "PASS", r
    assert (r.metrics["rows_evaluated"], r.metrics["invalid_rows"]) == (3, 0)
    assert r.metrics["maximum_absolute_time_offset_s"] == pytest.approx(0.001)


@pytest.mark.parametrize(
    ("row", "column", "value", "code"),
    [
        (1, "reference_time_s", 0.05, "synchronization_exceeded"), (1, "c2", 12.0, "measurement_out_of_range"), (1, "c2", "-10.5", "measurement_out_of_range"),
        (2, "sensor_time_s", 0.005, "non_monotonic_timestamp"), (0, "c1", "nan", "invalid_numeric_value"), (0, "c1", "1e400", "invalid_numeric_value"),
        (0, "Fx_ref", "", "invalid_numeric_value"), (0, "Fx_ref", "1.0d", "invalid_numeric_value"),
    ],
)
def test_d1_row_violations(run, row, column, value, code):
    rows = demo.three_rows()
    rows[row][column] = value
    r = run(evaluate_d1, rows, demo.task())
    assert r.status == "FAIL"
    assert code in codes(r)
    v = next(v for v in r.violations if v.code == code)
    assert v.row_number == row + 2
    assert r.metrics["invalid_rows"] >= 1
    if code == "invalid_numeric_value":
        assert v.observed == value


def test_d1_reads_python_numbers(run):
    rows = demo.three_rows()
    rows[0]["c1"], rows[1]["c1"] = " 1_0e-1 ", "+.5"
    assert run(evaluate_d1, rows, demo.task()).status == "PASS"


def test_d1_previous_is_the_last_finite_time(run):
    rows = demo.three_rows()
    rows[1]["sensor_time_s"] = "x"
    rows[2]["sensor_time_s"] = -1
    r = run(evaluate_d1, rows, demo.task())
    assert r.metrics["violations_by_code"]["non_monotonic_timestamp"] == 1


def test_d1_declarations(run):
    task = demo.task()
    task["d1"]["invalid_observation_policy_id"] = None
    r = run(evaluate_d1, demo.three_rows(), task)
    assert (r.status, r.missing_evidence) == ("INDETERMINATE", ["task.d1.invalid_observation_policy_id"])
    task["d1"]["exclusions_reviewed"] = False
    assert codes(run(evaluate_d1, demo.three_rows(), task)) == ["exclusions_not_reviewed"]
    reference, setup = copy.deepcopy(demo.REFERENCE), copy.deepcopy(demo.SETUP)
    reference["channels"]["Fx"]["expanded_uncertainty"] = 0.1
    setup["reference_to_sensor_rotation"][1] = [1.0, 0.0, 0.0]
    r = run(evaluate_d1, demo.three_rows(), demo.task(), reference=reference, setup=setup)
    assert codes(r) == ["reference_uncertainty_exceeded", "invalid_coordinate_rotation"]


def test_d1_columns(run, spark, tmp_path):
    rows = [{k: v for k, v in r.items() if k != "Fz_ref"} for r in demo.three_rows()]
    r = run(evaluate_d1, rows, demo.task())
    assert codes(r) == ["missing_required_column"] and r.metrics["rows_evaluated"] == 0
    data, at = demo.write(tmp_path, demo.three_rows(), demo.task())
    lines = data.read_text().splitlines()
    data.write_text("\n".join([lines[0] + ",c1", "", *[line + ",99" for line in lines[1:]]]) + "\n")
    r = evaluate_d1(data, load_task_bundle(at), spark)
    assert r.metrics["violations_by_code"] == {"duplicate_columns": 1, "measurement_out_of_range": 3}
    assert [v.row_number for v in r.violations] == [None, 2, 3, 4]
    data.write_text(lines[0] + "\n")
    assert codes(evaluate_d1(data, load_task_bundle(at), spark)) == ["empty_dataset"]
    assert codes(evaluate_d1(tmp_path / "none.csv", load_task_bundle(at), spark)) == ["dataset_unreadable"]


def test_d1_lists_fifty_and_counts_all(run):
    rows = [demo.row(i * 0.01, (20, 0, 0), (0, 0, 0)) for i in range(80)]
    r = run(evaluate_d1, rows, demo.task())
    assert r.metrics["total_violations"] == 80
    assert [v.row_number for v in r.violations] == list(range(2, 52))


def test_d1_runs_restart_time(run):
    task = demo.task(d4=demo.D4)
    r = run(evaluate_d1, demo.four_runs(), task)
    assert (r.status, r.metrics["rows_evaluated"]) == ("PASS", 32)
    rows = demo.four_runs()
    rows[3]["run_id"] = "  "
    assert codes(run(evaluate_d1, rows, task)) == ["invalid_run_id"]


# --- D2 -------------------------------------------------------------------------------------------------------------
def test_d2_full_grid(run):
    r = run(evaluate_d2, demo.factorial(), demo.task(d2=demo.D2))
    assert (r.status, r.metrics["estimated_fill_distance"], r.metrics["grid_point_count"]) == ("PASS", 0.0, 27)
    assert r.metrics["samples_inside_claim_domain"] == 27


def test_d2_centre_only(run):
    r = run(evaluate_d2, [demo.row(0.0, (0, 0, 0), (0, 0, 0))], demo.task(d2=demo.D2))
    assert r.status == "FAIL" and codes(r) == ["fill_distance_exceeded"]
    assert r.metrics["estimated_fill_distance"] == pytest.approx(math.sqrt(3) / 2)
    assert r.metrics["worst_covered_domain_point"] == {a: -1.0 for a in demo.AXES}


def test_d2_rotation_and_gates(run):
    setup = copy.deepcopy(demo.SETUP)
    setup["reference_to_sensor_rotation"] = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    r = run(evaluate_d2, [demo.row(0.0, (0, 0, 0), (1, 0, 0))], demo.task(d2=demo.D2), setup=setup)
    assert r.metrics["achieved_minimum"] == {"Fx": 0.0, "Fy": 1.0, "Fz": 0.0}
    bad = demo.factorial()
    bad[3]["c1"] = "x"
    r = run(evaluate_d2, bad, demo.task(d2=demo.D2))
    assert (r.status, r.missing_evidence) == ("INDETERMINATE", ["prerequisite.D1_PASS"])
    d2 = copy.deepcopy(demo.D2)
    d2["domain"]["Fx"]["grid_points"] = 3_000_000
    assert run(evaluate_d2, demo.factorial(), demo.task(d2=d2)).missing_evidence == ["task.d2.grid_within_software_limit"]
    d2 = copy.deepcopy(demo.D2)
    d2["excluded_regions"] = None
    assert run(evaluate_d2, demo.factorial(), demo.task(d2=d2)).missing_evidence == ["task.d2.excluded_regions"]


def test_d2_strata(run):
    d2 = copy.deepcopy(demo.D2)
    d2["conditions"] = {"band": {"kind": "categorical", "source": "column", "column": "band", "categories": ["cold", "hot"]}}
    rows = [r | {"band": b} for b in ("cold", "hot") for r in demo.factorial()]
    for i, r in enumerate(rows):
        r["sensor_time_s"], r["reference_time_s"] = i * 0.01, i * 0.01
    r = run(evaluate_d2, rows, demo.task(d2=d2))
    assert (r.status, r.metrics["grid_point_count"]) == ("PASS", 54)
    assert list(r.metrics["strata"]) == ["band=cold", "band=hot"]
    r = run(evaluate_d2, rows[:27], demo.task(d2=d2))
    assert r.status == "FAIL" and math.isinf(r.metrics["estimated_fill_distance"])
    d2["excluded_regions"] = [{"region_id": "hot", "reason": "not claimed", "categorical_values": {"band": ["hot"]}}]
    r = run(evaluate_d2, rows[:27], demo.task(d2=d2))
    assert (r.status, r.metrics["excluded_grid_point_count"]) == ("PASS", 27)
    d2["excluded_regions"][0]["continuous_bounds"] = {"Fq": {"minimum": 0.0}}
    assert codes(run(evaluate_d2, rows[:27], demo.task(d2=d2))) == ["unknown_exclusion_dimension"]


def test_d2_distances_match_brute_force(run, spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.uniform(-1, 0.1, (40, 3)), rng.uniform(-1.4, 1.4, (6, 3))])
    d2 = copy.deepcopy(demo.D2)
    for a, n in zip(demo.AXES, (5, 7, 4), strict=True):
        d2["domain"][a]["grid_points"] = n
    r = run(evaluate_d2, [demo.row(i * 0.01, (0, 0, 0), p) for i, p in enumerate(points)], demo.task(d2=d2))
    grid = np.stack(np.meshgrid(*[np.arange(n) / (n - 1) for n in (5, 7, 4)], indexing="ij"), -1).reshape(-1, 3)
    far = np.sqrt(((grid[:, None] - ((points + 1) / 2)[None]) ** 2).sum(2)).min(1)
    assert r.metrics["estimated_fill_distance"] == pytest.approx(far.max(), rel=1e-12)
    assert list(r.metrics["worst_covered_domain_point"].values()) == pytest.approx(list(-1 + 2 * grid[far.argmax()]))


# --- D3 -------------------------------------------------------------------------------------------------------------
def test_d3(run):
    r = run(evaluate_d3, demo.factorial(), demo.task(d3=demo.D3))
    assert r.status == "PASS"
    assert (r.metrics["design_matrix_rank"], r.metrics["sensitivity_matrix_rank"]) == (4, 12)
    assert r.metrics["condition_number"] == pytest.approx(math.sqrt(1.5))
    same = [x | {"c2": x["c1"], "c3": x["c1"]} for x in demo.factorial()]
    r = run(evaluate_d3, same, demo.task(d3=demo.D3))
    assert codes(r) == ["rank_deficient", "condition_number_exceeded"] and r.violations[1].observed == "Infinity"
    close = [x | {"c3": x["c1"] + 1e-6 * x["c3"]} for x in demo.factorial()]
    r = run(evaluate_d3, close, demo.task(d3=demo.D3))
    assert r.metrics["design_matrix_rank"] == 4 and codes(r) == ["condition_number_exceeded"]
    d3 = demo.D3 | {"output_dimension": 2}
    assert codes(run(evaluate_d3, demo.factorial(), demo.task(d3=d3))) == ["output_dimension_mismatch"]
    few = run(evaluate_d3, demo.factorial()[:2], demo.task(d3=demo.D3))
    assert few.metrics["singular_values"][2:] == [0.0, 0.0] and few.metrics["weakest_feature_direction"] == {}


# --- D4 -------------------------------------------------------------------------------------------------------------
def brute_ess(values, lag):
    c = np.asarray(values) - np.mean(values)
    rho = [float(c[:-k] @ c[k:] / (c @ c)) for k in range(1, lag + 1)]
    return len(c) / (1 + 2 * sum(rho))


def test_d4(run):
    r = run(evaluate_d4, demo.four_runs(), demo.task(d4=demo.D4))
    assert r.status == "PASS", r.summary
    assert r.metrics["configuration_run_counts"] == {"lissajous": 2, "spiral": 2}
    one = demo.octagon("x")
    for c in demo.INPUTS:
        assert r.metrics["effective_sample_sizes"][f"sensor.{c}"] == pytest.approx(4 * brute_ess([x[c] for x in one], 1))
    assert r.metrics["limiting_signal"] == "sensor.c3"  # reference.Fz has the same, and is declared later


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"minimum_independent_runs": 5}, "minimum_independent_runs_not_met"), ({"minimum_runs_per_configuration": {"spiral": 3}}, "minimum_configuration_runs_not_met"),
        ({"minimum_effective_sample_size": 1e6}, "minimum_effective_sample_size_not_met"), ({"stationarity_reviewed": False}, "stationarity_not_supported"),
    ],
)
def test_d4_minima(run, change, code):
    r = run(evaluate_d4, demo.four_runs(), demo.task(d4=demo.D4 | change))
    assert (r.status, codes(r)) == ("FAIL", [code])


def test_d4_evidence(run):
    d4 = copy.deepcopy(demo.D4)
    d4["run_evidence"][1]["acquisition_id"] = "acquisition_0"
    r = run(evaluate_d4, demo.four_runs(), demo.task(d4=d4))
    assert codes(r)[0] == "duplicate_acquisition_id"
    d4 = copy.deepcopy(demo.D4)
    d4["run_evidence"].pop()
    r = run(evaluate_d4, demo.four_runs(), demo.task(d4=d4))
    assert (r.status, r.metrics["maximum_possible_independent_run_count"]) == ("INDETERMINATE", 4)
    rows = demo.four_runs()
    rows[9]["configuration_id"] = "other"
    r = run(evaluate_d4, rows, demo.task(d4=demo.D4))
    assert codes(r) == ["multiple_configurations_per_run"] and r.violations[0].row_number == 11
    flat = [x | {"c1": 1.0} if x["run_id"] == "spiral_01" else x for x in demo.four_runs()]
    assert codes(run(evaluate_d4, flat, demo.task(d4=demo.D4))) == ["autocorrelation_undefined_constant_signal"]
    mixed = sorted(demo.four_runs(), key=lambda x: x["sensor_time_s"])
    assert run(evaluate_d4, mixed, demo.task(d4=demo.D4)).status == "PASS"


# --- D5, D6 ---------------------------------------------------------------------------------------------------------
def test_d5(run):
    task = demo.task(d3=demo.D3, d5=demo.D5)
    r = run(evaluate_d5, demo.split_runs(), task)
    assert r.status == "PASS", r
    assert (r.metrics["development_sample_count"], r.metrics["test_sample_count"], r.metrics["development_design_rank"]) == (24, 8, 4)
    assert list(r.metrics["test_rmse"].values()) == pytest.approx([0, 0, 0], abs=1e-12)
    shifted = [x | {f"{a}_ref": x[f"{a}_ref"] + 5 for a in demo.AXES} if x["run_id"] == "test_01" else x for x in demo.split_runs()]
    r = run(evaluate_d5, shifted, task)
    assert r.status == "PASS" and list(r.metrics["test_rmse"].values()) == pytest.approx([5, 5, 5])
    assert np.array(r.metrics["estimated_sensitivity_matrix"]) == pytest.approx(np.eye(3), abs=1e-12)


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"test_units": ["test_01", "development_01"]}, "development_test_unit_overlap"), ({"test_units": []}, "empty_test_partition"),
        ({"test_units": ["test_01", "test_09"]}, "declared_unit_not_observed"), ({"minimum_test_units": 2}, "minimum_test_units_not_met"),
        ({"split_frozen_before_development": False}, "split_not_frozen_before_development"), ({"development_units": demo.DEVELOPMENT[:2]}, "observed_unit_not_partitioned"),
        ({"data_use": demo.D5["data_use"] | {"model_selection": "includes_test"}}, "test_data_used_during_development"),
        ({"data_use": demo.D5["data_use"] | {"test_results_used_for_further_development": True}}, "test_results_fed_back_into_development"),
    ],
)
def test_d5_protocol(run, change, code):
    r = run(evaluate_d5, demo.split_runs(), demo.task(d3=demo.D3, d5=demo.D5 | change))
    assert r.status == "FAIL" and code in codes(r) and "test_rmse" not in r.metrics


def d6_task(**change):
    task = demo.task(d2=demo.D2, d3=demo.D3, d5=demo.D5, d6=demo.D6)
    task["d5"]["test_units"] = [f"test_{t:02d}" for t in range(1, 5)]
    task["d6"].update(change)
    return task


def test_d6_matches_brute_force(run):
    r = run(evaluate_d6, demo.split_runs(4, 0.01), d6_task())
    assert (r.status, r.metrics["calibration_acceptance_status"]) == ("PASS", "PASS"), r
    for i, a in enumerate(demo.AXES):
        errors = np.array([0.01 * (t + i) for t in range(1, 5)])
        rng = np.random.default_rng(7)
        reps = [math.sqrt(np.mean(errors[rng.integers(0, 4, 4)] ** 2)) for _ in range(500)]
        span = r.metrics["axes"][a]["confidence_interval"]
        assert (span["lower"], span["upper"]) == pytest.approx(tuple(np.quantile(reps, [0.025, 0.975])), rel=1e-9)
        assert r.metrics["axes"][a]["rmse_estimate"] == pytest.approx(math.sqrt(np.mean(errors**2)))
    assert r.metrics["regions"]["positive_x"]["supporting_test_unit_count"] == 4


def test_d6_verdicts(run):
    task = d6_task()
    task["d6"]["axes"]["Fx"]["maximum_interval_half_width"] = 0.001
    assert codes(run(evaluate_d6, demo.split_runs(4, 0.01), task)) == ["metric_interval_too_wide"]
    task = d6_task()
    task["d6"]["axes"]["Fz"]["calibrated_force_uncertainty"] = 0.10
    r = run(evaluate_d6, demo.split_runs(4, 0.01), task)
    assert (r.status, r.metrics["calibration_acceptance_status"]) == ("PASS", "FAIL")
    assert codes(run(evaluate_d6, demo.split_runs(4, 0.01), d6_task(minimum_bootstrap_units=5))) == ["insufficient_independent_test_units_for_bootstrap"]
    task = d6_task()
    task["d6"]["regions"][0]["dimensions"] = {"Fx": {"minimum": 10.0}}
    r = run(evaluate_d6, demo.split_runs(4, 0.01), task)
    assert codes(r) == ["insufficient_regional_test_units"] and r.metrics["calibration_acceptance_status"] == "INDETERMINATE"
    r = run(evaluate_d6, demo.split_runs(1), demo.task(d3=demo.D3, d5=demo.D5 | {"split_frozen_before_development": False}, d6=demo.D6))
    assert r.missing_evidence == ["prerequisite.D5_PASS"]


# --- D0, D7, roll-up ------------------------------------------------------------------------------------------------
def test_d0(tmp_path):
    _, at = demo.write(tmp_path, demo.three_rows(), demo.complete())
    assert evaluate_d0(load_task_bundle(at)).status == "PASS"
    task = demo.complete()
    task["claim"]["model_family"] = "quadratic"
    _, at = demo.write(tmp_path, demo.three_rows(), task)
    r = evaluate_d0(load_task_bundle(at))
    assert (r.status, codes(r)) == ("FAIL", ["model_family_mismatch"])
    _, at = demo.write(tmp_path, demo.three_rows(), demo.task())
    assert evaluate_d0(load_task_bundle(at)).missing_evidence == ["task.claim", "task.d2", "task.d3", "task.d6", "task.d4", "task.d5"]


def whole_task():
    task = demo.complete()
    task["d2"]["maximum_fill_distance"] = 2.0
    runs = [*demo.DEVELOPMENT, *[f"test_{t:02d}" for t in range(1, 5)]]
    task["d4"]["minimum_runs_per_configuration"] = {}
    task["d4"]["run_evidence"] = [demo.D4["run_evidence"][0] | {"run_id": r, "acquisition_id": f"a-{r}"} for r in runs]
    task["d3"]["maximum_condition_number"] = 10.0
    task["assessment"] = {"criteria": {f"D{i}": {"applicable": True} for i in range(1, 7)} | {"D7": {"applicable": False, "reason": "no package yet"}}}
    return task


def test_roll_up(run, spark, tmp_path):
    r = run(evaluate_all, demo.split_runs(4, 0.01), whole_task())
    assert (r.status, r.calibration_acceptance_status) == ("PASS", "PASS"), {k: (v.status, v.summary) for k, v in r.criteria.items()}
    assert r.criteria["D7"].status == "NOT_APPLICABLE"
    task = whole_task()
    del task["assessment"]["criteria"]["D7"]
    r = run(evaluate_all, demo.split_runs(4, 0.01), task)
    assert (r.status, r.missing_evidence) == ("INDETERMINATE", ["task.assessment.criteria.D7"])


def test_d7(run, spark, tmp_path):
    import hashlib

    task = whole_task()
    task["d7"] = {
        "evidence_manifest_path": "manifest.yaml", "evidence_package_id": "package-1", "required_file_roles": ["raw_data"], "required_criterion_results": ["D1", "D6"],
        "numerical_absolute_tolerance": 1e-9, "numerical_relative_tolerance": 1e-9,
    }
    data, at = demo.write(tmp_path, demo.split_runs(4, 0.01), task)
    bundle = load_task_bundle(at)
    a = Assessment(data, bundle, spark)
    for c in ("D1", "D6"):
        (tmp_path / f"{c}.json").write_text(json.dumps(a.result(c).model_dump(mode="json")))
    roles = {"data.csv": "raw_data", "task.yaml": "task_config", "sensor.yaml": "sensor_profile", "reference.yaml": "reference_profile", "setup.yaml": "setup_profile", "D1.json": "criterion_result", "D6.json": "criterion_result"}

    def manifest(skip=()):
        files = [{"path": p, "role": r, "sha256": hashlib.sha256((tmp_path / p).read_bytes()).hexdigest()} for p, r in roles.items() if p not in skip]
        document = {"package_id": "package-1", "files": files, "software_commit": "0000000", "dependency_snapshot_id": "s", "preprocessing_procedure_id": "p", "exclusion_record_id": "e", "partition_manifest_id": "m", "random_seeds": {"d6.bootstrap": 7}, "criterion_results": {"D1": "D1.json", "D6": "D6.json"}}
        (tmp_path / "manifest.yaml").write_text(yaml.safe_dump(document))

    manifest()
    r = evaluate_d7(data, bundle, spark)
    assert r.status == "PASS", r.violations
    manifest(skip=("D6.json",))
    assert codes(evaluate_d7(data, bundle, spark)) == ["active_input_not_manifested"]
    manifest()
    with (tmp_path / "setup.yaml").open("a") as f:
        f.write("\n")
    assert codes(evaluate_d7(data, bundle, spark)) == ["evidence_hash_mismatch"]
    changed = json.loads((tmp_path / "D1.json").read_text())
    changed["metrics"]["rows_evaluated"] += 1
    (tmp_path / "D1.json").write_text(json.dumps(changed))
    manifest()
    r = evaluate_d7(data, bundle, spark)
    assert codes(r) == ["criterion_result_not_reproduced"] and r.violations[0].observed == ["D1.metrics.rows_evaluated"]


def test_partition_count_does_not_matter(spark, tmp_path):
    data, at = demo.write(tmp_path, demo.split_runs(4, 0.01), whole_task())
    bundle = load_task_bundle(at)
    df = spark.read.csv(str(data), header=True)
    order = ["run_id", "sensor_time_s"]
    from gaugewright.sources.observations import bound

    results = [Assessment(bound(df.repartition(n), "x", order), bundle, spark).overall() for n in (1, 7)]
    for c in results[0].criteria:
        one, other = (r.criteria[c].model_dump(mode="json") for r in results)
        assert close(one["metrics"], other["metrics"]), c
        assert one["status"] == other["status"]


def test_row_numbers_of_dataframes(spark, tmp_path):
    from gaugewright.sources.observations import bound, read

    rows = demo.four_runs()
    rows[20]["c1"] = rows[5]["Fx_ref"] = 99.0
    data, at = demo.write(tmp_path, rows, demo.task(d4=demo.D4))
    bundle = load_task_bundle(at)
    ordered = spark.createDataFrame([r | {"place": i, "Fx_ref": float(r["Fx_ref"]), "c1": float(r["c1"])} for i, r in enumerate(rows)])
    whole = spark.read.csv(str(data), header=True)
    whole.coalesce(1).write.parquet(str(tmp_path / "data.parquet"))
    for d in (data, bound(ordered.repartition(5), "x", ["place"]), whole, read(spark, tmp_path / "data.parquet"), read(spark, data)):
        r = Assessment(d, bundle, spark).result("D1")
        assert [(v.code, v.row_number) for v in r.violations] == [("measurement_out_of_range", 7), ("measurement_out_of_range", 22)]
        assert Assessment(d, bundle, spark).result("D2").status == "INDETERMINATE"


def test_d4_does_not_depend_on_blocks(spark, tmp_path):
    """Runs that lie in several files, some with fewer rows than a lag."""
    d4 = demo.D4 | {"signals": [s | {"maximum_autocorrelation_lag": 3} for s in demo.D4["signals"]], "minimum_effective_sample_size": 0.1}
    rng = np.random.default_rng(11)
    names = [*demo.INPUTS, *(f"{a}_ref" for a in demo.AXES)]
    rows = [r | dict(zip(names, map(float, x), strict=True)) for r, x in zip(demo.four_runs(), np.cumsum(rng.uniform(-0.3, 0.3, (32, 6)), 0), strict=True)]
    data, at = demo.write(tmp_path, rows, demo.task(d4=d4))
    whole = spark.read.csv(str(data), header=True).toPandas()
    (tmp_path / "parts").mkdir()
    for i, (a, b) in enumerate(((0, 3), (3, 5), (5, 6), (6, 20), (20, 32))):
        whole.iloc[a:b].to_csv(tmp_path / "parts" / f"part-{i}.csv", index=False)
    one, many = (Assessment(d, load_task_bundle(at), spark).result("D4") for d in (data, tmp_path / "parts"))
    for k, told in one.metrics["signals"].items():
        source, channel = k.split(".")
        for run_id, mine in told["per_run"].items():
            assert many.metrics["signals"][k]["per_run"][run_id]["autocorrelations"] == pytest.approx(mine["autocorrelations"], rel=1e-9)
            values = [r[channel if source == "sensor" else f"{channel}_ref"] for r in rows if r["run_id"] == run_id]
            assert mine["effective_sample_size"] == pytest.approx(brute_ess(values, 3))
    assert codes(one) == codes(many) and sum(len(t["per_run"]) for t in one.metrics["signals"].values()) > 10


def test_d2_continuous_conditions(run):
    d2 = copy.deepcopy(demo.D2)
    d2["conditions"] = {"T": {"kind": "continuous", "source": "column", "column": "temp", "unit": "C", "minimum": 0.0, "maximum": 10.0, "grid_points": 2}, "rig": {"kind": "fixed", "source": "constant", "constant": 1.0, "claimed_value": 1.0}}
    rows = [r | {"temp": t} for t in (0, 10) for r in demo.factorial()]
    for i, r in enumerate(rows):
        r["sensor_time_s"], r["reference_time_s"] = i * 0.01, i * 0.01
    r = run(evaluate_d2, rows, demo.task(d2=d2))
    assert (r.status, r.metrics["grid_shape"], list(r.metrics["strata"])) == ("PASS", [3, 3, 3, 2], ["rig=1.0"])
    rows[7]["temp"] = "warm"
    assert codes(run(evaluate_d2, rows, demo.task(d2=d2))) == ["invalid_condition_value"]
    d2["conditions"]["T"]["column"] = "gone"
    assert codes(run(evaluate_d2, rows, demo.task(d2=d2))) == ["missing_condition_column"]


def test_d4_without_its_configuration_column(run):
    rows = [{k: v for k, v in r.items() if k != "configuration_id"} for r in demo.four_runs()]
    r = run(evaluate_d4, rows, demo.task(d4=demo.D4))
    assert r.metrics["violations_by_code"] == {"declared_run_not_observed": 4, "minimum_configuration_runs_not_met": 2, "minimum_effective_sample_size_not_met": 1, "minimum_independent_runs_not_met": 1, "missing_required_column": 1}
    assert (r.metrics["rows_evaluated"], r.metrics["limiting_signal"], r.metrics["minimum_effective_sample_size_observed"]) == (0, "sensor.c1", 0.0)


def test_rows_are_read_a_bounded_number_of_times(spark, tmp_path):
    """All criteria over one DataFrame: what each reads in one pass is one pass."""
    _, at = demo.write(tmp_path, demo.split_runs(4, 0.01), whole_task())
    rows = [{k: float(v) if isinstance(v, int | float) else v for k, v in r.items()} for r in demo.split_runs(4, 0.01)]
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows).coalesce(1)
    result = Assessment(df.mapInArrow(through, df.schema), load_task_bundle(at), spark)
    passes = {}
    for c in ("D1", "D2", "D3", "D4", "D5", "D6"):
        before = read.value
        assert result.result(c).status == "PASS", c
        passes[c] = (read.value - before) / len(rows)
    assert passes["D1"] <= 2 and passes["D2"] <= 4 and passes["D3"] <= 2 and passes["D4"] <= 10 and passes["D5"] <= 3 and passes["D6"] <= 1, passes
