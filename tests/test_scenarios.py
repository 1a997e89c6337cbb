"""Every criterion over small made-up tasks, a complete one and some with one fault each."""

import pytest

from . import scenarios

_D = "INDETERMINATE"
#: What each scenario must give: case, status, codes with counts, what is missing.
_EXPECTED = {
    "D0": [
        ("complete", "PASS", "", ""), ("bare", _D, "", "task.claim,task.d2,task.d3,task.d6,task.d4,task.d5"), ("model_family", "FAIL", "model_family_mismatch:1", ""),
        ("inputs", "FAIL", "sensor_input_mismatch:1", ""), ("outputs", "FAIL", "reference_output_mismatch:1", ""), ("domain", "FAIL", "operating_domain_mismatch:1", ""),
        ("conditions", "FAIL", "operating_condition_mismatch:1", ""), ("metrics", "FAIL", "performance_requirement_mismatch:1", ""),
        ("unit_open", _D, "", "task.claim.generalization.independent_unit"), ("axis_open", _D, "", "task.d2.domain.Fy.maximum"),
    ],
    "D1": [
        ("good", "PASS", "", ""), ("late", "FAIL", "non_monotonic_timestamp:1,synchronization_exceeded:1", ""), ("high", "FAIL", "measurement_out_of_range:1", ""),
        ("back", "FAIL", "non_monotonic_timestamp:1,synchronization_exceeded:1", ""), ("nan", "FAIL", "invalid_numeric_value:1", ""), ("no_run", "FAIL", "invalid_run_id:1", ""),
        ("no_column", "FAIL", "missing_required_column:1", ""), ("policy_open", _D, "", "task.d1.invalid_observation_policy_id"), ("unreviewed", "FAIL", "exclusions_not_reviewed:1", ""),
        ("uncertain", "FAIL", "reference_uncertainty_exceeded:1", ""), ("mirrored", "FAIL", "invalid_coordinate_rotation:1", ""), ("unknown", "FAIL", "unknown_sensor_channel:1", ""),
    ],
    "D2": [
        ("grid", "PASS", "", ""), ("centre", "FAIL", "fill_distance_exceeded:1", ""), ("gate", _D, "", "prerequisite.D1_PASS"), ("too_many", _D, "", "task.d2.grid_within_software_limit"),
        ("regions_open", _D, "", "task.d2.excluded_regions"), ("region_unknown", "FAIL", "unknown_exclusion_dimension:1", ""), ("condition_gone", "FAIL", "missing_condition_column:1", ""),
    ],
    "D3": [
        ("full_rank", "PASS", "", ""), ("same_inputs", "FAIL", "condition_number_exceeded:1,rank_deficient:1", ""), ("strict", "FAIL", "condition_number_exceeded:1", ""),
        ("two_outputs", "FAIL", "output_dimension_mismatch:1", ""), ("test_open", _D, "", "task.d3.model_specific_test_id"),
    ],
    "D4": [
        ("four", "PASS", "", ""), ("five_asked", "FAIL", "minimum_independent_runs_not_met:1", ""), ("spirals_asked", "FAIL", "minimum_configuration_runs_not_met:1", ""),
        ("ess_asked", "FAIL", "minimum_effective_sample_size_not_met:1", ""), ("drifting", "FAIL", "stationarity_not_supported:1", ""),
        ("shared_acquisition", "FAIL", "duplicate_acquisition_id:1,minimum_configuration_runs_not_met:1,minimum_effective_sample_size_not_met:1,minimum_independent_runs_not_met:1", ""),
        ("evidence_open", _D, "", "task.d4.run_evidence.lissajous_02"), ("two_configurations", "FAIL", "multiple_configurations_per_run:1", ""), ("flat", "FAIL", "autocorrelation_undefined_constant_signal:1", ""),
    ],
    "D5": [
        ("split", "PASS", "", ""), ("overlap", "FAIL", "development_test_unit_overlap:1", ""), ("no_test", "FAIL", "empty_test_partition:1,minimum_test_units_not_met:1,observed_unit_not_partitioned:1", ""),
        ("unseen", "FAIL", "declared_unit_not_observed:1", ""), ("unassigned", "FAIL", "observed_unit_not_partitioned:1", ""), ("not_frozen", "FAIL", "split_not_frozen_before_development:1", ""),
        ("leak", "FAIL", "test_data_used_during_development:1", ""), ("fed_back", "FAIL", "test_results_fed_back_into_development:1", ""),
    ],
    "D6": [
        ("precise", "PASS", "", ""), ("too_wide", "FAIL", "metric_interval_too_wide:1", ""), ("few_units", "FAIL", "insufficient_independent_test_units_for_bootstrap:1", ""),
        ("thin_region", "FAIL", "insufficient_regional_test_units:1", ""), ("axes", "FAIL", "performance_axis_mismatch:1", ""),
    ],
    "D7": [
        ("as_recorded", "PASS", "", ""), ("package", "FAIL", "evidence_package_id_mismatch:1", ""), ("not_listed", "FAIL", "active_input_not_manifested:1", ""),
        ("other_role", "FAIL", "active_input_role_mismatch:1", ""), ("seed", "FAIL", "random_seed_mismatch:1", ""), ("seed_open", _D, "", "evidence.random_seeds.d6.bootstrap"),
        ("result_open", _D, "", "evidence.criterion_results.D0"), ("edited", "FAIL", "evidence_hash_mismatch:1", ""), ("other_result", "FAIL", "criterion_result_not_reproduced:1", ""),
        ("no_json", "FAIL", "criterion_result_unreadable:1", ""), ("gone", "FAIL", "criterion_result_unreadable:1,evidence_file_missing:1", ""), ("no_manifest", _D, "", "task.d7.evidence_manifest_path"),
    ],
}
_REGISTERS = [
    ("aligned", True, True, True, 6, "", "", 3, 2), ("other_order", True, False, True, 6, "", "", 3, 2), ("short", False, False, True, 6, "task.d5", "", 3, 2),
    ("settled", False, False, True, 6, "", "task.old", 4, 3), ("other_task", False, True, False, 6, "", "", 3, 2), ("other_count", False, True, True, 6, "", "", 3, 2),
]


@pytest.mark.parametrize("criterion", [c for c in _EXPECTED if c != "D7"])
def test_criterion(spark, criterion):
    got = {tuple(r) for r in scenarios.outcomes(spark, criterion).collect()}
    assert got == set(_EXPECTED[criterion])


def test_provenance(spark):
    assert {tuple(r) for r in scenarios.provenance_outcomes(spark).collect()} == set(_EXPECTED["D7"])


def test_registers(spark):
    assert {tuple(r) for r in scenarios.register_outcomes(spark).collect()} == set(_REGISTERS)
