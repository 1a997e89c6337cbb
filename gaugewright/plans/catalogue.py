"""Queries of the calibration operators over the driver's tables, and the same in SQL.

The tables hold no calibration data, so roles are bound to their columns by a task's mapping, as for any dataset:

* E, ``events``: runs are users, configurations event types; the sensor's clock is ``ts`` (set back at every eleventh
  event), the reference's is off by some milliseconds; the sensor reads ``value``, the reference half of it and one.
* C, ``events`` again, with event types as runs and the event's key as time.
* L, ``lineitem``: runs are line numbers (1 to 4 develop, 5 to 7 test), strata return flag and line status; inputs are
  quantity, discount and tax, the output is the discounted price.

Each query is built from the operators' own functions and returns a lazy DataFrame wherever nothing small has to be known
before (a fitted model, a split).
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..declarations import (
    AssessmentRequirements,
    CalibrationClaim,
    D2ExcludedRegion,
    DeclarationClassification,
    DeclarationResolutionStage,
    InstrumentProfile,
    SetupProfile,
    TaskBundle,
    TaskConfig,
)
from ..functions.draws import times
from ..functions.linalg import factor
from ..operators import coverage, holdout, identifiability, performance, provenance, replication, validity
from ..results import CriterionResult
from ..sources.observations import Observations, bound
from ..sources.shared import place_for, removed
from . import sweep
from .assessment import Assessment, evaluate_d1, evaluate_d2, evaluate_d3, evaluate_d4, evaluate_d5, evaluate_d6

ROUND = 6
DEVELOPMENT, TEST = ["1", "2", "3", "4"], ["5", "6", "7"]
SEED, REPETITIONS = 20, 200
IDENTITY3 = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
TURN = [[0.6, -0.8, 0.0], [0.8, 0.6, 0.0], [0.0, 0.0, 1.0]]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _bundle(task: dict, sensor: dict, reference: dict, setup: dict) -> TaskBundle:
    profile = lambda kind, channels: InstrumentProfile(instrument_id=kind, kind=kind, channels=channels, calibration_certificate_id="certificate")
    declared = TaskConfig(profiles={"sensor": "sensor.yaml", "reference": "reference.yaml", "setup": "setup.yaml"}, **task)
    rig = {"setup_id": "tables", "maximum_time_offset_s": 0.0025, "sensor_acquisition_bandwidth_hz": 1.0, "reference_acquisition_bandwidth_hz": 1.0, "sampling_process_id": "as-stored"}
    return TaskBundle(task_path="/task.yaml", task=declared, sensor=profile("sensor", sensor), reference=profile("reference", reference), setup=SetupProfile(**rig | setup))


_D1 = {"invalid_observation_policy_id": "keep", "exclusion_record_id": "none", "exclusions_reviewed": True}


# --- E ---------------------------------------------------------------------------------------------------------------
def events(spark: SparkSession, sf_dir: str) -> Observations:
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / F.lit(1e6)
    df = _table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value",
        (t - F.when(F.col("event_id") % 11 == 0, F.lit(86400.0 * 40)).otherwise(0.0)).alias("sensor_t"),
        (t - F.when(F.col("event_id") % 11 == 0, F.lit(86400.0 * 40)).otherwise(0.0) + (F.col("event_id") % 7 - 3) * F.lit(0.001)).alias("reference_t"),
        (F.col("value") * 0.5 + 1.0).alias("force"),
    )
    return bound(df, "events", ["event_id"])


def events_bundle() -> TaskBundle:
    task = {
        "task_id": "events",
        "dataset_mapping": {"sensor_timestamp_column": "sensor_t", "reference_timestamp_column": "reference_t", "run_id_column": "user_id", "configuration_id_column": "event_type", "sensor_channels": {"v": "value"}, "reference_channels": {"F": "force"}},
        "d1": {"maximum_reference_uncertainty": {"F": 0.1}, **_D1},
    }
    return _bundle(task, {"v": {"unit": "u", "valid_min": 5.0, "valid_max": 480.0}}, {"F": {"unit": "N", "valid_min": 2.0, "valid_max": 200.0, "expanded_uncertainty": 0.05}}, {"reference_to_sensor_rotation": [[1.0]]})


_EVENTS = """
e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS run, event_type, value, value * 0.5 + 1.0 AS force,
             epoch_us(ts) / 1e6 - CASE WHEN event_id % 11 = 0 THEN 86400.0 * 40 ELSE 0.0 END AS s,
             epoch_us(ts) / 1e6 - CASE WHEN event_id % 11 = 0 THEN 86400.0 * 40 ELSE 0.0 END + (event_id % 7 - 3) * CAST(0.001 AS DOUBLE) AS r FROM events),
w AS (SELECT *, lag(s) OVER o AS s0, lag(r) OVER o AS r0 FROM e WINDOW o AS (PARTITION BY run ORDER BY event_id)),
v AS (SELECT event_id, x.* FROM w, LATERAL (VALUES (3, 'non_monotonic_timestamp', s <= s0), (4, 'non_monotonic_timestamp', r <= r0),
        (5, 'synchronization_exceeded', abs(s - r) > 0.0025), (7, 'measurement_out_of_range', value < 5), (8, 'measurement_out_of_range', value > 480),
        (10, 'measurement_out_of_range', force < 2), (11, 'measurement_out_of_range', force > 200)) x(seq, code, hit) WHERE hit)
"""


def d1_violations_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = validity.row_checks(events(spark, sf_dir), events_bundle())
    hit = validity.hits(table.checks)
    counted = table.rows.agg(*[F.count_if(h).alias(f"n{i}") for i, h in enumerate(hit)])
    each = F.explode(F.array(*[F.struct(F.lit(c.code).alias("code"), F.col(f"n{i}").alias("n")) for i, c in enumerate(table.checks)]))
    return counted.select(each.alias("v")).groupBy("v.code").agg(F.sum("v.n").alias("n_violations")).where("n_violations > 0")


def d1_row_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = validity.row_checks(events(spark, sf_dir), events_bundle())
    from ..functions.columns import any_of

    return table.rows.agg(F.count("*").alias("n_rows"), F.count_if(any_of(validity.hits(table.checks))).alias("n_invalid"), F.round(F.max(table.offset), ROUND).alias("max_offset_s"))


def d1_first_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = validity.row_checks(events(spark, sf_dir), events_bundle())
    first = validity.first_violations(table, 50)
    told = F.array(*[F.when(F.col(f"v{i}").isNotNull(), F.struct(F.lit(i).alias("seq"), F.lit(c.code).alias("code"))) for i, c in enumerate(table.checks)])
    rows = first.select(F.col("__place").alias("event_id"), F.explode(F.filter(told, lambda x: x.isNotNull())).alias("t"))
    return rows.select("event_id", "t.seq", "t.code").orderBy("event_id", "seq").limit(50)


def d1_monotonic_lastfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps with gaps: the last finite one before each row counts."""
    from ..sources.observations import previous

    data = events(spark, sf_dir)
    rows = data.rows.withColumns({"run": data.text("user_id"), "t": F.when(F.col("event_id") % 5 != 0, F.col("sensor_t"))})
    rows = previous(rows, {"before": "t"}, ["run"])
    return rows.groupBy("run").agg(F.count_if(F.col("t") <= F.col("before")).alias("n_back"), F.count_if(F.col("before").isNull()).alias("n_first"))


# --- D4 over E -------------------------------------------------------------------------------------------------------
def _runs(data: Observations) -> DataFrame:
    return data.rows.select(data.text("user_id").alias("run"), data.text("event_type").alias("configuration"), "__file", "__block", "__place", F.col("value").alias("s0"), F.col("force").alias("s1"))


def d4_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(events(spark, sf_dir)).groupBy("run").agg(F.count("*").alias("n_rows"), F.countDistinct("configuration").alias("n_configurations"))


def d4_config_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = replication.first_configuration(_runs(events(spark, sf_dir)))
    return own.groupBy("own").agg(F.countDistinct("run").alias("n_runs"), F.count_if(F.col("configuration") != F.col("own")).alias("n_conflicts")).withColumnRenamed("own", "configuration")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed users against evidence for those whose key is not a multiple of 9, and for some who were never seen; two share
    an acquisition."""
    users = _table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 9 <> 0")
    more = spark.range(3).select((F.col("id") + 10_000_000).alias("user_id"))
    acquisition = F.concat(F.lit("acquisition-"), (F.col("user_id") - F.pmod("user_id", F.lit(2))).cast("string"))
    yes = F.lit(True)
    declared = users.union(more).select(F.col("user_id").cast("string").alias("run"), acquisition.alias("acquisition_id"), yes.alias("separate"), yes.alias("initialised"), yes.alias("zeroed"))
    return replication.ledger(_runs(events(spark, sf_dir)).select("run").distinct(), declared)


def d4_evidence_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(~F.col("observed"), "declared_run_not_observed").when(~F.col("declared"), "missing_evidence").otherwise("matched")
    return _ledger(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n_runs"))


def d4_acquisition_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = _ledger(spark, sf_dir).where("observed AND declared")
    return matched.groupBy("acquisition_id").agg(F.min("owner").alias("owner"), F.count_if(~F.col("verified")).alias("n_duplicates"))


def _lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.lagged(_runs(events(spark, sf_dir)), {"s0": 2, "s1": 1})


def d4_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lagged(spark, sf_dir).where(F.col("v_s0") > replication.CONSTANT).select("run", "n", F.round(F.col("p_s0_1") / F.col("v_s0"), ROUND).alias("rho_1"), F.round(F.col("p_s0_2") / F.col("v_s0"), ROUND).alias("rho_2"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _lagged(spark, sf_dir).where((F.col("n") > 2) & (F.col("v_s0") > replication.CONSTANT))
    below = {"sensor.v": 1 + 2 * (F.col("p_s0_1") + F.col("p_s0_2")) / F.col("v_s0"), "reference.F": 1 + 2 * F.col("p_s1_1") / F.col("v_s1")}
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("signal"), (F.col("n") / b).alias("size"), b.alias("below")) for i, (k, b) in enumerate(below.items())]))
    return t.select(each.alias("x")).where("x.below > 0").groupBy("x.place", "x.signal").agg(F.sum("x.size").alias("ess"), F.count("*").alias("n_runs"))


def d4_ess_by_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("signal", F.round("ess", 4).alias("ess"), "n_runs")


def d4_limiting_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).agg(F.min_by("signal", F.struct("ess", "place")).alias("signal"), F.round(F.min("ess"), 4).alias("ess"))


_LAGS = """
c AS (SELECT CAST(user_id AS VARCHAR) AS run, event_id, value - avg(value) OVER (PARTITION BY user_id) AS a,
             value * 0.5 + 1.0 - avg(value * 0.5 + 1.0) OVER (PARTITION BY user_id) AS b FROM events),
k AS (SELECT *, lag(a) OVER o AS a1, lag(a, 2) OVER o AS a2, lag(b) OVER o AS b1 FROM c WINDOW o AS (PARTITION BY run ORDER BY event_id)),
g AS (SELECT run, count(*) AS n, sum(a * a) AS v, sum(a * a1) AS p1, sum(a * a2) AS p2, sum(b * b) AS vb, sum(b * b1) AS q1 FROM k GROUP BY run),
x AS (SELECT 0 AS place, 'sensor.v' AS signal, n, 1 + 2 * (p1 + p2) / v AS below FROM g WHERE n > 2 AND v > 2.220446049250313e-16
      UNION ALL SELECT 1, 'reference.F', n, 1 + 2 * q1 / vb FROM g WHERE n > 2 AND v > 2.220446049250313e-16),
z AS (SELECT place, signal, sum(n / below) AS ess, count(*) AS n_runs FROM x WHERE below > 0 GROUP BY place, signal)
"""


# --- L ---------------------------------------------------------------------------------------------------------------
def lines(spark: SparkSession, sf_dir: str) -> Observations:
    """Rows ordered by order key, equal keys (lines are not unique) by a hash of all columns; time follows that order."""
    df = _table(spark, sf_dir, "lineitem")
    df = df.withColumn("part", F.shiftrightunsigned(F.xxhash64(*df.columns), 32))
    time = F.col("l_orderkey") + F.col("part") / F.lit(2.0**32)
    df = df.select("*", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), time.alias("t"))
    return bound(df, "lineitem", ["l_orderkey", "part"])


_SPANS = {"q": ("l_quantity", 1.0, 50.0, 6), "d": ("l_discount", 0.0, 0.1, 5), "x": ("l_tax", 0.0, 0.08, 5)}


def lines_bundle(rotation=None) -> TaskBundle:
    """Inputs, as sensors and, for coverage, as references: quantity, discount and tax."""
    mapped = {k: c for k, (c, *_) in _SPANS.items()}
    task = {
        "task_id": "lines",
        "dataset_mapping": {"sensor_timestamp_column": "t", "reference_timestamp_column": "t", "run_id_column": "l_linenumber", "configuration_id_column": "l_returnflag", "sensor_channels": mapped, "reference_channels": mapped},
        "d1": {"maximum_reference_uncertainty": dict.fromkeys(mapped, 1.0), **_D1},
        "d2": {
            "axes": list(mapped), "domain": {k: {"minimum": a, "maximum": b, "grid_points": n} for k, (_, a, b, n) in _SPANS.items()},
            "conditions": {
                "flag": {"kind": "categorical", "source": "column", "column": "l_returnflag", "categories": ["A", "N", "R"]},
                "status": {"kind": "categorical", "source": "column", "column": "l_linestatus", "categories": ["F", "O"]},
            },
            "excluded_regions": [{"region_id": "small-open", "reason": "not claimed", "continuous_bounds": {"q": {"maximum": 15.0}}, "categorical_values": {"status": ["O"]}}],
            "maximum_fill_distance": 0.2,
        },
        "d3": {"model_type": "affine", "input_channels": list(mapped), "output_dimension": 3, "normalization": {k: {"minimum": a, "maximum": b} for k, (_, a, b, _) in _SPANS.items()}, "relative_rank_tolerance": 1e-12, "maximum_condition_number": 5.0, "model_specific_test_id": "design", "confounding_review_id": "review", "condition_handling": "held_fixed"},
    }
    limits = {k: {"unit": "u", "valid_min": a, "valid_max": b, "expanded_uncertainty": 0.01} for k, (_, a, b, _) in _SPANS.items()}
    return _bundle(task, limits, limits, {"reference_to_sensor_rotation": rotation or IDENTITY3})


def revenue_bundle() -> TaskBundle:
    """Inputs as before, one reference: the discounted price; with a split, a bootstrap, and all the rest declared."""
    mapped = {k: c for k, (c, *_) in _SPANS.items()}
    need = {"maximum_interval_half_width": 1e6, "maximum_rmse": 1e6}
    runs = [*DEVELOPMENT, *TEST]
    task = {
        "task_id": "revenue",
        "dataset_mapping": {"sensor_timestamp_column": "t", "reference_timestamp_column": "t", "run_id_column": "l_linenumber", "sensor_channels": mapped, "reference_channels": {"revenue": "revenue"}},
        "d1": {"maximum_reference_uncertainty": {"revenue": 1.0}, **_D1},
        "d2": {"axes": ["revenue"], "domain": {"revenue": {"minimum": 1000.0, "maximum": 90000.0, "grid_points": 50}}, "conditions": {}, "excluded_regions": [], "maximum_fill_distance": 0.5},
        "d3": lines_bundle().task.d3.model_dump() | {"output_dimension": 1},
        "d4": {
            "dependence_method_id": "lags", "stationarity_reviewed": True, "signals": [{"source": "sensor", "channel": "q", "maximum_autocorrelation_lag": 1}],
            "minimum_independent_runs": 7, "minimum_runs_per_configuration": {}, "minimum_effective_sample_size": 10.0, "initialization_procedure_id": "i", "zeroing_procedure_id": "z",
            "run_evidence": [{"run_id": r, "acquisition_id": f"a{r}", "separate_acquisition": True, "initialization_completed": True, "zeroing_completed": True} for r in runs],
        },
        "d5": {
            "validation_unit": "run", "model_source": "task.d3", "development_units": DEVELOPMENT, "test_units": TEST, "minimum_test_units": 3, "split_manifest_id": "split",
            "split_frozen_before_development": True, "development_selection_method_id": "fixed",
            "data_use": dict.fromkeys(holdout.DEVELOPMENT_ONLY, "development_only") | {"final_performance_evaluation": "test_only", "model_locked_before_test_evaluation": True, "test_results_used_for_further_development": False},
        },
        "d6": {
            "metric": "rmse", "confidence_level": 0.9, "bootstrap_repetitions": REPETITIONS, "bootstrap_random_seed": SEED, "bootstrap_unit": "run", "minimum_bootstrap_units": 3, "uncertainty_method_id": "u",
            "axes": {"revenue": need | {"calibrated_force_uncertainty": 1.0, "maximum_calibrated_force_uncertainty": 2.0}},
            "regions": [{"region_id": "large", "dimensions": {"revenue": {"minimum": 40000.0}}, "minimum_bootstrap_units": 2, "axes": {"revenue": need}}],
        },
        "claim": CalibrationClaim(sensor_inputs=list(mapped), reference_outputs=["revenue"], operating_domain=["revenue"], operating_conditions=[], model_family="affine", performance_metrics=["rmse", "calibrated_force_uncertainty"], generalization={"target_description": "later lines", "independent_unit": "run", "sensor_scope": "same_sensor", "operating_conditions": []}).model_dump(),
        "assessment": AssessmentRequirements(criteria={f"D{i}": {"applicable": True} for i in range(1, 7)} | {"D7": {"applicable": False, "reason": "no evidence package"}}).model_dump(),
    }
    sensor = {k: {"unit": "u", "valid_min": a, "valid_max": b} for k, (_, a, b, _) in _SPANS.items()}
    return _bundle(task, sensor, {"revenue": {"unit": "N", "valid_min": 0.0, "valid_max": 1e6, "expanded_uncertainty": 0.5}}, {"reference_to_sensor_rotation": [[1.0]]})


# --- D2 --------------------------------------------------------------------------------------------------------------
def _points(spark: SparkSession, sf_dir: str, rotation=None) -> tuple[Observations, coverage.Domain, DataFrame]:
    data, bundle = lines(spark, sf_dir), lines_bundle(rotation)
    domain = coverage.domain_of(bundle)
    return data, domain, coverage.layered(coverage.normalised(coverage.points_of(data, bundle, domain), domain), domain)


def _named(rows: DataFrame, domain: coverage.Domain) -> DataFrame:
    layers = F.array(*[F.array(*map(F.lit, s)) for s in domain.strata])
    at = F.get(layers, F.col("layer").cast("int"))
    return rows.withColumns({"flag": F.get(at, F.lit(0)), "status": F.get(at, F.lit(1))})


def d2_fill_distance_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, domain, points = _points(spark, sf_dir)
    rows = _named(coverage.strata_table(data, domain, lines_bundle().task.d2.excluded_regions, points), domain)
    return rows.select("flag", "status", F.col("samples").alias("n_samples"), F.col("evaluated").alias("n_evaluated"), F.col("excluded").alias("n_excluded"), F.round("distance", ROUND).alias("fill_distance"))


def d2_worst_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, domain, points = _points(spark, sf_dir)
    rows = coverage.strata_table(data, domain, [], points)
    worst = rows.agg(F.max(F.struct(F.round("distance", 9).alias("d"), (-F.col("layer")).alias("l"), (-F.col("place")).alias("p"))).alias("w"))
    return worst.select((-F.col("w.l")).alias("layer"), (-F.col("w.p")).alias("place"), F.round("w.d", ROUND).alias("fill_distance"))


def d2_support_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, domain, points = _points(spark, sf_dir)
    inside = F.col("layer").isNotNull() & F.col("n0").between(0, 1) & F.col("n1").between(0, 1) & F.col("n2").between(0, 1)
    return points.agg(F.count("*").alias("n_samples"), F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside"))


def d2_achieved_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, domain, points = _points(spark, sf_dir)
    return points.agg(*[f(f"x{i}").alias(f"{k}_{n}") for i, n in enumerate(domain.names) for k, f in (("min", F.min), ("max", F.max))])


def d2_rotated_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, domain, points = _points(spark, sf_dir, TURN)
    return points.agg(*[F.round(f(f"x{i}"), ROUND).alias(f"{k}_{n}") for i, n in enumerate(domain.names) for k, f in (("min", F.min), ("max", F.max))])


def d2_excluded_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid points in regions that the observations bound: up to their mean quantity, and from their mean tax on."""
    data, domain = lines(spark, sf_dir), coverage.domain_of(lines_bundle())
    q, x = data.cells.agg(F.avg("l_quantity"), F.avg("l_tax")).first()
    regions = [D2ExcludedRegion(region_id="small-open", reason="r", continuous_bounds={"q": {"maximum": q}}, categorical_values={"status": ["O"]}), D2ExcludedRegion(region_id="high-tax", reason="r", continuous_bounds={"x": {"minimum": x}})]
    grid = _named(coverage.grid(spark, domain, regions), domain)
    return grid.groupBy("flag", "status", F.coalesce("region", F.lit("kept")).alias("region")).agg(F.count("*").alias("n_points"))


_GRID = """
f AS (SELECT * FROM (VALUES (0, 'A', 'F'), (1, 'A', 'O'), (2, 'N', 'F'), (3, 'N', 'O'), (4, 'R', 'F'), (5, 'R', 'O')) t(layer, flag, status)),
g AS (SELECT layer, flag, status, a * 25 + b * 5 + c AS place, a / 5.0::DOUBLE AS g0, b / 4.0::DOUBLE AS g1, c / 4.0::DOUBLE AS g2,
             1.0 + a / 5.0::DOUBLE * 49.0 AS q, c / 4.0::DOUBLE * CAST(0.08 AS DOUBLE) AS x
      FROM f, (SELECT unnest(range(6)) AS a), (SELECT unnest(range(5)) AS b), (SELECT unnest(range(5)) AS c)),
n AS (SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status, (l_quantity - 1.0) / 49.0 AS n0, l_discount / CAST(0.1 AS DOUBLE) AS n1, l_tax / CAST(0.08 AS DOUBLE) AS n2 FROM lineitem),
d AS (SELECT g.layer, g.flag, g.status, g.place, g.q, g.x, sqrt(min((n0 - g0) ** 2 + (n1 - g1) ** 2 + (n2 - g2) ** 2)) AS d
      FROM g LEFT JOIN n ON n.flag = g.flag AND n.status = g.status GROUP BY ALL)
"""


# --- D3 --------------------------------------------------------------------------------------------------------------
def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = identifiability.inputs_of(data := lines(spark, sf_dir), lines_bundle())
    return data.cells.select(*[c.alias(f"z{i}") for i, c in enumerate(columns)])


def d3_normalized_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _inputs(spark, sf_dir)
    outside = (F.abs("z0") > 1) | (F.abs("z1") > 1) | (F.abs("z2") > 1)
    return z.agg(*[F.round(f(f"z{i}"), ROUND).alias(f"{k}_{n}") for i, n in enumerate(_SPANS) for k, f in (("min", F.min), ("max", F.max))], F.count_if(outside & (F.abs("z1") < 2)).alias("n_outside"))


def d3_gram_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-products of the design from its triangular factor."""
    r, n = factor(_inputs(spark, sf_dir), [F.lit(1.0), F.col("z0"), F.col("z1"), F.col("z2")])
    gram = r.T @ r
    return spark.createDataFrame([(i, j, round(float(gram[i, j]), 4), n) for i in range(4) for j in range(i, 4)], "i int, j int, product double, n_rows long")


def d3_rank_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = factor(_inputs(spark, sf_dir), [F.lit(1.0), F.col("z0"), F.col("z1"), F.col("z2")])
    s = np.linalg.svd(r, compute_uv=False)
    return spark.createDataFrame([(n, int((s > 1e-12 * s[0]).sum()), round(float(s[0] / s[-1]), 6))], "n_rows long, design_rank int, condition_number double")


# --- D5, D6 ----------------------------------------------------------------------------------------------------------
def _fit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, holdout.Fit, Observations, TaskBundle]:
    data, bundle = lines(spark, sf_dir), revenue_bundle()
    samples = holdout.samples_of(data, bundle)
    return samples, holdout.fitted(samples, DEVELOPMENT, 3, 1), data, bundle


def d5_partition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed runs against a split that shares a run, leaves one out, and names one that was never observed."""
    units = holdout.partition(holdout.samples_of(lines(spark, sf_dir), revenue_bundle()), ["1", "2", "3", "9"], ["3", "5", "6", "7"])
    kinds = {"overlap": "development AND test", "unassigned": "NOT development AND NOT test", "not_observed": "NOT observed", "observed": "observed"}
    each = F.explode(F.array(*[F.when(F.expr(e), F.lit(k)) for k, e in kinds.items()]))
    return units.select(each.alias("kind"), "unit").where("kind IS NOT NULL")


def d5_split_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of splits of the line numbers, one for each flag: those of which fewer rows bear it than the mean develop."""
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").cast("string").alias("unit")).agg(F.count("*").alias("n"))
    few = F.col("n") < F.avg("n").over(Window.partitionBy("l_returnflag"))
    split = rows.withColumn("few", few).groupBy("l_returnflag").agg(F.collect_list(F.when(F.col("few"), F.col("unit"))).alias("d"), F.collect_list(F.when(~F.col("few"), F.col("unit"))).alias("t"))
    told = [(r["l_returnflag"], holdout.split_digest("run", r["d"], r["t"])) for r in split.collect()]  # a row a flag
    return spark.createDataFrame(told, "l_returnflag string, sha256 string")


def d5_ols_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fit, *_ = _fit(spark, sf_dir)
    names = ["intercept", *_SPANS]
    return spark.createDataFrame([(n, round(float(c), 3)) for n, c in zip(names, fit.coefficients[:, 0], strict=True)], "feature string, coefficient double")


def d5_test_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, fit, *_ = _fit(spark, sf_dir)
    e = fit.error(0)
    return samples.where(F.col("unit").isin(*TEST)).agg(F.count("*").alias("n_test"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"))


def _run_stats(samples: DataFrame, fit: holdout.Fit) -> DataFrame:
    e = fit.error(0)
    return samples.where(F.col("unit").isin(*TEST)).groupBy("unit").agg(F.count("*").alias("n"), F.sum(e * e).alias("q0"), F.count_if(F.col("y0") >= 40000).alias("m"), F.sum(F.when(F.col("y0") >= 40000, e * e)).alias("z0"))


def d6_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, fit, *_ = _fit(spark, sf_dir)
    return _run_stats(samples, fit).select("unit", "n", F.round(F.sqrt(F.col("q0") / F.col("n")), 4).alias("rmse"))


def _repetitions(spark: SparkSession, sf_dir: str, region: bool = False) -> DataFrame:
    samples, fit, *_ = _fit(spark, sf_dir)
    place = F.array_position(F.array(*map(F.lit, TEST)), F.col("unit")) - 1
    stats = _run_stats(samples, fit).select(place.alias("place"), F.col("m" if region else "n").alias("n"), F.col("z0" if region else "q0").alias("q0"))
    return performance.pooled(stats, times(spark, 3, REPETITIONS, SEED + region), 1)


def d6_bootstrap_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repetitions(spark, sf_dir).select("repetition", F.round("r0", 4).alias("rmse"))


def _interval(rows: DataFrame) -> DataFrame:
    ends = F.percentile("r0", F.array(F.lit(0.05), F.lit(0.95)))
    return rows.agg(F.count("*").alias("n"), ends.alias("e")).select("n", F.round(F.col("e")[0], 4).alias("low"), F.round(F.col("e")[1], 4).alias("high"))


def d6_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interval(_repetitions(spark, sf_dir))


def d6_region_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interval(_repetitions(spark, sf_dir, region=True))


def d6_region_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, _, *_ = _fit(spark, sf_dir)
    rows = samples.where(F.col("unit").isin(*TEST))
    regions = {"large": F.col("y0") >= 40000, "small": F.col("y0") <= 5000, "open": F.col("l_linestatus").isin("O")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("region"), w.alias("inside")) for k, w in regions.items()]))
    return rows.select("unit", each.alias("r")).where("r.inside").groupBy("r.region").agg(F.count("*").alias("n_samples"), F.countDistinct("unit").alias("n_units"))


_OLS = """
l AS (SELECT CAST(l_linenumber AS VARCHAR) AS unit, l_quantity AS x0, l_discount AS x1, l_tax AS x2, l_extendedprice * (1 - l_discount) AS y, l_linestatus FROM lineitem),
t AS (SELECT * FROM l WHERE unit IN ('1', '2', '3', '4')),
s AS (SELECT avg(x0) m0, avg(x1) m1, avg(x2) m2, avg(y) my, covar_pop(x0, x0) a, covar_pop(x0, x1) b, covar_pop(x0, x2) c, covar_pop(x1, x1) d, covar_pop(x1, x2) e,
             covar_pop(x2, x2) f, covar_pop(x0, y) u, covar_pop(x1, y) v, covar_pop(x2, y) w FROM t),
k AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM s),
o AS (SELECT *, (u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w)) / det AS k0, (a * (v * f - e * w) - u * (b * f - e * c) + c * (b * w - v * c)) / det AS k1,
             (a * (d * w - v * e) - b * (b * w - v * c) + u * (b * e - d * c)) / det AS k2 FROM k),
p AS (SELECT k0, k1, k2, my - k0 * m0 - k1 * m1 - k2 * m2 AS k FROM o),
h AS (SELECT l.*, k + k0 * x0 + k1 * x1 + k2 * x2 - y AS err FROM l, p WHERE unit IN ('5', '6', '7')),
r AS (SELECT unit, count(*) AS n, sum(err * err) AS q, count(*) FILTER (y >= 40000) AS m, sum(err * err) FILTER (y >= 40000) AS z FROM h GROUP BY unit)
"""


def _drawn(seed: int) -> str:
    drawn = np.random.default_rng(seed).integers(0, 3, size=(REPETITIONS, 3))
    values = ", ".join(f"({i}, '{TEST[j]}')" for i, row in enumerate(drawn.tolist()) for j in row)
    return f"b AS (SELECT * FROM (VALUES {values}) t(repetition, unit))"


# --- many tasks: D0, registers, roll-ups, recorded results ---------------------------------------------------------------
def d0_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each part, whose columns say what of the claim is declared otherwise, or not at all."""
    change = lambda when, path, value: F.when(when, F.struct(F.lit(path).alias("key"), F.lit(value).cast("string").alias("value")))
    size, brand = F.col("p_size"), F.crc32("p_brand")
    made = F.array(
        change(size % 5 == 0, "claim.sensor_inputs", '["q", "d"]'), change(size % 7 == 0, "claim.model_family", None), change(brand % 3 == 0, "claim.performance_metrics", '["rmse"]'),
        change(F.col("p_type") == "ECONOMY", "d2.maximum_fill_distance", None), change(F.col("p_retailprice") > 950, "claim.operating_domain", '["revenue", "time"]'), change(size % 11 == 0, "d6.regions", None),
        change(F.col("p_partkey") % 13 == 0, "d4", None),
    )
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.map_from_entries(F.filter(made, lambda x: x.isNotNull())).alias("changes"))
    return sweep.claims(rows, revenue_bundle())


#: What is open in the bare task, and a path that is not (both in the order of a register).
_OPEN = ["task.claim", "task.d2", "task.d3", "task.d6", "task.d4", "task.d5", "task.old"]


def bare_bundle() -> TaskBundle:
    channel = {"v": {"unit": "u"}}
    task = {"task_id": "bare", "dataset_mapping": {"sensor_timestamp_column": "t", "reference_timestamp_column": "t", "sensor_channels": {"v": "v"}, "reference_channels": {"v": "v"}}, "d1": {"maximum_reference_uncertainty": {"v": 1.0}, **_D1}}
    return _bundle(task, channel, channel, {"reference_to_sensor_rotation": [[1.0]]})


def register_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register for each customer: of the open paths it lists those whose bit its key sets (all with their last bits
    clear), and the nation says how many it expects."""
    entry = lambda p: json.dumps({"path": p, "criterion": "D2", "classification": next(iter(DeclarationClassification)).value, "resolution_stage": next(iter(DeclarationResolutionStage)).value, "decision_question": "q", "legitimate_source": "l"})
    bits = F.col("c_custkey") % 128
    listed = F.filter(F.array(*[F.when((bits == 0) | (F.floor(bits / (1 << i)) % 2 == 1), F.lit(entry(p))) for i, p in enumerate(_OPEN)]), lambda x: x.isNotNull())
    head = json.dumps({"register_id": "r", "task_config": "task.yaml", "expected_d0_status": "INDETERMINATE", "scope_note": "s"})[:-1]
    task = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("other")).otherwise(F.lit("bare"))
    document = F.concat(F.lit(head + ', "task_id": "'), task, F.lit('", "expected_missing_count": '), (F.col("c_nationkey") % 7 + 1).cast("string"), F.lit(', "entries": ['), F.array_join(listed, ", "), F.lit("]}"))
    return sweep.registers(_table(spark, sf_dir, "customer").select("c_custkey", document.alias("document")), bare_bundle())


def register_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over those audits, how often each path is unlisted or settled, and how many registers are aligned."""
    rows = register_evaluation(spark, sf_dir)
    told = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: F.concat(F.lit(f"{c}:"), x))
    each = F.explode(F.concat(told("unlisted"), told("settled"), F.array(F.when(F.col("aligned"), "aligned").otherwise("apart"))))
    return rows.select(each.alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def overall_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roll-up for each order: its own status is D0's, its lines' flags those of the criteria."""
    status = lambda c, fail, open_: F.when(c == fail, "FAIL").when(c == open_, "INDETERMINATE").otherwise("PASS")
    lines_of = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(status(F.col("l_returnflag"), "R", "A")).alias("statuses"))
    rows = _table(spark, sf_dir, "orders").join(lines_of, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast("array<string>")
    given = F.struct(status(F.col("o_orderstatus"), "F", "P").alias("d0"), (F.col("o_orderpriority") == "1-URGENT").alias("undeclared"), F.coalesce("statuses", none).alias("statuses"))
    return sweep.verdicts(rows.select("o_orderkey", given.alias("given")))


def d7_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results recorded for each supplier against live ones: every seventh has counted a line more, every fifth has revenue off by
    a millionth, every ninth another flag list, and every 31st nothing recorded."""
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.sort_array(F.collect_set("l_returnflag")).alias("flags"))
    key = F.col("l_suppkey")
    document = lambda n, quantity, flags: F.to_json(F.struct(F.struct(n.alias("n"), quantity.alias("quantity")).alias("metrics"), flags.alias("flags")))
    live = rows.select(key.cast("string").alias("key"), document(F.col("n"), F.col("quantity"), F.col("flags")).alias("document"))
    off = F.when(key % 5 == 0, F.col("quantity") * (1 + 1e-6)).otherwise(F.col("quantity"))
    less = F.when(key % 9 == 0, F.slice("flags", 2, 10)).otherwise(F.col("flags"))
    recorded = rows.where(key % 31 != 0).select(key.cast("string").alias("key"), document(F.col("n") + (key % 7 == 0).cast("int"), off, less).alias("document"))
    return provenance.compared(recorded, live, 0.0, 1e-9).select(F.col("key").cast("long").alias("l_suppkey"), "path")


def d7_manifest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active inputs (orders with lines) against a manifest (orders up to a price) by the role each expects."""
    manifest = _table(spark, sf_dir, "orders").where("o_totalprice < 250000").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("role"))
    active = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.max("l_linestatus").alias("expected"))
    return provenance.matched(active, manifest).groupBy("finding").agg(F.count("*").alias("n_inputs"))


def assessment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up of the complete task over L, one row per criterion."""
    rows = Assessment(lines(spark, sf_dir), revenue_bundle(), spark).rows()
    return rows.select("criterion_id", "status", F.size("missing_evidence").alias("n_missing"), F.size("violations").alias("n_violations"))


# --- whole criteria ---------------------------------------------------------------------------------------------------
_ITEMS = "item string, word string, number double"


def _told(spark: SparkSession, result: CriterionResult, metrics: dict[str, str], **more) -> DataFrame:
    """A result as rows: its status, counts by code, and the metrics named (path by dots, to the item's name)."""
    rows = [("status", result.status.value, None)]
    rows += [(f"code:{c}", None, float(n)) for c, n in sorted((result.metrics.get("violations_by_code") or {}).items())]
    for path, item in metrics.items():
        value = result.metrics
        for k in path.split("/"):
            value = value[k]
        rows.append((item, value, None) if isinstance(value, str) else (item, None, round(float(value), 4)))
    rows += [(k, None, float(v)) for k, v in more.items()]
    return spark.createDataFrame(rows, _ITEMS)


def d1_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate_d1(events(spark, sf_dir), events_bundle(), spark)
    listed = max(v.row_number for v in r.violations)
    return _told(spark, r, {"rows_evaluated": "rows", "invalid_rows": "invalid", "maximum_absolute_time_offset_s": "offset", "total_violations": "total"}, n_listed=len(r.violations), last_listed_row=listed)


def csv_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E as a folder of CSV files with quotes and line ends in a column of notes, read back as text, and evaluated by D1."""
    data = events(spark, sf_dir)
    path = place_for(spark, "csv")
    note = F.concat(F.lit('"'), F.col("event_type"), F.lit('",\n'), F.col("event_id").cast("string"))
    rows = data.cells.select("event_id", "user_id", note.alias("note"), "event_type", "value", "sensor_t", "reference_t", "force")
    rows.repartitionByRange("event_id").sortWithinPartitions("event_id").write.csv(path, header=True, escape='"')
    try:
        r = evaluate_d1(path, events_bundle(), spark)
    finally:
        removed(spark, path)
    return _told(spark, r, {"rows_evaluated": "rows", "invalid_rows": "invalid", "maximum_absolute_time_offset_s": "offset", "total_violations": "total"}, n_listed=len(r.violations), last_listed_row=max(v.row_number for v in r.violations))


def d2_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate_d2(lines(spark, sf_dir), lines_bundle(), spark)
    named = {"samples_used": "samples", "samples_inside_claim_domain": "inside", "samples_outside_claim_domain": "outside", "estimated_fill_distance": "fill_distance", "grid_point_count": "points", "excluded_grid_point_count": "excluded"}
    return _told(spark, r, named | {f"achieved_{k}/{a}": f"{k}_{a}" for k in ("minimum", "maximum") for a in _SPANS})


def d3_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate_d3(lines(spark, sf_dir), lines_bundle(), spark)
    named = {"samples_used": "samples", "design_matrix_rank": "rank", "sensitivity_matrix_rank": "sensitivity_rank", "condition_number": "condition"}
    return _told(spark, r, named | {f"normalized_achieved_{k}/{a}": f"{k}_{a}" for k in ("minimum", "maximum") for a in _SPANS})


_TYPES = ("click", "error", "purchase", "signup", "view")


def clean_events(spark: SparkSession, sf_dir: str) -> Observations:
    df = _table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.col("event_id").cast("double").alias("t"), (F.col("value") * 0.5 + 1.0).alias("force"))
    return bound(df, "events", ["event_id"])


def clean_bundle() -> TaskBundle:
    """Event types as runs; ``view`` shares its acquisition with ``signup``, and one run is declared that is never seen."""
    evidence = [{"run_id": r, "acquisition_id": "signup" if r == "view" else r, "separate_acquisition": True, "initialization_completed": True, "zeroing_completed": True} for r in (*_TYPES, "refund")]
    task = {
        "task_id": "clean",
        "dataset_mapping": {"sensor_timestamp_column": "t", "reference_timestamp_column": "t", "run_id_column": "event_type", "sensor_channels": {"v": "value"}, "reference_channels": {"F": "force"}},
        "d1": {"maximum_reference_uncertainty": {"F": 0.1}, **_D1},
        "d4": {
            "dependence_method_id": "lags", "stationarity_reviewed": True, "minimum_independent_runs": 5, "minimum_runs_per_configuration": {}, "minimum_effective_sample_size": 1e9,
            "signals": [{"source": "sensor", "channel": "v", "maximum_autocorrelation_lag": 2}, {"source": "reference", "channel": "F", "maximum_autocorrelation_lag": 1}],
            "initialization_procedure_id": "i", "zeroing_procedure_id": "z", "run_evidence": evidence,
        },
    }
    wide = {"valid_min": -1e6, "valid_max": 1e6}
    return _bundle(task, {"v": {"unit": "u", **wide}}, {"F": {"unit": "N", "expanded_uncertainty": 0.05, **wide}}, {"reference_to_sensor_rotation": [[1.0]]})


def d4_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate_d4(clean_events(spark, sf_dir), clean_bundle(), spark)
    named = {"rows_evaluated": "rows", "observed_run_count": "runs", "verified_independent_run_count": "verified", "effective_sample_sizes/sensor.v": "ess_v", "effective_sample_sizes/reference.F": "ess_F", "limiting_signal": "limiting"}
    return _told(spark, r, named | {f"signals/sensor.v/per_run/{t}/effective_sample_size": f"ess_{t}" for t in _TYPES[:-1]})


def d5_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate_d5(lines(spark, sf_dir), revenue_bundle(), spark)
    named = {"development_sample_count": "development", "test_sample_count": "test", "development_design_rank": "rank", "test_rmse/revenue": "rmse", "observed_unit_count": "units", "split_manifest_sha256": "split"}
    return _told(spark, r, named)


def d6_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate_d6(lines(spark, sf_dir), revenue_bundle(), spark)
    axis, region = "axes/revenue", "regions/large/axes/revenue"
    named = {f"{axis}/rmse_estimate": "rmse", f"{axis}/confidence_interval/lower": "low", f"{axis}/confidence_interval/upper": "high", f"{region}/rmse_estimate": "region_rmse", f"{region}/confidence_interval/lower": "region_low", f"{region}/confidence_interval/upper": "region_high"}
    return _told(spark, r, named | {"calibration_acceptance_status": "acceptance", "test_sample_count": "test"})


def _status_items(status: str, items: dict[str, str]) -> str:
    """SQL of rows like those of ``_told``: a status, and numbers by item (``'...'``: words)."""
    parts = [f"SELECT 'status' AS item, {status} AS word, CAST(NULL AS DOUBLE) AS number"]
    for k, e in items.items():
        parts.append(f"SELECT '{k}', {e}, NULL" if e.startswith(("'", "(SELECT word", "sha256")) else f"SELECT '{k}', NULL, round(CAST({e} AS DOUBLE), 4)")
    return " UNION ALL ".join(parts)


#: Largest and smallest eigenvalue of the design's cross-products, by power iteration (of the matrix, and of what the
#: largest leaves of it); m holds the ten entries.
_POWER = """
m AS (SELECT {entries} FROM lineitem),
big AS (WITH RECURSIVE p(k, a, b, c, d, l) AS (SELECT 0, CAST(1 AS DOUBLE), CAST(0.9 AS DOUBLE), CAST(0.8 AS DOUBLE), CAST(0.7 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
  SELECT k + 1, u / s, v / s, w / s, x / s, s FROM (SELECT k, u, v, w, x, sqrt(u * u + v * v + w * w + x * x) AS s FROM
    (SELECT k, g00 * a + g01 * b + g02 * c + g03 * d AS u, g01 * a + g11 * b + g12 * c + g13 * d AS v, g02 * a + g12 * b + g22 * c + g23 * d AS w, g03 * a + g13 * b + g23 * c + g33 * d AS x FROM p, m WHERE k < {steps})))
  SELECT l FROM p ORDER BY k DESC LIMIT 1),
small AS (WITH RECURSIVE p(k, a, b, c, d, l) AS (SELECT 0, CAST(1 AS DOUBLE), CAST(0.9 AS DOUBLE), CAST(0.8 AS DOUBLE), CAST(0.7 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
  SELECT k + 1, u / s, v / s, w / s, x / s, s FROM (SELECT k, u, v, w, x, sqrt(u * u + v * v + w * w + x * x) AS s FROM
    (SELECT k, (t.l - g00) * a - g01 * b - g02 * c - g03 * d AS u, (t.l - g11) * b - g01 * a - g12 * c - g13 * d AS v, (t.l - g22) * c - g02 * a - g12 * b - g23 * d AS w, (t.l - g33) * d - g03 * a - g13 * b - g23 * c AS x FROM p, m, big t WHERE k < {steps})))
  SELECT (SELECT l FROM big) - l AS l FROM p ORDER BY k DESC LIMIT 1)
"""
_D = "INDETERMINATE"
_CRC = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_SPLIT_SQL = """
WITH g AS (SELECT l_returnflag, CAST(l_linenumber AS VARCHAR) AS unit, count(*) AS n FROM lineitem GROUP BY ALL),
f AS (SELECT *, n < avg(n) OVER (PARTITION BY l_returnflag) AS few FROM g),
s AS (SELECT l_returnflag, coalesce(string_agg('"' || unit || '"', ',' ORDER BY unit) FILTER (few), '') AS d, coalesce(string_agg('"' || unit || '"', ',' ORDER BY unit) FILTER (NOT few), '') AS t FROM f GROUP BY 1)
SELECT l_returnflag, sha256('{"development_units":[' || d || '],"test_units":[' || t || '],"validation_unit":"run"}') AS sha256 FROM s
"""
_CLAIMS_SQL = f"""
WITH t AS (SELECT {_CRC} AS t),
p AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(p_brand, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 3 = 0 AS lacks FROM part, t),
c AS (SELECT p_partkey, concat_ws(',', CASE WHEN p_retailprice > 950 THEN 'operating_domain_mismatch:1' END, CASE WHEN lacks THEN 'performance_requirement_mismatch:1' END, CASE WHEN p_size % 5 = 0 THEN 'sensor_input_mismatch:1' END) AS codes,
             concat_ws(',', CASE WHEN p_size % 7 = 0 THEN 'task.claim.model_family' END, CASE WHEN p_type = 'ECONOMY' THEN 'task.d2.maximum_fill_distance' END, CASE WHEN p_size % 11 = 0 THEN 'task.d6.regions' END, CASE WHEN p_partkey % 13 = 0 THEN 'task.d4' END) AS missing FROM p)
SELECT p_partkey, CASE WHEN codes <> '' THEN 'FAIL' WHEN missing <> '' THEN 'INDETERMINATE' ELSE 'PASS' END AS status, codes, missing FROM c
"""
_REGISTERS_SQL = f"""
WITH o AS (SELECT {_OPEN} AS paths),
r AS (SELECT c_custkey, c_mktsegment <> 'HOUSEHOLD' AS own, c_nationkey % 7 + 1 AS expected, paths[1:6] AS actual, list_filter(paths, lambda x, i: c_custkey % 128 = 0 OR (c_custkey >> (i - 1)) & 1 = 1) AS listed FROM customer, o),
d AS (SELECT *, list_filter(actual, lambda x: NOT list_contains(listed, x)) AS gone, list_filter(listed, lambda x: NOT list_contains(actual, x)) AS old FROM r)
SELECT c_custkey, own AND expected = 6 AND len(listed) = 6 AND len(gone) = 0 AND len(old) = 0 AS aligned, listed = actual AS order_matches, own AS task_id_matches, CAST(len(listed) AS INTEGER) AS n_listed,
       array_to_string(gone, ',') AS unlisted, array_to_string(old, ',') AS settled FROM d
"""
_RECORDED_SQL = """
WITH s AS (SELECT l_suppkey AS k, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1)
SELECT k AS l_suppkey, '' AS path FROM s WHERE k % 31 = 0
UNION ALL SELECT k, 'metrics.n' FROM s WHERE k % 31 <> 0 AND k % 7 = 0
UNION ALL SELECT k, 'metrics.quantity' FROM s WHERE k % 31 <> 0 AND k % 5 = 0
UNION ALL SELECT k, 'flags.__length__' FROM s WHERE k % 31 <> 0 AND k % 9 = 0
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        d1_violations_by_code, d1_row_summary, d1_first_violations, d1_monotonic_lastfinite, d2_fill_distance_by_stratum, d2_worst_point, d2_support_counts,
        d2_achieved_extent, d2_rotated_extent, d2_excluded_grid, d3_normalized_extent, d3_gram_check, d3_rank_condition, d4_run_counts, d4_config_conflicts,
        d4_evidence_outer, d4_acquisition_owner, d4_autocorrelation, d4_ess_by_signal, d4_limiting_signal, d5_partition_audit, d5_split_digest,
        d5_ols_coefficients, d5_test_rmse, d6_run_stats, d6_bootstrap_rmse, d6_bootstrap_ci, d6_region_support, d6_region_ci, d7_manifest_audit,
        register_audit_counts, overall_rollup, assessment_rows, d1_evaluation, csv_evaluation, d2_evaluation, d3_evaluation, d4_evaluation, d5_evaluation,
        d6_evaluation, d0_evaluation, d7_evaluation, register_evaluation,
    ]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    declared = "u AS (SELECT DISTINCT user_id FROM events WHERE user_id % 9 <> 0 UNION ALL SELECT 10000000 + unnest(range(3))), m AS (SELECT CAST(user_id AS VARCHAR) AS run, 'acquisition-' || CAST(user_id - user_id % 2 AS VARCHAR) AS acquisition_id FROM u), seen AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS run FROM events)"
    pooled = "SELECT repetition, sqrt(sum(q) / sum(n)) AS e FROM b JOIN r ON r.unit = b.unit GROUP BY repetition"
    regional = "SELECT repetition, sqrt(sum(z) / sum(m)) AS e FROM b JOIN r ON r.unit = b.unit GROUP BY repetition"
    ci = "SELECT count(*) AS n, round(quantile_cont(e, 0.05), 4) AS low, round(quantile_cont(e, 0.95), 4) AS high FROM"
    z = {"q": "(l_quantity - 25.5) / 24.5", "d": "(l_discount - CAST(0.05 AS DOUBLE)) / CAST(0.05 AS DOUBLE)", "x": "(l_tax - CAST(0.04 AS DOUBLE)) / CAST(0.04 AS DOUBLE)"}
    design = ["CAST(1 AS DOUBLE)", *z.values()]
    turned = {"q": "0.6 * l_quantity - 0.8 * l_discount", "d": "0.8 * l_quantity + 0.6 * l_discount", "x": "l_tax"}
    columns = {k: c for k, (c, *_) in _SPANS.items()}
    d5 = revenue_bundle().task.d5
    canonical = '{"development_units":["' + '","'.join(sorted(d5.development_units)) + '"],"test_units":["' + '","'.join(sorted(d5.test_units)) + '"],"validation_unit":"run"}'
    entries = ", ".join(f"sum({design[i]} * {design[j]}) AS g{i}{j}" for i in range(4) for j in range(i, 4)) + ", count(*) AS n"
    power = _POWER.format(entries=entries, steps=600)
    first = "(SELECT event_id, seq FROM v ORDER BY event_id, seq LIMIT 50)"
    place = f"(SELECT count(*) + 1 FROM e WHERE event_id <= (SELECT max(event_id) FROM {first}))"
    d1 = f"WITH {_EVENTS} " + _status_items("'FAIL'", {"rows": "(SELECT count(*) FROM e)", "invalid": "(SELECT count(DISTINCT event_id) FROM v)", "offset": "(SELECT max(abs(s - r)) FROM e)", "total": "(SELECT count(*) FROM v)", "n_listed": f"(SELECT count(*) FROM {first})", "last_listed_row": place}) + " UNION ALL SELECT 'code:' || code, NULL, CAST(count(*) AS DOUBLE) FROM v GROUP BY code"
    evaluated = {"d1_evaluation": d1, "csv_evaluation": d1}
    cover = {
        "samples": "(SELECT count(*) FROM lineitem)", "inside": "(SELECT count(*) FILTER (i) FROM c)", "outside": "(SELECT count(*) FILTER (NOT i) FROM c)", "fill_distance": "(SELECT max(h) FROM k)",
        "points": "(SELECT sum(n_evaluated) FROM k)", "excluded": "(SELECT sum(n_excluded) FROM k)",
        **{f"{f}imum_{k}": f"(SELECT {f}({c}) FROM lineitem)" for k, c in columns.items() for f in ("min", "max")},
    }
    evaluated["d2_evaluation"] = f"WITH {_GRID}, k AS (SELECT layer, count(*) FILTER (NOT (q <= 15 AND status = 'O')) AS n_evaluated, count(*) FILTER (q <= 15 AND status = 'O') AS n_excluded, max(coalesce(d, 'Infinity'::DOUBLE)) FILTER (NOT (q <= 15 AND status = 'O')) AS h FROM d GROUP BY layer), c AS (SELECT l_returnflag IN ('A', 'N', 'R') AND l_linestatus IN ('F', 'O') AND (l_quantity - 1.0) / 49.0 BETWEEN 0 AND 1 AND l_discount / CAST(0.1 AS DOUBLE) BETWEEN 0 AND 1 AND l_tax / CAST(0.08 AS DOUBLE) BETWEEN 0 AND 1 AS i FROM lineitem) " + _status_items("(SELECT CASE WHEN max(h) <= 0.2 THEN 'PASS' ELSE 'FAIL' END FROM k)", cover) + " UNION ALL SELECT 'code:fill_distance_exceeded', NULL, CAST(1 AS DOUBLE) FROM k HAVING max(h) > 0.2"
    rank = "(SELECT CASE WHEN (SELECT l FROM small) > 1e-10 * (SELECT l FROM big) THEN 4 END)"
    condition = "(SELECT sqrt((SELECT l FROM big) / (SELECT l FROM small)))"
    identified = {"samples": "(SELECT n FROM m)", "rank": rank, "sensitivity_rank": f"3 * {rank}", "condition": condition, **{f"{f}imum_{k}": f"(SELECT {f}({e}) FROM lineitem)" for k, e in z.items() for f in ("min", "max")}}
    evaluated["d3_evaluation"] = f"WITH {power} " + _status_items(f"(SELECT CASE WHEN {condition} <= 5 THEN 'PASS' ELSE 'FAIL' END)", identified) + f" UNION ALL SELECT 'code:condition_number_exceeded', NULL, CAST(1 AS DOUBLE) WHERE {condition} > 5"
    lags = "a AS (SELECT event_type AS run, event_id, value - avg(value) OVER (PARTITION BY event_type) AS a FROM events), k AS (SELECT *, lag(a) OVER o AS a1, lag(a, 2) OVER o AS a2 FROM a WINDOW o AS (PARTITION BY run ORDER BY event_id)), g AS (SELECT run, count(*) / (1 + 2 * (sum(a * a1) + sum(a * a2)) / sum(a * a)) AS v, count(*) / (1 + 2 * sum(a * a1) / sum(a * a)) AS f FROM k GROUP BY run), s AS (SELECT sum(v) AS v, sum(f) AS f FROM g WHERE run <> 'view')"
    repeated = {"rows": "(SELECT count(*) FROM events)", "runs": "(SELECT count(DISTINCT event_type) FROM events)", "verified": "(SELECT count(DISTINCT event_type) - 1 FROM events)", "ess_v": "(SELECT v FROM s)", "ess_F": "(SELECT f FROM s)", "limiting": "(SELECT word FROM (SELECT CASE WHEN v <= f THEN 'sensor.v' ELSE 'reference.F' END AS word FROM s))", **{f"ess_{t}": f"(SELECT v FROM g WHERE run = '{t}')" for t in _TYPES[:-1]}, **{f"code:{c}": "1" for c in ("declared_run_not_observed", "duplicate_acquisition_id", "minimum_effective_sample_size_not_met", "minimum_independent_runs_not_met")}}
    evaluated["d4_evaluation"] = f"WITH {lags} " + _status_items("'FAIL'", repeated)
    held = {"development": "(SELECT count(*) FROM t)", "test": "(SELECT count(*) FROM h)", "rank": "4", "rmse": "(SELECT sqrt(avg(err * err)) FROM h)", "units": "(SELECT count(DISTINCT unit) FROM l)", "split": f"sha256('{canonical}')"}
    evaluated["d5_evaluation"] = f"WITH {_OLS} " + _status_items("'PASS'", held)
    spans = f"b0 AS (SELECT * FROM ({{}})), {_drawn(SEED).replace('b AS', 'b1 AS')}, {_drawn(SEED + 1).replace('b AS', 'b2 AS')}, r1 AS (SELECT sqrt(sum(q) / sum(n)) AS e FROM b1 JOIN r ON r.unit = b1.unit GROUP BY repetition), r2 AS (SELECT sqrt(sum(z) / sum(m)) AS e FROM b2 JOIN r ON r.unit = b2.unit GROUP BY repetition)".removeprefix("b0 AS (SELECT * FROM ({})), ")
    performed = {"rmse": "(SELECT sqrt(sum(q) / sum(n)) FROM r)", "low": "(SELECT quantile_cont(e, 0.05) FROM r1)", "high": "(SELECT quantile_cont(e, 0.95) FROM r1)", "region_rmse": "(SELECT sqrt(sum(z) / sum(m)) FROM r)", "region_low": "(SELECT quantile_cont(e, 0.05) FROM r2)", "region_high": "(SELECT quantile_cont(e, 0.95) FROM r2)", "acceptance": "'PASS'", "test": "(SELECT count(*) FROM h)"}
    evaluated["d6_evaluation"] = f"WITH {_OLS}, {spans} " + _status_items("'PASS'", performed)
    evaluated["d3_rank_condition"] = f"WITH {power} SELECT n AS n_rows, CAST({rank} AS INTEGER) AS design_rank, round({condition}, 6) AS condition_number FROM m"
    outside = " OR ".join(f"{c} < {a} OR {c} > {z}" for c, a, z, _ in _SPANS.values()) + " OR l_extendedprice * (1 - l_discount) NOT BETWEEN 0 AND 1e6"
    evaluated["assessment_rows"] = f"""
WITH {_OLS}, {spans}, {power},
bad AS (SELECT count(*) AS n FROM lineitem WHERE {outside}),
far AS (SELECT max(d) AS d FROM (SELECT g, min(abs(v - g)) AS d FROM (SELECT unnest(range(50)) / 49.0::DOUBLE AS g), (SELECT DISTINCT (y - 1000) / 89000 AS v FROM l) GROUP BY g)),
dev AS (SELECT l_linenumber AS unit, l_orderkey, l_quantity - avg(l_quantity) OVER (PARTITION BY l_linenumber) AS a FROM lineitem),
ess AS (SELECT sum(n / (1 + 2 * c / v)) AS n FROM (SELECT unit, count(*) AS n, sum(a * a) AS v, sum(a * b) AS c FROM (SELECT unit, a, lag(a) OVER (PARTITION BY unit ORDER BY l_orderkey) AS b FROM dev) GROUP BY unit)),
units AS (SELECT count(DISTINCT unit) AS n, count(DISTINCT unit) FILTER (unit IN ('1', '2', '3', '4', '5', '6', '7')) AS own FROM l),
half AS (SELECT (quantile_cont(e, 0.95) - quantile_cont(e, 0.05)) / 2 AS w FROM r1 UNION ALL SELECT (quantile_cont(e, 0.95) - quantile_cont(e, 0.05)) / 2 FROM r2),
own(criterion_id, gate, ok) AS (
  SELECT 'D0', NULL, true UNION ALL SELECT 'D1', NULL, n = 0 FROM bad UNION ALL SELECT 'D2', 'D1', d <= 0.5 FROM far UNION ALL SELECT 'D3', 'D1', {condition} <= 5
  UNION ALL SELECT 'D4', 'D1', units.n >= 7 AND units.n = units.own AND ess.n >= 10 FROM units, ess UNION ALL SELECT 'D5', 'D1', n = 7 AND own = 7 FROM units
  UNION ALL SELECT 'D6', 'D5', max(w) <= 1e6 AND (SELECT count(*) FROM r WHERE m > 0) >= 2 FROM half),
told AS (SELECT o.criterion_id, o.ok, g.ok AND coalesce(gg.ok, true) AS open FROM own o LEFT JOIN own g ON g.criterion_id = o.gate LEFT JOIN own gg ON gg.criterion_id = g.gate)
SELECT criterion_id, CASE WHEN open IS NULL OR open THEN CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END ELSE 'INDETERMINATE' END AS status, CAST(coalesce(NOT open, false) AS INTEGER) AS n_missing,
       CAST(CASE WHEN ok OR NOT coalesce(open, true) THEN 0 WHEN criterion_id = 'D1' THEN least(50, (SELECT n FROM bad)) ELSE 1 END AS INTEGER) AS n_violations FROM told
UNION ALL SELECT 'D7', 'NOT_APPLICABLE', 0, 0
"""
    return evaluated | {
        "d1_violations_by_code": f"WITH {_EVENTS} SELECT code, count(*) AS n_violations FROM v GROUP BY code",
        "d1_row_summary": f"WITH {_EVENTS} SELECT (SELECT count(*) FROM e) AS n_rows, (SELECT count(DISTINCT event_id) FROM v) AS n_invalid, (SELECT round(max(abs(s - r)), 6) FROM e) AS max_offset_s",
        "d1_first_violations": f"WITH {_EVENTS} SELECT event_id, CAST(seq AS INTEGER) AS seq, code FROM v ORDER BY event_id, seq LIMIT 50",
        "d1_monotonic_lastfinite": f"WITH {_EVENTS}, q AS (SELECT run, event_id, CASE WHEN event_id % 5 <> 0 THEN s END AS t FROM e), p AS (SELECT run, t, last_value(t IGNORE NULLS) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM q) SELECT run, count(*) FILTER (t <= b) AS n_back, count(*) FILTER (b IS NULL) AS n_first FROM p GROUP BY run",
        "d2_fill_distance_by_stratum": f"WITH {_GRID}, k AS (SELECT layer, flag, status, count(*) FILTER (NOT (q <= 15 AND status = 'O')) AS n_evaluated, count(*) FILTER (q <= 15 AND status = 'O') AS n_excluded, max(coalesce(d, 'Infinity'::DOUBLE)) FILTER (NOT (q <= 15 AND status = 'O')) AS h FROM d GROUP BY ALL) SELECT k.flag, k.status, (SELECT count(*) FROM lineitem WHERE l_returnflag = k.flag AND l_linestatus = k.status) AS n_samples, n_evaluated, n_excluded, round(h, 6) AS fill_distance FROM k",
        "d2_worst_point": f"WITH {_GRID} SELECT CAST(layer AS BIGINT) AS layer, CAST(place AS BIGINT) AS place, round(coalesce(d, 'Infinity'::DOUBLE), 6) AS fill_distance FROM d ORDER BY round(coalesce(d, 'Infinity'::DOUBLE), 9) DESC, layer, place LIMIT 1",
        "d2_support_counts": "WITH c AS (SELECT l_returnflag IN ('A', 'N', 'R') AND l_linestatus IN ('F', 'O') AND (l_quantity - 1.0) / 49.0 BETWEEN 0 AND 1 AND l_discount / CAST(0.1 AS DOUBLE) BETWEEN 0 AND 1 AND l_tax / CAST(0.08 AS DOUBLE) BETWEEN 0 AND 1 AS i FROM lineitem) SELECT count(*) AS n_samples, count(*) FILTER (i) AS n_inside, count(*) FILTER (NOT i) AS n_outside FROM c",
        "d2_achieved_extent": "SELECT " + ", ".join(f"{f}({c}) AS {f}_{k}" for k, c in columns.items() for f in ("min", "max")) + " FROM lineitem",
        "d2_rotated_extent": "SELECT " + ", ".join(f"round({f}({c}), 6) AS {f}_{k}" for k, c in turned.items() for f in ("min", "max")) + " FROM lineitem",
        "d2_excluded_grid": f"WITH {_GRID}, l AS (SELECT avg(l_quantity) AS mq, avg(l_tax) AS mx FROM lineitem) SELECT flag, status, CASE WHEN q <= mq AND status = 'O' THEN 'small-open' WHEN x >= mx THEN 'high-tax' ELSE 'kept' END AS region, count(*) AS n_points FROM g, l GROUP BY ALL",
        "d3_normalized_extent": "SELECT " + ", ".join(f"round({f}({c}), 6) AS {f}_{k}" for k, c in z.items() for f in ("min", "max")) + ", count(*) FILTER ((" + " OR ".join(f"abs({c}) > 1" for c in z.values()) + f") AND abs({z['d']}) < 2) AS n_outside FROM lineitem",
        "d3_gram_check": " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum({design[i]} * {design[j]}), 4) AS product, count(*) AS n_rows FROM lineitem" for i in range(4) for j in range(i, 4)),
        "d4_run_counts": "SELECT CAST(user_id AS VARCHAR) AS run, count(*) AS n_rows, count(DISTINCT event_type) AS n_configurations FROM events GROUP BY user_id",
        "d4_config_conflicts": "WITH o AS (SELECT user_id, event_type, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS own FROM events) SELECT own AS configuration, count(DISTINCT user_id) AS n_runs, count(*) FILTER (event_type <> own) AS n_conflicts FROM o GROUP BY own",
        "d4_evidence_outer": f"WITH {declared} SELECT CASE WHEN seen.run IS NULL THEN 'declared_run_not_observed' WHEN m.run IS NULL THEN 'missing_evidence' ELSE 'matched' END AS kind, count(*) AS n_runs FROM seen FULL JOIN m ON m.run = seen.run GROUP BY 1",
        "d4_acquisition_owner": f"WITH {declared} SELECT acquisition_id, min(m.run) AS owner, count(*) - 1 AS n_duplicates FROM seen JOIN m ON m.run = seen.run GROUP BY acquisition_id",
        "d4_autocorrelation": f"WITH {_LAGS} SELECT run, n, round(p1 / v, 6) AS rho_1, round(p2 / v, 6) AS rho_2 FROM g WHERE v > 2.220446049250313e-16",
        "d4_ess_by_signal": f"WITH {_LAGS} SELECT signal, round(ess, 4) AS ess, n_runs FROM z",
        "d4_limiting_signal": f"WITH {_LAGS} SELECT signal, round(ess, 4) AS ess FROM z ORDER BY ess, place LIMIT 1",
        "d5_partition_audit": "WITH dev AS (SELECT * FROM (VALUES ('1'), ('2'), ('3'), ('9')) t(unit)), test AS (SELECT * FROM (VALUES ('3'), ('5'), ('6'), ('7')) t(unit)), seen AS (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS unit FROM lineitem), both_ AS (SELECT unit FROM dev UNION SELECT unit FROM test) SELECT 'overlap' AS kind, unit FROM dev WHERE unit IN (SELECT unit FROM test) UNION ALL SELECT 'unassigned', unit FROM seen WHERE unit NOT IN (SELECT unit FROM both_) UNION ALL SELECT 'not_observed', unit FROM both_ WHERE unit NOT IN (SELECT unit FROM seen) UNION ALL SELECT 'observed', unit FROM seen",
        "d5_split_digest": _SPLIT_SQL,
        "d5_ols_coefficients": f"WITH {_OLS} SELECT 'intercept' AS feature, round(k, 3) AS coefficient FROM p UNION ALL SELECT 'q', round(k0, 3) FROM p UNION ALL SELECT 'd', round(k1, 3) FROM p UNION ALL SELECT 'x', round(k2, 3) FROM p",
        "d5_test_rmse": f"WITH {_OLS} SELECT count(*) AS n_test, round(sqrt(avg(err * err)), 4) AS rmse FROM h",
        "d6_run_stats": f"WITH {_OLS} SELECT unit, n, round(sqrt(q / n), 4) AS rmse FROM r",
        "d6_bootstrap_rmse": f"WITH {_OLS}, {_drawn(SEED)} SELECT CAST(repetition AS BIGINT) AS repetition, round(e, 4) AS rmse FROM ({pooled})",
        "d6_bootstrap_ci": f"WITH {_OLS}, {_drawn(SEED)} {ci} ({pooled})",
        "d6_region_ci": f"WITH {_OLS}, {_drawn(SEED + 1)} {ci} ({regional})",
        "d6_region_support": "WITH l AS (SELECT l_linenumber AS unit, l_extendedprice * (1 - l_discount) AS y, l_linestatus AS st FROM lineitem WHERE l_linenumber IN (5, 6, 7)), x AS (SELECT 'large' AS region, unit FROM l WHERE y >= 40000 UNION ALL SELECT 'small', unit FROM l WHERE y <= 5000 UNION ALL SELECT 'open', unit FROM l WHERE st = 'O') SELECT region, count(*) AS n_samples, count(DISTINCT unit) AS n_units FROM x GROUP BY region",
        "d7_manifest_audit": "WITH m AS (SELECT o_orderkey AS path, o_orderstatus AS role FROM orders WHERE o_totalprice < 250000), a AS (SELECT l_orderkey AS path, max(l_linestatus) AS expected FROM lineitem GROUP BY 1) SELECT CASE WHEN m.role IS NULL THEN 'active_input_not_manifested' WHEN m.role <> a.expected THEN 'active_input_role_mismatch' ELSE 'matched' END AS finding, count(*) AS n_inputs FROM a LEFT JOIN m ON m.path = a.path GROUP BY 1",
        "d0_evaluation": _CLAIMS_SQL,
        "d7_evaluation": _RECORDED_SQL,
        "register_evaluation": _REGISTERS_SQL,
        "register_audit_counts": f"WITH e AS ({_REGISTERS_SQL}) SELECT item, count(*) AS n FROM (SELECT unnest(list_concat(list_transform(list_filter(string_split(unlisted, ','), lambda x: x <> ''), lambda x: 'unlisted:' || x), list_transform(list_filter(string_split(settled, ','), lambda x: x <> ''), lambda x: 'settled:' || x), [CASE WHEN aligned THEN 'aligned' ELSE 'apart' END])) AS item FROM e) GROUP BY item",
        "overall_rollup": "WITH l AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS fails, bool_or(l_returnflag = 'A') AS opens FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'FAIL' WHEN o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' THEN 'INDETERMINATE' WHEN coalesce(fails, false) THEN 'FAIL' WHEN coalesce(opens, false) THEN 'INDETERMINATE' ELSE 'PASS' END AS status FROM orders LEFT JOIN l ON l_orderkey = o_orderkey",
    }


