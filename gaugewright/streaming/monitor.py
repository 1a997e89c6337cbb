"""A running monitor of D1's row checks: the batch predicates over a stream, with the last timestamps of each run kept.

An extension: the batch evaluators do not need it. Checks that look at a row alone are the batch ones. Order within a run
is that of arrival in a micro-batch's ordering column; the last finite timestamps of each run are state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..declarations import TaskBundle
from ..functions.columns import parsed, quoted, stripped, within

_STATE = "sensor double, reference double"
_OUT = "run string, n_rows long, n_not_increasing long"


def row_findings(stream: DataFrame, bundle: TaskBundle) -> DataFrame:
    """Each row with ``findings``: the codes of the checks it fails on its own."""
    m, limit = bundle.task.dataset_mapping, bundle.setup.maximum_time_offset_s
    kinds = dict(stream.dtypes)
    number = lambda c: parsed(quoted(c), kinds[c])
    s, r = number(m.sensor_timestamp_column), number(m.reference_timestamp_column)
    found = [F.when(t.isNull(), F.lit("invalid_numeric_value")) for t in (s, r)]
    if m.run_id_column is not None:
        found.insert(0, F.when(stripped(quoted(m.run_id_column)) == "", F.lit("invalid_run_id")))
    if limit is not None:
        found.append(F.when(F.abs(s - r) > limit, F.lit("synchronization_exceeded")))
    for kind, profile in (("sensor", bundle.sensor), ("reference", bundle.reference)):
        for name, column in m.channels(kind).items():
            value, channel = number(column), profile.channels.get(name)
            found.append(F.when(value.isNull(), F.lit("invalid_numeric_value")))
            if channel:
                found.append(F.when(~within(value, channel.valid_min, channel.valid_max), F.lit("measurement_out_of_range")))
    return stream.withColumn("findings", F.filter(F.array(*found), lambda x: x.isNotNull()))


def findings_per_window(stream: DataFrame, bundle: TaskBundle, event_time: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Counts of findings by code in tumbling windows of event time, with a watermark for late rows."""
    rows = row_findings(stream, bundle).withWatermark(event_time, late)
    each = rows.select(F.window(event_time, window).alias("window"), F.explode("findings").alias("code"))
    return each.groupBy("window", "code").agg(F.count("*").alias("n_findings"))


def not_increasing(stream: DataFrame, bundle: TaskBundle, order: str) -> DataFrame:
    """Per run and micro-batch: rows, and timestamps that do not increase over the last finite one of their run."""
    m = bundle.task.dataset_mapping
    kinds = dict(stream.dtypes)
    rows = stream.select(
        stripped(quoted(m.run_id_column)).alias("run") if m.run_id_column else F.lit("").alias("run"), F.col(order).alias("at"),
        parsed(quoted(m.sensor_timestamp_column), kinds[m.sensor_timestamp_column]).alias("sensor"),
        parsed(quoted(m.reference_timestamp_column), kinds[m.reference_timestamp_column]).alias("reference"),
    )

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(("sensor", "reference"), state.get if state.exists else (None, None), strict=True))
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        back = 0
        for clock in last:
            times = rows[clock].dropna()
            before = times.shift(fill_value=last[clock] if last[clock] is not None else float("-inf"))
            back += int((times <= before).sum())
            if len(times):
                last[clock] = float(times.iloc[-1])
        state.update((last["sensor"], last["reference"]))
        yield pd.DataFrame({"run": [key[0]], "n_rows": [len(rows)], "n_not_increasing": [back]})

    return rows.groupBy("run").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
