"""The whole navigation cycle over a table or a stream, with parts that can be replaced.

Sensor states are matched to roads, given to a drift model, and run through ``fusion``, whose inertial step uses the grade of the road matched
in the row before. Source, matcher and drift model are functions: of nothing to a DataFrame, and of a DataFrame to one with the same rows and
more columns. On streams they may join with tables and use column functions; so the built ones do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import fusion, matching
from . import state

Step = Callable[[DataFrame], DataFrame]


def road_matcher(edges: DataFrame, config: matching.MatchConfig = matching.GRAPH) -> Step:
    """Adds the best match of each row (``matching.BEST``)."""
    return lambda states: matching.best_match(states, edges, config)


def constant_drift(position_m: float, velocity_mps: float) -> Step:
    """A drift model that always says the same."""
    return lambda states: states.withColumns({"predicted_position_error_m": F.lit(position_m), "predicted_velocity_error_mps": F.lit(velocity_mps)})


def navigation_cycle(source: DataFrame | Callable[[], DataFrame], matcher: Step | None = None, drift_model: Step | None = None, track: str = "track_id", on: str = "t", row: str = "row_idx", use_velocity: bool = False, **options) -> DataFrame:
    """The states of ``source`` with ``fusion.FUSED``, the columns of matcher and drift model, and with the latter ai_weight (1 without a prediction),
    drift_state and drift_detected (by position alone, or by velocity too). ``options``: those of ``streaming.state.stateful``, for streams."""
    states = source() if callable(source) else source
    for step in (matcher, drift_model):
        states = states if step is None else step(states)
    run = (lambda df: state.fusion_stream(df, track, on, row, **options)) if states.isStreaming else (lambda df: fusion.fusion_pipeline(df, track, on, row))
    out = run(states)
    if "predicted_position_error_m" in out.columns:
        position, velocity = "predicted_position_error_m", "predicted_velocity_error_mps"
        decided = scalar.drift_decision(position, velocity) if use_velocity else scalar.drift_decision(position)
        out = out.withColumns({"ai_weight": F.coalesce(scalar.ai_weight(position), F.lit(1.0)), "drift_state": F.when(F.col(position).isNotNull(), decided)})
        out = out.withColumn("drift_detected", F.coalesce(F.col("drift_state") == "ABNORMAL", F.lit(False)))
    return out
