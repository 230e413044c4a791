"""Queries that fit models: no SQL can say the same; the tests judge them by properties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import features, fusion, isolation, matching, metrics, models, sync
from ..sources.scratch import scratch_path, written
from ..streaming import cycle, state
from . import views
from .book import Book
from .road_queries import curved, judged, scored
from .telemetry_queries import split, states

book = Book()
FEATURES = ["ay", "az", "speed", "accuracy", "gx"]


@book.add()
def isolation_forest(spark, d):
    """Scores of all rows by a forest on the train split, flagged over the 99th percentile of validation scores."""
    rows = sync.attach_split(views.tel(spark, d), split(spark, d))
    forest = isolation.isolation_forest_fit(rows.filter("split = 'train'"), FEATURES)
    scored = written(isolation.isolation_forest_score(rows, forest, FEATURES), "scores")  # read for the threshold, and for the flags
    flagged = isolation.anomaly_flag(scored, isolation.select_threshold(scored.filter("split = 'validation'")))
    return flagged.select("sequence_id", "row_idx", "split", "drift_score", "drift_detected")


def windows(spark, d):
    rows = sync.attach_split(views.tel(spark, d), split(spark, d))
    w = features.temporal_windows(rows.withColumn("target", F.col("speed") * 0.5 + F.col("ay") * 0.1), FEATURES, ["target"])
    return sync.attach_split(w, split(spark, d))


@book.add()
def window_regressor(spark, d):
    """Errors, per split, of a regression on window summaries."""
    w = windows(spark, d)
    fitted = models.window_regressor(w.filter("split = 'train'"), ["target"], len(FEATURES))
    predicted = models.predict_windows(w, fitted, len(FEATURES)).select("split", "predicted_target", "target")
    return metrics.regression_metrics(written(predicted, "predicted"), "predicted_target", "target", ["split"])  # read several times


@book.add()
def batch_score(spark, d):
    """Windows scored by a loaded function."""
    w = windows(spark, d)
    return models.batch_score(w, lambda: lambda x: np.nanmean(x, axis=1)[:, :1], ["mean_ay"]).select("sequence_id", "row_idx", "mean_ay")


@book.add()
def learned_rerank(spark, d):
    """Top-1 and top-3 of held-out points by the learned order."""
    near = scored(spark, d)
    model, held = models.fit_reranker(matching.candidate_features(judged(near)))
    ranked = matching.match_confidence(matching.rank_candidates(near))
    r = matching.candidate_features(ranked).join(held.select("point_id", "segment_id", "label"), ["point_id", "segment_id"])
    return matching.topk_accuracy(models.learned_rerank(r, model), "rank")


@book.add()
def fusion_stream(spark, d):
    """The fusion cycle as a stream over the events' file, collected as a table in the shared folder."""
    out = scratch_path(spark, "stream")
    table = states(spark, d)
    source = f"{out}/in"
    table.write.parquet(source)
    stream = state.fusion_stream(spark.readStream.schema(table.schema).parquet(source))
    query = stream.select("track_id", "row_idx", *fusion.FUSED).writeStream.option("checkpointLocation", f"{out}/state").format("parquet").option("path", f"{out}/rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def outages(spark, d):
    """``states`` with measurements missing: every third position, and all of them for a stretch; speeds, headings, accuracies and confidences here and there."""
    r, lost = F.col("row_idx"), lambda n: F.col("row_idx") % n == 0
    gone = lost(3) | (F.pmod(F.floor(r / 200), F.lit(4)) == 1)
    return states(spark, d).withColumns({"lat": F.when(~gone, F.col("lat")), "lon": F.when(~lost(3), F.col("lon")), **{c: F.when(~lost(n), F.col(c)) for c, n in (("speed", 5), ("heading", 7), ("accuracy", 11), ("confidence", 13))}})


@book.add()
def fusion_outage(spark, d):
    """The fusion cycle over drives with missing measurements: whole from each drive's first position on."""
    return fusion.fusion_pipeline(outages(spark, d)).select("track_id", "row_idx", "lat", "lon", *fusion.FUSED)


@book.add()
def navigation_cycle(spark, d):
    """The whole cycle with the built matcher, whose grades enter the inertial step, and a constant drift model."""
    out = cycle.navigation_cycle(states(spark, d), cycle.road_matcher(curved(spark, d)), cycle.constant_drift(12.0, 0.5))
    return out.select("track_id", "row_idx", "road_segment_id", "map_grade_pct", "ai_weight", "drift_state", "drift_detected", *fusion.FUSED)
