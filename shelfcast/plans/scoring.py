"""Score all series, compare the new batch with history, raise alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators import drift, scoring
from shelfcast.panel import recent


def scoring_run(history: DataFrame, model, as_of, new: DataFrame | None = None, days: int = 7,
                old_predictions: DataFrame | None = None, lags: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables ``predictions``, ``drift``, ``alerts`` and a one-row ``summary``."""
    new = recent(history, days) if new is None else new
    predictions = scoring.score_all_series(new, model, as_of, days, lags)
    found = drift.data_drift(new, history)
    if old_predictions is not None:
        found = found.unionByName(drift.prediction_drift(predictions, old_predictions))
    alerts = drift.drift_alerts(found)
    # The model's own metrics start with "prediction_"; everything else describes the data.
    over = F.col("over_threshold")
    own = F.col("metric").startswith("prediction_")
    summary = alerts.agg(
        F.count_if(over & ~own).alias("n_data_alerts"), F.count_if(over & own).alias("n_model_alerts")
    ).select(
        predictions.agg(F.count("*").alias("n")).scalar().alias("predictions_generated"),
        new.agg(F.count("*").alias("n")).scalar().alias("new_rows"),
        (F.col("n_data_alerts") > 0).alias("data_drift_detected"), (F.col("n_model_alerts") > 0).alias("model_drift_detected"),
        (F.col("n_data_alerts") + F.col("n_model_alerts") > 0).alias("alerts_sent"),
    )
    return {"predictions": predictions, "drift": found, "alerts": alerts, "summary": summary}
