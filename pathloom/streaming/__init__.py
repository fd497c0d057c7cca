"""Running estimates as Structured Streaming aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def running_moments(samples: DataFrame, weight: str = "w", time: str | None = None, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Count, mean and standard error of a stream of weights: over all so far, or in windows of event time behind a watermark."""
    keys = []
    if time:
        samples, keys = samples.withWatermark(time, late), [F.window(time, window).alias("window")]
    w = F.col(weight)
    return samples.groupBy(*keys).agg(F.count(w).alias("samples"), F.avg(w).alias("mean"), (F.stddev_samp(w) / F.sqrt(F.count(w))).alias("sem"))
