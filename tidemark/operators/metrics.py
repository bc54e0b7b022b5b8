"""Queries over metric samples: (series columns, ts, value) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Slices of time that a series' samples are taken in.
SLICES = 64


def _growth(now: Column, before: Column) -> Column:
    """Growth over the sample before; a counter that falls has started again at 0, the first has none."""
    return F.when(before.isNull(), 0.0).when(now < before, now).otherwise(now - before)


def increase(samples: DataFrame, series: Sequence[str], ts: str, value: str, at: Column, seconds: int) -> DataFrame:
    """(series, increase) of counters over the ``seconds`` before ``at``, restarts considered.

    Growth is between samples inside the window; nothing is extrapolated. A
    series is reduced by slices of time, each a task's own, and the slices are
    joined at their borders: few series are no few tasks.
    """
    recent = samples.where((F.col(ts) > at - F.make_dt_interval(secs=F.lit(seconds))) & (F.col(ts) <= at))
    slice_ = F.floor((F.unix_micros(at) - F.unix_micros(F.col(ts).cast("timestamp"))) * SLICES / F.lit(seconds * 1_000_000)).cast("int")
    sliced = recent.withColumn("__slice", slice_)
    before = F.lag(value).over(Window.partitionBy(*series, "__slice").orderBy(ts))
    own = sliced.withColumn("__growth", _growth(F.col(value), before)).groupBy(*series, "__slice").agg(F.sum("__growth").alias("__inner"), F.min_by(value, ts).alias("__first"), F.max_by(value, ts).alias("__last"))
    border = _growth(F.col("__first"), F.lag("__last").over(Window.partitionBy(*series).orderBy(F.desc("__slice"))))
    return own.withColumn("__border", border).groupBy(*series).agg(F.sum(F.col("__inner") + F.col("__border")).alias("increase"))


def rate(samples: DataFrame, series: Sequence[str], ts: str, value: str, at: Column, seconds: int) -> DataFrame:
    """(series, rate) per second over the window."""
    return increase(samples, series, ts, value, at, seconds).select(*series, (F.col("increase") / seconds).alias("rate"))


def latest(samples: DataFrame, series: Sequence[str], ts: str, value: str) -> DataFrame:
    """(series, value): the instant reading of a gauge."""
    return samples.groupBy(*series).agg(F.max_by(value, ts).alias(value))


def staleness(samples: DataFrame, series: Sequence[str], ts: str, at: Column) -> DataFrame:
    """(series, seconds) since the last sample."""
    return samples.groupBy(*series).agg(F.max(ts).alias("last")).select(*series, F.timestamp_diff("SECOND", F.col("last"), at).alias("seconds"))


def mean_of(df: DataFrame, series: Sequence[str], total: str, count: str) -> DataFrame:
    """(series, mean): ratio of sums."""
    return df.groupBy(*series).agg((F.sum(total) / F.sum(count)).alias("mean"))


def histogram(df: DataFrame, series: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """(series, le, count): cumulative buckets, the last unbounded (le is infinity)."""
    return df.groupBy(*series).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all")).select(*series, F.inline(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("count")))))


def histogram_quantile(buckets: DataFrame, series: Sequence[str], q: float) -> DataFrame:
    """(series, quantile): linear within the bucket the quantile falls in; the last bound for the unbounded bucket."""
    w = Window.partitionBy(*series).orderBy("le")
    steps = buckets.select(*series, "le", "count", F.coalesce(F.lag("count").over(w), F.lit(0)).alias("below"), F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("low"), F.max("count").over(Window.partitionBy(*series)).alias("total"))
    rank = F.col("total") * q
    hit = steps.where((F.col("count") >= rank) & ((F.col("below") < rank) | (F.col("low") == 0.0)) & (F.col("total") > 0))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (rank - F.col("below")) / F.greatest(F.col("count") - F.col("below"), F.lit(1))
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside)
    return hit.groupBy(*series).agg(F.min_by(value, "le").alias("quantile"))


def alerts(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """Rows for which an alert's condition holds, with its name."""
    return df.where(condition).withColumn("alert", F.lit(name))


def lasting(samples: DataFrame, series: Sequence[str], ts: str, condition: Column, at: Column, seconds: int) -> DataFrame:
    """(series, since) of the series for which ``condition`` has held at every sample of the ``seconds`` before ``at``.

    It has held since the first sample after the last one without it; a series
    without samples in that time, or whose samples begin within it, is not listed.
    """
    known = samples.where(F.col(ts) <= at)
    held = F.coalesce(condition, F.lit(False))
    ends = known.groupBy(*series).agg(F.max(F.when(~held, F.col(ts))).alias("broken"), F.max(ts).alias("newest"))
    since = known.join(ends, list(series)).where(F.col("broken").isNull() | (F.col(ts) > F.col("broken"))).groupBy(*series).agg(F.min(ts).alias("since"), F.max("newest").alias("newest"))
    start = at - F.make_dt_interval(secs=F.lit(seconds))
    return since.where((F.col("since") <= start) & (F.col("newest") > start)).select(*series, "since")
