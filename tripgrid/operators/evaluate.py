"""Forecast scores.

Aligned rows have ``idx`` (sample), ``step``, ``channel``, ``x``, ``y``, ``yhat`` and
``actual``. Cells with neither a forecast nor trips have no row; they add nothing to
an error sum but do count in every mean, which is why the means take the matrix size
and the number of samples from outside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripgrid.config import REPORT_SAMPLE
from tripgrid.functions.numbers import round_pred
from tripgrid.operators.cleaning import CITY
from tripgrid.operators.lookup import attach
from tripgrid.session import Staged, stage

PLACE = ("idx", "step", "channel", "x", "y")


def pred_actual_join(pred: DataFrame, actual: DataFrame, keys: Sequence[str] = CITY) -> DataFrame:
    """Align ``yhat`` and ``actual`` by sample, step, channel and cell; a missing side is 0."""
    return pred.join(actual, [*keys, *PLACE], "full_outer").select(
        *keys,
        *PLACE,
        F.coalesce("yhat", F.lit(0.0)).alias("yhat"),
        F.coalesce("actual", F.lit(0).cast("long")).alias("actual"),
    )


def _squared_error() -> Column:
    return F.pow(F.col("yhat") - F.col("actual"), F.lit(2))


def _rounded() -> Column:
    return round_pred(F.col("yhat"))


def sample_scores(aligned: DataFrame, keys: Sequence[str] = CITY) -> DataFrame:
    """Per sample, step and channel: squared error ``se`` and the grid totals.

    Every part of a report is a sum over these few rows.
    """
    return aligned.groupBy(*keys, "idx", "step", "channel").agg(
        F.sum(_squared_error()).alias("se"),
        F.sum(_rounded()).cast("long").alias("pred"),
        F.sum("actual").alias("actual"),
    )


def _mse(df: DataFrame, se: Column, dims, samples, steps: int, keys: Sequence[str]) -> DataFrame:
    sized = attach(attach(df.groupBy(*keys).agg(F.sum(se).alias("__se")), dims, keys), samples, keys)
    cells = F.col("nx") * F.col("ny") * 2 * steps * F.col("n_samples")
    return sized.select(*keys, F.try_divide(F.col("__se"), cells.cast("double")).alias("mse"))


def _horizon(df: DataFrame, se: Column, dims, samples, keys: Sequence[str]) -> DataFrame:
    per_step = df.groupBy(*keys, "step", "channel").agg(F.sum(se).alias("__se"))
    sized = attach(attach(per_step, dims, keys), samples, keys)
    total = F.try_divide(F.col("__se"), (F.col("nx") * F.col("ny")).cast("double"))
    mean = F.try_divide(total, F.col("n_samples").cast("double"))
    return sized.select(*keys, "step", "channel", total.alias("total_mse"), mean.alias("mean_mse"))


def _totals(df: DataFrame, pred: Column, keys: Sequence[str]) -> DataFrame:
    first = df.where(F.col("step") == 0)
    return first.groupBy(*keys, "idx", "channel").agg(
        F.sum(pred).cast("long").alias("pred"), F.sum("actual").alias("actual")
    )


def mse(
    aligned: DataFrame, dims: DataFrame | Staged, samples: DataFrame | Staged, steps: int, keys: Sequence[str] = CITY
) -> DataFrame:
    """``mse``: mean squared error over all cells of both channels, zeros included."""
    return _mse(aligned, _squared_error(), dims, samples, steps, keys)


def horizon_mse(
    aligned: DataFrame, dims: DataFrame | Staged, samples: DataFrame | Staged, keys: Sequence[str] = CITY
) -> DataFrame:
    """``total_mse`` and ``mean_mse`` over the samples, per step and channel."""
    return _horizon(aligned, _squared_error(), dims, samples, keys)


def demand_pred_vs_actual(aligned: DataFrame, keys: Sequence[str] = CITY) -> DataFrame:
    """Grid totals of the first step: forecasts rounded per cell, and trips."""
    return _totals(aligned, _rounded(), keys)


def nth_sample(samples: DataFrame, keys: Sequence[str] = CITY, nth: int = REPORT_SAMPLE) -> DataFrame:
    """Rows of sample ``nth``, or of the last sample when there are fewer."""
    last = samples.groupBy(*keys).agg(F.least(F.lit(nth).cast("long"), F.max("idx")).alias("__nth"))
    return attach(samples, last, keys).where(F.col("idx") == F.col("__nth")).drop("__nth")


def heatmap_cells(aligned: DataFrame, keys: Sequence[str] = CITY, nth: int = REPORT_SAMPLE) -> DataFrame:
    """First step of one sample, cell by cell: ``actual`` and rounded ``pred``."""
    first = nth_sample(aligned.where(F.col("step") == 0), keys, nth)
    return first.select(*keys, "x", "y", "channel", "actual", _rounded().cast("long").alias("pred"))


def _part(df: DataFrame, keys: Sequence[str], metric: str, value: str, **at: str) -> DataFrame:
    """One report part in long form; ``at`` names the columns for channel, step, idx."""
    places = {
        name: F.col(at[name]) if name in at else F.lit(None)
        for name in ("channel", "step", "idx")
    }
    return df.select(
        *keys,
        F.lit(metric).alias("metric"),
        places["channel"].cast("int").alias("channel"),
        places["step"].cast("int").alias("step"),
        places["idx"].cast("long").alias("idx"),
        F.col(value).cast("double").alias("value"),
    )


def score_forecast(
    aligned: DataFrame,
    dims: DataFrame | Staged,
    samples: DataFrame | Staged,
    steps: int,
    history: DataFrame | None = None,
    keys: Sequence[str] = CITY,
) -> DataFrame:
    """The whole report as rows ``metric, channel, step, idx, value``.

    The aligned rows, which are as many as forecasts, are read once.
    """
    dims = dims if isinstance(dims, Staged) else stage(dims, "dims")
    samples = samples if isinstance(samples, Staged) else stage(samples, "samples")
    scores = stage(sample_scores(aligned, keys), "scores").df
    by_step = _horizon(scores, F.col("se"), dims, samples, keys)
    totals = _totals(scores, F.col("pred"), keys)
    overall = _mse(scores, F.col("se"), dims, samples, steps, keys)
    report = (
        _part(overall, keys, "mse", "mse")
        .unionByName(_part(by_step, keys, "total_loss", "total_mse", channel="channel", step="step"))
        .unionByName(_part(by_step, keys, "mean_loss", "mean_mse", channel="channel", step="step"))
        .unionByName(_part(totals, keys, "pred_demand", "pred", channel="channel", idx="idx"))
        .unionByName(_part(totals, keys, "actual_demand", "actual", channel="channel", idx="idx"))
    )
    if history is not None:
        report = report.unionByName(_part(history, keys, "training_loss", "loss", step="pass"))
    return report


def series_total_demand(report: DataFrame, keys: Sequence[str] = CITY) -> DataFrame:
    """Ordered series of the total-demand charts."""
    kept = report.where(F.col("metric").isin("pred_demand", "actual_demand"))
    return kept.select(*keys, "metric", "channel", "idx", "value").orderBy(*keys, "metric", "channel", "idx")


def series_loss(report: DataFrame, keys: Sequence[str] = CITY) -> DataFrame:
    """Ordered series of the loss charts."""
    kept = report.where(F.col("metric").isin("total_loss", "mean_loss", "training_loss"))
    return kept.select(*keys, "metric", "channel", "step", "value").orderBy(*keys, "metric", "channel", "step")
