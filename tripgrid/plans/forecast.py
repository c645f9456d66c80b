"""Stored demand to a fitted forecaster and its scores, and two older experiments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripgrid.config import (
    CHRONO_SHARE,
    HOUR_S,
    PLAIN_HORIZON_HOURS,
    PLAIN_WINDOW_HOURS,
    RANDOM_SHARE,
    CityConfig,
    ColumnMap,
)
from tripgrid.operators import conv, evaluate, forecast, latent, series, splits, training
from tripgrid.operators.cleaning import CITY
from tripgrid.session import Staged, pin_utc, remove, scratch, stage
from tripgrid.sources import readers, writers
from tripgrid.sources.publish import read_table


STARTS = ("fresh", "continue", "resume", "score")


def stored_span(stored: DataFrame, keys: Sequence[str] = CITY) -> DataFrame:
    """First and last hour, counted since 1970, of a stored demand set."""
    absolute = F.floor(F.unix_seconds("t0") / HOUR_S)
    return stored.groupBy(*keys).agg(F.min(absolute).alias("first_hour"), F.max(absolute).alias("last_hour"))


def sample_counts(span: DataFrame, w: int, f: int, share: float = CHRONO_SHARE, keys: Sequence[str] = CITY) -> DataFrame:
    """``n_samples`` that ``sliding_windows`` cuts from the test part of each set."""
    n = F.col("last_hour") - F.col("first_hour") + 1
    test = n - F.floor(F.lit(share) * n)
    return span.select(*keys, F.greatest(test - w - f, F.lit(0)).alias("n_samples"))


def run_forecast_job(
    spark: SparkSession,
    source: str,
    jobs: Sequence[CityConfig],
    out: str,
    run_id: str,
    lags: Sequence[int] | None = None,
    share: float = CHRONO_SHARE,
    start: str = "fresh",
    models: str | None = None,
) -> None:
    """Fit, forecast and score the named cities of a demand set written by the demand job.

    Cities with the same settings share one model and one pass. Appends the report to
    ``out/eval`` and keeps the model under ``out/model-...``. ``start`` is ``fresh``, or
    ``continue`` to train on from the model saved there or under ``models``, or
    ``resume`` to finish the passes of a recurrent kind that was stopped, or ``score``
    to use that model as it is.
    """
    if start not in STARTS:
        raise ValueError(f"start must be one of {STARTS}, not {start!r}")
    pin_utc(spark)
    groups: dict[CityConfig, list[str]] = {}
    for job in jobs:
        groups.setdefault(replace(job, city="", time_format="", columns=ColumnMap()), []).append(job.city)
    for settings, cities in groups.items():
        w, f, kind = settings.window, settings.horizon, settings.kind
        name = f"model-{kind}-{w}-{f}"
        with scratch(spark):
            stored = read_table(spark, source, "demand").where(F.col("city").isin(cities))
            dims = stage(read_table(spark, source, "dims").where(F.col("city").isin(cities)), "dims")
            span = stage(stored_span(stored), "span")
            counts = stored.where(F.col("channel").isNotNull()).select("city", "hour", "channel", "x", "y", "cnt")
            whole = series.stage_series(counts, span, drop_last=False)
            train, test = series.split_series(whole, share)
            depths = tuple(lags or range(1, w + 1))
            saved = None if start == "fresh" else forecast.load_forecaster(spark, f"{models or out}/{name}")
            if start == "score":
                if saved is None:
                    raise ValueError(f"no model is saved under {models or out}/{name}")
                fitted = saved
            else:
                fitted = _fitted(train, settings, depths, saved, f"{out}/{name}", start)
                forecast.save_forecaster(spark, fitted, f"{out}/{name}")
            history = forecast.loss_history(spark, f"{(models or out) if start == 'score' else out}/{name}")
            per_city = history.withColumn("city", F.explode(F.array(*[F.lit(c) for c in cities])))
            aligned = forecast.forecast_series(test, fitted, w, f)
            n_samples = stage(sample_counts(span.df, w, f, share), "samples")
            report = evaluate.score_forecast(aligned, dims, n_samples, f, per_city)
            writers.append_eval(report, f"{out}/eval", run_id)


def _fitted(
    train: DataFrame, job: CityConfig, depths: Sequence[int], saved: forecast.Forecaster | None, path: str, start: str
) -> forecast.Forecaster:
    spark = train.sparkSession
    if job.kind not in forecast.RECURRENT:
        rows = series.lag_features(train, depths)
        return forecast.fit_forecaster(rows, depths, job.kind, job.max_iter, job.solver, job.trees, start=saved)
    if start == "fresh":
        remove(spark, f"{path}/passes")
    done = training.load_state(spark, path)
    passes = job.passes + (len(done.losses) if done and start == "continue" else 0)
    lent = saved if done is None else None
    return forecast.fit_recurrent(train, job.window, job.kind, job.hidden, job.layers, passes, path, lent)


def _random_parts(
    stored: DataFrame, share: float, seed: int, keys: Sequence[str]
) -> list[tuple[DataFrame, Staged]]:
    """Random hours for training, the others for testing, each renumbered without holes."""
    hours = stage(stored.select(*keys, "hour").distinct(), "hours").df
    counts = stored.where(F.col("channel").isNotNull()).select(*keys, "hour", "channel", "x", "y", "cnt")
    parts = []
    for part in splits.split_random(hours, [*keys, "hour"], share, seed):
        moved, span = splits.reindex_hours(counts, part, keys)
        parts.append((moved, stage(span, "span")))
    return parts


def run_plain_forecast(
    spark: SparkSession,
    source: str,
    w: int = PLAIN_WINDOW_HOURS,
    f: int = PLAIN_HORIZON_HOURS,
    lags: Sequence[int] | None = None,
    share: float = RANDOM_SHARE,
    seed: int = 0,
    keys: Sequence[str] = CITY,
    fitted: forecast.Forecaster | None = None,
    kind: str = "linear",
    **how,
) -> DataFrame:
    """Older experiment: random hours, windows with a gap, fit, mean test loss per set.

    ``kind`` may be recurrent; ``how`` then says how it is trained.

    Random hours have no calendar of their own, so positions stand in for hours. With
    ``fitted`` nothing is trained. Staged tables last as long as the session.
    """
    pin_utc(spark)
    stored = readers.scan_demand(spark, f"{source}/demand")
    (train, train_span), (test, test_span) = _random_parts(stored, share, seed, keys)
    depths = tuple(lags or range(1, w + 1))
    if fitted is None:
        whole = series.stage_series(train, train_span, keys, drop_last=False)
        if kind in forecast.RECURRENT:
            fitted = forecast.fit_recurrent(whole, w, kind, **how)
        else:
            fitted = forecast.fit_forecaster(series.lag_features(whole, depths), depths, kind, **how)
    aligned = forecast.forecast_series(series.stage_series(test, test_span, keys, drop_last=False), fitted, w, f, gap=1)
    dims = stage(spark.read.parquet(f"{source}/dims"), "dims")
    samples = sample_counts(test_span.df, w, f, 0.0, keys)
    return evaluate.mse(aligned, dims, samples, f, keys)


def run_encoder(
    spark: SparkSession,
    source: str,
    k: int = 2,
    tile: int = latent.TILE,
    share: float = RANDOM_SHARE,
    seed: int = 0,
    keys: Sequence[str] = CITY,
) -> DataFrame:
    """Older experiment: random hours, fit the grid encoder, reconstruction error on the others."""
    pin_utc(spark)
    stored = readers.scan_demand(spark, f"{source}/demand")
    (train, train_span), (test, test_span) = _random_parts(stored, share, seed, keys)
    encoder = latent.fit_encoder(train, _lengths(train_span, keys), k, tile, keys)
    return latent.reconstruction_mse(test, encoder, _lengths(test_span, keys), keys)


def run_conv_encoder(
    spark: SparkSession,
    source: str,
    shape: conv.Shape = conv.Shape(),
    share: float = RANDOM_SHARE,
    seed: int = 0,
    keys: Sequence[str] = CITY,
    **how,
) -> DataFrame:
    """The same experiment with the convolutional encoder; ``how`` says how it is trained."""
    pin_utc(spark)
    stored = readers.scan_demand(spark, f"{source}/demand")
    (train, train_span), (test, test_span) = _random_parts(stored, share, seed, keys)
    encoder = conv.fit_conv_encoder(train, _lengths(train_span, keys), shape, keys, **how)
    return conv.conv_mse(test, encoder, _lengths(test_span, keys), keys)


def _lengths(span: Staged, keys: Sequence[str]) -> Staged:
    n = F.col("last_hour") - F.col("first_hour") + 1
    return Staged(span.df.select(*keys, n.alias("n")), span.rows, span.path)

