"""Pooled demand forecasters and the recursive roll-out.

One model serves every cell, channel and set. Regressions and trees read the last counts
of the cell and the calendar of the hour to be forecast; recurrent networks read the
counts of a window one after the other and keep a hidden state.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripgrid.functions.calendar import CALENDAR
from tripgrid.functions.calendar import calendar as _calendar
from tripgrid.operators import recurrent, training
from tripgrid.operators.series import window_index
from tripgrid.session import path_exists, remove, shared_dir

KINDS = ("linear", "gbt")
RECURRENT = tuple(recurrent.GATES)


@dataclass(frozen=True)
class Tree:
    """Nodes from the root down: a node with ``feature`` -1 is a leaf with ``value``."""

    weight: float
    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]


@dataclass(frozen=True)
class Forecaster:
    """Plain numbers of a fitted model, the lags it reads, and one loss per training pass.

    A linear one has a weight for each lag and calendar input, then the intercept. A
    recurrent one has all weights of its network; its only lag is the length of the
    window, and its counts are divided by ``scale``.
    """

    kind: str
    lags: tuple[int, ...]
    weights: tuple[float, ...] = ()
    trees: tuple[Tree, ...] = ()
    losses: tuple[float, ...] = ()
    calendar: bool = True
    hidden: int = 0
    layers: int = 1
    scale: float = 1.0

    @property
    def network(self) -> recurrent.Network:
        return recurrent.Network(self.kind, self.hidden, self.layers)


def inputs(calendar: bool = True) -> Column:
    """The input array of a row of ``lag_features``."""
    if not calendar:
        return F.col("lags")
    return F.concat("lags", F.slice("time_features", 2, 6), F.slice("time_features", 9, 12))


def assemble(rows: DataFrame, calendar: bool = True) -> DataFrame:
    """``features`` and ``label`` vectors from the output of ``lag_features``."""
    return rows.select(array_to_vector(inputs(calendar)).alias("features"), "label")


def _residuals(rows: DataFrame, start: Forecaster) -> DataFrame:
    """Rows whose label is what ``start`` leaves unexplained."""
    predict = _predictor(start)

    @F.pandas_udf("double")
    def explained(values: pd.Series) -> pd.Series:
        return pd.Series(predict(np.stack(values.to_numpy())) if len(values) else [], dtype=float)

    return rows.withColumn("label", F.col("label") - explained(inputs(start.calendar)))


def _tree_tables(spark: SparkSession, model: GBTRegressionModel) -> tuple[Tree, ...]:
    """Node tables as the stored model keeps them."""
    path = f"{shared_dir(spark)}/tripgrid-model-{uuid.uuid4().hex}"
    model.write().save(path)
    trees = []
    for tree, weight in enumerate(model.treeWeights):
        node, split = F.col("nodeData"), F.col("nodeData.split")
        stored = spark.read.parquet(f"{path}/data").where(F.col("treeID") == tree).select(
            node["id"].alias("id"),
            split["featureIndex"].alias("feature"),
            F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
            split["numCategories"].alias("categories"),
            node["leftChild"].alias("left"),
            node["rightChild"].alias("right"),
            node["prediction"].alias("value"),
        )
        nodes = sorted(stored.collect(), key=lambda n: n["id"])
        for i, n in enumerate(nodes):
            leaf = n["left"] < 0
            if n["id"] != i or leaf != (n["feature"] < 0) or not leaf and (n["categories"] != -1 or n["threshold"] is None):
                raise ValueError(f"node {n} of tree {tree} is of an unknown form")
        columns = {c: tuple(n[c] for n in nodes) for c in ("feature", "left", "right", "value")}
        trees.append(Tree(weight, threshold=tuple(0.0 if n["threshold"] is None else n["threshold"] for n in nodes), **columns))
    remove(spark, path)
    return tuple(trees)


def fit_forecaster(
    rows: DataFrame,
    lags: Sequence[int],
    kind: str = "linear",
    max_iter: int = 115,
    solver: str = "normal",
    trees: int = 20,
    seed: int = 0,
    calendar: bool = True,
    start: Forecaster | None = None,
) -> Forecaster:
    """Fit on the output of ``lag_features``; ``kind`` is ``linear`` or ``gbt``.

    The normal solver of the linear kind reads the rows once and keeps only the
    products of the inputs. ``solver="l-bfgs"`` makes up to ``max_iter`` passes and
    reports its objective after each. ``start`` is trained on: the fit is made to what
    it leaves unexplained, and added to it.
    """
    if kind in RECURRENT:
        raise ValueError(f"{kind!r} is trained on series, by fit_recurrent")
    if kind not in KINDS:
        raise ValueError(f"unknown forecaster {kind!r}, use one of {sorted((*KINDS, *RECURRENT))}")
    lags = tuple(lags)
    if start is not None:
        if (start.kind, start.lags, start.calendar) != (kind, lags, calendar):
            raise ValueError("the forecaster to go on with has another kind or other inputs")
        rows = _residuals(rows, start)
    data = assemble(rows, calendar)
    if kind == "gbt":
        model = GBTRegressor(maxIter=trees, maxDepth=4, seed=seed).fit(data)
        losses = model.evaluateEachIteration(data, "squared")
        own = Forecaster(kind, lags, trees=_tree_tables(rows.sparkSession, model), calendar=calendar)
    else:
        model = LinearRegression(solver=solver, maxIter=max_iter).fit(data)
        normal = solver == "normal"
        losses = [model.summary.meanSquaredError] if normal else model.summary.objectiveHistory
        own = Forecaster(kind, lags, (*map(float, model.coefficients), float(model.intercept)), calendar=calendar)
    if start is not None:
        added = tuple(a + b for a, b in zip(start.weights, own.weights))
        own = replace(own, weights=added, trees=start.trees + own.trees)
    return replace(own, losses=tuple(float(v) for v in losses))


def fit_recurrent(
    series: DataFrame,
    window: int,
    kind: str = "lstm",
    hidden: int = 32,
    layers: int = 1,
    passes: int = 10,
    path: str | None = None,
    start: Forecaster | None = None,
    **how,
) -> Forecaster:
    """Train a recurrent network on the output of ``stage_series``; ``kind`` is ``rnn``, ``gru`` or ``lstm``.

    With ``path`` every pass is kept there, and training goes on behind the last one
    until there are ``passes``. ``start`` lends its weights to a network that has no
    passes yet.
    """
    if start is not None and (start.kind, start.hidden, start.layers) != (kind, hidden, layers):
        raise ValueError("the forecaster to go on with has another kind or another size")
    given = {} if start is None else {"start": np.array(start.weights), "scale": start.scale}
    net, scale, state = recurrent.fit(series, kind, hidden, layers, passes, path=path, **given, **how)
    return Forecaster(kind, (window,), tuple(map(float, state.weights)), losses=state.losses, hidden=hidden, layers=layers, scale=scale)


def loss_history(spark: SparkSession, path: str) -> DataFrame:
    """``pass, loss`` of all runs saved under ``path``, those that were stopped included."""
    if path_exists(spark, f"{path}/passes"):
        state = training.load_state(spark, path)
        passes = [] if state is None else list(enumerate(state.losses))
        return spark.createDataFrame(passes, "pass int, loss double")
    return spark.read.schema("pass int, loss double").parquet(f"{path}/history")


def save_forecaster(spark: SparkSession, fitted: Forecaster, path: str) -> None:
    """Replace the model under ``path`` and append its losses to the history.

    Passes that were kept one by one are the history already.
    """
    done = 0
    if path_exists(spark, f"{path}/history"):
        done = loss_history(spark, path).agg(F.coalesce(F.max("pass") + 1, F.lit(0))).first()[0]
    passes = [(done + i, loss) for i, loss in enumerate(fitted.losses)]
    trees = [(t.weight, list(t.feature), list(t.threshold), list(t.left), list(t.right), list(t.value)) for t in fitted.trees]
    row = (fitted.kind, list(fitted.lags), fitted.calendar, list(fitted.weights), trees, fitted.hidden, fitted.layers, fitted.scale)
    spark.createDataFrame([row], _MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    if path_exists(spark, f"{path}/passes"):
        return
    spark.createDataFrame(passes, "pass int, loss double").coalesce(1).write.mode("append").parquet(f"{path}/history")


_MODEL = (
    "kind string, lags array<int>, calendar boolean, weights array<double>, trees array<struct<weight:double,"
    "feature:array<int>,threshold:array<double>,left:array<int>,right:array<int>,value:array<double>>>, hidden int, layers int, scale double"
)


def load_forecaster(spark: SparkSession, path: str) -> Forecaster | None:
    """The saved model, or ``None`` when there is none and training starts fresh."""
    if not path_exists(spark, f"{path}/model"):
        return None
    row = spark.read.schema(_MODEL).parquet(f"{path}/model").first()
    losses = [r["loss"] for r in loss_history(spark, path).orderBy("pass").toLocalIterator()]
    trees = tuple(Tree(t["weight"], *(tuple(t[c]) for c in ("feature", "threshold", "left", "right", "value"))) for t in row["trees"])
    # Models of older versions have no network.
    size = (row["hidden"] or 0, row["layers"] or 1, row["scale"] or 1.0)
    return Forecaster(row["kind"], tuple(row["lags"]), tuple(row["weights"]), trees, tuple(losses), row["calendar"], *size)


def _predictor(fitted: Forecaster):
    """A small picklable function from an input matrix to predictions."""
    if fitted.kind == "linear":
        weights, intercept = np.array(fitted.weights[:-1]), fitted.weights[-1]
        return lambda values: values @ weights + intercept
    tables = [(t.weight, *map(np.array, (t.feature, t.threshold, t.left, t.right, t.value))) for t in fitted.trees]

    def boosted(values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values))
        rows = np.arange(len(values))
        for weight, feature, threshold, left, right, value in tables:
            node = np.zeros(len(values), dtype=np.int64)
            while (feature[node] >= 0).any():
                inner = feature[node] >= 0
                goes_left = values[rows, np.maximum(feature[node], 0)] <= threshold[node]
                node = np.where(inner, np.where(goes_left, left[node], right[node]), node)
            total += weight * value[node]
        return total

    return boosted


def forecast_recursive(samples: DataFrame, fitted: Forecaster, f: int) -> DataFrame:
    """Replace ``features`` and ``at`` by ``yhat``, the next ``f`` counts.

    ``features`` holds the last counts, newest at the end, and ``at`` is the first
    hour to forecast, counted since 1970. Each forecast becomes an input of the next
    one; a recurrent forecaster also keeps its hidden state from step to step. Rows are
    independent, so there is no shuffle: a task works through Arrow batches and computes
    one step of a whole batch at a time.
    """
    depth = max(fitted.lags)
    rest = [c for c in samples.columns if c not in ("features", "at")]
    recent = F.slice("features", F.size("features") - depth + 1, depth)
    checked = F.when(F.size("features") < depth, F.raise_error(F.lit("window is shorter than the longest lag"))).otherwise(
        recent.cast("array<double>")
    )
    given = samples.select(*rest, checked.alias("features"), "at")
    schema = T.StructType([given.schema[c] for c in rest] + [T.StructField("yhat", T.ArrayType(T.DoubleType()))])

    roll = roller(fitted, f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            window = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, depth)
            yhat = roll(window, batch.column("at").to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], _lists(yhat)], [*rest, "yhat"])

    return given.mapInArrow(run, schema)


def _lists(values: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values, float).reshape(-1)))


def roller(fitted: Forecaster, f: int):
    """A picklable function from windows (row, hour) and the hours behind them to the next ``f`` counts of each."""
    if fitted.kind in RECURRENT:
        net, weights, scale = fitted.network, np.array(fitted.weights), fitted.scale

        def recurring(window: np.ndarray, first: np.ndarray) -> np.ndarray:
            size = recurrent.CHUNK
            parts = [recurrent.roll(net, weights, scale, window[i : i + size], first[i : i + size], f) for i in range(0, len(window), size)]
            return np.concatenate(parts) if parts else np.zeros((0, f))

        return recurring
    lags = np.array(fitted.lags)
    predict, calendar = _predictor(fitted), fitted.calendar

    def lagged(window: np.ndarray, first: np.ndarray) -> np.ndarray:
        depth = window.shape[1]
        state = np.empty((len(window), depth + f))
        state[:, :depth] = window
        for step in range(f):
            known = state[:, depth + step - lags]
            hour = [_calendar(first + step)[:, CALENDAR]] if calendar else []
            state[:, depth + step] = predict(np.hstack([known, *hour]))
        return state[:, depth:]

    return lagged


def forecast_series(series: DataFrame, fitted: Forecaster, w: int, f: int, gap: int = 0, all_windows: bool = False) -> DataFrame:
    """The same aligned rows as ``forecast_windows`` of ``sliding_windows``, straight from the series.

    Windows are views of short pieces of the series inside a task: what travels to
    Python is each count about twice, and not the whole window for each of its samples.
    """
    depth, roll = max(fitted.lags), roller(fitted, f)
    if depth > w:
        raise ValueError("window is shorter than the longest lag")
    held = window_index(series, w, f, gap, all_windows)
    doubles = held.withColumn("part", F.col("part").cast("array<double>"))
    rest = [c for c in series.columns if c not in ("series", "first_hour")]
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([series.schema[c] for c in rest]).add("idx", T.LongType()).add("yhat", numbers).add("actual", numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = np.lib.stride_tricks.sliding_window_view
        for batch in batches:
            for i in range(batch.num_rows):
                row, part = batch.slice(i, 1), batch.column("part")[i].values.to_numpy(zero_copy_only=False)
                start, size = row.column("from")[0].as_py(), row.column("len")[0].as_py()
                idx = start + np.arange(size)
                windows = view(part, w)[:size, w - depth :]
                yhat = roll(windows, row.column("first_hour")[0].as_py() + idx + (w + gap))
                labels = view(part[w + gap :], f)[:size]
                kept = [row.column(c).take(pa.array(np.zeros(size, np.int64))) for c in rest]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(idx, pa.int64()), _lists(yhat), _lists(labels)], [*rest, "idx", "yhat", "actual"])

    rolled = doubles.mapInArrow(run, schema)
    pairs = rolled.select(*rest, "idx", F.posexplode(F.arrays_zip("yhat", "actual")).alias("step", "pair"))
    return pairs.select(*rest, "idx", "step", "pair.yhat", "pair.actual")


def forecast_windows(windows: DataFrame, fitted: Forecaster, w: int, f: int, gap: int = 0) -> DataFrame:
    """Forecast every window and lay ``yhat`` beside its label: aligned rows.

    A window carries its own labels, so nothing has to be joined.
    """
    samples = windows.withColumn("at", F.col("first_hour") + F.col("idx") + (w + gap)).drop("first_hour")
    rolled = forecast_recursive(samples, fitted, f)
    rest = [c for c in rolled.columns if c not in ("yhat", "labels")]
    pairs = rolled.select(*rest, F.posexplode(F.arrays_zip("yhat", F.col("labels").alias("actual"))).alias("step", "pair"))
    return pairs.select(*rest, "step", "pair.yhat", "pair.actual")
