"""Training of networks over many tasks: gradients are summed by Spark, the optimiser runs on the driver.

A pass over the data is cut into a fixed number of steps. In each, every task adds up the
gradient of the rows it holds, all at the same weights; Spark adds the tasks' gradients
entry by entry, and one Adam update is made. So the model depends on the rows and the
steps and not on how rows are dealt to tasks, but for the last digits of sums.

After each pass the weights, the optimiser's moments and the pass's loss are written to
a folder of their own. The marker that Spark's writer leaves when it is done tells whole
passes from broken ones; a job that was stopped goes on behind the last whole pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripgrid.session import path_exists

#: (weights, batch) -> summed gradient, summed loss, weight of the rows.
Gradient = Callable[[np.ndarray, pa.RecordBatch], tuple[np.ndarray, float, float]]

_PASS = "pass int, loss double, steps long, weights array<double>, mean array<double>, square array<double>"


@dataclass(frozen=True)
class State:
    """Weights, Adam's moments and number of updates, and one loss for each pass."""

    weights: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    steps: int = 0
    losses: tuple[float, ...] = ()

    @staticmethod
    def fresh(weights: np.ndarray) -> State:
        return State(weights, np.zeros_like(weights), np.zeros_like(weights))


def adam(state: State, gradient: np.ndarray, rate: float, decay: tuple[float, float] = (0.9, 0.999), tiny: float = 1e-8) -> State:
    steps = state.steps + 1
    mean = decay[0] * state.mean + (1 - decay[0]) * gradient
    square = decay[1] * state.square + (1 - decay[1]) * gradient**2
    move = (mean / (1 - decay[0] ** steps)) / (np.sqrt(square / (1 - decay[1] ** steps)) + tiny)
    return State(state.weights - rate * move, mean, square, steps, state.losses)


def summed(rows: DataFrame, weights: np.ndarray, gradient: Gradient) -> tuple[np.ndarray, float, float]:
    """Gradient, loss and weight of all ``rows``, summed.

    A task sends one number for each weight, however many rows it holds, and the driver
    receives as many as there are weights.
    """
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for batch in batches:
            if batch.num_rows:
                own, loss, weight = gradient(weights, batch)
                total[:size] += own
                total[size:] += loss, weight
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2), pa.int32()), pa.array(total)], ["at", "value"])

    parts = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    total = np.zeros(size + 2)
    for at, value in parts.collect():
        total[at] = value
    return total[:size], float(total[size]), float(total[size + 1])


def pass_path(path: str, number: int) -> str:
    return f"{path}/passes/pass-{number:06}"


def save_pass(spark: SparkSession, state: State, path: str) -> None:
    """Write the state after its last pass; a broken attempt at the same pass is replaced."""
    number = len(state.losses) - 1
    row = (number, state.losses[-1], state.steps, state.weights.tolist(), state.mean.tolist(), state.square.tolist())
    spark.createDataFrame([row], _PASS).coalesce(1).write.mode("overwrite").parquet(pass_path(path, number))


def is_whole(spark: SparkSession, path: str, number: int) -> bool:
    return path_exists(spark, f"{pass_path(path, number)}/_SUCCESS")


def load_state(spark: SparkSession, path: str) -> State | None:
    """The state after the last whole pass that all passes before it lead to, or ``None``."""
    whole = 0
    while is_whole(spark, path, whole):
        whole += 1
    if not whole:
        return None
    rows = spark.read.schema(_PASS).parquet(*[pass_path(path, i) for i in range(whole)])
    losses = tuple(r["loss"] for r in rows.select("pass", "loss").orderBy("pass").collect())
    last = rows.where(F.col("pass") == whole - 1).first()
    return State(np.array(last["weights"]), np.array(last["mean"]), np.array(last["square"]), last["steps"], losses)


def train(
    rows: DataFrame,
    start: np.ndarray,
    gradient: Gradient,
    passes: int,
    steps: int,
    rate: float,
    path: str | None = None,
    step: str = "step",
    ready: tuple[np.ndarray, float, float] | Callable[[np.ndarray], tuple[np.ndarray, float, float]] | None = None,
) -> State:
    """Train until ``passes`` passes are done, those kept under ``path`` included.

    Column ``step`` of ``rows`` says in which of the ``steps`` of a pass a row takes part.
    ``ready`` gives the gradient, loss and weight of what is not in the rows, which is
    shared out among the steps.
    """
    spark = rows.sparkSession
    state = (load_state(spark, path) if path else None) or State.fresh(start)
    if len(state.weights) != len(start):
        raise ValueError(f"{path} holds {len(state.weights)} weights, the network has {len(start)}")
    while len(state.losses) < passes:
        losses = weights = 0.0
        for k in range(steps):
            own = rows.where(F.col(step) == k) if steps > 1 else rows
            total, loss, weight = summed(own, state.weights, gradient)
            if ready is not None:
                more = ready(state.weights)
                total, loss, weight = total + more[0] / steps, loss + more[1] / steps, weight + more[2] / steps
            losses, weights = losses + loss, weights + weight
            if weight:
                state = adam(state, total / weight, rate)
        state = State(state.weights, state.mean, state.square, state.steps, (*state.losses, losses / max(weights, 1.0)))
        if path:
            save_pass(spark, state, path)
    return state
