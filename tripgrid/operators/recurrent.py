"""Recurrent forecasters: one network for all series, trained over pieces of them.

The input of an hour is the count of the hour before and the calendar of the hour itself;
the output is its count. The network sees a piece of a series from its first hour on;
errors count from the ``warm``-th hour of a piece, and pieces overlap by that much, so
that every hour behind the first ones is learned once. Gradients go back to the start of
the piece and no further.

In a forecast the hidden state runs through the window and is kept from step to step, so
a step costs one step of the network and not another run through the window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripgrid.functions.calendar import CALENDAR, calendar
from tripgrid.operators import training
from tripgrid.session import stage

#: Gates of each kind of cell.
GATES = {"rnn": 1, "gru": 3, "lstm": 4}
PIECE = 168
WARM = 24
# Pieces or windows that are run through the network at a time.
CHUNK = 512


@dataclass(frozen=True)
class Network:
    """The form of a network; its weights are one flat array."""

    kind: str
    hidden: int
    layers: int = 1
    inputs: int = 1 + len(CALENDAR)

    def __post_init__(self) -> None:
        if self.kind not in GATES:
            raise ValueError(f"unknown recurrent kind {self.kind!r}, use one of {sorted(GATES)}")

    @property
    def shapes(self) -> list[tuple[int, ...]]:
        wide = GATES[self.kind] * self.hidden
        layers = [((self.inputs if k == 0 else self.hidden, wide), (self.hidden, wide), (wide,)) for k in range(self.layers)]
        return [s for layer in layers for s in layer] + [(self.hidden,), (1,)]

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes)

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.shapes:
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape))
            at += n
        return out

    def fresh(self, seed: int) -> np.ndarray:
        bound = 1 / np.sqrt(self.hidden)
        return np.random.default_rng(seed).uniform(-bound, bound, self.size)

    def rest(self, n: int) -> list[tuple[np.ndarray, ...]]:
        """The hidden state of ``n`` series that nothing was seen of."""
        zero = np.zeros((n, self.hidden))
        return [(zero, zero) if self.kind == "lstm" else (zero,) for _ in range(self.layers)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _cell(kind: str, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, x: np.ndarray, state: tuple) -> tuple[tuple, tuple]:
    """The next state of one layer and what its derivative needs."""
    h = state[0]
    n = h.shape[1]
    if kind == "rnn":
        new = np.tanh(x @ wx + h @ wh + b)
        return (new,), (x, h, new)
    if kind == "gru":
        zx, zh = x @ wx + b, h @ wh
        gates = _sigmoid(zx[:, : 2 * n] + zh[:, : 2 * n])
        reset, keep = gates[:, :n], gates[:, n:]
        fresh = np.tanh(zx[:, 2 * n :] + reset * zh[:, 2 * n :])
        return (keep * h + (1 - keep) * fresh,), (x, h, reset, keep, fresh, zh[:, 2 * n :])
    z = x @ wx + h @ wh + b
    gates = _sigmoid(z[:, : 3 * n])
    enter, forget, leave = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
    fresh = np.tanh(z[:, 3 * n :])
    c = forget * state[1] + enter * fresh
    shown = np.tanh(c)
    return (leave * shown, c), (x, h, enter, forget, leave, fresh, state[1], shown)


def _back(kind: str, wx: np.ndarray, wh: np.ndarray, kept: tuple, dstate: tuple) -> tuple[tuple, np.ndarray, tuple]:
    """Derivatives for the weights, the input and the state before, from those for the state after."""
    x, h, dh = kept[0], kept[1], dstate[0]
    if kind == "rnn":
        dz = dh * (1 - kept[2] ** 2)
        return (x.T @ dz, h.T @ dz, dz.sum(axis=0)), dz @ wx.T, (dz @ wh.T,)
    if kind == "gru":
        _, _, reset, keep, fresh, inner = kept
        dfresh = dh * (1 - keep) * (1 - fresh**2)
        dkeep = dh * (h - fresh) * keep * (1 - keep)
        dreset = dfresh * inner * reset * (1 - reset)
        dzx = np.hstack([dreset, dkeep, dfresh])
        dzh = np.hstack([dreset, dkeep, dfresh * reset])
        return (x.T @ dzx, h.T @ dzh, dzx.sum(axis=0)), dzx @ wx.T, (dh * keep + dzh @ wh.T,)
    _, _, enter, forget, leave, fresh, before, shown = kept
    dc = dstate[1] + dh * leave * (1 - shown**2)
    dz = np.hstack([dc * fresh * enter * (1 - enter), dc * before * forget * (1 - forget), dh * shown * leave * (1 - leave), dc * enter * (1 - fresh**2)])
    return (x.T @ dz, h.T @ dz, dz.sum(axis=0)), dz @ wx.T, (dz @ wh.T, dc * forget)


def advance(net: Network, parts: list[np.ndarray], x: np.ndarray, state: list[tuple]) -> tuple[np.ndarray, list[tuple], list[tuple]]:
    """One hour of a batch: the outputs, the next state, and what derivatives need."""
    new, kept = [], []
    for k in range(net.layers):
        own, cache = _cell(net.kind, *parts[3 * k : 3 * k + 3], x, state[k])
        new.append(own)
        kept.append(cache)
        x = own[0]
    return x @ parts[-2] + parts[-1][0], new, kept


def gradient(net: Network, flat: np.ndarray, x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient and sum of squared errors of a batch: inputs (row, hour, input), labels and which of them count."""
    parts = net.parts(flat)
    state, caches, errors, tops = net.rest(len(x)), [], [], []
    for t in range(x.shape[1]):
        out, state, kept = advance(net, parts, x[:, t], state)
        caches.append(kept)
        tops.append(state[-1][0])
        errors.append(np.where(counts[:, t], out - y[:, t], 0.0))
    grads = [np.zeros_like(p) for p in parts]
    dstate = net.rest(len(x))
    for t in reversed(range(x.shape[1])):
        dout = 2 * errors[t]
        grads[-2] += tops[t].T @ dout
        grads[-1] += dout.sum()
        dx = dout[:, None] * parts[-2]
        for k in reversed(range(net.layers)):
            after = (dstate[k][0] + dx, *dstate[k][1:])
            own, dx, dstate[k] = _back(net.kind, parts[3 * k], parts[3 * k + 1], caches[t][k], after)
            for g, d in zip(grads[3 * k : 3 * k + 3], own, strict=True):
                g += d
    return np.concatenate([g.ravel() for g in grads]), float(sum((e**2).sum() for e in errors))


def inputs(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Inputs of the hours behind each value; ``values[:, t]`` is the count of hour ``first + t``."""
    n, hours = values.shape
    at = first[:, None] + np.arange(1, hours + 1)
    known = calendar(at.ravel())[:, CALENDAR].reshape(n, hours, len(CALENDAR))
    return np.concatenate([values[:, :, None], known], axis=2)


def pieces(series: DataFrame, steps: int, piece: int = PIECE, warm: int = WARM) -> DataFrame:
    """``step, first, values``: overlapping pieces of every series, dealt to steps by a hash."""
    if not 1 <= warm < piece:
        raise ValueError(f"warm must be between 1 and {piece - 1}")
    n, rest = F.size("series"), [c for c in series.columns if c != "series"]
    starts = F.when(n > warm, F.sequence(F.lit(0), n - warm - 1, F.lit(piece - warm)))
    cut = series.select(*rest, "series", F.explode(starts).alias("from"))
    return cut.select(
        F.pmod(F.xxhash64(*[c for c in rest if c != "first_hour"], F.col("first_hour") + F.col("from")), F.lit(steps)).cast("int").alias("step"),
        (F.col("first_hour") + F.col("from")).cast("long").alias("first"),
        F.slice("series", F.col("from") + 1, piece).cast("array<double>").alias("values"),
    )


def _padded(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(column)
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, size


def batch_gradient(net: Network, scale: float, warm: int) -> training.Gradient:
    def own(flat: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, float, float]:
        total, loss, weight = np.zeros(net.size), 0.0, 0.0
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            values, size = _padded(part, "values")
            values /= scale
            first = part.column("first").to_numpy(zero_copy_only=False)
            hours = np.arange(1, values.shape[1])
            counts = (hours >= warm) & (hours < size[:, None])
            grad, squared = gradient(net, flat, inputs(values[:, :-1], first), values[:, 1:], counts)
            total, loss, weight = total + grad, loss + squared, weight + float(counts.sum())
        return total, loss, weight

    return own


def fit(
    series: DataFrame,
    kind: str = "lstm",
    hidden: int = 32,
    layers: int = 1,
    passes: int = 10,
    steps: int = 8,
    rate: float = 0.01,
    piece: int = PIECE,
    warm: int = WARM,
    seed: int = 0,
    path: str | None = None,
    scale: float | None = None,
    start: np.ndarray | None = None,
) -> tuple[Network, float, training.State]:
    """Train on the output of ``stage_series``; with ``path``, go on behind the passes kept there.

    Counts are divided by ``scale``, by default the root of their mean square. Losses are
    mean squared errors of counts divided so.
    """
    net = Network(kind, hidden, layers)
    if scale is None:
        squares = F.aggregate("series", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
        found = series.agg(F.sum(squares).alias("s"), F.sum(F.size("series").cast("long")).alias("n")).first()
        scale = float(np.sqrt((found["s"] or 0.0) / max(found["n"] or 0, 1))) or 1.0
    held = stage(pieces(series, steps, piece, warm).sortWithinPartitions("step"), "pieces")
    state = training.train(held.df, net.fresh(seed) if start is None else start, batch_gradient(net, scale, warm), passes, steps, rate, path)
    return net, scale, state


def roll(net: Network, flat: np.ndarray, scale: float, window: np.ndarray, first: np.ndarray, f: int) -> np.ndarray:
    """The ``f`` counts behind each window (row, hour); ``first`` is the hour of the first of them."""
    parts, n = net.parts(flat), len(window)
    state, values = net.rest(n), window / scale
    known = inputs(values, first - values.shape[1])
    for t in range(values.shape[1]):
        out, state, _ = advance(net, parts, known[:, t], state)
    found = np.empty((n, f))
    found[:, 0] = out
    for step in range(1, f):
        x = inputs(found[:, step - 1 : step], first + step - 1)[:, 0]
        found[:, step], state, _ = advance(net, parts, x, state)
    return found * scale
