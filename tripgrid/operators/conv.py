"""A convolutional code of hourly grids that sees neighbouring cells, and back.

The plane of cells is cut into square tiles. Encoding is twice: a convolution over 3 x 3
cells, ReLU, and the maximum of 2 x 2; so a tile needs the counts of ``HALO`` cells
around it, which each count brings to the tiles beside its own (one row for each tile it
reaches, nine at most). All tiles share the weights, and a cell on the border of a tile
gets the code that it would have on an untiled plane, where cells without trips are zero.
Decoding is twice a transposed convolution with a kernel as large as its stride, which
needs no neighbours.

A tile and hour without any trip near it has no row; all these have one and the same code
and decode alike, and training and errors count them as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripgrid.operators import training
from tripgrid.operators.cleaning import CITY
from tripgrid.operators.lookup import attach
from tripgrid.session import Staged, stage

TILE = 8
# Cells around a tile that its code depends on: one for the first convolution, and one
# pooled cell, which is two, for the second.
HALO = 3
POOLED = 4
CHANNELS = 2
# Tiles that are run through the network at a time.
CHUNK = 256


@dataclass(frozen=True)
class Shape:
    """The form of a network: channels between the convolutions, and channels of a code cell."""

    inner: int = 8
    code: int = 4
    tile: int = TILE

    def __post_init__(self) -> None:
        if self.tile % POOLED or self.tile < POOLED:
            raise ValueError(f"a tile's side must be a multiple of {POOLED}")

    @property
    def shapes(self) -> list[tuple[int, ...]]:
        """Kernels (rows of a patch, channels out) and offsets: two to encode, two to decode."""
        return [(9 * CHANNELS, self.inner), (self.inner,), (9 * self.inner, self.code), (self.code,), (self.code, 4 * self.inner), (self.inner,), (self.inner, 4 * CHANNELS), (CHANNELS,)]

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes)

    @property
    def code_size(self) -> int:
        return (self.tile // POOLED) ** 2 * self.code

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.shapes:
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape))
            at += n
        return out

    def fresh(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        drawn = [rng.uniform(-1, 1, s) / np.sqrt(s[0]) if len(s) > 1 else np.zeros(s) for s in self.shapes]
        return np.concatenate([d.ravel() for d in drawn])


@dataclass(frozen=True)
class ConvEncoder:
    """A trained network; counts are divided by ``scale`` before they are encoded."""

    shape: Shape
    weights: tuple[float, ...]
    scale: float = 1.0
    losses: tuple[float, ...] = ()


def _patches(x: np.ndarray) -> np.ndarray:
    """(n, a, b, c) to (n, a - 2, b - 2, 9 c): the 3 x 3 cells around each inner cell."""
    a, b = x.shape[1] - 2, x.shape[2] - 2
    return np.concatenate([x[:, i : i + a, j : j + b] for i in range(3) for j in range(3)], axis=3)


def _unpatched(d: np.ndarray) -> np.ndarray:
    """The derivative of ``_patches``."""
    n, a, b, wide = d.shape
    c = wide // 9
    out = np.zeros((n, a + 2, b + 2, c))
    for k in range(9):
        i, j = divmod(k, 3)
        out[:, i : i + a, j : j + b] += d[..., k * c : (k + 1) * c]
    return out


def _pool(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximum of 2 x 2 cells and which of the four it is, the first of equal ones."""
    n, a, b, c = x.shape
    four = x.reshape(n, a // 2, 2, b // 2, 2, c).transpose(0, 1, 3, 5, 2, 4).reshape(n, a // 2, b // 2, c, 4)
    which = four.argmax(axis=4)
    return np.take_along_axis(four, which[..., None], axis=4)[..., 0], which


def _unpooled(d: np.ndarray, which: np.ndarray) -> np.ndarray:
    n, a, b, c = d.shape
    four = np.zeros((n, a, b, c, 4))
    np.put_along_axis(four, which[..., None], d[..., None], axis=4)
    return four.reshape(n, a, b, c, 2, 2).transpose(0, 1, 4, 2, 5, 3).reshape(n, 2 * a, 2 * b, c)


def _widen(x: np.ndarray, kernel: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A transposed convolution with kernel and stride 2."""
    n, a, b, _ = x.shape
    c = len(offset)
    return (x @ kernel).reshape(n, a, b, 2, 2, c).transpose(0, 1, 3, 2, 4, 5).reshape(n, 2 * a, 2 * b, c) + offset


def _narrow(d: np.ndarray) -> np.ndarray:
    """The derivative of ``_widen`` for its products."""
    n, a, b, c = d.shape
    return d.reshape(n, a // 2, 2, b // 2, 2, c).transpose(0, 1, 3, 2, 4, 5).reshape(n, a // 2, b // 2, 4 * c)


def encoded(parts: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Codes (n, tile / 4, tile / 4, code) of tiles with their surroundings (n, tile + 6, tile + 6, 2)."""
    first = _patches(x)
    one = first @ parts[0] + parts[1]
    inner, which1 = _pool(np.maximum(one, 0))
    second = _patches(inner)
    two = second @ parts[2] + parts[3]
    code, which2 = _pool(np.maximum(two, 0))
    return code, (first, one, which1, second, two, which2)


def decoded(parts: list[np.ndarray], code: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Counts (n, tile, tile, 2) of codes."""
    wide = _widen(code, parts[4], parts[5])
    shown = np.maximum(wide, 0)
    return _widen(shown, parts[6], parts[7]), (wide, shown)


def gradient(shape: Shape, flat: np.ndarray, x: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Gradient and sum of squared errors of a batch of tiles with their surroundings, each counted ``weight`` times."""
    parts = shape.parts(flat)
    code, (first, one, which1, second, two, which2) = encoded(parts, x)
    out, (wide, shown) = decoded(parts, code)
    error = out - x[:, HALO:-HALO, HALO:-HALO]
    each = np.ones(len(x)) if weight is None else weight
    grads = [np.zeros_like(p) for p in parts]
    d = 2 * error * each[:, None, None, None]
    grads[7] = d.sum(axis=(0, 1, 2))
    d = _narrow(d)
    grads[6] = np.tensordot(shown, d, ([0, 1, 2], [0, 1, 2]))
    d = (d @ parts[6].T) * (wide > 0)
    grads[5] = d.sum(axis=(0, 1, 2))
    d = _narrow(d)
    grads[4] = np.tensordot(code, d, ([0, 1, 2], [0, 1, 2]))
    d = _unpooled(d @ parts[4].T, which2) * (two > 0)
    grads[3] = d.sum(axis=(0, 1, 2))
    grads[2] = np.tensordot(second, d, ([0, 1, 2], [0, 1, 2]))
    d = _unpooled(_unpatched(d @ parts[2].T), which1) * (one > 0)
    grads[1] = d.sum(axis=(0, 1, 2))
    grads[0] = np.tensordot(first, d, ([0, 1, 2], [0, 1, 2]))
    return np.concatenate([g.ravel() for g in grads]), float(((error**2).sum(axis=(1, 2, 3)) * each).sum())


def tiles(demand: DataFrame, tile: int = TILE, keys: Sequence[str] = CITY) -> DataFrame:
    """``hour, tx, ty, cells``: the counts in and around each tile, as (slot, cnt).

    Each count is sent to its own tile and to those whose surroundings it lies in. A row
    holds (tile + 6)² x 2 counts at most.
    """
    side, wide = tile, tile + 2 * HALO
    reach = lambda c: F.sequence(F.floor((F.col(c) - HALO) / side).cast("int"), F.floor((F.col(c) + HALO) / side).cast("int"))
    sent = demand.withColumn("tx", F.explode(reach("x"))).withColumn("ty", F.explode(reach("y")))
    dx, dy = F.col("x") - F.col("tx") * side + HALO, F.col("y") - F.col("ty") * side + HALO
    inside = (dx >= 0) & (dx < wide) & (dy >= 0) & (dy < wide)
    slot = ((dx * wide + dy) * CHANNELS + F.col("channel")).cast("int").alias("slot")
    placed = sent.filter(inside).select(*keys, "hour", "tx", "ty", F.struct(slot, F.col("cnt").cast("double").alias("cnt")).alias("cell"))
    return placed.groupBy(*keys, "hour", "tx", "ty").agg(F.collect_list("cell").alias("cells"))


def _dense(batch: pa.RecordBatch, tile: int, scale: float) -> np.ndarray:
    wide = tile + 2 * HALO
    cells = batch.column("cells")
    row = np.repeat(np.arange(batch.num_rows), cells.value_lengths().to_numpy(zero_copy_only=False))
    flat = cells.flatten()
    out = np.zeros((batch.num_rows, wide * wide * CHANNELS))
    # A set may list a cell twice; both count.
    np.add.at(out, (row, flat.field("slot").to_numpy(zero_copy_only=False)), flat.field("cnt").to_numpy(zero_copy_only=False) / scale)
    return out.reshape(batch.num_rows, wide, wide, CHANNELS)


def _quiet(shape: Shape) -> np.ndarray:
    wide = shape.tile + 2 * HALO
    return np.zeros((1, wide, wide, CHANNELS))


def quiet_rows(held: DataFrame, hours: DataFrame | Staged, keys: Sequence[str] = CITY) -> int:
    """How many tiles and hours have no row, among tiles that have one in some hour; ``hours`` gives ``n`` per set."""
    seen = held.groupBy(*keys, "tx", "ty").agg(F.count(F.lit(1)).alias("seen"))
    return int(attach(seen, hours, keys).agg(F.sum(F.col("n") - F.col("seen"))).first()[0] or 0)


def fit_conv_encoder(
    demand: DataFrame,
    hours: DataFrame | Staged,
    shape: Shape = Shape(),
    keys: Sequence[str] = CITY,
    passes: int = 10,
    steps: int = 4,
    rate: float = 0.01,
    seed: int = 0,
    path: str | None = None,
    start: ConvEncoder | None = None,
) -> ConvEncoder:
    """Train on sparse counts (``hour, channel, x, y, cnt``); ``hours`` gives ``n`` hours per set, empty ones included.

    With ``path`` every pass is kept there and training goes on behind the last one.
    """
    dealt = tiles(demand, shape.tile, keys).withColumn("step", F.pmod(F.xxhash64(*keys, "hour", "tx", "ty"), F.lit(steps)).cast("int"))
    held = stage(dealt.sortWithinPartitions("step"), "tiles")
    if start is None:
        found = demand.agg(F.sum(F.col("cnt").cast("double") * F.col("cnt")).alias("s"), F.count(F.lit(1)).alias("n")).first()
        scale = float(np.sqrt((found["s"] or 0.0) / max(found["n"], 1))) or 1.0
    else:
        scale = start.scale
    quiet = quiet_rows(held.df, hours, keys)
    pixels = shape.tile**2 * CHANNELS

    def own(flat: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, float, float]:
        total, loss = np.zeros(shape.size), 0.0
        for at in range(0, batch.num_rows, CHUNK):
            grad, squared = gradient(shape, flat, _dense(batch.slice(at, CHUNK), shape.tile, scale))
            total, loss = total + grad, loss + squared
        return total, loss, float(batch.num_rows * pixels)

    def empty(flat: np.ndarray) -> tuple[np.ndarray, float, float]:
        grad, squared = gradient(shape, flat, _quiet(shape), np.array([float(quiet)]))
        return grad, squared, float(quiet * pixels)

    begun = shape.fresh(seed) if start is None else np.array(start.weights)
    state = training.train(held.df, begun, own, passes, steps, rate, path, ready=empty)
    return ConvEncoder(shape, tuple(map(float, state.weights)), scale, state.losses)


def _mapped(held: DataFrame, encoder: ConvEncoder, rest: list[str], name: str, of) -> DataFrame:
    """``rest`` and an array ``name`` that ``of`` makes from the rows of each Arrow batch."""
    schema = T.StructType([held.schema[c] for c in rest]).add(name, T.ArrayType(T.DoubleType()))
    parts = encoder.shape.parts(np.array(encoder.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                values = of(parts, part).reshape(part.num_rows, -1)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * values.shape[1])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], [*rest, name])

    return held.mapInArrow(run, schema)


def encode_tiles(demand: DataFrame, encoder: ConvEncoder, keys: Sequence[str] = CITY) -> DataFrame:
    """``hour, tx, ty, z``: the code of every tile and hour with a trip in it or around it.

    ``z`` has ``code`` numbers for each 4 x 4 cells, by x, then y.
    """
    shape, scale = encoder.shape, encoder.scale
    of = lambda parts, batch: encoded(parts, _dense(batch, shape.tile, scale))[0]
    return _mapped(tiles(demand, shape.tile, keys), encoder, [*keys, "hour", "tx", "ty"], "z", of)


def quiet_code(encoder: ConvEncoder) -> np.ndarray:
    """The code of a tile without any trip near it."""
    return encoded(encoder.shape.parts(np.array(encoder.weights)), _quiet(encoder.shape))[0].ravel()


def decode_tiles(latent: DataFrame, encoder: ConvEncoder, keys: Sequence[str] = CITY) -> DataFrame:
    """``hour, x, y, channel, yhat`` for every cell of the tiles in ``latent``."""
    shape, scale = encoder.shape, encoder.scale
    side, cells = shape.tile, shape.tile // POOLED

    def of(parts: list[np.ndarray], batch: pa.RecordBatch) -> np.ndarray:
        z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, cells, cells, shape.code)
        return decoded(parts, z)[0] * scale

    rest = [*keys, "hour", "tx", "ty"]
    each = _mapped(latent, encoder, rest, "yhat", of).select(*rest, F.posexplode("yhat").alias("at", "yhat"))
    cell = F.floor(F.col("at") / CHANNELS)
    x, y = F.col("tx") * side + F.floor(cell / side), F.col("ty") * side + F.pmod(cell, F.lit(side))
    return each.select(*keys, "hour", x.cast("int").alias("x"), y.cast("int").alias("y"), F.pmod("at", F.lit(CHANNELS)).cast("int").alias("channel"), "yhat")


def conv_mse(demand: DataFrame, encoder: ConvEncoder, hours: DataFrame | Staged, keys: Sequence[str] = CITY) -> DataFrame:
    """``mse`` of decode(encode(demand)) per set, over all cells of tiles that have a row in some hour, and all ``n`` hours."""
    shape, scale = encoder.shape, encoder.scale
    rest = [*keys, "tx", "ty"]

    def of(parts: list[np.ndarray], batch: pa.RecordBatch) -> np.ndarray:
        x = _dense(batch, shape.tile, scale)
        error = (decoded(parts, encoded(parts, x)[0])[0] - x[:, HALO:-HALO, HALO:-HALO]) * scale
        return (error**2).sum(axis=(1, 2, 3))

    scored = _mapped(tiles(demand, shape.tile, keys), encoder, rest, "se", of)
    per_tile = scored.groupBy(*rest).agg(F.sum(F.get("se", F.lit(0))).alias("se"), F.count(F.lit(1)).alias("seen"))
    parts = shape.parts(np.array(encoder.weights))
    quiet = float(((decoded(parts, quiet_code(encoder).reshape(1, shape.tile // POOLED, shape.tile // POOLED, shape.code))[0] * scale) ** 2).sum())
    sized = attach(per_tile, hours, keys)
    total = sized.groupBy(*keys).agg(
        F.sum(F.col("se") + (F.col("n") - F.col("seen")) * quiet).alias("se"), F.sum(F.col("n") * (shape.tile**2 * CHANNELS)).alias("n")
    )
    return total.select(*keys, F.try_divide("se", F.col("n").cast("double")).alias("mse"))
