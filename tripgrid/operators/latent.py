"""Short latent vectors for hourly grids, and back.

The grid is cut into square tiles, and each tile has its own principal components
over its cells and both channels. A tile has a fixed number of columns, so its
covariance is small however large the city is, and tiles are independent.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripgrid.operators.cleaning import CITY
from tripgrid.operators.lookup import BROADCAST_ROWS, attach, lookup_join
from tripgrid.session import Staged, stage

TILE = 8
# Hours summarised by one task at a time.
BLOCK_HOURS = 1024


@dataclass(frozen=True)
class GridEncoder:
    """``cells``: x, y, channel, tx, ty, base and one loading per component."""

    k: int
    tile: int
    cells: Staged

    @property
    def broadcast_rows(self) -> int:
        """Rows of ``cells`` that weigh as much as a broadcast of plain lookup rows."""
        return BROADCAST_ROWS * 8 // (8 + self.k)


def _tiled(demand: DataFrame, tile: int) -> DataFrame:
    side = F.lit(tile)
    slot = (F.pmod("x", side) * tile + F.pmod("y", side)) * 2 + F.col("channel")
    return demand.withColumns(
        {
            "tx": F.floor(F.col("x") / side).cast("int"),
            "ty": F.floor(F.col("y") / side).cast("int"),
            "slot": slot.cast("int"),
        }
    )


def fit_encoder(
    demand: DataFrame, hours: DataFrame | Staged, k: int = 2, tile: int = TILE, keys: Sequence[str] = CITY
) -> GridEncoder:
    """Principal components per tile. ``hours`` gives ``n`` hours per set, empty ones included.

    First every block of hours of a tile is reduced to sums and products of its
    columns; then the blocks of a tile are added up and decomposed.
    """
    width = tile * tile * 2
    if not 1 <= k <= width:
        raise ValueError(f"k must be between 1 and {width}")
    keys = list(keys)
    base = _tiled(demand, tile).select(
        *keys, "tx", "ty", "slot", "hour", "cnt", F.floor(F.col("hour") / BLOCK_HOURS).cast("int").alias("block")
    )
    place = ", ".join(f"{c} {t}" for c, t in base.dtypes if c in keys) + (", " if keys else "") + "tx int, ty int"
    names = [*keys, "tx", "ty"]

    def moments(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, at = np.unique(pdf["hour"].to_numpy(), return_inverse=True)
        grid = np.zeros((len(rows), width))
        grid[at, pdf["slot"].to_numpy()] = pdf["cnt"].to_numpy()
        out = pdf.iloc[:1][names].copy()
        out["sums"] = [grid.sum(axis=0)]
        out["products"] = [(grid.T @ grid).ravel()]
        return out

    partial = base.groupBy(*names, "block").applyInPandas(
        moments, f"{place}, sums array<double>, products array<double>"
    )
    sized = attach(partial, hours, keys)

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        n = float(pdf["n"].iloc[0])
        mean = np.sum(np.stack(pdf["sums"].to_list()), axis=0) / n
        second = np.sum(np.stack(pdf["products"].to_list()), axis=0).reshape(width, width) / n
        used = np.flatnonzero(np.diag(second))
        cov = (second - np.outer(mean, mean))[np.ix_(used, used)]
        _, vectors = np.linalg.eigh(cov)
        top = np.zeros((len(used), k))
        found = min(k, len(used))
        top[:, :found] = vectors[:, ::-1][:, :found]
        largest = np.abs(top).argmax(axis=0)
        top *= np.where(top[largest, np.arange(k)] < 0, -1.0, 1.0)
        quiet = mean[used] - top @ (top.T @ mean[used])
        out = pd.concat([pdf.iloc[:1][names]] * len(used), ignore_index=True)
        cell, channel = used // 2, used % 2
        out["x"] = out["tx"] * tile + cell // tile
        out["y"] = out["ty"] * tile + cell % tile
        out["channel"] = channel
        out["base"] = quiet
        out["loadings"] = list(top)
        return out

    cells = sized.groupBy(*names).applyInPandas(
        decompose, f"{place}, x int, y int, channel int, base double, loadings array<double>"
    )
    return GridEncoder(k, tile, stage(cells, "encoder"))


def encode_grid(demand: DataFrame, encoder: GridEncoder, keys: Sequence[str] = CITY) -> DataFrame:
    """``hour, tx, ty, z``: the projections of each tile that had trips in the hour.

    A tile without trips projects to zero and has no row. Cells the encoder never saw
    do not contribute.
    """
    cells = encoder.cells
    loadings = Staged(cells.df.select(*keys, "x", "y", "channel", "tx", "ty", "loadings"), cells.rows, cells.path)
    weighted = lookup_join(demand, loadings, [*keys, "x", "y", "channel"], max_rows=encoder.broadcast_rows)
    parts = [F.sum(F.col("cnt") * F.get("loadings", F.lit(i))) for i in range(encoder.k)]
    return weighted.groupBy(*keys, "hour", "tx", "ty").agg(F.array(*parts).alias("z"))


def component_variances(latent: DataFrame, encoder: GridEncoder, hours: DataFrame | Staged, keys: Sequence[str] = CITY) -> DataFrame:
    """``tx, ty, variances``: how far each component of a tile varies over all ``n`` hours.

    ``latent`` has the codes of the counts that the encoder was fitted on. In the hours a
    tile is absent from it, its code is zero.
    """
    codes = [F.get("z", F.lit(i)) for i in range(encoder.k)]
    sums, squares = ([F.sum(c) for c in columns] for columns in (codes, [c * c for c in codes]))
    held = latent.groupBy(*keys, "tx", "ty").agg(F.array(*sums).alias("sums"), F.array(*squares).alias("squares"))
    variance = F.zip_with("sums", "squares", lambda s, q: q / F.col("n") - (s / F.col("n")) * (s / F.col("n")))
    return attach(held, hours, keys).select(*keys, "tx", "ty", variance.alias("variances"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def decode_grid(latent: DataFrame, encoder: GridEncoder, keys: Sequence[str] = CITY) -> DataFrame:
    """``hour, x, y, channel, yhat`` for every known cell of the tiles in ``latent``.

    In the hours a tile is absent from ``latent``, its cells decode to ``base``.
    """
    wide = lookup_join(latent, encoder.cells, [*keys, "tx", "ty"], max_rows=encoder.broadcast_rows)
    return wide.select(
        *keys, "hour", "x", "y", "channel", (F.col("base") + _dot(F.col("loadings"), F.col("z"))).alias("yhat")
    )


def reconstruction_mse(
    demand: DataFrame, encoder: GridEncoder, hours: DataFrame | Staged, keys: Sequence[str] = CITY
) -> DataFrame:
    """``mse`` of decode(encode(demand)) over all cells and all ``n`` hours.

    Nothing is decoded. The loadings of a tile are orthonormal and ``base`` is
    orthogonal to them, so the squared error of an hour is cnt² - z² - 2 cnt base +
    base², each summed over the tile. A cell the encoder never saw decodes to zero: it
    adds its cnt² and counts like the others.
    """
    cells = encoder.cells
    place = [*keys, "x", "y", "channel"]
    bases = Staged(cells.df.select(*place, F.col("base").alias("__base")), cells.rows, cells.path)
    beside = lookup_join(demand.select(*place, "cnt"), bases, place, "left", max_rows=encoder.broadcast_rows)
    # Counts are combined per cell first, so a busy cell is one row per task.
    seen = beside.groupBy(*place).agg(
        F.sum(F.pow(F.col("cnt"), F.lit(2)) - 2 * F.col("cnt") * F.coalesce("__base", F.lit(0.0))).alias("se"),
        F.max(F.col("__base").isNull().cast("int")).alias("cells"),
    )
    energy = encode_grid(demand, encoder, keys).select(*keys, (-_dot(F.col("z"), F.col("z"))).alias("se"))
    quiet = cells.df.select(*keys, F.pow("base", F.lit(2)).alias("quiet"))
    zero, none = F.lit(0.0), F.lit(0)
    parts = [
        seen.select(*keys, "se", zero.alias("quiet"), "cells"),
        energy.select(*keys, "se", zero.alias("quiet"), none.alias("cells")),
        quiet.select(*keys, zero.alias("se"), "quiet", F.lit(1).alias("cells")),
    ]
    total = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(
        F.sum("se").alias("se"), F.sum("quiet").alias("quiet"), F.sum("cells").alias("cells")
    )
    sized = attach(total, hours, keys)
    error = F.greatest(F.col("se") + F.col("quiet") * F.col("n"), F.lit(0.0))
    return sized.select(*keys, F.try_divide(error, (F.col("cells") * F.col("n")).cast("double")).alias("mse"))
