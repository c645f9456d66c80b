"""The convolutional grid encoder: tiles with borders, derivatives, training, errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripgrid.operators import conv
from tripgrid.session import stage

SMALL = conv.Shape(inner=3, code=2, tile=8)


@pytest.fixture(scope="module")
def demand(spark):
    """Some busy cells on both sides of tile borders, also at negative places, over 30 hours."""
    rng = np.random.default_rng(8)
    rows = {(int(h), int(c), int(x), int(y)) for h, c, x, y in zip(rng.integers(0, 30, 900), rng.integers(0, 2, 900), rng.integers(-9, 20, 900), rng.integers(-3, 18, 900))}
    data = [("a", *r, 1 + sum(r) % 5) for r in sorted(rows)]
    return spark.createDataFrame(data, "city string, hour int, channel int, x int, y int, cnt long")


@pytest.fixture(scope="module")
def hours(spark):
    return stage(spark.createDataFrame([("a", 30)], "city string, n long"), "hours")


@pytest.fixture(scope="module")
def encoder():
    return conv.ConvEncoder(SMALL, tuple(SMALL.fresh(4) + 0.05), 2.5)


def plane(demand, hour, low, side):
    grid = np.zeros((1, side, side, 2))
    for r in demand.where(F.col("hour") == hour).collect():
        grid[0, r["x"] - low, r["y"] - low, r["channel"]] += r["cnt"]
    return grid


def test_tiles_equal_the_untiled_grid(demand, encoder):
    """One network over the whole plane gives the same codes, on borders of tiles too."""
    parts = SMALL.parts(np.array(encoder.weights))
    found = {(r["hour"], r["tx"], r["ty"]): np.array(r["z"]).reshape(2, 2, 2) for r in conv.encode_tiles(demand, encoder).collect()}
    for hour in (0, 7, 29):
        # From cell -16 - 3 to 24 + 3: tiles -2 to 2 and what surrounds them.
        code = conv.encoded(parts, plane(demand, hour, -16 - conv.HALO, 40 + 2 * conv.HALO) / encoder.scale)[0][0]
        for tx in range(-2, 3):
            for ty in range(-2, 3):
                want = code[2 * (tx + 2) : 2 * (tx + 3), 2 * (ty + 2) : 2 * (ty + 3)]
                got = found.get((hour, tx, ty))
                got = conv.quiet_code(encoder).reshape(2, 2, 2) if got is None else got
                assert np.allclose(got, want, atol=1e-12)


def plain_code(shape, weights, grid):
    """Loops over cells, kernels and channels, straight from the definition."""
    k1, b1, k2, b2 = conv.Shape.parts(shape, weights)[:4]
    out = grid
    for kernel, offset in ((k1, b1), (k2, b2)):
        n = out.shape[0] - 2
        new = np.zeros((n, n, len(offset)))
        for i in range(n):
            for j in range(n):
                new[i, j] = np.maximum(sum(out[i + a, j + b] @ kernel[(3 * a + b) * out.shape[2] : (3 * a + b + 1) * out.shape[2]] for a in range(3) for b in range(3)) + offset, 0)
        out = np.array([[new[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].max(axis=(0, 1)) for j in range(n // 2)] for i in range(n // 2)])
    return out


def test_network_equals_plain_loops(encoder):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 2, (2, 14, 14, 2)) * (rng.uniform(size=(2, 14, 14, 2)) < 0.3)
    weights = np.array(encoder.weights)
    code = conv.encoded(SMALL.parts(weights), x)[0]
    assert np.allclose(code[1], plain_code(SMALL, weights, x[1]))
    k3, b3, k4, b4 = SMALL.parts(weights)[4:]
    out = conv.decoded(SMALL.parts(weights), code)[0]
    for i in (0, 3, 7):
        for j in (0, 2, 5):
            mid = np.maximum(code[0, i // 4, j // 4] @ k3[:, ((i // 2) % 2 * 2 + (j // 2) % 2) * 3 :][:, :3] + b3, 0)
            assert np.allclose(out[0, i, j], mid @ k4[:, (i % 2 * 2 + j % 2) * 2 :][:, :2] + b4)


def test_gradient_against_differences():
    rng = np.random.default_rng(5)
    flat = SMALL.fresh(2) + 0.03
    x = rng.uniform(0, 2, (3, 14, 14, 2)) * (rng.uniform(size=(3, 14, 14, 2)) < 0.4)
    weight = np.array([1.0, 3.0, 0.5])
    grad, _ = conv.gradient(SMALL, flat, x, weight)
    for i in range(0, SMALL.size, 5):
        step = np.zeros(SMALL.size)
        step[i] = 1e-6
        up, down = (conv.gradient(SMALL, flat + s, x, weight)[1] for s in (step, -step))
        assert abs((up - down) / 2e-6 - grad[i]) < 1e-4 * max(1, abs(grad[i]))


def test_errors_count_quiet_tiles(demand, encoder, hours):
    codes = conv.encode_tiles(demand, encoder)
    back = {(r["hour"], r["x"], r["y"], r["channel"]): r["yhat"] for r in conv.decode_tiles(codes, encoder).collect()}
    counts = {(r["hour"], r["x"], r["y"], r["channel"]): r["cnt"] for r in demand.collect()}
    seen = {(r["tx"], r["ty"]) for r in codes.collect()}
    quiet = conv.decoded(SMALL.parts(np.array(encoder.weights)), conv.quiet_code(encoder).reshape(1, 2, 2, 2))[0][0] * encoder.scale
    errors = []
    for tx, ty in seen:
        for h in range(30):
            for i in range(8):
                for j in range(8):
                    for c in range(2):
                        at = (h, 8 * tx + i, 8 * ty + j, c)
                        errors.append((back.get(at, quiet[i, j, c]) - counts.get(at, 0)) ** 2)
    assert np.isclose(conv.conv_mse(demand, encoder, hours).first()["mse"], np.mean(errors))


def test_training_lowers_the_error_and_goes_on(spark, demand, hours, tmp_path):
    how = {"steps": 2, "rate": 0.02}
    whole = conv.fit_conv_encoder(demand, hours, SMALL, passes=6, **how)
    assert whole.losses[-1] < whole.losses[0]
    # The loss of a pass is the error of its weights, in scaled counts.
    first = conv.fit_conv_encoder(demand, hours, SMALL, passes=1, steps=1)
    start = conv.ConvEncoder(SMALL, tuple(SMALL.fresh(0)), first.scale)
    assert np.isclose(first.losses[0] * first.scale**2, conv.conv_mse(demand, start, hours).first()["mse"])
    path = str(tmp_path / "conv")
    conv.fit_conv_encoder(demand, hours, SMALL, passes=2, path=path, **how)
    again = conv.fit_conv_encoder(demand.repartition(5), hours, SMALL, passes=6, path=path, **how)
    assert np.allclose(again.weights, whole.weights, atol=1e-8) and len(again.losses) == 6


def test_odd_tables(demand, encoder, hours):
    none = demand.limit(0)
    assert conv.encode_tiles(none, encoder).count() == 0
    assert conv.conv_mse(none, encoder, hours).count() == 0
    with pytest.raises(ValueError, match="multiple"):
        conv.Shape(tile=6)
