from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripgrid.checks import queries
from tripgrid.functions.encoding import time_features
from tripgrid.operators import evaluate, forecast, latent, series
from tripgrid.operators.forecast import _calendar
from tripgrid.session import shared_dir

HOURS = 480


@pytest.fixture(scope="module")
def seasonal(spark):
    """Six cells with a daily wave each; no random numbers."""
    wave = F.transform(
        F.sequence(F.lit(0), F.lit(HOURS - 1)),
        lambda h: F.round(20 + 3 * F.col("x") + 10 * F.sin((h + F.col("x")) * 2 * np.pi / 24)).cast("long"),
    )
    cells = spark.range(6).select(F.lit("a").alias("city"), F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("channel"))
    return cells.select("*", F.lit(473352).cast("long").alias("first_hour"), wave.alias("series"))


def squared_error(aligned):
    return aligned.agg(F.avg(F.pow(F.col("yhat") - F.col("actual"), F.lit(2)))).first()[0]


@pytest.fixture(scope="module")
def parts(seasonal):
    return series.split_series(seasonal, 0.8)


@pytest.mark.parametrize("kind", ["linear", "gbt"])
def test_forecast_beats_repeating_the_last_value(spark, parts, kind):
    train, test = parts
    lags = (1, 2, 24)
    fitted = forecast.fit_forecaster(series.lag_features(train, lags), lags, kind, trees=5)
    cut = series.sliding_windows(test, 24, 12)
    aligned = forecast.forecast_windows(cut, fitted, 24, 12)
    last = cut.select(F.element_at("features", -1).alias("yhat"), F.explode("labels").alias("actual"))
    assert aligned.count() == cut.count() * 12
    assert squared_error(aligned) < squared_error(last) / 2


@pytest.mark.parametrize("kind", ["linear", "gbt"])
def test_roll_out_equals_the_model_step_by_step(spark, parts, kind):
    """Every step, recomputed row by row from the model's numbers."""
    train, test = parts
    lags = (1, 3)
    fitted = forecast.fit_forecaster(series.lag_features(train, lags), lags, kind, trees=4)
    cut = series.sliding_windows(test, 6, 3)
    got = forecast.forecast_windows(cut, fitted, 6, 3).collect()
    found = {(r["x"], r["idx"], r["step"]): r["yhat"] for r in got}

    def predict(values):
        if kind == "linear":
            return sum(w * v for w, v in zip(fitted.weights, values)) + fitted.weights[-1]
        total = 0.0
        for t in fitted.trees:
            n = 0
            while t.feature[n] >= 0:
                n = t.left[n] if values[t.feature[n]] <= t.threshold[n] else t.right[n]
            total += t.weight * t.value[n]
        return total

    assert len(found) == cut.count() * 3
    for r in cut.collect():
        known = list(map(float, r["features"]))
        for step in range(3):
            at = datetime.fromtimestamp((r["first_hour"] + r["idx"] + 6 + step) * 3600, timezone.utc)
            flags = [at.weekday() == d for d in range(1, 7)] + [at.month == m for m in range(2, 13)]
            known.append(predict([known[-k] for k in lags] + flags + [at.hour / 23]))
            assert found[r["x"], r["idx"], step] == pytest.approx(known[-1], abs=1e-9)


def test_fit_equals_numpy_least_squares(spark, seasonal):
    rows = series.lag_features(seasonal, (1, 2)).collect()
    use = [i for i in forecast.CALENDAR if len({r["time_features"][i] for r in rows}) > 1]
    x = np.array([[*r["lags"], *[r["time_features"][i] for i in use], 1.0] for r in rows])
    y = np.array([r["label"] for r in rows])
    best = np.linalg.lstsq(x, y, rcond=None)[0]
    fitted = forecast.fit_forecaster(series.lag_features(seasonal, (1, 2)), (1, 2))
    weights = dict(zip([("lag", 1), ("lag", 2), *forecast.CALENDAR, "intercept"], fitted.weights))
    got = [weights[k] for k in [("lag", 1), ("lag", 2), *use, "intercept"]]
    assert np.allclose(got, best, atol=1e-4)
    assert fitted.losses[0] == pytest.approx(np.mean((x @ best - y) ** 2), rel=1e-4)


@pytest.mark.parametrize("kind", ["linear", "gbt"])
def test_training_goes_on_from_a_saved_model(spark, parts, kind):
    train, _ = parts
    rows = series.lag_features(train, (1, 24))
    first = forecast.fit_forecaster(rows, (1, 24), kind, max_iter=2, solver="l-bfgs", trees=2)
    more = forecast.fit_forecaster(rows, (1, 24), kind, max_iter=30, solver="l-bfgs", trees=2, start=first)
    error = lambda m: forecast._residuals(rows, m).agg(F.avg(F.pow("label", F.lit(2)))).first()[0]
    assert error(more) < error(first)
    if kind == "gbt":
        assert more.trees[:2] == first.trees and len(more.trees) == 4
    with pytest.raises(ValueError, match="other inputs"):
        forecast.fit_forecaster(rows, (1, 2), kind, start=first)


def test_calendar_inputs_agree_with_the_column_function(spark):
    hours = spark.range(470_000, 490_000, 13).select("id", time_features(F.timestamp_seconds(F.col("id") * 3600)).alias("tf"))
    table = hours.toPandas()
    assert np.allclose(_calendar(table["id"].to_numpy()), np.stack(table["tf"].to_list()))


def test_unknown_kind_and_short_windows(spark, parts):
    train, test = parts
    with pytest.raises(ValueError, match="unknown forecaster"):
        forecast.fit_forecaster(train, (1,), "x")
    fitted = forecast.fit_forecaster(series.lag_features(train, (1, 24)), (1, 24))
    with pytest.raises(Exception, match="shorter than the longest lag"):
        forecast.forecast_windows(series.sliding_windows(test, 6, 3), fitted, 6, 3).collect()


@pytest.mark.parametrize("kind", ["linear", "gbt"])
def test_save_and_load(spark, parts, kind):
    train, test = parts
    path = f"{shared_dir(spark)}/model-{kind}"
    assert forecast.load_forecaster(spark, path) is None
    fitted = forecast.fit_forecaster(series.lag_features(train, (1, 2)), (1, 2), kind, max_iter=5, solver="l-bfgs", trees=3)
    assert len(fitted.losses) > 1 and fitted.losses[-1] < fitted.losses[0]
    forecast.save_forecaster(spark, fitted, path)
    forecast.save_forecaster(spark, fitted, path)
    history = [tuple(r) for r in forecast.loss_history(spark, path).orderBy("pass").collect()]
    assert history == list(enumerate(fitted.losses * 2))
    loaded = forecast.load_forecaster(spark, path)
    cut = series.sliding_windows(test, 6, 3)
    same = forecast.forecast_windows(cut, fitted, 6, 3).exceptAll(forecast.forecast_windows(cut, loaded, 6, 3))
    assert same.count() == 0


@pytest.fixture(scope="module")
def small_grid(spark):
    """Counts on 5 x 3 cells for 40 hours, spread over several tiles of side 2."""
    h = F.col("id")
    return spark.range(40 * 12).select(
        F.lit("a").alias("city"), (h % 40).alias("hour"), (h % 2).cast("int").alias("channel"),
        ((h * 7) % 5).cast("int").alias("x"), ((h * 11) % 3).cast("int").alias("y"),
    ).groupBy("city", "hour", "channel", "x", "y").agg(F.count("*").alias("cnt"))


def tile_matrix(rows, tx, ty, n):
    m = np.zeros((n, 8))
    for r in rows:
        if (r.x // 2, r.y // 2) == (tx, ty):
            m[r.hour, ((r.x % 2) * 2 + r.y % 2) * 2 + r.channel] = r.cnt
    return m


@pytest.mark.parametrize("block", [1024, 7])
def test_encoder_equals_numpy_components(spark, small_grid, block, monkeypatch):
    monkeypatch.setattr(latent, "BLOCK_HOURS", block)
    n = spark.createDataFrame([("a", 50)], "city string, n long")
    encoder = latent.fit_encoder(small_grid, n, k=2, tile=2)
    got = latent.reconstruction_mse(small_grid, encoder, n).first()["mse"]
    rows, total, cells = small_grid.collect(), 0.0, 0
    for tx in range(3):
        for ty in range(2):
            m = tile_matrix(rows, tx, ty, 50)
            m = m[:, m.any(axis=0)]
            mean = m.mean(axis=0)
            _, vectors = np.linalg.eigh(np.cov(m.T, bias=True).reshape(m.shape[1], -1))
            top = vectors[:, ::-1][:, :2]
            total += (((m - mean) @ top @ top.T + mean - m) ** 2).sum()
            cells += m.size
    assert got == pytest.approx(total / cells, abs=1e-9)


def test_full_rank_encoding_is_lossless(spark, small_grid):
    n = spark.createDataFrame([("a", 40)], "city string, n long")
    encoder = latent.fit_encoder(small_grid, n, k=8, tile=2)
    assert latent.reconstruction_mse(small_grid, encoder, n).first()["mse"] == pytest.approx(0, abs=1e-12)
    back = latent.decode_grid(latent.encode_grid(small_grid, encoder), encoder)
    place = ["city", "hour", "x", "y", "channel"]
    off = back.join(small_grid, place, "left").where(F.abs(F.col("yhat") - F.coalesce("cnt", F.lit(0))) > 1e-9)
    assert back.count() >= small_grid.count() and off.count() == 0
    with pytest.raises(ValueError):
        latent.fit_encoder(small_grid, n, k=9, tile=2)


@pytest.fixture
def own_counts(spark, small_grid, monkeypatch):
    """Registered queries on ``small_grid``, whose tiles of four are 4 x 3 cells and 1 x 3 cells; 51 hours."""
    monkeypatch.setattr(queries, "_counts", lambda spark, sf: small_grid)
    monkeypatch.setattr(queries, "_hours_n", lambda spark, sf: spark.createDataFrame([("a", 51)], "city string, n long"))
    return {(r.hour, r.channel, r.x, r.y): r.cnt for r in small_grid.collect()}


def covariances(counts):
    known = sorted({c[1:] for c in counts})
    grid = np.array([[counts.get((h, *c), 0) for c in known] for h in range(51)], float)
    tile = np.array([c[1] // 4 for c in known])
    return known, grid, tile, np.cov(grid.T, bias=True) * (tile[:, None] == tile)


def test_encode_grid_gives_the_spread_along_each_code(spark, own_counts):
    known, grid, tile, cov = covariances(own_counts)
    want = {}
    for h in range(51):
        for t in (0, 1):
            x = grid[h] * (tile == t)
            if x.any():
                want[h, t, 0] = (x @ x, np.sqrt(x @ cov @ x / (x @ x)))
    got = {(r.hour, r.tx, r.ty): (r.energy, r.spread) for r in queries.QUERIES["encode_grid"](spark, "own-encode").collect()}
    assert got.keys() == want.keys()
    for place, pair in want.items():
        assert got[place] == pytest.approx(pair, abs=2e-6)


def test_decode_grid_gives_quiet_cells_too(spark, own_counts):
    known, grid, tile, cov = covariances(own_counts)
    want = {}
    for h in range(51):
        for i, place in enumerate(known):
            if grid[h][tile == tile[i]].any():
                want[(h, *place)] = (grid[h, i], round(cov[i] @ grid[h] * 51 * 51))
    assert any(cnt == 0 for cnt, _ in want.values())
    rows = queries.QUERIES["decode_grid"](spark, "own-decode").collect()
    assert {(r.hour, r.channel, r.x, r.y): (r.yhat, r.shared) for r in rows} == want and len(rows) == len(want)


def test_nth_sample_falls_back_to_the_last(spark):
    df = spark.createDataFrame([("a", i, 0) for i in range(30)] + [("b", i, 0) for i in range(5)], "city string, idx long, step int")
    got = sorted(tuple(r) for r in evaluate.nth_sample(df).collect())
    assert got == [("a", 20, 0), ("b", 4, 0)]


def test_cells_the_encoder_never_saw_count(spark):
    schema = "city string, hour long, channel int, x int, y int, cnt long"
    train = spark.createDataFrame([("a", h, 0, 0, 0, h % 3) for h in range(6)], schema)
    test = spark.createDataFrame([("a", 0, 0, 0, 0, 2), ("a", 1, 0, 9, 9, 3), ("a", 2, 1, 0, 0, 4)], schema)
    n = spark.createDataFrame([("a", 6)], "city string, n long")
    encoder = latent.fit_encoder(train, n, k=1, tile=2)
    # The known cell is coded without loss; 9 and 16 are lost over three cells and six hours.
    assert latent.reconstruction_mse(test, encoder, n).first()["mse"] == pytest.approx(25 / 18)


@pytest.mark.parametrize("kind", ["linear", "gru"])
def test_series_forecast_like_their_windows(parts, kind):
    """Windows by reference: the same rows, and no window travels."""
    train, test = parts
    if kind == "linear":
        fitted = forecast.fit_forecaster(series.lag_features(train, (1, 24)), (1, 24))
    else:
        fitted = forecast.Forecaster("gru", (24,), tuple(forecast.recurrent.Network("gru", 4).fresh(1)), hidden=4, scale=9.0)
    for gap, whole in ((0, False), (1, False), (0, True)):
        want = forecast.forecast_windows(series.sliding_windows(test, 24, 5, gap, whole), fitted, 24, 5, gap)
        got = forecast.forecast_series(test, fitted, 24, 5, gap, whole)
        key = lambda r: (r["x"], r["idx"], r["step"])
        a, b = (sorted((r.asDict() for r in df.collect()), key=key) for df in (want, got))
        assert [key(r) for r in a] == [key(r) for r in b] and len(a) > 0
        assert [r["actual"] for r in a] == [r["actual"] for r in b]
        assert np.allclose([r["yhat"] for r in a], [r["yhat"] for r in b])


def test_window_index_holds_each_value_about_twice(seasonal):
    """Whatever the window and the horizon, up to half of the series."""
    for w, f in ((24, 5), (100, 60)):
        rows = series.window_index(seasonal, w, f).collect()
        assert sum(r["len"] for r in rows) == 6 * (HOURS - w - f)
        assert sum(len(r["part"]) for r in rows) <= 2.1 * 6 * HOURS
        want = {(r["x"], r["idx"]): (r["features"], r["labels"]) for r in series.sliding_windows(seasonal, w, f).where("x = 2").collect()}
        for r in rows:
            if r["x"] == 2:
                for k in range(0, r["len"], 37):
                    assert (r["part"][k : k + w], r["part"][k + w : k + w + f]) == want[2, r["from"] + k]
    with pytest.raises(ValueError, match="longest lag"):
        forecast.forecast_series(seasonal, forecast.Forecaster("linear", (30,), (1.0, 0.0), calendar=False), 24, 5)
