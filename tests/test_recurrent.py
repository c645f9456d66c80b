"""Recurrent forecasters: derivatives, training over many tasks, stopped runs, roll-out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripgrid.functions.calendar import CALENDAR, calendar
from tripgrid.operators import forecast, recurrent, series, training
from tripgrid.session import path_exists, remove

KINDS = sorted(recurrent.GATES)
FAST = {"hidden": 6, "steps": 1, "piece": 40, "warm": 8, "rate": 0.03}


@pytest.fixture(scope="module")
def regime(spark):
    """Four busy hours, then four quiet ones, shifted by cell.

    No weights of the last three counts tell when a regime ends; how long it has lasted does.
    """
    wave = F.transform(F.sequence(F.lit(0), F.lit(239)), lambda h: F.when((h + F.col("x")) % 8 < 4, 9).otherwise(0).cast("long"))
    cells = spark.range(12).select(F.lit("a").alias("city"), F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("channel"))
    return cells.select("*", F.lit(473352).cast("long").alias("first_hour"), wave.alias("series"))


@pytest.mark.parametrize("layers", [1, 2])
@pytest.mark.parametrize("kind", KINDS)
def test_gradient_against_differences(kind, layers):
    net = recurrent.Network(kind, 3, layers)
    rng = np.random.default_rng(2)
    flat = net.fresh(1)
    values, first = rng.uniform(0, 2, (4, 7)), np.array([5, 900, 17, 3000])
    x, y = recurrent.inputs(values[:, :-1], first), values[:, 1:]
    counts = rng.uniform(size=y.shape) < 0.7
    grad, _ = recurrent.gradient(net, flat, x, y, counts)
    for i in rng.choice(net.size, 40, replace=False):
        step = np.zeros(net.size)
        step[i] = 1e-6
        up, down = (recurrent.gradient(net, flat + s, x, y, counts)[1] for s in (step, -step))
        assert abs((up - down) / 2e-6 - grad[i]) < 1e-5 * max(1, abs(grad[i]))


def plain_roll(net, flat, scale, window, first, f):
    """One window, one hour after the other, from the formulas of the cells."""
    parts, hidden = net.parts(flat), [(np.zeros(net.hidden), np.zeros(net.hidden)) for _ in range(net.layers)]
    sig = lambda z: 1 / (1 + np.exp(-z))
    n, out, last = net.hidden, [], None
    hours = list(range(first - len(window) + 1, first + 1)) + list(range(first + 1, first + f))
    for t, hour in enumerate(hours):
        value = window[t] / scale if t < len(window) else last
        x = np.concatenate([[value], calendar(np.array([hour]))[0, list(CALENDAR)]])
        for k in range(net.layers):
            wx, wh, b = parts[3 * k : 3 * k + 3]
            h, c = hidden[k]
            if net.kind == "rnn":
                h = np.tanh(x @ wx + h @ wh + b)
            elif net.kind == "gru":
                r = sig(x @ wx[:, :n] + h @ wh[:, :n] + b[:n])
                u = sig(x @ wx[:, n : 2 * n] + h @ wh[:, n : 2 * n] + b[n : 2 * n])
                new = np.tanh(x @ wx[:, 2 * n :] + b[2 * n :] + r * (h @ wh[:, 2 * n :]))
                h = u * h + (1 - u) * new
            else:
                i, g, o = (sig(x @ wx[:, j * n : (j + 1) * n] + h @ wh[:, j * n : (j + 1) * n] + b[j * n : (j + 1) * n]) for j in range(3))
                c = g * c + i * np.tanh(x @ wx[:, 3 * n :] + h @ wh[:, 3 * n :] + b[3 * n :])
                h = o * np.tanh(c)
            hidden[k], x = (h, c), h
        last = x @ parts[-2] + parts[-1][0]
        if t >= len(window) - 1:
            out.append(last * scale)
    return out


@pytest.mark.parametrize("kind", KINDS)
def test_roll_out_equals_a_plain_loop(regime, kind):
    net = recurrent.Network(kind, 5, 2)
    flat, w, f = net.fresh(3), 10, 6
    fitted = forecast.Forecaster(kind, (w,), tuple(flat), hidden=5, layers=2, scale=4.0)
    windows = series.sliding_windows(regime.where("x < 3"), w, f).where("idx % 50 = 0")
    rows = forecast.forecast_windows(windows.withColumn("kept", F.col("features")), fitted, w, f).collect()
    assert len({(r["x"], r["idx"]) for r in rows}) == 15 and len(rows) == 15 * f
    for r in rows:
        if r["step"] == f - 1:
            want = plain_roll(net, flat, 4.0, np.array(r["kept"], float), 473352 + r["idx"] + w, f)
            got = [q["yhat"] for q in sorted((q for q in rows if (q["x"], q["idx"]) == (r["x"], r["idx"])), key=lambda q: q["step"])]
            assert np.allclose(got, want)


@pytest.mark.parametrize("kind", KINDS)
def test_recurrent_kinds_see_a_regime_that_linear_ones_do_not(regime, kind):
    train, test = series.split_series(regime, 0.8)
    fitted = forecast.fit_recurrent(train, 24, kind, passes=60, seed=1, **{**FAST, "hidden": 10, "rate": 0.05})
    assert fitted.losses[-1] < fitted.losses[0] / 10
    lags = (1, 2, 3)
    linear = forecast.fit_forecaster(series.lag_features(train, lags), lags, calendar=False)
    cut = series.sliding_windows(test, 24, 3)
    error = [forecast.forecast_windows(cut, m, 24, 3).agg(F.avg(F.pow(F.col("yhat") - F.col("actual"), F.lit(2)))).first()[0] for m in (fitted, linear)]
    assert error[0] < error[1] / 3


def test_tasks_do_not_change_the_model(regime):
    found = [recurrent.fit(regime.repartition(n, "x"), "gru", passes=3, scale=7.0, **{**FAST, "steps": 2})[2] for n in (2, 16)]
    assert np.allclose(found[0].weights, found[1].weights, atol=1e-9)
    assert np.allclose(found[0].losses, found[1].losses, atol=1e-9)


def test_stopped_runs_go_on(spark, regime, tmp_path, monkeypatch):
    whole = forecast.fit_recurrent(regime, 24, "lstm", passes=4, path=f"{tmp_path}/whole", **FAST)
    path = f"{tmp_path}/stopped"
    save = training.save_pass

    def dies(spark, state, path):
        save(spark, state, path)
        if len(state.losses) == 3:
            # The third pass is written in part only.
            remove(spark, f"{training.pass_path(path, 2)}/_SUCCESS")
            raise KeyboardInterrupt

    monkeypatch.setattr(training, "save_pass", dies)
    with pytest.raises(KeyboardInterrupt):
        forecast.fit_recurrent(regime, 24, "lstm", passes=4, path=path, **FAST)
    monkeypatch.setattr(training, "save_pass", save)
    assert [r["pass"] for r in forecast.loss_history(spark, path).collect()] == [0, 1]
    again = forecast.fit_recurrent(regime, 24, "lstm", passes=4, path=path, **FAST)
    assert np.allclose(again.weights, whole.weights, atol=1e-9) and np.allclose(again.losses, whole.losses, atol=1e-9)
    forecast.save_forecaster(spark, again, path)
    loaded = forecast.load_forecaster(spark, path)
    assert loaded == again
    assert not path_exists(spark, f"{path}/history")
    assert [r["loss"] for r in forecast.loss_history(spark, path).orderBy("pass").collect()] == list(again.losses)


def test_pieces_cover_every_hour_once(spark):
    df = spark.createDataFrame([("a", 100, list(range(n)), n) for n in (3, 8, 9, 50, 101)], "city string, first_hour long, series array<long>, x int")
    rows = recurrent.pieces(df, 3, piece=20, warm=8).collect()
    hours = sorted(r["first"] + i for r in rows for i in range(8, len(r["values"])))
    assert hours == sorted(100 + h for n in (3, 8, 9, 50, 101) for h in range(8, n))
    assert {r["step"] for r in rows} <= {0, 1, 2}


def test_names_and_sizes(regime):
    with pytest.raises(ValueError, match="unknown recurrent kind"):
        recurrent.Network("transformer", 4)
    with pytest.raises(ValueError, match="trained on series"):
        forecast.fit_forecaster(series.lag_features(regime, (1,)), (1,), "lstm")
    with pytest.raises(ValueError, match="warm"):
        recurrent.pieces(regime, 1, 10, 10)
