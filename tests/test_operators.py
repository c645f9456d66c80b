import numpy as np
import pytest
from pyspark.sql import functions as F

from tripgrid.operators import cleaning, demand, evaluate, grid, series, splits, stations, values
from tripgrid.operators.lookup import attach, lookup_join
from tripgrid.operators.ranking import dense_position
from tripgrid.session import stage

POINT = "city string, start_lat double, start_lon double, end_lat double, end_lon double, distance_miles double"
GRID = "city string, start_hour long, end_hour long, start_x int, start_y int, end_x int, end_y int"
DEMAND = "city string, hour long, channel int, x int, y int, cnt long"
SPAN = "city string, first_hour long, last_hour long"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def span(spark, *entries):
    return spark.createDataFrame(list(entries), SPAN)


# Lookups and ranks


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_join_gives_the_same_rows_past_the_broadcast_bound(spark, how):
    big = spark.range(5000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    hot = big.withColumn("k", F.when(F.col("v") % 3 == 0, F.lit(1)).otherwise(F.col("k")))
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    near = lookup_join(hot, small, ["k"], how)
    far = lookup_join(hot, small, ["k"], how, max_rows=2, salts=4)
    assert "BroadcastHashJoin" in near._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.select(near.columns).collect()))


def test_attach_without_keys_reads_one_row(spark):
    df = spark.range(3)
    got = attach(df, df.agg(F.max("id").alias("top")))
    assert rows(got, "id") == [(0, 2), (1, 2), (2, 2)]


def test_stage_counts_rows_also_when_empty(spark):
    assert stage(spark.range(12)).rows == 12
    assert stage(spark.range(12).where("id > 50")).rows == 0


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_banded_ranks_equal_one_window(spark, keys):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 100003).alias("v"))
    plain = dense_position(df, "v", "pos", keys)
    banded = dense_position(df, "v", "pos", keys, one_task_rows=10, bands=8)
    assert rows(plain.select("k", "v", "pos"), "k", "v") == rows(banded.select("k", "v", "pos"), "k", "v")


# Cleaning


def test_zero_distance_keeps_missing_lengths_for_the_null_filter(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0, d) for d in (0.0, 2.0, None)], POINT)
    kept = cleaning.drop_zero_distance(df)
    assert kept.count() == 2
    assert cleaning.drop_nulls(kept).count() == 1
    as_text = spark.createDataFrame([("0",), ("0.0",), ("3",), ("x",), (None,)], "distance_miles string")
    assert cleaning.drop_zero_distance(as_text).count() == 3


def test_drop_nulls_treats_nan_as_null(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "x"), (1.0, None)], "v double, t string")
    assert cleaning.drop_nulls(df).count() == 1


def test_zscore_filter_against_numpy(spark):
    rng = np.random.default_rng(7)
    pts = rng.normal(size=(400, 4)) * [1, 2, 1, 2] + [40, -86, 40, -86]
    pts[5, 0] += 30
    pts[6, 3] += 60
    pts[7, 1] -= 60
    df = spark.createDataFrame([("a", *map(float, p), 1.0) for p in pts], POINT)

    def near(p, a, b):
        both = np.concatenate([p[:, a], p[:, b]])
        z = np.abs((p[:, [a, b]] - both.mean()) / both.std())
        return p[(z < 3).all(axis=1)]

    want = near(near(pts, 1, 3), 0, 2)
    got = cleaning.zscore_filter(df)
    assert sorted(r[1] for r in got.collect()) == sorted(want[:, 0].tolist())
    assert cleaning.zscore_filter(df.drop("city"), keys=()).count() == len(want)


def test_no_spread_keeps_no_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 1.0, 2.0, 1.0)] * 4, POINT)
    assert cleaning.zscore_filter(df).count() == 0


def test_pooled_stats_with_uneven_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, None), ("a", 6.0, None)], "city string, p double, q double")
    mean, std = cleaning.pooled_stats(df, ("p", "q")).select("mean", "std").first()
    both = np.array([1, 2, 6, 5.0])
    assert (mean, std) == (pytest.approx(both.mean()), pytest.approx(both.std()))
    only = df.where("q is null")
    assert cleaning.pooled_stats(only, ("p", "q")).first()["std"] == pytest.approx(2.0)


# Grid and demand


@pytest.fixture(scope="module")
def gridded(spark):
    data = [("a", 0, 0, 0, 0, 1, 1), ("a", 0, 1, 0, 0, 0, 0), ("a", 3, 3, 2, 1, 0, 0), ("b", 1, 1, 5, 5, 5, 5)]
    return spark.createDataFrame(data, GRID)


def test_cells_are_numbered_as_first_seen(spark, gridded):
    ordered = stage(gridded.where("city = 'a'").withColumn("trip", F.monotonically_increasing_id())).df
    got = rows(grid.cell_table(ordered, "trip"), "cell_id")
    assert got == [("a", 0, 0, 0, 4), ("a", 1, 1, 1, 1), ("a", 2, 1, 2, 1)]


def test_hourly_demand_counts_ends_by_start_hour(spark, gridded):
    got = rows(demand.hourly_demand(gridded.where("city = 'a'")), "hour", "channel", "x", "y")
    assert got == [
        ("a", 0, 0, 0, 0, 2), ("a", 0, 1, 0, 0, 1), ("a", 0, 1, 1, 1, 1),
        ("a", 3, 0, 2, 1, 1), ("a", 3, 1, 0, 0, 1),
    ]
    by_end = demand.hourly_demand(gridded, bucket_end_by="end").where("city = 'a' and channel = 1")
    assert rows(by_end, "hour") == [("a", 0, 1, 1, 1, 1), ("a", 1, 1, 0, 0, 1), ("a", 3, 1, 0, 0, 1)]
    with pytest.raises(ValueError):
        demand.hourly_demand(gridded, bucket_end_by="middle")


def test_counts_do_not_wrap(spark):
    many = spark.range(70_000).selectExpr("'a' city", "0L start_hour", "0L end_hour", "0 start_x", "0 start_y", "0 end_x", "0 end_y")
    assert [r.cnt for r in demand.hourly_demand(many).collect()] == [70_000, 70_000]


def test_fill_hours(spark, gridded):
    counts = demand.hourly_demand(gridded)
    spans = span(spark, ("a", 100, 103), ("b", 50, 50))
    dropped = rows(demand.total_demand(demand.fill_hours(counts, spans)), "city", "hour")
    assert dropped == [("a", 0, 4), ("a", 1, 0), ("a", 2, 0)]
    kept = rows(demand.total_demand(demand.fill_hours(counts, spans, drop_last=False)), "city", "hour")
    assert kept == [("a", 0, 4), ("a", 1, 0), ("a", 2, 0), ("a", 3, 2), ("b", 0, 0)]


def test_hour_calendar_time_base(spark):
    spans = span(spark, ("a", 473352, 473354))
    true = demand.hour_calendar(spans).selectExpr("cast(t0 as string)", "cast(t1 as string)").first()
    assert tuple(true) == ("2024-01-01 00:00:00", "2024-01-01 01:00:00")
    rebased = demand.hour_calendar(spans, time_base="rebased").selectExpr("cast(t0 as string)").first()[0]
    assert rebased == "1970-01-01 00:00:00"


def test_rebase_moves_both_hours(spark):
    df = spark.createDataFrame([("a", 10, 12), ("a", 11, 11)], "city string, start_hour long, end_hour long")
    assert rows(demand.rebase_hours(df, demand.hour_span(df)), "start_hour") == [("a", 0, 2), ("a", 1, 1)]


def test_high_demand_cells(spark):
    visits = spark.createDataFrame([("a", i, 0, 100) for i in range(30)] + [("a", 99, 0, 1)], "city string, x int, y int, visits long")
    assert grid.high_demand_cells(visits).count() == 30
    assert grid.high_demand_cells(visits, min_visits=100).count() == 30


def test_trips_in_cells_needs_both_ends(spark, gridded):
    cells = spark.createDataFrame([("a", 0, 0), ("a", 2, 1)], "city string, x int, y int")
    want = [("a", 0, 1), ("a", 3, 3)]
    for bound in (10, 1):
        kept = grid.trips_in_cells(gridded, cells, max_rows=bound).select("city", "start_hour", "end_hour")
        assert rows(kept, "start_hour") == want


# Stations and OD


def trips(spark, data):
    schema = (
        "file_ord long, row_ord long, start_time string, end_time string, start_station int, end_station int, "
        "start_lat double, start_lon double, end_lat double, end_lon double"
    )
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def station_trips(spark):
    return trips(
        spark,
        [
            (0, 0, "7/7/2016 4:10", "7/7/2016 4:30", 1, 2, None, 10.0, 22.0, None),
            (0, 1, "7/7/2016 4:50", "7/7/2016 5:10", 1, 2, 11.0, 99.0, 99.0, 20.0),
            (1, 0, "2016-07-07 07:00:00", "2016-07-07 08:00:00", 2, 3, 55.0, 55.0, 33.0, 30.0),
            (1, 1, "2016-07-07 07:30:00", "bad", 9, 1, 9.0, 9.0, 1.0, 1.0),
        ],
    )


def test_station_table_takes_the_first_value_of_each_column(spark, station_trips):
    files = spark.createDataFrame(
        [(0, 0, 2, None, "7/1/2016"), (0, 1, 2, 77.0, "7/2/2016"), (0, 2, 7, 70.0, "7/3/2016"), (0, 3, None, 1.0, "x")],
        "file_ord long, row_ord long, id int, lat double, time string",
    )
    got = rows(stations.station_table(files, station_trips).selectExpr("id", "lat", "lon", "cast(datetime as string)", "tidx"), "id")
    assert got == [
        (1, 11.0, 10.0, "2016-07-07 04:10:00", 0),
        (2, 77.0, 20.0, "2016-07-01 00:00:00", 1),
        (3, 33.0, 30.0, "2016-07-07 08:00:00", 2),
        (7, 70.0, None, "2016-07-03 00:00:00", 3),
        (9, 9.0, 9.0, "2016-07-07 07:30:00", 4),
    ]


def test_od_counts_gaps_and_rejects(spark, station_trips):
    known = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id int, tidx long")
    for bound in (10, 1):
        od, rejects = stations.od_matrix(station_trips, known, max_rows=bound)
        assert rows(od.selectExpr("hour", "cast(dat as string)", "o_idx", "d_idx", "trips"), "hour") == [
            (0, "2016-07-07 04:00:00", 0, 1, 2),
            (3, "2016-07-07 07:00:00", 1, 2, 1),
        ]
        assert [(r.start_station, r.end_station, r.trips) for r in rejects.collect()] == [(9, 1, 1)]
    filled = stations.fill_od_hours(stations.od_hour_count(od))
    assert rows(filled.select("hour", "cnt"), "hour") == [(0, 2), (1, 0), (2, 0), (3, 1)]
    assert stations.od_max(od).first()[0] == 2


def test_od_hours_before_the_origin_start_the_list(spark):
    early = trips(spark, [(0, 0, "7/7/2016 2:10", "x", 1, 1, 0.0, 0.0, 0.0, 0.0), (0, 1, "7/7/2016 5:10", "x", 1, 1, 0.0, 0.0, 0.0, 0.0)])
    od, _ = stations.od_matrix(early, spark.createDataFrame([(1, 0)], "id int, tidx long"))
    hours = stations.od_hour_count(od)
    assert rows(stations.fill_od_hours(hours).select("hour", "cnt"), "hour") == [(-2, 1), (-1, 0), (0, 0), (1, 1)]
    assert stations.trips_before_origin(hours).first()[0] == 1


# Series, windows, splits


@pytest.fixture(scope="module")
def six_hours(spark):
    counts = spark.createDataFrame(
        [("a", 1, 0, 0, 0, 5), ("a", 3, 0, 0, 0, 7), ("a", 0, 1, 2, 2, 1), ("a", 6, 1, 2, 2, 8)], DEMAND
    )
    return counts, span(spark, ("a", 473352, 473358))


def test_dense_series_fills_zeros(six_hours):
    counts, spans = six_hours
    got = rows(series.dense_series(counts, spans).select("x", "channel", "first_hour", "series"), "x")
    assert got == [(0, 0, 473352, [0, 5, 0, 7, 0, 0]), (2, 1, 473352, [1, 0, 0, 0, 0, 0])]
    whole = rows(series.dense_series(counts, spans, drop_last=False).select("series"), "series")
    assert whole == [([0, 5, 0, 7, 0, 0, 0],), ([1, 0, 0, 0, 0, 0, 8],)]


@pytest.mark.parametrize("block", [1, 2, 256])
def test_sliding_windows(six_hours, block):
    dense = series.dense_series(*six_hours).where("x = 0")
    cut = series.sliding_windows(dense, 3, 1, block=block).select("idx", "features", "labels")
    assert rows(cut, "idx") == [(0, [0, 5, 0], [7]), (1, [5, 0, 7], [0])]
    more = series.sliding_windows(dense, 3, 1, all_windows=True, block=block).select("idx", "features", "labels")
    assert rows(more, "idx") == [(0, [0, 5, 0], [7]), (1, [5, 0, 7], [0]), (2, [0, 7, 0], [0])]
    gap = series.sliding_windows_gap(dense, 3, 1, block=block).select("idx", "features", "labels")
    assert rows(gap, "idx") == [(0, [0, 5, 0], [0]), (1, [5, 0, 7], [0])]


def test_window_count_matches_for_many_lengths(spark):
    lengths = spark.range(10, 700, 83).select(
        F.col("id").alias("n"), F.sequence(F.lit(1), F.col("id")).alias("series")
    )
    cut = series.sliding_windows(lengths, 6, 3, block=16)
    counted = cut.groupBy("n").agg(F.count("*").alias("k"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    wrong = counted.where("k <> n - 9 or lo <> 0 or hi <> n - 10")
    assert counted.count() == 9 and wrong.count() == 0
    shifted = cut.where((F.get("features", F.lit(0)) != F.col("idx") + 1) | (F.get("labels", F.lit(2)) != F.col("idx") + 9))
    assert shifted.count() == 0


def test_short_series_is_an_error(six_hours):
    with pytest.raises(Exception, match="window is longer"):
        series.sliding_windows(series.dense_series(*six_hours), 7, 1).collect()
    assert series.sliding_windows(series.dense_series(*six_hours), 5, 3).count() == 0


def test_lag_features(six_hours):
    dense = series.dense_series(*six_hours).where("x = 0")
    got = series.lag_features(dense, (1, 3)).select("hour", "lags", "label", F.get("time_features", F.lit(19)))
    assert rows(got, "hour") == [(3, [0, 0], 7, 3 / 23), (4, [7, 5], 0, 4 / 23), (5, [0, 0], 0, 5 / 23)]


def test_sample_time_features(six_hours):
    _, spans = six_hours
    calendar = demand.hour_calendar(spans)
    cut = series.sample_time_features(series.sample_hours(calendar, 3, 1))
    got = rows(cut.select("idx", F.transform("time_features", lambda t: F.round(t[19] * 23))), "idx")
    assert got == [(0, [0.0, 1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0, 4.0])]


def test_dense_grid(spark, six_hours):
    counts, _ = six_hours
    x, y = grid.axis_rank(counts, "x"), grid.axis_rank(counts, "y")
    dims = stage(grid.grid_dims(x, y))
    assert dims.df.select("nx", "ny").first() == (2, 2)
    got = rows(series.dense_grid(grid.axis_lookup(counts, x, y), dims).select("hour", "grid"), "hour")
    assert got[0] == (0, [0, 0, 0, 0, 0, 0, 0, 1]) and got[1] == (1, [5] + [0] * 7)


def test_split_chrono(spark):
    counts = spark.range(11).selectExpr("'a' city", "id hour", "0 channel", "0 x", "0 y", "1L cnt")
    train, test = splits.split_chrono(counts, span(spark, ("a", 0, 10)))
    assert [r.hour for r in train.orderBy("hour").collect()] == list(range(9))
    assert [r.hour for r in test.collect()] == [9]
    dense = series.dense_series(counts, span(spark, ("a", 0, 10)))
    head, tail = series.split_series(dense, 0.9)
    assert len(head.first().series) == 9 and tail.select(F.size("series"), "first_hour").first() == (1, 9)


def test_split_random_is_stable(spark):
    df = spark.range(20_000)
    train, test = splits.split_random(df, ["id"], seed=3)
    again, _ = splits.split_random(df.repartition(3), ["id"], seed=3)
    other, _ = splits.split_random(df, ["id"], seed=4)
    assert train.count() + test.count() == 20_000
    assert abs(train.count() / 20_000 - 0.8) < 0.02
    assert train.exceptAll(again).count() == 0 and train.exceptAll(other).count() > 0


def test_reindex_closes_holes(spark, six_hours):
    counts, _ = six_hours
    hours = spark.createDataFrame([("a", 1), ("a", 2), ("a", 6)], "city string, hour long")
    moved, spans = splits.reindex_hours(counts, hours)
    assert rows(moved.select("hour", "cnt"), "hour") == [(0, 5), (2, 8)]
    assert rows(spans, "city") == [("a", 0, 2)]


# Values


def test_outlier_values(spark):
    counts = spark.range(100_001).selectExpr("'a' city", "if(id = 0, 999, id % 90 + 1) cnt")
    assert [r.cnt for r in values.outlier_values(counts).collect()] == [999]
    clipped = values.clip_outlier_cells(counts)
    assert clipped.where("cnt = 0").count() == 1 and clipped.agg(F.max("cnt")).first()[0] == 90
    assert values.outlier_member(counts, values.outlier_values(counts)).count() == 1


def test_normalize(spark):
    counts = spark.createDataFrame([("a", 1), ("a", 4), ("b", 2)], "city string, cnt long")
    assert rows(values.normalize_demand(counts), "city", "cnt") == [("a", 1, 0.25), ("a", 4, 1.0), ("b", 2, 1.0)]


# Scores


@pytest.fixture(scope="module")
def aligned(spark):
    pred = spark.createDataFrame([("a", 0, 0, 0, 0, 0, 1.5), ("a", 0, 1, 1, 1, 1, 2.0)], "city string, idx long, step int, channel int, x int, y int, yhat double")
    actual = spark.createDataFrame([("a", 0, 0, 0, 0, 0, 1), ("a", 1, 0, 1, 0, 1, 3)], "city string, idx long, step int, channel int, x int, y int, actual long")
    return evaluate.pred_actual_join(pred, actual)


def test_scores(spark, aligned):
    dims = spark.createDataFrame([("a", 2, 5)], "city string, nx long, ny long")
    samples = spark.createDataFrame([("a", 2)], "city string, n_samples long")
    assert aligned.count() == 3
    assert evaluate.mse(aligned, dims, samples, 2).first()["mse"] == pytest.approx((0.25 + 4 + 9) / (2 * 5 * 2 * 2 * 2))
    by_step = {(r.step, r.channel): (r.total_mse, r.mean_mse) for r in evaluate.horizon_mse(aligned, dims, samples).collect()}
    assert by_step == {(0, 0): (0.025, 0.0125), (1, 1): (0.4, 0.2), (0, 1): (0.9, 0.45)}
    assert rows(evaluate.demand_pred_vs_actual(aligned), "idx") == [("a", 0, 0, 2, 1), ("a", 1, 1, 0, 3)]
    assert rows(evaluate.heatmap_cells(aligned), "x") == [("a", 0, 1, 1, 3, 0)]
    history = spark.createDataFrame([("a", 0, 0.5)], "city string, pass int, loss double")
    report = evaluate.score_forecast(aligned, dims, samples, 2, history)
    total = report.where("metric = 'mse'").first()["value"]
    assert total == pytest.approx(evaluate.mse(aligned, dims, samples, 2).first()["mse"])
    assert report.where("metric = 'training_loss'").first()["value"] == 0.5
    assert evaluate.series_loss(report).count() == 7 and evaluate.series_total_demand(report).count() == 4


def test_counts_outside_the_calendar_have_no_place(spark):
    """A count before the first hour or behind the last one moves no other count."""
    counts = spark.createDataFrame(
        [("a", h, 0, 1, 1, c) for h, c in ((-3, 9), (2, 4), (4, 1), (6, 8))] + [("a", -1, 1, 2, 2, 5)],
        "city string, hour long, channel int, x int, y int, cnt long",
    )
    span = spark.createDataFrame([("a", 0, 5)], "city string, first_hour long, last_hour long")
    got = {r["x"]: list(r["series"]) for r in series.dense_series(counts, span, drop_last=False).collect()}
    assert got == {1: [0, 0, 4, 0, 1, 0], 2: [0] * 6}


def test_grids_of_empty_hours(spark):
    placed = spark.createDataFrame([("a", 1, 0, 0, 1, 5)], "city string, hour long, channel int, x_idx long, y_idx long, cnt long")
    dims = spark.createDataFrame([("a", 1, 2)], "city string, nx long, ny long")
    hours = spark.createDataFrame([("a", h) for h in range(3)], "city string, hour long")
    got = {r["hour"]: list(r["grid"]) for r in series.dense_grid(placed, dims, calendar=hours).collect()}
    assert got == {0: [0] * 4, 1: [0, 5, 0, 0], 2: [0] * 4}


def test_trips_that_cannot_be_placed_are_rejected(spark):
    rows = [
        ("7/7/2016 5:00", "3005.0", "3006"), ("not a time", "3005", "3006"), ("7/7/2016 6:00", "depot", "3006"),
        ("7/7/2016 6:00", "3005.5", "3006"), ("7/7/2016 6:10", "3005", "9"), (None, None, "3006"),
    ]
    trips = spark.createDataFrame(rows, "start_time string, start_station string, end_station string")
    table = spark.createDataFrame([(3005, 0), (3006, 1)], "id int, tidx long")
    od, rejects = stations.od_matrix(trips, table)
    hours = stations.od_hour_count(od)
    assert od.agg(F.sum("trips")).first()[0] == hours.agg(F.sum("cnt")).first()[0] == 1
    assert od.where("hour is null").count() == 0
    lost = {(r["reason"], r["start_time_text"], r["start_station_text"]) for r in rejects.collect()}
    assert lost == {
        ("time", "not a time", None), ("station", None, "depot"), ("station", None, "3005.5"), ("station", None, None), ("time", None, None),
    }
    assert rejects.agg(F.sum("trips")).first()[0] == 5
