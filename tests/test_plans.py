"""What the physical plans must and must not contain."""

import inspect

import pytest
from pyspark.sql import functions as F

from tripgrid.checks import fixtures as fx
from tripgrid.checks import queries as q
from tripgrid.operators import cleaning, demand, grid, series, stations
from tripgrid.sources import writers


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    """The plan with full scan details."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def tables(spark, sf):
    return q._tables(spark, sf)


def test_no_python_in_the_core(spark, sf, tables):
    counts = tables.demand.df
    dense = series.stage_series(counts, tables.frame)
    frames = [
        tables.gridded, demand.hourly_demand(tables.gridded), demand.fill_hours(counts, tables.frame),
        series.sliding_windows(dense, 24, 5), series.lag_features(dense, (1, 2)),
        grid.cell_table(tables.gridded, "trip_id"), stations.stations_from_trips(fx.station_trips_fx(spark, sf)),
    ]
    for df in frames:
        text = plan_of(df)
        for node in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoopJoin"):
            assert node not in text


def test_cleaning_does_not_move_trips(spark, sf):
    clean = cleaning.zscore_filter(q._whole(spark, sf))
    text = plan_of(clean)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "Exchange hashpartitioning" not in text


def test_demand_shuffles_once_and_combines_first(tables):
    text = plan_of(demand.hourly_demand(tables.gridded))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text


def test_hash_aggregation_where_trips_are_reduced(spark, sf, tables):
    for df in (
        demand.hourly_demand(tables.gridded),
        grid.cell_table(tables.gridded, "trip_id"),
        stations.stations_from_trips(fx.station_trips_fx(spark, sf)),
        cleaning.pooled_stats(q._whole(spark, sf), ("start_lon", "end_lon")),
    ):
        assert "SortAggregate" not in plan_of(df)


def test_filters_and_columns_reach_the_scan(spark, sf):
    """A pass for longitudes reads longitudes, with its null filters in the scan."""
    stats = cleaning.pooled_stats(q._whole(spark, sf), ("start_lon", "end_lon"))
    assert "ReadSchema: struct<city:string,start_lon:double,end_lon:double>" in formatted(stats)
    raw = cleaning.drop_nulls(cleaning.drop_zero_distance(q._whole(spark, sf)), ["distance_miles", "end_lat"])
    text = formatted(raw.select("end_lat"))
    assert "IsNotNull(distance_miles)" in text and "IsNotNull(end_lat)" in text and "EqualTo(distance_miles,0.0)" in text
    assert "ReadSchema: struct<end_lat:double,distance_miles:double>" in text


def test_text_is_parsed_once(spark, sf):
    typed = cleaning.computed_once(q._typed(spark, sf))
    text = plan_of(cleaning.drop_nulls(cleaning.drop_zero_distance(typed)))
    assert text.count("gettimestamp") == 6


def test_windows_are_cut_without_a_shuffle(tables):
    dense = series.stage_series(tables.demand.df, tables.frame)
    before = plan_of(dense).count("Exchange")
    assert plan_of(series.sliding_windows(dense, 24, 5)).count("Exchange") == before
    assert plan_of(series.lag_features(dense, (1, 24))).count("Exchange") == before


def test_series_share_one_shuffle(tables):
    assert plan_of(series.dense_series(tables.demand.df, tables.frame)).count("Exchange hashpartitioning") == 1


def test_partition_count_does_not_change_results(spark, sf, tables):
    counts = demand.hourly_demand(tables.gridded)
    other = demand.hourly_demand(tables.gridded.repartition(13))
    assert counts.exceptAll(other).count() == 0 and other.exceptAll(counts).count() == 0
    assert counts.agg(F.sum("cnt")).first()[0] == 2 * tables.gridded.count()


def test_cells_come_from_the_counts(spark, tables):
    """Cell ids from hourly counts are those from the trips, and read no trips."""
    counts = demand.hourly_demand(tables.gridded, order="trip_id")
    cells, want = grid.cells_of_demand(counts), grid.cell_table(tables.gridded, "trip_id")
    assert cells.exceptAll(want).count() == 0 and want.exceptAll(cells).count() == 0
    assert "SortAggregate" not in plan_of(counts)


def test_trips_are_written_where_they_are(spark, tables, tmp_path):
    writers.write_trips(tables.gridded, str(tmp_path / "trips"))
    assert "Exchange" not in plan_of(tables.gridded).replace("BroadcastExchange", "")
    assert "hint" not in inspect.getsource(writers.write_trips) + inspect.getsource(writers._replace_cities)
    assert spark.read.parquet(str(tmp_path / "trips")).count() == tables.gridded.count()
