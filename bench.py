"""Headline timings: each one runs a whole chain from the raw tables to a result.

Prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the tables and the
number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tripgrid.checks import fixtures as fx  # noqa: E402
from tripgrid.checks.queries import whole_trips  # noqa: E402
from tripgrid.operators import cleaning, demand, evaluate, forecast, grid, latent, series, stations  # noqa: E402
from tripgrid.plans import demand as demand_plan  # noqa: E402
from tripgrid.plans import forecast as forecast_plan  # noqa: E402
from tripgrid.session import pin_utc, stage  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# Window and horizon of the work to compare with; every hour of the window is an input.
W, H = 74, 200
LAGS = tuple(range(1, W + 1))
SHARE = 0.6


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tripgrid-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return pin_utc(spark)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    run(demand_plan.demand_tables(whole_trips(spark, "/root/testdata/sf0.001")).demand.df)
    times: dict[str, float] = {}

    def timed(name, fn):
        start = time.perf_counter()
        result = fn()
        times[name] = round(time.perf_counter() - start, 3)
        return result

    def clean():
        run(cleaning.zscore_filter(whole_trips(spark, SF_DIR)))

    def hourly():
        tables = demand_plan.demand_tables(whole_trips(spark, SF_DIR), carry=("trip_id",))
        run(demand.total_demand(demand.fill_hours(tables.demand.df, tables.frame)))
        return tables

    def cells():
        run(grid.cell_table(tables.gridded, "trip_id"))

    def od():
        trips = fx.station_trips_fx(spark, SF_DIR)
        table = stage(stations.station_table(fx.stations_fx(spark, SF_DIR), trips))
        counts = stage(stations.od_matrix(trips, table)[0]).df
        run(stations.fill_od_hours(stations.od_hour_count(counts)))

    def windows():
        dense = series.stage_series(tables.demand.df, tables.frame)
        cut = series.sliding_windows(dense, W, H)
        run(cut.groupBy("city", "idx").agg(F.sum(F.get("features", F.lit(0))), F.sum(F.get("labels", F.lit(199)))))
        return dense

    def train():
        rows = series.lag_features(series.split_series(dense, SHARE)[0], LAGS)
        return forecast.fit_forecaster(rows, LAGS, solver="normal")

    def score():
        test = series.split_series(dense, SHARE)[1]
        aligned = forecast.forecast_series(test, fitted, W, H)
        counts = tables.demand.df
        dims = stage(grid.grid_dims(grid.axis_rank(counts, "x"), grid.axis_rank(counts, "y")))
        span = tables.frame.df.withColumn("last_hour", F.col("last_hour") - 1)
        run(evaluate.score_forecast(aligned, dims, forecast_plan.sample_counts(span, W, H, SHARE), H))

    def encode():
        hours = tables.frame.df.select("city", (F.col("last_hour") - F.col("first_hour")).alias("n"))
        encoder = latent.fit_encoder(tables.demand.df, hours)
        run(latent.reconstruction_mse(tables.demand.df, encoder, hours))

    timed("clean_trips", clean)
    tables = timed("hourly_demand", hourly)
    timed("cell_ids", cells)
    timed("od_matrix", od)
    dense = timed("sliding_windows", windows)
    fitted = timed("train_pass", train)
    timed("forecast_score", score)
    timed("encode_decode", encode)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "tripgrid headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
