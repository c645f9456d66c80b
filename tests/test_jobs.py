"""The jobs on files, from text to stored tables."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tripgrid.checks import fixtures as fx
from tripgrid.checks.queries import whole_trips
from tripgrid.config import CITY_PRESETS, CityConfig, ColumnMap
from tripgrid.operators import stations
from tripgrid.plans import demand as demand_plan
from tripgrid.plans import forecast as forecast_plan
from tripgrid.plans import od as od_plan
from tripgrid.session import _session_dir, shared_dir
from tripgrid.sources import readers, writers


@pytest.fixture(scope="module")
def demand_set(spark, sf):
    root = f"{shared_dir(spark)}/demand-job"
    jobs, paths = [], {}
    for city in fx.CITIES:
        fx.trips_fx(spark, sf).where(F.col("city") == city).drop("city").repartition(2).write.option("header", True).csv(f"{root}/{city}")
        jobs.append(CityConfig(city, fx.FORMATS[city], window=24, horizon=3))
        paths[city] = f"{root}/{city}/*.csv"
    demand_plan.run_demand_job(spark, jobs, paths, f"{root}/out")
    return jobs, paths, f"{root}/out"


def same(a, b):
    columns = a.columns
    return a.exceptAll(b.select(columns)).count() == 0 and b.select(columns).exceptAll(a).count() == 0


def test_demand_job_equals_the_operators(spark, sf, demand_set):
    _, _, out = demand_set
    tables = demand_plan.demand_tables(whole_trips(spark, sf))
    assert same(demand_plan.stored_demand(tables), readers.scan_demand(spark, f"{out}/demand"))
    kept = tables.gridded.count()
    cells = spark.read.parquet(f"{out}/cells")
    assert spark.read.parquet(f"{out}/trips").count() == kept
    assert cells.agg(F.sum("visits")).first()[0] == 2 * kept
    numbered = cells.groupBy("city").agg(F.count("*").alias("n"), F.countDistinct("cell_id").alias("d"), F.max("cell_id").alias("m"))
    assert numbered.where("n <> d or n <> m + 1").count() == 0


def test_running_again_replaces_only_the_named_city(spark, demand_set):
    jobs, paths, out = demand_set
    before = readers.scan_demand(spark, f"{out}/demand").groupBy("city").count().orderBy("city").collect()
    demand_plan.run_demand_job(spark, jobs[:1], paths, out)
    assert readers.scan_demand(spark, f"{out}/demand").groupBy("city").count().orderBy("city").collect() == before
    assert spark.read.parquet(f"{out}/dims").count() == 3


def test_scan_demand_reads_one_folder(spark, demand_set):
    _, _, out = demand_set
    plan = readers.scan_demand(spark, f"{out}/demand", "b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(city" in plan and "= b)" in plan


def test_forecast_job(spark, demand_set, tmp_path):
    jobs, _, source = demand_set
    demand_plan.run_demand_job(spark, jobs, demand_set[1], source)
    jobs = [replace(j, solver="normal") for j in jobs]
    out = str(tmp_path / "fc")
    for run_id in ("one", "two", "two"):
        forecast_plan.run_forecast_job(spark, source, jobs, out, run_id, lags=(1, 24), share=0.9)
    report = spark.read.parquet(f"{out}/eval")
    assert {(r.city, r.run_id) for r in report.select("city", "run_id").distinct().collect()} == {
        (c, r) for c in fx.CITIES for r in ("one", "two")
    }
    steps = report.where("metric = 'mean_loss' and run_id = 'one' and city = 'a'")
    assert steps.count() == 2 * 3 and steps.where("value <= 0").count() == 0
    passes = report.where("metric = 'training_loss' and city = 'a'").groupBy("run_id").count()
    assert {tuple(r) for r in passes.collect()} == {("one", 1), ("two", 3)}
    # A recurrent kind: two passes, two more on top of them, and the missing one of five.
    short = replace(jobs[0], kind="gru", hidden=4, passes=2)
    for start, passes, total in (("fresh", 2, 2), ("continue", 2, 4), ("resume", 5, 5), ("fresh", 1, 1)):
        forecast_plan.run_forecast_job(spark, source, [replace(short, passes=passes)], out, start, start=start)
        own = spark.read.parquet(f"{out}/eval").where(F.col("run_id") == start)
        assert own.where("metric = 'training_loss'").count() == total
        assert own.where("metric = 'mean_loss' and value > 0").count() > 0
    with pytest.raises(ValueError, match="unknown forecaster"):
        forecast_plan.run_forecast_job(spark, source, [replace(jobs[0], kind="x")], out, "bad", lags=(1, 24))


def test_passes_and_saved_models_of_the_forecast_job(spark, demand_set, tmp_path):
    jobs, _, source = demand_set
    jobs, out = [replace(jobs[0], max_iter=3)], str(tmp_path / "fc")

    def run(run_id, **how):
        forecast_plan.run_forecast_job(spark, source, jobs, out, run_id, lags=(1, 24), **how)
        report = spark.read.parquet(f"{out}/eval").where(F.col("run_id") == run_id)
        return {m: report.where(F.col("metric") == m).count() for m in ("training_loss", "mean_loss")}

    with pytest.raises(ValueError, match="no model is saved"):
        run("none", start="score")
    passes = run("fresh")["training_loss"]
    # The loss before the first pass and after each.
    assert passes == 4
    assert run("scored", start="score") == {"training_loss": passes, "mean_loss": 6}
    assert run("more", start="continue")["training_loss"] > passes
    with pytest.raises(ValueError, match="start must be"):
        run("bad", start="warm")


def test_older_experiments(spark, demand_set):
    _, _, source = demand_set
    assert forecast_plan.run_plain_forecast(spark, source, 24, 3, (1, 24)).where("mse > 0").count() == 3
    assert forecast_plan.run_encoder(spark, source).where("mse > 0").count() == 3


def test_od_job_with_drifting_headers(spark, sf, tmp_path):
    root, out = str(tmp_path), str(tmp_path / "out")
    trips = fx.station_trips_fx(spark, sf).drop("trip_id")
    old = trips.where("file_ord = 0").orderBy("row_ord").drop("file_ord", "row_ord")
    new = trips.where("file_ord = 1").orderBy("row_ord").drop("file_ord", "row_ord")
    new = new.withColumnsRenamed({"start_station": "start_station_id", "end_station": "end_station_id"})
    old.coalesce(1).write.option("header", True).csv(f"{root}/a-trips-1")
    new.select(*reversed(new.columns)).coalesce(1).write.option("header", True).csv(f"{root}/b-trips-2")
    files = fx.stations_fx(spark, sf)
    for part in (0, 1):
        own = files.where(F.col("file_ord") == part).orderBy("row_ord").select("id", "lat", F.col("time").alias("date"))
        own.coalesce(1).write.option("header", True).csv(f"{root}/stations-{part}")
    od_plan.run_od_job(spark, f"{root}/stations-*/*.csv", f"{root}/*-trips-*/*.csv", out)
    table = stations.station_table(files, fx.station_trips_fx(spark, sf))
    assert same(table, spark.read.parquet(f"{out}/stations"))
    od, rejects = stations.od_matrix(fx.station_trips_fx(spark, sf), table)
    assert same(od, spark.read.parquet(f"{out}/od")) and rejects.count() == spark.read.parquet(f"{out}/rejects").count() == 0
    assert spark.read.parquet(f"{out}/early_trips").first()[0] == 0
    hours = spark.read.parquet(f"{out}/od_hours")
    assert hours.agg(F.sum("cnt")).first()[0] == od.agg(F.sum("trips")).first()[0] == trips.count()


def test_reading_order_survives_split_files(spark, tmp_path):
    lines = ["id,v"] + [f"{i},{'x' * 50}" for i in range(20_000)]
    (tmp_path / "b.csv").write_text("\n".join(lines))
    (tmp_path / "a.csv").write_text("v,id\ny,-1\nNA,-2\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = readers.read_text_tables(spark, f"{tmp_path}/*.csv")
        ids = [int(r.id) for r in df.orderBy("file_ord", "row_ord").select("id").collect()]
        assert df.rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert ids == [-1, -2, *range(20_000)]
    assert df.where("v is null").select("id").first()[0] == "-2"


def test_separate_date_columns(spark, tmp_path):
    text = "start_date,end_date,start_time_utc,end_time_utc,start_lat,start_lon,end_lat,end_lon,distance_miles\n"
    text += "01/02/2024 00:00:00,01/02/2024 00:00:00,10:00:00,11:30:00,1,2,3,4,5\n"
    text += "01/02/2024 00:00:00,01/02/2024 00:00:00,25:00:00,11:30:00,1,2,3,4,5\n"
    text += "01/02/2024 00:00:00,01/02/2024 00:00:00,10:00:00,11:30:00,1,2,3,4,0\n"
    (tmp_path / "t.csv").write_text(text)
    job = replace(CITY_PRESETS["kansas_city"], columns=ColumnMap(start_date="start_date", end_date="end_date"))
    got = demand_plan.read_city(spark, job, f"{tmp_path}/t.csv").orderBy("row_ord")
    times = got.selectExpr("cast(start_time_utc as string)", "cast(end_time_utc as string)").collect()
    assert [tuple(r) for r in times] == [("2024-01-02 10:00:00", "2024-01-02 11:30:00")]
    with pytest.raises(ValueError, match="lacks the columns"):
        readers.scan_trips(spark, f"{tmp_path}/t.csv", ColumnMap(start_lat="lat0"))


def test_mixed_headers_are_not_read_as_one(spark, tmp_path):
    head = "start_time_utc,end_time_utc,start_lat,start_lon,end_lat,end_lon,distance_miles"
    (tmp_path / "1.csv").write_text(f"{head}\na,b,1,2,3,4,5\n")
    (tmp_path / "2.csv").write_text(head.replace("start_lat,start_lon", "start_lon,start_lat") + "\na,b,1,2,3,4,5\n")
    with pytest.raises(Exception, match="CSV header"):
        readers.scan_trips(spark, f"{tmp_path}/*.csv").collect()
    lats = readers.read_text_tables(spark, f"{tmp_path}/*.csv").orderBy("file_ord").select("start_lat").collect()
    assert [r[0] for r in lats] == ["1", "2"]


def test_jobs_leave_no_staged_tables(spark, demand_set):
    jobs, paths, out = demand_set
    root = _session_dir(spark)

    def staged():
        return set(os.listdir(root))

    before = staged()
    demand_plan.run_demand_job(spark, jobs[1:2], paths, out)
    assert staged() == before


def test_cell_table_sinks(spark, tmp_path):
    cells = spark.createDataFrame([("a", 1, 2, 0, 5)], "city string, x int, y int, cell_id long, visits long")
    writers.write_cells(cells, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["visits"] == "5"
    writers.write_stations(cells, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1


def test_quoted_fields_keep_their_neighbours(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,say,last\n1,"say ""hi"", ok",x\n2,"a,b",y\n3,plain,z\n')
    got = readers.read_text_tables(spark, f"{tmp_path}/*.csv").orderBy("row_ord").select("id", "say", "last").collect()
    assert [tuple(r) for r in got] == [("1", 'say "hi", ok', "x"), ("2", "a,b", "y"), ("3", "plain", "z")]


def test_files_that_appear_later_are_noticed(spark, tmp_path):
    (tmp_path / "1.csv").write_text("id\n1\n")
    (tmp_path / "2.csv").write_text("id\n2\n")
    part = readers._in_reading_order(readers._csv(spark).csv(f"{tmp_path}/*.csv"))
    with pytest.raises(Exception, match="appeared while it was read"):
        readers._number_files(part, readers.list_files(spark, f"{tmp_path}/1.csv")).collect()


def test_more_files_take_no_more_jobs(spark, tmp_path):
    def read(files):
        root = tmp_path / str(files)
        root.mkdir()
        for i in range(files):
            (root / f"{i:03}.csv").write_text(f"a,b\n{i},1\n" if i % 2 else f"b,c\n1,{i}\n")
        spark.sparkContext.setJobGroup(f"scan-{files}", "scan")
        got = readers.read_text_tables(spark, f"{root}/*.csv", {"c": "a"}).orderBy("file_ord").collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert [(r["file_ord"], r["a"]) for r in got] == [(i, str(i)) for i in range(files)]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"scan-{files}"))

    # Lists of over 32 paths are listed in a job of their own, a few times.
    assert read(200) - read(40) <= 2
    with pytest.raises(ValueError, match="two columns would be called"):
        readers.read_text_tables(spark, f"{tmp_path}/40/*.csv", {"b": "a"})


def test_demand_job_options(spark, sf, demand_set, tmp_path):
    jobs, paths, _ = demand_set
    out = str(tmp_path / "options")
    demand_plan.run_demand_job(spark, jobs, paths, out, drop_last=False, time_base="rebased", bucket_end_by="end", min_visits=3)
    tables = demand_plan.demand_tables(whole_trips(spark, sf), bucket_end_by="end")
    assert same(demand_plan.stored_demand(tables, time_base="rebased", drop_last=False), readers.scan_demand(spark, f"{out}/demand"))
    assert readers.scan_demand(spark, f"{out}/demand").agg(F.min("t0")).first()[0].year == 1970
    cells, mask = spark.read.parquet(f"{out}/cells"), spark.read.parquet(f"{out}/cell_mask")
    assert same(cells.where("visits >= 3"), mask) and 0 < mask.count() < cells.count()
