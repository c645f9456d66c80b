"""Tables that change together, and numbers that stay."""

import pytest
from pyspark.sql import functions as F

from tripgrid.checks import fixtures as fx
from tripgrid.config import CityConfig
from tripgrid.plans import demand as demand_plan
from tripgrid.session import list_names, remove, write_small
from tripgrid.sources import publish, registry, writers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(spark, root, cities, value, stop=False):
    """A job of two tables that may be stopped between them."""
    with publish.publication(spark, root, cities) as folder:
        for name in ("one", "two"):
            df = spark.createDataFrame([(c, name, value) for c in cities], "city string, name string, value int")
            df.write.partitionBy("city").parquet(f"{folder}/{name}")
            if stop:
                raise KeyboardInterrupt


def seen(spark, root):
    return {(r["city"], r["name"]): r["value"] for name in ("one", "two") for r in publish.read_table(spark, root, name).collect()}


def test_readers_see_whole_jobs_only(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, ["a", "b"], 1)
    assert seen(spark, root) == {(c, n): 1 for c in "ab" for n in ("one", "two")}
    with pytest.raises(KeyboardInterrupt):
        put(spark, root, ["a", "b"], 2, stop=True)
    assert set(seen(spark, root).values()) == {1}
    put(spark, root, ["b", "c"], 3)
    assert seen(spark, root) == {(c, n): 1 if c == "a" else 3 for c in "abc" for n in ("one", "two")}


def test_two_jobs_at_once(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, ["a"], 1)
    with pytest.raises(RuntimeError, match="same time"), publish.publication(spark, root, ["a"]) as folder:
        spark.createDataFrame([("a", "one", 9)], "city string, name string, value int").write.parquet(f"{folder}/one")
        put(spark, root, ["a"], 2)
    assert set(seen(spark, root).values()) == {2}
    assert not [n for n in list_names(spark, f"{root}/manifests") if not n.endswith(".json") and not n.endswith(".crc")]


def test_prune_keeps_what_manifests_name(spark, tmp_path):
    root = str(tmp_path)
    for value, cities in ((1, ["a", "b"]), (2, ["b"]), (3, ["b"]), (4, ["b"])):
        put(spark, root, cities, value)
    publish.prune(spark, root, 2)
    assert len(publish.manifests(spark, root)) == 2 and len(list_names(spark, f"{root}/versions")) == 3
    assert seen(spark, root) == {("a", "one"): 1, ("a", "two"): 1, ("b", "one"): 4, ("b", "two"): 4}


def test_roots_without_publications(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "city string, value int")
    writers.write_by_city(df, f"{tmp_path}/one")
    assert publish.read_table(spark, str(tmp_path), "one").first()["value"] == 1


def found(spark, cells):
    return spark.createDataFrame(cells, "city string, x int, y int, first_seen long")


def ids(df):
    return {(r["city"], r["x"], r["y"]): r["cell_id"] for r in df.collect()}


@pytest.mark.parametrize("one_task_rows", [1_000_000, 1])
def test_ids_of_a_run_are_a_prefix_of_those_of_the_next(spark, tmp_path, one_task_rows):
    path = str(tmp_path / "ids")
    extend = lambda cells: ids(registry.extend_ids(found(spark, cells), path, ("x", "y"), "first_seen", "cell_id", one_task_rows=one_task_rows, bands=3))
    first = extend([("a", i, -i, 100 - 7 * i) for i in range(9)])
    assert first == {("a", i, -i): 8 - i for i in range(9)}
    # Old cells are seen later or not at all, new ones earlier; another city begins.
    second = extend([("a", i, -i, i) for i in range(4, 14)] + [("b", 1, 1, 5), ("b", 0, 0, 9)])
    assert {k: v for k, v in second.items() if k in first} == first
    assert {k: v for k, v in second.items() if k not in first} == {**{("a", i, -i): i for i in range(9, 14)}, ("b", 1, 1): 0, ("b", 0, 0): 1}
    assert extend([]) == second == ids(registry.read_ids(spark, path))
    assert ids(registry.read_ids(spark, path, 1)) == first


def test_a_stopped_version_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "ids")
    registry.extend_ids(found(spark, [("a", 0, 0, 0)]), path, ("x", "y"), "first_seen", "cell_id")
    registry.extend_ids(found(spark, [("a", 1, 1, 1)]), path, ("x", "y"), "first_seen", "cell_id")
    remove(spark, f"{path}/version-000001/_SUCCESS")
    again = registry.extend_ids(found(spark, [("a", 5, 5, 1), ("a", 1, 1, 2)]), path, ("x", "y"), "first_seen", "cell_id")
    assert ids(again) == {("a", 0, 0): 0, ("a", 5, 5): 1, ("a", 1, 1): 2}


def test_sets_without_keys(spark, tmp_path):
    path = str(tmp_path / "stations")
    stations = lambda n: spark.createDataFrame([(i,) for i in n], "id long")
    registry.extend_ids(stations([30, 10]), path, ("id",), "id", "tidx", ())
    last = registry.extend_ids(stations([20, 30, 5]), path, ("id",), "id", "tidx", ())
    assert {r["id"]: r["tidx"] for r in last.collect()} == {10: 0, 30: 1, 5: 2, 20: 3}


def test_demand_job_publishes_and_keeps_ids(spark, sf, tmp_path):
    trips = fx.trips_fx(spark, sf).where("city = 'a'").drop("city")
    trips.where("trip_id % 2 = 0").coalesce(1).write.option("header", True).csv(f"{tmp_path}/half")
    trips.coalesce(1).write.option("header", True).csv(f"{tmp_path}/all")
    job, out = CityConfig("a", fx.FORMATS["a"], window=24, horizon=3), str(tmp_path / "out")
    kept = []
    for part in ("half", "all"):
        demand_plan.run_demand_job(spark, [job], {"a": f"{tmp_path}/{part}/*.csv"}, out, publish=True, ids=f"{tmp_path}/ids")
        cells = publish.read_table(spark, out, "cells")
        kept.append({(r["x"], r["y"]): r["cell_id"] for r in cells.collect()})
        total = publish.read_table(spark, out, "demand").agg(F.sum("cnt")).first()[0]
        assert cells.count() == len(set(kept[-1].values())) and total <= cells.agg(F.sum("visits")).first()[0]
    common = kept[0].keys() & kept[1].keys()
    assert common and all(kept[0][c] == kept[1][c] for c in common)
    assert min(v for k, v in kept[1].items() if k not in common) >= len(kept[0])
