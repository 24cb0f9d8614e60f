"""Tables by tile: what a box reads, how files are cut."""

import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from trailmark.sources import files


def test_cells_by_tile(spark, tmp_path):
    path = str(tmp_path / "cells")
    k = F.col("id")
    cells = spark.range(20_000).select("id", (F.lit(-2.0) + (k * 7919) % 4001 / 1000).alias("lat"), (F.lit(9.0) + (k * 104729) % 3001 / 1000).alias("lng"))
    files.write_cells(cells, path, per_file=300)
    box = (-1.25, 9.5, -0.75, 9.75)
    got = files.read_dem_cells(spark, path, *box)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[tile#\d+ IN \(S02E009,S01E009\)\]", plan) and "PushedFilters: [IsNotNull(lat)" in plan
    want = cells.filter(F.col("lat").between(box[0], box[2]) & F.col("lng").between(box[1], box[3]))
    assert got.count() > 100 and not got.select("id", "lat", "lng").exceptAll(want).count() and not want.exceptAll(got.select("id", "lat", "lng")).count()
    sizes = [pq.read_metadata(p).num_rows for p in (tmp_path / "cells").rglob("*.parquet")]
    assert sum(sizes) == 20_000 and max(sizes) <= 300 and len(sizes) > 60
    one = next((tmp_path / "cells").rglob("*.parquet"))
    rows = pq.ParquetFile(one).read(columns=["lat", "lng"]).to_pylist()
    assert rows == sorted(rows, key=lambda r: (r["lat"], r["lng"]))


def test_cells_of_an_empty_table(spark, tmp_path):
    files.write_cells(spark.createDataFrame([], "lat double, lng double, h double"), str(tmp_path / "none"))
    rows = spark.createDataFrame([(1.0, 1.0, 1.0, "N01E001")], "lat double, lng double, h double, tile string")
    rows.write.mode("append").partitionBy("tile").parquet(str(tmp_path / "none"))
    assert files.read_dem_cells(spark, str(tmp_path / "none"), 1.0, 1.0, 1.0, 1.0).count() == 1
