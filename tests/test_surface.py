"""SQL functions against the Column functions of the same names, and the views."""

import pytest
from pyspark.sql import functions as F

from trailmark import plans
from trailmark.functions import geo, text, time
from trailmark.sources import surface

TEXTS = ["", "Água Preta-2", "  São João: 1ª volta! ", "https://x.y/a#b", "http://localhost:80/a", "file:///a", "0123456789abcdef", "ab-CD-09", "P1DT2H3M4.5S", "PT45M", "PT", "P1X", "2025-09-10T01:02:03", "2025-13-40", "a/b/", None]
WITH_TEXT = {"norm_key": text.norm_key, "route_slug": text.route_slug, "iri_tail": text.iri_tail, "stem_hash": text.stem_hash, "is_hash16": text.is_hash16, "valid_token": text.valid_token, "is_local_host": text.is_local_host, "iso_duration_s": time.iso_duration_s, "weekday_of": time.weekday_of}


def test_functions(spark):
    surface.register(spark)
    df = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    for name, f in WITH_TEXT.items():
        got = df.select("x", F.expr(f"{name}(x)").alias("a"), f(F.col("x")).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got), name
    n = spark.createDataFrame([(-23.5, -46.6, -23.4, -46.7), (0.0, 0.0, 0.0, 180.0), (90.0, 0.0, -90.0, 0.0), (1.0, 2.0, 1.0, 2.0), (None, 1.0, 1.0, 1.0), (30.0, -3.0, 0.0, 0.0), (30.0, 5.0, 0.0, 0.0)], "a double, b double, c double, d double")
    for r in n.select(F.expr("haversine_m(a, b, c, d)").alias("x"), geo.haversine_m(*map(F.col, "abcd")).alias("y"), F.expr("leg_energy(a, b)").alias("u"), geo.leg_energy(F.col("a"), F.col("b")).alias("w")).collect():
        assert r["x"] == r["y"] and (r["u"] == pytest.approx(r["w"], abs=1e-12) if r["u"] is not None else r["w"] is None)
    h = spark.createDataFrame([("0123456789abcdef", "0123456789abcdee"), ("f" * 16, "0" * 16), (None, "0" * 16)], "a string, b string")
    assert [tuple(r) for r in h.select(F.expr("hamming_hex(a, b)"), text.hamming_hex(F.col("a"), F.col("b"))).collect()] == [(1, 1), (64, 64), (None, None)]
    assert spark.sql("SELECT tour_week(timestamp'2025-09-10 01:00:00') = date'2025-09-08' AS x").first()["x"]
    assert set(surface.FUNCTIONS) == {*WITH_TEXT, "haversine_m", "leg_energy", "hamming_hex", "tour_week"}


def test_views(spark):
    with pytest.raises(ValueError, match="lacks"):
        surface.register(spark, tours=spark.createDataFrame([("a",)], "tour string"))
    with pytest.raises(ValueError, match="no view"):
        surface.register(spark, other=spark.range(1))
    plan = plans.QUERIES["sql_distances"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Window" in plan
