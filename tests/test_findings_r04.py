"""What the findings of round 4 name, on small rows."""

import duckdb
from pyspark.sql import functions as F


def test_summary_of_odd_texts_equals_its_sql(spark, tmp_path):
    from trailmark import plans

    texts = [None, "", " \n\u00a0\n", "\u3000a\u00a0\nb", "\tc\u2003", "x" * 196 + "\u00a0" + "y" * 9, "x" * 195 + " \u00a0" + "y" * 9, "\r\n d", "é" * 201]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in plans.QUERIES["h17_tour_summary"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(c.execute(plans.SQL["h17_tour_summary"]).fetchall())


def _graph(spark):
    """Two components, one way edges, parallel ones, and an origin at a node without edges."""
    rows = [(f"{a}-{b}", a, b, float(1 + (a * 7 + b * 3) % 5)) for a in range(24) for b in range(24) if a != b and (a * b + a + b) % 4 == 0 and a % 2 == b % 2]
    half = spark.createDataFrame(rows + [("more", 2, 6, 1.0)], "edge string, src long, dst long, cost double")
    refs = spark.createDataFrame([(f"o{k}", k) for k in range(0, 24, 3)] + [("o0", 1), ("alone", 99)], "origin string, node long")
    return half, refs


def test_mean_energy_and_matrix_search_in_tasks(spark, monkeypatch):
    """energies of a node by an origin aren't kept between rounds, and equal those of larger components."""
    from trailmark.operators import energy, searches

    half, refs = _graph(spark)
    tree = energy.settled(energy.relax(half, refs).select("origin", "node", "energy"))
    mean = sorted(map(tuple, energy.mean_energy(energy.partial_energy(tree)).collect()))
    pairs = sorted(map(tuple, energy.accessibility_matrix(tree, refs).collect()))
    told = lambda: (sorted(map(tuple, energy.reached_energy(half, refs).collect())), sorted(map(tuple, energy.accessibility_matrix(searches.energies(half, refs, nodes=refs), refs).collect())))
    with monkeypatch.context() as m:
        m.setattr(searches, "energies_in_blocks", None)
        m.setattr(searches, "ORIGINS_A_BLOCK", 3)
        m.setattr(searches, "PAIRS_AT_ONCE", 10)
        assert told() == (mean, pairs)
    monkeypatch.setattr(searches, "EDGES_A_TASK", 45)
    assert told() == (mean, pairs)


def test_a_component_travels_packed(spark, monkeypatch):
    """what a block of origins takes along of its component are a few bytes an edge, not its rows."""
    from trailmark.operators import searches
    from trailmark.operators.energy import Scratch

    half, refs = _graph(spark)
    made = Scratch(spark)
    monkeypatch.setattr(searches, "ORIGINS_A_BLOCK", 1)
    parts = searches.by_component(half, refs, made)
    rows = searches.in_tasks(*parts, made)._df
    assert {"names", "named", "half"} <= set(rows.columns) and "src" not in rows.columns
    assert rows.count() == refs.count()


def test_matrix_doesnt_deal_missing_pairs(spark):
    """pairs that none leads between are made where they leave."""
    from trailmark.operators import energy

    refs = spark.range(300).select(F.concat(F.lit("o"), "id").alias("origin"), F.col("id").alias("node"))
    tree = refs.filter("node < 3").crossJoin(refs.select(F.col("node").alias("to")).filter("to < 3")).select("origin", F.col("to").alias("node"), F.lit(1.0).alias("energy"))
    got = energy.accessibility_matrix(tree, refs)
    assert got.count() == 300 * 299 and got.filter("energy = 1").count() == 6
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_closest_trips_are_those_of_all_pairs(spark, monkeypatch):
    """best trips without the pairs, on crowded days, with ties, boxes, parts and tours that few trips suit."""
    import random

    from trailmark.operators import matching as m

    draw = random.Random(2)
    day = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), k)
    tours = spark.createDataFrame([(k, k % 3) for k in range(150)], "tour long, d int").select("tour", day(F.col("d")).alias("date"))
    routes = spark.createDataFrame([(k, draw.randrange(30) / 100, draw.randrange(30) / 100, float(draw.choice([1, 5, 20, 99]))) for k in range(149)] + [(149, None, 0.1, 1.0)], "tour long, lat double, lng double, dist_m double")
    boxes = [(draw.randrange(30) / 100, draw.randrange(30) / 100, draw.choice([0, 0, 5]) / 100, draw.choice([0, 5]) / 100) for _ in range(400)]
    rows = [(f"t{k}", k % 3, draw.choice([2, 9]), float(draw.choice([1, 4, 18, 90])), s, w, s + h, w + b) for k, (s, w, h, b) in enumerate(boxes)] + [("none", 0, 9, 99.0, None, None, None, None)]
    trips = spark.createDataFrame(rows, "trip string, d int, h int, distance double, sw_lat double, sw_lng double, ne_lat double, ne_lng double")
    trips = trips.withColumn("departed", F.timestamp_seconds(F.unix_timestamp(day(F.col("d")).cast("timestamp")) + F.col("h") * 3600)).drop("d", "h")
    c = m.candidate_trips(tours, routes, trips)
    every = c.select("tour", "trip", F.floor(F.abs(F.col("lat") - F.col("sw_lat")) * 300).alias("d_start"), F.floor(F.abs(F.col("ne_lat") - F.col("lat")) * 300).alias("d_end")).filter("d_start <= 40")
    want = sorted(map(tuple, m.best_trip(every).collect()))
    told = lambda: m.closest_trips(tours, routes, trips, scale=300.0, most=40.0)
    assert sorted(map(tuple, m.best_trip(told()).collect())) == want and len(want) > 100
    for name, size in {"TOURS_A_BLOCK": 20, "TRIPS_A_BLOCK": 90, "TOURS_AT_ONCE": 4, "TRIPS_AT_FIRST": 8}.items():
        monkeypatch.setattr(m, name, size)
    got = told()
    assert sorted(map(tuple, m.best_trip(got).collect())) == want
    assert "Join Inner, ((date" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_search_deals_its_own_component(spark, monkeypatch):
    """F7, F8: edges that no way from the sources uses are written once, and neither dealt nor read in rounds."""
    from trailmark.operators import energy

    rows = [(100 * c + k, 100 * c + k + 1, f"e{c}-{k}", 1.0 + k % 2, 2.0, 5.0) for c in range(20) for k in range(3)]
    half = spark.createDataFrame([r for a, b, e, c, w, m in rows for r in ((a, b, e, c, w, m), (b, a, e, w, c, m))], "src long, dst long, edge string, cost double, back double, len_m double")
    start = spark.createDataFrame([("o", 300)], "origin string, node long")
    dealt, sizes = energy.dealt, []
    monkeypatch.setattr(energy, "dealt", lambda df, key: (sizes.append(df.count()), dealt(df, key))[1])
    told = lambda: sorted(map(tuple, energy.reach_round(half, start).collect()))
    near = told()
    assert sizes == [6] and len(near) == 4 and near[3] == ("o", 303, 4.0 + 6.0)
    assert energy.top_n_routes(half, 300, 301, 1).count() == 2 and sizes == [6] * 2
    monkeypatch.setattr(energy, "FEW_ROUNDS", 2)
    assert told() == near and sizes[2:] == [120]


def test_days_of_many_tours_take_few_rounds(spark, monkeypatch):
    """days of 12,000 tours aren't walked in parts, one after the other."""
    from trailmark.operators import matching

    day = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 2).cast("int"))
    tours = spark.range(24_000).select(F.format_string("t%05d", "id").alias("tour"), day.alias("date"), F.lit(None).cast("int").alias("seq"))
    folders = spark.range(26_000).select(F.format_string("f%05d", "id").alias("name"), day.alias("date"), F.lit(None).cast("int").alias("number"))
    made = []
    monkeypatch.setattr(matching, "settled", lambda df, of=matching.settled: made.append(1) or of(df))
    got = {r["name"]: r["tour"] for r in matching.match_folders(folders, tours).collect()}
    assert all(got[f"f{k:05d}"] == (f"t{k:05d}" if k < 24_000 else None) for k in range(26_000))
    assert len(made) <= 3 + 2 * 2
