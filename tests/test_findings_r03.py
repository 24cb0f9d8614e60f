"""What the findings of round 3 name, on small rows."""

from pyspark.sql import functions as F


def test_paragraphs_keep_digits_at_their_ends(spark):
    from trailmark.functions.text import paragraphs

    df = spark.createDataFrame([("0997 a0\n 1b1 \n\n2c2",)], "text string")
    assert df.select(paragraphs(F.col("text")).alias("p")).first()["p"] == ["0997 a0", "1b1", "2c2"]


def _largest_join(spark, df):
    """The rows that the largest join of df's plan makes."""
    df.collect()
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            p = p.executedPlan()
            name = p.nodeName()
        if "QueryStage" in name:
            p = p.plan()
            name = p.nodeName()
        if "Join" in name and p.metrics().contains("numOutputRows"):
            out = max(out, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return out


def test_asof_tour_with_many_rows_of_a_second(spark):
    from trailmark.operators.matching import asof_tour

    at = lambda s: F.timestamp_seconds(F.lit(86_400 * 9) + s)
    media = spark.range(400).select(F.col("id").alias("m"), at(F.col("id") % 4 * 3600).alias("ts"))
    tours = spark.range(300).select((F.col("id") + 1000).alias("tour"), at((F.col("id") % 3 - 1) * 1800 + 100).alias("ts"))
    got = asof_tour(media, tours)
    first = [300 % 3 + 1000 + k for k in range(3)]
    near = {0: first[1], 1: first[2], 2: first[2], 3: first[2]}
    assert {(r["m"], r["tour"]) for r in got.collect()} == {(k, near[k % 4]) for k in range(400)}
    assert _largest_join(spark, got) <= 400


def test_t_junctions_with_many_lines_through_few_places(spark):
    from trailmark.operators import roads as g

    ends = lambda k: [(k, 0, 0.0, float(k % 3)), (k, 1, 30.0, float(k % 3))]
    rows = [x for k in range(60) for x in ends(k)] + [(100 + k, 0, 10.0, float(k % 2)) for k in range(90)] + [(100 + k, 1, 10.0, 20.0 + k % 2) for k in range(90)]
    lines = spark.createDataFrame(rows, "line int, seq int, r double, c double")
    segs = g.segments(lines)
    got = g.t_junctions(lines, segs, 0.02)

    def plain():
        byl = {}
        for l, q, r, c in rows:
            byl.setdefault(l, {})[q] = (r, c)
        for l, e in byl.items():
            (r1, c1), (r2, c2) = e[0], e[1]
            for vl, _, r, c in rows:
                t = ((r - r1) * (r2 - r1) + (c - c1) * (c2 - c1)) / ((r2 - r1) ** 2 + (c2 - c1) ** 2)
                if vl != l and 1e-9 < t < 1 - 1e-9 and ((r - r1 - t * (r2 - r1)) ** 2 + (c - c1 - t * (c2 - c1)) ** 2) ** 0.5 <= 0.02:
                    yield l, round(t, 6), r, c

    assert {(r["line"], round(r["t"], 6), r["r"], r["c"]) for r in got.collect()} == set(plain())
    assert _largest_join(spark, got) <= 20 * 150


def test_nearest_node_with_many_rows_of_a_place(spark):
    from trailmark.operators.roads import nearest_node

    points = spark.range(900).select(F.col("id").alias("p"), (F.col("id") % 3).cast("double").alias("r"), F.lit(0.5).alias("c"))
    nodes = spark.range(800).select(F.col("id"), (F.col("id") % 2 * 100).cast("double").alias("r"), F.lit(0.5).alias("c"), F.lit(True).alias("valid"))
    got = nearest_node(points, nodes, 0.01)
    assert {tuple(r) for r in got.collect()} == {(k, 0, float(k % 3)) for k in range(900)}
    assert _largest_join(spark, got) <= 900


def test_phash_gathers_few_rows_of_a_picture(spark):
    """Pictures of odd sizes against the plain rule; what comes out of a join is one row per pixel at most."""
    import math

    from trailmark.operators import matching as m

    sizes = {0: (40, 40), 1: (7, 90), 2: (33, 5), 3: (64, 150), 4: (1, 1)}
    tone = lambda i, r, c: float((i * 31 + r * r * 7 + c * 13 + r * c) % 256)
    rows = [(i, r, c, *[tone(i + k, r, c) for k in range(3)]) for i, (h, w) in sizes.items() for r in range(h) for c in range(w)]
    df = spark.createDataFrame(rows, "img int, r int, c int, red double, green double, blue double")
    grid = m.luma(df)
    got = {(x["img"], x["r"], x["c"]): x["luma"] for x in grid.collect()}

    def plain(i, a, b):
        h, w = sizes[i]
        u, v = (b + 0.5) * w / 32 - 0.5, (a + 0.5) * h / 32 - 0.5
        x0, y0 = math.floor(u), math.floor(v)
        px = lambda r, c: sum(k * t for k, t in zip((0.299, 0.587, 0.114), [tone(i + q, max(0, min(r, h - 1)), max(0, min(c, w - 1))) for q in range(3)]))
        fx, fy = u - x0, v - y0
        return px(y0, x0) * (1 - fx) * (1 - fy) + px(y0, x0 + 1) * fx * (1 - fy) + px(y0 + 1, x0) * (1 - fx) * fy + px(y0 + 1, x0 + 1) * fx * fy

    assert set(got) == {(i, a, b) for i in sizes for a in range(32) for b in range(32)}
    assert all(abs(x - plain(*k)) < 1e-6 for k, x in got.items())
    assert m.phash(grid).count() == 5
    assert _largest_join(spark, grid) <= len(rows)


def test_trip_candidates_of_a_crowded_day(spark, monkeypatch):
    """Each pair once, whether rows repeat or not, and without a shuffle of the pairs where they don't."""
    import datetime

    from trailmark.operators import matching as m

    monkeypatch.setattr(m, "TOURS_A_BLOCK", 8)
    day = datetime.date(2024, 5, 2)
    tours = spark.range(50).select(F.col("id").alias("tour"), F.lit(day).alias("date"))
    routes = spark.range(50).select(F.col("id").alias("tour"), F.lit(0.5).alias("lat"), F.lit(0.5).alias("lng"), F.lit(10.0).alias("dist_m"))
    at = F.when(F.col("id") % 2 == 0, F.lit(datetime.datetime(2024, 5, 3, 1))).otherwise(F.lit(datetime.datetime(2024, 5, 2, 1)))
    trips = spark.range(40).select(F.col("id").alias("trip"), at.alias("departed"), F.lit(9.0).alias("distance"), *[F.lit(x).alias(k) for k, x in {"sw_lat": 0.0, "sw_lng": 0.0, "ne_lat": 1.0, "ne_lng": 1.0}.items()])
    every = sorted((a, b) for a in range(50) for b in range(40))
    got = m.trip_candidates(tours, routes, trips)
    assert sorted(map(tuple, got.collect())) == every
    assert "keys=[tour#" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    two = m.trip_candidates(tours.union(tours.withColumn("date", F.date_add("date", 1))), routes.union(routes), trips)
    assert sorted(map(tuple, two.collect())) == every


def test_relax_shuffles_edges_once(spark, monkeypatch):
    """However many rounds a search takes, with fronts that are sent to the edges and with larger ones."""
    from trailmark.operators import energy

    n = 12
    rows = [(k, k + 1, f"e{k}", 1.0) for k in range(n)] + [(0, 100 + k, f"f{k}", 1.0) for k in range(5)]
    half = spark.createDataFrame(rows, "src long, dst long, edge string, cost double")
    start = spark.createDataFrame([("o", 0)], "origin string, node long")
    plans, settled = [], energy.settled
    monkeypatch.setattr(energy, "settled", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), settled(df))[1])
    for most in (200_000, 0):
        monkeypatch.setattr(energy, "FRONT_TO_SEND", most)
        plans.clear()
        got = {r["node"]: r["energy"] for r in energy.relax(half, start).collect()}
        assert got == {k: float(k) for k in range(n + 1)} | {100 + k: 1.0 for k in range(5)}
        rounds = [p for p in plans if "dealt_" in p]
        assert len(rounds) == n + 1
        for p in rounds:
            lines = p.split("\n")
            at = next(k for k, x in enumerate(lines) if "FileScan" in x and "dealt_" in x)
            above = [x for x in lines[:at] if x.index(x.lstrip(" :+-*(0123456789)")) < lines[at].index("FileScan")]
            join = max(k for k, x in enumerate(above) if "Join" in x)
            assert not any("Exchange hashpartitioning(src" in x for x in above[join:])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("dealt_")]


def test_sql_of_the_stream_states_the_cap():
    """600 users with an event each: the first 500 are admitted."""
    import pytest

    duckdb = pytest.importorskip("duckdb")
    from trailmark import plans

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_milliseconds(i) AS ts, i AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value FROM range(600) x(i)")
    ids = {int(r[0], 16) for r in con.sql(plans.SQL["l8_stream_snapshot"]).fetchall()}
    assert ids == set(range(500))
    assert len({r[0] for r in con.sql(plans.SQL["l9_batch_equivalent"]).fetchall()}) == 600


def test_energies_of_many_origins_in_blocks(spark, monkeypatch):
    """Blocks of few rows against relax(): several components, one way edges, origins of two nodes or none of the graph's."""
    import random

    from trailmark.operators import energy, searches

    draw = random.Random(4)
    node = lambda k: draw.randrange(15) + 100 * k
    rows = [(node(k), node(k), draw.choice([1.0, 2.5, 7.0, 3.0, 0.1]), f"e{k}-{i}") for k in range(3) for i in range(35)]
    half = spark.createDataFrame(rows, "src long, dst long, cost double, edge string")
    sources = spark.createDataFrame([(f"o{i}", draw.choice([node(k), 5000 + i])) for k in range(3) for i in range(6 * k, 6 * k + 7)], "origin string, node long")
    for name, size in {"ORIGINS_A_BLOCK": 5, "NODES_A_BLOCK": 7, "EDGES_AT_ONCE": 3}.items():
        monkeypatch.setattr(searches, name, size)
    got = sorted(map(tuple, searches.energies(half, sources, e_max=6.0).collect()))
    assert got == sorted(map(tuple, energy.relax(half, sources, e_max=6.0).select("origin", "node", "energy").collect()))
    only = searches.energies(half, sources, e_max=6.0, nodes=half.select(F.col("src").alias("node")).filter("node < 5").distinct())
    assert sorted(map(tuple, only.collect())) == [x for x in got if x[1] in {r[0] for r in rows if r[0] < 5}]


def test_round_trip_deals_edges_once(spark, monkeypatch):
    """Both searches of a round trip read the same table of edges, each with its own costs."""
    from trailmark.operators import energy

    rows = [(0, 1, "a", 1.0, 4.0), (1, 0, "a", 4.0, 1.0), (1, 2, "b", 2.0, 3.0), (2, 1, "b", 3.0, 2.0), (0, 2, "c", 9.0, 5.0), (2, 0, "c", 5.0, 9.0)]
    half = spark.createDataFrame(rows, "src long, dst long, edge string, cost double, back double")
    dealt, times = energy.dealt, []
    monkeypatch.setattr(energy, "dealt", lambda *a: (times.append(a[1]), dealt(*a))[1])
    got = {r["node"]: r["energy"] for r in energy.reach_round(half, spark.createDataFrame([("o", 0)], "origin string, node long")).collect()}
    assert got == {0: 0.0, 1: 5.0, 2: 3.0 + 5.0} and times == ["src"]


def test_match_census_of_crowded_days(spark):
    """A row meets counts, not the tours of its days and routes; rows without a tour aren't numbered together."""
    import datetime

    from trailmark.operators.matching import match_census

    day = lambda c: F.date_add(F.lit(datetime.date(2024, 5, 1)), c.cast("int"))
    crowd = spark.range(300).select(F.col("id").alias("tour"), day(F.col("id") % 2).alias("date"), (F.col("id") % 5).alias("route"), F.lit(False).alias("has_activity"))
    alone = spark.createDataFrame([(900, datetime.date(2024, 6, 10), 77, True), (901, datetime.date(2024, 6, 20), 5, False), (902, datetime.date(2024, 6, 25), 5, False)], crowd.schema)
    own = [(1000, datetime.date(2024, 1, 1), 77), (1001, datetime.date(2024, 6, 21), 5), (1002, datetime.date(2024, 6, 20), None), (1003, datetime.date(2024, 6, 9), 66), (1004, None, 66), (1005, datetime.date(2024, 6, 26), 6)]
    census = spark.range(200).select(F.col("id").alias("row"), day(F.col("id") % 3).alias("date"), (F.col("id") % 5).alias("route")).union(spark.createDataFrame(own, "row long, date date, route long"))
    got = match_census(census, crowd.union(alone))
    by_row = {r["row"]: (r["tour"], r["how"]) for r in got.collect()}
    assert len(by_row) == 206
    assert all(by_row[k] == (None, "two tours on that date" if k % 3 < 2 else "ambiguous within a day") for k in range(200))
    assert [by_row[k] for k in range(1000, 1006)] == [(900, "skipped"), (901, "route+date"), (None, "taken"), (None, "taken"), (None, "no tour"), (902, "date+-1")]
    assert _largest_join(spark, got) <= 303


def test_hamming_dedup_deals_bands_once(spark):
    """Known and incoming hashes against the plain rule; one exchange by bands, of numbers."""
    import random

    from trailmark.operators.matching import hamming_dedup

    draw = random.Random(7)
    base = [draw.getrandbits(64) for _ in range(6)]
    some = lambda: draw.choice(base) ^ sum(1 << k for k in draw.sample(range(64), draw.randrange(5)))
    rows = [(k, draw.choice("ab"), f"{some():016x}") for k in range(60)] + [(60, None, f"{base[0]:016x}"), (61, "a", None)]
    known = [(f"k{k}", draw.choice("ab"), f"{some():016x}") for k in range(4)]
    got = hamming_dedup(spark.createDataFrame(rows, "row long, kind string, hash string"), spark.createDataFrame(known, "id string, kind string, hash string"))
    like = lambda x, y: None not in (*x[1:], *y[1:]) and x[1] == y[1] and (int(x[2], 16) ^ int(y[2], 16)).bit_count() <= 5
    want = {x[0]: min((y[0] for y in known if like(x, y)), default=None) or next((str(y[0]) for y in rows if y[0] < x[0] and like(x, y)), None) for x in rows}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r["row"]: r["dup_of"] for r in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning(band" in x and "ReusedExchange" not in x]
    assert len(dealt) == 1, plan


def test_density_needs_no_trees_of_all_origins(spark, monkeypatch):
    """components that fit into a task are searched there; larger ones give the same."""
    from trailmark.operators import energy, searches

    rows = [(f"{a}-{b}", f"n{a}", f"n{b}", float(1 + (a * 7 + b * 3) % 5)) for a in range(20) for b in range(a + 1, 20) if (a * b + a + b) % 3 == 0 and a % 2 == b % 2]
    half = spark.createDataFrame([(e, *ends, c) for e, a, b, c in rows for ends in ((a, b), (b, a))], "edge string, src string, dst string, cost double")
    refs = spark.createDataFrame([(f"o{k}", f"n{k}") for k in range(0, 20, 3)] + [("o0", "n3"), ("alone", "x")], "origin string, node string")
    tree = energy.settled(energy.relax(half, refs))
    flow = {r["edge"]: r["p"] for r in energy.passes(tree).filter("edge is not null").groupBy("edge").agg(F.sum("passes").alias("p")).collect()}
    mean = {r["node"]: (r["energy"], r["reached"]) for r in energy.mean_energy(energy.partial_energy(tree)).collect()}
    told = lambda: [{r[0]: tuple(r[1:]) for r in x.collect()} for x in energy.density(half, refs)]
    with monkeypatch.context() as m:
        m.setattr(energy, "relax", None)
        m.setattr(searches, "ORIGINS_A_BLOCK", 3)
        got = told()
    assert got[0] == {e: (p,) for e, p in flow.items()} and got[1] == mean
    monkeypatch.setattr(searches, "EDGES_A_TASK", 45)
    assert told() == got


def test_folders_take_few_rounds(spark, monkeypatch):
    """folders at the ends of blocks don't take a round for each step in their lists."""
    import datetime as dt

    from trailmark.operators import matching

    from .test_operators import greedy_folders

    day = lambda k: dt.date(2025, 1, 1) + dt.timedelta(k)
    f = [(f"{day(k)} {n}", day(k), n % 3) for k in range(30) for n in range(4)]
    t = [(f"t{k:02d}{n}", day(k), n % 4) for k in range(30) for n in range(3)]
    made = []
    monkeypatch.setattr(matching, "settled", lambda df, of=matching.settled: made.append(1) or of(df))
    got = matching.match_folders(spark.createDataFrame(f, "name string, date date, number int"), spark.createDataFrame(t, "tour string, date date, seq int"), 3)
    assert {r["name"]: r["tour"] for r in got.collect()} == greedy_folders(f, t)
    assert len(made) <= 3 + 2 * 12


def test_facts_are_dealt_in_bounded_parts(spark, monkeypatch):
    """packed facts aren't put together into few tasks; repeated ones go."""
    from trailmark.operators import mutate
    from trailmark.sources import facts

    rows = [("d", f"c{k % 900}", p, f"_:{k % 900}" if p == "nation" else o, "bnode" if p == "nation" else "iri", None, None, None) for k in range(1000) for p, o in ((facts.TYPE, "C" if k % 2 else "D"), ("nation", None))]
    df = spark.createDataFrame(rows, "dump string, s string, p string, o string, o_kind string, o_dtype string, o_lang string, s_parent string")
    monkeypatch.setattr(facts, "FACTS_A_TASK", 100, raising=False)
    routed, named = mutate.route_by_class(df, "C", "new"), mutate.skolemise_bnodes(df, {"nation": "geo"})
    assert {r["dump"] for r in routed.filter("s = 'c101'").collect()} == {"new"} and routed.count() == 1800
    assert {r["o"] for r in named.filter("p = 'nation' and s = 'c7'").collect()} == {"c7_geo"} and named.count() == 1800
    assert all(x.rdd.getNumPartitions() == 20 for x in (routed, named))


def test_edge_profiles_ask_once_for_a_cell(spark):
    """an edge's points share their cells, and have the heights of sample_bilinear()."""
    from trailmark.operators import raster, roads

    cells = spark.createDataFrame([(r, c, float((r * 7 + c * 5) % 11), (r + c) % 4 > 0) for r in range(5) for c in range(5) if (r, c) != (2, 2)], "r int, c int, h double, mask boolean")
    edges = spark.createDataFrame([("flat", 0.5, 0.5, 0.5, 3.5), ("over", 1.0, 0.2, 4.9, 4.4), ("dot", 2.5, 2.5, 2.5, 2.5)], "edge string, r1 double, c1 double, r2 double, c2 double")
    got = roads.edge_profiles(edges, cells, 5, 5, 10.0, 10.0, 1.0)
    assert _largest_join(spark, got) < 40
    found = {r["edge"]: r for r in got.collect()}
    at = lambda e, k, n: (e["edge"] + f"#{k}", *[e[f"{x}1"] + (e[f"{x}2"] - e[f"{x}1"]) * k / n for x in "rc"])
    points = [at(e, k, n) for e in edges.collect() for n in [len(found[e["edge"]]["profile"]) - 1] for k in range(n + 1)]
    want = {r["id"]: r["h"] for r in raster.sample_bilinear(spark.createDataFrame(points, "id string, r double, c double"), cells, 5, 5).collect()}
    assert len(want) == 31 + 59 + 2 and len(found) == 3
    for e, r in found.items():
        assert [None if h is None else round(h, 9) for h in r["profile"]] == [None if (h := want[f"{e}#{k}"]) is None else round(h, 9) for k in range(len(r["profile"]))]


def test_pairs_of_one_template_go_where_they_meet(spark):
    """Long texts that share 60 % pass the small sketches, whatever they differ by; the join must not hand them on."""
    from trailmark.llm import jaccard

    common = [f"t{k}" for k in range(540)]
    texts = [" ".join(common + [f"d{i}x{k}" for k in range(360)]) for i in range(30)]
    texts.append(texts[0] + " more")
    sets = [jaccard.shingles(t) for t in texts]
    meet = [(cid, f"r{cid}", len(s), *map(int, jaccard.sketch(s)[1]), jaccard.sketch(s)[0].tolist()) for cid, s in enumerate(sets)]
    meet = spark.createDataFrame(meet, "cid long, rep string, n long, k0 long, k1 long, k2 long, k3 long, fine array<long>")
    mixed = spark.createDataFrame([(e, cid, True, cid) for e in (7, 8) for cid in range(len(sets))], "e long, cid long, whole boolean, comp long")
    got = [tuple(r) for r in jaccard.candidates(jaccard.with_sketches(mixed, meet), 80, 100).collect()]
    assert got == [(0, 30)]
    small = jaccard.with_sketches(mixed.filter("e = 7"), meet)
    pairs = small.alias("x").join(small.alias("y"), F.col("x.cid") < F.col("y.cid"))
    assert pairs.filter(jaccard.may_match("x", "y", 80, 100)).count() == 31 * 30 // 2
