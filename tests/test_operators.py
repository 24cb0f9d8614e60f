"""Operators on small rows of their own, where SQL has no say."""

import datetime as dt
import heapq
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailmark.functions import geo, text, time
from trailmark.operators import catalogue, energy, matching, mutate, raster, roads, rules, trajectory
from trailmark.sources import facts, files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    "got,want",
    [
        (lambda: text.norm_key(lit("Água Preta-2")), "aguapreta2"),
        (lambda: text.route_slug(lit("  São João: 1ª volta! ")), "sao-joao-1-volta"),
        (lambda: text.own_route_slug(lit("https://evil.example/route/x")), None),
        (lambda: text.contributor_of(lit("a.jpg"), lit("fotos Ana - extra")), "Ana"),
        (lambda: text.contributor_of(lit("zé WhatsApp Image 1.jpg"), lit(None)), "zé"),
        (lambda: text.parse_folder_name(lit("2026-06-16 PH 96 - Super"))["title"], "Super"),
        (lambda: text.sheet_value(lit("1,234")), "1234"),
        (lambda: text.sheet_value(lit("#DIV/0!")), None),
        (lambda: text.original_ext(lit("IMAGE/HEIF")), "heif"),
        (lambda: text.original_ext(lit(None)), "jpg"),
        (lambda: text.media_kind(lit("a.TIFF")), "image"),
        (lambda: text.parse_folder_name(lit("2026-06-16 - 7 SN - Noite"))["number"], 7),
        (lambda: text.parse_folder_name(lit("Super 2026-06-16"))["title"], None),
        (lambda: text.own_route_slug(lit("https://www.example.org:80/route/Abc-1/")), "abc-1"),
        (lambda: text.is_media_folder(lit("Mídias do passeio")), True),
        (lambda: time.iso_duration_s(lit("P1DT1H51M15.5S")), 86400 + 6660 + 15.5),
        (lambda: time.iso_duration_s(lit("1h")), None),
        (lambda: time.fmt_duration(lit("PT3H5M")), "3h05"),
        (lambda: time.fmt_duration(lit("PT15S")), None),
        (lambda: time.write_duration(lit(5430)), "PT1H30M"),
        (lambda: time.clock_to_iso(lit("1:02:03")), "PT1H2M3S"),
        (lambda: time.sheet_date_ms(lit("Date(2026,0,2,3,4,5)")), 1767333845000),
        (lambda: time.dms_to_decimal(lit(23.0), lit(30.0), lit(36.0), lit("S")), -23.51),
        (lambda: time.clock_or_number_s(lit("0:01:02.5")), 62.5),
        (lambda: time.minute_round_local(lit(1767333845)), "2026-01-02T03:04:00-03:00"),
        (lambda: time.parse_date_ms(lit("nonsense")), None),
        (lambda: files.tile_name(lit(-23.5), lit(-46.2)), "S24W047"),
        (lambda: geo.haversine_m(lit(0.0), lit(0.0), lit(None).cast("double"), lit(1.0)), None),
    ],
)
def test_scalars(spark, got, want):
    assert one(spark, got()) == want


def test_polyline(spark):
    pts = one(spark, files.decode_polyline(lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")))
    assert [(p["lat"], p["lng"]) for p in pts] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert one(spark, files.decode_polyline(lit("_p~iF"))) is None and one(spark, files.decode_polyline(lit(None).cast("string"))) is None


def test_gpx(spark):
    gpx = '<gpx><wpt lat="1.1234567" lon="2"><name>A &amp;amp; B</name></wpt><trkpt lat="1" lon="2"><ele>3.5</ele></trkpt><trkpt lon="5" lat="4"/><trkpt lat="x" lon="1"/></gpx>'
    df = spark.createDataFrame([("p", gpx)], "path string, value string")
    assert [tuple(r)[2:] for r in files.gpx_points(df).collect()] == [(1.0, 2.0, 3.5), (4.0, 5.0, None)]
    poi = files.gpx_pois(df).first()
    assert (poi["lat"], poi["name"]) == (1.12346, "A &amp; B")


def test_triples(spark, tmp_path):
    (tmp_path / "tours.nt").write_text('<a> <http://schema.org/name> "x \\"y\\""@pt .\n<a> <p> _:b .\n<a_geo> <p> "1"^^<int> .\n<a> <p> _:b .\nbroken\n')
    got = {tuple(r) for r in facts.read_triples(spark, str(tmp_path / "tours.nt")).collect()}
    assert got == {("tours", "a", "https://schema.org/name", 'x "y"', "literal", "rdf:langString", "pt", None), ("tours", "a", "p", "_:b", "bnode", None, None, None), ("tours", "a_geo", "p", "1", "literal", "int", None, "a")}
    df = facts.read_triples(spark, str(tmp_path / "tours.nt"))
    roots = spark.createDataFrame([("a",)], "s string")
    assert mutate.purge(df, roots).count() == 0 and mutate.upsert(df, df).exceptAll(df).count() == 0


def test_fixtures_and_rules(spark):
    docs = rules.generate_fixtures(spark, 5, 16)
    empty = docs.drop("doc", "flaw").limit(0)
    found, ok = rules.validate(docs.drop("flaw"), empty, rules.rule_table(spark))
    flaw = {r["doc"]: r["flaw"] for r in docs.select("doc", "flaw").distinct().collect()}
    serious = {"no_title", "two_titles", "no_date", "bad_date_type", "two_dates", "title_iri", "negative_energy", "energy_type", "two_energies"}
    assert {r["doc"]: r["ok"] for r in ok.collect()} == {d: f not in serious for d, f in flaw.items()}
    assert {r["severity"] for r in found.collect()} == {"Violation", "Warning"}
    assert len(rules.SHAPES) == 65


def test_folders(spark):
    f = spark.createDataFrame([("a", "2025-01-02", 2), ("b", "2025-01-02", None), ("c", "2025-01-03", None), ("d", None, None)], "name string, date string, number int").withColumn("date", F.col("date").cast("date"))
    t = spark.createDataFrame([("t1", "2025-01-02", 1), ("t2", "2025-01-02", 2), ("t3", "2025-02-01", 3)], "tour string, date string, seq int").withColumn("date", F.col("date").cast("date"))
    assert {r["name"]: r["tour"] for r in matching.match_folders(f, t).collect()} == {"a": "t2", "b": "t1", "c": None, "d": None}


def greedy_folders(folders, tours):
    """The rule one folder after the other."""
    free, out = sorted(tours), {}
    for name, day, number in sorted(folders, key=lambda f: (f[0], f[1], -1 if f[2] is None else f[2])):
        found = [t for d in (0, -1, 1) for t in free if t[1] == day + dt.timedelta(d)]
        found = [t for t in found if number is not None and t[2] == number] or found
        if found:
            free.remove(found[0])
        out[name] = found[0][0] if found else None
    return out


@pytest.mark.parametrize("seed,block,days", [(1, 6, 12), (3, 9, 4), (4, 1000, 40)])
def test_folders_in_rounds(spark, seed, block, days):
    """Dense calendars, crowded days, names that don't follow dates, tours without a number."""
    rnd = random.Random(seed)
    day = lambda: dt.date(2025, 1, 1) + dt.timedelta(min(rnd.randrange(days), rnd.randrange(days)))
    f = [(f"{rnd.randrange(10**6):06d}-{k}", day(), rnd.choice([None, 1, 2, 3])) for k in range(60)]
    t = [(f"t{k:03d}", day(), rnd.choice([None, 1, 2, 3])) for k in range(50)]
    got = matching.match_folders(spark.createDataFrame(f, "name string, date date, number int"), spark.createDataFrame(t, "tour string, date date, seq int"), block)
    assert {r["name"]: r["tour"] for r in got.collect()} == greedy_folders(f, t)


def test_folders_of_a_given_calendar(spark):
    from trailmark import plans

    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("date")).collect()
    f = [(f"{r['date']} {r['o_orderkey']}", r["date"], r["o_custkey"] % 9) for r in o if r["o_orderstatus"] == "F"]
    t = [(f"t{r['o_orderkey']}", r["date"], r["o_custkey"] % 9) for r in o if r["o_orderstatus"] == "O"]
    got = {r["name"]: r["tour"] for r in plans.QUERIES["e2_match_folders"](spark, "/root/testdata/sf0.001").collect()}
    assert got == greedy_folders(f, t) and sum(x is not None for x in got.values()) > 100
    none = spark.createDataFrame([], "tour string, date date, seq int")
    assert all(r["tour"] is None for r in matching.match_folders(spark.createDataFrame(f[:5], "name string, date date, number int"), none).collect())


def test_hamming_is_exact(spark):
    base = 0x0123456789ABCDEF
    rows = [(k, "x", f"{base ^ bits:016x}") for k, bits in enumerate([0, 0b11111, 0b111111, 1 << 63, (1 << 10 | 1 << 20 | 1 << 30 | 1 << 40 | 1 << 50)])]
    df = spark.createDataFrame(rows, "row long, kind string, hash string")
    got = {r["row"]: r["dup_of"] for r in matching.hamming_dedup(df, spark.createDataFrame([], "id string, kind string, hash string")).collect()}
    assert got == {0: None, 1: "0", 2: "1", 3: "0", 4: "0"}


def test_stops_and_visits(spark):
    pts = [("a", k, t, 0.0, 0.0, v, None) for k, (t, v) in enumerate([(0, 0.0), (50, 0.0), (95, 0.1), (100, 5.0), (200, 5.0), (210, 0.0), (400, 0.0), (401, 9.0)])]
    df = spark.createDataFrame(pts, "trip string, seq long, t long, lat double, lng double, speed double, power double")
    assert sorted((r["t0"], r["t1"]) for r in trajectory.stops(df).collect()) == [(0, 95), (100, 200), (210, 400)]
    e = trajectory.integrate_power(df.withColumn("power", F.lit(100.0)), spark.createDataFrame([("a", 0, 401)], "trip string, t0 long, t1 long")).first()
    assert (e["kj"], e["moving_s"]) == (1.6, 6)


def brute(edges, src):
    best, heap = {src: 0.0}, [(0.0, src)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for a, b, c in edges:
            if a == u and d + c < best.get(b, 1e18):
                best[b] = d + c
                heapq.heappush(heap, (d + c, b))
    return best


def test_reach_passes_paths(spark):
    edges = [(1, 2, 4.0, 1.0), (2, 3, 1.0, 1.0), (1, 3, 7.0, 2.0), (3, 4, 1.0, 9.0), (4, 5, 2.0, 2.0), (7, 8, 1.0, 1.0)]
    df = spark.createDataFrame([(f"{a}-{b}", a, b, x, y) for a, b, x, y in edges], "edge string, a long, b long, cost_ab double, cost_ba double")
    half = roads.half_edges(df)
    src = spark.createDataFrame([("o", 1)], "origin string, node long")
    tree = energy.settled(energy.reach(half, src))
    want = brute([(a, b, x) for a, b, x, _ in edges] + [(b, a, y) for a, b, _, y in edges], 1)
    assert {r["node"]: r["energy"] for r in tree.collect()} == want
    left = energy.inverted_reach(half, src, 8.0)
    want = brute([(a, b, max(8.0 - c, 0.0)) for a, b, x, y in edges for a, b, c in ((a, b, x), (b, a, y))], 1)
    assert {r["node"]: r["energy"] for r in left.collect()} == want
    refs = spark.createDataFrame([("one", 1), ("five", 5), ("far", 7)], "origin string, node long")
    known = {x: brute([(a, b, c) for a, b, x, y in edges for a, b, c in ((a, b, x), (b, a, y))], n) for x, n in (("one", 1), ("five", 5), ("far", 7))}
    pairs = energy.accessibility_matrix(energy.reach(half, refs), refs).collect()
    assert len(pairs) == 6 and all(r["energy"] == known[r["origin"]].get({"one": 1, "five": 5, "far": 7}[r["target"]], float("inf")) for r in pairs)
    every = {r["node"]: (r["energy"], r["reached"]) for r in energy.density(half, refs)[1].collect()}
    assert every == {n: (sum(x[n] for x in known.values() if n in x) / k, k) for n in range(1, 9) if (k := sum(n in x for x in known.values()))}
    flow = {r["node"]: r["passes"] for r in energy.passes(tree).collect()}
    assert flow == {1: 5, 2: 4, 3: 3, 4: 2, 5: 1}
    path = energy.extract_path(tree, spark.createDataFrame([("o", 5), ("o", 8)], "origin string, target long")).orderBy("back").collect()
    assert [r["node"] for r in path] == [5, 4, 3, 2, 1]
    assert {r["node"]: r["energy"] for r in energy.reach_round(half, src).collect()}[3] == 5.0 + 2.0
    far = {(r["origin"], r["target"]): r["energy"] for r in energy.accessibility_matrix(tree, spark.createDataFrame([("o", 1), ("p", 8)], "origin string, node long")).collect()}
    assert far[("o", "p")] == float("inf")
    walk, best = energy.max_energy_walk(half, 1, 3)
    assert [r["node"] for r in walk.orderBy("layer").collect()] == [1, 3, 4, 3] and max(r["energy"] for r in best.collect()) == 7 + 1 + 9


def test_raster(spark):
    cells = spark.createDataFrame([(r, c, float(10 * r + c), not (r == 1 and c == 1)) for r in range(3) for c in range(3)], "r int, c int, h double, mask boolean")
    pts = spark.createDataFrame([("centre", 0.5, 0.5), ("corner", 1.0, 1.0), ("hole", 1.5, 1.5)], "id string, r double, c double")
    h = {r["id"]: r["h"] for r in raster.sample_bilinear(pts, cells, 3, 3).collect()}
    assert h["centre"] == 0.0 and abs(h["corner"] - (0 + 1 + 10) / 3) < 1e-9 and h["hole"] == 11.0
    assert [len(raster.move_list(n)) for n in (4, 8, 16, 32)] == [4, 8, 16, 32]
    filled = {(r["r"], r["c"]): r["v"] for r in raster.idw_fill(cells, cells.filter("r = 0 and c = 0").select("r", "c", F.col("h").alias("v")), 5).collect()}
    assert filled[(2, 2)] == 0.0 and filled[(1, 2)] is None
    d = {(r["r"], r["c"]): r["d"] for r in raster.distance_to_used(cells, cells.filter("r = 0 and c = 0").select("r", "c")).collect()}
    assert d[(0, 2)] == 2.0 and abs(d[(2, 1)] - 7 / 3) < 1e-9


def test_crossings_and_edges(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 4.0, 4.0), (2, 0, 0.0, 4.0), (2, 1, 4.0, 0.0), (3, 0, 2.0, 0.0), (3, 1, 2.0, 9.0)], "line long, seq long, r double, c double")
    lines = spark.createDataFrame([(1, False, 0), (2, False, 0), (3, True, 1)], "line long, deck boolean, layer int")
    segs = roads.segments(v)
    cut = {(r["line"], round(r["t"], 6)) for r in roads.crossings(segs, lines, cell=1.0).collect()}
    assert cut == {(1, 0.5), (2, 0.5)}
    assert roads.emit_edges(segs, roads.crossings(segs, lines, cell=1.0), 0.01).count() == 5


def test_decks(spark):
    decks = spark.createDataFrame([("x", 1, 1, 2, 10.0, 0.0, -5.0), ("y", 1, 3, 2, 10.0, 8.0, -5.0), ("z", 2, 2, 9, 1.0, 1.0, 2.0)], "line string, layer int, a long, b long, len double, ha double, hb double")
    got = {r["line"]: (r["h0"], r["h1"]) for r in roads.deck_chains(decks).collect()}
    assert got == {"x": (0.0, 4.0), "y": (8.0, 4.0), "z": (1.0, 2.0)}


@pytest.mark.parametrize("seed,tile", [(1, 8), (2, 64)])
def test_distances_by_tiles(spark, seed, tile, monkeypatch):
    """A maze around the origin, whose ways wind through many tiles, and an island that nothing reaches."""
    rnd = random.Random(seed)
    cells = {(r, c) for r in range(-8, 8) for c in range(-9, 9) if (r % 4 or c in (-9, 8)[r // 4 % 2 : r // 4 % 2 + 1]) and rnd.random() < 0.93} | {(90, 90), (90, 91)}
    seeds = [c for c in sorted(cells) if c[0] == 7][:2] + [(500, 500)]
    best, heap = dict.fromkeys(seeds[:2], 0), [(0, s) for s in seeds[:2]]
    while heap:
        d, (r, c) = heapq.heappop(heap)
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                to, cost = (r + i, c + j), d + (4 if i and j else 3)
                if to in cells and cost < best.get(to, 1e9):
                    best[to] = cost
                    heapq.heappush(heap, (cost, to))
    rounds = []
    real = raster.settled
    monkeypatch.setattr(raster, "settled", lambda df: rounds.append(1) or real(df))
    df = lambda xs: spark.createDataFrame(sorted(xs), "r int, c int")
    got = {(r["r"], r["c"]): r["d"] for r in raster.distance_to_used(df(cells), df(seeds), tile).collect()}
    assert got == {k: d / 3 for k, d in best.items()} and len(got) > 100
    assert tile < 64 or len(rounds) <= 20  # the corridors cross the four tiles around the origin again and again


def test_phash(spark):
    px = [(i, r, c, float((r * 5 + c * (3 + i)) % 256), float(c), float(r)) for i in range(2) for r in range(40) for c in range(40)]
    df = spark.createDataFrame(px, "img int, r int, c int, red double, green double, blue double")
    got = matching.phash(matching.luma(df)).collect()
    assert len(got) == 2 and all(len(r["hash"]) == 16 for r in got)


FACT = "dump string, s string, p string, o string, o_kind string, o_dtype string, o_lang string, s_parent string"


def test_split_follows_long_lists(spark):
    rows = [(None, "x", facts.TYPE, "Order", "iri", None, None, None), (None, "x", "list", "_:b0", "bnode", None, None, None)]
    rows += [(None, f"_:b{k}", "rest", f"_:b{k + 1}", "bnode", None, None, None) for k in range(13)]
    out = mutate.split_by_class(spark.createDataFrame(rows, FACT), {"Order": "tours"})
    assert {r["dump"] for r in out.collect()} == {"tours"}


def test_closure_of_a_deep_hierarchy(spark):
    triples = spark.createDataFrame([(None, "x", facts.TYPE, "c0", "iri", None, None, None)], FACT)
    sub = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(20)] + [("c20", "c19")], "child string, parent string")
    none = spark.createDataFrame([], "p string, c string")
    out = catalogue.rdfs_closure(triples, sub, none, none).filter(F.col("p") == facts.TYPE)
    assert {r["o"] for r in out.collect()} == {f"c{k}" for k in range(21)}


def test_chain_of_many_decks(spark):
    n = 54
    decks = [(f"d{k:02}", 1, f"n{k:02}", f"n{k + 1:02}", 1.0, 5.0, float(n if k == n - 1 else 5)) for k in range(n)]
    decks[0] = decks[0][:5] + (0.0, 5.0)
    decks += [(f"f{k}", 1, "m", f"m{k}", 1.0, 7.0, 8.0) for k in range(3)] + [("r0", 1, "p", "q", 1.0, 7.0, 8.0), ("r1", 1, "q", "p", 1.0, 7.0, 8.0)]
    out = {r["line"]: (r["h0"], r["h1"]) for r in roads.deck_chains(spark.createDataFrame(decks, "line string, layer int, a string, b string, len double, ha double, hb double")).collect()}
    assert out == {f"d{k:02}": pytest.approx((k, k + 1)) for k in range(n)} | {x: (7.0, 8.0) for x in ("f0", "f1", "f2", "r0", "r1")}


def test_a_ramp_of_thousands_of_decks(spark, monkeypatch):
    """In rounds of the logarithm; ways of either direction, layers apart, rings that never end beside them."""
    n, rnd = 3_000, random.Random(5)
    length = [rnd.randrange(1, 9) for _ in range(n)]
    decks = []
    for k in range(n):
        a, b, ha, hb = f"n{k}", f"n{k + 1}", 3.0 if k == 0 else -1.0, 50.0 if k == n - 1 else -2.0
        decks.append((f"d{k}", 1, a, b, float(length[k]), ha, hb) if rnd.random() < 0.5 else (f"d{k}", 1, b, a, float(length[k]), hb, ha))
    decks += [(f"r{k}", 1, f"q{k}", f"q{(k + 1) % 5}", 1.0, 7.0, 8.0) for k in range(5)] + [("x", 2, "n0", "n1", 1.0, 7.0, 8.0), ("loop", 2, "z", "z", 1.0, 7.0, 8.0), ("y", None, "n0", "n1", 1.0, 7.0, 8.0)]
    rounds = []
    real = roads.settled
    monkeypatch.setattr(roads, "settled", lambda df: rounds.append(1) or real(df))
    got = {r["line"]: (r["h0"], r["h1"]) for r in roads.deck_chains(spark.createDataFrame(decks, "line string, layer int, a string, b string, len double, ha double, hb double")).collect()}
    at, want = [3.0 + 47.0 * sum(length[:k]) / sum(length) for k in range(n + 1)], {}
    for line, layer, a, *_ in decks:
        k = int(line[1:]) if line[0] == "d" else None
        want[line] = (7.0, 8.0) if k is None else pytest.approx((at[k], at[k + 1]) if a == f"n{k}" else (at[k + 1], at[k]))
    assert got == want and len(rounds) <= 20


def test_passes_in_deep_and_wide_trees(spark, monkeypatch):
    rnd = random.Random(9)
    up = {"a": {k: k - 1 if k else None for k in range(3_000)}, "b": {k: rnd.randrange(k) if k else None for k in range(400)}}
    want, chosen = {}, {(o, k) for o in up for k in up[o] if rnd.random() < 0.5}
    for o, parents in up.items():
        below, own = dict.fromkeys(parents, 1), {k: int((o, k) in chosen) for k in parents}
        for k in sorted(parents, reverse=True):
            if parents[k] is not None:
                below[parents[k]] += below[k]
                own[parents[k]] += own[k]
        want |= {(o, k): (below[k], own[k]) for k in parents}
    tree = spark.createDataFrame([(o, k, p, k) for o in up for k, p in up[o].items()], "origin string, node int, parent int, edge int")
    rounds = []
    real = energy.settled
    monkeypatch.setattr(energy, "settled", lambda df: rounds.append(1) or real(df))
    every = {(r["origin"], r["node"]): r["passes"] for r in energy.passes(tree).collect()}
    assert len(rounds) <= 14
    some = {(r["origin"], r["node"]): r["passes"] for r in energy.passes(tree, spark.createDataFrame(sorted(chosen), "origin string, node int")).collect()}
    assert {k: (every[k], some[k]) for k in every} == want


def test_upper_medians(spark):
    rnd = random.Random(4)
    lists = {"a": [float(rnd.randrange(7)) for _ in range(501)], "b": [rnd.random() for _ in range(100)], "c": [1.0], "d": [2.0, 3.0]}
    rows = [(w, x) for w, xs in lists.items() for x in [*xs, None]] + [("none", None)]
    got = {r["what"]: r["median"] for r in trajectory.upper_medians(spark.createDataFrame(rows, "what string, x double")).collect()}
    assert got == {w: sorted(xs)[len(xs) // 2] for w, xs in lists.items()}


def test_matrix_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(energy, "REFERENCES_A_BLOCK", 3)
    refs = spark.createDataFrame([(f"o{k}", k) for k in range(10)], "origin string, node int")
    tree = spark.createDataFrame([(f"o{k}", j, float(10 * k + j)) for k in range(10) for j in range(20) if (k + j) % 3], "origin string, node int, energy double")
    got = [tuple(r) for r in energy.accessibility_matrix(tree, refs).collect()]
    assert sorted(got) == sorted((f"o{k}", f"o{j}", float(10 * k + j) if (k + j) % 3 else math.inf) for k in range(10) for j in range(10) if k != j)
    assert energy.accessibility_matrix(tree, refs.limit(0)).collect() == []


def test_nearest_node_far_away(spark):
    points = spark.createDataFrame([("near", 0.0, 0.0), ("far", 5e6, 0.0), ("none", None, 0.0)], "p string, r double, c double")
    nodes = spark.createDataFrame([("n", 0.0, 1.0, True), ("x", 5e6, 0.0, False)], "id string, r double, c double, valid boolean")
    assert {r["p"]: r["node"] for r in roads.nearest_node(points, nodes, 1.0).collect()} == {"near": "n", "far": "n"}
    assert roads.nearest_node(points, nodes.filter("not valid"), 1.0).count() == 0


def test_routes_over_dear_edges(spark, tmp_path):
    from trailmark import plans

    cost = {(1, 1): 2.0, (2, 1): 10.0, (1, 2): 5.0, (2, 2): 7.3, (1, 3): 9.0, (2, 3): 9.0}
    spark.createDataFrame([(*k, c) for k, c in cost.items()], "l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    used, want = {}, {}
    for route in range(2):
        paid = lambda s, p: cost[s, p] + (1.5 ** used.get((s, p), 0) - 1) * 0.01 * 10 * cost[s, p]  # noqa: B023, E731
        _, via = min((paid(1, p) + paid(2, p), p) for p in (1, 2, 3))  # noqa: B023
        for s in (1, 2):
            used[s, via] = used.get((s, via), 0) + 1
        want[route] = {"s1": 0.0, f"p{via}": cost[1, via], "s2": cost[2, via]}
    got = {}
    for r in plans.QUERIES["n8_top_n_routes"](spark, str(tmp_path)).collect():
        got.setdefault(r["route"], {})[r["node"]] = r["energy"]
    assert got == want and want[0] != want[1]


def test_hamming_dedup_is_exact(spark):
    import random

    dice = random.Random(3)
    base = [dice.getrandbits(64) for _ in range(12)]
    hashes = [b ^ sum(1 << k for k in dice.sample(range(64), dice.randrange(9))) for b in base for _ in range(8)]
    rows = [(n, "ab"[n % 2], f"{h:016x}") for n, h in enumerate(hashes)]
    known = [(f"k{n}", "a", f"{h ^ 1:016x}") for n, h in enumerate(base[:3])]
    got = matching.hamming_dedup(spark.createDataFrame(rows, "row long, kind string, hash string"), spark.createDataFrame(known, "id string, kind string, hash string"))
    close = lambda x, y: (int(x, 16) ^ int(y, 16)).bit_count() <= 5
    for r in got.collect():
        n, kind, h = rows[r["row"]]
        first = [i for i, k, x in known if k == kind and close(x, h)] or [str(m) for m, k, x in rows[:n] if k == kind and close(x, h)]
        assert r["dup_of"] == (first[0] if first else None)


@pytest.mark.parametrize("n_dirs", [4, 8, 16, 32, 64, 128])
def test_moves(n_dirs):
    """n_dirs moves without a common factor that go all around, and are the shorter the fewer they are."""
    moves = {(r, c) for r, c, _, _ in raster.move_list(n_dirs)}
    assert len(moves) == n_dirs == len({math.atan2(r, c) for r, c in moves}) and moves == {(c, -r) for r, c in moves}
    assert moves == {(r, c) for r, c, _, _ in raster.move_list(128)} & moves or n_dirs == 4


def test_more_than_the_old_limits(spark):
    keys = spark.createDataFrame([(f"k{n}",) for n in range(31)], "key string")
    known = spark.createDataFrame([("k0", "7")], "key string, slug string")
    got = {r["key"]: r["slug"] for r in mutate.mint_slugs(keys, known, length=1).collect()}
    assert len(got) == 31 == len(set(got.values())) and got["k0"] == "7" and all(len(s) == 1 for s in got.values())
    with pytest.raises(ValueError):
        mutate.mint_slugs(spark.range(40).selectExpr("cast(id as string) as key"), known, length=1)
    docs = spark.createDataFrame([("a", "p/" + "a" * 10_000 + "!!"), ("b", "p/" + "a" * 10_001)], "doc string, s string").select("doc", "s", F.lit("rdf:type").alias("p"), F.lit("C").alias("o"))
    assert [(r["doc"], r["error"]) for r in rules.check_single_subject(docs, "C", "p/").collect()] == [("a", "slug")]
    names = ["2025-09-10 12345678901 x", "2025-09-10 PH 1234567890123456789 x", "2025-09-10 " + "y" * 1_000_100]
    found = [one(spark, text.parse_folder_name(lit(n))) for n in names]
    assert (found[0]["number"], found[0]["title"]) == (12_345_678_901, "x")
    assert (found[1]["series"], found[1]["number"], found[1]["title"]) == ("PH", None, "1234567890123456789 x")
    assert found[2]["title"] == "y" * 1_000_100


def test_saved_twice_in_a_batch(spark):
    kind = "id string, slug string, name string, created int, updated int, distance double"
    saved = spark.createDataFrame([("a", "old", "A", 1, 1, 1.0)], kind)
    batch = spark.createDataFrame([("a", "x", "A1", None, 5, 2.0), ("a", "y", "A2", None, 6, 3.0), ("b", "z", "B", None, None, 4.0), ("b", "z", "B", None, None, 4.0)], kind)
    out, conflicts = mutate.save_route_upsert(saved, batch, F.lit(9))
    assert sorted((r["id"], r["slug"], r["name"], r["created"]) for r in out.collect()) == [("a", "y", "A2", 1), ("b", "z", "B", 9)] and conflicts.count() == 0


def test_budget_of_zero(spark):
    half = spark.createDataFrame([("a", "b", 0.0, 1.0, 1), ("b", "c", 1.0, 1.0, 2)], "src string, dst string, cost double, back double, edge int")
    src = spark.createDataFrame([("o", "a")], "origin string, node string")
    assert {r["node"] for r in energy.reach(half, src, e_max=0.0).collect()} == {"a", "b"}
    assert {r["node"] for r in energy.reach_round(half, src, e_max=0.0, per_leg=False).collect()} == {"a"}


def encoded(points):
    """Points of whole hundred-thousandths in the polyline format."""
    out, before = [], (0, 0)
    for p in points:
        for a, b in zip(p, before):
            x = (a - b) << 1 if a >= b else ~((a - b) << 1)
            while x >= 32:
                out.append(chr((x & 31 | 32) + 63))
                x >>= 5
            out.append(chr(x + 63))
        before = p
    return "".join(out)


def test_long_polylines(spark):
    rnd = random.Random(6)
    lines = {n: [(rnd.randrange(-9_000_000, 9_000_001), rnd.randrange(-18_000_000, 18_000_001)) for _ in range(n)] for n in (1, 2, 63, 64, 65, 128, 4_097, 20_000)}
    rows = [(str(n), encoded(pts)) for n, pts in lines.items()] + [("odd", encoded(lines[2])[:-1]), ("far", encoded([(0, 0), (9_000_001, 0)])), ("other", "??\n?"), ("open", "??_"), ("empty", ""), ("null", None)]
    got = {r["k"]: r["p"] for r in spark.createDataFrame(rows, "k string, t string").select("k", files.decode_polyline(F.col("t")).alias("p")).collect()}
    for n, pts in lines.items():
        assert got[str(n)] is None if n < 2 else [(p["lat"], p["lng"]) for p in got[str(n)]] == [(a / 1e5, b / 1e5) for a, b in pts]
    assert [got[k] for k in ("far", "other", "open", "empty", "null")] == [None] * 5
