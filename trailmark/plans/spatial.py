"""Queries over trajectories, rasters and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import energy as n
from ..operators import raster as r
from ..operators import roads as g
from ..operators import searches as many
from ..operators import trajectory as t
from . import views as v
from .registry import query


def routes(spark, d):
    return v.fixes(spark, d).select(F.col("trip").alias("route"), "seq", "lat", "lng", F.col("power").alias("ele"))


def _r(df, **digits):
    return df.withColumns({c: F.round(c, k) for c, k in digits.items()})


@query("f1_haversine", v.sql("SELECT trip, seq, round(coalesce(d, 0), 3) AS d FROM steps", "steps"))
def f1(spark, d):
    x = routes(spark, d).withColumn("d", F.coalesce(t._step("route", "seq"), F.lit(0.0)))
    return _r(x.select(F.col("route").alias("trip"), "seq", "d"), d=3)


@query("f2_route_stats", v.sql("SELECT trip AS route, round(sum(d) / 100) AS dist_hm, sum(CASE WHEN power > pp THEN power - pp ELSE 0 END) AS ascent_m, sum(CASE WHEN power < pp THEN pp - power ELSE 0 END) AS descent_m FROM steps GROUP BY trip", "steps"))
def f2(spark, d):
    return t.route_stats(routes(spark, d)).withColumn("dist_hm", F.round(F.col("dist_m") / 100, 0)).drop("dist_m")


@query("f3_downsample_stride", v.sql("WITH x AS (SELECT *, seq - 1 AS i, count(*) OVER (PARTITION BY trip) AS n FROM fixes) SELECT trip AS route, seq, lat, lng FROM x WHERE n <= 20 OR i % CAST(ceil(n / 20.0) AS BIGINT) = 0 OR i = n - 1", "fixes"))
def f3(spark, d):
    return t.downsample_stride(routes(spark, d), 20).select("route", "seq", "lat", "lng")


@query("f4_resample_n", v.sql("WITH m AS (SELECT trip, count(*) AS m FROM fixes GROUP BY trip), k AS (SELECT trip, k, CAST(round_even(k * (m - 1) / 9.0, 0) AS BIGINT) AS i FROM m, range(10) AS x(k)) SELECT k.trip AS route, CAST(k.k AS INT) AS k, lat, lng FROM k JOIN fixes f ON f.trip = k.trip AND f.seq = k.i + 1", "fixes"))
def f4(spark, d):
    return t.resample_n(routes(spark, d), 10)


@query("f5_route_length", v.sql("SELECT trip AS route, round(coalesce(sum(d), 0), 1) AS dist_m FROM steps GROUP BY trip", "steps"))
def f5(spark, d):
    return _r(t.route_length(routes(spark, d)), dist_m=1)


@query("f6_route_bbox", v.sql("SELECT trip AS route, min(lat) AS south, min(lng) AS west, max(lat) AS north, max(lng) AS east, round((max(lat) - min(lat)) * 111.32 * (max(lng) - min(lng)) * 111.32 * cos(radians((min(lat) + max(lat)) / 2)), 4) AS km2 FROM fixes GROUP BY trip", "fixes"))
def f6(spark, d):
    return _r(t.route_bbox(routes(spark, d)), km2=4)


@query("f7_mercator", v.sql("SELECT trip, seq, CAST(floor((lng + 180) / 360 * 4096) AS BIGINT) AS x, CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 4096) AS BIGINT) AS y, round(cos(radians(lat)) * 2 * pi() * 6371000 / (256 * 4096), 6) AS res FROM fixes", "fixes"))
def f7(spark, d):
    x, y = geo.tile_xy(F.col("lat"), F.col("lng"), 12)
    return v.fixes(spark, d).select("trip", "seq", x.alias("x"), y.alias("y"), F.round(geo.metres_per_px(F.col("lat"), 12), 6).alias("res"))


PIXEL_Y = "(0.5 - ln((1 + sin(radians({0}))) / (1 - sin(radians({0})))) / (4 * pi()))"


@query("f7b_fit_zoom", v.sql(f"""WITH b AS (SELECT trip, min(lat) AS s, min(lng) AS w, max(lat) AS n, max(lng) AS e FROM fixes GROUP BY trip)
  SELECT trip AS route, CAST(coalesce(max(z) FILTER ((e - w) / 360 * 256 * pow(2, z) <= 800 AND ({PIXEL_Y.format('s')} - {PIXEL_Y.format('n')}) * 256 * pow(2, z) <= 480), 3) AS INT) AS zoom FROM b, range(3, 20) x(z) GROUP BY trip""", "fixes"))
def f7b(spark, d):
    return t.route_bbox(routes(spark, d)).select("route", geo.fit_zoom(*map(F.col, ("south", "west", "north", "east")), 800, 480).alias("zoom"))


@query("f9_stops", v.sql("""WITH x AS (SELECT *, speed <= 0.5 AS slow, lag(speed <= 0.5) OVER w AS pslow, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, coalesce(t - pt >= 60, FALSE) AS gap FROM steps WINDOW w AS (PARTITION BY trip ORDER BY seq)),
  y AS (SELECT *, sum(CASE WHEN gap OR slow IS DISTINCT FROM pslow THEN 1 ELSE 0 END) OVER (PARTITION BY trip ORDER BY seq) AS run FROM x),
  z AS (SELECT trip, run, min(t) AS t0, max(t) AS t1, arg_min(lat, seq) AS lat, arg_min(lng, seq) AS lng, bool_and(slow) AS slow, arg_min(gap, seq) AS after_gap FROM y GROUP BY trip, run),
  q AS (SELECT *, coalesce(lead(after_gap) OVER (PARTITION BY trip ORDER BY run), FALSE) AS cut FROM z)
  SELECT trip, pt AS t0, t AS t1, plat AS lat, plng AS lng FROM x WHERE gap UNION ALL SELECT trip, t0, t1, lat, lng FROM q WHERE slow AND NOT cut AND t1 - t0 >= 90""", "steps"))
def f9(spark, d):
    return t.stops(v.fixes(spark, d))


@query("f10_visits", v.sql(f"""WITH p AS (SELECT trip, lat AS plat, lng AS plng FROM fixes WHERE seq = 1), x AS (SELECT f.*, {v.metres_sql('lat', 'lng', 'plat', 'plng')} <= 5000 AS inside FROM fixes f JOIN p USING (trip)),
  s AS (SELECT *, max(CASE WHEN inside THEN t END) OVER (PARTITION BY trip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM x), b AS (SELECT *, sum(CASE WHEN NOT inside AND coalesce(t - seen > 60, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY trip ORDER BY seq) AS run FROM s)
  SELECT trip, min(seq) AS i0, max(seq) AS i1 FROM b WHERE inside GROUP BY trip, run""", "fixes"))
def f10(spark, d):
    x = v.fixes(spark, d)
    return t.visits(x, x.filter("seq = 1").select("trip", F.col("lat").alias("plat"), F.col("lng").alias("plng")), 5000).select("trip", "i0", "i1")


@query("f11_remaining_distance", v.sql("SELECT trip, seq, round(coalesce(sum(d) OVER (PARTITION BY trip ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 1) AS rem_m FROM steps", "steps"))
def f11(spark, d):
    return _r(t.remaining_distance(v.fixes(spark, d)).select("trip", "seq", "rem_m"), rem_m=1)


@query("f12_after_distance", v.sql("WITH x AS (SELECT *, sum(coalesce(d, 0)) OVER (PARTITION BY trip ORDER BY seq) AS m FROM steps) SELECT trip, seq FROM x WHERE m >= 100000", "steps"))
def f12(spark, d):
    x = v.fixes(spark, d)
    starts = x.groupBy("trip").agg(F.min("t").alias("t0")).withColumn("metres", F.lit(100_000.0))
    return t.after_distance(x, starts).select("trip", "seq")


@query("f15_integrate_power", v.sql("SELECT trip, round(sum(CASE WHEN t - pt > 0 AND t - pt <= 30 THEN power * (t - pt) ELSE 0 END) / 1000, 3) AS kj, sum(CASE WHEN t - pt > 0 AND t - pt <= 30 AND speed > 0.5 THEN t - pt ELSE 0 END) AS moving_s FROM steps GROUP BY trip", "steps"))
def f15(spark, d):
    x = v.fixes(spark, d)
    w = x.groupBy("trip").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return _r(t.integrate_power(x, w).select("trip", "kj", "moving_s"), kj=3)


def ride_routes(spark, d):
    x = v.fixes(spark, d)
    ends = x.groupBy("trip").agg(F.min_by(F.struct("lat", "lng"), "seq").alias("a"), F.max_by(F.struct("lat", "lng"), "seq").alias("b"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    return ends.select("trip", F.col("a.lat").alias("s_lat"), F.col("a.lng").alias("s_lng"), F.col("b.lat").alias("e_lat"), F.col("b.lng").alias("e_lng"), F.lit(20_000.0).alias("dist_m"), F.when(F.col("trip") % 3 == 0, F.col("t0") + 60).alias("human_dep"), F.when(F.col("trip") % 2 == 0, F.col("t1") - 60).alias("human_arr"))


@query("f16_ride_window")
def f16(spark, d):
    return t.ride_window(v.fixes(spark, d), ride_routes(spark, d))


@query("f17_window_accuracy")
def f17(spark, d):
    x = v.fixes(spark, d)
    x = n.settled(x)
    true = t.ride_window(x, ride_routes(spark, d))
    blind = t.ride_window(x, ride_routes(spark, d).withColumns({"human_dep": F.lit(None).cast("long"), "human_arr": F.lit(None).cast("long")}))
    return t.window_accuracy(blind, true)


@query("f18_densify", v.sql("SELECT count(*) AS parts, CAST(count(DISTINCT trip || '/' || seq) AS BIGINT) AS segs, round(sum(part) / 1000, 0) AS km FROM (SELECT trip, seq, d / greatest(ceil(d / 600), 1) AS part, unnest(range(CAST(greatest(ceil(d / 600), 1) AS BIGINT))) AS k FROM steps WHERE d IS NOT NULL)", "steps"))
def f18(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("trip").orderBy("seq")
    x = v.fixes(spark, d).select(F.concat_ws("/", "trip", "seq").alias("seg"), F.lag("lat").over(w).alias("lat1"), F.lag("lng").over(w).alias("lng1"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), F.lit(0.0).alias("z1"), F.lit(1.0).alias("z2"), F.lit(True).alias("deck"))
    x = x.filter("lat1 is not null").withColumn("len_m", geo.haversine_m(*map(F.col, ("lat1", "lng1", "lat2", "lng2"))))
    return t.densify(x).agg(F.count("*").alias("parts"), F.countDistinct("seg").alias("segs"), F.round(F.sum("len_m") / 1000, 0).alias("km"))


@query("f19_route_energy_car", v.sql("SELECT trip AS route, round(sum(0.3 * d + 2 * greatest(coalesce(power - pp, 0), 0) - greatest(coalesce(pp - power, 0), 0)), 0) AS kj FROM steps WHERE d IS NOT NULL GROUP BY trip", "steps"))
def f19(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("route").orderBy("seq")
    x = routes(spark, d).withColumn("d", t._step("route", "seq")).withColumn("dh", F.col("ele") - F.lag("ele").over(w)).withColumn("bike_kj", F.lit(1.0)).filter("d is not null")
    return _r(t.route_energy_car(x, 0.1, 0.2, 2.0, 0.5).select("route", "kj"), kj=0)


@query("f20_fov", "SELECT p_partkey, round_even(degrees(2 * atan((CASE WHEN p_size % 2 = 0 THEN 24.0 ELSE 36.0 END) / (2 * p_size))), 1) AS fov, (p_partkey * 37.0) % 360 AS bearing FROM part")
def f20(spark, d):
    return v.table(spark, d, "part").select("p_partkey", geo.fov_from_focal(F.col("p_size"), F.col("p_size") % 2 == 0).alias("fov"), geo.bearing(F.col("p_partkey") * F.lit(37.0)).alias("bearing"))


@query("r1_fuse_dem", v.sql("WITH a AS (SELECT r, c, h * 10 AS h FROM cells WHERE h > 10) SELECT c.r, c.c, CASE WHEN a.h IS NULL OR abs(a.h - c.h) > 100 THEN c.h ELSE a.h END AS h, CASE WHEN abs(a.h - c.h) > 100 THEN 'discarded' WHEN a.h IS NOT NULL THEN 'local' ELSE 'world' END AS how FROM cells c LEFT JOIN a USING (r, c)", "cells"))
def r1(spark, d):
    c = v.cells(spark, d)
    return r.fuse_dem(c.filter("h > 10").withColumn("h", F.col("h") * 10), c).select("r", "c", "h", "how")


@query("r2_smooth_gaussian", v.sql("""WITH k AS (SELECT k, exp(-pow(k / 1.0, 2) / 2) AS w FROM range(-3, 4) AS x(k)), a AS (SELECT c.r, c.c, sum(w * o.h) / sum(w) AS h FROM cells c CROSS JOIN k JOIN cells o ON o.r = c.r AND o.c = c.c + k.k GROUP BY 1, 2)
  SELECT c.r, c.c, round(sum(w * o.h) / sum(w), 4) AS h FROM a c CROSS JOIN k JOIN a o ON o.c = c.c AND o.r = c.r + k.k GROUP BY 1, 2""", "cells"))
def r2(spark, d):
    return _r(r.smooth_gaussian(v.cells(spark, d), 30.0, 30.0, 30.0).select("r", "c", "h"), h=4)


@query("r3_sample_bilinear", v.sql("SELECT r || '/' || c AS id, h FROM cells", "cells"))
def r3(spark, d):
    c = v.cells(spark, d)
    pts = c.select(F.concat_ws("/", "r", "c").alias("id"), (F.col("r") + 0.5).alias("r"), (F.col("c") + 0.5).alias("c"))
    return r.sample_bilinear(pts, c, 1 << 30, 1 << 30)


@query("r4_sample_nearest", v.sql("SELECT c.r || '/' || c.c AS id, coalesce(o.h, 0) AS h FROM cells c LEFT JOIN cells o ON o.r = c.r AND o.c = c.c + 1", "cells"))
def r4(spark, d):
    c = v.cells(spark, d)
    return r.sample_nearest(c.select(F.concat_ws("/", "r", "c").alias("id"), (F.col("r") + 0.2).alias("r"), (F.col("c") + 0.7).alias("c")), c)


@query("r5_idw_fill", v.sql("""WITH hit AS (SELECT r - i * k AS r, c - j * k AS c, i, j, k, h FROM cells CROSS JOIN (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) x(i, j) CROSS JOIN range(1, 9) y(k) WHERE h >= 25),
  ray AS (SELECT r, c, i, j, min(k) AS k, arg_min(h, k) AS v FROM hit GROUP BY ALL),
  f AS (SELECT r, c, sum(v / (k * k * (i * i + j * j))) / sum(1.0::DOUBLE / (k * k * (i * i + j * j))) AS v FROM ray GROUP BY r, c)
  SELECT c.r, c.c, round(CASE WHEN c.h >= 25 THEN c.h ELSE f.v END, 6) AS v, c.h >= 25 AS network FROM cells c LEFT JOIN f ON f.r = c.r AND f.c = c.c""", "cells"))
def r5(spark, d):
    c = v.cells(spark, d)
    return _r(r.idw_fill(c, c.filter("h >= 25").select("r", "c", F.col("h").alias("v")), 8), v=6)


@query("r6_box_smooth", v.sql("SELECT c.r, c.c, round(CASE WHEN c.h > 40 THEN c.h ELSE avg(o.h) END, 4) AS v FROM cells c JOIN cells o ON o.r BETWEEN c.r - 1 AND c.r + 1 AND o.c BETWEEN c.c - 1 AND c.c + 1 GROUP BY c.r, c.c, c.h", "cells"))
def r6(spark, d):
    c = v.cells(spark, d).select("r", "c", F.col("h").alias("v"), (F.col("h") > 40).alias("network"))
    return _r(r.box_smooth(c).select("r", "c", "v"), v=4)


def best_sql(name: str, sources: str, half: str = "half") -> str:
    """A keyed recursion: the cheapest way of each origin to each node."""
    return f"""{name}(origin, node, energy) USING KEY (origin, node) AS ({sources} UNION SELECT f.origin, h.dst, min(f.energy + h.cost) FROM {name} f JOIN {half} h ON h.src = f.node
  LEFT JOIN recurring.{name} r ON r.origin = f.origin AND r.node = h.dst WHERE r.energy IS NULL OR f.energy + h.cost < r.energy GROUP BY f.origin, h.dst)"""


STEPS8 = "steps8 AS (SELECT a.r * 1000000 + a.c AS src, b.r * 1000000 + b.c AS dst, CASE WHEN a.r <> b.r AND a.c <> b.c THEN 4.0::DOUBLE ELSE 3.0::DOUBLE END AS cost FROM cells a CROSS JOIN (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(i, j) JOIN cells b ON b.r = a.r + o.i AND b.c = a.c + o.j)"


@query("r7_distance_to_used", f"WITH RECURSIVE {v.CELLS}, {STEPS8}, {best_sql('best', 'SELECT 0, r * 1000000 + c, 0.0::DOUBLE FROM cells WHERE h = 0', 'steps8')} SELECT CAST(node // 1000000 AS INT) AS r, CAST(node % 1000000 AS INT) AS c, energy / 3 AS d FROM best")
def r7(spark, d):
    c = v.cells(spark, d)
    return r.distance_to_used(c, c.filter("h = 0").select("r", "c"))


C = geo.Cost()
UP = f"{C.a_roll} * d + CASE WHEN dh < {C.climb_thr} * d THEN {C.a_aero} * d ELSE 0 END + {C.beta} * dh"
DOWN = f"greatest({C.a_roll + C.a_aero} * d - greatest(least({C.ab_ratio} * d / -dh, 1.0) - {C.eps_offset}, 0.0) * {C.beta} * -dh, 0.0)"
LEG = f"CASE WHEN dh >= 0 THEN {UP} ELSE {DOWN} END"


@query("n1_leg_energy", v.sql(f"SELECT trip, seq, round({LEG}, 4) AS kj FROM (SELECT trip, seq, d, power - pp AS dh FROM steps WHERE d IS NOT NULL)", "steps"))
def n1(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("route").orderBy("seq")
    x = routes(spark, d).withColumn("d", t._step("route", "seq")).withColumn("dh", F.col("ele") - F.lag("ele").over(w)).filter("d is not null")
    return x.select(F.col("route").alias("trip"), "seq", F.round(geo.leg_energy(F.col("d"), F.col("dh")), 4).alias("kj"))


@query("r9_grid_edges", v.sql(f"SELECT src_r, src_c, dst_r, dst_c, round({LEG}, 4) AS energy FROM (SELECT a.r AS src_r, a.c AS src_c, b.r AS dst_r, b.c AS dst_c, sqrt(pow((b.r - a.r) * 30.0, 2) + pow((b.c - a.c) * 30.0, 2)) AS d, b.h - a.h AS dh FROM cells a JOIN cells b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 WHERE a.r <> b.r OR a.c <> b.c)", "cells"))
def r9(spark, d):
    return _r(r.grid_edges(v.cells(spark, d), r.move_list(8, 30.0, 30.0)).select("src_r", "src_c", "dst_r", "dst_c", "energy"), energy=4)


@query("r10_portal_edges", v.sql("SELECT count(*) AS n, sum(dh) AS dh FROM (SELECT b.h - a.h AS dh FROM cells a JOIN cells b ON b.r = a.r AND b.c = a.c + 5 UNION ALL SELECT a.h - b.h FROM cells a JOIN cells b ON b.r = a.r AND b.c = a.c + 5)", "cells"))
def r10(spark, d):
    c = v.cells(spark, d)
    p = c.select(F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("r").alias("r2"), (F.col("c") + 5).alias("c2"), F.lit(150.0).alias("len_m"), F.lit(None).cast("double").alias("z1"), F.lit(None).cast("double").alias("z2"))
    return r.portal_edges(p, c).agg(F.count("*").alias("n"), F.sum("dh").alias("dh"))


@query("r11_effective_mask", v.sql("SELECT r, c, h > 25 AS mask FROM cells", "cells"))
def r11(spark, d):
    c = v.cells(spark, d)
    return r.effective_mask(c, c.filter("h > 25")).select("r", "c", "mask")


@query("r12_max_edge_cost", v.sql(f"SELECT round(({C.a_roll + C.a_aero} * sqrt(1800.0) + {C.beta} * (max(h) - min(h))) * 1.001, 6) AS most FROM cells", "cells"))
def r12(spark, d):
    return _r(r.max_edge_cost(v.cells(spark, d), 30.0, 30.0), most=6)


def half(spark, d):
    return g.half_edges(v.roads(spark, d))


def origin(spark, d):
    """The first supplier by name, from line items as they are: roads needn't be made for it."""
    e = v.table(spark, d, "lineitem").select(v._iri("s", "l_suppkey").alias("node"))
    return e.agg(F.min("node").alias("node")).select(F.lit("o").alias("origin"), "node")


@query("g6_segments", v.sql("SELECT trip AS line, seq, round(off, 6) AS off FROM (SELECT trip, seq, coalesce(sum(l) OVER (PARTITION BY trip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (SELECT trip, seq, sqrt(pow(lead(lat) OVER w - lat, 2) + pow(lead(lng) OVER w - lng, 2)) AS l FROM fixes WINDOW w AS (PARTITION BY trip ORDER BY seq)) WHERE l > 0)", "fixes"))
def g6(spark, d):
    x = v.fixes(spark, d).select(F.col("trip").alias("line"), "seq", F.col("lat").alias("r"), F.col("lng").alias("c"))
    return _r(g.segments(x).select("line", "seq", "off"), off=6)


def net(spark, d):
    """Two successive fixes of a trip as a line on a grid of cells; each fix is an end of one line."""
    x = v.fixes(spark, d)
    return x.select((F.col("trip") * 100_000 + F.floor((F.col("seq") - 1) / 2)).alias("line"), ((F.col("seq") - 1) % 2).alias("seq"), ((F.col("lat") + 24) * 100).alias("r"), ((F.col("lng") + 47) * 100).alias("c"))


@query("g8_t_junctions", v.sql("""WITH v AS (SELECT trip * 100000 + (seq - 1) // 2 AS line, (seq - 1) % 2 AS seq, (lat + 24) * 100 AS r, (lng + 47) * 100 AS c FROM fixes),
  s AS (SELECT a.line, a.seq, a.r, a.c, b.r - a.r AS dr, b.c - a.c AS dc FROM v a JOIN v b ON b.line = a.line AND a.seq = 0 AND b.seq = 1 WHERE a.r <> b.r OR a.c <> b.c),
  x AS (SELECT s.*, v.r AS vr, v.c AS vc, ((v.r - s.r) * dr + (v.c - s.c) * dc) / (dr * dr + dc * dc) AS t FROM s JOIN v ON v.line <> s.line AND v.r BETWEEN least(s.r, s.r + dr) - 0.03 AND greatest(s.r, s.r + dr) + 0.03 AND v.c BETWEEN least(s.c, s.c + dc) - 0.03 AND greatest(s.c, s.c + dc) + 0.03)
  SELECT DISTINCT line, seq, round(t, 6) AS t, vr AS r, vc AS c FROM x WHERE t > 1e-9 AND t < 1 - 1e-9 AND sqrt(pow(vr - (r + t * dr), 2) + pow(vc - (c + t * dc), 2)) <= 0.02""", "fixes"))
def g8(spark, d):
    x = net(spark, d)
    return _r(g.t_junctions(x, g.segments(x), 0.02), t=6)


@query("g9_snap_nodes", v.sql("SELECT CAST(floor(lat / 0.01 + 0.5) AS BIGINT) AS i, CAST(floor(lng / 0.01 + 0.5) AS BIGINT) AS j, arg_min(lat, trip * 1000000 + seq) AS r FROM fixes GROUP BY 1, 2", "fixes"))
def g9(spark, d):
    x = v.fixes(spark, d).select(F.col("trip").alias("line"), "seq", F.col("lat").alias("r"), F.col("lng").alias("c"))
    return g.snap_nodes(x, 0.01).select("key.i", "key.j", "r")


@query("g13_node_elevation", v.sql("""WITH p AS (SELECT r, c, greatest(c - 1, 0) AS c0, CASE WHEN c = 0 THEN 0::DOUBLE ELSE 0.75::DOUBLE END AS fc FROM cells),
  t AS (SELECT p.r, p.c, o.h, (CASE WHEN o.r = p.r THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END) * (CASE WHEN o.c = c0 THEN 1 - fc ELSE fc END) AS w FROM p JOIN cells o ON o.r BETWEEN p.r AND p.r + 1 AND o.c BETWEEN c0 AND c0 + 1)
  SELECT r || '/' || c AS id, r + 0.75::DOUBLE AS r, c + 0.25::DOUBLE AS c, sum(h * w) / sum(w) AS h, TRUE AS valid FROM t GROUP BY t.r, t.c""", "cells"))
def g13(spark, d):
    c = v.cells(spark, d)
    nodes = c.select(F.concat_ws("/", "r", "c").alias("id"), (F.col("r") + 0.75).alias("r"), (F.col("c") + 0.25).alias("c"))
    return g.node_elevation(nodes, c, 1 << 30, 1 << 30)


def leg_sql(dist: str, rise: str) -> str:
    """LEG of a distance and a rise."""
    return f"(SELECT {LEG} FROM (SELECT {dist} AS d, {rise} AS dh))"


@query("g14_edge_profiles", v.sql(f"""WITH x AS (SELECT a.r, a.c, (b.h - a.h) / 2 AS up1, (e.h - b.h) / 2 AS up2, a.h AS h1, b.h AS h2, e.h AS h3 FROM cells a JOIN cells b ON b.r = a.r AND b.c = a.c + 1 JOIN cells e ON e.r = a.r AND e.c = a.c + 2)
  SELECT r || '/' || c AS edge, 60.0::DOUBLE AS len_m, 15.0::DOUBLE AS step_m, round((h1 + h3) * 1.5 + 2 * h2, 3) AS heights, round(2 * {leg_sql('15.0', 'up1')} + 2 * {leg_sql('15.0', 'up2')}, 6) AS cost_ab, round(2 * {leg_sql('15.0', '-up1')} + 2 * {leg_sql('15.0', '-up2')}, 6) AS cost_ba FROM x""", "cells"))
def g14(spark, d):
    c = v.cells(spark, d)
    e = c.select(F.concat_ws("/", "r", "c").alias("edge"), (F.col("r") + 0.5).alias("r1"), (F.col("c") + 0.5).alias("c1"), (F.col("r") + 0.5).alias("r2"), (F.col("c") + 2.5).alias("c2"))
    x = n.directed_costs(g.edge_profiles(e, c, 1 << 30, 1 << 30, 30.0, 30.0, 15.0).filter(~F.exists("profile", lambda x: x.isNull())))
    x = x.withColumn("heights", F.aggregate("profile", F.lit(0.0), lambda a, h: a + h)).drop("profile")
    return _r(x.select("edge", "len_m", "step_m", "heights", "cost_ab", "cost_ba"), heights=3, cost_ab=6, cost_ba=6)


@query("g15_half_edges", v.sql("SELECT a AS src, b AS dst, edge, TRUE AS a_to_b, cost FROM roads UNION ALL SELECT b, a, edge, FALSE, cost FROM roads", "roads"))
def g15(spark, d):
    return half(spark, d).select("src", "dst", "edge", "a_to_b", "cost")


@query("g16_bake_graph", v.sql("SELECT CAST(floor(lat / 1e-6 + 0.5) AS BIGINT) AS i, CAST(floor(lng / 1e-6 + 0.5) AS BIGINT) AS j, CAST(arg_min(greatest(-32767, least(32767, power * 10)), trip * 1000000 + seq) AS INT) AS dm FROM fixes GROUP BY 1, 2", "fixes"))
def g16(spark, d):
    x = v.fixes(spark, d)
    lines = x.select(F.col("trip").alias("line"), "seq", "lat", "lng", F.lit(False).alias("deck"))
    return g.bake_graph(lines, x.select(F.col("trip").alias("line"), "seq", F.col("power").alias("h")))[0].select("key.i", "key.j", "dm")


@query("g17_nearest_node", v.sql("""WITH x AS (SELECT trip || '/' || seq AS id, lat, lng, kind FROM fixes), m AS (SELECT p.id AS p, sqrt(pow(p.lat - n.lat, 2) + pow(p.lng - n.lng, 2)) AS d, n.id AS node FROM x p, x n WHERE p.kind = 'view' AND n.kind = 'purchase')
  SELECT p, min((d, node))[2] AS node, round(min(d), 9) AS d FROM m GROUP BY p""", "fixes"))
def g17(spark, d):
    x = v.fixes(spark, d)
    nodes = x.filter("kind = 'purchase'").select(F.concat_ws("/", "trip", "seq").alias("id"), F.col("lat").alias("r"), F.col("lng").alias("c"), F.lit(True).alias("valid"))
    return g.nearest_node(x.filter("kind = 'view'").select(F.concat_ws("/", "trip", "seq").alias("p"), F.col("lat").alias("r"), F.col("lng").alias("c")), nodes, 0.002).withColumn("d", F.round("d", 9))


@query("g18_layer_counts", "SELECT o_orderpriority AS layer, count(*) AS n FROM orders GROUP BY 1")
def g18(spark, d):
    return g.layer_counts(v.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "layer"))


@query("g1_osm_filters", "SELECT 'roads' AS what, count(*) AS n FROM part WHERE p_size > 10 UNION ALL SELECT 'water', count(*) FROM part WHERE p_size = 3 UNION ALL SELECT 'hydro', count(*) FROM part WHERE p_size IN (3, 4, 5) UNION ALL SELECT 'cycling', count(*) FROM part WHERE p_size IN (12, 13, 14)")
def g1(spark, d):
    s = F.col("p_size")
    osm = v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(s == 12, "cycleway").when(s == 13, "path").when(s > 10, "primary").alias("highway"), F.lit("no").alias("bridge"), F.lit("no").alias("tunnel"), F.lit(0).alias("layer"), F.when(s == 3, "water").when(s == 5, "ridge").alias("natural"), F.lit(None).cast("string").alias("landuse"), F.when(s.isin(3, 4), "river").alias("waterway"), F.when(s == 13, "designated").alias("bicycle"), F.when(s == 14, "lane").alias("cycleway"), *[F.lit(None).cast("string").alias(c) for c in g.CYCLE_TAGS[1:]])
    k = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return k(g.filter_roads(osm), "roads").union(k(g.filter_water(osm)[0], "water")).union(k(g.filter_hydro(osm), "hydro")).union(k(g.filter_cycling(osm), "cycling"))


def tree_sql(name: str, best: str, half: str = "half") -> str:
    """Of equally cheap last steps that from the smallest parent."""
    return f"""{name} AS (SELECT b.*, x.parent, x.edge FROM {best} b LEFT JOIN (SELECT p.origin, h.dst AS node, min(h.src) AS parent, arg_min(h.edge, h.src) AS edge FROM {best} p JOIN {half} h ON h.src = p.node
  JOIN {best} c ON c.origin = p.origin AND c.node = h.dst AND c.energy = p.energy + h.cost GROUP BY p.origin, h.dst) x ON x.origin = b.origin AND x.node = b.node)"""


def path_sql(name: str, tree: str, targets: str = "TRUE") -> str:
    return f"""{name} AS (SELECT origin, node AS target, node, edge, parent, 0::INT AS back FROM {tree} WHERE {targets} UNION ALL SELECT p.origin, p.target, t.node, t.edge, t.parent, p.back + 1 FROM {name} p JOIN {tree} t ON t.origin = p.origin AND t.node = p.parent)"""


HALF = "half AS (SELECT a AS src, b AS dst, edge, cost FROM roads UNION ALL SELECT b, a, edge, cost FROM roads)"
ONE, EVERY = "SELECT 'o', min(a), 0.0::DOUBLE FROM roads", "SELECT DISTINCT a, a, 0.0::DOUBLE FROM roads"
FROM_ONE = f"WITH RECURSIVE {v.ROADS}, {HALF}, {best_sql('best', ONE)}, {tree_sql('tree', 'best')}, {path_sql('path', 'tree')}"
FROM_EVERY = f"WITH RECURSIVE {v.ROADS}, {HALF}, {best_sql('best', EVERY)}"


@query("n3_reach", f"{FROM_ONE} SELECT origin, node, energy, parent FROM tree")
def n3(spark, d):
    return n.reach(half(spark, d), origin(spark, d)).select("origin", "node", "energy", "parent")


@query("n3b_reach_within", f"{FROM_ONE} SELECT origin, node, energy, parent FROM tree WHERE energy <= 12")
def n3b(spark, d):
    return n.reach(half(spark, d), origin(spark, d), e_max=12.0).select("origin", "node", "energy", "parent")


@query("n4_reach_round", f"{FROM_ONE} SELECT origin, node, 2 * energy AS energy FROM tree")
def n4(spark, d):
    return n.reach_round(half(spark, d), origin(spark, d))


@query("n5_passes", f"{FROM_ONE} SELECT origin, node, parent, edge, passes FROM tree JOIN (SELECT node, count(*) AS passes FROM path GROUP BY node) USING (node)")
def n5(spark, d):
    return n.passes(n.reach(half(spark, d), origin(spark, d)))


@query("n7_extract_path", f"{FROM_ONE} SELECT origin, target, node, edge, back FROM path")
def n7(spark, d):
    tree = n.reach(half(spark, d), origin(spark, d))
    return n.extract_path(tree, tree.select("origin", F.col("node").alias("target")))


def references(spark, d):
    """Every supplier, from line items as they are."""
    e = v.table(spark, d, "lineitem").select(v._iri("s", "l_suppkey").alias("node")).distinct()
    return e.select(F.col("node").alias("origin"), "node")


@query("n12_density", f"{FROM_EVERY}, {tree_sql('tree', 'best')}, {path_sql('path', 'tree')} SELECT edge, CAST(count(*) AS DOUBLE) AS passes FROM path WHERE edge IS NOT NULL GROUP BY edge")
def n12(spark, d):
    return n.density(half(spark, d), references(spark, d))[0]


@query("n12b_mean_energy", f"{FROM_EVERY} SELECT node, sum(energy) / count(*) AS energy, count(*) AS reached FROM best GROUP BY node")
def n12b(spark, d):
    return n.reached_energy(half(spark, d), references(spark, d))


@query("n13_accessibility_matrix", f"{FROM_EVERY} SELECT x.origin, y.origin AS target, coalesce(energy, 'infinity'::DOUBLE) AS energy FROM (SELECT DISTINCT a AS origin FROM roads) x JOIN (SELECT DISTINCT a AS origin FROM roads) y ON x.origin <> y.origin LEFT JOIN best ON best.origin = x.origin AND node = y.origin")
def n13(spark, d):
    refs = references(spark, d)
    return n.accessibility_matrix(many.energies(half(spark, d), refs, nodes=refs), refs)


@query("n11_inverted_reach", f"WITH RECURSIVE {v.ROADS}, most AS (SELECT max(cost) + 1 AS m FROM roads), inverted AS (SELECT a AS src, b AS dst, edge, m - cost AS cost FROM roads, most UNION ALL SELECT b, a, edge, m - cost FROM roads, most), {best_sql('best', ONE, 'inverted')} SELECT origin, node, energy FROM best")
def n11(spark, d):
    e = half(spark, d)
    most = e.agg(F.max("cost")).first()[0] + 1
    return n.inverted_reach(e, origin(spark, d), most).select("origin", "node", "energy")


@query("n14_partial_energy", v.sql("SELECT a AS node, sum(cost) AS energy_sum, count(*) AS reached FROM (SELECT a, cost FROM roads UNION ALL SELECT b, cost FROM roads) GROUP BY 1", "roads"))
def n14(spark, d):
    e = v.roads(spark, d)
    part = lambda c: n.partial_energy(e.select(F.col(c).alias("node"), F.col("cost_ab").alias("energy")))
    return n.merge_partials([part("a"), part("b")])


@query("n15_edge_energy", v.sql("WITH m AS (SELECT a, avg(cost) AS e FROM roads GROUP BY a) SELECT edge, round(m.e, 6) AS energy FROM roads JOIN m USING (a)", "roads"))
def n15(spark, d):
    e = v.roads(spark, d)
    node = e.groupBy(F.col("a").alias("node")).agg(F.avg("cost_ab").alias("energy"))
    return _r(n.edge_energy(e.select("edge", "a", "b"), node).select("edge", "energy"), energy=6)


LAYERS = ", ".join(
    ["l0 AS (SELECT min(a) AS node, 0.0::DOUBLE AS energy, NULL::VARCHAR AS parent FROM roads)"]
    + [f"l{k} AS (SELECT dst AS node, max((e, p))[1] AS energy, max((e, p))[2] AS parent FROM (SELECT h.dst, l.energy + h.cost AS e, h.src AS p FROM l{k - 1} l JOIN half h ON h.src = l.node) GROUP BY dst)" for k in range(1, 5)]
    + ["w4 AS (SELECT * FROM l4 ORDER BY energy DESC, node LIMIT 1)"]
    + [f"w{k} AS (SELECT l{k}.* FROM l{k} JOIN w{k + 1} w ON w.parent = l{k}.node)" for k in range(3, -1, -1)]
)


@query("n10_max_energy_walk", f"WITH {v.ROADS}, {HALF}, {LAYERS} " + " UNION ALL ".join(f"SELECT {k}::INT AS layer, node, energy FROM w{k}" for k in range(5)))
def n10(spark, d):
    start = origin(spark, d).first()["node"]
    return n.max_energy_walk(half(spark, d), start, 4)[0]


ROUTE = "SELECT {0}::INT AS route, p.node, p.edge, p.back, coalesce(h.cost, 0) AS energy, {1} AS shared FROM {2} p LEFT JOIN half h ON h.edge = p.edge AND h.dst = p.node"
SECOND = "dear AS (SELECT h.src, h.dst, h.edge, CASE WHEN u.edge IS NULL THEN cost ELSE cost + 0.5::DOUBLE * 0.01::DOUBLE * (cost * 10) END AS cost FROM half h LEFT JOIN (SELECT DISTINCT edge FROM path1 WHERE edge IS NOT NULL) u ON u.edge = h.edge)"
LAST = "node = (SELECT max(a) FROM roads)"


@query("n8_top_n_routes", f"WITH RECURSIVE {v.ROADS}, {HALF}, {best_sql('best1', ONE)}, {tree_sql('tree1', 'best1')}, {path_sql('path1', 'tree1', LAST)}, {SECOND}, {best_sql('best2', ONE, 'dear')}, {tree_sql('tree2', 'best2', 'dear')}, {path_sql('path2', 'tree2', LAST)} {ROUTE.format(0, 'FALSE', 'path1')} UNION ALL {ROUTE.format(1, 'coalesce(p.edge IN (SELECT edge FROM path1 WHERE edge IS NOT NULL), FALSE)', 'path2')}")
def n8(spark, d):
    e = v.table(spark, d, "lineitem").select(v._iri("s", "l_suppkey").alias("a"))
    a, b = e.agg(F.min("a"), F.max("a")).first()
    return n.top_n_routes(half(spark, d).withColumn("len_m", F.col("cost") * 10), a, b, 2)
