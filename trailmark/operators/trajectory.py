"""Trajectories: stops, visits, windows of rides, energy. All windows are partitioned by trip or route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bbox_area_km2, haversine_m
from ..scratch import settled

STILL, STOP_S, GAP_S, RADIUS_M, SHARE = 0.5, 90, 60, 250, 0.7
SHORTEST_S, FAR_ARRIVAL_M, GOOD_ARRIVAL_M, LONGEST_DT = 900, 500, 200, 30


def _step(by: str, order: str) -> Column:
    w = Window.partitionBy(by).orderBy(order)
    return haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))


def route_stats(points: DataFrame, climb: bool = True) -> DataFrame:
    """points (route, seq, lat, lng, ele) to (route, dist_m, ascent_m, descent_m). A missing elevation skips
    that step's climb only."""
    w = Window.partitionBy("route").orderBy("seq")
    x = points.withColumn("d", _step("route", "seq"))
    sums = [F.bround(F.coalesce(F.sum("d"), F.lit(0.0)), 1).alias("dist_m")]
    if climb:
        x = x.withColumn("dz", F.col("ele") - F.lag("ele").over(w))
        sums += [F.bround(F.coalesce(F.sum(F.when(F.col("dz") > 0, F.col("dz"))), F.lit(0.0)), 1).alias("ascent_m"), F.bround(F.coalesce(F.sum(F.when(F.col("dz") < 0, -F.col("dz"))), F.lit(0.0)), 1).alias("descent_m")]
    return x.groupBy("route").agg(*sums)


def route_length(points: DataFrame) -> DataFrame:
    return points.withColumn("d", _step("route", "seq")).groupBy("route").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("dist_m"))


def downsample_stride(points: DataFrame, most: int = 400) -> DataFrame:
    """Every ceil(n / most)-th point and the last; 5 decimals."""
    w = Window.partitionBy("route")
    i = F.row_number().over(w.orderBy("seq")) - 1
    x = points.withColumn("__i", i).withColumn("__n", F.count("*").over(w))
    stride = F.ceil(F.col("__n") / most)
    kept = x.filter((F.col("__n") <= most) | (F.col("__i") % stride == 0) | (F.col("__i") == F.col("__n") - 1))
    return kept.withColumn("lat", F.bround("lat", 5)).withColumn("lng", F.bround("lng", 5)).drop("__i", "__n")


def resample_n(points: DataFrame, n: int = 80) -> DataFrame:
    """(route, k, lat, lng): exactly n points, those at round(k (m - 1) / (n - 1)); 4 decimals."""
    w = Window.partitionBy("route")
    x = points.withColumn("__i", (F.row_number().over(w.orderBy("seq")) - 1).cast("long"))
    m = x.groupBy("route").agg(F.count("*").alias("m"))
    want = m.select("route", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * (F.col("m") - 1) / (n - 1), 0).cast("long"))).alias("k", "__i"))
    return want.join(x, ["route", "__i"]).select("route", "k", F.bround("lat", 4).alias("lat"), F.bround("lng", 4).alias("lng"))


def route_bbox(points: DataFrame) -> DataFrame:
    box = points.groupBy("route").agg(F.min("lat").alias("south"), F.min("lng").alias("west"), F.max("lat").alias("north"), F.max("lng").alias("east"))
    return box.withColumn("km2", bbox_area_km2(*map(F.col, ("south", "west", "north", "east"))))


def bbox_overlap(boxes: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return boxes.filter((F.col("south") <= north) & (F.col("north") >= south) & (F.col("west") <= east) & (F.col("east") >= west))


def stops(points: DataFrame) -> DataFrame:
    """points (trip, seq, t, lat, lng, speed) to (trip, t0, t1, lat, lng): gaps of GAP_S and more, and slow
    stretches of STOP_S and more; a gap ends a slow stretch without making it a stop."""
    w = Window.partitionBy("trip").orderBy("seq")
    x = points.select("trip", "seq", "t", "lat", "lng", (F.col("speed") <= STILL).alias("slow"))
    x = x.withColumns({"pt": F.lag("t").over(w), "plat": F.lag("lat").over(w), "plng": F.lag("lng").over(w), "pslow": F.lag("slow").over(w)})
    gap = F.coalesce(F.col("t") - F.col("pt") >= GAP_S, F.lit(False))
    by_gap = x.filter(gap).select("trip", F.col("pt").alias("t0"), F.col("t").alias("t1"), F.col("plat").alias("lat"), F.col("plng").alias("lng"))
    x = x.withColumn("gap", gap).withColumn("run", F.sum((F.col("gap") | ~F.col("slow").eqNullSafe(F.col("pslow"))).cast("int")).over(w))
    runs = x.groupBy("trip", "run").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("lat", "seq").alias("lat"), F.min_by("lng", "seq").alias("lng"), F.min("slow").alias("slow"), F.min_by("gap", "seq").alias("after_gap"))
    cut = F.coalesce(F.lead("after_gap").over(Window.partitionBy("trip").orderBy("run")), F.lit(False))
    slow = runs.withColumn("cut", cut).filter(F.col("slow") & ~F.col("cut") & (F.col("t1") - F.col("t0") >= STOP_S)).select("trip", "t0", "t1", "lat", "lng")
    return by_gap.unionByName(slow)


def visits(points: DataFrame, places: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """points, places (trip, plat, plng) to (trip, i0, i1, t0, t1): stretches within the radius; one ends only
    at a point outside that is more than GAP_S after the last inside."""
    w = Window.partitionBy("trip").orderBy("seq")
    x = points.join(places, "trip").withColumn("inside", haversine_m(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng")) <= radius_m)
    seen = F.last(F.when(F.col("inside"), F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("brk", (~F.col("inside") & F.coalesce(F.col("t") - seen > GAP_S, F.lit(False))).cast("int"))
    x = x.withColumn("run", F.sum("brk").over(w)).filter("inside")
    return x.groupBy("trip", "run").agg(F.min("seq").alias("i0"), F.max("seq").alias("i1"), F.min_by("t", "seq").alias("t0"), F.max_by("t", "seq").alias("t1")).drop("run")


def remaining_distance(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("trip").orderBy("seq")
    x = points.withColumn("__d", _step("trip", "seq"))
    return x.withColumn("rem_m", F.coalesce(F.sum("__d").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))).drop("__d")


def after_distance(points: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (trip, t0, metres): the points from where that many metres are behind since t0."""
    w = Window.partitionBy("trip").orderBy("seq")
    x = points.withColumn("__d", _step("trip", "seq")).join(starts, "trip").filter("t >= t0")
    return x.withColumn("__m", F.sum(F.coalesce("__d", F.lit(0.0))).over(w)).filter((F.col("__m") >= F.col("metres")) & ((F.col("metres") > 0) | (F.col("t") > F.col("t0")))).drop("__d", "__m", "t0", "metres")


def departure(points: DataFrame, routes: DataFrame) -> DataFrame:
    """routes (trip, s_lat, s_lng, e_lat, e_lng, dist_m, human_dep) to (trip, t_dep, by_stop): the human value;
    else the end of the last stop in the first visit to the start with SHARE of the route still ahead, or when
    that visit ends. Trips that never come near the start have none."""
    v = visits(points, routes.select("trip", F.col("s_lat").alias("plat"), F.col("s_lng").alias("plng")))
    rem = remaining_distance(points).select("trip", F.col("seq").alias("i1"), "rem_m")
    v = v.join(rem, ["trip", "i1"]).join(routes.select("trip", "dist_m"), "trip")
    enough = F.col("rem_m") >= SHARE * F.col("dist_m")
    first = Window.partitionBy("trip").orderBy(F.when(enough, 0).otherwise(1), F.when(enough, F.col("i0").cast("double")).otherwise(-F.col("rem_m")), "i0")
    v = v.withColumn("n", F.row_number().over(first)).filter("n = 1")
    s = stops(points).join(routes.select("trip", "s_lat", "s_lng"), "trip").filter(haversine_m(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng")) <= 2 * RADIUS_M).select("trip", F.col("t0").alias("st0"), F.col("t1").alias("st1"))
    met = v.select("trip", "t0", "t1").join(s, "trip").filter((F.col("st1") >= F.col("t0") - 600) & (F.col("st0") <= F.col("t1") + 60)).groupBy("trip").agg(F.max("st1").alias("stop_end"))
    out = routes.select("trip", "human_dep").join(v.select("trip", F.col("t1").alias("left_at")), "trip", "left").join(met, "trip", "left")
    return out.select("trip", F.coalesce("human_dep", "stop_end", "left_at").alias("t_dep"), (F.col("human_dep").isNull() & F.col("stop_end").isNotNull()).alias("by_stop")).filter("t_dep is not null")


def arrival(points: DataFrame, routes: DataFrame, deps: DataFrame) -> DataFrame:
    """routes also has human_arr. (trip, t_arr, d_arr, d_end): the human value; else a stop, or the trip's end,
    within GOOD_ARRIVAL_M of the route's end; else when the trip was nearest to it."""
    r = routes.join(deps.select("trip", "t_dep"), "trip").select("trip", "e_lat", "e_lng", "human_arr", "t_dep", (SHARE * F.col("dist_m")).alias("metres"))
    far = after_distance(points, r.select("trip", F.col("t_dep").alias("t0"), "metres")).select("trip", "seq", F.lit(0).alias("how"))
    later = points.join(r.select("trip", "t_dep"), "trip").filter("t > t_dep").select("trip", "seq", F.lit(1).alias("how"))
    some = far.unionByName(later).unionByName(points.join(r.select("trip"), "trip").select("trip", "seq", F.lit(2).alias("how")))
    pick = some.groupBy("trip", "seq").agg(F.min("how").alias("how")).withColumn("best", F.min("how").over(Window.partitionBy("trip"))).filter("how = best or (best = 1 and how = 1)")
    to_end = haversine_m(F.col("lat"), F.col("lng"), F.col("e_lat"), F.col("e_lng"))
    near = points.join(pick.select("trip", "seq"), ["trip", "seq"]).join(r, "trip").groupBy("trip").agg(F.min(F.struct(to_end.alias("d"), "seq", "t")).alias("x")).select("trip", F.col("x.d").alias("d_end"), F.col("x.t").alias("t_near"))
    last = points.groupBy("trip").agg(F.max(F.struct("seq", "t", "lat", "lng")).alias("x")).select("trip", F.col("x.t").alias("t0"), F.col("x.t").alias("t1"), F.col("x.lat").alias("lat"), F.col("x.lng").alias("lng"))
    ends = stops(points).unionByName(last).join(near, "trip").join(r.select("trip", "e_lat", "e_lng"), "trip")
    is_last = F.col("t0") == F.col("t1")
    stop = ends.filter((F.col("t0") >= F.col("t_near") - 300) | is_last).groupBy("trip").agg(F.min(F.struct(to_end.alias("d"), "t0")).alias("x")).select("trip", F.col("x.d").alias("d_stop"), F.col("x.t0").alias("t_stop"))
    out = near.join(stop, "trip", "left").join(r.select("trip", "human_arr"), "trip")
    good = F.coalesce(F.col("d_stop") <= GOOD_ARRIVAL_M, F.lit(False))
    return out.select("trip", F.coalesce("human_arr", F.when(good, F.col("t_stop")).otherwise(F.col("t_near"))).alias("t_arr"), F.when(F.col("human_arr").isNotNull() | ~good, F.col("d_end")).otherwise(F.col("d_stop")).alias("d_arr"), "d_end")


def integrate_power(points: DataFrame, windows: DataFrame, missing_power: str = "zero") -> DataFrame:
    """windows (trip, t0, t1) to (trip, kj, moving_s, power_coverage): power times dt for 0 < dt <= LONGEST_DT."""
    w = Window.partitionBy("trip").orderBy("seq")
    x = points.withColumn("dt", F.col("t") - F.lag("t").over(w)).join(windows, "trip").filter((F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1")))
    ok = (F.col("dt") > 0) & (F.col("dt") <= LONGEST_DT)
    power = F.coalesce("power", F.lit(0.0)) if missing_power == "zero" else F.col("power")
    return x.groupBy("trip").agg(
        F.coalesce(F.sum(F.when(ok, power * F.col("dt"))) / 1000, F.lit(0.0)).alias("kj"),
        F.coalesce(F.sum(F.when(ok & (F.col("speed") > STILL), F.col("dt"))), F.lit(0)).alias("moving_s"),
        F.avg(F.col("power").isNotNull().cast("int")).alias("power_coverage"),
    )


def ride_window(points: DataFrame, routes: DataFrame) -> DataFrame:
    """(trip, t_dep, t_arr, kj, moving_s, d_start, d_end, d_arr, by_stop, source) where arrival follows departure."""
    dep = settled(departure(points, routes))
    w = settled(dep.join(arrival(points, routes, dep), "trip").filter("t_arr > t_dep"))
    energy = integrate_power(points, w.select("trip", F.col("t_dep").alias("t0"), F.col("t_arr").alias("t1")))
    start = points.join(routes.select("trip", "s_lat", "s_lng"), "trip").groupBy("trip").agg(F.min(haversine_m(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng"))).alias("d_start"))
    h = routes.select("trip", "human_dep", "human_arr")
    source = F.when(F.col("human_dep").isNotNull() & F.col("human_arr").isNotNull(), "human").when(F.col("human_dep").isNull() & F.col("human_arr").isNull(), "heuristic").otherwise("mixed")
    return w.join(energy, "trip", "left").join(start, "trip").join(h, "trip").select("trip", "t_dep", "t_arr", F.coalesce("kj", F.lit(0.0)).alias("kj"), F.coalesce("moving_s", F.lit(0)).alias("moving_s"), "d_start", "d_end", "d_arr", "by_stop", source.alias("source"))


def upper_medians(values: DataFrame) -> DataFrame:
    """values (what, x) to (what, median): of n values that aren't null the one of rank n // 2 + 1.

    Equal values are counted, the counts are put in order across partitions, and the partitions' sums tell in which one a
    rank lies; only that one is ranked within. Nothing but one sum a partition meets in one task.
    """
    counts = values.filter("x is not null").groupBy("what", "x").agg(F.count("*").alias("n"))
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(counts.repartitionByRange(parts, "what", "x").withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy("what", "part").agg(F.sum("n").alias("held"))
    before = Window.partitionBy("what").orderBy("part")
    sums = sums.withColumn("before", F.sum("held").over(before) - F.col("held")).withColumn("rank", F.floor(F.sum("held").over(Window.partitionBy("what")) / 2) + 1)
    here = sums.filter("before < rank and rank <= before + held")
    within = placed.join(F.broadcast(here), ["what", "part"])
    upto = F.sum("n").over(Window.partitionBy("what", "part").orderBy("x")) + F.col("before")
    return within.withColumn("upto", upto).filter("rank <= upto and rank > upto - n").select("what", F.col("x").alias("median"))


def window_accuracy(blind: DataFrame, human: DataFrame) -> DataFrame:
    """Both (trip, t_dep, t_arr, kj): n, upper medians of the errors, and shares within limits."""
    x = blind.join(human.select("trip", F.col("t_dep").alias("hd"), F.col("t_arr").alias("ha"), F.col("kj").alias("hk")), "trip")
    err = {"dep_min": F.abs(F.col("t_dep") - F.col("hd")) / 60, "arr_min": F.abs(F.col("t_arr") - F.col("ha")) / 60, "kj_pct": F.try_divide(F.abs(F.col("kj") - F.col("hk")), F.col("hk")) * 100}
    x = settled(x.select(*[e.alias(c) for c, e in err.items()]))
    within = lambda c, m: F.avg((F.col(c) <= m).cast("int")).alias(f"{c}_within_{m}")
    shares = x.agg(F.count("*").alias("n"), *[within(c, m) for c in ("dep_min", "arr_min") for m in (5, 10, 30)], *[within("kj_pct", m) for m in (10, 20)])
    medians = upper_medians(x.select(F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("double").alias("x")) for c in err]))))
    wide = medians.agg(*[F.max(F.when(F.col("what") == c, F.col("median"))).alias(f"{c}_median") for c in err])
    one = lambda df: df.withColumn("__row", F.lit(1))
    both = one(shares).join(one(wide), "__row")
    return both.select("n", *[f"{c}_median" for c in err], *shares.columns[1:])


def densify(segments: DataFrame, step_m: float = 30.92, deck_step_m: float = 600.0) -> DataFrame:
    """segments (seg, lat1, lng1, lat2, lng2, len_m, deck, z1, z2) cut into equal parts no longer than the step."""
    n = F.greatest(F.ceil(F.col("len_m") / F.when(F.col("deck"), deck_step_m).otherwise(step_m)), F.lit(1)).cast("int")
    x = segments.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("n")
    return x.select("seg", F.col("k").alias("part"), *[at(f"{c}1", f"{c}2", F.col("k") - 1).alias(f"{c}1") for c in ("lat", "lng", "z")], *[at(f"{c}1", f"{c}2", F.col("k")).alias(f"{c}2") for c in ("lat", "lng", "z")], (F.col("len_m") / F.col("n")).alias("len_m"), "deck")


def route_energy_car(segments: DataFrame, a_roll: float, a_aero: float, beta: float, eps: float, kj_per_litre: float = 32_000.0, metabolic: float = 4.0) -> DataFrame:
    """segments (route, d, dh, bike_kj) to fuel energy, litres, and the ratio to what the riders ate."""
    e = (a_roll + a_aero) * F.col("d") + beta * F.greatest(F.col("dh"), F.lit(0.0)) - eps * beta * F.greatest(-F.col("dh"), F.lit(0.0))
    return segments.groupBy("route").agg(F.sum(e).alias("kj"), F.sum("bike_kj").alias("bike")).select("route", "kj", (F.col("kj") / kj_per_litre).alias("litres"), (F.col("kj") / (metabolic * F.col("bike"))).alias("ratio"))
