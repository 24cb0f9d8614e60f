"""Road graphs from lines: crossings, junctions, nodes, edges, decks. Spatial joins go by cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .energy import settled

#: Tags that make a road a cycling road.
CYCLEWAY = ("lane", "track", "shared_lane", "share_busway", "opposite_lane", "opposite_track")
CYCLE_TAGS = ("cycleway", "cycleway_left", "cycleway_right", "cycleway_both")
EPS = 1e-9


def filter_roads(ways: DataFrame) -> DataFrame:
    return ways.filter("highway is not null").select("id", "highway", "bridge", "tunnel", "layer")


def filter_water(osm: DataFrame) -> tuple[DataFrame, DataFrame]:
    areas = osm.filter("natural = 'water' or landuse = 'reservoir' or waterway = 'riverbank'")
    return areas, osm.filter("waterway = 'river'")


def filter_hydro(osm: DataFrame, area_km2: float = 0.0) -> DataFrame:
    """Waterways and ridges with a style; only the main ones in views above 150 km2."""
    kind = F.when(F.col("natural") == "ridge", "ridge").when(F.col("waterway") == "river", "river").otherwise("other")
    out = osm.filter("waterway is not null or natural = 'ridge'").withColumns({"style": kind, "dashed": F.coalesce(F.col("tunnel").isin("yes", "culvert"), F.lit(False))})
    return out.filter("style != 'other'") if area_km2 > 150 else out


def filter_cycling(osm: DataFrame) -> DataFrame:
    path = (F.col("highway") == "path") & F.col("bicycle").isin("yes", "designated")
    tagged = F.lit(False)
    for tag in CYCLE_TAGS:
        tagged = tagged | F.coalesce(F.col(tag).isin(*CYCLEWAY), F.lit(False))
    return osm.filter((F.col("highway") == "cycleway") | F.coalesce(path, F.lit(False)) | (F.col("highway").isNotNull() & tagged))


def filter_relations(relations: DataFrame, network: str) -> DataFrame:
    """Relations of a cycle network; none at all is an error, found when rows are read."""
    out = relations.filter(F.col("cycle_network") == network)
    if not out.limit(1).count():
        raise ValueError(f"no relation of {network}")
    return out


def segments(vertices: DataFrame) -> DataFrame:
    """vertices (line, seq, r, c) to (line, seq, r1, c1, r2, c2, off, len) without empty ones."""
    w = Window.partitionBy("line").orderBy("seq")
    x = vertices.select("line", "seq", F.col("r").alias("r1"), F.col("c").alias("c1"), F.lead("r").over(w).alias("r2"), F.lead("c").over(w).alias("c2")).filter("r2 is not null")
    x = x.withColumn("len", F.sqrt(F.pow(F.col("r2") - F.col("r1"), 2) + F.pow(F.col("c2") - F.col("c1"), 2))).filter("len > 0")
    return x.withColumn("off", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def _cells(r1: Column, c1: Column, r2: Column, c2: Column, size: float, pad: float = 0.0) -> Column:
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - pad) / size), F.floor((F.greatest(a, b) + pad) / size))
    return F.flatten(F.transform(span(r1, r2), lambda i: F.transform(span(c1, c2), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def crossings(segs: DataFrame, lines: DataFrame, cell: float = 8.0, z_tol: float | None = None) -> DataFrame:
    """Splits (line, seq, t) where segments of different lines cross inside both; not where a deck crosses
    another layer. lines (line, deck, layer). Segments of one cell meet, and each pair is tried once."""
    x = segs.join(lines, "line").withColumn("cell", F.explode(_cells(F.col("r1"), F.col("c1"), F.col("r2"), F.col("c2"), cell)))
    a, b = x.alias("a"), x.alias("b")
    pair = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.line") < F.col("b.line")))
    d = lambda k, s: F.col(f"{s}.{k}2") - F.col(f"{s}.{k}1")
    den = d("r", "a") * d("c", "b") - d("c", "a") * d("r", "b")
    dr, dc = F.col("b.r1") - F.col("a.r1"), F.col("b.c1") - F.col("a.c1")
    t, u = F.try_divide(dr * d("c", "b") - dc * d("r", "b"), den), F.try_divide(dr * d("c", "a") - dc * d("r", "a"), den)
    apart = (F.col("a.deck") | F.col("b.deck")) & (F.col("a.layer") != F.col("b.layer"))
    hit = pair.filter(~apart & (F.abs(den) > 1e-12)).select(F.col("a.line").alias("la"), F.col("a.seq").alias("sa"), F.col("b.line").alias("lb"), F.col("b.seq").alias("sb"), t.alias("t"), u.alias("u"))
    hit = hit.filter((F.col("t") > EPS) & (F.col("t") < 1 - EPS) & (F.col("u") > EPS) & (F.col("u") < 1 - EPS)).dropDuplicates(["la", "sa", "lb", "sb"])
    return hit.select(F.inline(F.array(F.struct(F.col("la").alias("line"), F.col("sa").alias("seq"), F.col("t").alias("t")), F.struct(F.col("lb").alias("line"), F.col("sb").alias("seq"), F.col("u").alias("t")))))


def _on_way(size: Column, pad: Column) -> Column:
    """The cells that a segment (r1, c1, r2, c2) comes within pad of: row by row of cells, those of the columns
    between which the segment runs there."""
    r1, c1, r2, c2 = map(F.col, ("r1", "c1", "r2", "c2"))
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - pad) / size), F.floor((F.greatest(a, b) + pad) / size))
    clip = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    steep = F.abs(r2 - r1) > pad  # else a row of cells may hold all of it

    def row(i: Column) -> Column:
        ta, tb = clip((i * size - pad - r1) / (r2 - r1)), clip(((i + 1) * size + pad - r1) / (r2 - r1))
        a, b = F.when(steep, c1 + ta * (c2 - c1)).otherwise(c1), F.when(steep, c1 + tb * (c2 - c1)).otherwise(c2)
        return F.transform(span(a, b), lambda j: F.struct(i.alias("i"), j.alias("j")))

    return F.flatten(F.transform(span(r1, r2), row))


def t_junctions(vertices: DataFrame, segs: DataFrame, tol: float, cell: float = 8.0) -> DataFrame:
    """Splits (line, seq, t, r, c) of segments that a vertex of another line lies on, within the tolerance.

    The vertices of a place are tried once: it counts for a line if its smallest or its largest line is another.
    Cells are as large as hold one place on average, `cell` at most, but not so small that a segment of mean
    length crosses more than about a hundred; a segment meets the cells on its way only.
    """
    place = settled(vertices.groupBy("r", "c").agg(F.min("line").alias("l0"), F.max("line").alias("l1")).filter("r is not null and c is not null"))
    box = place.agg(((F.max("r") - F.min("r")) * (F.max("c") - F.min("c")) / F.count("*")).alias("share")).crossJoin(segs.agg(F.avg("len").alias("mean"))).first()
    size = min(cell, max(math.sqrt(box["share"] or 0.0), (box["mean"] or 0.0) / 64, 4 * tol, 1e-6))
    size, pad = F.lit(size), F.lit(tol + 1e-6 * size)
    v = place.select("l0", "l1", F.col("r").alias("vr"), F.col("c").alias("vc"), F.floor(F.col("r") / size).alias("i"), F.floor(F.col("c") / size).alias("j"))
    s = segs.select("line", "seq", "r1", "c1", "r2", "c2", F.inline(_on_way(size, pad)))
    dr, dc = F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1")
    t = ((F.col("vr") - F.col("r1")) * dr + (F.col("vc") - F.col("c1")) * dc) / (dr * dr + dc * dc)
    off = F.sqrt(F.pow(F.col("vr") - (F.col("r1") + t * dr), 2) + F.pow(F.col("vc") - (F.col("c1") + t * dc), 2))
    hit = s.join(v, ["i", "j"]).filter("line != l0 or line != l1").withColumns({"t": t, "off": off}).filter((F.col("t") > EPS) & (F.col("t") < 1 - EPS) & (F.col("off") <= tol))
    return hit.select("line", "seq", "t", F.col("vr").alias("r"), F.col("vc").alias("c")).distinct()


def node_key(r: Column, c: Column, snap: float) -> Column:
    return F.struct(F.floor(r / snap + 0.5).alias("i"), F.floor(c / snap + 0.5).alias("j"))


def snap_nodes(points: DataFrame, snap: float) -> DataFrame:
    """points (line, seq, r, c) to (key, r, c): one node per rounded place, with its first point's coordinates."""
    x = points.withColumn("key", node_key(F.col("r"), F.col("c"), snap))
    return x.groupBy("key").agg(F.min(F.struct("line", "seq", "r", "c")).alias("x")).select("key", "x.r", "x.c")


def emit_edges(segs: DataFrame, splits: DataFrame, snap: float) -> DataFrame:
    """(a, b, line, len): pieces between cuts with node keys at their ends, a < b, one per pair of nodes."""
    at = lambda t: (F.col("r1") + (F.col("r2") - F.col("r1")) * t, F.col("c1") + (F.col("c2") - F.col("c1")) * t)
    cuts = segs.join(splits.groupBy("line", "seq").agg(F.collect_set("t").alias("ts")), ["line", "seq"], "left")
    cuts = cuts.withColumn("t", F.explode(F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("ts", F.array().cast("array<double>")))))))
    w = Window.partitionBy("line", "seq").orderBy("t")
    x = cuts.withColumn("t2", F.lead("t").over(w)).filter(F.col("t2") - F.col("t") > EPS)
    x = x.withColumns({"ka": node_key(*at(F.col("t")), snap), "kb": node_key(*at(F.col("t2")), snap)}).filter("ka != kb")
    x = x.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "line", "seq", "t", (F.col("len") * (F.col("t2") - F.col("t"))).alias("len"))
    return x.groupBy("a", "b").agg(F.min(F.struct("line", "seq", "t", "len")).alias("x")).select("a", "b", "x.line", "x.len")


def deck_flatten(vertices: DataFrame, decks: DataFrame) -> DataFrame:
    """vertices (line, seq, r, c, h) with the heights of decks (line, ele_a, ele_b) straight from end to end; a
    surveyed end counts before the ground's."""
    w = Window.partitionBy("line").orderBy("seq")
    step = F.sqrt(F.pow(F.col("r") - F.lag("r").over(w), 2) + F.pow(F.col("c") - F.lag("c").over(w), 2))
    x = vertices.withColumn("__d", F.coalesce(step, F.lit(0.0))).withColumn("__s", F.sum("__d").over(w))
    ends = x.groupBy("line").agg(F.min_by("h", "seq").alias("ha"), F.max_by("h", "seq").alias("hb"), F.max("__s").alias("full"))
    x = x.join(ends, "line").join(decks.withColumn("deck", F.lit(True)), "line", "left")
    a, b = F.coalesce("ele_a", "ha"), F.coalesce("ele_b", "hb")
    flat = a + (b - a) * F.coalesce(F.try_divide(F.col("__s"), F.col("full")), F.lit(0.0))
    return x.select("line", "seq", "r", "c", F.when(F.col("deck"), flat).otherwise(F.col("h")).alias("h"))


def deck_chains(decks: DataFrame) -> DataFrame:
    """decks (line, layer, a, b: end nodes, len, ha, hb) to (line, h0, h1): decks of one layer that share ends
    and form a simple path are one ramp from its first end to its last; rings and forks stay as they are.

    Each deck is passed in two ways. A way leads to the next deck's where two decks meet and no more, and ends at a
    free end or at a fork. Pointers along the ways are doubled, so a chain of n decks takes log2(n) rounds; ways that
    still lead on after a round in which none came to an end go in a ring.
    """
    layer = F.coalesce("layer", F.lit(0)).alias("layer")
    own = decks.select("line", layer, "a", "b", "len", "ha", "hb")
    deg = own.select("layer", F.explode(F.array("a", "b")).alias("node")).groupBy("layer", "node").agg(F.count("*").alias("deg"))
    way = lambda a, b, fwd: own.select("layer", F.col(a).alias("node"), "line", F.lit(fwd).alias("fwd"), "len", F.col(b).alias("to"), F.col("hb" if fwd else "ha").alias("tail"))
    ways = settled(way("a", "b", True).union(way("b", "a", False)).join(deg.select("layer", F.col("node").alias("to"), "deg"), ["layer", "to"]))
    on = ways.filter("deg = 2").select("layer", F.col("to").alias("node"), F.col("line").alias("came"), F.col("fwd").alias("came_fwd"))
    after = on.join(ways.select("layer", "node", "line", "fwd"), ["layer", "node"]).filter("line != came").select(F.col("came").alias("line"), F.col("came_fwd").alias("fwd"), F.struct("line", "fwd").alias("next"))
    x = ways.join(after, ["line", "fwd"], "left").select("line", "fwd", "len", F.col("len").alias("rest"), "tail", F.col("deg").alias("last"), "next")
    x = settled(x.select("line", "fwd", "len", "rest", "tail", F.when(F.col("next").isNull(), F.col("last") == 1).alias("free"), "next"))
    left = x.filter("next is not null").count()
    while left:
        y = x.select(F.struct("line", "fwd").alias("next"), F.col("rest").alias("rest2"), F.col("tail").alias("tail2"), F.col("free").alias("free2"), F.col("next").alias("next2"))
        x = settled(x.join(y, "next", "left").select("line", "fwd", "len", (F.col("rest") + F.coalesce("rest2", F.lit(0))).alias("rest"), F.coalesce("tail2", "tail").alias("tail"), F.coalesce("free", "free2").alias("free"), F.col("next2").alias("next")))
        before, left = left, x.filter("next is not null").count()
        if left == before:
            break
    end = lambda fwd, k: x.filter((F.col("fwd") == fwd) & F.col("free")).select("line", F.col("rest").alias(f"rest{k}"), F.col("tail").alias(f"tail{k}"))
    both = decks.join(end(True, 1), "line", "left").join(end(False, 0), "line", "left")
    full = F.col("rest0") + F.col("rest1") - F.col("len")
    at = lambda d: F.col("tail0") + (F.col("tail1") - F.col("tail0")) * d / F.when(full > 0, full).otherwise(1.0)
    ramp = F.col("rest0").isNotNull() & F.col("rest1").isNotNull()
    return both.select("line", F.when(ramp, at(F.col("rest0") - F.col("len"))).otherwise(F.col("ha")).alias("h0"), F.when(ramp, at(F.col("rest0"))).otherwise(F.col("hb")).alias("h1"))


def node_elevation(nodes: DataFrame, cells: DataFrame, height: int, width: int) -> DataFrame:
    """nodes (id, r, c) with h and valid: inside the raster, on data."""
    from .raster import sample_bilinear

    h = sample_bilinear(nodes, cells, height, width)
    at = nodes.select("id", F.floor("r").cast("int").alias("__r"), F.floor("c").cast("int").alias("__c")).join(cells.filter("mask").select(F.col("r").alias("__r"), F.col("c").alias("__c"), F.lit(True).alias("ok")), ["__r", "__c"], "left")
    return nodes.join(h, "id", "left").join(at.select("id", F.coalesce("ok", F.lit(False)).alias("valid")), "id")


def edge_profiles(edges: DataFrame, cells: DataFrame, height: int, width: int, dx: float, dy: float, step_m: float) -> DataFrame:
    """edges (edge, r1, c1, r2, c2) with len_m, step_m and profile: heights at equal steps from end to end, each as
    raster.sample_bilinear() has it.

    An edge asks once for each cell that its points lie between, and its profile is made where the answers meet. A
    corner of weight 0 isn't asked for, unless it is the floor cell."""
    ln = F.sqrt(F.pow((F.col("r2") - F.col("r1")) * dy, 2) + F.pow((F.col("c2") - F.col("c1")) * dx, 2))
    x = edges.select("edge", "r1", "c1", "r2", "c2", ln.alias("len_m")).withColumn("n", F.greatest(F.ceil(F.col("len_m") / step_m), F.lit(1)).cast("int"))
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(v - 0.5, F.lit(float(top - 1))))
    along = lambda end, k: F.col(f"{end}1") + (F.col(f"{end}2") - F.col(f"{end}1")) * k / F.col("n")
    places = F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: F.struct(clamp(along("r", k), height).alias("r"), clamp(along("c", k), width).alias("c")))
    key = lambda r, c: F.shiftleft(r.cast("long"), 32) + c.cast("long")

    def corners(p: Column) -> Column:
        r0, c0 = F.floor(p["r"]), F.floor(p["c"])
        r1, c1 = F.least(r0 + 1, F.lit(height - 1)), F.least(c0 + 1, F.lit(width - 1))
        fr, fc = p["r"] - r0, p["c"] - c0
        tap = lambda r, c, w, n: F.struct(key(r, c).alias("cell"), w.alias("w"), F.lit(n).alias("n"))
        taps = F.array(tap(r0, c0, (1 - fr) * (1 - fc), 0), tap(r0, c1, (1 - fr) * fc, 1), tap(r1, c0, fr * (1 - fc), 2), tap(r1, c1, fr * fc, 3))
        return F.filter(taps, lambda t: (t["w"] != 0) | (t["n"] == 0))

    asked = x.withColumn("cell", F.explode(F.array_distinct(F.transform(F.flatten(F.transform(places, corners)), lambda t: t["cell"]))))
    known = cells.select(key(F.col("r"), F.col("c")).alias("cell"), "h", F.coalesce("mask", F.lit(False)).alias("ok"))
    own = asked.join(known, "cell", "left").groupBy("edge").agg(*[F.first(c).alias(c) for c in ("r1", "c1", "r2", "c2", "len_m", "n")], F.collect_list(F.struct("cell", "h", "ok")).alias("found"))
    own = own.withColumn("cells", F.transform("found", lambda f: f["cell"]))

    def sampled(p: Column) -> Column:
        taps = F.transform(corners(p), lambda t: F.struct(t["w"].alias("w"), t["n"].alias("n"), F.get("found", F.array_position("cells", t["cell"]).cast("int") - 1).alias("f")))
        data = F.filter(taps, lambda t: F.coalesce(t["f"]["ok"], F.lit(False)))
        total = lambda value: F.aggregate(data, F.lit(0.0), lambda a, t: a + F.coalesce(value(t), F.lit(0.0)))
        mean = F.try_divide(total(lambda t: t["f"]["h"] * t["w"]), total(lambda t: t["w"]))
        return F.coalesce(F.when(F.exists(data, lambda t: t["f"]["h"].isNotNull()), mean), taps[0]["f"]["h"])

    return own.select("edge", "len_m", (F.col("len_m") / F.col("n")).alias("step_m"), F.transform(places, sampled).alias("profile"))


def half_edges(edges: DataFrame) -> DataFrame:
    """edges (edge, a, b, cost_ab, cost_ba) to (src, dst, edge, a_to_b, cost, back)."""
    way = lambda a, b, f, c, d: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "edge", F.lit(f).alias("a_to_b"), F.col(c).alias("cost"), F.col(d).alias("back"))
    return edges.select(F.inline(F.array(way("a", "b", True, "cost_ab", "cost_ba"), way("b", "a", False, "cost_ba", "cost_ab"))))


def bake_graph(lines: DataFrame, heights: DataFrame, snap_deg: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """lines (line, seq, lat, lng, deck) and heights (line, seq, h) to nodes (key, lat, lng, dm) and edges (a, b,
    len_dm, deck): decimetres, clamped to 16 bits, one edge per pair of nodes."""
    from ..functions.geo import equirect_m

    x = lines.join(heights, ["line", "seq"], "left").withColumn("key", node_key(F.col("lat"), F.col("lng"), snap_deg))
    dm = F.greatest(F.lit(-32767), F.least(F.lit(32767), F.bround(F.coalesce("x.h", F.lit(0.0)) * 10, 0))).cast("int")
    nodes = x.groupBy("key").agg(F.min(F.struct("line", "seq", "lat", "lng", "h")).alias("x")).select("key", "x.lat", "x.lng", dm.alias("dm"))
    w = Window.partitionBy("line").orderBy("seq")
    e = x.withColumns({"kb": F.lead("key").over(w), "lat2": F.lead("lat").over(w), "lng2": F.lead("lng").over(w)}).filter("kb is not null and kb != key")
    ln = F.least(F.lit(65535), F.bround(equirect_m(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")) * 10, 0)).cast("int")
    e = e.select(F.least("key", "kb").alias("a"), F.greatest("key", "kb").alias("b"), "line", "seq", ln.alias("len_dm"), "deck")
    return nodes, e.groupBy("a", "b").agg(F.min(F.struct("line", "seq", "len_dm", "deck")).alias("x")).select("a", "b", "x.len_dm", "x.deck")


def nearest_node(points: DataFrame, nodes: DataFrame, cell: float, rings: int = 3) -> DataFrame:
    """points (p, r, c) and nodes (id, r, c, valid) to (p, node, d): the nearest valid node within `rings` cells;
    points that have none there look four times as far, and so on, until each has one. Without a valid
    node, or without a finite place, a point has no row. The points of a place are matched once, and so are its
    nodes, of which the smallest counts."""
    finite = (F.abs("r") < float("inf")) & (F.abs("c") < float("inf"))
    nodes = settled(nodes.filter("valid").filter(finite).groupBy("r", "c").agg(F.min("id").alias("id")))
    points = points.filter(finite)
    some = nodes.limit(1).count()
    left, found = settled(points.select("r", "c").distinct()), None
    while True:
        v = nodes.select(F.col("id").alias("node"), F.col("r").alias("nr"), F.col("c").alias("nc"), F.floor(F.col("r") / cell).alias("i"), F.floor(F.col("c") / cell).alias("j"))
        around = F.explode(_cells(F.col("r"), F.col("c"), F.col("r"), F.col("c"), cell, rings * cell))
        x = left.withColumn("cell", around).select("r", "c", "cell.i", "cell.j").join(v, ["i", "j"])
        d = F.sqrt(F.pow(F.col("r") - F.col("nr"), 2) + F.pow(F.col("c") - F.col("nc"), 2))
        best = settled(x.withColumn("d", d).filter(F.col("d") <= rings * cell).groupBy("r", "c").agg(F.min(F.struct("d", "node")).alias("x")).select("r", "c", "x.node", "x.d"))
        found = best if found is None else found.unionByName(best)
        left = settled(left.join(best, ["r", "c"], "left_anti"))
        if not some or not left.limit(1).count():
            break
        cell *= 4
    return points.join(found, ["r", "c"]).groupBy("p").agg(F.min(F.struct("d", "node")).alias("x")).select("p", "x.node", "x.d")


def layer_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("layer").agg(F.count("*").alias("n"))
