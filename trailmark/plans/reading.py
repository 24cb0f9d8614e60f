"""Queries over readers: the given tables written as lines, GPX, JSON and polylines, and read again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import time as tm
from ..operators import energy as n
from ..operators import roads as g
from ..sources import facts as fa
from ..sources import files as fi
from . import views as v
from .registry import query


def _join(*parts) -> Column:
    """Plain strings and columns as one text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("a1_read_triples", v.sql("SELECT DISTINCT s, p, o, o_kind, o_dtype FROM facts", "facts"))
def a1(spark, d):
    x = v.facts(spark, d)
    literal = F.when(F.col("o_dtype") == "xsd:string", _join('"', F.col("o"), '"')).otherwise(_join('"', F.col("o"), '"^^<', F.col("o_dtype"), ">"))
    o = F.when(F.col("o_kind") == "iri", _join("<", F.col("o"), ">")).otherwise(literal)
    lines = x.select(_join("<", F.col("s"), "> <", F.col("p"), "> ", o, " .").alias("value"), F.lit("facts.nt").alias("file"))
    return fa.triple_rows(lines).select("s", "p", "o", "o_kind", "o_dtype")


@query("a7_census_rows", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS title, CAST(o_orderkey AS VARCHAR) AS route, CASE WHEN o_orderkey % 4 <> 0 THEN 'https://x.example/activities/' || o_custkey END AS activity FROM orders")
def a7(spark, d):
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    short = _join(day, "\thttps://x.example/routes/", k)
    full = _join(day, " 07:00\t\t\t\t\t\t", F.col("o_orderpriority"), "\tsee https://x.example/routes/", k, "\tas https://x.example/activities/", F.col("o_custkey"), " says")
    return fi.census_rows(v.table(spark, d, "orders").select(F.when(k % 4 == 0, short).otherwise(full).alias("value")))


LAT, LNG = "(event_id % 80) + 0.25", "-(event_id % 170) - 0.5"


def places(spark, d):
    """Events with a place whose numbers are exact in text and in binary."""
    return v.table(spark, d, "events").selectExpr("*", f"{LAT} AS lat", f"{LNG} AS lng")


@query("a9_gpx_points", f"SELECT event_id AS path, 0::INT AS seq, CAST({LAT} AS DOUBLE) AS lat, CAST({LNG} AS DOUBLE) AS lng, CAST(user_id AS DOUBLE) AS ele FROM events UNION ALL SELECT event_id, 1, CAST(-({LAT}) AS DOUBLE), CAST(-({LNG}) AS DOUBLE), NULL FROM events")
def a9(spark, d):
    lat, lng = F.col("lat"), F.col("lng")
    gpx = _join('<gpx><trk><trkseg><trkpt lat="', lat, '" lon="', lng, '">\n<ele> ', F.col("user_id"), " </ele></trkpt><trkpt lon='", -lng, "' lat='", -lat, """'/><trkpt lon="1"></trkpt><rtept lat="NaN" lon="1"/></trkseg></trk></gpx>""")
    return fi.gpx_points(places(spark, d).select(F.col("event_id").alias("path"), gpx.alias("value")))


@query("a10_gpx_pois", "SELECT page_id AS path, 0::INT AS seq, CAST((page_id % 80) || '.12346' AS DOUBLE) AS lat, CAST('-' || (page_id % 170) || '.98766' AS DOUBLE) AS lng, nullif(trim(url), '') AS name, 'Flag' AS sym, NULL::VARCHAR AS type FROM pages WHERE url IS NOT NULL")
def a10(spark, d):
    k = F.col("page_id")
    gpx = _join('<gpx><wpt lat="', k % 80, '.123456" lon="-', k % 170, '.987656">\n<name>', tx.escape_xml(F.col("url")), '</name><sym>Flag</sym></wpt><wpt lat="x" lon="1"/></gpx>')
    return fi.gpx_pois(v.table(spark, d, "pages").select(k.alias("path"), gpx.alias("value")))


def track_json(spark, d):
    lat, lng = F.col("lat"), F.col("lng")
    text = _join('{"route":{"track_points":[{"x":', lng, ',"y":', lat, ',"e":', F.col("user_id"), '},{"x":1},{"lng":', -lng, ',"lat":', -lat, '}],"points_of_interest":[{"lat":', lat, ',"lng":', lng, ',"name":"', F.col("event_type"), '","type":"stop"}]}}')
    return fi.track_points_from_json(places(spark, d).select(F.col("event_id").alias("id"), text.alias("value")))


@query("a11_track_points", f"SELECT event_id AS id, 0::INT AS seq, CAST({LAT} AS DOUBLE) AS lat, CAST({LNG} AS DOUBLE) AS lng, CAST(user_id AS DOUBLE) AS ele FROM events UNION ALL SELECT event_id, 2, CAST(-({LAT}) AS DOUBLE), CAST(-({LNG}) AS DOUBLE), NULL FROM events")
def a11(spark, d):
    return track_json(spark, d)[0]


@query("a11b_track_places", f"SELECT event_id AS id, CAST({LAT} AS DOUBLE) AS lat, CAST({LNG} AS DOUBLE) AS lng, event_type AS name, NULL::VARCHAR AS sym, 'stop' AS type FROM events")
def a11b(spark, d):
    return track_json(spark, d)[1]


@query("a12_trip_points", f"WITH e AS (SELECT *, CAST({LAT} AS DOUBLE) AS lat, CAST({LNG} AS DOUBLE) AS lng FROM events) SELECT event_id AS trip, 1::INT AS seq, event_id + 1 AS t, lat, lng, 0.0::DOUBLE AS speed, NULL::DOUBLE AS power FROM e UNION ALL SELECT event_id, 2, event_id + 2, lat, lng, value, CAST(user_id AS DOUBLE) FROM e UNION ALL SELECT event_id, 3, event_id + 3, -lat, -lng, 1.5, NULL FROM e")
def a12(spark, d):
    k, lat, lng = F.col("event_id"), F.col("lat"), F.col("lng")
    text = _join('{"track_points":[{"t":', k, '},{"t":', k + 1, ',"y":', lat, ',"x":', lng, '},{"t":', k + 2, ',"s":', F.col("value"), ',"p":', F.col("user_id"), '},{"t":', k + 3, ',"y":', -lat, ',"x":', -lng, ',"s":1.5}]}')
    return fi.trip_points(places(spark, d).select(k.alias("trip"), text.alias("value")))


def _encoded(number: Column) -> Column:
    """A whole number below 2^18 in size as four characters of an encoded polyline."""
    bits = F.when(number < 0, -2 * number - 1).otherwise(2 * number)
    return F.concat(*[F.char(F.shiftright(bits, 5 * i).bitwiseAND(F.lit(31)) + (95 if i < 3 else 63)) for i in range(4)])


#: Three points in hundred-thousandths of a degree: the first and two steps.
START, STEPS = ("(id * 7919) % 200000", "-((id * 104729) % 200000)"), (("id % 1000", "-(id % 777)"), ("-(id % 500)", "id % 333"))
POINTS = [tuple(" + ".join([START[i], *[f"({s[i]})" for s in STEPS[:k]]]) for i in (0, 1)) for k in range(3)]


def _polyline() -> Column:
    return F.concat(*[_encoded(F.expr(x)) for pair in (START, *STEPS) for x in pair])


@query("a14_decode_polyline", " UNION ALL ".join(f"SELECT event_id AS id, {k}::INT AS seq, ({lat}) / 1e5 AS lat, ({lng}) / 1e5 AS lng FROM (SELECT event_id, event_id AS id FROM events) WHERE id % 10 <> 0" for k, (lat, lng) in enumerate(POINTS)))
def a14(spark, d):
    x = v.table(spark, d, "events").select(F.col("event_id").alias("id"))
    text = F.when(F.col("id") % 10 == 0, F.concat(_polyline(), F.lit("?"))).otherwise(_polyline())
    return x.select("id", F.posexplode(fi.decode_polyline(text)).alias("seq", "p")).select("id", "seq", "p.lat", "p.lng")


def saved(spark, d):
    """Orders as saved routes of three waypoints: an encoded leg, then one that is corrupt."""
    x = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    place = lambda k: [(F.expr(POINTS[k][i]) / 1e5).cast("string") for i in (0, 1)]
    none = F.lit(None).cast("string")
    wp = F.array(F.array(*place(0), "name", F.lit("true"), none), F.array(*place(2), F.lit("between"), F.lit("0"), none), F.array(F.lit("10.5"), F.lit("20.25"), F.lit("end"), F.lit("1"), F.lit("Pin")))
    return fi.saved_route_geometry(x.select("id", F.struct(wp.alias("wp"), F.array(_polyline(), F.lit("\x01")).alias("sg")).alias("state")))


SAVED = "(SELECT o_orderkey AS id, o_orderpriority AS name FROM orders)"


@query("a15_saved_route_geometry", " UNION ALL ".join([*[f"SELECT id, {k}::INT AS seq, ({lat}) / 1e5 AS lat, ({lng}) / 1e5 AS lng FROM {SAVED}" for k, (lat, lng) in enumerate(POINTS)], f"SELECT id, 3, 10.5, 20.25 FROM {SAVED}"]))
def a15(spark, d):
    return saved(spark, d)[0]


@query("a15b_saved_route_places", f"SELECT id, ({POINTS[0][0]}) / 1e5 AS lat, ({POINTS[0][1]}) / 1e5 AS lng, name, 'Flag, Blue' AS sym FROM {SAVED} UNION ALL SELECT id, 10.5, 20.25, 'end', 'Pin' FROM {SAVED}")
def a15b(spark, d):
    return saved(spark, d)[1]


def streets(spark, d):
    """Cells as short streets that cross their neighbours only: vertices, and line data."""
    x = v.cells(spark, d).withColumn("line", F.col("r").cast("long") * 1000 + F.col("c"))
    at = lambda seq, r, c: F.struct(F.lit(seq).alias("seq"), r.cast("double").alias("r"), c.cast("double").alias("c"))
    ends = F.array(at(0, F.col("r"), F.col("c")), at(1, F.col("r") + 1.5, F.col("c") + (F.col("h") % 9) / 2 - 2))
    return x.select("line", F.inline(ends)), x.select("line", (F.col("h") > 25).alias("deck"), (F.col("h") % 2).cast("int").alias("layer"))


STREETS = """s AS (SELECT CAST(r AS BIGINT) * 1000 + c AS line, CAST(r AS DOUBLE) AS r1, CAST(c AS DOUBLE) AS c1, r + 1.5::DOUBLE AS r2, c + (h % 9) / 2 - 2 AS c2, h > 25 AS deck, h % 2 AS layer FROM cells),
  x AS (SELECT a.line AS la, b.line AS lb, (a.r2 - a.r1) * (b.c2 - b.c1) - (a.c2 - a.c1) * (b.r2 - b.r1) AS den, b.r1 - a.r1 AS dr, b.c1 - a.c1 AS dc, a.r2 - a.r1 AS ar, a.c2 - a.c1 AS ac, b.r2 - b.r1 AS br, b.c2 - b.c1 AS bc
    FROM s a JOIN s b ON a.line < b.line AND b.r1 BETWEEN a.r1 AND a.r1 + 1.5 AND NOT ((a.deck OR b.deck) AND a.layer <> b.layer)),
  hit AS (SELECT la, lb, (dr * bc - dc * br) / den AS t, (dr * ac - dc * ar) / den AS u FROM x WHERE abs(den) > 1e-12),
  cut AS (SELECT * FROM hit WHERE t > 1e-9 AND t < 1 - 1e-9 AND u > 1e-9 AND u < 1 - 1e-9),
  splits AS (SELECT la AS line, t FROM cut UNION ALL SELECT lb, u FROM cut)"""


@query("g7_crossings", v.sql(f"WITH {STREETS} SELECT line, 0::INT AS seq, round(t, 6) AS t FROM splits", "cells"))
def g7(spark, d):
    vertices, lines = streets(spark, d)
    return g.crossings(g.segments(vertices), lines).select("line", "seq", F.round("t", 6).alias("t"))


@query("g10_emit_edges", v.sql(f"""WITH {STREETS}, w AS (SELECT line, t FROM splits UNION SELECT line, 0.0 FROM s UNION SELECT line, 1.0 FROM s),
  p AS (SELECT *, lead(t) OVER (PARTITION BY line ORDER BY t) AS t2 FROM w), q AS (SELECT p.*, r1 + (r2 - r1) * t AS ra, c1 + (c2 - c1) * t AS ca, r1 + (r2 - r1) * t2 AS rb, c1 + (c2 - c1) * t2 AS cb, sqrt(pow(r2 - r1, 2) + pow(c2 - c1, 2)) * (t2 - t) AS len FROM p JOIN s USING (line) WHERE t2 - t > 1e-9),
  k AS (SELECT *, CAST(floor(ra / 0.01 + 0.5) AS BIGINT) AS i1, CAST(floor(ca / 0.01 + 0.5) AS BIGINT) AS j1, CAST(floor(rb / 0.01 + 0.5) AS BIGINT) AS i2, CAST(floor(cb / 0.01 + 0.5) AS BIGINT) AS j2 FROM q),
  o AS (SELECT *, (i1, j1) < (i2, j2) AS up FROM k WHERE i1 <> i2 OR j1 <> j2),
  e AS (SELECT CASE WHEN up THEN i1 ELSE i2 END AS ai, CASE WHEN up THEN j1 ELSE j2 END AS aj, CASE WHEN up THEN i2 ELSE i1 END AS bi, CASE WHEN up THEN j2 ELSE j1 END AS bj, line, t, len FROM o)
  SELECT ai, aj, bi, bj, line, round(len, 6) AS len FROM (SELECT *, row_number() OVER (PARTITION BY ai, aj, bi, bj ORDER BY line, t) AS n FROM e) WHERE n = 1""", "cells"))
def g10(spark, d):
    vertices, lines = streets(spark, d)
    segs = g.segments(vertices)
    out = g.emit_edges(segs, g.crossings(segs, lines), 0.01)
    return out.select(*[F.col(f"{e}.{k}").alias(e + k) for e in "ab" for k in "ij"], "line", F.round("len", 6).alias("len"))


@query("g11_deck_flatten", v.sql("""WITH x AS (SELECT *, sqrt(pow(lat - lag(lat) OVER w, 2) + pow(lng - lag(lng) OVER w, 2)) AS d FROM fixes WINDOW w AS (PARTITION BY trip ORDER BY seq)), y AS (SELECT *, sum(coalesce(d, 0)) OVER (PARTITION BY trip ORDER BY seq) AS m FROM x),
  e AS (SELECT trip, CASE WHEN trip % 3 = 0 THEN 7.0 ELSE arg_min(power, seq) END AS a, arg_max(power, seq) AS b, max(m) AS whole FROM y GROUP BY trip)
  SELECT trip AS line, seq, round(CASE WHEN trip % 2 = 0 THEN a + (b - a) * CASE WHEN whole > 0 THEN m / whole ELSE 0 END ELSE power END, 4) AS h FROM y JOIN e USING (trip)""", "fixes"))
def g11(spark, d):
    x = v.fixes(spark, d).select(F.col("trip").alias("line"), "seq", F.col("lat").alias("r"), F.col("lng").alias("c"), F.col("power").alias("h"))
    decks = x.select("line").distinct().filter("line % 2 = 0").select("line", F.when(F.col("line") % 3 == 0, 7.0).alias("ele_a"), F.lit(None).cast("double").alias("ele_b"))
    return g.deck_flatten(x, decks).select("line", "seq", F.round("h", 4).alias("h"))


@query("n6_swept_passes", v.sql("WITH more AS (SELECT 's' || l_suppkey AS origin, 'p' || (l_partkey + 1) AS node, sum(cost) AS more FROM (SELECT l_suppkey, l_partkey, min(l_quantity) AS cost FROM lineitem GROUP BY ALL) GROUP BY ALL) SELECT a AS origin, b AS node, edge, cost + coalesce(more, 0) AS passes FROM roads LEFT JOIN more ON origin = a AND node = b", "roads"))
def n6(spark, d):
    """Every edge as a move that also crosses the node of the next part."""
    e = v.roads(spark, d)
    flow = e.select(F.col("a").alias("origin"), F.col("b").alias("node"), "edge", F.col("cost_ab").alias("passes"))
    sweep = e.select("edge", _join("p", F.substring("b", 2, 20).cast("long") + 1).alias("node"))
    return n.swept_passes(flow, sweep).select("origin", "node", "edge", "passes")


@query("n9_repulsion_cost", v.sql("SELECT r, c, round(pow(1.5, h), 4) AS power, round(1 + 1.5 / (c + 1), 6) AS linear, round(1 + 1.5 / (c * c + 1), 6) AS square FROM cells", "cells"))
def n9(spark, d):
    how = lambda mode, digits: F.round(n.repulsion_cost(F.col("h") % 50, F.col("c"), mode), digits).alias(mode)
    return v.cells(spark, d).select("r", "c", how("power", 4), how("linear", 6), how("square", 6))


@query("n16_constrained_fill")
def n16(spark, d):
    c = v.cells(spark, d)
    reached = c.filter("h >= 25").select("r", "c", F.col("h").alias("v"))
    network = reached.select("r", "c", F.lit(True).alias("network"))
    return n.constrained_fill(c.join(network, ["r", "c"], "left").fillna({"network": False}), reached, 8)


@query("g5_filter_relations", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#2'")
def g5(spark, d):
    x = v.table(spark, d, "part").withColumnRenamed("p_brand", "cycle_network")
    return g.filter_relations(x, "Brand#2").select("p_partkey", "p_name")


@query("s15_sheet_and_exif", "SELECT o_orderkey, epoch_ms(o_orderdate) + 10800000 AS ms, round_even((CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END) * (o_orderkey % 90 + (o_custkey % 60) / 60.0 + 30 / 3600.0), 6) AS decimal, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE (o_orderkey % 30) * 3600.0 + (o_custkey % 60) * 60 + 7.5 END AS seconds FROM orders")
def s15(spark, d):
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    sheet = _join("Date(", F.year(day), ",", F.month(day) - 1, ",", F.dayofmonth(day), ")")
    clock = F.when(k % 3 == 0, _join(" ", F.col("o_totalprice").cast("decimal(20,2)"), " s")).otherwise(F.format_string("%d:%02d:07.5", k % 30, c % 60))
    decimal = tm.dms_to_decimal(k % 90, c % 60, F.lit(30), F.when(k % 2 == 0, "W").otherwise("N"))
    return v.table(spark, d, "orders").select("o_orderkey", tm.sheet_date_ms(sheet).alias("ms"), decimal.alias("decimal"), tm.clock_or_number_s(clock).alias("seconds"))


@query("s18_minute_round_local", "SELECT event_id, strftime(make_timestamp(CAST(floor((floor(epoch_us(ts) / 1000000.0) + 30) / 60) AS BIGINT) * 60000000 - 10800000000), '%Y-%m-%dT%H:%M:%S') || '-03:00' AS minute FROM events")
def s18(spark, d):
    epoch = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return v.table(spark, d, "events").select("event_id", tm.minute_round_local(epoch).alias("minute"))


FOLDERS, MIMES = ("Mídia 1", "FOTOS", "Vídeos", "video", "Textos", "Fotos velhas"), ("IMAGE/PNG", "image/heif", "image/heic", "text/plain", None, "image/jpeg")


@query("s24_archive_names", "SELECT doc_id, doc_id % 6 < 4 AS media, CASE doc_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'heif' WHEN 2 THEN 'heic' ELSE 'jpg' END AS ext FROM documents")
def s24(spark, d):
    pick = lambda names: F.get(F.array(*[F.lit(x).cast("string") for x in names]), (F.col("doc_id") % 6).cast("int"))
    return v.table(spark, d, "documents").select("doc_id", tx.is_media_folder(pick(FOLDERS)).alias("media"), tx.original_ext(pick(MIMES)).alias("ext"))
