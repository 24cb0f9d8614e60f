"""Queries over stored forms: the given tables written as files or tables, in the folder that all tasks share, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import roads as g
from ..operators import rules
from ..scratch import shared_dir
from ..sources import facts as fa
from ..sources import files as fi
from ..streaming import live
from . import views as v
from .reading import _join
from .registry import query


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


DUMPS = "http://rdfs.org/ns/void#dataDump"


@query("a2_read_manifest_union", v.sql("SELECT DISTINCT dump, s, p, o, o_kind, o_dtype FROM facts WHERE dump <> 'nations'", "facts"))
def a2(spark, d):
    """A folder of N-Triples per dump; the manifest names two of three, and one that is missing."""
    x, base = v.facts(spark, d), folder(spark, "dumps")
    literal = F.when(F.col("o_dtype") == "xsd:string", _join('"', F.col("o"), '"')).otherwise(_join('"', F.col("o"), '"^^<', F.col("o_dtype"), ">"))
    o = F.when(F.col("o_kind") == "iri", _join("<", F.col("o"), ">")).otherwise(literal)
    x.select("dump", _join("<", F.col("s"), "> <", F.col("p"), "> ", o, " .").alias("value")).write.partitionBy("dump").text(base)
    named = [f"{base}/dump={n}" for n in ("orders", "customers", "gone")]
    manifest = spark.createDataFrame([("m", DUMPS, n) for n in named] + [("m", "other", f"{base}/dump=nations")], "s string, p string, o string")
    read = fa.read_manifest_union(spark, manifest, [f"{base}/dump=nations"])
    return read.select(F.when(F.col("s").startswith("order/"), "orders").otherwise("customers").alias("dump"), "s", "p", "o", "o_kind", "o_dtype")


def documents_of(rows, key, per, value, path):
    """One JSON document for so many keys, each a file of its own."""
    grouped = rows.groupBy(F.floor(F.col(key) / per).alias("doc")).agg(value)
    grouped.repartition("doc").write.partitionBy("doc").text(path)


@query("a5_read_routes", "SELECT 'customer/' || c_custkey AS tour_iri, CAST(c_nationkey AS VARCHAR) AS id, c_name AS name, 2 AS points, -c_custkey / 8.0 AS lng, CASE WHEN c_nationkey > 3 THEN 'a \"b\"' END AS poi FROM customer")
def a5(spark, d):
    c, path = v.table(spark, d, "customer"), folder(spark, "routes")
    k = F.col("c_custkey")
    none = F.array().cast("array<struct<lat:double,lng:double,name:string,sym:string>>")
    place = F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"), F.lit('a "b"').alias("name"), F.lit("Pin").alias("sym"))
    route = F.struct(_join("customer/", k).alias("tour_iri"), F.col("c_nationkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.array(F.array(F.lit(0.5), -k / 8.0), F.array(F.lit(1.5), k / 8.0)).alias("latlngs"), F.when(F.col("c_nationkey") > 3, F.array(place)).otherwise(none).alias("pois"))
    documents_of(c.select("c_custkey", route.alias("r")), "c_custkey", 500, F.to_json(F.struct(F.lit("now").alias("generatedAt"), F.collect_list("r").alias("routes"))).alias("value"), path)
    read = fi.read_routes(spark, path)
    lng = F.get(F.get("latlngs", F.lit(0)), F.lit(1))
    return read.select("tour_iri", "id", "name", F.size("latlngs").alias("points"), lng.alias("lng"), F.get("pois", F.lit(0))["name"].alias("poi"))


@query("a6_read_saved_routes", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS INT) AS points, CAST(c_custkey / 8.0 AS VARCHAR) AS lat, '2025' AS created FROM customer")
def a6(spark, d):
    c, path = v.table(spark, d, "customer"), folder(spark, "saved")
    wp = F.array(F.array((F.col("c_custkey") / 8.0).cast("string"), F.lit("2")))
    saved = F.struct(F.col("c_name").alias("name"), F.struct(F.lit(1).alias("v"), wp.alias("wp")).alias("state"), F.col("c_nationkey").alias("points"), F.lit("2025").alias("created"))
    entry = F.struct(F.col("c_custkey").cast("string").alias("key"), saved.alias("value"))
    documents_of(c.select("c_custkey", entry.alias("e")), "c_custkey", 500, F.to_json(F.struct(F.map_from_entries(F.collect_list("e")).alias("routes"))).alias("value"), path)
    return fi.read_saved_routes(spark, path).select("id", "name", "points", F.get(F.get("state.wp", F.lit(0)), F.lit(0)).alias("lat"), "created")


@query("a8_read_sheet_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey + 1000 AS VARCHAR) END AS number, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE o_orderpriority END AS title FROM orders")
def a8(spark, d):
    k, path = F.col("o_orderkey"), folder(spark, "sheet")
    number = F.when(k % 5 == 0, "#DIV/0!").otherwise(F.format_number(F.col("o_custkey") + 1000, 0))
    title = F.when(k % 3 == 0, F.element_at(F.array(*map(F.lit, ("-", "n/a", "?", "sumiu"))), (k % 4 + 1).cast("int"))).otherwise(_join(" ", F.col("o_orderpriority"), " "))
    x = v.table(spark, d, "orders").select(k.cast("string").alias("key"), number.alias(" number"), title.alias("title "))
    x.write.option("sep", "\t").option("header", True).csv(path)
    return fi.read_sheet_csv(spark, path)


@query("a13_file_inventory", "SELECT 'lang=' || lang AS folder, 'source=' || source AS subfolder, 'txt' AS ext, count(*) > 0 AS some, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source")
def a13(spark, d):
    """Documents as text files by language and source; hidden files beside them don't count."""
    path = folder(spark, "archive")
    docs = v.table(spark, d, "documents").filter("lang is not null and source is not null").select("lang", "source", F.coalesce("text", F.lit("")).alias("value"))
    docs.write.partitionBy("lang", "source").text(path)
    found = fi.file_inventory(spark, path)
    return found.groupBy("folder", "subfolder", "ext").agg((F.count("*") > 0).alias("some"), F.sum("length").alias("bytes"))


BOX = (-23.4, -46.6, -21.6, -44.3)
GRID = "SELECT event_id AS id, -23.7 + ((event_id * 7919) % 3000) / 1e3 AS lat, -46.8 + ((event_id * 104729) % 3000) / 1e3 AS lng, value AS h FROM events"


@query("a16_read_dem_cells", f"SELECT id, lat, lng, h FROM ({GRID}) WHERE lat BETWEEN {BOX[0]} AND {BOX[2]} AND lng BETWEEN {BOX[1]} AND {BOX[3]}")
def a16(spark, d):
    """Events as cells over nine tiles and more, stored by tile; a box that touches two of them."""
    path, k = folder(spark, "cells"), F.col("event_id")
    cells = v.table(spark, d, "events").select(k.alias("id"), (F.lit(-23.7) + (k * 7919) % 3000 / 1e3).alias("lat"), (F.lit(-46.8) + (k * 104729) % 3000 / 1e3).alias("lng"), F.col("value").alias("h"))
    fi.write_cells(cells, path)
    return fi.read_dem_cells(spark, path, *BOX).select("id", "lat", "lng", "h")


@query("a17_read_network_lines", v.sql("SELECT r || '-' || c || '/0' AS line, CAST(k AS INT) AS seq, CAST(r + k * 0.5 AS DOUBLE) AS lat, CAST(c AS DOUBLE) AS lng, h > 25 AS deck, CASE WHEN h > 40 THEN CAST(h AS INT) ELSE 0 END AS layer FROM cells, range(2) AS x(k) WHERE r <= 60 AND r + 0.5 >= 20", "cells"))
def a17(spark, d):
    """Cells as lines of two parts, of which the second is a point."""
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    at = lambda a, b: F.struct(a.alias("lat"), b.alias("lng"))
    lines = v.cells(spark, d).select(F.concat_ws("-", "r", "c").alias("id"), F.array(F.array(at(r, c), at(r + 0.5, c)), F.array(at(r, c))).alias("parts"), F.when(F.col("h") > 25, "yes").alias("bridge"), F.lit(None).cast("string").alias("tunnel"), F.when(F.col("h") > 40, F.col("h").cast("int")).alias("layer"), r.alias("s"), c.alias("w"), (r + 0.5).alias("n"), c.alias("e"))
    vertices, data = fi.read_network_lines(lines, 20.0, -1e9, 60.0, 1e9)
    return vertices.join(data, "line")


@query("a18_write_routes", "SELECT 'order/' || o_orderkey AS tour_iri, CASE WHEN o_orderkey % 7 > 0 THEN epoch_ms(o_orderdate) END AS date_ms, o_orderpriority AS name FROM orders")
def a18(spark, d):
    """Routes written newest first, and read again."""
    path = folder(spark, "written")
    routes = v.table(spark, d, "orders").select(_join("order/", F.col("o_orderkey")).alias("tour_iri"), F.when(F.col("o_orderkey") % 7 > 0, F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("date_ms"), F.col("o_orderpriority").alias("name"))
    fi.write_routes(routes, path)
    return spark.read.schema("tour_iri string, date_ms long, name string").json(path)


@query("a19_write_report", "SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def a19(spark, d):
    path = folder(spark, "report")
    fi.write_report(v.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")), path)
    return spark.read.schema("status string, n long, keys long").json(path)


FLAWED = ", ".join(f"'{x}'" for x in rules.FLAWS)


@query("d17_generate_fixtures", f"WITH n AS (SELECT (SELECT count(*) FROM orders) AS good, (SELECT count(*) FROM customer) AS bad), x AS (SELECT unnest(range(good + bad)) AS k, good FROM n) SELECT CASE WHEN k >= good THEN [{FLAWED}][(k - good) % {len(rules.FLAWS)} + 1] END AS flaw, count(*) AS docs, CAST(sum(k) AS BIGINT) AS numbers FROM x GROUP BY 1")
def d17(spark, d):
    """As many valid documents as orders, as many invalid ones as customers; with their flaws."""
    made = rules.generate_fixtures(spark, v.table(spark, d, "orders").count(), v.table(spark, d, "customer").count())
    docs = made.select("doc", "flaw").distinct()
    return docs.groupBy("flaw").agg(F.count("*").alias("docs"), F.sum(F.substring_index("doc", "/", -1).cast("long")).alias("numbers"))


@query("f8_equirect_m", v.sql("SELECT trip, seq, round(sqrt(pow((lat2 - lat) * 111320, 2) + pow((lng2 - lng) * 111320 * cos(radians((lat + lat2) / 2)), 2)), 3) AS m FROM (SELECT *, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2 FROM fixes WINDOW w AS (PARTITION BY trip ORDER BY seq)) WHERE lat2 IS NOT NULL", "fixes"))
def f8(spark, d):
    w = Window.partitionBy("trip").orderBy("seq")
    x = v.fixes(spark, d).withColumns({"lat2": F.lead("lat").over(w), "lng2": F.lead("lng").over(w)}).filter("lat2 is not null")
    return x.select("trip", "seq", F.round(geo.equirect_m(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")), 3).alias("m"))


@query("g12_deck_chains", v.sql("""WITH x AS (SELECT trip, seq, seq // 20 AS g, floor(d) + 1 AS len, pp AS ha, power AS hb FROM steps WHERE pp IS NOT NULL AND seq % 20 > 0),
  y AS (SELECT *, sum(len) OVER w AS upto, sum(len) OVER p AS whole, first_value(ha) OVER w AS a, last_value(hb) OVER (PARTITION BY trip, g ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b, trip % 5 = 0 AND max(seq) OVER p % 20 = 19 AS ring FROM x WINDOW w AS (PARTITION BY trip, g ORDER BY seq), p AS (PARTITION BY trip, g))
  SELECT trip, seq, round(CASE WHEN ring THEN ha ELSE a + (b - a) * (upto - len) / whole END, 3) AS h0, round(CASE WHEN ring THEN hb ELSE a + (b - a) * upto / whole END, 3) AS h1 FROM y""", "steps"))
def g12(spark, d):
    """Steps between fixes as decks, in chains of up to nineteen; those of every fifth trip close into rings."""
    w = Window.partitionBy("trip").orderBy("seq")
    x = v.fixes(spark, d).select("trip", "seq", F.col("power").alias("hb"), F.lag("power").over(w).alias("ha"), geo.haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")).alias("d"))
    x = x.filter("ha is not null and seq % 20 > 0")
    first = F.greatest(F.col("seq") - 19, F.lit(1))
    b = F.when((F.col("trip") % 5 == 0) & (F.col("seq") % 20 == 19), first).otherwise(F.col("seq"))
    decks = x.select(F.concat_ws("/", "trip", "seq").alias("line"), (F.col("trip") % 2).cast("int").alias("layer"), F.concat_ws("/", "trip", F.col("seq") - 1).alias("a"), F.concat_ws("/", F.col("trip"), b).alias("b"), (F.floor("d") + 1).cast("double").alias("len"), "ha", "hb")
    part = F.split("line", "/")
    return g.deck_chains(decks).select(part[0].cast("long").alias("trip"), part[1].cast("long").alias("seq"), F.round("h0", 3).alias("h0"), F.round("h1", 3).alias("h1"))


BAKED = v.sql("""WITH k AS (SELECT trip, seq, lat, lng, CAST(floor(lat / 1e-6 + 0.5) AS BIGINT) AS i, CAST(floor(lng / 1e-6 + 0.5) AS BIGINT) AS j FROM fixes), e AS (SELECT *, lead(i) OVER w AS i2, lead(j) OVER w AS j2, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2 FROM k WINDOW w AS (PARTITION BY trip ORDER BY seq)),
  o AS (SELECT *, (i, j) < (i2, j2) AS up, sqrt(pow((lat2 - lat) * 111320, 2) + pow((lng2 - lng) * 111320 * cos(radians((lat + lat2) / 2)), 2)) AS m FROM e WHERE i2 IS NOT NULL AND (i <> i2 OR j <> j2)),
  p AS (SELECT CASE WHEN up THEN i ELSE i2 END AS ai, CASE WHEN up THEN j ELSE j2 END AS aj, CASE WHEN up THEN i2 ELSE i END AS bi, CASE WHEN up THEN j2 ELSE j END AS bj, trip, seq, CAST(least(65535, round_even(m * 10, 0)) AS INT) AS len_dm FROM o)
  SELECT ai, aj, bi, bj, len_dm, trip % 2 = 0 AS deck FROM (SELECT *, row_number() OVER (PARTITION BY ai, aj, bi, bj ORDER BY trip, seq) AS n FROM p) WHERE n = 1""", "fixes")


@query("g16b_baked_edges", BAKED)
def g16b(spark, d):
    x = v.fixes(spark, d)
    lines = x.select(F.col("trip").alias("line"), "seq", "lat", "lng", (F.col("trip") % 2 == 0).alias("deck"))
    edges = g.bake_graph(lines, x.select(F.col("trip").alias("line"), "seq", F.col("power").alias("h")))[1]
    return edges.select(*[F.col(f"{e}.{k}").alias(e + k) for e in "ab" for k in "ij"], "len_dm", "deck")


@query("l4_last_points", v.sql("SELECT lower(to_hex(trip)) AS id, seq FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY seq DESC) AS n FROM fixes) WHERE n <= 25", "fixes"))
def l4(spark, d):
    """The newest points of each token, by number."""
    x = v.fixes(spark, d).select(F.lower(F.hex("trip")).alias("id"), F.col("seq").alias("at"))
    return live.last_points(x, 25).select("id", F.col("at").alias("seq"))
