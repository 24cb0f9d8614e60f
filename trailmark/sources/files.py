"""Readers and writers of routes, recordings, sheets, archives and rasters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import activity_url, any_route_id, extract, sheet_value, unescape_xml

ROUTES = "generatedAt string, source string, routes array<struct<tour_iri:string,id:string,provider:string,date:string,dateMs:bigint,name:string,latlngs:array<array<double>>,pois:array<struct<lat:double,lng:double,name:string,sym:string,type:string>>,error:string>>"
SAVED = "routes map<string,struct<name:string,state:struct<v:int,rm:string,n:string,wp:array<array<string>>,sg:array<string>>,points:int,created:string,updated:string>>"
TRIP = "track_points array<struct<t:bigint,y:double,x:double,s:double,p:double>>"
TRACK = "route struct<track_points:array<struct<x:double,y:double,lng:double,lat:double,e:double,elevation:double>>,points_of_interest:array<struct<lat:double,lng:double,name:string,sym:string,type:string>>>"


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """A row per route. A missing file gives none; a malformed one is an error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], ROUTES).select(F.inline("routes"))
    return spark.read.schema(ROUTES).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("routes"))


def read_saved_routes(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """id, name, state, points, created, updated. Lenient: what can't be read counts as empty."""
    raw = spark.read.schema(SAVED).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    return raw.select(F.explode("routes").alias("id", "r")).select("id", "r.*")


def read_census_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Ragged lines without a header: date, title, route and recording found anywhere in the line."""
    return census_rows(spark.read.text(path))


def census_rows(lines: DataFrame) -> DataFrame:
    cells = F.split("value", "\t", -1)
    return lines.select(F.substring(F.get(cells, F.lit(0)), 1, 10).alias("date"), F.get(cells, F.lit(6)).alias("title"), any_route_id(F.col("value")).alias("route"), activity_url(F.col("value")).alias("activity"))


def read_sheet_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    return raw.select(*[sheet_value(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns])


def _attr(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""\b{name}\s*=\s*["']([^"']*)["']""", 1).try_cast("double")


def gpx_points(files: DataFrame) -> DataFrame:
    """files (path, value: the whole text) to (path, seq, lat, lng, ele); points that aren't finite go."""
    tags = F.regexp_extract_all("value", F.lit(r"(?s)(<(?:trkpt|rtept)\b[^>]*?(?:/>|>.*?</(?:trkpt|rtept)>))"), 1)
    x = files.select("path", F.posexplode(tags).alias("seq", "tag"))
    ele = extract(F.col("tag"), r"<ele>\s*([^<\s]+)\s*</ele>").try_cast("double")
    out = x.select("path", "seq", _attr(F.col("tag"), "lat").alias("lat"), _attr(F.col("tag"), "lon").alias("lng"), ele.alias("ele"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out.filter(finite("lat") & finite("lng"))


def gpx_pois(files: DataFrame) -> DataFrame:
    tags = F.regexp_extract_all("value", F.lit(r"(?s)(<wpt\b[^>]*?(?:/>|>.*?</wpt>))"), 1)
    x = files.select("path", F.posexplode(tags).alias("seq", "tag"))
    part = lambda n: unescape_xml(extract(F.col("tag"), rf"(?s)<{n}>\s*(.*?)\s*</{n}>"))
    return x.select("path", "seq", F.bround(_attr(F.col("tag"), "lat"), 5).alias("lat"), F.bround(_attr(F.col("tag"), "lon"), 5).alias("lng"), part("name").alias("name"), part("sym").alias("sym"), part("type").alias("type")).filter("lat is not null and lng is not null")


def track_points_from_json(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (id, value) to points (id, seq, lat, lng, ele) and places (id, lat, lng, name, sym, type)."""
    x = rows.select("id", F.from_json("value", TRACK)["route"].alias("r"))
    p = x.select("id", F.posexplode("r.track_points").alias("seq", "p")).select("id", "seq", F.coalesce("p.y", "p.lat").alias("lat"), F.coalesce("p.x", "p.lng").alias("lng"), F.coalesce("p.e", "p.elevation").alias("ele")).filter("lat is not null and lng is not null")
    return p, x.select("id", F.inline("r.points_of_interest"))


def trip_points(rows: DataFrame) -> DataFrame:
    """rows (trip, value) to (trip, seq, t, lat, lng, speed, power): places are carried forward, what comes before
    the first is dropped, missing speed is 0 and missing power stays null for the caller to decide."""
    x = rows.select("trip", F.posexplode(F.from_json("value", TRIP)["track_points"]).alias("seq", "p")).select("trip", "seq", F.col("p.t").alias("t"), "p.y", "p.x", "p.s", "p.p")
    w = Window.partitionBy("trip").orderBy("seq")
    return x.select("trip", "seq", "t", F.last("y", ignorenulls=True).over(w).alias("lat"), F.last("x", ignorenulls=True).over(w).alias("lng"), F.coalesce("s", F.lit(0.0)).alias("speed"), F.col("p").alias("power")).filter("lat is not null and lng is not null and t is not null")


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder, subfolder, name, ext, length, mtime) of all files but hidden ones; contents aren't read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("mtime"))
    # One leading part of every path is the root itself, whatever the scheme.
    rel = F.regexp_replace(F.col("path"), rf"^.*?{root.split('://')[-1].rstrip('/')}/", "")
    parts = F.split(rel, "/")
    name = F.element_at(parts, -1)
    return x.select("path", F.when(F.size(parts) > 1, parts[0]).alias("folder"), F.when(F.size(parts) > 2, F.element_at(parts, -2)).alias("subfolder"), name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), "length", "mtime").filter(~F.col("name").startswith("."))


def decode_polyline(text: Column) -> Column:
    """Encoded points as array<struct<lat,lng>>; null if corrupt, of fewer than two points or out of range.

    A number is a run of characters from `_` up and one below it. Sums run within blocks of about the root of
    the number of points, and then over blocks, since an array can't grow without being copied.
    """
    zero = F.lit(0).cast("long")
    # A lambda's argument is computed once, an expression that is used again isn't.
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def number(run: Column) -> Column:
        five = lambda k: (F.ascii(F.substr(run, k + 1, F.lit(1))) - 63).bitwiseAND(F.lit(31)).cast("long")
        bits = F.aggregate(F.sequence(F.lit(0), F.length(run) - 1), zero, lambda a, k: a + F.call_function("shiftleft", five(k), 5 * k))
        return once(bits, lambda x: F.when(x.bitwiseAND(F.lit(1)) == 1, -F.shiftright(x, 1) - 1).otherwise(F.shiftright(x, 1)))

    pair = lambda lat, lng: (lat.alias("lat"), lng.alias("lng"))

    def points(nums: Column) -> Column:
        n = F.floor(F.size(nums) / 2).cast("int")
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(n)).cast("int"))
        start = F.struct(*pair(zero, zero), F.array().cast("array<struct<lat:bigint,lng:bigint>>").alias("pts"))

        def add(a: Column, k: Column) -> Column:
            there = F.struct(*pair(a["lat"] + F.get(nums, 2 * k), a["lng"] + F.get(nums, 2 * k + 1)))
            return once(there, lambda p: F.struct(*pair(p["lat"], p["lng"]), F.concat(a["pts"], F.array(p)).alias("pts")))

        block = lambda b: F.aggregate(F.sequence(b * size, F.least(n, (b + 1) * size) - 1), start, add)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), block)
        before = lambda all_, b: F.aggregate(F.slice(all_, F.lit(1), b), F.struct(*pair(zero, zero)), lambda a, x: F.struct(*pair(a["lat"] + x["lat"], a["lng"] + x["lng"])))
        moved = lambda x, o: F.transform(x["pts"], lambda p: F.struct(*pair((p["lat"] + o["lat"]) / 1e5, (p["lng"] + o["lng"]) / 1e5)))
        return once(blocks, lambda all_: F.flatten(F.transform(all_, lambda x, b: once(before(all_, b), lambda o: moved(x, o)))))

    there = lambda pts: F.when(~F.exists(pts, lambda p: (F.abs(p["lat"]) > 90) | (F.abs(p["lng"]) > 180)), pts)
    whole = lambda nums: (F.size(nums) % 2 == 0) & (F.size(nums) >= 4)
    fits = ~text.rlike("[^?-~]") & F.right(text, F.lit(1)).rlike("[?-^]")
    runs = F.regexp_extract_all(text, F.lit("([_-~]*[?-^])"), 1)
    return F.when(fits, once(F.transform(runs, number), lambda nums: F.when(whole(nums), once(points(nums), there))))


def saved_route_geometry(saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """saved (id, state) to points (id, seq, lat, lng) and flagged waypoints (id, lat, lng, name, sym). A leg that
    is missing or corrupt is straight; joints aren't doubled."""
    wp = saved.select("id", F.posexplode("state.wp").alias("k", "w"), F.col("state.sg").alias("sg"))
    num = lambda i: F.get("w", F.lit(i)).try_cast("double")
    wp = wp.select("id", "k", "sg", num(0).alias("lat"), num(1).alias("lng"), F.get("w", F.lit(2)).alias("name"), F.get("w", F.lit(3)).alias("poi"), F.get("w", F.lit(4)).alias("sym"))
    w = Window.partitionBy("id").orderBy("k")
    nxt = F.lead(F.struct("lat", "lng")).over(w)
    leg = F.coalesce(decode_polyline(F.get("sg", F.col("k"))), F.array(F.struct("lat", "lng"), F.col("to")))
    legs = wp.withColumn("to", nxt).filter("to is not null").withColumn("leg", leg)
    pts = legs.select("id", "k", F.posexplode("leg").alias("j", "p")).filter((F.col("k") == 0) | (F.col("j") > 0))
    seq = F.row_number().over(Window.partitionBy("id").orderBy("k", "j")) - 1
    pois = wp.filter(F.col("poi").isin("true", "1")).select("id", "lat", "lng", "name", F.coalesce("sym", F.lit("Flag, Blue")).alias("sym"))
    return pts.select("id", seq.alias("seq"), "p.lat", "p.lng"), pois


def tile_name(lat: Column, lng: Column) -> Column:
    """The name of a whole-degree tile."""
    la, lo = F.floor(lat), F.floor(lng)
    return F.concat(F.when(la < 0, "S").otherwise("N"), F.lpad(F.abs(la).cast("string"), 2, "0"), F.when(lo < 0, "W").otherwise("E"), F.lpad(F.abs(lo).cast("string"), 3, "0"))


CELLS_A_FILE = 2_000_000


def write_cells(cells: DataFrame, path: str, per_file: int = CELLS_A_FILE) -> None:
    """cells (lat, lng, ...) as a table partitioned by whole-degree tile, for read_dem_cells(). Files hold `per_file`
    cells at most, in the order of places, so that a reader's box also skips row groups within a tile. A tile's cells
    are dealt to as many tasks as it fills files, by bands of latitude."""
    placed = cells.withColumn("tile", tile_name(F.col("lat"), F.col("lng")))
    per_tile = placed.groupBy("tile").agg(F.ceil(F.count("*") / per_file).alias("__bands"))
    band = F.floor((F.col("lat") - F.floor("lat")) * F.col("__bands"))
    dealt = placed.join(per_tile, "tile").withColumn("__band", band).repartition("tile", "__band").sortWithinPartitions("tile", "lat", "lng")
    dealt.drop("__bands", "__band").write.mode("overwrite").option("maxRecordsPerFile", per_file).partitionBy("tile").parquet(path)


def read_dem_cells(spark: SparkSession, path: str, south: float, west: float, north: float, east: float) -> DataFrame:
    """Cells of a table of write_cells() within a box: only the tiles that it touches are read."""
    las, los = range(math.floor(south), math.floor(north) + 1), range(math.floor(west), math.floor(east) + 1)
    tiles = [f"{'S' if a < 0 else 'N'}{abs(a):02d}{'W' if o < 0 else 'E'}{abs(o):03d}" for a in las for o in los]
    return spark.read.parquet(path).filter(F.col("tile").isin(*tiles)).filter(F.col("lat").between(south, north) & F.col("lng").between(west, east))


def read_network_lines(lines: DataFrame, south: float, west: float, north: float, east: float) -> tuple[DataFrame, DataFrame]:
    """lines (id, parts: array<array<struct<lat,lng>>>, bridge, tunnel, layer and its box s, w, n, e): vertices (line,
    seq, lat, lng) and line data of those that touch the box; parts of fewer than two points go."""
    hit = lines.filter((F.col("s") <= north) & (F.col("n") >= south) & (F.col("w") <= east) & (F.col("e") >= west))
    parts = hit.select("id", "bridge", "tunnel", "layer", F.posexplode("parts").alias("k", "pts")).filter(F.size("pts") >= 2).withColumn("line", F.concat_ws("/", "id", "k"))
    deck = (F.coalesce("bridge", F.lit("no")) != "no") | (F.coalesce("tunnel", F.lit("no")) != "no")
    return parts.select("line", F.posexplode("pts").alias("seq", "p")).select("line", "seq", "p.lat", "p.lng"), parts.select("line", deck.alias("deck"), F.coalesce("layer", F.lit(0)).alias("layer"))


def write_routes(routes: DataFrame, path: str) -> None:
    """The newest first; Spark keeps the order across the files by their names."""
    routes.orderBy(F.coalesce("date_ms", F.lit(0)).desc(), "tour_iri").write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("overwrite").format(kind).save(path)
