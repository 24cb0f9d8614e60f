"""Queries that match records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import matching as m
from ..operators import reports as rep
from . import views as v
from .registry import query

ASOF = """SELECT m, tour FROM (SELECT a.event_id AS m, b.event_id AS tour, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.s - b.s), b.s, b.event_id) AS n
  FROM (SELECT *, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS s FROM events WHERE event_type = 'view') a JOIN (SELECT *, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS s FROM events WHERE event_type = 'purchase') b ON a.s - b.s BETWEEN -7200 AND 43200) WHERE n = 1"""


@query("e1_asof_tour", ASOF)
def e1(spark, d):
    e = v.table(spark, d, "events")
    return m.asof_tour(e.filter("event_type = 'view'").select(F.col("event_id").alias("m"), "ts"), e.filter("event_type = 'purchase'").select(F.col("event_id").alias("tour"), "ts"))


@query("e2_match_folders")
def e2(spark, d):
    o = v.table(spark, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    folders = o.filter("o_orderstatus = 'F'").select(F.concat_ws(" ", F.col("date").cast("string"), F.col("o_orderkey").cast("string")).alias("name"), "date", (F.col("o_custkey") % 9).cast("int").alias("number"))
    tours = o.filter("o_orderstatus = 'O'").select(F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("tour"), "date", (F.col("o_custkey") % 9).cast("int").alias("seq"))
    return m.match_folders(folders, tours)


@query("e3_match_census", """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_custkey AS route, o_orderpriority = '1-URGENT' AS act, o_orderstatus AS kind FROM orders), c AS (SELECT * FROM o WHERE kind = 'F'), t AS (SELECT * FROM o WHERE kind = 'O'),
  r AS (SELECT c.k, count(*) AS nr, min(t.k) AS r1, count(*) FILTER (abs(t.day - c.day) <= 1) AS nn, min(t.k) FILTER (abs(t.day - c.day) <= 1) AS r2 FROM c JOIN t USING (route) GROUP BY c.k),
  d AS (SELECT c.k, count(*) FILTER (t.day = c.day) AS n0, min(t.k) FILTER (t.day = c.day) AS d0, count(*) FILTER (t.day <> c.day) AS n1, min(t.k) FILTER (t.day <> c.day) AS d1 FROM c JOIN t ON abs(t.day - c.day) <= 1 GROUP BY c.k),
  h AS (SELECT c.k AS id, CASE WHEN nr = 1 THEN 'route' WHEN nn = 1 THEN 'route+date' WHEN n0 = 1 THEN 'date' WHEN n0 > 1 THEN 'two tours on that date' WHEN n1 = 1 THEN 'date+-1' WHEN coalesce(n1, 0) = 0 THEN 'no tour' ELSE 'ambiguous within a day' END AS how,
    CASE WHEN nr = 1 THEN r1 WHEN nn = 1 THEN r2 WHEN n0 = 1 THEN d0 WHEN n0 > 1 THEN NULL WHEN n1 = 1 THEN d1 END AS tour FROM c LEFT JOIN r USING (k) LEFT JOIN d USING (k)),
  n AS (SELECT h.*, act, CASE WHEN tour IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY tour ORDER BY id) END AS n FROM h LEFT JOIN t ON t.k = tour)
  SELECT id AS "row", CASE WHEN n = 1 THEN tour END AS tour, CASE WHEN n > 1 THEN 'taken' WHEN act THEN 'skipped' ELSE how END AS how FROM n""")
def e3(spark, d):
    o = v.table(spark, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    census = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("row"), "date", F.col("o_custkey").alias("route"))
    tours = o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("tour"), "date", F.col("o_custkey").alias("route"), (F.col("o_orderpriority") == "1-URGENT").alias("has_activity"))
    return m.match_census(census, tours)


TRIPS = """trips AS (SELECT trip || '/' || CAST(day AS VARCHAR) AS trip, min(ts) AS departed, sum(value) AS distance, min(lat) AS sw_lat, min(lng) AS sw_lng, max(lat) AS ne_lat, max(lng) AS ne_lng
  FROM (SELECT user_id AS trip, CAST(ts AS DATE) AS day, ts, floor(value * 100) AS value, ((event_id * 7919) % 3000) / 1e4 AS lat, ((event_id * 104729) % 3000) / 1e4 AS lng FROM events) GROUP BY trip, day),
  rides AS (SELECT event_id AS tour, CAST(ts AS DATE) AS date, ((event_id * 7919) % 3000) / 1e4 AS lat, ((event_id * 104729) % 3000) / 1e4 AS lng, floor(value * 100) AS dist_m FROM events WHERE event_type = 'purchase')"""
CAND = f"""WITH {TRIPS}, cand AS (SELECT DISTINCT tour, trip, r.lat - t.sw_lat AS a, t.ne_lat - r.lat AS b FROM rides r JOIN trips t ON (r.date = CAST(t.departed AS DATE) OR (hour(t.departed) < 4 AND r.date = CAST(t.departed AS DATE) - 1))
  WHERE (NOT (ne_lat > sw_lat AND ne_lng > sw_lng) OR (lat BETWEEN sw_lat - 0.003 AND ne_lat + 0.003 AND lng BETWEEN sw_lng - 0.003 AND ne_lng + 0.003)) AND distance >= 0.9 * dist_m)"""


def trips(spark, d):
    e = v.table(spark, d, "events")
    at = {"lat": ((F.col("event_id") * 7919) % 3000) / 1e4, "lng": ((F.col("event_id") * 104729) % 3000) / 1e4, "day": F.to_date("ts"), "value": F.floor(F.col("value") * 100)}
    e = e.withColumns(at)
    t = e.groupBy("user_id", "day").agg(F.min("ts").alias("departed"), F.sum("value").alias("distance"), F.min("lat").alias("sw_lat"), F.min("lng").alias("sw_lng"), F.max("lat").alias("ne_lat"), F.max("lng").alias("ne_lng")).withColumn("trip", F.concat_ws("/", "user_id", "day"))
    p = e.filter("event_type = 'purchase'").withColumnRenamed("event_id", "tour")
    return p.select("tour", F.col("day").alias("date")), p.select("tour", "lat", "lng", F.col("value").alias("dist_m")), t


@query("e4_trip_candidates", CAND + " SELECT tour, trip FROM cand")
def e4(spark, d):
    return m.trip_candidates(*trips(spark, d))


@query("e5_best_trip", CAND + """, s AS (SELECT tour, trip, floor(abs(a) * 3000) AS d_start, floor(abs(b) * 3000) AS d_end FROM cand), x AS (SELECT *, d_start + d_end AS score, row_number() OVER w AS n, lead(d_start + d_end) OVER w AS nxt FROM s WHERE d_start <= 400 WINDOW w AS (PARTITION BY tour ORDER BY d_start + d_end, trip))
  SELECT tour, trip, CASE WHEN nxt < 2 * score + 100 THEN 'baixa' WHEN d_end > 400 THEN 'media' WHEN d_start <= 150 AND d_end <= 150 THEN 'alta' ELSE 'media' END AS confidence FROM x WHERE n = 1""")
def e5(spark, d):
    return m.best_trip(m.closest_trips(*trips(spark, d), scale=3000.0, most=400.0)).select("tour", "trip", "confidence")


def _matches(spark, d):
    e = v.table(spark, d, "events")
    k = F.col("event_id")
    return e.select(k.alias("tour"), (k % 2 == 0).alias("has_link"), F.when(k % 3 == 0, 1).alias("departed_at"), F.when(k % 5 == 0, 1).alias("arrived_at"), F.lit(None).cast("int").alias("moving_s"), F.when(k % 7 == 0, 100.0).alias("energy"), (F.col("value") * 20).alias("duration_s"), (F.col("value") * 10).alias("d_arrival"), (k % 4 != 0).alias("by_stop"), F.lit(150.0).alias("new_energy"), F.when(k % 11 == 0, "baixa").otherwise("alta").alias("confidence"))


@query("e6_fields_to_write", "SELECT f.field AS field, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN event_id % 2 <> 0 THEN 'link' END, CASE WHEN value * 20 >= 900 AND event_id % 3 <> 0 THEN 'departed_at' END, CASE WHEN value * 20 >= 900 AND value * 10 <= 500 AND event_id % 5 <> 0 THEN 'arrived_at' END, CASE WHEN value * 20 >= 900 AND value * 10 <= 500 THEN 'moving_s' END, CASE WHEN value * 20 >= 900 AND value * 10 <= 500 AND event_id % 7 <> 0 THEN 'energy' END], lambda x: x IS NOT NULL)) AS field FROM events) f GROUP BY 1")
def e6(spark, d):
    return m.fields_to_write(_matches(spark, d)).select(F.explode("fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@query("e7_review_flags", "SELECT f.reason AS reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN event_id % 11 = 0 THEN 'low confidence' END, CASE WHEN value * 20 < 900 THEN 'implausibly short' END, CASE WHEN value * 10 > 500 THEN 'arrival far from the route''s end' END, CASE WHEN event_id % 4 = 0 THEN 'departure without a stop' END, CASE WHEN event_id % 7 = 0 THEN 'energy differs' END], lambda x: x IS NOT NULL)) AS reason FROM events) f GROUP BY 1")
def e7(spark, d):
    return m.review_flags(_matches(spark, d)).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("e8_resolve_handles", """WITH k AS (SELECT lower(c_mktsegment) AS k, 'customer/' || c_custkey AS iri, 0 AS rank FROM customer WHERE c_acctbal < 5000 UNION ALL SELECT lower(replace(c_name, '#', '')), 'customer/' || c_custkey, 2 FROM customer),
  b AS (SELECT k, rank, CASE WHEN rank = 0 THEN max(iri) ELSE min(iri) END AS iri FROM k GROUP BY k, rank), r AS (SELECT k, arg_min(iri, rank) AS person FROM b GROUP BY k)
  SELECT handle, person FROM (SELECT c_name AS handle, lower(replace(c_name, '#', '')) AS k FROM customer UNION ALL SELECT DISTINCT c_mktsegment, lower(c_mktsegment) FROM customer UNION ALL SELECT 'Nobody', 'nobody') LEFT JOIN r USING (k)""")
def e8(spark, d):
    c = v.table(spark, d, "customer")
    people = c.select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("iri"), F.when(F.col("c_acctbal") < 5000, F.array("c_mktsegment")).alias("alt_names"), F.lit(None).cast("string").alias("instagram"), F.col("c_name").alias("name"))
    handles = c.select(F.col("c_name").alias("handle")).union(c.select("c_mktsegment").distinct()).union(spark.createDataFrame([("Nobody",)], "handle string"))
    return m.resolve_handles(handles, people)


def handles(spark, d):
    w = F.split(F.lower("text"), "[^a-z]+")
    return v.table(spark, d, "documents").select(F.get(w, F.lit(0)).alias("a"), F.get(w, F.lit(1)).alias("b")).select(F.explode(F.array("a", "b")).alias("handle")).filter("handle is not null and handle != ''").distinct()


@query("e9_near_duplicate_handles", """WITH w AS (SELECT string_split_regex(lower(text), '[^a-z]+') AS w FROM documents), h AS (SELECT DISTINCT h FROM (SELECT w[1] AS h FROM w UNION ALL SELECT w[2] FROM w) WHERE h IS NOT NULL AND h <> '')
  SELECT x.h AS a, y.h AS b FROM h x JOIN h y ON x.h < y.h WHERE (length(x.h) >= 5 AND length(y.h) >= 5 AND abs(length(x.h) - length(y.h)) <= 1 AND levenshtein(x.h, y.h) <= 1) OR (length(x.h) >= 3 AND length(y.h) >= 3 AND (starts_with(y.h, x.h) OR starts_with(x.h, y.h)))""")
def e9(spark, d):
    return m.near_duplicate_handles(handles(spark, d))


HASHES = """h AS (SELECT doc_id AS row, lang AS kind, substr(md5(coalesce(text, '')), 1, 15) || CASE WHEN doc_id % 3 = 0 THEN '0' ELSE substr(md5(coalesce(text, '')), 16, 1) END AS hash FROM documents)"""


def hashes(spark, d):
    """Digests of the texts, of every third document with other last bits, so that copies are near ones."""
    md5 = F.md5(F.coalesce("text", F.lit("")))
    x = F.concat(F.substring(md5, 1, 15), F.when(F.col("doc_id") % 3 == 0, "0").otherwise(F.substring(md5, 16, 1)))
    return v.table(spark, d, "documents").select(F.col("doc_id").alias("row"), F.col("lang").alias("kind"), x.alias("hash"))


@query("e10_hamming_dedup", f"""WITH {HASHES}, n AS (SELECT *, ('0x' || substr(hash, 1, 8))::BIGINT AS a, ('0x' || substr(hash, 9, 8))::BIGINT AS b FROM h),
  p AS (SELECT x.row, y.row AS other FROM n x JOIN n y ON x.kind = y.kind AND bit_count(xor(x.a, y.a)) + bit_count(xor(x.b, y.b)) <= 5),
  k AS (SELECT row, min('label/' || other) AS id FROM p JOIN labels ON doc_id = other GROUP BY row), e AS (SELECT row, min(other) AS first FROM p WHERE other < row GROUP BY row)
  SELECT h.row, coalesce(id, CAST(first AS VARCHAR)) AS dup_of FROM h LEFT JOIN k ON k.row = h.row LEFT JOIN e ON e.row = h.row""")
def e10(spark, d):
    """The labelled documents are the known ones."""
    h = hashes(spark, d)
    known = h.join(v.table(spark, d, "labels").select(F.col("doc_id").alias("row")).distinct(), "row")
    return m.hamming_dedup(h, known.select(F.concat(F.lit("label/"), F.col("row").cast("string")).alias("id"), "kind", "hash"))


def pixels(spark, d):
    """Pages as pictures of 40 by 40: three bytes of a digest of page and place."""
    p = v.table(spark, d, "pages").select(F.col("page_id").alias("img"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("r")).select("img", "r", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("c"))
    tone = lambda k: ((F.col("img") * (k + 3) + F.col("r") * (7 + k) + F.col("c") * F.col("c")) % 256).cast("double")
    return p.select("img", "r", "c", tone(0).alias("red"), tone(1).alias("green"), tone(2).alias("blue"))


@query("e11_phash")
def e11(spark, d):
    return m.phash(m.luma(pixels(spark, d)))


@query("e13_enrich_ingest", v.sql("SELECT CASE WHEN doc_id % 5 = 0 THEN 'no_gps' WHEN doc_id % 4 <> 0 THEN 'unsupported' WHEN doc_id % 7 = 0 THEN 'duplicate' WHEN lang <> 'en' THEN 'no_person' WHEN source = 'src0' THEN 'no_tour' ELSE 'ready' END AS bucket, count(*) AS n FROM documents GROUP BY 1"))
def e13(spark, d):
    x = v.table(spark, d, "documents")
    p = F.col("doc_id").alias("path")
    files = x.select(p, F.col("source").alias("folder"), F.col("lang").alias("handle"), F.when(F.col("doc_id") % 4 == 0, "image").otherwise("video").alias("kind"))
    folders = x.select(F.col("source").alias("folder")).distinct().filter("folder != 'src0'").withColumn("tour", F.concat(F.lit("t/"), "folder"))
    people = spark.createDataFrame([("en", "person/en")], "handle string, person string")
    out = m.enrich_ingest(files, folders, people, x.filter("doc_id % 5 != 0").select(p, F.lit(1.0).alias("lat"), F.lit(1.0).alias("lng")), x.filter("doc_id % 7 = 0").select(p, F.lit("x").alias("dup_of")))
    return rep.ingest_report(out).select("bucket", "n")


@query("e14_tour_media_count", "SELECT 'customer/' || o_custkey AS tour, count(*) AS n FROM orders GROUP BY 1")
def e14(spark, d):
    return m.tour_media_count(v.facts(spark, d), "customer")


@query("e15_folder_to_ride", "SELECT strftime(o_orderdate, '%Y-%m-%d') || ' PH ' || o_custkey || ' - ' || o_orderpriority AS name, 'PH ' || o_custkey AS code FROM orders")
def e15(spark, d):
    f = v.table(spark, d, "orders").select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" PH "), F.col("o_custkey").cast("string"), F.lit(" - "), "o_orderpriority").alias("name"))
    sheet = spark.createDataFrame([], "date string, codes map<string,string>, sheet_title string")
    return m.folder_to_ride(f, sheet).select("name", "code")


@query("e16_unique_routes", "SELECT o_orderkey AS tour, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'g' || o_custkey END AS geometry, CASE WHEN o_custkey % 3 = 0 THEN 'not fetched' END AS error FROM orders")
def e16(spark, d):
    meta = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("tour"), F.lit("own").alias("provider"), F.col("o_custkey").alias("id"))
    fetched = m.routes_to_fetch(meta).filter("id % 3 != 0").select("provider", "id", F.concat(F.lit("g"), F.col("id").cast("string")).alias("geometry"), F.lit(None).cast("string").alias("error"))
    return m.unique_routes(meta, fetched).select("tour", "geometry", "error")


@query("e17_orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def e17(spark, d):
    return m.orphans(v.table(spark, d, "customer").select("c_custkey"), v.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("e18_tour_route_meta", "SELECT o_orderkey AS tour, CASE WHEN o_orderstatus = 'F' THEN 'external' ELSE 'own' END AS provider, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) ELSE 'r-' || o_custkey END AS id FROM orders WHERE o_orderstatus IN ('F', 'O')")
def e18(spark, d):
    k = F.col("o_custkey").cast("string")
    url = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("https://routes.example.com/routes/"), k)).when(F.col("o_orderstatus") == "O", F.concat(F.lit("https://example.org/route/R-"), k)).otherwise("https://else.where/route/x")
    t = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("tour"), url.alias("url"))
    return m.tour_route_meta(t).select("tour", "provider", "id")


@query("e19_live_peer_lookup", "SELECT c_custkey AS id, c_mktsegment AS name FROM customer WHERE lower(c_mktsegment) = 'building'")
def e19(spark, d):
    return m.live_peer_lookup(v.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("name")), "Building").select(F.col("id").cast("long").alias("id"), "name")


# Scalar functions over the given texts.

KEYS = "regexp_replace(translate(lower({}), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn'), '[^a-z0-9]+', '{}', 'g')"


@query("s1_text_keys", f"SELECT page_id, {KEYS.format('url', '')} AS norm, trim(substr(trim({KEYS.format('url', '-')}, '-'), 1, 60), '-') AS slug, regexp_extract(url, '([^/#]*)$', 1) AS tail, substr(md5(url), 1, 16) AS stem_hash, regexp_matches(url, '^[0-9a-f]{{16}}$') AS is_hash, regexp_matches(url, '^(https?://(localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0)|file:)') AS local FROM pages")
def s1(spark, d):
    u = F.col("url")
    return v.table(spark, d, "pages").select("page_id", tx.norm_key(u).alias("norm"), tx.route_slug(u).alias("slug"), tx.iri_tail(u).alias("tail"), tx.stem_hash(u).alias("stem_hash"), tx.is_hash16(u).alias("is_hash"), tx.is_local_host(u).alias("local"))


@query("s25_xml_and_paragraphs", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped, html AS again, len(list_filter(string_split(html, chr(10)), lambda x: trim(x) <> '')) AS n FROM pages")
def s25(spark, d):
    h = F.col("html")
    return v.table(spark, d, "pages").select("page_id", tx.escape_xml(h).alias("escaped"), tx.unescape_xml(tx.escape_xml(h)).alias("again"), F.size(tx.paragraphs(h)).cast("long").alias("n"))


@query("s19_hamming_hex", f"WITH {HASHES} SELECT row, bit_count(xor(('0x' || substr(hash, 1, 8))::BIGINT, ('0x' || substr(md5(kind), 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(hash, 9, 8))::BIGINT, ('0x' || substr(md5(kind), 9, 8))::BIGINT)) AS bits FROM h")
def s19(spark, d):
    return hashes(spark, d).select("row", tx.hamming_hex(F.col("hash"), F.substring(F.md5("kind"), 1, 16)).cast("long").alias("bits"))


@query("s22_files", v.sql("SELECT mtime AS id, CASE ext WHEN 'jpg' THEN 'image' WHEN 'mp4' THEN 'video' WHEN 'opus' THEN 'audio' END AS kind, who, ext FROM files", "files"))
def s22(spark, d):
    n = F.col("name")
    return v.files(spark, d).select(F.col("mtime").alias("id"), tx.media_kind(n).alias("kind"), tx.contributor_of(n, F.col("subfolder")).alias("who"), tx.extension(n).alias("ext"))


@query("s7_parse_folder_name", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, 'BP' AS series, CAST(o_custkey AS INT) AS number, o_orderpriority AS title FROM orders")
def s7(spark, d):
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" BP "), F.col("o_custkey").cast("string"), F.lit(" - x "), "o_orderpriority")
    p = tx.parse_folder_name(name)
    return v.table(spark, d, "orders").select("o_orderkey", p["date"].alias("date"), p["series"].alias("series"), p["number"].alias("number"), F.substring(p["title"], 3, 100).alias("title"))


def _dur(spark, d):
    n = F.floor("o_totalprice").cast("long") % 20000
    return v.table(spark, d, "orders").select("o_orderkey", "o_orderdate", n.alias("n"))


NUM = "(CAST(floor(o_totalprice) AS BIGINT) % 20000)"


@query("s8_durations", f"SELECT o_orderkey, CAST({NUM} AS DOUBLE) AS seconds, CASE WHEN {NUM} >= 3600 THEN ({NUM} // 3600) || 'h' || lpad(CAST({NUM} % 3600 // 60 AS VARCHAR), 2, '0') ELSE ({NUM} // 60) || 'min' END AS label, CASE WHEN {NUM} >= 3600 THEN ({NUM} // 3600) || 'h ' || lpad(CAST({NUM} % 3600 // 60 AS VARCHAR), 2, '0') || 'm ' || lpad(CAST({NUM} % 60 AS VARCHAR), 2, '0') || 's' ELSE ({NUM} // 60) || 'm ' || lpad(CAST({NUM} % 60 AS VARCHAR), 2, '0') || 's' END AS hms, {NUM} / 3600 AS hours FROM orders")
def s8(spark, d):
    from ..functions import time as tm

    n = F.col("n")
    iso = F.concat(F.lit("PT"), F.floor(n / 3600).cast("string"), F.lit("H"), F.floor(n % 3600 / 60).cast("string"), F.lit("M"), (n % 60).cast("string"), F.lit("S"))
    return _dur(spark, d).select("o_orderkey", tm.iso_duration_s(iso).alias("seconds"), tm.fmt_duration(iso).alias("label"), tm.fmt_hms(n).alias("hms"), tm.iso_duration_hours(iso).alias("hours"))


@query("s12_dates", "SELECT o_orderkey, CAST(dayofweek(o_orderdate) AS INT) AS weekday, epoch_ms(o_orderdate) + 10800000 AS ms, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, day(o_orderdate) || ' de ' || ['janeiro', 'fevereiro', 'março', 'abril', 'maio', 'junho', 'julho', 'agosto', 'setembro', 'outubro', 'novembro', 'dezembro'][month(o_orderdate)] || ' de ' || year(o_orderdate) AS label, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '-03:00' AS exif FROM orders")
def s12(spark, d):
    from ..functions import time as tm

    lex = v.iso("o_orderdate")
    return v.table(spark, d, "orders").select("o_orderkey", tm.weekday_of(lex).alias("weekday"), tm.parse_date_ms(lex).alias("ms"), tm.tour_week(F.col("o_orderdate")).alias("week"), tm.date_label_pt(F.col("o_orderdate")).alias("label"), tm.exif_datetime(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).alias("exif"))


@query("s4_route_ids", "SELECT page_id, CAST(page_id AS VARCHAR) AS ext, CAST(page_id AS VARCHAR) AS anywhere, 'p-' || page_id AS own, 'https://x.example/activities/' || page_id AS activity FROM pages")
def s4(spark, d):
    k = F.col("page_id").cast("string")
    return v.table(spark, d, "pages").select("page_id", tx.external_route_id(F.concat(F.lit("see https://routes.example.com/routes/"), k, F.lit("?x"))).alias("ext"), tx.any_route_id(F.concat(F.lit("a\thttps://y.example/routes/"), k)).alias("anywhere"), tx.own_route_slug(F.concat(F.lit(" https://www.example.org:80/route/P-"), k, F.lit("/ "))).alias("own"), tx.activity_url(F.concat(F.lit("1\t2\thttps://x.example/activities/"), k, F.lit("\t3"))).alias("activity"))


# Sorting and sets.


@query("t1_sort_limit", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50")
def t1(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(50)


@query("t3_set_operations", "SELECT 'union' AS what, count(*) AS n FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def t3(spark, d):
    a, b = v.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), v.table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    n = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return n(a.union(b).distinct(), "union").union(n(a.intersect(b), "intersect")).union(n(a.distinct().join(b, "k", "left_anti"), "except"))


@query("t_runner_up", "SELECT o_custkey, o_orderkey, CAST(next AS BIGINT) AS next FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS n, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE n = 1")
def t_runner_up(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return v.table(spark, d, "orders").withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("o_orderkey").over(w)).filter("n = 1").select("o_custkey", "o_orderkey", "next")
