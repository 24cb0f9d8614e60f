"""Report queries, and the live positions over a finished table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import reports as h
from ..scratch import shared_dir
from ..streaming import live
from . import views as v
from .registry import query


@query("h1_folder_rollup", v.sql("SELECT folder, count(*) AS files, sum(CASE WHEN ext = 'jpg' THEN 1 ELSE 0 END) AS images, sum(CASE WHEN ext = 'mp4' THEN 1 ELSE 0 END) AS videos, sum(CASE WHEN ext IN ('jpg', 'mp4') AND who IS NOT NULL THEN 1 ELSE 0 END) AS shared, sum(CASE WHEN ext IN ('jpg', 'mp4') AND who IS NULL THEN 1 ELSE 0 END) AS originals, CAST(sum(length) AS BIGINT) AS bytes, max(mtime) AS last_mtime, count(DISTINCT who) AS contributors FROM files GROUP BY folder", "files"))
def h1(spark, d):
    return h.folder_rollup(v.files(spark, d))


def gappy(spark, d):
    from .catalogue import _gappy

    return _gappy(spark, d)


@query("h2_capture_funnel", "SELECT 'base' AS stage, 'balance' AS field, count(*) FILTER (c_acctbal > 0) AS filled, count(*) AS total FROM customer UNION ALL SELECT 'base', 'nation', count(*) FILTER (c_nationkey > 5), count(*) FROM customer UNION ALL SELECT 'more', 'segment', count(*) FILTER (c_mktsegment <> 'BUILDING'), count(*) FROM customer")
def h2(spark, d):
    return h.capture_funnel(gappy(spark, d), {"base": ["balance", "nation"], "more": ["segment"]})


GAPS = "gaps AS (SELECT c_custkey, list_filter([CASE WHEN c_acctbal > 0 THEN NULL ELSE 'balance' END, CASE WHEN c_nationkey > 5 THEN NULL ELSE 'nation' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN NULL ELSE 'segment' END], lambda x: x IS NOT NULL) AS missing FROM customer)"


@query("h3_tour_gaps", f"WITH {GAPS} SELECT c_custkey, array_to_string(missing, ',') AS missing FROM gaps")
def h3(spark, d):
    return h.tour_gaps(gappy(spark, d), ["balance", "nation", "segment"], "c_custkey", None).withColumn("missing", F.array_join("missing", ","))


@query("h4_completeness", f"WITH {GAPS} SELECT count(*) AS total, count(*) FILTER (len(missing) = 0) AS complete, count(*) FILTER (len(list_filter(missing, lambda x: x <> 'segment')) = 0) AS complete_but_recording FROM gaps")
def h4(spark, d):
    return h.completeness(h.tour_gaps(gappy(spark, d), ["balance", "nation", "segment"], "c_custkey", None), "segment")


@query("h5_sweep_state", "SELECT 'customer/' || c_custkey AS tour, CASE WHEN n IS NULL THEN '?' WHEN n % 5 = 0 THEN '∅' ELSE CAST(n % 5 AS VARCHAR) END AS state FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def h5(spark, d):
    s = v.table(spark, d, "orders").groupBy(F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("tour")).agg((F.count("*") % 5).alias("files"))
    return h.sweep_state(v.tours(spark, d).select("tour"), s)


@query("h6_media_totals", v.sql("SELECT 'files' AS what, count(*) AS n FROM files UNION ALL SELECT 'shared', count(*) FROM files WHERE ext IN ('jpg', 'mp4') AND who IS NOT NULL UNION ALL SELECT 'originals', count(*) FROM files WHERE ext IN ('jpg', 'mp4') AND who IS NULL UNION ALL SELECT 'bytes', CAST(sum(length) AS BIGINT) FROM files UNION ALL SELECT 'tours_with_media', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'tours_swept', count(*) FROM customer WHERE c_acctbal > 0", "files"))
def h6(spark, d):
    m = v.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("media"))
    tours = v.table(spark, d, "customer").join(m, "c_custkey", "left").select("media", F.when(F.col("c_acctbal") > 0, 1).alias("swept"))
    return h.media_totals(tours, h.folder_rollup(v.files(spark, d)))


@query("h7_contributor_counts", v.sql("SELECT who AS handle, count(*) AS n, CASE WHEN who = 'en' THEN 'resolved' ELSE 'pending' END AS state FROM files WHERE who IS NOT NULL GROUP BY 1", "files"))
def h7(spark, d):
    return h.contributor_counts(v.files(spark, d), spark.createDataFrame([("en", "person/en")], "handle string, person string")).select("handle", "n", "state")


@query("h8_audit_matrix", "SELECT c_custkey, c_acctbal > 0 AS balance, c_nationkey > 5 AS nation, c_mktsegment <> 'BUILDING' AS segment FROM customer")
def h8(spark, d):
    return h.audit_matrix(gappy(spark, d), ["balance", "nation", "segment"], key="c_custkey")


@query("h9_census_derived", "SELECT l_orderkey, l_linenumber, l_extendedprice * 1000 / (l_quantity * 60) AS mean_power, 100 * (l_quantity * 60) / (l_quantity * 90) AS pct_moving, l_extendedprice / 32000 AS litres FROM lineitem")
def h9(spark, d):
    x = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("kj"), (F.col("l_quantity") * 60).alias("moving_s"), (F.col("l_quantity") * 90).alias("total_s"), F.lit(5).alias("people"))
    return h.census_derived(x).select("l_orderkey", "l_linenumber", "mean_power", "pct_moving", "litres")


@query("h10_tour_display_stats", "SELECT c_custkey, CASE WHEN c_nationkey > 10 THEN c_nationkey - 10 END AS elapsed_s, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 END AS people, CASE WHEN c_custkey % 4 > 0 THEN 0 END AS new_people FROM customer")
def h10(spark, d):
    x = v.table(spark, d, "customer").select("c_custkey", F.lit(10).alias("departed_s"), F.col("c_nationkey").alias("arrived_s"), F.lit(1).alias("moving_s"), F.lit(100.0).alias("planned"), F.col("c_acctbal").alias("measured"), (F.col("c_custkey") % 4).alias("attendees"), F.lit(0).alias("newcomers"))
    return h.tour_display_stats(x).select("c_custkey", "elapsed_s", "people", "new_people")


INTENSITY = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} < 150 THEN 'De boa' WHEN {0} < 300 THEN 'Ok' WHEN {0} < 500 THEN 'Endorfinado' WHEN {0} < 1000 THEN 'Frito' ELSE 'Insano' END"


@query("h11_intensity", f"SELECT label, count(*) AS n FROM (SELECT {INTENSITY.format('c_acctbal')} AS label FROM customer) GROUP BY 1")
def h11(spark, d):
    return v.table(spark, d, "customer").select(h.intensity(F.col("c_acctbal")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("h12_series_numbers", "SELECT o_custkey AS tour, string_agg(x, ' + ' ORDER BY seq DESC, x) AS label FROM (SELECT o_custkey, o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN 'PH-S' ELSE o_orderstatus END || ' ' || o_orderkey AS x FROM orders) GROUP BY 1")
def h12(spark, d):
    e = v.table(spark, d, "orders").select(F.col("o_custkey").alias("tour"), F.when(F.col("o_orderstatus") == "P", "S").otherwise(F.col("o_orderstatus")).alias("code"), F.col("o_orderkey").alias("seq"), F.lit(0).alias("at"))
    return h.series_numbers(e, "title")


@query("h13_timeline", v.sql("SELECT 'customer/' || c_custkey AS tour, (c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey)) AS year_break, coalesce(n, 0) AS n_all, coalesce(u, 0) AS n_default FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1) ON o_custkey = c_custkey"))
def h13(spark, d):
    cu = v.table(spark, d, "customer")
    tours = cu.select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("tour"), F.concat((F.col("c_nationkey") + 2000).cast("string"), F.lit("-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("date_lex"))
    media = v.table(spark, d, "orders").select(F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("tour"), F.col("o_orderkey").cast("string").alias("m"), v.iso("o_orderdate").alias("date_lex"), F.array(F.when(F.col("o_orderpriority") == "1-URGENT", h.DEFAULT_LIST).otherwise("x")).alias("lists"))
    return h.timeline(tours, media).select("tour", "year_break", "n_all", "n_default")


@query("h14_feed", "SELECT CAST(o_orderkey AS VARCHAR) AS tour, '/tour/' || o_orderkey AS link, 'tour:' || o_orderkey AS guid, strftime(o_orderdate, '%Y-%m-%d') || ' · ' || CAST(CAST(round(o_totalprice, 0) AS BIGINT) AS VARCHAR) || ' kJ' AS summary FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 50")
def h14(spark, d):
    x = v.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("tour"), F.lit("t").alias("title"), v.iso("o_orderdate").alias("date_lex"), F.lit(None).cast("string").alias("instagram"), F.lit(None).cast("string").alias("description"), F.col("o_totalprice").alias("energy"), F.array(F.lit("person/1")).alias("authors"))
    return h.feed(x, spark.createDataFrame([("person/1", "One")], "iri string, label string")).select("tour", "link", "guid", "summary")


@query("h15_sitemap", "SELECT '/tour/' || o_orderkey AS loc, o_orderdate > '1998-06-01' AND o_orderdate < '1998-06-05' AS news FROM orders UNION ALL SELECT '/', FALSE UNION ALL SELECT '/timeline', FALSE")
def h15(spark, d):
    x = v.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("tour"), F.concat(v.iso("o_orderdate"), F.lit("+00:00")).alias("date_lex"))
    return h.sitemap(x, F.lit("1998-06-03 00:00:00").cast("timestamp"))


@query("h16_series_page", "SELECT CAST(c_custkey AS INT) AS seq, c_name AS tour FROM customer WHERE c_mktsegment = 'BUILDING'")
def h16(spark, d):
    x = v.table(spark, d, "customer").select(F.col("c_mktsegment").alias("series"), F.col("c_custkey").cast("string").alias("seq"), F.col("c_name").alias("tour"))
    return h.series_page(x, "BUILDING")


@query("h17_tour_summary", "WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS p FROM documents) SELECT doc_id, CASE WHEN length(p) > 200 THEN rtrim(substr(p, 1, 197)) || '…' ELSE p END AS summary FROM p")
def h17(spark, d):
    return v.table(spark, d, "documents").select("doc_id", h.tour_summary(F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("double")).alias("summary"))


@query("h18_weekly_cost", """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), w AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, count(*) AS days, sum(n) AS commits, sum(CASE WHEN n >= 6 THEN 6.0 WHEN n >= 2 THEN 3.0 ELSE 1.0 END) AS hours FROM d GROUP BY 1)
  SELECT week, days, CAST(commits AS BIGINT) AS commits, CAST(hours AS DOUBLE) AS hours FROM w UNION ALL SELECT NULL, CAST(sum(days) AS BIGINT), CAST(sum(commits) AS BIGINT), CAST(sum(hours) AS DOUBLE) FROM w""")
def h18(spark, d):
    days = v.table(spark, d, "events").filter("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("commits"))
    return h.weekly_totals(h.weekly_cost(days)).select("week", "days", "commits", "hours")


@query("h19_class_counts", v.sql("SELECT dump, o AS cls, count(DISTINCT s) AS n FROM facts WHERE p = 'rdf:type' GROUP BY 1, 2", "facts"))
def h19(spark, d):
    return h.class_counts(v.facts(spark, d))


@query("h20_list_sizes", "SELECT 'list/' || o_orderpriority AS list, count(*) AS n FROM orders GROUP BY 1")
def h20(spark, d):
    return h.list_sizes(v.facts(spark, d))


@query("h21_match_report", "SELECT 'how:' || o_orderstatus AS what, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'write:' || o_orderpriority, count(*) FROM orders GROUP BY 1")
def h21(spark, d):
    x = v.table(spark, d, "orders").select(F.col("o_orderstatus").alias("how"), F.array("o_orderpriority").alias("fields"), F.array().cast("array<string>").alias("reasons"))
    return h.match_report(x)


@query("h23_saved_route_summary", f"SELECT c_custkey AS id, printf('%.1f km', (c_custkey * 100) / 1000.0) || ' · ' || CASE WHEN c_nationkey > 3 THEN c_nationkey || ' m · ' ELSE '' END || CAST(c_custkey AS VARCHAR) || ' kJ (' || {INTENSITY.format('c_custkey')} || ')' AS summary FROM customer")
def h23(spark, d):
    x = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 100.0).alias("dist_m"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("double")).alias("ascent_m"), F.col("c_custkey").cast("double").alias("kj"))
    return h.saved_route_summary(x)


@query("b22_saved_route_list", "SELECT o_orderkey AS id, o_orderdate AS at FROM orders")
def b22(spark, d):
    x = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), F.lit(None).cast("timestamp_ntz").alias("updated"))
    return h.saved_route_list(x).select("id", "at")


def fix_events(spark, d):
    """Events as fixes of one token per user; purchases stop it."""
    x = v.fixes(spark, d)
    name = F.concat(F.lit("user "), F.col("trip").cast("string"))
    return x.select(F.lower(F.hex("trip")).alias("id"), F.when(F.col("kind") == "purchase", "stop").otherwise("fix").alias("kind"), name.alias("name"), "lat", F.when(F.col("kind") == "error", F.lit(200.0)).otherwise(F.col("lng")).alias("lng"), F.lit(1e9).alias("ttl"), F.col("t").cast("double").alias("at"), "seq")


@query("l1_validate_fix", v.sql("SELECT lower(to_hex(trip)) AS id, seq, CAST(86400 AS DOUBLE) AS ttl FROM fixes WHERE kind <> 'error'", "fixes"))
def l1(spark, d):
    return live.validate_fix(fix_events(spark, d))[0].select("id", "seq", "ttl")


@query("l2_head_positions", v.sql("SELECT lower(to_hex(trip)) AS id, arg_max(lat, seq) AS lat, arg_max(lng, seq) AS lng, CAST(max(t) AS DOUBLE) AS at FROM fixes GROUP BY 1", "fixes"))
def l2(spark, d):
    x = fix_events(spark, d).withColumn("lng", F.lit(0.0)).drop("lng").join(v.fixes(spark, d).select(F.lower(F.hex("trip")).alias("id"), "seq", "lng"), ["id", "seq"])
    return live.head_positions(x).select("id", "lat", "lng", "at")


@query("l7_peer_cap", v.sql("SELECT lower(to_hex(trip)) AS id, min(t) AS first_seen FROM fixes GROUP BY 1 ORDER BY 2, 1 LIMIT 500", "fixes"))
def l7(spark, d):
    seen = v.fixes(spark, d).groupBy(F.lower(F.hex("trip")).alias("id")).agg(F.min("t").alias("first_seen"))
    return live.peer_cap(seen)


@query("l8_snapshot_view", v.sql("SELECT lower(to_hex(trip)) AS id, arg_max(lat, seq) AS lat, CAST(1.8e9 - max(t) AS DOUBLE) AS age FROM fixes GROUP BY 1", "fixes"))
def l8(spark, d):
    return live.snapshot_view(live.head_positions(fix_events(spark, d)), 1.8e9).select("id", "lat", "age")


def live_events(events):
    """Events as those of one token per user, a two-thousandth of the time apart; some purchases stop it, errors have
    bad places."""
    k = F.col("event_id")
    return events.select(
        F.lower(F.hex("user_id")).alias("id"),
        F.when((F.col("event_type") == "purchase") & (k % 5 == 0), "stop").otherwise("fix").alias("kind"),
        F.concat(F.lit(" user "), F.col("user_id").cast("string")).alias("name"),
        (F.lit(-23.7) + (k * 7919) % 11 / 1e5).alias("lat"),
        F.when(F.col("event_type") == "error", 200.0).otherwise(F.lit(-46.8) + (k * 104729) % 11 / 1e5).alias("lng"),
        (F.lit(60.5) + k % 5 * 60).alias("ttl"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 2e9).alias("at"),
        (F.floor("value") / 8).alias("accuracy"),
        F.when(k % 4 != 0, (k % 360).cast("double")).alias("heading"),
        k.alias("seq"),
    )


def trail_rows(snap):
    """A row per point of a snapshot's trails."""
    x = snap.select("id", "name", "age", "accuracy", "heading", F.posexplode_outer("trail").alias("nth", "p"))
    return x.select("id", "name", "age", "accuracy", "heading", "nth", F.col("p.lat").alias("p_lat"), F.col("p.lng").alias("p_lng"), F.col("p.accuracy").alias("p_accuracy"), F.col("p.age").alias("p_age"))


LIVE = f"""WITH RECURSIVE e AS (SELECT lower(to_hex(user_id)) AS id, 'user ' || user_id AS name, event_type = 'purchase' AND event_id % 5 = 0 AS stop, -23.7 + (event_id * 7919) % 11 / 1e5 AS lat, -46.8 + (event_id * 104729) % 11 / 1e5 AS lng,
  60.0 + event_id % 5 * 60 AS ttl, epoch_us(ts) / 2e9 AS sec, floor(value) / 8 AS accuracy, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 360 AS DOUBLE) END AS heading, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type <> 'error'),
w AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS k, NULL::VARCHAR AS name, FALSE AS live, FALSE AS keep, 0.0::DOUBLE AS lat, 0.0::DOUBLE AS lng, 0.0::DOUBLE AS accuracy, 0.0::DOUBLE AS heading, 0.0::DOUBLE AS ttl, 0.0::DOUBLE AS sec, 0.0::DOUBLE AS klat, 0.0::DOUBLE AS klng, 0.0::DOUBLE AS kat, -1e300::DOUBLE AS gone, 0 AS run FROM e
  UNION ALL SELECT id, k, name, NOT stop, keep, lat, lng, accuracy, heading, ttl, sec, CASE WHEN keep THEN lat ELSE klat END, CASE WHEN keep THEN lng ELSE klng END, CASE WHEN keep THEN sec ELSE kat END, gone, run FROM (
    SELECT *, NOT stop AND (NOT there OR kat <= gone OR sec - kat >= 8 OR {v.metres_sql('klat', 'klng', 'lat', 'lng')} >= 12) AS keep FROM (
      SELECT e.*, w.klat, w.klng, w.kat, there, CASE WHEN there THEN greatest(w.gone, e.sec - w.ttl) ELSE -1e300 END AS gone, w.run + CASE WHEN there THEN 0 ELSE 1 END AS run
      FROM (SELECT *, id AS wid FROM w) w JOIN e ON e.id = w.wid AND e.k = w.k + 1, LATERAL (SELECT w.live AND e.sec - w.sec < w.ttl AS there)))),
now AS (SELECT max(sec) AS t FROM e), h AS (SELECT w.*, t FROM w, now QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1),
p AS (SELECT w.id, w.k, w.lat, w.lng, w.accuracy, w.sec, h.gone, h.ttl, h.t FROM w JOIN h ON h.id = w.id AND h.run = w.run WHERE w.keep QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY w.k DESC) <= 500),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS nth FROM p WHERE sec > greatest(gone, t - ttl))
SELECT h.id, h.name, round_even(h.t - h.sec, 1) AS age, h.accuracy, h.heading, CAST(nth AS INT) AS nth, round_even(q.lat, 5) AS p_lat, round_even(q.lng, 5) AS p_lng, round_even(q.accuracy, 1) AS p_accuracy, CAST(round_even(q.t - q.sec, 0) AS BIGINT) AS p_age
FROM h LEFT JOIN q ON q.id = h.id WHERE h.live AND h.t - h.sec < h.ttl"""


def _good_events(events):
    return live.validate_fix(live_events(events))[0]


# The peers' cap takes each stretch at once: see live.PeerCap.
CAPPED = """WITH RECURSIVE g AS (SELECT lower(to_hex(user_id)) AS id, event_id AS seq, event_type = 'purchase' AND event_id % 5 = 0 AS stop, 60.0::DOUBLE + event_id % 5 * 60 AS ttl, epoch_us(ts) / 2e9 AS sec, epoch_us(ts) <= cut AS early
  FROM events, (SELECT epoch_us(min(ts)) + CAST(round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 2.0, 0) AS BIGINT) AS cut FROM events) WHERE event_type <> 'error'),
b AS (SELECT early, id, min(sec) FILTER (NOT stop) AS since, arg_max(stop, (sec, seq)) AS stop, max(sec) AS sec, arg_max(ttl, (sec, seq)) AS ttl FROM g GROUP BY early, id),
peers1 AS (SELECT id, sec, ttl FROM b WHERE early AND NOT stop AND since IS NOT NULL ORDER BY since, id LIMIT 500),
stay AS (SELECT id FROM (SELECT p.id, coalesce(b.stop, FALSE) AS stop, coalesce(b.sec, p.sec) AS sec, coalesce(b.ttl, p.ttl) AS ttl FROM peers1 p LEFT JOIN (SELECT * FROM b WHERE NOT early) b ON b.id = p.id), (SELECT max(sec) AS now FROM b WHERE NOT early) WHERE NOT stop AND (now IS NULL OR now - sec < ttl)),
fresh AS (SELECT id, row_number() OVER (ORDER BY since, id) AS nth FROM b WHERE NOT early AND NOT stop AND since IS NOT NULL AND id NOT IN (SELECT id FROM peers1)),
peers2 AS (SELECT id FROM fresh WHERE nth <= 500 - (SELECT count(*) FROM stay)),
admitted AS (SELECT id, seq FROM g WHERE id IN (SELECT id FROM peers1) OR (NOT early AND id IN (SELECT id FROM peers2))),
"""
LIVE_CAPPED = CAPPED + LIVE.removeprefix("WITH RECURSIVE ").replace(
    "FROM events WHERE event_type <> 'error'),", "FROM events WHERE event_type <> 'error' AND (lower(to_hex(user_id)), event_id) IN (SELECT (id, seq) FROM admitted)),", 1
).replace("now AS (SELECT max(sec) AS t FROM e)", "now AS (SELECT max(sec) AS t FROM g)", 1)


@query("l9_batch_equivalent", LIVE)
def l9(spark, d):
    good = _good_events(v.table(spark, d, "events"))
    return trail_rows(live.batch_equivalent(good, good.agg(F.max("at")).first()[0]))


@query("l8_stream_snapshot", LIVE_CAPPED)
def l8_stream(spark, d):
    """The events as two stretches of a stream, which stops in between, through the watermark, the peers' cap and the
    tokens' state; then the snapshot of its state."""
    events = v.table(spark, d, "events")
    now = _good_events(events).agg(F.max("at")).first()[0]
    folder = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    half = F.lit(first + (last - first) / 2)
    for stretch in (F.col("ts") <= half, F.col("ts") > half):
        events.filter(stretch).write.mode("append").parquet(f"{folder}/events")
        state = live.run_once(_good_events(spark.readStream.schema(events.schema).parquet(f"{folder}/events")), folder)
    return trail_rows(live.snapshot(*state, now))
