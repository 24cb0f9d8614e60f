"""The given tables as the inputs that the operators take: facts, media, tours, fixes, files, cells, roads.

Each view has a twin in SQL, so that every query over it can be checked against another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.facts import TYPE, entities_to_triples


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _iri(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def iso(column: str):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    orders = entities_to_triples(t("orders"), _iri("order/", "o_orderkey"), "Order", {"customer": (_iri("customer/", "o_custkey"), "iri", None), "status": (F.col("o_orderstatus"), "literal", "xsd:string"), "inList": (_iri("list/", "o_orderpriority"), "iri", None), "date": (iso("o_orderdate"), "literal", "xsd:dateTime")}, "orders")
    customers = entities_to_triples(t("customer"), _iri("customer/", "c_custkey"), "Customer", {"name": (F.col("c_name"), "literal", "xsd:string"), "nation": (_iri("nation/", "c_nationkey"), "iri", None), "balance": (F.floor("c_acctbal"), "literal", "xsd:integer"), "segment": (F.col("c_mktsegment"), "literal", "xsd:string")}, "customers")
    nations = entities_to_triples(t("nation"), _iri("nation/", "n_nationkey"), "Nation", {"name": (F.col("n_name"), "literal", "xsd:string"), "region": (_iri("region/", "n_regionkey"), "iri", None)}, "nations")
    return orders.unionByName(customers).unionByName(nations)


FACTS = f"""facts AS (
  SELECT 'orders' AS dump, 'order/' || o_orderkey AS s, x.p, x.o, x.k AS o_kind, x.d AS o_dtype FROM orders, LATERAL (VALUES
    ('{TYPE}', 'Order', 'iri', NULL), ('customer', 'customer/' || o_custkey, 'iri', NULL), ('status', o_orderstatus, 'literal', 'xsd:string'),
    ('inList', 'list/' || o_orderpriority, 'iri', NULL), ('date', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'literal', 'xsd:dateTime')) AS x(p, o, k, d)
  UNION ALL SELECT 'customers', 'customer/' || c_custkey, x.p, x.o, x.k, x.d FROM customer, LATERAL (VALUES
    ('{TYPE}', 'Customer', 'iri', NULL), ('name', c_name, 'literal', 'xsd:string'), ('nation', 'nation/' || c_nationkey, 'iri', NULL),
    ('balance', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), 'literal', 'xsd:integer'), ('segment', c_mktsegment, 'literal', 'xsd:string')) AS x(p, o, k, d)
  UNION ALL SELECT 'nations', 'nation/' || n_nationkey, x.p, x.o, x.k, x.d FROM nation, LATERAL (VALUES
    ('{TYPE}', 'Nation', 'iri', NULL), ('name', n_name, 'literal', 'xsd:string'), ('region', 'region/' || n_regionkey, 'iri', NULL)) AS x(p, o, k, d)
)"""


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as media: their customer's tour, none for every third priority; a list, an author, a date."""
    o = table(spark, sf_dir, "orders")
    none = F.array().cast("array<string>")
    return o.select(
        _iri("order/", "o_orderkey").alias("m"),
        F.when(F.col("o_orderstatus") == "F", "video").otherwise("photo").alias("kind"),
        iso("o_orderdate").alias("date_lex"),
        F.col("o_orderdate").alias("date_ts"),
        F.when(F.col("o_orderpriority") == "1-URGENT", none).otherwise(F.array(_iri("customer/", "o_custkey"))).alias("tours"),
        F.array(F.concat(F.lit("person/"), (F.col("o_custkey") % 7).cast("string"))).alias("authors"),
        F.array("o_orderpriority").alias("lists"),
    )


MEDIA = """media AS (SELECT 'order/' || o_orderkey AS m, CASE WHEN o_orderstatus = 'F' THEN 'video' ELSE 'photo' END AS kind,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date_lex, o_orderdate AS date_ts,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'customer/' || o_custkey END AS tour,
  'person/' || (o_custkey % 7) AS author, o_orderpriority AS list FROM orders)"""


def tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(_iri("customer/", "c_custkey").alias("tour"), F.col("c_name").alias("title"), F.floor("c_acctbal").cast("double").alias("energy"), F.col("c_mktsegment").alias("series"), F.col("c_nationkey").alias("nation"))


TOURS = """tours AS (SELECT 'customer/' || c_custkey AS tour, c_name AS title, floor(c_acctbal) AS energy, c_mktsegment AS series, c_nationkey AS nation FROM customer)"""


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a recording per user: whole seconds, places on a grid of hundredths of a degree's hundredth."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("trip"),
        F.row_number().over(w).cast("long").alias("seq"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"),
        (F.lit(-23.7) + ((F.col("event_id") * 7919) % 3000) / 1e4).alias("lat"),
        (F.lit(-46.8) + ((F.col("event_id") * 104729) % 3000) / 1e4).alias("lng"),
        (F.col("value") / 10).alias("speed"),
        F.round(F.col("value") * 10, 0).alias("power"),
        F.col("event_type").alias("kind"),
    )


FIXES = """fixes AS (SELECT user_id AS trip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS t,
  -23.7 + ((event_id * 7919) % 3000) / 1e4 AS lat, -46.8 + ((event_id * 104729) % 3000) / 1e4 AS lng, value / 10 AS speed, round(value * 10, 0) AS power, event_type AS kind FROM events)"""


def metres_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return f"2 * 6371000.0 * asin(sqrt(pow(sin(radians({lat2} - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - ({lng1})) / 2), 2)))"


STEPS = f"""steps AS (SELECT *, {metres_sql('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} AS d, lag(t) OVER w AS pt, lag(power) OVER w AS pp FROM fixes WINDOW w AS (PARTITION BY trip ORDER BY seq))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an archive: a folder per source, who shared them by language."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(F.lit("jpg"), F.lit("mp4"), F.lit("opus"), F.lit("txt")), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("lang"), F.lit(" WhatsApp Image "), F.col("doc_id").cast("string"), F.lit("."), ext)).otherwise(F.concat(F.lit("IMG_"), F.col("doc_id").cast("string"), F.lit("."), ext))
    return d.select(F.col("source").alias("folder"), F.lit(None).cast("string").alias("subfolder"), name.alias("name"), F.col("n_chars").alias("length"), F.col("doc_id").alias("mtime"))


FILES = """files AS (SELECT source AS folder, CASE WHEN doc_id % 3 = 0 THEN lang || ' WhatsApp Image ' || doc_id ELSE 'IMG_' || doc_id END AS stem,
  ['jpg', 'mp4', 'opus', 'txt'][doc_id % 4 + 1] AS ext, CASE WHEN doc_id % 3 = 0 THEN lang END AS who, n_chars AS length, doc_id AS mtime FROM documents)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a raster: a row per customer, a column per month, whole heights."""
    o = table(spark, sf_dir, "orders")
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    return o.groupBy(F.col("o_custkey").cast("int").alias("r"), month.cast("int").alias("c")).agg((F.sum(F.floor("o_totalprice")) % 50).cast("double").alias("h")).withColumn("mask", F.lit(True))


CELLS = """cells AS (SELECT CAST(o_custkey AS INT) AS r, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INT) AS c, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) % 50 AS DOUBLE) AS h FROM orders GROUP BY 1, 2)"""


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a graph: suppliers and parts as nodes, the smallest quantity as a whole-number cost."""
    e = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_quantity").alias("cost_ab"))
    return e.select(F.concat_ws("-", "l_suppkey", "l_partkey").alias("edge"), _iri("s", "l_suppkey").alias("a"), _iri("p", "l_partkey").alias("b"), "cost_ab", F.col("cost_ab").alias("cost_ba"))


ROADS = """roads AS (SELECT l_suppkey || '-' || l_partkey AS edge, 's' || l_suppkey AS a, 'p' || l_partkey AS b, min(l_quantity) AS cost FROM lineitem GROUP BY l_suppkey, l_partkey)"""

VIEWS = {"facts": FACTS, "media": MEDIA, "tours": TOURS, "fixes": FIXES, "steps": STEPS, "files": FILES, "cells": CELLS, "roads": ROADS}
NEEDS = {"steps": ("fixes",)}


def sql(body: str, *views: str) -> str:
    """body with the views it uses before it."""
    names: list[str] = []
    for v in views:
        for n in (*NEEDS.get(v, ()), v):
            if n not in names:
                names.append(n)
    if not names:
        return body
    more = body.lstrip()
    if more[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(VIEWS[n] for n in names) + ",\n" + more[5:]
    return "WITH " + ",\n".join(VIEWS[n] for n in names) + "\n" + more
