"""Queries over facts: sources, patterns, facets, changes, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as c
from ..operators import mutate as m
from ..operators import rules as r
from ..scratch import settled
from ..sources import facts as src
from . import views as v
from .registry import query

T = "rdf:type"


@query("a3_triples_to_entities", v.sql(f"SELECT s, max(CASE WHEN p = 'name' THEN o END) AS name, max(CASE WHEN p = 'nation' THEN o END) AS nation, max(CASE WHEN p = 'segment' THEN o END) AS segment FROM facts WHERE dump = 'customers' GROUP BY s", "facts"))
def a3(spark, d):
    return src.triples_to_entities(v.facts(spark, d), "Customer", {"name": "name", "nation": "nation", "segment": "segment"})


@query("a4_entities_to_triples", v.sql("SELECT dump, s, p, o, o_kind, o_dtype FROM facts", "facts"))
def a4(spark, d):
    return v.facts(spark, d).select("dump", "s", "p", "o", "o_kind", "o_dtype")


@query("a20_dedupe_first_by_key", "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def a20(spark, d):
    o = v.table(spark, d, "orders")
    return src.dedupe_first_by_key(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("b1_match_pattern", v.sql("SELECT s, p, o FROM facts WHERE p = 'status' AND o = 'F'", "facts"))
def b1(spark, d):
    return c.match_pattern(v.facts(spark, d), p="status", o="F").select("s", "p", "o")


@query("b2_class_union", v.sql(f"SELECT DISTINCT s, o AS kind FROM facts WHERE p = '{T}' AND o IN ('Customer', 'Nation')", "facts"))
def b2(spark, d):
    return c.class_union(v.facts(spark, d), ["Customer", "Nation"])


@query("b3_optional_attr", v.sql(f"SELECT x.s, n.o AS nation FROM facts x LEFT JOIN facts n ON n.s = x.s AND n.p = 'nation' WHERE x.p = '{T}' AND x.o IN ('Customer', 'Nation')", "facts"))
def b3(spark, d):
    f = v.facts(spark, d)
    return c.optional_attr(c.class_union(f, ["Customer", "Nation"]).select("s"), f, "nation", "nation")


@query("b4_facet_values", v.sql("SELECT m FROM media WHERE list IN ('2-HIGH', '5-LOW') AND author IN ('person/1', 'person/3')", "media"))
def b4(spark, d):
    return c.facet_values(v.media(spark, d), {"lists": ["2-HIGH", "5-LOW"], "authors": ["person/1", "person/3"], "tours": []}).select("m")


@query("b5_facet_date_range", v.sql("SELECT m FROM media WHERE date_ts >= '1996-03-01' AND date_ts <= '1997-06-30 23:59:59'", "media"))
def b5(spark, d):
    return c.facet_date_range(v.media(spark, d), "1996-03-01", "1997-06-30").select("m")


@query("b6_facet_energy_range", v.sql("SELECT m FROM media JOIN tours USING (tour) WHERE energy BETWEEN 100 AND 2500", "media", "tours"))
def b6(spark, d):
    media = v.media(spark, d).select("m", F.explode("tours").alias("tour"))
    return c.facet_energy_range(media, v.tours(spark, d), 100, 2500).select("m")


@query("b7_facet_weekday", v.sql("SELECT m FROM media WHERE dayofweek(date_ts) IN (0, 6)", "media"))
def b7(spark, d):
    return c.facet_weekday(v.media(spark, d), [0, 6]).select("m")


@query("b8_group_key", v.sql("SELECT m, coalesce(tour, 'sem-passeio') AS by_tour, substr(date_lex, 1, 4) AS by_year, substr(date_lex, 1, 7) AS by_month, substr(date_lex, 1, 10) AS by_day FROM media", "media"))
def b8(spark, d):
    x = v.media(spark, d).select("m", "date_lex", F.explode_outer("tours").alias("tour"))
    return x.select("m", *[c.group_key(k).alias(f"by_{k}") for k in ("tour", "year", "month", "day")])


FACETS = dict(lists=["2-HIGH", "3-MEDIUM", "5-LOW"], first="1995-06-01", last="1999-12-31", least=0, most=5000, days=[0, 1, 2, 5, 6], mode="month")


@query("b9_faceted_query", v.sql("SELECT DISTINCT m, substr(date_lex, 1, 7) AS grp, date_lex FROM media JOIN tours USING (tour) WHERE list IN ('2-HIGH', '3-MEDIUM', '5-LOW') AND date_ts >= '1995-06-01' AND date_ts <= '1999-12-31 23:59:59' AND energy BETWEEN 0 AND 5000 AND dayofweek(date_ts) IN (0, 1, 2, 5, 6)", "media", "tours"))
def b9(spark, d):
    return c.faceted_query(v.media(spark, d), v.tours(spark, d), **FACETS)


@query("b10_list_members", v.sql("SELECT DISTINCT s AS m FROM facts WHERE p = 'inList' AND o = 'list/2-HIGH'", "facts"))
def b10(spark, d):
    return c.list_members(v.facts(spark, d), "list/2-HIGH")


@query("b11_path_join", v.sql("SELECT DISTINCT a.s, b.o FROM facts a JOIN facts b ON a.o = b.s WHERE a.p = 'customer' AND b.p = 'nation'", "facts"))
def b11(spark, d):
    return c.path_join(v.facts(spark, d), "customer", "nation")


ROOTS = "(SELECT s FROM facts WHERE p = 'segment' AND o = 'BUILDING')"


def roots(f):
    return c.match_pattern(f, p="segment", o="BUILDING").select("s")


@query("b12_describe", v.sql(f"SELECT DISTINCT s, p, o FROM facts WHERE s IN {ROOTS}", "facts"))
def b12(spark, d):
    f = v.facts(spark, d)
    return c.describe(f, roots(f)).select("s", "p", "o")


@query("b13_derived_subjects", "SELECT 'customer/' || c_custkey || '_geo' AS s FROM customer WHERE c_mktsegment = 'BUILDING'")
def b13(spark, d):
    f = v.facts(spark, d)
    geo = f.filter((F.col("p") == "balance")).withColumn("s", F.concat("s", F.lit("_geo"))).withColumn("s_parent", src.parent_of(F.col("s")))
    return c.derived_subjects(f.unionByName(geo), roots(f))


@query("b14_rdfs_closure", v.sql(f"""SELECT DISTINCT s, o FROM (
  SELECT s, o FROM facts WHERE p = '{T}' UNION ALL SELECT s, unnest(['Agent', 'Thing']) FROM facts WHERE p = 'nation' UNION ALL SELECT s, unnest(['Agent', 'Thing']) FROM facts WHERE p = '{T}' AND o = 'Customer'
  UNION ALL SELECT o, unnest(['Customer', 'Agent', 'Thing']) FROM facts WHERE p = 'customer' UNION ALL SELECT o, unnest(['Place', 'Thing']) FROM facts WHERE p = 'nation' UNION ALL SELECT s, unnest(['Place', 'Thing']) FROM facts WHERE p = '{T}' AND o = 'Nation')""", "facts"))
def b14(spark, d):
    sub = spark.createDataFrame([("Customer", "Agent"), ("Agent", "Thing"), ("Nation", "Place"), ("Place", "Thing")], "child string, parent string")
    dom = spark.createDataFrame([("nation", "Agent")], "p string, c string")
    rng = spark.createDataFrame([("customer", "Customer"), ("nation", "Place")], "p string, c string")
    return c.types_only(c.rdfs_closure(v.facts(spark, d), sub, dom, rng)).select("s", "o")


@query("b15_types_only", v.sql(f"SELECT s, o FROM facts WHERE p = '{T}'", "facts"))
def b15(spark, d):
    return c.types_only(v.facts(spark, d)).select("s", "o")


@query("b16_display_name", "SELECT 'customer/' || c_custkey AS iri, coalesce(CASE WHEN c_acctbal > 5000 THEN c_name END, CASE WHEN c_acctbal < 0 THEN c_mktsegment END, CAST(c_custkey AS VARCHAR)) AS label FROM customer")
def b16(spark, d):
    p = v.table(spark, d, "customer").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("iri"), F.when(F.col("c_acctbal") > 5000, F.col("c_name")).alias("name"), F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).alias("alt_name"))
    return c.display_name(p)


@query("b17_media_records", v.sql("SELECT m, title AS tour_title, energy, author AS author_name, CAST(dayofweek(date_ts) AS INT) AS weekday, '/' || kind || '/' || m AS url FROM media LEFT JOIN tours USING (tour)", "media", "tours"))
def b17(spark, d):
    people = spark.createDataFrame([(f"person/{k}", f"person/{k}", None) for k in range(7)], "iri string, name string, alt_name string")
    x = c.media_records(v.media(spark, d), v.tours(spark, d), people)
    return x.select("m", F.get("tour_titles", F.lit(0)).alias("tour_title"), "energy", F.get("author_names", F.lit(0)).alias("author_name"), "weekday", "url")


def _gappy(spark, d):
    cu = v.table(spark, d, "customer")
    return cu.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")).alias("nation"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))


GAPS = "gaps AS (SELECT c_custkey, list_filter([CASE WHEN c_acctbal > 0 THEN NULL ELSE 'balance' END, CASE WHEN c_nationkey > 5 THEN NULL ELSE 'nation' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN NULL ELSE 'segment' END], lambda x: x IS NOT NULL) AS missing FROM customer)"


@query("b18_missing_fields", f"WITH {GAPS} SELECT unnest(missing) AS field, count(*) AS n FROM gaps GROUP BY 1")
def b18(spark, d):
    return c.missing_counts(c.missing_fields(_gappy(spark, d), ["balance", "nation", "segment"], "c_custkey"))


@query("b19_nonempty_reference_check", "SELECT 'customer/' || c_custkey AS iri, TRUE AS defined, c_custkey IN (SELECT o_custkey FROM orders) AS referenced FROM customer")
def b19(spark, d):
    f = v.facts(spark, d)
    return c.nonempty_reference_check(f, c.class_union(f, ["Customer"]).select(F.col("s").alias("iri")), "Customer")


EDITIONS = "SELECT c_mktsegment AS series, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS sequence, 'customer/' || c_custkey AS tour FROM customer"


def editions(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey"))
    return v.table(spark, d, "customer").select(F.col("c_mktsegment").alias("series"), n.alias("sequence"), F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("tour"))


@query("b20_resolve_edition", EDITIONS.replace("AS sequence", "AS sequence"))
def b20(spark, d):
    e = editions(spark, d).withColumn("ed", F.concat_ws("/", F.lit("edition"), "series", F.col("sequence").cast("string")))
    fact = lambda s, p, o: e.select(F.col(s).alias("s"), F.lit(p).alias("p"), F.col(o).cast("string").alias("o"))
    triples = fact("ed", "inEventSeries", "series").union(fact("ed", "sequence", "sequence")).union(fact("tour", "inSeriesEdition", "ed"))
    return c.resolve_edition(triples, e.select("series", "sequence"))


@query("b21_find_saved_route", """SELECT ref, id FROM (SELECT ref, id, row_number() OVER (PARTITION BY ref ORDER BY how, updated DESC NULLS LAST, id) AS n FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS ref, CAST(o_orderkey AS VARCHAR) AS id, 0 AS how, o_orderdate AS updated FROM orders UNION ALL
  SELECT p.ref, CAST(o.o_orderkey AS VARCHAR), 1, o.o_orderdate FROM orders o JOIN (SELECT DISTINCT o_orderpriority AS ref FROM orders) p ON o.o_orderpriority = p.ref)) WHERE n = 1""")
def b21(spark, d):
    o = v.table(spark, d, "orders")
    saved = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("slug"), F.col("o_orderdate").alias("updated"), F.col("o_orderdate").alias("created"))
    refs = o.select(F.col("o_orderkey").cast("string").alias("ref")).union(o.select("o_orderpriority")).distinct()
    return c.find_saved_route(saved, refs).select("ref", "id")


def deep(spark, d):
    """facts, with a derived node and a blank node of each customer."""
    f = v.facts(spark, d)
    own, null = settled(f.filter("p = 'segment'")), F.lit(None).cast("string")
    tail = F.concat(F.lit("_:"), F.substring_index("s", "/", -1))
    more = lambda s, p, o, kind, parent: own.select("dump", s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), null.alias("o_dtype"), null.alias("o_lang"), parent.alias("s_parent"))
    geo = more(F.concat("s", F.lit("_geo")), "lat", F.lit("1"), "literal", F.col("s"))
    return settled(f.unionByName(geo).unionByName(more(F.col("s"), "detail", tail, "bnode", null)).unionByName(more(tail, "note", F.col("o"), "literal", null)))


PURGED = v.sql(f"""WITH own AS (SELECT s, o FROM facts WHERE p = 'segment'), deep AS (SELECT s, p, o FROM facts UNION ALL SELECT s || '_geo', 'lat', '1' FROM own UNION ALL SELECT s, 'detail', '_:' || substr(s, 10) FROM own UNION ALL SELECT '_:' || substr(s, 10), 'note', o FROM own)
  SELECT s, p, o FROM deep WHERE s NOT IN {ROOTS} AND replace(s, '_geo', '') NOT IN {ROOTS} AND replace(s, '_:', 'customer/') NOT IN {ROOTS}""", "facts")


@query("c1_purge", PURGED)
def c1(spark, d):
    f = deep(spark, d)
    return m.purge(f, roots(f)).select("s", "p", "o")


@query("c2_upsert", v.sql(f"SELECT s, p, o FROM facts WHERE s NOT IN {ROOTS} UNION ALL SELECT s, 'name', upper(o) FROM facts WHERE p = 'name' AND s IN {ROOTS}", "facts"))
def c2(spark, d):
    f = v.facts(spark, d)
    docs = f.filter("p = 'name'").join(roots(f), "s", "left_semi").withColumn("o", F.upper("o")).select(f.columns)
    return m.upsert(f, docs).select("s", "p", "o")


@query("c3_merge_patch", v.sql(f"SELECT s, p, o FROM facts WHERE NOT (s IN {ROOTS} AND p IN ('segment', 'balance')) UNION ALL SELECT s, 'segment', 'PATCHED' FROM facts WHERE p = 'segment' AND s IN {ROOTS}", "facts"))
def c3(spark, d):
    f = v.facts(spark, d)
    own = f.filter("p = 'segment'").join(roots(f), "s", "left_semi")
    patch = own.withColumn("o", F.lit("PATCHED")).select(f.columns)
    return m.merge_patch(f, patch, own.select("s", F.lit("balance").alias("p"))).select("s", "p", "o")


@query("c4_expand_curies", "SELECT c_custkey AS doc, unnest(['http://schema.org/' || lower(c_mktsegment), 'https://schema.org/' || lower(c_mktsegment), 'http://x.example/name']) AS p FROM customer")
def c4(spark, d):
    x = v.table(spark, d, "customer").select(F.col("c_custkey").alias("doc"), F.concat(F.lit("schema:"), F.lower("c_mktsegment"), F.lit(" x:name")).alias("curies"))
    return m.expand_curies(x, {"schema": ["http://schema.org/", "https://schema.org/"], "x": ["http://x.example/"]})


@query("c5_patch_diff", "SELECT c_custkey, 'c_mktsegment' AS p, 'NEW' AS o FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'NEW'")
def c5(spark, d):
    a = v.table(spark, d, "customer")
    b = a.withColumn("c_mktsegment", F.when(F.col("c_acctbal") < 0, "NEW").otherwise(F.col("c_mktsegment")))
    return m.patch_diff(a, b, "c_custkey", ["c_mktsegment", "c_name"])[0]


@query("c6_route_by_class", v.sql("SELECT CASE WHEN dump = 'customers' THEN 'identities' ELSE dump END AS dump, s, p, o FROM facts", "facts"))
def c6(spark, d):
    return m.route_by_class(v.facts(spark, d), "Customer", "identities").select("dump", "s", "p", "o")


@query("c7_assign_lists", v.sql("SELECT DISTINCT s, p, o FROM (SELECT s, p, o FROM facts WHERE NOT (p = 'inList' AND o = 'list/5-LOW' AND s IN (SELECT s FROM facts WHERE p = 'status' AND o = 'F')) UNION ALL SELECT s, 'inList', 'list/done' FROM facts WHERE p = 'status' AND o = 'F')", "facts"))
def c7(spark, d):
    f = v.facts(spark, d)
    return m.assign_lists(f, c.match_pattern(f, p="status", o="F"), ["list/done"], ["list/5-LOW"], ["list/done", "list/5-LOW"]).select("s", "p", "o")


@query("c8_replace_person_fields", v.sql("SELECT s, p, o FROM facts WHERE NOT (p = 'name' AND dump = 'customers') UNION ALL SELECT s, p, lower(o) FROM facts WHERE p = 'name' AND dump = 'customers'", "facts"))
def c8(spark, d):
    f = v.facts(spark, d)
    return m.replace_person_fields(f, f.filter("p = 'name' and dump = 'customers'").withColumn("o", F.lower("o"))).select("s", "p", "o")


@query("c9_delete_keep_refs", PURGED)
def c9(spark, d):
    f = deep(spark, d)
    routes = v.tours(spark, d).select(F.col("tour").alias("tour_iri"))
    return m.delete_keep_refs(f, routes, roots(f))[0].select("s", "p", "o")


@query("c10_remap_iris", v.sql("SELECT DISTINCT replace(s, 'nation/', 'country/') AS s, p, CASE WHEN o_kind = 'literal' THEN o ELSE replace(o, 'nation/', 'country/') END AS o FROM facts", "facts"))
def c10(spark, d):
    f = v.facts(spark, d)
    mapping = c.class_union(f, ["Nation"]).select(F.col("s").alias("old"), F.regexp_replace("s", "^nation/", "country/").alias("new"))
    return m.remap_iris(f, mapping).select("s", "p", "o")


@query("c10b_remap_prefix", v.sql("SELECT replace(s, 'nation/', 'land/') AS s, p, CASE WHEN o_kind = 'literal' THEN o ELSE replace(o, 'nation/', 'land/') END AS o FROM facts", "facts"))
def c10b(spark, d):
    return m.remap_prefix(v.facts(spark, d), {"nation/": "land/"}).select("s", "p", "o")


@query("c11_skolemise_bnodes", v.sql("SELECT s, p, CASE WHEN p = 'nation' THEN s || '_geo' ELSE o END AS o, CASE WHEN p = 'nation' THEN 'iri' ELSE o_kind END AS o_kind FROM facts WHERE dump = 'customers'", "facts"))
def c11(spark, d):
    f = v.facts(spark, d).filter("dump = 'customers'")
    blank = f.withColumns({"o": F.when(F.col("p") == "nation", F.concat(F.lit("_:"), "s")).otherwise(F.col("o")), "o_kind": F.when(F.col("p") == "nation", "bnode").otherwise(F.col("o_kind"))})
    return m.skolemise_bnodes(blank, {"nation": "geo"}).select("s", "p", "o", "o_kind")


@query("c12_retype", v.sql(f"SELECT s, p, CASE WHEN p = '{T}' AND o = 'Customer' THEN 'Client' ELSE o END AS o FROM facts", "facts"))
def c12(spark, d):
    return m.retype(v.facts(spark, d), {"Customer": "Client"}).select("s", "p", "o")


@query("c13_split_by_class", v.sql("SELECT CASE dump WHEN 'customers' THEN 'identities' WHEN 'orders' THEN 'tours' ELSE 'orphans' END AS dump, count(*) AS n FROM facts GROUP BY 1", "facts"))
def c13(spark, d):
    from ..operators.reports import dump_counts

    return dump_counts(m.split_by_class(v.facts(spark, d), {"Customer": "identities", "Order": "tours"}))


@query("c14_collapse_associations", EDITIONS.replace("SELECT c_mktsegment AS series", "SELECT 'edition/' || c_mktsegment AS e0").replace(" AS sequence, 'customer/' || c_custkey AS tour", " AS n, 'customer/' || c_custkey AS s").join(["SELECT s, e0 || '/' || n AS o FROM (", ")"]))
def c14(spark, d):
    e = editions(spark, d)
    null = F.lit(None).cast("string")
    t = e.select(F.lit("tours").alias("dump"), F.col("tour").alias("s"), F.lit("inSeriesEdition").alias("p"), F.concat(F.lit("x/assoc_"), "series", F.lit("_"), F.col("sequence").cast("string")).alias("o"), F.lit("iri").alias("o_kind"), null.alias("o_dtype"), null.alias("o_lang"), null.alias("s_parent"))
    return m.collapse_associations(t)[0].select("s", "o")


@query("c15_add_type", v.sql(f"SELECT s, o FROM facts WHERE p = '{T}' UNION ALL SELECT s, 'Located' FROM facts WHERE p = 'nation'", "facts"))
def c15(spark, d):
    return c.types_only(m.add_type(v.facts(spark, d), "nation", "Located")).select("s", "o")


@query("c16_add_all_to_list", v.sql("SELECT s, o FROM facts WHERE p = 'inList' UNION ALL SELECT s, 'list/all' FROM facts WHERE p = 'status'", "facts"))
def c16(spark, d):
    return m.add_all_to_list(v.facts(spark, d), "Order", "list/all").filter("p = 'inList'").select("s", "o")


@query("c17_fix_local_hosts", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://img.example.org/assets/' || page_id ELSE 'http://localhost/none/' || page_id END AS o FROM pages")
def c17(spark, d):
    p = v.table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://localhost:8080/assets/"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("http://localhost/none/"), F.col("page_id").cast("string"))).alias("o"))
    return m.fix_local_hosts(p, "https://img.example.org/")


@query("c18_normalise_datatype", v.sql("SELECT s, p, CASE WHEN o_dtype = 'xsd:integer' THEN 'xsd:long' ELSE o_dtype END AS o_dtype FROM facts", "facts"))
def c18(spark, d):
    return m.normalise_datatype(v.facts(spark, d), "xsd:integer", "xsd:long").select("s", "p", "o_dtype")


@query("c19_mint_slugs", "SELECT count(*) AS keys, count(*) AS slugs, CAST(8 AS INT) AS len FROM customer")
def c19(spark, d):
    keys = v.table(spark, d, "customer").select(F.col("c_name").alias("key"))
    known = spark.createDataFrame([], "key string, slug string")
    return m.mint_slugs(keys, known).agg(F.count("key").alias("keys"), F.countDistinct("slug").alias("slugs"), F.max(F.length("slug")).alias("len"))


@query("c20_conservation_check", v.sql("SELECT 'lost' AS rule, count(*) AS violations FROM facts WHERE s LIKE 'nation/%' OR (o_kind = 'iri' AND o LIKE 'nation/%') UNION ALL SELECT 'gained', count(*) FROM facts WHERE s LIKE 'nation/%' OR (o_kind = 'iri' AND o LIKE 'nation/%') UNION ALL SELECT 'leftover', 0", "facts"))
def c20(spark, d):
    f = v.facts(spark, d)
    return m.conservation_check(f, m.remap_prefix(f, {"nation/": "land/"}), "nation/")


@query("c21_three_way_verdict", "SELECT CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN o_orderstatus = 'O' THEN 'ok' WHEN o_orderstatus = 'F' THEN 'insync' ELSE 'conflict' END AS verdict FROM orders")
def c21(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("name"), "o_orderstatus")
    row = lambda x, dig: x.select("name", F.lit(dig).alias("digest"))
    src_, dst = row(o, "a"), o.select("name", F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("digest"))
    base = o.select("name", F.when(F.col("o_orderstatus") == "O", "b").otherwise("c").alias("digest"))
    return m.three_way_verdict(src_, dst, base)


@query("c22_upsert_routes", "SELECT c_custkey AS tour_iri, CASE WHEN c_nationkey < 3 THEN 'removed' WHEN c_nationkey < 8 THEN 'unchanged' WHEN c_nationkey < 12 THEN 'metadata' WHEN c_nationkey < 18 THEN 'failed' ELSE 'replaced' END AS status FROM customer")
def c22(spark, d):
    cu, n = v.table(spark, d, "customer"), F.col("c_nationkey")
    routes = cu.select(F.col("c_custkey").alias("tour_iri"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("title"), F.lit("old").alias("geometry"))
    meta = cu.select(F.col("c_custkey").alias("tour_iri"), F.when(n < 3, None).when(n < 12, F.concat(F.lit("r"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).alias("id"), F.when(n.between(8, 11), "renamed").otherwise(F.col("c_name")).alias("title"))
    fetched = cu.filter(n >= 18).select(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("id"), F.lit("new").alias("geometry"))
    return m.upsert_routes(routes, meta, fetched).select("tour_iri", "status")


@query("c23_routes_depending_on", "SELECT 'customer/' || c_custkey AS tour, lower(c_mktsegment) AS slug FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def c23(spark, d):
    t = v.table(spark, d, "customer").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"), F.lit("_route")).alias("s"), F.lit("routeUrl").alias("p"), F.concat(F.lit("https://example.org/route/"), F.lower("c_mktsegment")).alias("o"), F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("s_parent"))
    return m.routes_depending_on(t, spark.createDataFrame([("building",), ("machinery",)], "slug string"))


@query("c24_save_route_upsert", "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS updated, round(c_acctbal, 1) AS distance FROM customer")
def c24(spark, d):
    cu = v.table(spark, d, "customer")
    rows = cu.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("slug"), F.col("c_name").alias("name"), F.lit(1).alias("created"), F.lit(1).alias("updated"), F.round("c_acctbal", 1).alias("distance"))
    return m.save_route_upsert(rows, rows.join(cu.filter("c_acctbal < 0").select(F.col("c_custkey").alias("id")), "id", "left_semi"), F.lit(2))[0].select("id", "updated", "distance")


@query("c25_build_sweep_patch", "SELECT 'customer/' || c.c_custkey || '_sweep' AS s, 'fileCount' AS p, CAST(n AS VARCHAR) AS o FROM customer c JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) x ON x.o_custkey = c.c_custkey WHERE n <> 10")
def c25(spark, d):
    t = v.tours(spark, d).select("tour", F.lit(10).cast("long").alias("swept"))
    f = v.table(spark, d, "orders").groupBy(F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("tour")).agg(F.count("*").alias("files"))
    return m.build_sweep_patch(t, f)


@query("c26_attach_provenance", v.sql(f"SELECT p, count(*) AS n FROM (SELECT p FROM facts UNION ALL SELECT unnest(['{T}', 'startedAtTime', 'generated']) FROM facts WHERE p = 'segment' AND o = 'BUILDING') GROUP BY p", "facts"))
def c26(spark, d):
    f = v.facts(spark, d)
    return m.attach_provenance(f, roots(f), F.lit("2026-01-01T00:00:00Z")).groupBy("p").agg(F.count("*").alias("n"))


@query("c27_delete_saved_routes", "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0")
def c27(spark, d):
    s = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return m.delete_saved_routes(s, s.filter("c_acctbal < 0").select("id"))[0].select("id")


RULES = (
    ("Customer", "balance", r.V, dict(min=1, max=1, dtype="xsd:integer", ge=0, lt=9000)),
    ("Customer", "segment", r.W, dict(values="BUILDING|MACHINERY|FURNITURE")),
    ("Customer", "^customer", r.I, dict(min=1, max=15)),
    ("Customer", "nation", r.W, dict(kind="iri", cls="Nation")),
    ("Order", "status", r.W, dict(dtype="xsd:date", values="F|O")),
    ("Order", "customer", r.V, dict(min=1, cls="Client")),
)


def rule_df(spark):
    return r.rule_table(spark, RULES)


COUNTED = "SELECT 'customer/' || c_custkey AS focus, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


@query("d1_rule_counts", f"SELECT CASE WHEN n < 1 THEN '02-Customer-^customer-min' ELSE '02-Customer-^customer-max' END AS rule, focus FROM ({COUNTED}) WHERE n < 1 OR n > 15")
def d1(spark, d):
    return r.rule_counts(v.facts(spark, d), rule_df(spark)).select("rule", "focus")


@query("d2_rule_values", v.sql("""SELECT '00-Customer-balance-ge' AS rule, s AS focus FROM facts WHERE p = 'balance' AND CAST(o AS DOUBLE) < 0
  UNION ALL SELECT '00-Customer-balance-lt', s FROM facts WHERE p = 'balance' AND CAST(o AS DOUBLE) >= 9000
  UNION ALL SELECT '01-Customer-segment-values', s FROM facts WHERE p = 'segment' AND o NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')
  UNION ALL SELECT '04-Order-status-dtype', s FROM facts WHERE p = 'status' UNION ALL SELECT '04-Order-status-values', s FROM facts WHERE p = 'status' AND o NOT IN ('F', 'O')""", "facts"))
def d2(spark, d):
    return r.rule_values(v.facts(spark, d), rule_df(spark)).select("rule", "focus")


def page_facts(spark, d):
    """Pages with a picture, of every third on a local host, and a title, of every fifth with a wrong datatype."""
    k = F.col("page_id")
    image = F.when(k % 3 == 0, F.concat(F.lit("http://localhost:3000/"), k.cast("string"))).otherwise(F.concat(F.lit("https://x.example/"), k.cast("string")))
    x = src.entities_to_triples(v.table(spark, d, "pages"), F.concat(F.lit("page/"), k.cast("string")), "Page", {"image": (image, "iri", None), "title": (F.concat(F.lit("Page "), k.cast("string")), "literal", "xsd:string")}, "pages")
    number = F.substring("s", 6, 20).cast("long")
    return x.withColumn("o_dtype", F.when(F.col("p") != "title", F.col("o_dtype")).when(number % 5 == 0, "xsd:date").when(number % 2 == 0, "rdf:langString").otherwise("xsd:string"))


PAGE_RULES = (("Page", "image", r.W, dict(pattern_not=r.LOCAL_HOST)), ("Page", "title", r.W, dict(dtype="xsd:string|rdf:langString")))


@query("d7_pattern_and_datatypes", "SELECT '00-Page-image-pattern_not' AS rule, 'page/' || page_id AS focus FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT '01-Page-title-dtype', 'page/' || page_id FROM pages WHERE page_id % 5 = 0")
def d7(spark, d):
    return r.rule_values(page_facts(spark, d), r.rule_table(spark, PAGE_RULES)).select("rule", "focus")


def shaped(spark, d):
    """Orders as tours and customers as people, in the words of the shapes, with flaws by number."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    tours = {
        "dcterms:title": (F.when(k % 10 > 0, F.col("o_orderpriority")), "literal", r.STRING),
        "dcterms:date": (v.iso("o_orderdate"), "literal", r.DATETIME),
        "ph:measuredEnergy": (F.when(k % 11 == 0, -1).otherwise(k), "literal", r.DECIMAL),
        "ph:departedAt": (F.when(k % 7 == 0, v.iso("o_orderdate")), "literal", r.STRING),
        "schema:image": (F.when(k % 6 == 0, F.lit("http://localhost/a.jpg")).when(k % 6 > 2, F.lit("https://img.example.org/a.jpg")), "iri", None),
        "schema:attendee": (F.concat(F.lit("person/"), F.col("o_custkey").cast("string")), "iri", None),
    }
    people = {"schema:name": (F.col("c_name"), "literal", r.STRING), "schema:alternateName": (F.when(c % 4 > 0, F.col("c_name")), "literal", r.STRING), "foaf:page": (F.lit("p"), "literal", r.STRING)}
    of_tours = src.entities_to_triples(v.table(spark, d, "orders"), F.concat(F.lit("tour/"), k.cast("string")), "Tour", tours, "tours")
    of_people = src.entities_to_triples(v.table(spark, d, "customer").filter(c % 9 > 0), F.concat(F.lit("person/"), c.cast("string")), "schema:Person", people, "people")
    again = of_people.filter((F.col("p") == "schema:name") & (F.substring_index("s", "/", -1).cast("long") % 5 == 0)).withColumn("o", F.lit("Other"))
    return settled(of_tours.unionByName(of_people).unionByName(again))


def _rule(cls, path, kind):
    """A rule's name by what it constrains."""
    n = next(n for n, s in enumerate(r.SHAPES) if s[:2] == (cls, path) and kind in s[3])
    return f"{n:02d}-{cls}-{path}-{kind}"


FOUND = " UNION ALL ".join(
    f"SELECT '{_rule(*rule)}' AS rule, count(*) AS n FROM {rows}"
    for rule, rows in {
        **{("Tour", path, "min"): "orders" for path in ("ph:linkRoute", "ph:inSeriesEdition", "dcterms:description")},
        ("Tour", "dcterms:title", "min"): "orders WHERE o_orderkey % 10 = 0",
        ("Tour", "ph:measuredEnergy", "ge"): "orders WHERE o_orderkey % 11 = 0",
        ("Tour", "ph:departedAt", "dtype"): "orders WHERE o_orderkey % 7 = 0",
        ("Tour", "schema:image", "min"): "orders WHERE o_orderkey % 6 IN (1, 2)",
        ("Tour", "schema:image", "pattern_not"): "orders WHERE o_orderkey % 6 = 0",
        ("Tour", "schema:attendee", "cls"): "orders WHERE o_custkey % 9 = 0",
        ("schema:Person", "schema:alternateName", "min"): "customer WHERE c_custkey % 9 > 0 AND c_custkey % 4 = 0",
        ("schema:Person", "schema:name", "max"): "customer WHERE c_custkey % 9 > 0 AND c_custkey % 5 = 0",
        ("schema:Person", "foaf:page", "kind"): "customer WHERE c_custkey % 9 > 0",
    }.items()
)


@query("d15_shapes", f"SELECT * FROM ({FOUND}) WHERE n > 0")
def d15(spark, d):
    """All shapes over tours and people: violations by rule."""
    return r.violations_by_rule(r.report(shaped(spark, d), r.rule_table(spark)))


@query("d3_rule_class", v.sql("SELECT '05-Order-customer-cls' AS rule, s AS focus FROM facts WHERE p = 'customer'", "facts"))
def d3(spark, d):
    return r.rule_class(v.facts(spark, d), rule_df(spark)).select("rule", "focus")


@query("d10_rule_unique_newcomer", v.sql("""WITH x AS (SELECT DISTINCT a.s, a.o AS person, n.o AS series FROM facts a JOIN facts b ON b.s = a.s AND b.p = 'customer' JOIN facts n ON n.s = b.o AND n.p = 'nation' WHERE a.p = 'inList')
  SELECT s AS focus, person || ' is new in ' || n || ' tours of ' || series AS message FROM (SELECT *, count(*) OVER (PARTITION BY person, series) AS n FROM x) WHERE n > 1""", "facts"))
def d10(spark, d):
    return r.rule_unique_newcomer(v.facts(spark, d), "inList", "customer", "nation").select("focus", "message")


@query("d11_validate", v.sql("SELECT s AS doc, (CAST(o AS DOUBLE) >= 0 AND CAST(o AS DOUBLE) < 9000) AS ok FROM facts WHERE p = 'balance'", "facts"))
def d11(spark, d):
    f = v.facts(spark, d)
    docs = f.filter("dump = 'customers'").withColumn("doc", F.col("s"))
    return r.validate(docs, f, rule_df(spark))[1]


@query("d12_check_single_subject", "SELECT 'customer/' || c_custkey AS doc, 'prefix' AS error FROM customer WHERE c_mktsegment = 'BUILDING'")
def d12(spark, d):
    f = v.facts(spark, d).filter("dump = 'customers'")
    b = roots(f).withColumn("__b", F.lit(True))
    docs = f.withColumn("doc", F.col("s")).join(b, "s", "left").withColumn("s", F.when(F.col("__b"), F.concat(F.lit("other/"), "s")).otherwise(F.col("s")))
    return r.check_single_subject(docs, "Customer", "customer/")


@query("d13_check_cross_type_collision", v.sql("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS hash FROM orders WHERE o_orderkey IN (SELECT c_custkey FROM customer)"))
def d13(spark, d):
    return r.check_cross_type_collision(v.facts(spark, d), "Order", "Customer")


@query("d14_check_stem_collisions", "SELECT p_brand AS stem, count(DISTINCT p_size) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1")
def d14(spark, d):
    f = v.table(spark, d, "part").select(F.concat(F.regexp_replace("p_brand", "[.]", "_"), F.lit("."), F.col("p_size").cast("string")).alias("name"))
    return r.check_stem_collisions(f).select("stem", F.size("names").cast("long").alias("n"))


@query("d16_violations_by_rule", v.sql(f"""WITH k AS ({COUNTED}) SELECT rule, count(*) AS n FROM (
  SELECT '02-Customer-^customer-min' AS rule FROM k WHERE n < 1 UNION ALL SELECT '02-Customer-^customer-max' FROM k WHERE n > 15
  UNION ALL SELECT '00-Customer-balance-ge' FROM facts WHERE p = 'balance' AND CAST(o AS DOUBLE) < 0 UNION ALL SELECT '00-Customer-balance-lt' FROM facts WHERE p = 'balance' AND CAST(o AS DOUBLE) >= 9000
  UNION ALL SELECT '01-Customer-segment-values' FROM facts WHERE p = 'segment' AND o NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')
  UNION ALL SELECT '04-Order-status-dtype' FROM facts WHERE p = 'status' UNION ALL SELECT '04-Order-status-values' FROM facts WHERE p = 'status' AND o NOT IN ('F', 'O')
  UNION ALL SELECT '05-Order-customer-cls' FROM facts WHERE p = 'customer') GROUP BY rule""", "facts"))
def d16(spark, d):
    return r.violations_by_rule(r.report(v.facts(spark, d), rule_df(spark)))
