"""Queries as a user of SQL writes them, over the registered views; each gives the rows of an operator's query."""

from __future__ import annotations

from ..sources import surface
from . import views as v
from .registry import SQL, query

TABLES = {"triples": v.facts, "media": v.media, "tours": v.tours, "fixes": v.fixes, "cells": v.cells, "roads": v.roads}

#: Name, views, the query whose rows they are, and the text.
TEXTS = {
    "sql_faceted_query": (
        ("media", "tours"),
        "b9_faceted_query",
        """SELECT DISTINCT m, substring(date_lex, 1, 7) AS grp, date_lex
        FROM (SELECT *, explode(tours) AS tour FROM media) JOIN tours USING (tour)
        WHERE arrays_overlap(lists, array('2-HIGH', '3-MEDIUM', '5-LOW')) AND date_lex BETWEEN '1995-06-01T00:00:00' AND '1999-12-31T23:59:59'
          AND energy BETWEEN 0 AND 5000 AND weekday_of(date_lex) IN (0, 1, 2, 5, 6)""",
    ),
    "sql_path_join": (("triples",), "b11_path_join", "SELECT DISTINCT a.s, b.o FROM triples a JOIN triples b ON a.o = b.s WHERE a.p = 'customer' AND b.p = 'nation'"),
    "sql_class_counts": (("triples",), "h19_class_counts", "SELECT dump, o AS cls, count(DISTINCT s) AS n FROM triples WHERE p = 'rdf:type' GROUP BY dump, o"),
    "sql_distances": (
        ("fixes",),
        "f1_haversine",
        "SELECT trip, seq, round(coalesce(haversine_m(lag(lat) OVER w, lag(lng) OVER w, lat, lng), 0), 3) AS d FROM fixes WINDOW w AS (PARTITION BY trip ORDER BY seq)",
    ),
    "sql_half_edges": (
        ("roads",),
        "g15_half_edges",
        "SELECT src, dst, edge, a_to_b, cost FROM roads LATERAL VIEW stack(2, a, b, true, cost_ab, b, a, false, cost_ba) x AS src, dst, a_to_b, cost",
    ),
    "sql_max_edge_cost": (
        ("cells",),
        "r12_max_edge_cost",
        "SELECT round((leg_energy(sqrt(1800D), 0) + 0.95D * rise) * 1.001D, 6) AS most FROM (SELECT max(h) - min(h) AS rise FROM cells WHERE mask)",
    ),
}


def _text(views: tuple[str, ...], text: str):
    def run(spark, sf_dir):
        surface.register(spark, **{name: TABLES[name](spark, sf_dir) for name in views})
        return spark.sql(text)

    return run


for _name, (_views, _like, _sql) in TEXTS.items():
    query(_name, SQL[_like])(_text(_views, _sql))


@query("sql_text_keys", SQL["s1_text_keys"])
def text_keys(spark, d):
    surface.register(spark)
    text = "SELECT page_id, norm_key(url) AS norm, route_slug(url) AS slug, iri_tail(url) AS tail, stem_hash(url) AS stem_hash, is_hash16(url) AS is_hash, is_local_host(url) AS local FROM {pages}"
    return spark.sql(text, pages=v.table(spark, d, "pages"))
