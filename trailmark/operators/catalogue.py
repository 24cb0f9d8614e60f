"""Queries over facts and typed rows: patterns, facets, paths, descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iri_tail
from ..functions.time import weekday_of
from ..sources.facts import TYPE
from .energy import settled

NO_TOUR, NO_DATE = "sem-passeio", "sem-data"


def match_pattern(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.filter(F.col(name) == value)
    return triples


def class_union(triples: DataFrame, classes: Sequence[str]) -> DataFrame:
    return triples.filter((F.col("p") == TYPE) & F.col("o").isin(*classes)).select("s", F.col("o").alias("kind")).distinct()


def optional_attr(df: DataFrame, triples: DataFrame, p: str, name: str, subject: str = "s") -> DataFrame:
    values = triples.filter(F.col("p") == p).select(F.col("s").alias(subject), F.col("o").alias(name))
    return df.join(values, subject, "left")


def facet_values(media: DataFrame, facets: dict[str, Sequence[str]]) -> DataFrame:
    """Array column to the values of which it has to hold any; an empty list sets no condition."""
    for column, values in facets.items():
        if values:
            media = media.filter(F.arrays_overlap(column, F.array(*map(F.lit, values))))
    return media


def facet_date_range(media: DataFrame, first: str | None, last: str | None) -> DataFrame:
    if first:
        media = media.filter(F.col("date_ts") >= F.lit(f"{first} 00:00:00").cast("timestamp_ntz"))
    if last:
        media = media.filter(F.col("date_ts") <= F.lit(f"{last} 23:59:59").cast("timestamp_ntz"))
    return media


def facet_energy_range(media: DataFrame, tours: DataFrame, least: float | None, most: float | None) -> DataFrame:
    """media (m, tour); tours (tour, energy)."""
    if least is None and most is None:
        return media
    e = tours.select("tour", "energy").filter(F.col("energy").isNotNull())
    if least is not None:
        e = e.filter(F.col("energy") >= least)
    if most is not None:
        e = e.filter(F.col("energy") <= most)
    return media.join(e.select("tour"), "tour", "left_semi")


def facet_weekday(media: DataFrame, days: Sequence[int]) -> DataFrame:
    return media if len(set(days)) in (0, 7) else media.filter(weekday_of(F.col("date_lex")).isin(*days))


def group_key(mode: str) -> Column:
    """The group of a media row (tour, date_lex)."""
    if mode == "tour":
        return F.coalesce("tour", F.lit(NO_TOUR))
    cut = {"year": 4, "month": 7, "day": 10}.get(mode)
    return F.coalesce(F.substring("date_lex", 1, cut), F.lit(NO_DATE)) if cut else F.lit("")


def faceted_query(media: DataFrame, tours: DataFrame, *, lists=(), authors=(), first=None, last=None, least=None, most=None, days=(), mode="month") -> DataFrame:
    """(m, grp, date_lex): distinct, newest first, undated last. Facets combine by AND, values by OR."""
    m = facet_values(media, {"lists": lists, "authors": authors})
    m = facet_weekday(facet_date_range(m, first, last), days)
    m = m.select("m", "date_lex", F.explode_outer("tours").alias("tour"))
    m = facet_energy_range(m, tours, least, most)
    return m.select("m", group_key(mode).alias("grp"), "date_lex").distinct().orderBy(F.desc_nulls_last("date_lex"), "m")


def list_members(triples: DataFrame, list_iri: str, predicate: str = "inList") -> DataFrame:
    return match_pattern(triples, p=predicate, o=list_iri).select(F.col("s").alias("m")).distinct()


def path_join(triples: DataFrame, p1: str, p2: str, inverse_first: bool = False) -> DataFrame:
    """(s, o) of the path p1/p2, or ^p1/p2."""
    a, b = ("o", "s") if inverse_first else ("s", "o")
    first = triples.filter(F.col("p") == p1).select(F.col(a).alias("s"), F.col(b).alias("via"))
    second = triples.filter(F.col("p") == p2).select(F.col("s").alias("via"), "o")
    return first.join(second, "via").select("s", "o").distinct()


def derived_subjects(triples: DataFrame, roots: DataFrame) -> DataFrame:
    """Subjects whose name is a root's and a role, by equality of the parent."""
    return triples.join(roots.select(F.col("s").alias("s_parent")), "s_parent", "left_semi").select("s").distinct()


def describe(triples: DataFrame, roots: DataFrame) -> DataFrame:
    """Facts of the roots, of nodes derived from them, and of blank nodes that these point to."""
    subjects = roots.select("s").union(derived_subjects(triples, roots)).distinct()
    own = triples.join(subjects, "s", "left_semi")
    blank = own.filter(F.col("o_kind") == "bnode").select(F.col("o").alias("s")).distinct()
    return own.unionByName(triples.join(blank, "s", "left_semi")).dropDuplicates()


def rdfs_closure(triples: DataFrame, subclass: DataFrame, domain: DataFrame, range_: DataFrame, subproperty: DataFrame | None = None) -> DataFrame:
    """Facts and the types they imply. subclass (child, parent), domain (p, c), range (p, c) and
    subproperty (p, q) are the vocabulary, whose size doesn't depend on the facts."""

    def upward(pairs: DataFrame, a: str, b: str) -> DataFrame:
        # Paths double in length each round, until there are no new ones.
        reach = settled(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
        while True:
            longer = reach.alias("x").join(reach.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
            grown = settled(reach.union(longer).distinct())
            if grown.count() == reach.count():
                return reach
            reach = grown

    facts = triples.select("s", "p", "o", "o_kind")
    if subproperty is not None:
        up = upward(subproperty, "p", "q")
        facts = facts.union(facts.join(up, F.col("p") == F.col("a")).select("s", F.col("b").alias("p"), "o", "o_kind"))
    by_domain = facts.join(domain, "p").select("s", F.col("c").alias("o"))
    by_range = facts.filter(F.col("o_kind") != "literal").join(range_, "p").select(F.col("o").alias("s"), F.col("c").alias("o"))
    typed = facts.filter(F.col("p") == TYPE).select("s", "o").union(by_domain).union(by_range).distinct()
    up = upward(subclass, "child", "parent")
    types = typed.union(typed.join(up, F.col("o") == F.col("a")).select("s", F.col("b").alias("o")))
    return facts.union(types.select("s", F.lit(TYPE).alias("p"), "o", F.lit("iri").alias("o_kind"))).distinct()


def types_only(triples: DataFrame) -> DataFrame:
    return triples.filter(F.col("p") == TYPE)


def display_name(people: DataFrame) -> DataFrame:
    """people (iri, name, alt_name) to (iri, label)."""
    return people.select("iri", F.coalesce("name", "alt_name", iri_tail(F.col("iri"))).alias("label"))


def media_records(media: DataFrame, tours: DataFrame, people: DataFrame) -> DataFrame:
    """Media (m, kind, date_lex, tours, authors, lists) with tour labels, energy, author names, weekday."""
    names = display_name(people)
    label = media.select("m", F.explode_outer("authors").alias("iri")).join(names, "iri", "left").groupBy("m").agg(F.sort_array(F.collect_set("label")).alias("author_names"))
    ride = media.select("m", F.explode_outer("tours").alias("tour")).join(tours, "tour", "left").groupBy("m").agg(F.sort_array(F.collect_set("title")).alias("tour_titles"), F.max("energy").alias("energy"))
    url = F.when(F.col("kind") == "video", F.concat(F.lit("/video/"), "m")).otherwise(F.concat(F.lit("/photo/"), "m"))
    return media.join(label, "m", "left").join(ride, "m", "left").withColumn("weekday", weekday_of(F.col("date_lex"))).withColumn("url", url)


def missing_fields(rows: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """(key, missing) of rows that lack any of the fields."""
    gaps = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return rows.select(key, gaps.alias("missing")).filter(F.size("missing") > 0)


def missing_counts(missing: DataFrame) -> DataFrame:
    return missing.select(F.explode("missing").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def nonempty_reference_check(triples: DataFrame, iris: DataFrame, cls: str) -> DataFrame:
    """iris (iri) with defined, whether it is of the class, and referenced, whether any fact points to it."""
    defined = match_pattern(triples, p=TYPE, o=cls).select(F.col("s").alias("iri"), F.lit(True).alias("defined")).distinct()
    pointed = triples.filter(F.col("o_kind") != "literal").select(F.col("o").alias("iri"), F.lit(True).alias("referenced")).distinct()
    out = iris.select("iri").distinct().join(defined, "iri", "left").join(pointed, "iri", "left")
    return out.select("iri", F.coalesce("defined", F.lit(False)).alias("defined"), F.coalesce("referenced", F.lit(False)).alias("referenced"))


def resolve_edition(triples: DataFrame, keys: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """keys (series, sequence) to the tour that realises that edition; keys of legacy (old_id, tour) first."""
    edition = triples.filter(F.col("p") == "inEventSeries").select(F.col("s").alias("edition"), F.col("o").alias("series"))
    number = triples.filter(F.col("p") == "sequence").select(F.col("s").alias("edition"), F.col("o").cast("int").alias("sequence"))
    tour = triples.filter(F.col("p") == "inSeriesEdition").select(F.col("o").alias("edition"), F.col("s").alias("tour"))
    found = edition.join(number, "edition").join(tour, "edition").select("series", "sequence", "tour")
    out = keys.join(found, ["series", "sequence"], "left")
    if legacy is not None:
        old = legacy.select(F.col("old_id").alias("sequence"), F.col("tour").alias("__old"))
        out = out.join(old, "sequence", "left").withColumn("tour", F.coalesce("tour", "__old")).drop("__old")
    return out


def find_saved_route(saved: DataFrame, refs: DataFrame) -> DataFrame:
    """saved (id, slug, updated, created), refs (ref): by id first, else by slug; ties to the newest."""
    cols = [c for c in saved.columns]
    by_id = refs.join(saved, F.col("ref") == F.col("id")).select("ref", *cols, F.lit(0).alias("__how"))
    by_slug = refs.join(saved, F.col("ref") == F.col("slug")).select("ref", *cols, F.lit(1).alias("__how"))
    best = Window.partitionBy("ref").orderBy("__how", F.coalesce("updated", "created").desc_nulls_last(), "id")
    return by_id.union(by_slug).withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n", "__how")
