"""Audit, census and publication reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, contributor_of, is_local_host, is_shared_copy, media_kind, null_if_no_match, paragraphs, series_label
from ..functions.time import instant, tour_week

#: Upper limits in kJ and labels of intensity.
INTENSITY = ((150, "De boa"), (300, "Ok"), (500, "Endorfinado"), (1000, "Frito"))
INTENSE = "Insano"
SERIES_ORDER = ("PH", "BT", "BP", "S")
DEFAULT_LIST = "padrao"


def folder_rollup(files: DataFrame) -> DataFrame:
    """files (folder, subfolder, name, length, mtime): a row per folder."""
    kind, shared = media_kind(F.col("name")), is_shared_copy(F.col("name"))
    x = files.withColumns({"kind": kind, "shared": shared, "who": contributor_of(F.col("name"), F.col("subfolder"))})
    visual = F.col("kind").isin("image", "video")
    count = lambda c, n: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n)
    return x.groupBy("folder").agg(F.count("*").alias("files"), count(F.col("kind") == "image", "images"), count(F.col("kind") == "video", "videos"), count(visual & F.col("shared"), "shared"), count(visual & ~F.col("shared"), "originals"), F.sum("length").alias("bytes"), F.max("mtime").alias("last_mtime"), F.countDistinct("who").alias("contributors"))


def capture_funnel(rows: DataFrame, stages: dict[str, Sequence[str]]) -> DataFrame:
    """(stage, field, filled, total) of each field that a stage asks for."""
    pairs = [F.struct(F.lit(s).alias("stage"), F.lit(f).alias("field"), F.col(f).isNotNull().alias("ok")) for s, fs in stages.items() for f in fs]
    return rows.select(F.inline(F.array(*pairs))).groupBy("stage", "field").agg(F.count_if("ok").alias("filled"), F.count("*").alias("total"))


def tour_gaps(rows: DataFrame, fields: Sequence[str], key: str = "iri", image: str | None = "image") -> DataFrame:
    """Missing fields per row; art on a local host counts as missing."""
    lacks = lambda f: F.col(f).isNull() | (F.coalesce(is_local_host(F.col(f)), F.lit(False)) if f == image else F.lit(False))
    return rows.select(key, F.filter(F.array(*[F.when(lacks(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull()).alias("missing"))


def completeness(gaps: DataFrame, recording: str = "activities") -> DataFrame:
    rest = F.array_remove("missing", recording)
    return gaps.agg(F.count("*").alias("total"), F.count_if(F.size("missing") == 0).alias("complete"), F.count_if(F.size(rest) == 0).alias("complete_but_recording"))


def sweep_state(tours: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Never swept ?, swept and empty, or the number of files."""
    x = tours.join(sweeps.select("tour", F.col("files").alias("__f")), "tour", "left")
    return x.withColumn("state", F.when(F.col("__f").isNull(), "?").when(F.col("__f") == 0, "∅").otherwise(F.col("__f").cast("string"))).drop("__f")


def media_totals(tours: DataFrame, folders: DataFrame) -> DataFrame:
    """tours (media, swept), folders as folder_rollup(): (what, n)."""
    a = tours.agg(F.count_if(F.col("media") > 0).alias("tours_with_media"), F.count_if(F.col("swept").isNotNull()).alias("tours_swept"))
    b = folders.agg(F.sum("files").alias("files"), F.sum("shared").alias("shared"), F.sum("originals").alias("originals"), F.sum("bytes").alias("bytes"))
    tall = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("long").alias("n")) for c in df.columns])))
    return tall(a).union(tall(b))


def contributor_counts(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """files (name, subfolder), resolved (handle, person): (handle, n, person, state), most first."""
    n = files.select(contributor_of(F.col("name"), F.col("subfolder")).alias("handle")).filter("handle is not null").groupBy("handle").agg(F.count("*").alias("n"))
    return n.join(resolved, "handle", "left").withColumn("state", F.when(F.col("person").isNull(), "pending").otherwise("resolved")).orderBy(F.desc("n"), "handle")


def audit_matrix(tours: DataFrame, fields: Sequence[str], extra: DataFrame | None = None, key: str = "tour") -> DataFrame:
    x = tours.select(key, *[F.col(f).isNotNull().alias(f) for f in fields])
    return x.join(extra, key, "left") if extra is not None else x


def census_derived(c: DataFrame) -> DataFrame:
    """c (kj, moving_s, total_s, people) with what follows from these."""
    return c.withColumns({"mean_power": F.try_divide(F.col("kj") * 1000, F.col("moving_s")), "pct_moving": F.try_divide(100 * F.col("moving_s"), F.col("total_s")), "collective_kj": F.col("kj") * F.col("people"), "litres": F.col("kj") / 32_000, "collective_total_s": F.col("total_s") * F.col("people"), "collective_moving_s": F.col("moving_s") * F.col("people")})


def tour_display_stats(t: DataFrame) -> DataFrame:
    """t (departed_s, arrived_s, moving_s, planned, measured, attendees, newcomers)."""
    people = F.when(F.col("attendees") > 0, F.col("attendees"))
    elapsed = F.when(F.col("arrived_s") > F.col("departed_s"), F.col("arrived_s") - F.col("departed_s"))
    energy = F.coalesce("measured", "planned")
    return t.withColumns({"elapsed_s": elapsed, "vs_plan_pct": F.when(F.col("planned") > 0, 100 * F.col("measured") / F.col("planned") - 100), "people": people, "new_people": F.when(people.isNotNull(), F.col("newcomers")), "collective_kj": energy * people, "collective_s": elapsed * people})


def intensity(kj: Column) -> Column:
    out = F.when(kj.isNull(), F.lit(None).cast("string"))
    for limit, label in INTENSITY:
        out = out.when(kj < limit, label)
    return out.otherwise(INTENSE)


def series_numbers(editions: DataFrame, how: str = "card") -> DataFrame:
    """editions (tour, code, seq, at: order of appearance) to (tour, label). card: by SERIES_ORDER, one per series;
    title: the highest number first; gallery and timeline: by code."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SERIES_ORDER)), F.col("code")), F.lit(0))
    rank = F.when(rank > 0, rank).otherwise(len(SERIES_ORDER) + 1)
    text = F.concat_ws(" ", series_label(F.col("code")), F.col("seq").cast("string"))
    if how == "card":
        one = editions.groupBy("tour", "code").agg(F.min_by("seq", "at").alias("seq"), F.min("at").alias("at"))
        items = F.sort_array(F.collect_list(F.struct(rank.alias("a"), F.col("at").cast("long").alias("b"), text.alias("x"))))
        return one.groupBy("tour").agg(F.array_join(F.transform(items, lambda s: s["x"]), " ").alias("label"))
    key = -F.col("seq") if how == "title" else F.col("code")
    items = F.sort_array(F.collect_list(F.struct(key.alias("a"), text.alias("x"))))
    return editions.groupBy("tour").agg(F.array_join(F.transform(items, lambda s: s["x"]), " + ").alias("label"))


def timeline(tours: DataFrame, media: DataFrame) -> DataFrame:
    """tours (tour, date_lex), media (tour, m, date_lex, lists): tours by date, the first of each year marked,
    with their media, default list first and then by time, and both counts."""
    first = F.when(F.array_contains("lists", DEFAULT_LIST), 0).otherwise(1)
    items = F.sort_array(F.collect_list(F.struct(first.alias("a"), F.coalesce("date_lex", F.lit("9999")).alias("b"), F.col("m").alias("m"))))
    m = media.groupBy("tour").agg(F.transform(items, lambda s: s["m"]).alias("media"), F.count_if(first == 0).alias("n_default"), F.count("*").alias("n_all"))
    # One row per year as written; bad dates may make them many, so Spark measures before it broadcasts.
    year = F.substring("date_lex", 1, 4)
    starts = tours.groupBy(year.alias("year")).agg(F.min(F.struct("date_lex", "tour")).alias("x")).select("year", F.col("x.tour").alias("first_tour"))
    x = tours.withColumn("year", year).join(starts, "year", "left").withColumn("year_break", F.col("tour") == F.col("first_tour")).drop("first_tour")
    return x.join(m, "tour", "left").fillna(0, ["n_default", "n_all"]).orderBy("date_lex", "tour")


def feed(tours: DataFrame, people: DataFrame, n: int = 50) -> DataFrame:
    """tours (tour, title, date_lex, instagram, description, energy, authors): the newest with link, guid, summary
    and author names."""
    top = tours.withColumn("at", instant(F.col("date_lex"), "+00:00")).orderBy(F.desc_nulls_last("at"), "tour").limit(n)
    names = top.select("tour", F.explode("authors").alias("iri")).join(people, "iri", "left").groupBy("tour").agg(F.sort_array(F.collect_set("label")).alias("author_names"))
    out = top.join(names, "tour", "left").withColumns({"link": F.coalesce("instagram", F.concat(F.lit("/tour/"), "tour")), "guid": F.concat(F.lit("tour:"), "tour"), "summary": tour_summary(F.col("description"), F.col("date_lex"), F.col("energy"))})
    return out.select("tour", "title", "link", "guid", "summary", "author_names", "at")


def sitemap(tours: DataFrame, now: Column) -> DataFrame:
    """Home, timeline and a row per tour; news if its date has an offset and is within two days of now."""
    spark = tours.sparkSession
    fixed = spark.createDataFrame([("/", False), ("/timeline", False)], "loc string, news boolean")
    zoned = F.col("date_lex").rlike(r"(Z|[+-]\d{2}:\d{2})$")
    near = F.abs(F.unix_timestamp(now) - F.unix_timestamp(instant(F.col("date_lex")))) < 48 * 3600
    return fixed.union(tours.select(F.concat(F.lit("/tour/"), "tour"), F.coalesce(zoned & near, F.lit(False))))


def series_page(editions: DataFrame, series: str) -> DataFrame:
    """editions (series, seq as written, tour): one series, the highest number first; a bad number is 0."""
    n = F.coalesce(F.col("seq").try_cast("int"), F.lit(0))
    return editions.filter(F.col("series") == series).select(n.alias("seq"), "tour").orderBy(F.desc("seq"), "tour")


def tour_summary(description: Column, date_lex: Column, energy: Column) -> Column:
    """The first paragraph, cut to 197 characters and an ellipsis beyond 200; else date and energy; null without any."""
    p = F.get(paragraphs(description), F.lit(0))
    cut = F.when(F.length(p) > 200, F.concat(F.rtrim(F.substring(p, 1, 197), F.lit(SPACES)), F.lit("…"))).otherwise(p)
    return F.coalesce(cut, null_if_no_match(F.concat_ws(" · ", F.substring(date_lex, 1, 10), F.concat(F.round(energy, 0).cast("long").cast("string"), F.lit(" kJ")))))


def weekly_cost(days: DataFrame, rate: float = 100.0, subscription: float = 20.0, fixed: float = 5.0) -> DataFrame:
    """days (day, commits) to a row per week from the first to the last, empty ones too: days worked, commits,
    hours by tier (six commits a day and more: 6 h, two: 3 h, one: 1 h), labour, fixed and total cost."""
    hours = F.when(F.col("commits") >= 6, 6.0).when(F.col("commits") >= 2, 3.0).when(F.col("commits") >= 1, 1.0).otherwise(0.0)
    w = days.groupBy(tour_week(F.col("day")).alias("week")).agg(F.count_if(F.col("commits") > 0).alias("days"), F.sum("commits").alias("commits"), F.sum(hours).alias("hours"))
    span = w.agg(F.min("week").alias("a"), F.max("week").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    x = span.join(w, "week", "left").fillna(0, ["days", "commits", "hours"])
    cost = x.withColumns({"labour": F.col("hours") * rate, "fixed": F.lit(subscription * 12 / 52 + fixed)})
    return cost.withColumn("total", F.col("labour") + F.col("fixed"))


def weekly_totals(weeks: DataFrame) -> DataFrame:
    return weeks.rollup("week").agg(*[F.sum(c).alias(c) for c in ("days", "commits", "hours", "labour", "fixed", "total")])


def class_counts(triples: DataFrame) -> DataFrame:
    return triples.filter(F.col("p") == "rdf:type").groupBy("dump", F.col("o").alias("cls")).agg(F.countDistinct("s").alias("n"))


def dump_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("dump").agg(F.count("*").alias("n"))


def list_sizes(triples: DataFrame, p: str = "inList") -> DataFrame:
    return triples.filter(F.col("p") == p).groupBy(F.col("o").alias("list")).agg(F.countDistinct("s").alias("n"))


def match_report(matches: DataFrame) -> DataFrame:
    """matches (how, fields, reasons) to (what, n): outcomes, writes per field, reasons to review."""
    out = matches.groupBy(F.concat(F.lit("how:"), "how").alias("what")).agg(F.count("*").alias("n"))
    each = lambda c, p: matches.select(F.explode(c).alias("x")).groupBy(F.concat(F.lit(p), "x").alias("what")).agg(F.count("*").alias("n"))
    return out.union(each("fields", "write:")).union(each("reasons", "review:"))


def ingest_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.when(F.col("person").isNull(), F.col("handle")))).alias("handles_without_person"))


def saved_route_summary(routes: DataFrame) -> DataFrame:
    """routes (id, dist_m, ascent_m, kj): one line each, without what isn't known."""
    km = F.format_string("%.1f km", F.col("dist_m") / 1000)
    climb = F.format_string("%d m", F.round("ascent_m", 0).cast("long"))
    kj = F.format_string("%d kJ (%s)", F.round("kj", 0).cast("long"), intensity(F.col("kj")))
    return routes.select("id", F.concat_ws(" · ", F.when(F.col("dist_m").isNotNull(), km), F.when(F.col("ascent_m").isNotNull(), climb), F.when(F.col("kj").isNotNull(), kj)).alias("summary"))


def saved_route_list(routes: DataFrame) -> DataFrame:
    """routes (id, slug, updated, created, ...): the newest first."""
    return routes.withColumn("at", F.coalesce("updated", "created")).orderBy(F.desc_nulls_last("at"), "id")
