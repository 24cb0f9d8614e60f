"""Changes to a set of facts, each a batch job from facts to facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LOCAL_HOST
from ..scratch import settled
from ..sources.facts import ROLES, TYPE, parent_of, parts

BASE32 = "0123456789abcdefghjkmnpqrstvwxyz"


def doomed(triples: DataFrame, roots: DataFrame) -> DataFrame:
    """Subjects that go with the roots: these, nodes derived from them, blank nodes they point to."""
    own = roots.select("s").distinct()
    derived = triples.join(own.select(F.col("s").alias("s_parent")), "s_parent", "left_semi").select("s")
    named = own.union(derived).distinct()
    blank = triples.filter(F.col("o_kind") == "bnode").join(named, "s", "left_semi").select(F.col("o").alias("s"))
    return named.union(blank).distinct()


def purge(triples: DataFrame, roots: DataFrame) -> DataFrame:
    return triples.join(doomed(triples, roots), "s", "left_anti").select(triples.columns)


def removed_count(triples: DataFrame, roots: DataFrame) -> DataFrame:
    return triples.join(doomed(triples, roots), "s", "left_semi").agg(F.count("*").alias("removed"))


def upsert(triples: DataFrame, docs: DataFrame) -> DataFrame:
    """docs replace what is known of their subjects."""
    roots = docs.filter(F.col("s_parent").isNull()).select("s").distinct()
    return purge(triples, roots).unionByName(docs).dropDuplicates()


def merge_patch(triples: DataFrame, patch: DataFrame, removes: DataFrame | None = None) -> DataFrame:
    """Facts of a predicate that the patch asserts, or removes (s, p) names, give way, with the derived
    node they point to; all others stay."""
    keys = patch.filter(F.col("s_parent").isNull()).select("s", "p")
    if removes is not None:
        keys = keys.union(removes.select("s", "p"))
    keys = keys.distinct()
    node = triples.join(keys, ["s", "p"], "left_semi").filter(F.col("o_kind") != "literal").select("s", F.col("o").alias("node"))
    node = node.filter(parent_of(F.col("node")).eqNullSafe(F.col("s"))).select(F.col("node").alias("s")).distinct()
    return triples.join(keys, ["s", "p"], "left_anti").join(node, "s", "left_anti").select(triples.columns).unionByName(patch).dropDuplicates()


def expand_curies(removes: DataFrame, prefixes: Mapping[str, Sequence[str]]) -> DataFrame:
    """(doc, curies separated by blanks) to (doc, p); a prefix may stand for several namespaces, an unknown
    one is an error."""
    table = F.create_map(*[x for k, v in prefixes.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    one = removes.select("doc", F.explode(F.split(F.trim("curies"), r"\s+")).alias("c")).filter("c != ''")
    prefix, name = F.substring_index("c", ":", 1), F.regexp_extract("c", "^[^:]*:(.*)$", 1)
    spaces = F.coalesce(F.element_at(table, prefix), F.raise_error(F.concat(F.lit("unknown prefix in "), "c")).cast("array<string>"))
    return one.select("doc", F.explode(F.transform(spaces, lambda ns: F.concat(ns, name))).alias("p"))


def patch_diff(orig: DataFrame, edited: DataFrame, key: str, fields: Sequence[str], never_removed: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Changed values as (key, p, o), and (key, p) of emptied ones."""
    tall = lambda df, name: df.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("p"), F.col(f).cast("string").alias(name)) for f in fields])))
    both = tall(orig, "was").join(tall(edited, "now"), [key, "p"], "right")
    changed = both.filter(F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("was"))).select(key, "p", F.col("now").alias("o"))
    gone = both.filter(F.col("now").isNull() & F.col("was").isNotNull() & ~F.col("p").isin(*never_removed, "")).select(key, "p")
    return changed, gone


def route_by_class(triples: DataFrame, cls: str, target: str) -> DataFrame:
    """Definitions of a class move to the target dump; references stay where they are."""
    n = parts(triples)
    moved = triples.filter((F.col("p") == TYPE) & (F.col("o") == cls)).select("s").repartition(n, "s").distinct().withColumn("__m", F.lit(True))
    return triples.repartition(n, "s").join(moved, "s", "left").withColumn("dump", F.when(F.col("__m"), F.lit(target)).otherwise(F.col("dump"))).drop("__m").select(triples.columns).dropDuplicates()


def assign_lists(triples: DataFrame, media: DataFrame, add: Sequence[str], remove: Sequence[str], known: Sequence[str], dump: str = "lists", p: str = "inList") -> DataFrame:
    """Lists added to and removed from the given media (s); media without facts are skipped."""
    if unknown := (set(add) | set(remove)) - set(known):
        raise ValueError(f"undeclared lists: {sorted(unknown)}")
    there = media.select("s").distinct().join(triples.select("s").distinct(), "s", "left_semi")
    gone = there.select("s", F.lit(p).alias("p"), F.explode(F.array(*map(F.lit, remove)).cast("array<string>")).alias("o"))
    new = there.select(F.lit(dump).alias("dump"), "s", F.lit(p).alias("p"), F.explode(F.array(*map(F.lit, add)).cast("array<string>")).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dtype"), F.lit(None).cast("string").alias("o_lang"), parent_of(F.col("s")).alias("s_parent"))
    rest = triples.join(gone, ["s", "p", "o"], "left_anti").select(triples.columns)
    return rest.unionByName(new.join(rest, ["s", "p", "o"], "left_anti").select(triples.columns)).dropDuplicates()


def replace_person_fields(triples: DataFrame, edits: DataFrame, fields: Sequence[str] = ("name", "alternateName", "url", "seeAlso")) -> DataFrame:
    """The four fields of each edited person are replaced, type and page stay; a person that is only
    referenced becomes defined."""
    edits = edits.filter(F.col("p").isin(*fields, TYPE))
    who = edits.select("s").distinct()
    kept = triples.join(who.withColumn("__e", F.lit(True)), "s", "left").filter(F.col("__e").isNull() | ~F.col("p").isin(*fields)).drop("__e").select(triples.columns)
    return kept.unionByName(edits).dropDuplicates()


def delete_keep_refs(triples: DataFrame, routes: DataFrame, tours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tours and their derived nodes go, and their routes; people, series and editions stay."""
    return purge(triples, tours), routes.join(tours.select(F.col("s").alias("tour_iri")), "tour_iri", "left_anti")


def remap_iris(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping (old, new) applies to subjects and objects, and to nodes derived from old ones."""
    suffix = rf"(_(?:{'|'.join(ROLES)}))?$"

    def mapped(df: DataFrame, c: str) -> DataFrame:
        stem, tail = F.regexp_replace(F.col(c), suffix, ""), F.regexp_extract(F.col(c), suffix, 1)
        m = mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
        return df.withColumn("__stem", stem).withColumn("__tail", tail).join(m, F.col("__stem") == F.col("__old"), "left").withColumn(c, F.coalesce(F.concat("__new", "__tail"), F.col(c))).drop("__stem", "__tail", "__old", "__new")

    literal = triples.filter(F.col("o_kind") == "literal")
    linked = mapped(triples.filter(F.col("o_kind") != "literal"), "o")
    out = mapped(linked.select(triples.columns).unionByName(literal), "s").withColumn("s_parent", parent_of(F.col("s")))
    return out.select(triples.columns).dropDuplicates()


def remap_prefix(triples: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Names that start with an old prefix get the new one."""
    def fix(c: Column) -> Column:
        out = c
        for old, new in rules.items():
            out = F.when(c.startswith(old), F.concat(F.lit(new), F.substr(c, F.lit(len(old) + 1)))).otherwise(out)
        return out

    o = F.when(F.col("o_kind") == "literal", F.col("o")).otherwise(fix(F.col("o")))
    return triples.withColumns({"s": fix(F.col("s")), "o": o}).withColumn("s_parent", parent_of(F.col("s"))).dropDuplicates()


def remap_stats(before: DataFrame, after: DataFrame, old_prefix: str) -> DataFrame:
    """(what, n): names that the change removed, and facts that still have the old prefix."""
    left = F.col("s").startswith(old_prefix) | ((F.col("o_kind") != "literal") & F.col("o").startswith(old_prefix))
    gone = before.select("s").distinct().join(after.select("s"), "s", "left_anti")
    return gone.agg(F.lit("changed").alias("what"), F.count("*").alias("n")).union(after.filter(left).agg(F.lit("leftovers"), F.count("*")))


def skolemise_bnodes(triples: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Blank objects of a role's predicate become <parent>_<role>."""
    role = F.element_at(F.create_map(*[F.lit(x) for kv in roles.items() for x in kv]), F.col("p"))
    names = triples.filter((F.col("o_kind") == "bnode") & role.isNotNull()).select(F.col("o").alias("old"), F.concat_ws("_", "s", role).alias("new")).groupBy("old").agg(F.min("new").alias("new"))
    o = names.withColumnsRenamed({"old": "__o", "new": "__on"})
    s = names.withColumnsRenamed({"old": "__s", "new": "__sn"})
    blank = F.col("o_kind") == "bnode"
    renamed = triples.filter(blank).join(o, F.col("o") == F.col("__o"), "left").unionByName(triples.filter(~F.coalesce(blank, F.lit(False))), True)
    n = parts(triples)
    out = renamed.repartition(n, "s").join(s, F.col("s") == F.col("__s"), "left")
    out = out.withColumn("o_kind", F.when(F.col("__on").isNotNull(), "iri").otherwise(F.col("o_kind"))).withColumn("o", F.coalesce("__on", "o")).withColumn("s", F.coalesce("__sn", "s"))
    return out.withColumn("s_parent", parent_of(F.col("s"))).select(triples.columns).repartition(n, "s").dropDuplicates()


def retype(triples: DataFrame, classes: Mapping[str, str]) -> DataFrame:
    new = F.element_at(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]), F.col("o"))
    return triples.withColumn("o", F.when(F.col("p") == TYPE, F.coalesce(new, F.col("o"))).otherwise(F.col("o"))).dropDuplicates()


def split_by_class(triples: DataFrame, dump_of: Mapping[str, str], orphan: str = "orphans") -> DataFrame:
    """Facts with the dump of their subject: by its class, else its parent's, else (blank nodes) that of
    the subject that points to it, round by round until no more are placed."""
    dump = F.element_at(F.create_map(*[F.lit(x) for kv in dump_of.items() for x in kv]), F.col("o"))
    placed = triples.filter(F.col("p") == TYPE).select("s", dump.alias("__d")).groupBy("s").agg(F.min("__d").alias("__d")).filter("__d is not null")
    parents = triples.filter("s_parent is not null").select("s", "s_parent").distinct().join(placed.withColumnRenamed("s", "s_parent"), "s_parent").select("s", "__d")
    placed = placed.union(parents.join(placed, "s", "left_anti"))
    links = settled(triples.filter(F.col("o_kind") == "bnode").select("s", F.col("o").alias("b")).distinct())
    placed = settled(placed)
    while True:
        more = settled(links.join(placed, "s").select(F.col("b").alias("s"), "__d").groupBy("s").agg(F.min("__d").alias("__d")).join(placed, "s", "left_anti"))
        if not more.limit(1).count():
            break
        placed = settled(placed.union(more))
    return triples.join(placed, "s", "left").withColumn("dump", F.coalesce("__d", F.lit(orphan))).select(triples.columns)


def collapse_associations(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes named ...assoc_<series>_<n> become edition/<series>/<n>; and editions of more than one tour."""
    pattern = r"assoc_([A-Za-z]+)_(\d+)$"
    fix = lambda c: F.when(c.rlike(pattern), F.concat(F.lit("edition/"), F.regexp_extract(c, pattern, 1), F.lit("/"), F.regexp_extract(c, pattern, 2))).otherwise(c)
    out = triples.withColumns({"s": fix(F.col("s")), "o": F.when(F.col("o_kind") == "literal", F.col("o")).otherwise(fix(F.col("o")))}).dropDuplicates()
    shared = out.filter(F.col("p") == "inSeriesEdition").groupBy(F.col("o").alias("edition")).agg(F.countDistinct("s").alias("tours")).filter("tours > 1")
    return out, shared


def add_type(triples: DataFrame, having: str, cls: str) -> DataFrame:
    """A further type for subjects that have a predicate; those that have it already stay as they are."""
    who = triples.filter(F.col("p") == having).select("s").distinct()
    new = triples.join(who, "s", "left_semi").filter(F.col("p") == TYPE).dropDuplicates(["dump", "s"]).withColumn("o", F.lit(cls))
    return triples.unionByName(new.select(triples.columns)).dropDuplicates()


def add_all_to_list(triples: DataFrame, cls: str, list_iri: str, p: str = "inList") -> DataFrame:
    new = triples.filter((F.col("p") == TYPE) & (F.col("o") == cls)).withColumns({"p": F.lit(p), "o": F.lit(list_iri)})
    return triples.unionByName(new).dropDuplicates()


def fix_local_hosts(triples: DataFrame, base: str, assets: str = "assets/") -> DataFrame:
    """Names on local hosts get the public base before their asset path; without one they stay."""
    path = F.regexp_extract("o", rf"({assets}.*)$", 1)
    return triples.withColumn("o", F.when(F.col("o").rlike(LOCAL_HOST) & (path != ""), F.concat(F.lit(base), path)).otherwise(F.col("o")))


def normalise_datatype(triples: DataFrame, was: str = "xsd:positiveInteger", now: str = "xsd:integer") -> DataFrame:
    return triples.withColumn("o_dtype", F.when(F.col("o_dtype") == was, now).otherwise(F.col("o_dtype"))).dropDuplicates()


def mint_slugs(keys: DataFrame, known: DataFrame, length: int = 8) -> DataFrame:
    """known (key, slug) and a slug of `length` base-32 characters for each new key, by hash: the same in
    every run, unique against the known ones and each other. In a round each key left has five offers and takes
    the first that nobody else claims."""
    left = keys.select("key").filter("key is not null").distinct().join(known, "key", "left_anti")
    done = known.select("key", "slug")
    digits = F.array(*map(F.lit, BASE32))

    def slug(tries: Column) -> Column:
        h = F.xxhash64("key", tries)
        return F.concat(*[F.element_at(digits, F.shiftrightunsigned(h, 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1) for k in range(length)])

    for n in count(0, 5):
        offers = left.select("key", F.posexplode(F.array(*[slug(F.lit(n + k)) for k in range(5)])).alias("n", "slug"))
        free = offers.join(done.select("slug"), "slug", "left_anti")
        first = free.withColumn("__c", F.row_number().over(Window.partitionBy("slug").orderBy("n", "key"))).filter("__c = 1")
        done = settled(done.unionByName(first.groupBy("key").agg(F.min_by("slug", "n").alias("slug"))))
        left = left.join(done, "key", "left_anti")
        if not left.limit(1).count():
            return done
        if left.count() + done.count() > 32**length:
            raise ValueError("there are more keys than slugs of this length")


def conservation_check(before: DataFrame, after: DataFrame, old_prefix: str) -> DataFrame:
    """(rule, violations): facts lost, facts gained, names left in the old namespace."""
    keys = ["s", "p", "o"]
    n = lambda df, name: df.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
    return n(before.select(*keys).exceptAll(after.select(*keys)), "lost").union(n(after.select(*keys).exceptAll(before.select(*keys)), "gained")).union(n(after.filter(F.col("s").startswith(old_prefix)), "leftover"))


def three_way_verdict(src: DataFrame, dst: DataFrame, base: DataFrame) -> DataFrame:
    """(name, digest) three times to (name, verdict): insync, ok to overwrite, or conflict."""
    r = lambda df, c: df.select("name", F.col("digest").alias(c))
    all_ = r(src, "a").join(r(dst, "b"), "name", "full").join(r(base, "c"), "name", "left")
    verdict = F.when(F.col("a").isNull(), "conflict").when(F.col("b").isNull(), "ok").when(F.col("a") == F.col("b"), "insync").when(F.col("b") == F.col("c"), "ok").otherwise("conflict")
    return all_.select("name", verdict.alias("verdict"))


def upsert_routes(routes: DataFrame, meta: DataFrame, fetched: DataFrame) -> DataFrame:
    """One entry per tour with what became of it. routes and fetched have geometry; meta (tour_iri, id,
    title): no id removes, the same id keeps its geometry, a failed fetch keeps the old one of that id."""
    old = routes.select("tour_iri", F.col("id").alias("old_id"), F.col("title").alias("old_title"), F.col("geometry").alias("old_geometry"))
    new = fetched.select(F.col("id"), F.col("geometry").alias("new_geometry")).dropDuplicates(["id"])
    all_ = meta.join(old, "tour_iri", "full").join(new, "id", "left")
    same = F.col("id").eqNullSafe(F.col("old_id"))
    geometry = F.when(same & F.col("old_geometry").isNotNull(), F.col("old_geometry")).otherwise(F.col("new_geometry"))
    status = (
        F.when(F.col("id").isNull(), "removed")
        .when(same & F.col("title").eqNullSafe(F.col("old_title")) & geometry.eqNullSafe(F.col("old_geometry")), "unchanged")
        .when(same, "metadata")
        .when(geometry.isNull(), "failed")
        .when(F.col("old_id").isNull(), "added")
        .otherwise("replaced")
    )
    return all_.select("tour_iri", "id", "title", geometry.alias("geometry"), status.alias("status"))


def routes_depending_on(triples: DataFrame, slugs: DataFrame, p: str = "routeUrl") -> DataFrame:
    slug = F.regexp_extract("o", r"/route/([a-z0-9-]+)/?$", 1)
    return triples.filter(F.col("p") == p).select(F.coalesce("s_parent", "s").alias("tour"), slug.alias("slug")).join(slugs, "slug", "left_semi").distinct()


def save_route_upsert(saved: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """saved and batch (id, slug, name, created, updated, distance): by id; and the batch rows whose slug
    another id has, saved or smaller and in the same batch. Of an id's rows in a batch the last updated one counts,
    of those the one with the largest slug, name and distance."""
    latest = Window.partitionBy("id").orderBy(*[F.desc_nulls_last(c) for c in ("updated", "slug", "name", "distance")])
    batch = batch.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n")
    other = saved.select(F.col("id").alias("__id"), "slug").union(batch.groupBy("slug").agg(F.min("id").alias("__id")).select("__id", "slug"))
    conflicts = batch.join(other, "slug").filter("id != __id").drop("__id").distinct()
    ok = batch.join(conflicts.select("id"), "id", "left_anti")
    old = saved.select("id", F.col("created").alias("__c"))
    finite = F.when(F.col("distance").isNotNull() & ~F.isnan("distance") & (F.abs("distance") < float("inf")), F.round("distance", 1))
    new = ok.join(old, "id", "left").withColumns({"created": F.coalesce("__c", "created", now), "updated": now, "distance": finite}).select(saved.columns)
    return saved.join(new, "id", "left_anti").select(saved.columns).unionByName(new), conflicts


def build_sweep_patch(tours: DataFrame, folders: DataFrame) -> DataFrame:
    """tours (tour, swept) and folders (tour, files): sweeps of archives whose count isn't recorded."""
    return tours.join(folders, "tour").filter((F.col("files") > 0) & ~F.col("swept").eqNullSafe(F.col("files"))).select(F.concat("tour", F.lit("_sweep")).alias("s"), F.lit("fileCount").alias("p"), F.col("files").cast("string").alias("o"))


def attach_provenance(triples: DataFrame, accepted: DataFrame, now: Column, dump: str = "images") -> DataFrame:
    """An upload activity per accepted media (s); what older ones generated the same media goes."""
    old = triples.filter(F.col("p") == "generated").join(accepted.select(F.col("s").alias("o")), "o", "left_semi").select("s").distinct()
    act = F.concat(F.lit("upload/"), F.substring(F.md5(F.concat_ws("|", "s", now.cast("string"))), 1, 16))
    null = F.lit(None).cast("string")
    fact = lambda p, o, kind, dtype: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), (F.lit(dtype) if dtype else null).alias("o_dtype"))
    rows = F.array(fact(TYPE, F.lit("Activity"), "iri", None), fact("startedAtTime", now, "literal", "xsd:dateTime"), fact("generated", F.col("s"), "iri", None))
    new = accepted.select("s").distinct().select(F.lit(dump).alias("dump"), act.alias("a"), F.inline(rows)).withColumnRenamed("a", "s").withColumns({"o_lang": null, "s_parent": null})
    return triples.join(old, "s", "left_anti").select(triples.columns).unionByName(new.select(triples.columns))


def delete_saved_routes(saved: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return saved.join(ids, "id", "left_anti"), ids.join(saved, "id", "left_anti")
