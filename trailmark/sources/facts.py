"""Facts: subject-predicate-object rows, from dumps and tables and back to typed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPE = "rdf:type"
COLUMNS = ("dump", "s", "p", "o", "o_kind", "o_dtype", "o_lang", "s_parent")
#: Roles that a derived node's name ends in, after its parent's.
ROLES = ("geo", "hash", "route", "sweep")
LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*$'


def parent_of(s: Column) -> Column:
    return F.when(s.rlike(rf"_({'|'.join(ROLES)})$"), F.regexp_extract(s, rf"^(.*)_(?:{'|'.join(ROLES)})$", 1))


def canonical_iri(iri: Column) -> Column:
    """One spelling for the vocabulary that exists under http and https."""
    return F.regexp_replace(iri, "^http://schema[.]org/", "https://schema.org/")


def read_triples(spark: SparkSession, paths: str | Sequence[str], dump: str | None = None) -> DataFrame:
    """Line-based N-Triples as facts, each once; the dump is the file's name unless given."""
    return triple_rows(spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file")), dump)


def triple_rows(lines: DataFrame, dump: str | None = None) -> DataFrame:
    """lines (value, file) to facts; what isn't a triple gives none."""
    part = lambda k: F.regexp_extract("value", LINE, k)
    bare = lambda x: F.regexp_replace(x, "^<|>$", "")
    o = part(3)
    literal = o.startswith('"')
    text = F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1)
    for esc, plain in (("\\\\n", "\n"), ("\\\\t", "\t"), ('\\\\"', '"'), ("\\\\\\\\", "\\\\")):
        text = F.regexp_replace(text, esc, plain)
    lang = F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1)
    dtype = F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1)
    out = lines.filter(F.col("value").rlike(LINE)).select(
        F.lit(dump).alias("dump") if dump else F.regexp_replace("file", r"\.[^.]*$", "").alias("dump"),
        bare(part(1)).alias("s"),
        canonical_iri(part(2)).alias("p"),
        F.when(literal, text).otherwise(canonical_iri(bare(o))).alias("o"),
        F.when(literal, "literal").when(o.startswith("_:"), "bnode").otherwise("iri").alias("o_kind"),
        F.when(literal, F.when(dtype != "", dtype).when(lang != "", "rdf:langString").otherwise("xsd:string")).alias("o_dtype"),
        F.when(lang != "", lang).alias("o_lang"),
    )
    return out.withColumn("s_parent", parent_of(F.col("s"))).dropDuplicates()


def read_manifest_union(spark: SparkSession, manifest: DataFrame, fallback: Sequence[str], predicate: str = "http://rdfs.org/ns/void#dataDump") -> DataFrame:
    """The dumps that a manifest's facts name, or the fallback if it names none; missing files are skipped."""
    named = [r[0] for r in manifest.filter(F.col("p") == predicate).select("o").distinct().collect()]  # a handful of files
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    there = [p for p in named or fallback if (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(hadoop).exists(q)]
    return read_triples(spark, there) if there else spark.createDataFrame([], "dump string, s string, p string, o string, o_kind string, o_dtype string, o_lang string, s_parent string")


def triples_to_entities(triples: DataFrame, cls: str, single: Mapping[str, str], multi: Mapping[str, str] = {}) -> DataFrame:
    """A row per subject of a class: column name to predicate. Of several values a single one takes the least."""
    subjects = triples.filter((F.col("p") == TYPE) & (F.col("o") == cls)).select("s").distinct()
    wanted = triples.filter(F.col("p").isin(*single.values(), *multi.values())).join(subjects, "s", "left_semi")
    aggs = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, p in single.items()]
    aggs += [F.sort_array(F.collect_set(F.when(F.col("p") == p, F.col("o")))).alias(c) for c, p in multi.items()]
    folded = subjects.join(wanted.groupBy("s").agg(*aggs), "s", "left") if aggs else subjects
    for c in multi:
        folded = folded.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return folded


def entities_to_triples(df: DataFrame, subject: Column, cls: str, mapping: Mapping[str, tuple[Column, str, str | None]], dump: str) -> DataFrame:
    """predicate to (value, kind, datatype): a fact for each value that isn't null, and the type's."""
    rows = [F.struct(F.lit(TYPE).alias("p"), F.lit(cls).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dtype"))]
    for p, (value, kind, dtype) in mapping.items():
        rows.append(F.struct(F.lit(p).alias("p"), value.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(dtype).cast("string").alias("o_dtype")))
    facts = df.select(F.lit(dump).alias("dump"), subject.alias("s"), F.inline(F.array(*rows))).filter(F.col("o").isNotNull())
    return facts.withColumn("o_lang", F.lit(None).cast("string")).withColumn("s_parent", parent_of(F.col("s"))).select(*COLUMNS)


FACTS_A_TASK = 250_000


def parts(triples: DataFrame) -> int:
    """How many parts of about FACTS_A_TASK facts there are. Packed facts are so small that parts of a given size in
    bytes would hold millions, which a join or dropDuplicates() then keeps in memory."""
    return max(1, -(-triples.count() // FACTS_A_TASK))


def dedupe_first_by_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__n", first).filter("__n = 1").drop("__n")
