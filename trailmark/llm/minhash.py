"""Near duplicates by circulant MinHash: signatures of two permutations, bands, exact verification.

The universe of shingles is the whole numbers below 2^32, to which shingles are hashed. SIGMA and PI are
two permutations of it, each a chain of steps that can be undone. SIGMA mixes a set's shingles once. PI,
shifted circularly by k places, orders them anew for coordinate k of the signature: the smallest of
PI(SIGMA(x) - k mod 2^32). Two sets agree in a coordinate with a probability of their Jaccard similarity,
and two permutations serve all coordinates.

BANDS runs of ROWS coordinates each are a set's index entries. Two sets of similarity s share none of them
with probability (1 - s^ROWS)^BANDS: 1.3e-7 at 0.8. Whatever shares an entry is a candidate, in buckets of
any size, and is verified on the whole texts' sets; so no link is false, and one is missed with that
probability.

Equal sets form classes, and only classes are compared. In rounds each class tries the smallest member of
another component in its buckets, so that a large group of near copies is one component at the cost of a few
tries a member. Then all pairs of different components that still share a bucket are tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, column
from .graph import components
from .jaccard import SEEN_CLASSES, SKETCH, class_of, likely, may_match, of_several, shingles, sketch, verify

WIDTH, SHARE, OF = 4, 80, 100
BANDS, ROWS = 40, 5
LINKING_ROUNDS = 3
#: Odd multipliers and shifts of the two permutations.
SIGMA = (0x7FEB352D, 0x846CA68B, 15, 16)
PI = (0x9E3779B1, 0x85EBCA77, 13, 16)
#: Shingles that are permuted at once, so that a block of all coordinates stays in a core's cache.
TOGETHER = 256


def permuted(x: np.ndarray, by: tuple[int, int, int, int]) -> np.ndarray:
    """Where a permutation of the whole numbers below 2^32 takes each x. Changes x."""
    m1, m2, s1, s2 = (np.uint32(k) for k in by)
    x ^= x >> s2
    x *= m1
    x ^= x >> s1
    x *= m2
    x ^= x >> s2
    return x


def signature(s: np.ndarray, coordinates: int) -> np.ndarray:
    """The circulant MinHash of a set of 64-bit shingle hashes that isn't empty."""
    mixed = permuted((s >> np.uint64(32)).astype(np.uint32), SIGMA)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 2**32 - 1, np.uint32)
    for k in range(0, len(mixed), TOGETHER):
        np.minimum(least, permuted(mixed[None, k : k + TOGETHER] - shifts, PI).min(axis=1), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of a signature, which tells bands apart."""
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for c in sig.reshape(bands, rows).T.astype(np.uint64):
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def index(docs: DataFrame, doc_id: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """Per row of docs: id, n (size of its set), cid and check (the class of equal sets), its sketches, and
    `keys`, the class's entries; these are null where the task gave the same class before, and where a row
    has no id or no shingle."""
    longs = lambda names: [T.StructField(x, T.LongType()) for x in names]
    several = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), *longs(("n", "cid", "check", *SKETCH)), T.StructField("fine", several), T.StructField("keys", several)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                numbers, fines, keys = [], [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    s = shingles(t, width)
                    cid, check = class_of(s)
                    fine, coarse = sketch(s)
                    numbers.append((len(s), cid, check, *map(int, coarse)))
                    fines.append(fine)
                    if len(s) and i is not None and cid not in seen:
                        if len(seen) >= SEEN_CLASSES:
                            seen.clear()
                        seen.add(cid)
                        keys.append(band_keys(signature(s, bands * rows), bands, rows).view(np.int64))
                    else:
                        keys.append(None)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*numbers)), pa.array(fines, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], schema.names)

    return docs.select(column(doc_id).alias("id"), column(text).alias("text")).mapInArrow(run, schema)


def link(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, share: int = SHARE, of: int = OF, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of docs.

    Documents link where of * |A & B| >= share * |A | B|, for their sets of shingles of `width` words;
    a document of fewer words has one shingle. component_id is the smallest id that links reach, and kept
    tells whether it is the row's own. Null, empty and wordless texts have no shingle and link with nothing.
    Equal texts are linked. Rows without an id aren't compared, have no component and are kept. Rows that
    share an id come out each with the component of its own text. Other columns are ignored, whatever
    their names; a table without rows gives none.
    """
    made = Scratch(docs.sparkSession)
    found = made.table(index(docs, doc_id, text, width, bands, rows), "index")
    alike = F.when(F.min("check") == F.max("check"), F.min("id")).otherwise(F.raise_error(F.lit("two sets have the same hash; change the multipliers")))
    classes = made.table(found.filter("n > 0 and id is not null").groupBy("cid").agg(alike.alias("rep"), F.min("n").alias("n"), *[F.min(k).alias(k) for k in SKETCH], F.first("fine").alias("fine")), "classes")
    entries = found.filter("keys is not null").select("cid", F.col("cid").alias("comp"), F.explode("keys").alias("e"))
    mixed = made.table(of_several(entries).dropDuplicates(["e", "cid"]), "mixed")
    meet = made.table(classes.join(mixed.select("cid").distinct(), "cid", "left_semi"), "meet")
    wanted = likely(docs.select(column(doc_id).alias("rep"), column(text).alias("text")), "rep", meet.select("rep"), "wanted")
    texts = made.table(wanted.filter("wanted").drop("wanted"), "texts")

    def told(pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and sketches allow, with their documents."""
        x, y = meet.withColumnRenamed("cid", "a").alias("x"), meet.withColumnRenamed("cid", "b").alias("y")
        return pairs.join(x, "a").join(y, "b").filter(may_match("x", "y", share, of) & may_match("x", "y", share, of, True)).select("a", "b", F.col("x.rep").alias("a_rep"), F.col("y.rep").alias("b_rep"))

    links = tried = None
    for k in range(LINKING_ROUNDS):
        low = mixed.groupBy("e").agg(F.min(F.struct("comp", "cid")).alias("low"))
        near = mixed.join(low, "e").filter(F.col("low.comp") < F.col("comp")).select(F.col("low.cid").alias("a"), F.col("cid").alias("b")).distinct()
        if tried is not None:
            near = near.join(tried, ["a", "b"], "left_anti")
        first = told(near).groupBy("b").agg(F.min(F.struct("a", "a_rep")).alias("x"), F.first("b_rep").alias("b_rep")).select("x.a", "b", "x.a_rep", "b_rep")
        first = made.table(first, f"first{k}")
        tried = first.select("a", "b") if tried is None else tried.union(first.select("a", "b"))
        new = made.table(verify(first, texts, width, share, of), f"links{k}")
        links = new if links is None else links.union(new)
        if not new.limit(1).count():
            break
        labels = components(links).withColumnRenamed("node", "cid")
        again = mixed.drop("comp").join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        mixed = made.table(of_several(again), "mixed")
    # Every pair of different components that shares a bucket, but for those that were tried; in the first
    # of its buckets only.
    before = F.collect_list("e").over(Window.partitionBy("cid").orderBy("e").rowsBetween(Window.unboundedPreceding, -1))
    known = made.table(mixed.withColumn("before", before).join(meet.drop("fine", "rep"), "cid"), "known")
    apart = (F.col("x.e") == F.col("y.e")) & (F.col("x.comp") < F.col("y.comp")) & may_match("x", "y", share, of) & ~F.arrays_overlap("x.before", "y.before")
    pair = known.alias("x").join(known.alias("y"), apart).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    pairs = told(pair.distinct().join(tried, ["a", "b"], "left_anti"))
    more = made.table(verify(made.table(pairs, "pairs"), texts, width, share, of), "links")
    labels = components(links.union(more))
    of_class = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = of_class.groupBy("comp").agg(F.min("rep").alias("component_id"))
    group = made.table(of_class.join(least, "comp").select("cid", "component_id"), "group")
    made.keep("index", "group")
    own = found.select("id", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(group, "cid", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return own.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
