"""Mixing sources to target weights, on DataFrame functions alone.

Tokens are aggregated per source, each source gets a target and from it a repetition rate, and each
document is taken floor(rate) times plus once more with the probability of the rate's fraction,
decided by a hash of seed and id. The only shuffle of the corpus-sized side is a partial
aggregation by source, so a source that holds a third of all rows costs one row per task. Nothing
but one row per source is ranked in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialize, n_words, prefix

WEIGHTS = (5, 2, 1)
SEED = "mix-1"
MOST_REPEATS = 3
BROADCAST_ROWS = 50_000


def source_sizes(docs: DataFrame, size: Column, source: str = "source") -> DataFrame:
    """One row per source (null is one): source, source_size."""
    return docs.groupBy(column(source).alias("source")).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("source_size"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MOST_REPEATS) -> DataFrame:
    """sizes(source, source_size) with weight, target and rate.

    Sources in code point order, null last, get the weights in turn. They share the total by weight;
    a source whose share would exceed cap times its size gets just that, and what it leaves is shared
    again by weight. The fixed point of that process is found in one pass: sources are filled up in
    the order of cap * size / weight, and the level is the first that does not exceed the next one.
    Runs over one row per source. Sources of size 0 have target 0 and rate 0.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("full_at", "weight", "source").rowsBetween(Window.unboundedPreceding, -1)
    t = (
        sizes.withColumn("weight", w)
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("left_size", F.col("all_size") - F.coalesce(F.sum("most").over(upto), F.lit(0)))
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        .withColumn("fits", F.col("left_size").cast("double") / F.col("left_weight") <= F.col("full_at"))
        # The first source that isn't full, if any, sets the level for all that follow.
        .withColumn("rest", F.max(F.when(F.col("fits"), F.struct(-F.col("full_at"), -F.col("weight"), "left_size", "left_weight"))).over(everything))
        .withColumn("level_first", F.min(F.when(F.col("fits"), F.col("full_at"))).over(everything))
    )
    shared = F.col("weight") * F.col("rest.left_size").cast("double") / F.col("rest.left_weight")
    target = F.when(F.col("level_first").isNull() | (F.col("full_at") < F.col("level_first")), F.col("most").cast("double")).otherwise(F.least(shared, F.col("most").cast("double")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    return t.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "weight", "target", "rate")


def draw(seed: str, doc_id: Column) -> Column:
    """A number in [0, 1) that depends on seed and id alone."""
    hexes = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(hexes, 16, 10).cast("double") / F.lit(float(16**13))


def mix(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, cap: int = MOST_REPEATS, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with __size, __source_size, __target and __copies, how often the mix takes each row; with more
    underscores if docs has such names.

    Null sources form one source, ranked last; null or empty texts have size 0 and follow their
    source's rate; rows that repeat an id share its draw; an empty table gives an empty one. Other
    columns pass through untouched, whatever their names.
    """
    p = prefix(docs.columns)
    sized = docs.withColumn(f"{p}size", n_words(column(text)))
    rates = targets(source_sizes(sized, F.col(f"{p}size"), source)).select("source", "source_size", "target", "rate").toDF(*[p + x for x in ("source", "source_size", "target", "rate")])
    rates = materialize(rates, "rates")
    if rates.count() <= BROADCAST_ROWS:
        rates = F.broadcast(rates)  # else Spark shuffles both sides and splits large sources
    rate = F.col(f"{p}rate")
    copies = F.floor(rate) + F.when(draw(seed, column(doc_id)) < rate - F.floor(rate), 1).otherwise(0)
    mixed = sized.join(rates, column(source).eqNullSafe(F.col(f"{p}source")))
    return mixed.select(*map(column, docs.columns), *[p + x for x in ("size", "source_size", "target")], copies.cast("int").alias(f"{p}copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as often as it is taken, with the columns it had before mix() added its four."""
    kept, copies = mixed.columns[:-4], column(mixed.columns[-1])
    nth = prefix(mixed.columns) + "nth"
    return mixed.filter(copies > 0).select(*map(column, kept), F.explode(F.sequence(F.lit(1), copies)).alias(nth)).drop(nth)
