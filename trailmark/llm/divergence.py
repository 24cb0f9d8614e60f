"""How the sources of each language differ: smoothed frequencies of common terms, compared in whole numbers.

A (lang, source) group gives a term of count c the probability p = 1 + (SCALE * (c + ADDED)) div
(N + ADDED * V), which depends on the count only; so terms are ranked by cells. A cell holds the terms with
one count in the group and one in the language. The divergence is evaluated once a cell, cells of equal
values are merged, and values are ranked by how many terms are before them. Only cells that reach into the
first ranks are expanded into terms again, in order of their bytes.

Two sources of a language are compared by cells of their two counts as well. The terms that only one of the
two has are summed from its own histogram of counts, less those that both have; the terms that neither has
are a product.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column

LEAST_DOCUMENTS, SCALE, ADDED, RANKS = 30, 1_000_000_000, 5, 50
GROUP = ("lang", "source")
#: Takes A-Z to a-z, other bytes of terms to themselves, the rest to blanks.
BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: A task hands on its counts when it has this many different ones.
COUNTS_HELD = 300_000


def occurrences(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, rows): occurrences and rows that hold the term, counted in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def counted() -> pa.RecordBatch:
            parts = []
            for (lang, source), (n, rows) in found.items():
                terms = list(n)
                numbers = [pa.array(map(c.__getitem__, terms), pa.int64(), size=len(terms)) for c in (n, rows)]
                parts.append([pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), *numbers])
            found.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], [*GROUP, "term", "n", "rows"])

        held = 0
        for b in batches:
            for t, *group in zip(*(c.to_pylist() for c in b.columns)):
                n, rows = found.setdefault(tuple(group), (Counter(), Counter()))
                terms = t.encode().translate(BYTES).split()
                held -= len(n)
                n.update(terms)
                rows.update(set(terms))
                held += len(n)
                if held >= COUNTS_HELD:
                    yield counted()
                    held = 0
        if held:
            yield counted()

    plain = lambda c, name: F.coalesce(column(c).cast("string"), F.lit("")).alias(name)
    return docs.select(plain(text, "text"), plain(lang, "lang"), plain(source, "source")).mapInArrow(run, "lang string, source string, term string, n long, rows long")


def probability(count: Column, total: Column, terms: Column) -> Column:
    """p of a term, exact for counts of any size; null without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    above, below = F.lit(SCALE).cast("decimal(10,0)") * wide(count + ADDED), wide(total + ADDED * terms)
    return F.call_function("div", above, F.when(terms > 0, below)) + 1


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group of rows with the same lang and source,

    part `pair`: each other source of the lang, by the sum of |p - q| over all kept terms; 0 without any.
    part `term`: the first `ranks` of the kept terms that the group has and gives a higher p than its lang.

    Terms are runs of letters, whose A-Z are lower-cased, and of other characters beyond ASCII. A lang keeps
    those in `least` of its rows at least. Null text, lang and source are ''. Repeated rows count each.
    Ranks are by value, the largest first, then by the item's bytes. Other columns are ignored, whatever
    their names; a table without rows gives none.
    """
    made = Scratch(docs.sparkSession)
    plain = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
    groups = docs.select(plain(lang).alias("lang"), plain(source).alias("source")).distinct()
    counts = occurrences(docs, text, lang, source).groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    of_term = Window.partitionBy("lang", "term")
    both = counts.withColumns({"of_lang": F.sum("n").over(of_term), "in_rows": F.sum("rows").over(of_term)})
    kept = made.table(both.filter(F.col("in_rows") >= least).select(*GROUP, "term", "n", "of_lang"), "kept")

    # One row a group: sums of its counts and of its lang's, and the lang's number of terms.
    langs = kept.groupBy("lang", "term").agg(F.min("of_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    sums = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    told = groups.join(sums, list(GROUP), "left").join(langs, "lang", "left").select(*GROUP, zero("total"), zero("terms"), zero("lang_total"))
    told = made.table(told.withColumn("p0", probability(F.lit(0), F.col("total"), F.col("terms"))), "told")

    # Cells of a group: how many terms have these counts in the group and in the lang.
    cells = kept.groupBy(*GROUP, "n", "of_lang").agg(F.count("*").alias("terms_in")).join(told, list(GROUP))
    cells = cells.withColumn("p", probability(F.col("n"), F.col("total"), F.col("terms")))
    own = cells.groupBy(*GROUP, "p").agg(F.sum("terms_in").alias("terms_in"))
    q = probability(F.col("of_lang"), F.col("lang_total"), F.col("terms"))
    above = made.table(cells.withColumn("value", F.col("p") - q).filter("value > 0").select(*GROUP, "n", "of_lang", "terms_in", "value"), "cells")
    best = Window.partitionBy(*GROUP).orderBy(F.desc("value"))
    values = above.groupBy(*GROUP, "value").agg(F.sum("terms_in").alias("terms_in"))
    first = values.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= ranks)
    first = first.withColumn("before", F.sum("terms_in").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("terms_in")).filter(F.col("before") < ranks)
    reach = above.join(first.select(*GROUP, "value"), [*GROUP, "value"], "left_semi")
    terms = kept.join(reach, [*GROUP, "n", "of_lang"]).select(*GROUP, F.col("term").alias("item"), "value")

    # Pairs of sources: the cells of terms that both have, then the rest by each one's own histogram.
    a, b = kept.alias("a"), kept.alias("b")
    shared = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    shared = shared.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.col("a.n").alias("n"), F.col("b.n").alias("m")).agg(F.count("*").alias("terms_in"))
    x = told.select(*GROUP, "terms", F.col("total").alias("total_a"), F.col("p0").alias("p0"))
    y = told.select("lang", F.col("source").alias("item"), F.col("total").alias("total_b"), F.col("p0").alias("q0"))
    p, q = probability(F.col("n"), F.col("total_a"), F.col("terms")), probability(F.col("m"), F.col("total_b"), F.col("terms"))
    cell = shared.join(x, list(GROUP)).join(y, ["lang", "item"]).withColumns({"p": p, "q": q})
    gap = lambda u, v: F.abs(F.col(u) - F.col(v))
    by_both = cell.groupBy(*GROUP, "item").agg(
        F.sum(F.col("terms_in") * gap("p", "q")).alias("both"), F.sum(F.col("terms_in") * gap("p", "q0")).alias("a_too"), F.sum(F.col("terms_in") * gap("q", "p0")).alias("b_too"), F.sum("terms_in").alias("n_both")
    )
    pairs = x.join(y, "lang").filter("source < item")
    against = own.join(told.select("lang", F.col("source").alias("item"), "p0"), "lang").filter("source != item")
    alone = made.table(against.groupBy(*GROUP, "item").agg(F.sum(F.col("terms_in") * gap("p", "p0")).alias("alone"), F.sum("terms_in").alias("n_own")), "alone")
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("alone_b"), F.col("n_own").alias("n_own_b"))
    whole = pairs.join(by_both, [*GROUP, "item"], "left").join(alone, [*GROUP, "item"], "left").join(back, [*GROUP, "item"], "left").na.fill(0)
    neither = F.col("terms") - F.col("n_own") - F.col("n_own_b") + F.col("n_both")
    value = F.col("both") + F.col("alone") - F.col("a_too") + F.col("alone_b") - F.col("b_too") + neither * gap("p0", "q0")
    one = whole.select(*GROUP, "item", F.coalesce(value, F.lit(0)).cast("long").alias("value"))
    two = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")

    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select(*GROUP, F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(one.union(two), "pair").union(ranked(terms, "term").filter(F.col("rank") <= ranks))
