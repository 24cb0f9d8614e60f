"""Line deduplication by overlapping windows of three lines, on DataFrame functions alone.

The lines that hold a word are numbered within their document, and each three consecutive ones are
hashed to 128 bits. A window that occurs more than once in the whole corpus stays where it occurs
first, by document id and then by position; the lines that its later occurrences cover are removed.
Overlapping windows cover a long passage together. A passage shorter than three lines is left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, prefix

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """__id, __th (a hash of the text, so that rows which share an id stay apart), __at, __h1, __h2."""
    numbered = F.transform(_lines(column(text)), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    full = F.filter(numbered, lambda s: F.trim(F.translate(s["x"], "\t\x0b\x0c\r", "    ")) != "")
    lines = docs.select(column(doc_id).alias("__id"), F.xxhash64(column(text)).alias("__th"), full.alias("__full")).filter(F.size("__full") >= width)

    def hashes(j: Column) -> Column:
        parts = [F.element_at("__full", j + k + 1)["x"] for k in range(width)]
        first = F.element_at("__full", j + 1)["i"]
        last = F.element_at("__full", j + width)["i"]
        return F.struct(first.alias("__at"), last.alias("__to"), F.xxhash64(*parts).alias("__h1"), F.xxhash64(F.lit("second"), *parts).alias("__h2"))

    return lines.select("__id", "__th", F.inline(F.transform(F.sequence(F.lit(0), F.size("__full") - width), hashes)))


def repeated(wins: DataFrame) -> DataFrame:
    """Windows that occur more than once: __h1, __h2 and __first, their first occurrence.

    Hash aggregation combines on the map side, so a window that millions of documents share costs a
    row per task.
    """
    place = F.struct("__id", "__th", "__at")
    found = wins.groupBy("__h1", "__h2").agg(F.min(place).alias("__first"), F.max(place).alias("__last"))
    return found.filter(~F.col("__first").eqNullSafe(F.col("__last"))).select("__h1", "__h2", "__first")


def later(wins: DataFrame) -> DataFrame:
    """__id, __th and __gone, the numbers of the lines that later occurrences cover.

    The join's probe side isn't grouped, so Spark splits a frequent window's rows among tasks.
    """
    place = F.struct("__id", "__th", "__at")
    hits = wins.join(repeated(wins), ["__h1", "__h2"]).filter(~place.eqNullSafe(F.col("__first")))
    spans = hits.groupBy("__id", "__th").agg(F.collect_set(F.struct("__at", "__to")).alias("__spans"))
    gone = F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.sequence(s["__at"], s["__to"]))))
    return spans.select("__id", "__th", gone.alias("__gone"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """docs with text cleaned and __n_lines and __n_removed after their own columns; with more underscores
    if docs has such names.

    Blank lines inside a covered passage go with it, others stay. Documents of fewer than three lines
    with a word, null and empty texts come back unchanged (null stays null). Rows that repeat id and
    text are one document: none is cleaned because of the other, and both come out alike. A null id
    sorts first. Other columns pass through.
    """
    p = prefix(docs.columns)
    gone = later(windows(docs, doc_id, text, width)).toDF(f"{p}id", f"{p}th", f"{p}gone")
    joined = docs.join(gone, column(doc_id).eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(column(text)) == F.col(f"{p}th")), "left")
    joined = joined.withColumn(f"{p}lines", _lines(column(text)))
    own, gone = F.col(f"{p}lines"), F.col(f"{p}gone")
    kept = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), gone)
    cleaned = F.array_join(F.transform(kept, lambda i: F.element_at(own, i + 1)), "\n")
    new = F.when(gone.isNull(), column(text)).otherwise(cleaned)
    removed = F.when(gone.isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long")
    return joined.select(*[new.alias(c) if c == text else column(c) for c in docs.columns], F.size(own).cast("long").alias(f"{p}n_lines"), removed.alias(f"{p}n_removed"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with cleaned texts and their new lengths; documents of which no word is left go."""
    out = dedup_lines(docs, doc_id, text)
    removed = F.col(out.columns[-1]) > 0
    emptied = removed & (F.trim(F.translate(column(text), "\t\n\x0b\x0c\r", "     ")) == "")
    length = F.when(removed, F.char_length(column(text)).cast("long")).otherwise(column(n_chars)) if n_chars in docs.columns else None
    return out.filter(~emptied).select(*[length.alias(c) if c == n_chars else column(c) for c in docs.columns])
