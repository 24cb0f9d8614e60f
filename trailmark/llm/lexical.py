"""Ranked lexical search for many queries at once, whose common parts are evaluated once.

A document scores the sum of its terms' contributions for each item, w * ((SCALE * tf) div (1000 * tf +
20 * m)), in whole numbers. Items share terms, and often several terms together. From a block of items a
graph is mined: terms in the same items form one node; then, in turns, the pairs of nodes that most items
share become nodes of their own and take the pair's place in these items, as long as two items share one.
An item is left as a short list of nodes.

Documents are evaluated where they lie. For each batch of documents a node's partial scores are
materialised once, as an array over the documents, from its children's; items add up their nodes. A task
hands on the best documents of each item among its own, and these lists are merged.

Two passes read the documents for a block of items: one cuts each text into terms and keeps the counts of those
that the block's items have, as a table; the other one scores from it. The block's terms and its graph are
sent to all tasks; a block has as many items as have TERMS_A_BLOCK terms together at most, or one.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bucket_count, column

RANKS, SCALE, LENGTH_SHARE = 50, 1_000_000_000, 50
TERMS_A_BLOCK = 100_000
#: Nodes of an item that are looked at for pairs, those that most items share first: a bound on time only.
PAIRED = 500
#: Numbers that a batch of documents may hold in all nodes' arrays: 32 MB.
NUMBERS_A_BATCH = 2**22
#: Takes A-Z to a-z, other bytes of terms to themselves, the rest to blanks.
BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, in UTF-8: runs of ASCII letters, digits and characters beyond ASCII."""
    return (text or "").encode().translate(BYTES).split()


@dataclass
class Plan:
    """A graph of shared parts. Nodes up to the number of groups are groups of terms, group[t] that of term
    t; then come layers of nodes, each the sum of two earlier ones; items are lists of nodes."""

    group: np.ndarray
    layers: list[np.ndarray]
    items: list[np.ndarray]

    @property
    def nodes(self) -> int:
        return int(self.group.max(initial=-1)) + 1 + sum(len(x) for x in self.layers)

    @property
    def additions(self) -> int:
        """Additions of arrays that a batch takes."""
        return len(self.group) + sum(len(x) for x in self.layers) + sum(map(len, self.items))


def mined(items: list[list[int]], n_terms: int) -> Plan:
    """The plan for items, lists of different terms below n_terms."""
    holders = defaultdict(list)
    for k, terms in enumerate(items):
        for t in terms:
            holders[t].append(k)
    groups: dict[tuple, int] = {}
    group = np.array([groups.setdefault(tuple(holders[t]), len(groups)) for t in range(n_terms)], np.int64)
    left = [set(group[terms].tolist()) for terms in items]
    layers, n = [], len(groups)
    while True:
        shared = Counter()
        several = Counter(x for nodes in left for x in nodes)
        for nodes in left:
            most = sorted((x for x in nodes if several[x] > 1), key=lambda x: (-several[x], x))[:PAIRED]
            shared.update(combinations(sorted(most), 2))
        layer = []
        at = defaultdict(set)
        for k, nodes in enumerate(left):
            for x in nodes:
                at[x].add(k)
        for (x, y), count in sorted(shared.items(), key=lambda p: (-p[1], p[0])):
            if count < 2:
                break
            both = at[x] & at[y]
            if len(both) < 2:
                continue
            for k in both:
                left[k] -= {x, y}
                left[k].add(n + len(layer))
            at[x] -= both
            at[y] -= both
            layer.append((x, y))
        if not layer:
            return Plan(group, layers, [np.array(sorted(x), np.int64) for x in left])
        layers.append(np.array(layer, np.int64))
        n += len(layer)


class _Best:
    """The best documents of each item so far: the largest scores, equal ones by the smaller id."""

    def __init__(self, items: int, ranks: int) -> None:
        self.ranks = ranks
        self.ids = [np.zeros(0, np.int64)] * items
        self.scores = [np.zeros(0, np.int64)] * items
        self.least = np.zeros(items, np.int64)

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        at = np.flatnonzero((scores > 0) & (scores >= self.least[item]))
        if not len(at):
            return
        ids, scores = np.concatenate((self.ids[item], ids[at])), np.concatenate((self.scores[item], scores[at]))
        order = np.lexsort((ids, -scores))[: self.ranks]
        self.ids[item], self.scores[item] = ids[order], scores[order]
        if len(order) == self.ranks:
            self.least[item] = scores[order[-1]]


def counted(docs: DataFrame, doc_id: str, text: str, terms: dict[bytes, int]) -> DataFrame:
    """doc, n, terms, tf: a row per row of docs with a term: its id, its terms with repeats, and of the given terms
    those that it has, by number, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                rows = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    found = terms_of(t)
                    if found:
                        tf = {terms[x]: n for x, n in Counter(found).items() if x in terms}
                        rows.append((i, len(found), list(tf), list(tf.values())))
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))], ["doc", "n", "terms", "tf"])

    return docs.select(column(doc_id).cast("long").alias("doc"), column(text).alias("text")).mapInArrow(run, "doc long, n long, terms array<int>, tf array<int>")


def scored(found: DataFrame, plan: Plan, weight: np.ndarray, ranks: int) -> DataFrame:
    """(item, doc, score) of counted() documents with `m`: for each task, the best documents of each item."""
    together = max(1, NUMBERS_A_BATCH // max(1, plan.nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(plan.items), ranks)
        for batch in batches:
            for start in range(0, batch.num_rows, together):
                b = batch.slice(start, together)
                ids, m = b.column("doc").to_numpy(), b.column("m").to_numpy()
                lists = b.column("terms")
                term, tf = lists.flatten().to_numpy(), b.column("tf").flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
                value = weight[term] * (SCALE * tf // (1000 * tf + 20 * m[doc]))
                partial = np.zeros((plan.nodes, b.num_rows), np.int64)
                np.add.at(partial.reshape(-1), plan.group[term] * b.num_rows + doc, value)
                n = plan.nodes - sum(map(len, plan.layers))
                for layer in plan.layers:
                    np.add(partial[layer[:, 0]], partial[layer[:, 1]], out=partial[n : n + len(layer)])
                    n += len(layer)
                for k, nodes in enumerate(plan.items):
                    best.add(k, ids, partial[nodes].sum(axis=0))
        sizes = [len(x) for x in best.ids]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sizes)), sizes)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], ["item", "doc", "score"])

    return found.mapInArrow(run, "item long, doc long, score long")


def blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, their different terms) of blocks of items of `most` terms together at most, or of one item each.
    Rows of the same id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(set(terms_of(t))) for t in b.column(1).to_pylist()], pa.list_(pa.binary()))], ["item", "terms"])

    schema = T.StructType([T.StructField("item", items.schema[item_id].dataType), T.StructField("terms", T.ArrayType(T.BinaryType()))])
    made = Scratch(items.sparkSession)
    each = items.select(column(item_id).alias("item"), column(text).alias("text")).mapInArrow(run, schema)
    each = each.groupBy("item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).withColumn("n", F.size("terms"))
    each = made.table(each.withColumn("at", F.xxhash64("item")), "items")
    n_blocks = bucket_count(each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], most)
    while True:
        block = F.pmod("at", F.lit(n_blocks))
        full = each.groupBy(block.alias("block")).agg(F.sum("n").alias("n"), F.count("*").alias("items"))
        if n_blocks >= 2**40 or not full.filter((F.col("n") > most) & (F.col("items") > 1)).limit(1).count():
            break
        n_blocks *= 2
    numbers = full.select("block").orderBy("block").toLocalIterator()
    for row in numbers:
        got = each.filter(block == row["block"]).select("item", "terms").orderBy("item").collect()
        yield [r["item"] for r in got], [[bytes(t) for t in r["terms"]] for r in got]
    made.keep()


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", ranks: int = RANKS, terms_a_block: int = TERMS_A_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `ranks` best rows of docs with a score above 0.

    The whole numbers: N rows with a term, L their terms, n a row's own, df rows that hold a term, tf its
    occurrences, m = 100 - 50 + (50 * n * N) div L, w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))). An
    item's different terms count once each. Equal scores rank by the smaller doc_id, a whole number.
    Null and empty texts have no terms: they are no documents, and such items find none. Rows without a
    doc_id count in all statistics but aren't ranked; rows that share one are ranked each. Items of one
    item_id, null too, are one item of all their terms. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    made, parts = Scratch(spark), []
    for b, (ids, own) in enumerate(blocks(items, item_id, item_text, terms_a_block)):
        number = {t: k for k, t in enumerate(sorted({t for terms in own for t in terms}))}
        plan = mined([[number[t] for t in terms] for terms in own], len(number))
        found = made.table(counted(docs, doc_id, text, number), f"found{b}")
        total = found.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
        if not total["N"]:
            made.drop(f"found{b}")
            break
        df = {r["term"]: r["df"] for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
        weight = np.floor(1000 * np.log((2 * total["N"] + 2) / (2 * np.array([df.get(k, 0) for k in range(len(number))], np.float64) + 1))).astype(np.int64)
        wide = lambda x: F.lit(x).cast("decimal(19,0)")
        length = F.call_function("div", LENGTH_SHARE * F.col("n").cast("decimal(15,0)") * wide(total["N"]), wide(total["L"]))
        listed = found.filter("doc is not null").withColumn("m", 100 - LENGTH_SHARE + length)
        best = made.table(scored(listed, plan, weight, ranks), f"best{b}")
        made.drop(f"found{b}")
        nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
        first = best.withColumn("rank", nth).filter(F.col("rank") <= ranks)
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", items.schema[item_id].dataType)]))
        parts.append(first.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_id), "rank", F.col("doc").alias(doc_id), "score"))
    schema = T.StructType([T.StructField(item_id, items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()), T.StructField(doc_id, T.LongType()), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    for part in parts:
        out = out.union(part)
    return out
