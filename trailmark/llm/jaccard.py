"""Joining documents whose sets of word shingles are similar, exactly, and grouping what is linked.

Universe partition with the pigeonhole principle. Sets whose sizes are in the same or in neighbouring
size bands may be similar; for each such pair of bands a scheme cuts the universe of shingles into
H + 1 segments by hash, where H is the most that similar sets of these sizes differ by. So at least
one segment of two similar sets is equal, and the hash of a set's part in each segment is its index
entry. Entries of equal parts meet, and those of parts with one-deletion subsets of others.

Entries are allocated by cost. A part is skipped, and indexed nowhere, if it is empty, for it would
match that of countless other sets, or if its posting list was measured to be dear. What it would have
found is made up for with one-deletion neighbourhoods: a set with z > 0 skipped segments and t segments
of which a one-deletion subset is such a part indexes, in the scheme's first 2 z + t segments, each
subset of its part that lacks one shingle, but no skipped ones. Proof: let two similar sets have e equal
segments, all skipped, y that differ by one shingle where the smaller part is skipped, and no other
equal ones. These e + y differ by y in all, the rest by at least 1 each, and all by at most H, so at
most e - 1 of the rest differ by more than 1. Either set sees e + y <= z + t and e <= z, so among its
first 2 z + t segments are at least e of the rest, and one of these differs by exactly 1: both sets
index it, the smaller one as a part, the larger as a subset. If 2 z + t exceeds the number of segments,
a set indexes these subsets in all segments and skips no part, so that it meets the sets which skip and,
by an equal part, those which don't.

The index is built twice. At first only empty parts are skipped. Equal sets form classes, and only
classes are compared. In rounds each class meets its bucket's smallest member of another component, and
what is verified joins components, so that large groups of copies are one component at the cost of a
link a member. Then each posting list is measured: a bucket is dear if its pairs of different
components are more than PAIRS_A_ENTRY times its entries. Classes that own an entry in a dear bucket are
indexed again, without these parts. Of other classes all pairs are found without them: a class outside
dear buckets meets a similar one in a bucket that isn't dear. What is left is paired by bucket.

Two sets that share hundreds of buckets would be paired in each. Buckets of the same members are one
bucket, and each entry carries its class's HEAD smallest entries of whole parts: a pair is left out where
the two heads have a smaller entry in common, because it is found there.

Sketches of 256 and then 1024 parity bits, of larger sets as many as shingles, of which similar sets
differ in at most H, drop candidates where entries meet; what remains is verified on the whole texts'
sets. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, column, prefix
from .graph import components

WIDTH = 4
SHARE, OF = 85, 100
CACHED_WORDS = 400_000
SEEN_CLASSES = 500_000
VERIFIED_TOGETHER = 64
LINKING_ROUNDS = 3
#: A bucket with more pairs of different components than this for each entry is dear. Indexing a class again
#: reads its text twice and shuffles hundreds of entries, which takes as long as trying thousands of pairs.
PAIRS_A_ENTRY = 2048
HEAD = 8
#: Bits of the filter that keeps documents which are no candidates from being shuffled: 4 MB.
FILTER_BITS = 2**25

M1, M2, M3, M4, M5, M6 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
S31, S29 = np.uint64(31), np.uint64(29)


def _mix(h: np.ndarray, m: np.uint64) -> np.ndarray:
    h = (h ^ (h >> S31)) * m
    return (h ^ (h >> S29)) * M5


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, sorted. A-Z are lower-cased; words lie between ASCII white space."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    k = min(n, width)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ (h >> S29)) * M1 + w[i : n - k + 1 + i]
    return np.unique(_mix(h, M2))


@cache
def bands(share: int, of: int) -> list[tuple[int, int]]:
    """Size bands: a set of one can only be similar to sets of the same and of the neighbouring ones."""
    found, low = [], 1
    while low < 2**40:
        high = low * of // share
        found.append((low, high))
        low = high + 1
    return found


def schemes(n: int, share: int, of: int) -> list[tuple[int, int]]:
    """(scheme, segments) that a set of n shingles is indexed in."""
    all_bands = bands(share, of)
    lo, hi = 0, len(all_bands) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if all_bands[mid][1] < n else (lo, mid)
    both = [lo, lo + 1] if n * of // share >= all_bands[lo + 1][0] else [lo]
    return [(k, 2 * all_bands[k][1] * (of - share) // (of + share) + 1) for k in both]


class _Scheme:
    """A set's parts in one scheme of m segments."""

    def __init__(self, s: np.ndarray, scheme: int, m: int) -> None:
        at = ((s * M6 >> np.uint64(24)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        self.m, self.part, self.own = m, at[order], _mix(s, M3)[order]
        self.count = np.bincount(self.part, minlength=m)
        ends = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.own, dtype=np.uint64)))
        edge = np.concatenate(([0], np.cumsum(self.count)))
        self.salt = _mix(np.array([scheme], np.uint64), M1)
        self.total = ends[edge[1:]] - ends[edge[:-1]]
        self.parts = self._keys(self.total, np.arange(m), self.count)

    def _keys(self, sums: np.ndarray, segment: np.ndarray, count: np.ndarray) -> np.ndarray:
        return _mix(_mix(sums + self.salt, M2) + segment.astype(np.uint64) * M4 + count.astype(np.uint64) * M6, M3)

    def subsets(self, which: slice | np.ndarray = slice(None)) -> np.ndarray:
        """The entries of the parts without a shingle, for each shingle in `which`, in order of segment."""
        part = self.part[which]
        return self._keys(self.total[part] - self.own[which], part, self.count[part] - 1)


def entries(s: np.ndarray, share: int, of: int, dear: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The index entries of a set, and whether each is of a whole part. dear: parts to do without."""
    found, whole = [], []
    for scheme, m in schemes(len(s), share, of):
        x = _Scheme(s, scheme, m)
        skipped, bare = x.count == 0, x.count[x.part] == 1
        if dear is not None:
            skipped = skipped | np.isin(x.parts, dear)
            bare = bare | np.isin(x.subsets(), dear)
        z = int(skipped.sum())
        near = 2 * z + len(np.unique(x.part[bare])) if z else 0
        found.append(x.parts if near > m else x.parts[~skipped])
        whole.append(np.ones(len(found[-1]), bool))
        if near:
            found.append(x.subsets(np.flatnonzero((x.part < near) & ~bare)))
            whole.append(np.zeros(len(found[-1]), bool))
    return np.concatenate(found), np.concatenate(whole)


def possible_entries(s: np.ndarray, share: int, of: int) -> np.ndarray:
    """What entries() may give, whatever is dear."""
    every = [_Scheme(s, scheme, m) for scheme, m in schemes(len(s), share, of)]
    return np.concatenate([e for x in every for e in (x.parts, x.subsets())])


def sketch(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of 1024 groups of shingles, or the next power of two of them that isn't below the set's size,
    whether it has an odd number of members, in longs; and the same of 256 larger groups, as 4 longs. The
    sketch of fewer groups is that of more with its parts of that length put together by exclusive or."""
    bits = max(1024, 1 << (len(s) - 1).bit_length()) if len(s) else 1024
    odd = np.bincount(((s >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    fine = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return fine, np.bitwise_xor.reduce(fine.reshape(-1, 4), axis=0)


def class_of(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    one, two = (_mix(np.array([_mix(s, m).sum(dtype=np.uint64), len(s)], np.uint64).cumsum(dtype=np.uint64)[1:], M4) for m in (M4, M1))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


SKETCH = ("k0", "k1", "k2", "k3")


def index(docs: DataFrame, doc_id: str, text: str, width: int, share: int, of: int) -> DataFrame:
    """Two kinds of rows, e, cid, whole, doc, from one pass over the texts.

    For each row of docs: doc (id, n, check, sketch), its class cid and a random e. For each class that
    a task meets, once: its index entries e, where doc is null. Rows without an id have no entries.
    """
    field = T.StructField("id", docs.schema[doc_id].dataType)
    doc_type = T.StructType([field, *(T.StructField(x, T.LongType()) for x in ("n", "check", *SKETCH)), T.StructField("fine", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        number = np.uint64(TaskContext.get().partitionId() << 40)
        names = ["e", "cid", "whole", "doc"]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                info, fines, cids, own, whole, of_class = [], [], [], [], [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    s = shingles(t, width)
                    cid, check = class_of(s)
                    cids.append(cid)
                    fine, coarse = sketch(s)
                    fines.append(fine)
                    info.append((len(s), check, *map(int, coarse)))
                    if len(s) and i is not None and cid not in seen:
                        if len(seen) >= SEEN_CLASSES:
                            seen.clear()
                        seen.add(cid)
                        e, w = entries(s, share, of)
                        own.append(e.view(np.int64))
                        whole.append(w)
                        of_class.append(np.full(len(own[-1]), cid))
                count = np.arange(b.num_rows, dtype=np.uint64) + number
                number += np.uint64(b.num_rows)
                doc = pa.StructArray.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*info)), pa.array(fines, pa.list_(pa.int64()))], ["id", "n", "check", *SKETCH, "fine"])
                yield pa.RecordBatch.from_arrays([pa.array(_mix(count, M6).view(np.int64)), pa.array(cids, pa.int64()), pa.nulls(b.num_rows, pa.bool_()), doc], names)
                if own:
                    e = np.concatenate(own)
                    yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(np.concatenate(of_class)), pa.array(np.concatenate(whole)), pa.nulls(len(e), doc.type)], names)

    schema = T.StructType([T.StructField("e", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("doc", doc_type)])
    return docs.select(column(doc_id).alias("id"), column(text).alias("text")).mapInArrow(run, schema)


def class_entries(texts: DataFrame, width: int, share: int, of: int) -> DataFrame:
    """(cid, comp, text) to (e, cid), all entries that a class may get; with dear as well to (e, cid, comp,
    whole), those that it gets if it does without these. Texts of other classes give nothing."""
    measured = "dear" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                cid, s = b.column("cid")[k].as_py(), shingles(b.column("text")[k].as_py(), width)
                if class_of(s)[0] != cid:
                    continue
                if measured:
                    e, whole = entries(s, share, of, b.column("dear")[k].values.to_numpy().view(np.uint64))
                    rest = [np.full(len(e), b.column("comp")[k].as_py()), whole]
                else:
                    e, rest = possible_entries(s, share, of), []
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (e.view(np.int64), np.full(len(e), cid), *rest)], ["e", "cid", "comp", "whole"][: 2 + len(rest)])

    return texts.mapInArrow(run, "e long, cid long" + ", comp long, whole boolean" * measured)


def members(entries: DataFrame) -> DataFrame:
    """entries (e, cid, whole, ...) with n, h1 and h2, which tell what members their bucket has; of repeated
    entries one, and none of buckets with a single member or without a whole part. Rows without `whole`
    pass. One shuffle by e; a bucket's rows stream through its task."""
    bucket = Window.partitionBy("e")
    once = entries.withColumn("before", F.lag("cid").over(bucket.orderBy("cid"))).filter("whole is null or before is null or before != cid").drop("before")
    shared = once.withColumn("n", F.count("whole").over(bucket)).filter("whole is null or n > 1")
    kinds = {x: F.bit_xor(F.xxhash64(F.lit(x), "cid", "whole")).over(bucket) for x in ("h1", "h2")}
    return shared.withColumns({"parts": F.max("whole").over(bucket), **kinds}).filter("whole is null or parts").drop("parts")


def same_lists(told: DataFrame) -> DataFrame:
    """(e, one) of members()' entries: for each bucket, the smallest of those that have the same members. No
    more buckets have them than the smallest member has entries."""
    lists = told.select("e", "n", "h1", "h2").distinct()
    return lists.select("e", F.min("e").over(Window.partitionBy("n", "h1", "h2")).alias("one"))


def dear_lists(mixed: DataFrame) -> DataFrame:
    """The buckets e of mixed (e, whole, comp) whose pairs of different components, at least one of each
    pair's entries a whole part, are more than PAIRS_A_ENTRY times their entries."""
    w, n = F.sum(F.col("whole").cast("long")), F.count("*")
    by_comp = mixed.groupBy("e", "comp").agg(w.alias("w"), (n - w).alias("d"))
    total = by_comp.groupBy("e").agg(F.sum("w").alias("w"), F.sum("d").alias("d"), F.sum(F.expr("w * w")).alias("ww"), F.sum(F.expr("w * d")).alias("wd"))
    return total.filter(f"(w * w - ww) / 2 + w * d - wd > {PAIRS_A_ENTRY} * (w + d)").select("e")


def of_several(mixed: DataFrame) -> DataFrame:
    """The entries of those buckets that hold more than one component."""
    several = mixed.groupBy("e").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    return mixed.join(several.select("e"), "e", "left_semi")


def likely(docs: DataFrame, doc_id: str, wanted: DataFrame, name: str) -> DataFrame:
    """docs with a column `name`, whether the id may be in wanted (one column, of ids), without a shuffle
    of docs.

    The filter has FILTER_BITS bits whatever the input, so it may be broadcast; when it fills up, more
    rows pass, and the exact join that follows decides.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    p = prefix(docs.columns)
    at = wanted.select(bit(wanted[wanted.columns[0]]).alias("at"))
    maps = at.groupBy(F.bitmap_bucket_number("at").alias(f"{p}bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias(f"{p}map"))
    spot = F.bitmap_bit_position(bit(column(doc_id)))
    byte = F.conv(F.hex(F.substring(F.col(f"{p}map"), (spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    isset = F.coalesce(F.getbit(byte, (spot % 8).cast("int")) == 1, F.lit(False))
    own = docs.withColumn(f"{p}bucket", F.bitmap_bucket_number(bit(column(doc_id))))
    return own.join(F.broadcast(maps), f"{p}bucket", "left").select(*[column(c) for c in docs.columns], isset.alias(name))


def may_match(a: str, b: str, share: int, of: int, fine: bool = False) -> Column:
    """Whether sizes and sketches allow classes a and b, aliases with n and sketch, to be similar."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    if fine:
        one, two = F.col(f"{a}.fine"), F.col(f"{b}.fine")
        m = F.least(F.size(one), F.size(two))
        short = lambda x: F.when(F.size(x) == m, x).otherwise(F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.aggregate(F.sequence(j, F.size(x) - 1, m), F.lit(0).cast("long"), lambda t, i: t.bitwiseXOR(x[i]))))
        bits = F.zip_with(short(one), short(two), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        differ = F.aggregate(bits, F.lit(0), lambda t, x: t + x)
    else:
        differ = sum((F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in SKETCH), F.lit(0))
    return (of * F.least(n_a, n_b) >= share * F.greatest(n_a, n_b)) & ((of + share) * differ <= (of - share) * (n_a + n_b))


def verify(pairs: DataFrame, texts: DataFrame, width: int, share: int, of: int) -> DataFrame:
    """The pairs (a, b, a_rep, b_rep) of classes that are similar, as (a, b).

    texts (rep, text) has the text of each class's document. Only those that a pair may name are shuffled.
    A class that has many partners meets them in groups of bounded size; its text travels once for each.
    Texts that share an id are told apart by their class.
    """

    def sets(t: pa.Table, cid: str, text: str) -> Iterator[tuple[int, np.ndarray]]:
        for c, text in zip(t.column(cid).to_pylist(), t.column(text).to_pylist()):
            s = shingles(text, width)
            if class_of(s)[0] == c:
                yield c, s

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, one = next(sets(left, "one", "own_text"), (None, None))
        hits = set()
        if a is not None:
            for b, s in sets(right, "b", "text"):
                both = len(np.intersect1d(one, s, assume_unique=True))
                if of * both >= share * (len(one) + len(s) - both):
                    hits.add(b)
        return pa.table([pa.array([a] * len(hits), pa.int64()), pa.array(sorted(hits), pa.int64())], names=["a", "b"])

    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / VERIFIED_TOGETHER).alias("groups"))
    grouped = pairs.join(counts, "a").withColumn("g", F.pmod(F.xxhash64("b"), F.col("groups")))
    named = {x: likely(texts, "rep", pairs.select(x), "named").filter("named").drop("named") for x in ("a_rep", "b_rep")}
    right = grouped.select("a", "g", "b", F.col("b_rep").alias("rep")).join(named["b_rep"], "rep").select("a", "g", "b", "text")
    own = named["a_rep"].select(F.col("rep").alias("a_rep"), F.col("text").alias("own_text"))
    left = grouped.select(F.col("a").alias("one"), F.col("g").alias("part"), "a_rep").distinct().join(own, "a_rep").select("one", "part", "own_text")
    return left.groupBy("one", "part").cogroup(right.groupBy("a", "g")).applyInArrow(run, "a long, b long")


def with_sketches(mixed: DataFrame, meet: DataFrame) -> DataFrame:
    """The entries mixed (e, cid, whole, comp) with their classes' sizes, sketches and heads."""
    nth = F.row_number().over(Window.partitionBy("cid").orderBy("e"))
    heads = mixed.filter("whole").withColumn("nth", nth).filter(F.col("nth") <= HEAD).groupBy("cid").agg(F.collect_list("e").alias("head"))
    return mixed.join(meet.drop("rep").join(heads, "cid", "left"), "cid")


def candidates(mixed: DataFrame, share: int, of: int) -> DataFrame:
    """(a, b) of with_sketches()' classes of different components that share a bucket and whose sketches, small and
    large, allow that they are similar. The large ones are compared here, not after the join: documents of one template
    pass the small ones, whatever they differ by, and the rows that a join hands on would grow as the template's square."""
    one, two = F.col("x.head"), F.col("y.head")
    before = F.coalesce(F.exists(F.array_intersect(one, two), lambda e: e < F.col("x.e")), F.lit(False))
    apart = (F.col("x.comp") < F.col("y.comp")) & (F.col("x.whole") | F.col("y.whole"))
    alike = may_match("x", "y", share, of) & ~before & may_match("x", "y", share, of, True)
    pair = mixed.alias("x").join(mixed.alias("y"), (F.col("x.e") == F.col("y.e")) & apart & alike)
    return pair.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))


def link(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, share: int = SHARE, of: int = OF, made: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per row of docs.

    Documents link where of * |A & B| >= share * |A | B|, for their sets of shingles of `width` words;
    a document of fewer words has one shingle. component_id is the smallest id that links reach.
    Null, empty and wordless texts have no shingle and link with nothing. Equal texts are linked.
    Rows without an id aren't compared and have no component. Rows that share an id come out each
    with the component of its own text. Other columns are ignored.
    """
    made = made or Scratch(docs.sparkSession)
    found = made.table(members(index(docs, doc_id, text, width, share, of)), "index")
    rows = found.filter("doc is not null").select("doc.*", "cid")
    shared = found.filter("doc is null")
    alike = F.when(F.min("check") == F.max("check"), F.min("id")).otherwise(F.raise_error(F.lit("two sets have the same hash; change the multipliers")))
    classes = made.table(rows.filter("n > 0 and id is not null").groupBy("cid").agg(alike.alias("rep"), F.min("n").alias("n"), *[F.min(k).alias(k) for k in SKETCH], F.first("fine").alias("fine")), "classes")
    same = made.table(same_lists(shared), "same")
    mixed = made.table(shared.select("e", "cid", "whole").join(same.filter("e = one").select("e"), "e", "left_semi").withColumn("comp", F.col("cid")), "mixed")
    meet = made.table(classes.join(mixed.select("cid").distinct(), "cid", "left_semi"), "meet")
    wanted = likely(docs.select(column(doc_id).alias("rep"), column(text).alias("text")), "rep", meet.select("rep"), "wanted")
    texts = made.table(wanted.filter("wanted").drop("wanted"), "texts")

    def told(pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and sketches allow, with their documents."""
        x, y = meet.withColumnRenamed("cid", "a").alias("x"), meet.withColumnRenamed("cid", "b").alias("y")
        return pairs.join(x, "a").join(y, "b").filter(may_match("x", "y", share, of) & may_match("x", "y", share, of, True)).select("a", "b", F.col("x.rep").alias("a_rep"), F.col("y.rep").alias("b_rep"))

    # In rounds, each class tries the smallest of another component that shares a bucket with it, of
    # those that may match and weren't tried.
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
    # Classes that own an entry in a dear bucket are indexed again, without these parts.
    dear = made.table(dear_lists(mixed), "dear")
    if dear.limit(1).count():
        owners = made.table(mixed.join(dear, "e", "left_semi").select("cid", "comp").distinct(), "owners")
        of_owner = made.table(texts.join(meet.join(owners, "cid").select("cid", "comp", "rep"), "rep").select("cid", "comp", "text"), "owned")
        hot = same.join(dear.withColumnRenamed("e", "one"), "one", "left_semi").select("e")
        theirs = class_entries(of_owner, width, share, of).join(hot, "e", "left_semi").groupBy("cid").agg(F.collect_set("e").alias("dear"))
        again = class_entries(of_owner.join(theirs, "cid").select("cid", "comp", "text", "dear"), width, share, of)
        again = again.dropDuplicates(["e", "cid"]).select("e", "cid", "whole", "comp")
        rest = mixed.join(owners, "cid", "left_anti").select("e", "cid", "whole", "comp")
        mixed = made.table(of_several(rest.unionByName(again)), "mixed")
        one = same_lists(members(mixed)).filter("e = one").select("e")
        mixed = made.table(mixed.join(one, "e", "left_semi"), "mixed")
    # Then every pair of different components that shares a bucket.
    mixed = made.table(with_sketches(mixed, meet), "mixed")
    pairs = told(candidates(mixed, share, of).distinct())
    more = made.table(verify(made.table(pairs, "pairs"), texts, width, share, of), "links")
    labels = components(links.union(more))
    known = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = known.groupBy("comp").agg(F.min("rep").alias("component_id"))
    group = made.table(known.join(least, "comp").select("cid", "component_id"), "group")
    made.keep("index", "group")
    own = rows.select("id", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid"))
    return own.join(group, "cid", "left").select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, share: int = SHARE, of: int = OF) -> DataFrame:
    """docs without those that link to one of a smaller id, directly or not; all columns as they were.

    Only rows that may have to go are joined with the list of those that do; the rest isn't shuffled.
    Rows that share an id are one document, and null ids stay. Other columns may have any names.
    """
    made = Scratch(docs.sparkSession)
    linked = link(docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")), width=width, share=share, of=of, made=made)
    p = prefix(docs.columns)
    gone = made.table(linked.filter("doc_id != component_id").select(F.col("doc_id").alias(f"{p}gone")).distinct(), "gone")
    made.keep("gone")
    flagged = likely(docs, doc_id, gone, f"{p}likely")
    kept = flagged.filter(f"{p}likely").join(gone, column(doc_id) == F.col(f"{p}gone"), "left_anti")
    return flagged.filter(f"not {p}likely").unionByName(kept).drop(f"{p}likely")
