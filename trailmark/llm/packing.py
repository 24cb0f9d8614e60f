"""Best-fit packing of token sequences by minimum bin slack.

Texts become token ids and, if longer than a bin, pieces of it. Only the histogram of the pieces'
lengths is planned in one place: it has at most `size` rows, whatever the corpus. There each bin gets
the fullest combination of the lengths still available, found by a subset-sum dynamic programme over
bitsets; among equally full ones the combination with the longest pieces. A combination is taken as
often as the counts allow before the next is sought, which is what bin by bin would do while nothing
runs out. The pieces then find their places by their rank among pieces of their length.

Ranks are counted in buckets of a bounded number of rows, so that a length which a third of all pieces
have isn't sorted in one task.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator, Mapping
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_count, column, materialize, prefix

SIZE = 4096
END_ID = 1
RANKED_TOGETHER = 50_000
#: A worker keeps the ids of so many of the last parts at least, and of about twice as many at most.
CACHED = 200_000
#: Parts of more characters are encoded each time.
LONGEST_CACHED = 64
ENCODED_TOGETHER = 20_000
GROUP_CHARS = 4_000_000


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_LOWER = [c for c in map(chr, range(0x21, 0x100)) if unicodedata.category(c)[0] in "LNPS" and c == c.lower()]
_kind = lambda k: "".join(re.escape(c) for c in _LOWER if unicodedata.category(c)[0] in k)
#: Lower-case Latin-1 between plain blanks, which the tokenizer's normalizer leaves as it is.
PLAIN = re.compile(rf"[ \n\r\t{_kind('LNPS')}]*")
#: Fixed value: the pattern of what the tokenizer encodes on its own, for such texts.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_kind('L')}]+|[{_kind('N')}]|[{_kind('PS')}]+")


class _Recent(dict):
    """A dict in two generations: turn() forgets what wasn't used since the last time."""

    def __init__(self) -> None:
        self.old: dict = {}

    def __missing__(self, key):
        value = self[key] = self.old[key]
        return value

    def unknown(self, keys: Iterable) -> list:
        return [k for k in keys if k not in self and k not in self.old]

    def turn(self) -> None:
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()


@cache
def _known(path: str) -> _Recent:
    return _Recent()


def _parts(text: str) -> list[str]:
    """Parts that the tokenizer encodes on their own, whatever stands around them.

    It lower-cases; if the text is plain Latin-1 then, these are its pieces, else what stands between
    blanks and line ends. Texts in which a special token may stand aren't lower-cased here.
    """
    if "<|" not in text:
        low = text.lower()
        if PLAIN.fullmatch(low):
            return PIECES.findall(low)
    return text.replace("\n", " ").split(" ")


def _encode_each(parts: list[str], path: str) -> Iterator[tuple[str, bytes]]:
    """Each part with its ids, many in one call: word_ids says whose an id is. Pieces are words of one text."""
    pieces = [p for p in parts if PIECES.fullmatch(p)]
    others = [p for p in parts if not PIECES.fullmatch(p)]
    for kind, apart in ((pieces, False), (others, True)):
        for k in range(0, len(kind), ENCODED_TOGETHER):
            some = kind[k : k + ENCODED_TOGETHER]
            e = _tokenizer(path).encode(some if apart else " ".join(some), is_pretokenized=apart, add_special_tokens=False)
            ids = np.array(e.ids, "<u4").tobytes()
            ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(some) + 1)).tolist()
            yield from ((c, ids[4 * a : 4 * b]) for c, a, b in zip(some, ends, ends[1:]))


def encode(texts: list[str], path: str) -> Iterator[bytes]:
    """The token ids of each text as little-endian unsigned 32-bit numbers, without special ones."""
    known = _known(path)
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or chars + len(texts[end]) <= GROUP_CHARS):
            chars += len(texts[end])
            end += 1
        cut = [_parts(t) for t in texts[start:end]]
        known.turn()
        new = known.unknown(set().union(*cut))
        known.update(_encode_each(new, path))
        for parts in cut:
            yield b"".join(map(known.__getitem__, parts))
        for p in new:
            if len(p) > LONGEST_CACHED:
                del known[p]
        start = end


def pieces(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut at size.

    Null and empty texts are the one id end_id. Null ids and repeated rows stay as they are.
    """
    field = docs.schema[doc_id]
    end = np.array([end_id], "<u4").tobytes()
    names = ["piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            row, cols = [], ([], [], [], [])
            for k, ids in enumerate(encode(texts, path)):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    row.append(k)
                    for c, v in zip(cols, (p, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], [doc_id, *names])

    schema = T.StructType([field, T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in names[1:])])
    return docs.select(column(doc_id).alias("id"), column(text).alias("text")).mapInArrow(run, schema)


def fullest(counts: Mapping[int, int], size: int) -> dict[int, int]:
    """The fullest combination of at most size: how many of each length. Ties to longer ones."""
    lengths = sorted(n for n in counts if counts[n] > 0)
    room = (1 << (size + 1)) - 1
    below = []  # sums that the shorter lengths reach, as bits
    sums = 1
    for n in lengths:
        below.append(sums)
        left, step = min(counts[n], size // n), 1
        while left:
            step = min(step, left)
            sums |= (sums << (n * step)) & room
            left -= step
            step *= 2
    rest, taken = sums.bit_length() - 1, {}
    for n, reach in zip(reversed(lengths), reversed(below)):
        if rest == 0:
            break
        k = min(counts[n], rest // n)
        while k and not reach >> (rest - k * n) & 1:
            k -= 1
        if k:
            taken[n] = k
            rest -= k * n
    return taken


def plan(counts: Mapping[int, int], size: int = SIZE) -> tuple[np.ndarray, int]:
    """The bins for so many pieces of each length.

    Gives rows (length, first rank, first bin, pieces of that length in a bin, their first place) in
    the order of length and rank, and the number of bins. Each combination leaves at least one of its
    lengths with less than it takes, so a length of n can end at most log2(size / n) + 1 of them: the
    rows are bounded by size, not by the pieces.
    """
    left = {int(n): int(c) for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    rows, bins = [], 0
    while left:
        taken = fullest(left, size)
        times = min(left[n] // k for n, k in taken.items())
        at = 0
        for n, k in taken.items():
            rows.append((n, used[n], bins, k, at))
            at += n * k
            used[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5), bins


def pack(parts: DataFrame, *, length: str = "length", size: int = SIZE) -> DataFrame:
    """parts with sequence_id and offset; lengths are 1 to size, and no sequence exceeds size. Other
    columns pass, whatever their names, but for these two, which may not be there before."""
    spark = parts.sparkSession
    p = prefix(parts.columns)
    row, bucket, within, rank = (p + x for x in ("row", "bucket", "within", "rank"))
    rows = materialize(parts.withColumn(row, F.monotonically_increasing_id()), "pieces")
    counts = {r[0]: r[1] for r in rows.groupBy(column(length).alias("length")).count().collect()}  # at most size rows
    if any(n is None or not 0 < n <= size for n in counts):
        raise ValueError(f"lengths have to be 1 to {size}")
    bins, _ = plan(counts, size)
    buckets = bucket_count(sum(counts.values()), RANKED_TOGETHER)
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(row), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(f"{p}length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(column(length).alias(f"{p}length"), bucket).count().withColumn(f"{p}before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count").withColumnRenamed(bucket, f"{p}of")
    ranked = rows.withColumn(within, F.row_number().over(Window.partitionBy(column(length), bucket).orderBy(row)))
    ranked = ranked.join(offsets, (column(length) == F.col(f"{p}length")) & (F.col(bucket) == F.col(f"{p}of"))).withColumn(rank, F.col(within) - 1 + F.col(f"{p}before"))
    table = spark.sparkContext.broadcast(bins)
    kept = parts.schema.fields
    at = parts.columns.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = t[:, 0] << 44 | t[:, 1]
        for b in batches:
            n, k = b.column(at).to_numpy().astype(np.int64), b.column(len(kept)).to_numpy()
            row = t[np.searchsorted(key, n << 44 | k, "right") - 1]
            times, slot = np.divmod(k - row[:, 1], row[:, 3])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(row[:, 2] + times), pa.array(row[:, 4] + slot * n)], [*(f.name for f in kept), "sequence_id", "offset"])

    return ranked.select(*[column(f.name) for f in kept], rank).toDF(*map(str, range(len(kept) + 1))).mapInArrow(run, T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """pieces() and pack() in one; an empty table gives no rows."""
    return pack(pieces(docs, path, doc_id=doc_id, text=text, size=size, end_id=end_id), size=size)
