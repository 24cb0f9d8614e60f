"""Token counts of whole texts, without making token ids.

A byte-level BPE tokenizer cuts a text into pre-tokens and encodes each on its own, so a document
has the sum of its pre-tokens' counts. Documents are taken in blocks of about BLOCK_CHARS characters:
a block keeps how often each of its documents has each of the block's pre-tokens, by place in the
block's list, and sends each of these once to where equal pre-tokens meet. There each distinct
pre-token of the corpus is encoded once, and its count goes back to the blocks that have it, is
joined to the frequencies, and summed. A frequent pre-token costs one row per block, not one per
document or occurrence.

Blocks are numbered by task and order. Input that is replayed in another order after an executor is
lost would mix two numberings, so hand in files or a table, not the result of a shuffle.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 24_000_000
LIMIT = 1024
#: Fixed value: the pattern of the byte-level pre-tokenizer.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: UTF-8 has this byte and higher ones only for U+0540 and beyond; below, all libraries' tables agree.
RARE_BYTE = 0xD5


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _specials(path: str) -> re.Pattern[str] | None:
    """Matches the strings that the tokenizer cuts out first, each of them one token."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    pre, added = model["pre_tokenizer"] or {}, model["added_tokens"]
    if model["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
        raise ValueError("only a byte-level tokenizer without normalizer and prefix space is counted by pre-tokens")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError("added tokens that take in their surroundings aren't supported")
    return re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None


def pre_tokens(text: str, raw: bytes, path: str) -> tuple[Counter[str], int]:
    """How often text has each pre-token, and how many special tokens. raw: text in UTF-8."""
    cut = _specials(path)
    parts = cut.split(text) if cut else [text]
    # Characters that this Python doesn't know may be classed differently by the two libraries.
    if raw and np.frombuffer(raw, np.uint8).max() >= RARE_BYTE and any(unicodedata.category(c) == "Cn" for c in set(text)):
        own = tokenizer(path).pre_tokenizer
        found = Counter(p[a:b] for p in parts for _, (a, b) in own.pre_tokenize_str(p))
    else:
        found = Counter(PIECES.findall(parts[0]))
        for p in parts[1:]:
            found.update(PIECES.findall(p))
    return found, len(parts) - 1


def _blocks(path: str, block_chars: int, id_type: pa.DataType) -> Callable:
    """Documents to rows of block, place, word, docs: a block's documents at place -1, its words from 0."""

    def pack(ids, sizes, special, at, times) -> bytes:
        rows = pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), pa.array(sizes, pa.int64()), pa.array(special, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
            ["id", "n_bytes", "special", "at", "times"],
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(rows)
        return sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        names = ["block", "place", "word", "docs"]

        def out(docs, words):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([None], pa.string()), pa.array([pack(*docs)], pa.binary())], names)
            words = list(words)
            for k in range(0, len(words), 50_000):
                part = words[k : k + 50_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(k, k + n, dtype=np.int32)), pa.array(part, pa.string()), pa.nulls(n, pa.binary())], names)

        docs, words, chars = ([], [], [], [], []), {}, 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                raw = text.encode()
                found, special = pre_tokens(text, raw, path)
                at = np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found))
                times = np.fromiter(found.values(), np.int32, len(found))
                order = np.argsort(at)
                at = at[order]
                at[1:] -= at[:-1].copy()  # gaps pack better
                for column, v in zip(docs, (doc_id, len(raw), special, at, times[order])):
                    column.append(v)
                chars += len(text)
                if chars >= block_chars:
                    yield from out(docs, words)
                    block, docs, words, chars = block + 1, ([], [], [], [], []), {}, 0
        if docs[0]:
            yield from out(docs, words)

    return run


def _count(path: str) -> Callable:
    """Sorted words to their counts; other rows pass. A word is encoded once, where it first comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_n = None, 0
        for b in batches:
            word = b.column("word").dictionary_encode()
            new = word.dictionary.to_pylist()
            counts = np.array([last_n if w == last and last is not None else -1 for w in new], np.int64)
            todo = [k for k, n in enumerate(counts) if n < 0]
            for k, e in zip(todo, tokenizer(path).encode_batch_fast([new[k] for k in todo], add_special_tokens=False)):
                counts[k] = len(e.ids)
            if new:
                last, last_n = new[-1], int(counts[-1])
            n = pa.array(counts, pa.int64()).take(word.indices)
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("place"), n, b.column("docs")], ["block", "place", "n", "docs"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block and place to a row per document."""

    def out(docs: bytes, counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        for rows in pa.ipc.open_stream(docs):
            at, times = rows.column("at"), rows.column("times")
            ends = at.offsets.to_numpy()
            gaps, times = at.values.to_numpy(), times.values.to_numpy()
            total = np.zeros(rows.num_rows, np.int64)
            for k in range(rows.num_rows):
                own = slice(ends[k], ends[k + 1])
                total[k] = n[np.cumsum(gaps[own])] @ times[own]
            total += rows.column("special").to_numpy()
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("n_bytes"), pa.array(total)], ["id", "n_bytes", "n_tokens"])

    docs, counts = None, []
    for b in batches:
        place = b.column("place").to_numpy()
        n = b.column("n").to_numpy(zero_copy_only=False)
        first = 0
        for k in np.flatnonzero(place < 0):
            if docs is not None:
                counts.append(n[first:k].astype(np.int64))
                yield from out(docs, counts)
            docs, counts, first = b.column("docs")[int(k)].as_py(), [], k + 1
        counts.append(n[first:].astype(np.int64))
    if docs is not None:
        yield from out(docs, counts)


def count_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row per row of docs.

    path: the tokenizer's .json, there on every executor. Null texts count as empty; strings of
    special tokens inside a text count as these; repeated rows and null ids come out as they went in.
    Other columns are ignored.
    """
    field = docs.schema[doc_id]
    kind = field.dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    blocks = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(_blocks(path, block_chars, to_arrow_type(field.dataType)), "block long, place int, word string, docs binary")
    by_word = blocks.repartition("word", F.when(F.col("word").isNull(), F.col("block"))).sortWithinPartitions("word")
    counted = by_word.mapInArrow(_count(path), "block long, place int, n long, docs binary")
    by_block = counted.repartition("block").sortWithinPartitions("block", "place")
    return by_block.mapInArrow(_sum, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
