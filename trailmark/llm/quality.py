"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; policies are masks over those bits with a version name, and ablations are bitwise sums over
the ledger, so that no text is read again to try another policy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, prefix

GAPS = {ord(c): None for c in " \t\n\x0b\x0c\r"}
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")

#: Rules in the order of their bits: name and the condition under which a document fails.
RULES = {
    "few_words": "n_words < 50",
    "repetition": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "few_letters": "100 * n_letters < 50 * word_chars",
    "shouting": "100 * n_upper > 50 * n_letters",
}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("few_words", "repetition"),
    "2026-1": tuple(RULES),
}
POLICY = "2026-1"


@cache
def _kinds() -> np.ndarray:
    """Of every code point: 1 for a letter, 3 for an upper-case letter."""
    return np.fromiter((chr(c).isalpha() + 2 * chr(c).isupper() for c in range(0x110000)), np.uint8, 0x110000)


def _measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = text.translate(GAPS)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    kinds = _kinds()[np.frombuffer(chars.encode("utf-32-le"), "<u4")]
    symbols = sum(map(chars.count, SYMBOLS))
    return n, len(chars), symbols, len(lines), len(lines) - len(set(lines)), _repeated(words), int((kinds & 1).sum()), int((kinds >> 1).sum())


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, at, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    found = (times > 1)[at]
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= found
    return int(inside.sum())


def with_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and, after their own columns, __<measure> for each measure and __failed, the failure bits; with
    more underscores if docs has such names.

    One pass without a shuffle. Null texts measure as empty, repeated rows repeat, an empty table
    gives an empty ledger, other columns pass through.
    """
    p = prefix(docs.columns)
    names = [p + x for x in MEASURES]
    at, own = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_measure(x) for x in b.column(at).to_pylist()]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in cols)], [*own, *names])

    measured = docs.toDF(*map(str, range(len(own)))).mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in names)]))
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES.values()):
        for x in MEASURES:
            rule = re.sub(rf"\b{x}\b", p + x, rule)
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn(f"{p}failed", bits)


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the measures and failed: one row per row of docs."""
    led = with_ledger(docs.select(column(key).alias("key"), column(text).alias("text")))
    return led.select(F.col("key").alias(key), *[F.col(f"__{x}").alias(x) for x in (*MEASURES, "failed")])


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def passes(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(led: DataFrame, policy: str = POLICY) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that it alone rejects."""
    bit = {r: 1 << list(RULES).index(r) for r in POLICIES[policy]}
    rejects = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    total = lambda what: F.coalesce(F.sum(what.cast("long")), F.lit(0))
    sums = led.agg(F.count("*").alias("n"), *[total(rejects.bitwiseAND(F.lit(b)) != 0).alias(f"fail_{r}") for r, b in bit.items()], *[total(rejects == b).alias(f"only_{r}") for r, b in bit.items()])
    rows = [F.struct(F.lit(r).alias("rule"), F.col(f"fail_{r}").alias("fails"), F.col(f"only_{r}").alias("fails_alone")) for r in bit]
    return sums.select(F.lit(policy).alias("policy"), "n", F.inline(F.array(*rows)))


def keep_good(docs: DataFrame, policy: str = POLICY, text: str = "text") -> DataFrame:
    """The rows of docs that the policy lets pass, with their own columns."""
    return with_ledger(docs, text).filter(passes(policy, prefix(docs.columns) + "failed")).select(*map(column, docs.columns))
