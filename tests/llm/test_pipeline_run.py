"""run() of the pipeline against a plain version of all five stages, on given documents with edge rows among them."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline as c  # noqa: E402
from trailmark.llm.queries import PACKED_BY, tokenizer_file  # noqa: E402

from .test_operators import check_bins  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def good(text):
    """The rules of policy 2026-1, told plainly."""
    words = WORDS.findall(text)
    n, chars = len(words), "".join(words)
    at = {}
    for k in range(n - 2):
        at.setdefault(tuple(words[k : k + 3]), []).append(k)
    again = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    letters = sum(x.isalpha() for x in chars)
    return not (
        n < 50
        or 100 * len(again) > 50 * n
        or 10 * sum(text.count(s) for s in "#*$%&|<>") > n
        or (len(lines) >= 4 and 100 * (len(lines) - len(set(lines))) > 30 * len(lines))
        or len(chars) < 2 * n
        or len(chars) > 20 * n
        or 100 * letters < 50 * len(chars)
        or 100 * sum(x.isupper() for x in chars) > 50 * letters
    )


def without_repeats(docs):
    """Three lines with a word that came before, in the order of ids, go, with what lies between."""
    first, cleaned = {}, {}
    order = sorted({(d["doc_id"], d["text"]) for d in docs}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for who in order:
        lines = who[1].split("\n")
        full = [k for k, x in enumerate(lines) if WORDS.search(x)]
        gone = set()
        for x, y, z in zip(full, full[1:], full[2:]):
            place = (who, x)
            if first.setdefault((lines[x], lines[y], lines[z]), place) != place:
                gone |= set(range(x, z + 1))
        cleaned[who] = "\n".join(x for k, x in enumerate(lines) if k not in gone), bool(gone)
    out = []
    for d in docs:
        text, changed = cleaned[d["doc_id"], d["text"]]
        if not changed or WORDS.search(text):
            out.append(d | {"text": text, "n_chars": len(text) if changed else d["n_chars"]})
    return out


def one_of_each(docs):
    sets = {}
    for d in docs:
        if d["doc_id"] is not None:
            w = [x.translate(LOWER) for x in WORDS.findall(d["text"])]
            sets[d["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                comp[max(root(i), root(j))] = min(root(i), root(j))
    return [d for d in docs if d["doc_id"] is None or root(d["doc_id"]) == d["doc_id"]]


def mixed(docs):
    size = Counter()
    for d in docs:
        size[d["source"]] += len(WORDS.findall(d["text"]))
    named = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(named)}
    target, open_, left = {}, set(named), sum(size.values())
    while open_:
        share = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    out = []
    for d in docs:
        rate = min(target[d["source"]] / size[d["source"]], 3) if size[d["source"]] else 0
        drawn = int(hashlib.md5(f"{c.mixing.SEED}:{'null' if d['doc_id'] is None else d['doc_id']}".encode()).hexdigest()[:13], 16) / 16**13
        out += [d] * (int(rate) + (drawn < rate - int(rate)))
    return out


def pieces(docs):
    tokenizer = Tokenizer.from_file(tokenizer_file(PACKED_BY))
    out = []
    for d in docs:
        ids = np.array([*tokenizer.encode(d["text"], add_special_tokens=False).ids, 1], "<u4")
        out += [(d["doc_id"], k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    return out


LONG = " ".join(f"word{k % 977}x{k % 13}" for k in range(12_000)).translate({48 + k: 97 + k for k in range(10)})
TEXT = "Some words of its own that no other document has, told at length so that the rules let it pass: " + " ".join(f"{a}{b}ly" for a in ("quick", "slow", "soft", "hard", "cold") for b in ("er", "en", "al", "ing", "ist", "ous", "ful", "ish"))


def edge_rows():
    text = lambda k: TEXT.replace("words", f"words{k}").replace("own", f"own{k}").replace("length", f"length{k}")
    rows = [(90_001, None, "en", "src0", None), (90_002, "", None, None, 0), (90_003, " \n\t ", "en", "src1", 4), (90_004, LONG, "en", None, len(LONG)), (None, text("a"), "en", "src2", 1), (90_005, text("b") + "\n1 2\n3 4\n5 6", None, None, None)]
    rows += [(90_006, "\n".join([text("c") * 2, "1 2", "3 4", "5 6", text("d")]), "en", "src3", 7)] * 2
    return rows + [(90_007, text("b") + " more", "en", "src3", 7), (90_008, LONG + " end", "en", "alone", 9)]


def test_run(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = given.unionByName(spark.createDataFrame(edge_rows(), given.schema))
    docs = docs.withColumns({"__size": F.lit(1), "a.b": F.lit(2), "length": F.lit(3), "piece": F.lit("x")})
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r.asDict() for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    kept = [r for r in rows if good(r["text"] or "")]
    deduped = without_repeats(kept)
    single = one_of_each(deduped)
    want = pieces(mixed(single))
    got = c.run(spark, str(tmp_path)).collect()
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[x] for x in columns) for r in got) == Counter(want)
    left = {d["doc_id"] for d in single}
    assert len(kept) < len(rows) and len(single) < len(deduped) and {None, 90_004, 90_005} <= left and not {90_001, 90_002, 90_003, 90_008} & left
    total = sum(w[3] for w in want)
    assert check_bins(got, 4096) <= -(-total // 4096) + 1


def test_run_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert c.run(spark, str(tmp_path)).collect() == []
