"""The pipeline against plain versions of its stages, each on its own input."""

import re

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as c  # noqa: E402
from trailmark.llm import mixing, quality  # noqa: E402
from trailmark.llm.common import materialize  # noqa: E402

from .test_operators import brute_components, check_bins  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.columns
    for name, stage in c.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = materialize(stage(spark, docs, SF), name)
        got = out.collect()
        if name != "packing":
            assert out.columns == own
        ids = {r["doc_id"] for r in got}
        if name == "quality_rules":
            mask = quality.mask(quality.POLICY)
            led = {r["doc_id"]: r["failed"] for r in quality.ledger(docs).collect()}
            assert ids == {i for i in before if not led[i] & mask}
        elif name == "line_dedup":
            seen = set()
            want = {}
            for i in sorted(before):
                ls = before[i]["text"].split("\n")
                full = [k for k, x in enumerate(ls) if re.search(r"[^\x20\x09-\x0D]", x)]
                gone = set()
                for a, b, z in zip(full, full[1:], full[2:]):
                    key = (ls[a], ls[b], ls[z])
                    if key in seen:
                        gone |= set(range(a, z + 1))
                    seen.add(key)
                text = "\n".join(x for k, x in enumerate(ls) if k not in gone)
                if not gone or text.strip():
                    want[i] = text
            assert {r["doc_id"]: r["text"] for r in got} == want
            assert all(r["n_chars"] == len(r["text"]) for r in got)
        elif name == "near_duplicates":
            comp = brute_components([(i, r["text"]) for i, r in before.items()], 5, 80)
            assert ids == {i for i, (n, k) in comp.items() if i == k}
        elif name == "mixing":
            copies = {r["doc_id"]: r["__copies"] for r in mixing.mix(docs).collect()}
            count = {}
            for r in got:
                count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
            assert count == {i: n for i, n in copies.items() if n}
        else:
            bins = check_bins(got, 4096)
            assert bins <= -(-sum(r["length"] for r in got) // 4096) + 1
        docs = out
