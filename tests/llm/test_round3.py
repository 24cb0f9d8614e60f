"""Circulant MinHash, source divergence and lexical search against plain versions and SQL."""

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from trailmark.llm import divergence, lexical, minhash, oracles, queries, topk  # noqa: E402

from .test_operators import EDGE, LONG, SCHEMA, brute_components  # noqa: E402

SF = "/root/testdata/sf0.001"
#: Beside the edge rows: groups of many terms, ties, capitals beyond ASCII, digits, apostrophes, a lang without terms.
MORE = [(100 + k, f"Äpfel Birnen {'z' * (k % 3 + 1)} Straße x{k % 7} it's 7up é" + " rare" * (k % 5), ["s", "t", None][k % 3], *[k] * 5, "a") for k in range(120)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(EDGE + MORE, SCHEMA).withColumnRenamed("a", "lang")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA).withColumnRenamed("a", "lang")


def same(con, sql, df):
    names = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=key) == want
    return want


def connected(documents, benchmark):
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    return con


def given(name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_lexical_search"])
def test_given_tables(spark, name):
    assert same(given(name), queries.oracle_sql()[name], queries.queries()[name](spark, SF))


def test_divergence_edges(rows, none):
    got = divergence.audit(rows)
    want = same(connected(rows.toArrow(), none.toArrow()), oracles.OP12, got)
    assert {r[2] for r in want} == {"pair", "term"}
    assert divergence.audit(none).collect() == []


def test_divergence_merges_equal_values(spark):
    """More terms of one value than ranks: they come in order of their bytes, whatever the cell."""
    text = lambda k: " ".join(f"t{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(200)) if k % 2 else "ta zz"
    docs = spark.createDataFrame([(k, text(k), "s" if k % 2 else "t", "en") for k in range(80)], "doc_id long, text string, source string, lang string")
    same(connected(docs.toArrow(), docs.toArrow()), oracles.OP12, divergence.audit(docs))


def test_search_edges(spark, rows, none):
    items = spark.createDataFrame([(1, "Straße Birnen x1"), (2, "cat DOG rare"), (3, None), (4, "?!"), (5, "missing"), (2, "z zz zzz"), (None, "birnen straße rare")], "item_id long, text string")
    for terms_a_block in (100_000, 4):
        got = lexical.search(rows, items, terms_a_block=terms_a_block)
        want = same(connected(rows.toArrow(), items.toArrow()), oracles.OP13, got)
        assert len(want) > 100
    assert lexical.search(none, items).collect() == []
    assert lexical.search(rows, items.limit(0)).collect() == []
    assert lexical.search(rows, items, ranks=1).count() == 3
    huge = lexical.search(rows.withColumnRenamed("doc_id", "a.b").withColumnRenamed("n_chars", "m"), items, doc_id="a.b")
    assert huge.columns == ["item_id", "rank", "a.b", "score"] and huge.count() == len(want)


def test_mined_plan_gives_each_item_its_terms():
    """Nodes are unfolded into terms: each item has each of its terms once; sharing saves additions."""
    rng = np.random.default_rng(3)
    for n_items, n_terms, paired in ((1, 5, 500), (60, 40, 500), (60, 40, 3), (40, 300, 500), (3, 0, 500)):
        base = [rng.choice(n_terms, size=min(n_terms, 12), replace=False).tolist() for _ in range(4)]
        items = [sorted({*base[k % 4], *rng.choice(n_terms, size=min(n_terms, 6), replace=False).tolist()}) for k in range(n_items)]
        lexical.PAIRED, before = paired, lexical.PAIRED
        plan = lexical.mined(items, n_terms)
        lexical.PAIRED = before
        inside = [[t for t in range(n_terms) if plan.group[t] == g] for g in range(int(plan.group.max(initial=-1)) + 1)]
        for layer in plan.layers:
            inside += [inside[x] + inside[y] for x, y in layer]
        assert len(inside) == plan.nodes
        assert [sorted(t for x in nodes for t in inside[x]) for nodes in plan.items] == items
        if n_items == 60:
            assert plan.additions < sum(map(len, items))


def test_permutations_and_estimates():
    """Both chains of steps are one-to-one; two sets agree in as many coordinates as they are similar."""
    x = np.unique(np.random.default_rng(1).integers(0, 2**32, 1_000_000).astype(np.uint32))
    for by in (minhash.SIGMA, minhash.PI):
        assert len(np.unique(minhash.permuted(x.copy(), by))) == len(x)
    rng = np.random.default_rng(2)
    for common, apart in ((400, 50), (100, 100), (30, 2)):
        agree = []
        for _ in range(30):
            s = rng.integers(0, 2**63, common + 2 * apart).astype(np.uint64)
            agree.append((minhash.signature(s[: common + apart], 200) == minhash.signature(np.concatenate((s[:common], s[common + apart :])), 200)).mean())
        assert abs(np.mean(agree) - common / (common + 2 * apart)) < 0.03


def test_minhash(spark):
    rng = np.random.default_rng(11)
    texts, n = [], 0
    for base in range(40):
        words = [f"v{rng.integers(300)}" for _ in range(int(rng.integers(1, 150)))]
        for _ in range(int(rng.integers(1, 6))):
            w = list(words)
            for _ in range(int(rng.integers(0, 1 + len(w) // 20))):
                w[int(rng.integers(len(w)))] = f"N{n}"
                n += 1
            texts.append((len(texts), " ".join(w)))
    chain = [f"c{k}" for k in range(60)]
    for k in range(0, 60, 2):  # each is similar to its neighbours only
        texts.append((len(texts), " ".join(chain[k : k + 40] if k + 40 <= 60 else chain[k:] + [f"d{j}" for j in range(k - 20)])))
    texts += [(len(texts), "One two"), (len(texts) + 1, "one TWO\n"), (len(texts) + 2, None), (len(texts) + 3, " \t")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.link(docs).collect()}
    want = brute_components(texts, 4, 80)
    assert got == want and len({c for _, c in want.values()}) < len(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in minhash.link(docs).collect())


def test_minhash_edges(rows, none):
    got = minhash.link(rows.withColumnRenamed("source", "cid").withColumnRenamed("lang", "keys")).collect()
    assert len(got) == len(EDGE) + len(MORE)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["component_id"] == 1 and by_id[2]["n_shingles"] == by_id[3]["n_shingles"] == by_id[5]["n_shingles"] == 0
    assert by_id[2]["kept"] and by_id[None]["component_id"] is None and by_id[None]["kept"]
    w = LONG.split()
    assert by_id[4]["n_shingles"] == len({tuple(w[k : k + 4]) for k in range(len(w) - 3)})
    assert by_id[6]["kept"] and by_id[7]["kept"]
    assert minhash.link(none).collect() == []


def test_scores_beyond_64_bits_are_an_error(spark):
    schema = "vec_id long, embedding array<double>"
    large = spark.createDataFrame([(1, [1.0] * 8), (2, [3e7] * 8)], schema)
    with pytest.raises(Exception, match="scores of vector 2 don't fit"):
        topk.top_k(large, F.col("__id") == 1).collect()
    most = 7e5  # 8 * (1024 * 7e5)^2 is just below 2^62
    near = spark.createDataFrame([(1, [most] * 8), (2, [-most] * 8), (3, [most] * 7 + [0.0]), (4, [])], schema)
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(near, F.col("__id") == 1).orderBy("rank").collect()]
    one = int(most * 1024) ** 2
    assert got == [(3, 7 * one), (2, -8 * one)]
