import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from trailmark.llm import chat, graph, jaccard, lines, mixing, packing, quality, sharding, tokens, topk, urls  # noqa: E402
from trailmark.llm.queries import COUNTED_BY, PACKED_BY, tokenizer_file  # noqa: E402

SCHEMA = "doc_id long, text string, source string, n_chars long, low long, count long, size long, e long, a string"
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(30_000))
#: Nulls in each column, empty and very long texts, ties, repeated rows, columns with clashing names.
EDGE = [
    (1, "the cat sat on the mat and looked at the dog", "s", 1, 1, 1, 1, 1, "x"),
    (1, "the cat sat on the mat and looked at the dog", "s", 1, 1, 1, 1, 1, "x"),
    (2, None, "s", None, None, None, None, None, None),
    (3, "", None, 0, 0, 0, 0, 0, ""),
    (None, "no id here at all", "t", 3, 3, 3, 3, 3, "y"),
    (4, LONG, "t", len(LONG), 4, 4, 4, 4, "z"),
    (5, " \t\n ", "u", 4, 5, 5, 5, 5, "z"),
    (6, "a\nb\nc\nd", "u", 7, 6, 6, 6, 6, "z"),
    (7, "a\nb\nc\ne", "u", 7, 7, 7, 7, 7, "z"),
    (8, "<|endoftext|> ok ՘ x", "u", 7, 7, 7, 7, 7, "z"),
]


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("edge") / "docs")
    spark.createDataFrame(EDGE, SCHEMA).coalesce(2).write.parquet(p)
    return spark.read.parquet(p)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(edge):
    """Columns that are named as an operator names its own."""
    named = "__size __copies __gone __failed __n_words __n_lines __slot __p __row __rank __bucket __id __likely a.b ___x".split()
    return edge.select("*", *[F.lit(k).alias(n) for k, n in enumerate(named)])


def test_clashing_names(clashing, edge):
    n = len(EDGE)
    for out in (quality.keep_good(clashing), lines.without_repeats(clashing), jaccard.keep_first(clashing), mixing.emit(mixing.mix(clashing))):
        assert out.columns == clashing.columns
        assert all(r["__size"] == 0 and r["__gone"] == 2 and r["a.b"] == 13 for r in out.collect())
    for out, more in ((quality.with_ledger(clashing), 9), (lines.dedup_lines(clashing), 2), (mixing.mix(clashing), 4), (sharding.place(clashing), 3)):
        assert out.columns[:-more] == clashing.columns and len(set(out.columns)) == len(out.columns) and out.count() == n
    assert mixing.mix(clashing).select(F.sum("____copies")).first()[0] == mixing.mix(edge).select(F.sum("__copies")).first()[0]
    packed = packing.pack(clashing.select("*", F.lit(60).alias("the.length")), length="the.length", size=100)
    assert packed.count() == n and packed.select("sequence_id").distinct().count() == n


def naive_fill(names, slots):
    """The table filled by walking each shard's whole preference list, turn by turn."""
    wishes = []
    for name in names:
        d = hashlib.md5(name.encode()).digest()
        start, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        wishes.append([(start + k * step) % slots for k in range(slots)])
    owner = {}
    while len(owner) < slots:
        for k, wish in enumerate(wishes):
            free = [s for s in wish if s not in owner]
            if free:
                owner[free[0]] = k
    return [owner[s] for s in range(slots)]


def test_fill_as_naive():
    for names, slots in ((["a"], 2), ([f"s{k}" for k in range(7)], 101), ([f"n{k}" for k in range(30)], 211)):
        assert sharding.fill(names, slots) == naive_fill(names, slots)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 1e3, 1e6, 1e7]), st.booleans())
def test_search_is_exact(seed, scale, collinear):
    """Large, negative, tied and collinear vectors, with pivots among them."""
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(700, 4)) * scale)
    if collinear:
        x = np.floor(rng.integers(1, 50, size=(700, 1)) * np.array([[1.0, 2.0, 3.0, 4.0]]) * scale)
    q = np.concatenate([-x[:3], x[3:6]])
    ids, qids = np.arange(700), np.array([900, 901, 902, 3, 4, 5])
    exact = [[int(c) for c in r] for r in x]
    for i, best, score in topk._search(qids, q, ids, x, x[10:40], 10):
        own = [int(c) for c in q[list(qids).index(i)]]
        want = sorted((-sum(a * b for a, b in zip(own, r)), k) for k, r in enumerate(exact) if k != i)[:10]
        assert [(-int(s), int(k)) for s, k in zip(score, best)] == want


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_tokens(spark, edge, none):
    from tokenizers import Tokenizer

    path = tokenizer_file(COUNTED_BY)
    t = Tokenizer.from_file(path)
    want = sorted(((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x, *_ in EDGE), key=str)
    for block in (10, 10**9):
        assert rows(tokens.count_tokens(edge, path, block_chars=block)) == want
    assert rows(tokens.count_tokens(none, path)) == []


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_pre_tokens(text):
    path = tokenizer_file(COUNTED_BY)
    t = tokens.tokenizer(path)
    found, special = tokens.pre_tokens(text, text.encode(), path)
    n = sum(k * len(t.encode(w, add_special_tokens=False).ids) for w, k in found.items())
    assert n + special == len(t.encode(text, add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_chunked_ids(texts):
    path = tokenizer_file(PACKED_BY)
    t = packing._tokenizer(path)
    assert list(packing.encode(texts, path)) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def check_bins(got, size):
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= size
    return len(bins)


def test_packing(spark, edge, none):
    path = tokenizer_file(PACKED_BY)
    t = packing._tokenizer(path)
    want = []
    for i, x, *_ in EDGE:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, at, len(ids[at : at + 100]), zlib.crc32(ids[at : at + 100].tobytes())) for k, at in enumerate(range(0, len(ids), 100))]
    got = packing.pack_documents(edge, path, size=100).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert check_bins(got, 100) <= -(-sum(w[3] for w in want) // 100) + 1
    assert rows(packing.pack_documents(none, path)) == []


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=8))
def test_plan(counts):
    table, bins = packing.plan(counts, 30)
    places = []
    for n, first, bin_, k, at in table.tolist():
        nxt = min([r[1] for r in table.tolist() if r[0] == n and r[1] > first], default=counts[n])
        places += [(bin_ + q // k, at + q % k * n, n) for q in range(nxt - first)]
    assert Counter(p[2] for p in places) == Counter(counts)
    for b in range(bins):
        end = 0
        for _, at, n in sorted(p for p in places if p[0] == b):
            assert at == end
            end += n
        assert 0 < end <= 30


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), min_size=1, max_size=5))
def test_fullest(counts):
    best = {0}
    for n, c in counts.items():
        best = {s + k * n for s in best for k in range(c + 1) if s + k * n <= 25}
    taken = packing.fullest(counts, 25)
    assert sum(n * k for n, k in taken.items()) == max(best) and all(k <= counts[n] for n, k in taken.items())


def test_lines(spark, edge, none):
    got = {(r["doc_id"], r["text"]) for r in lines.dedup_lines(edge).collect()}
    assert (6, "a\nb\nc\nd") in got and (7, "e") in got
    assert {(1, EDGE[0][1]), (2, None), (3, ""), (None, "no id here at all"), (4, LONG)} <= got
    out = lines.dedup_lines(edge)
    assert out.columns == [*edge.columns, "__n_lines", "__n_removed"] and out.count() == len(EDGE)
    assert lines.without_repeats(edge).columns == edge.columns
    assert rows(lines.dedup_lines(none)) == []
    docs = spark.createDataFrame([(1, "p\nq\nr\ns\nt"), (2, "q\n\nr\ns\nz"), (3, "p\nq\nr\ns\nt"), (4, "n\nn\nn\nn\nn")], "doc_id long, text string")
    assert {tuple(r)[:2] for r in lines.dedup_lines(docs).collect()} == {(1, "p\nq\nr\ns\nt"), (2, "z"), (3, ""), (4, "n")}


def brute_components(texts, width, share):
    sets = {}
    for i, t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= share * len(a | b) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return {i: (len(s), comp[i]) for i, s in sets.items()}


@pytest.mark.parametrize("width,share,dear_at", [(4, 85, 2048), (5, 80, 2048), (4, 85, 0), (5, 80, 0)])
def test_jaccard(spark, monkeypatch, width, share, dear_at):
    """Also where every bucket of several components is dear, so that all of their classes are indexed again."""
    monkeypatch.setattr(jaccard, "PAIRS_A_ENTRY", dear_at)
    monkeypatch.setattr(jaccard, "LINKING_ROUNDS", 1 if dear_at == 0 else 3)
    rng = np.random.default_rng(7)
    texts, n = [], 0
    for base in range(30):
        words = [f"v{rng.integers(200)}" for _ in range(int(rng.integers(1, 120)))]
        for _ in range(int(rng.integers(1, 6))):
            w = list(words)
            for _ in range(int(rng.integers(0, 3))):
                w[rng.integers(len(w))] = f"V{rng.integers(200)}"
            w += [f"t{rng.integers(99)}" for _ in range(int(rng.integers(0, 3)))]
            texts.append((n, " ".join(w)))
            n += 1
    # Near copies just below and above the threshold, and a passage that many share.
    words = [f"y{k}" for k in range(100)]
    for k in range(25):
        w = list(words)
        for at in rng.choice(100, 2 + k % 3, replace=False):
            w[at] = f"q{k}"
        texts.append((500 + k, " ".join(w)))
        texts.append((600 + k, " ".join(words[:30] + [f"own{k}w{j}" for j in range(int(rng.integers(5, 60)))])))
    texts += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, LONG), (1005, LONG + " tail")]
    got = {r[0]: (r[1], r[2]) for r in jaccard.link(spark.createDataFrame(texts, "doc_id long, text string"), width=width, share=share).collect()}
    assert got == brute_components(texts, width, share)


def test_jaccard_edges(edge, none):
    got = rows(jaccard.link(edge))
    assert [r[2] for r in got if r[0] == 1] == [1, 1] and (2, 0, 2) in got and (None, 2, None) in got and len(got) == len(EDGE)
    assert rows(jaccard.link(none)) == []
    kept = jaccard.keep_first(edge)
    assert kept.columns == edge.columns and kept.count() == len(EDGE)


def meet(one, two):
    """Whether two lists of entries share one that is a whole part of either."""
    a, b = (dict(zip(e.tolist(), w.tolist())) for e, w in (one, two))
    return any(w or b[e] for e, w in a.items() if e in b)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 2**63), min_size=8, max_size=90), st.integers(0, 5), st.integers(0, 5), st.integers(1, 8))
def test_entries_meet_without_dear_ones(base, less, more, one_in):
    """Whatever is similar shares an entry that isn't dear, whichever parts are, or is indexed whole."""
    items = sorted(base)
    one, two = set(items), {*items[less:], *(2**63 + k for k in range(more))}
    if 100 * len(one & two) >= 80 * len(one | two):
        a, b = (np.array(sorted(x), np.uint64) for x in (one, two))
        every = np.concatenate([jaccard.possible_entries(x, 80, 100) for x in (a, b)])
        dear = every[every % np.uint64(one_in) == 0]
        own = [np.intersect1d(jaccard.possible_entries(x, 80, 100), dear) for x in (a, b)]
        assert meet(jaccard.entries(a, 80, 100, own[0]), jaccard.entries(b, 80, 100, own[1]))


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 2**63), min_size=1, max_size=40), st.integers(0, 3), st.integers(0, 3))
def test_entries_meet(base, less, more):
    """Whatever is similar shares an entry, also where segments are empty."""
    items = sorted(base)
    a = np.array(items, np.uint64)
    b = np.array(sorted({*items[less:], *(2**63 + k for k in range(more))}), np.uint64)
    if len(b) and 100 * len(set(items[less:])) >= 80 * (len(items) + more):
        assert meet(jaccard.entries(a, 80, 100), jaccard.entries(b, 80, 100))


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 102), (101, 102)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[k] == 0 for k in range(41)) and got[102] == got[101] == 100


def test_chat(spark):
    messages = [("t", 1, None, "user", "hi \\ <|im_end|>", 1.0), ("t", 2, 1, "assistant", None, 0.5), ("t", 3, 1, "assistant", "best\n<|x", 2.0), ("t", 4, 3, "user\nx", "", None), ("t", 5, 2, "user", "q", 0.1), ("u", 1, 9, "assistant", "lone", 0.0)]
    df = spark.createDataFrame(messages, "tree string, id long, parent long, role string, text string, score double").withColumn("rank", F.lit("clash"))
    out = {r["tree"]: r for r in chat.read_back(chat.format_trees(df)).collect()}
    assert out["t"]["dialogue"] == "user\nhi \\ <|im_end|>\nassistant\nbest\n<|x\nuser\nx\n\n" and out["t"]["learned"] == "best\n<|x" and out["t"]["n_turns"] == 3
    assert out["u"]["learned"] == "lone" and out["t"]["leaf"] == 4
    every = chat.format_trees(df, best=None).select("tree", "leaf", "rank").collect()
    assert {tuple(r) for r in every} == {("t", 4, 1), ("t", 5, 2), ("u", 1, 1)}
    assert rows(chat.format_trees(df.limit(0))) == []


def test_chat_threads(spark):
    data = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", None), (None, 1, "assistant", "x"), *((2, k, "user" if k % 2 else "assistant", f"m{k}") for k in range(70))]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r["tree"]: r for r in chat.read_back(chat.format_trees(chat.threads(df))).collect()}
    assert got["1"]["dialogue"] == "user\n\nuser\na\nuser\na\n" and got["null"]["learned"] == "x"
    assert got["2"]["learned"] == "".join(f"m{k}" for k in range(0, 70, 2)) and got["2"]["n_turns"] == 70


def test_topk(spark):
    rng = np.random.default_rng(3)
    vecs = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(300)]
    vecs += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, vecs[5][1]), (304, [1.0, 2.0]), (100, vecs[100][1]), (None, vecs[1][1])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = rows(topk.top_k(df, F.col("__id") % 100 == 0))
    ok = [(i, np.floor(np.float32(v).astype(float) * 1024)) for i, v in vecs if i is not None and v and None not in v and np.isfinite(v).all() and len(v) == 8]
    want = []
    for q, a in {i: v for i, v in ok if i % 100 == 0}.items():
        best = sorted(((-int(a @ b), i) for i, b in ok if i != q))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want, key=str)
    assert rows(topk.top_k(df.limit(0), F.col("__id") % 100 == 0)) == []


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("https://A.Example.com/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        ("http://example.net/de/81#x", "example.net", "/de/81", "example.net/de/8", "block"),
        ("http://badexample.net/de/8", "badexample.net", "/de/8", "net/de/", "allow"),
        ("http://x.org?/es/", "x.org", "", None, "allow"),
        ("http://my-casino.example/x", "my-casino.example", "/x", None, "block"),
        ("http://casinos.example/x", "casinos.example", "/x", None, "allow"),
        ("http://a.example/free-free-free", "a.example", "/free-free-free", None, "allow"),
        ("http://a.example/poker-bet", "a.example", "/poker-bet", None, "block"),
        ("nothing", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    got = urls.judge(spark.createDataFrame([(1, url, "h")], "page_id long, url string, host string")).first()
    assert tuple(got)[:5] == (1, host, path, rule, verdict)


def test_sharding(spark, edge, none):
    table = sharding.fill([f"s{k}" for k in range(7)], 101)
    assert set(Counter(table).values()) <= {14, 15} and -1 not in table
    fewer = sharding.fill([f"s{k}" for k in range(6)], 101)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 40
    got = sharding.place(edge).collect()
    table = sharding.fill()
    for r in got:
        key = f"k{r['doc_id']}" if r["doc_id"] is not None else f"t{r['text'] or ''}"
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["__slot"], r["__shard"]) == (slot, table[slot])
    assert rows(sharding.place(none)) == [] and len(got) == len(EDGE)
    with pytest.raises(ValueError):
        sharding.fill(["a"], 100)


def test_mixing(spark, edge, none):
    got = mixing.mix(edge).collect()
    assert len(got) == len(EDGE)
    assert mixing.emit(mixing.mix(edge)).columns == edge.columns and rows(mixing.mix(none)) == []
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 50), ("d", 0)], "source string, source_size long")
    target = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # Weights 5, 2, 1, 5, 2 for a, b, c, d, null: a and d are full at 30 and 0, then null and b as the level rises.
    assert target["a"] == 30 and target["d"] == 0 and target["b"] == 300 and target[None] == 150 and target["c"] == 680
    assert all(r["__copies"] <= 3 for r in got)
    again = mixing.mix(edge).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = Counter(zip(w, w[1:], w[2:]))
    inside = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if wins[x] > 1 for j in range(3)}
    ls = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ls), len(ls) - len(set(ls)), len(inside)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n\t#é|", max_size=80))
def test_quality_measures(text):
    assert quality._measure(text)[:6] == brute_quality(text)


def test_quality(spark, edge, none):
    got = quality.ledger(edge)
    measures = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    assert rows(got.select(*measures)) == sorted(((i, *brute_quality(x)) for i, x, *_ in EDGE), key=str)
    assert quality.keep_good(edge).columns == edge.columns
    assert {r["doc_id"] for r in quality.keep_good(edge, "base").collect()} <= {4}
    assert rows(quality.ledger(none)) == []
    ab = {r["rule"]: r for r in quality.ablations(got).collect()}
    assert ab["few_words"]["fails"] == sum(brute_quality(x)[0] < 50 for _, x, *_ in EDGE) and ab["few_words"]["n"] == len(EDGE)
    assert all(r["fails_alone"] <= r["fails"] for r in ab.values())


@pytest.mark.parametrize("ids", ["random", "far"])
def test_components_of_a_long_chain(spark, ids):
    n = 3000
    chain = list(range(1, n)) + [0]
    if ids == "random":
        chain = [int(k) for k in np.random.default_rng(1).permutation(n)]
    links = [*zip(chain, chain[1:]), (n + 2, n + 1), (n + 2, n + 3), (n + 9, n + 9)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(n), 0) | dict.fromkeys((n + 1, n + 2, n + 3), n + 1) | {n + 9: n + 9}


def test_sketches_of_any_size(spark):
    """Sketches of sets of any two sizes differ in as many bits as their groups' parities do."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 900, 1024, 1025, 1200, 5000)]
    sets.append(sets[-1][40:])
    rows = [(i, len(s), *map(int, jaccard.sketch(s)[1]), list(map(int, jaccard.sketch(s)[0]))) for i, s in enumerate(sets)]
    t = spark.createDataFrame(rows, "i int, n long, k0 long, k1 long, k2 long, k3 long, fine array<long>")
    ok = jaccard.may_match("x", "y", 80, 100, True)
    got = {(r[0], r[1]): r[2] for r in t.alias("x").crossJoin(t.alias("y")).select("x.i", "y.i", ok).collect()}

    def odd(s, bits):
        return {int(p) for p, c in zip(*np.unique((s >> np.uint64(7)) % np.uint64(bits), return_counts=True)) if c % 2}

    def size(s):
        return next(b for b in (1024 << k for k in range(9)) if b >= len(s))

    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            bits = min(size(a), size(b))
            near = 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 180 * len(odd(a, bits) ^ odd(b, bits)) <= 20 * (len(a) + len(b))
            assert got[i, j] == near, (len(a), len(b))
    assert got[6, 7] and not got[4, 5]
