"""SQL for another engine that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from . import chat, mixing, quality, urls

WORD = r"'[^\x20\x09-\x0D]+'"

OP3 = r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
x AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM l),
f AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT a.doc_id, a.i AS i1, c.i AS i3, a.line AS l1, b.line AS l2, c.line AS l3 FROM f a JOIN f b ON b.doc_id = a.doc_id AND b.k = a.k + 1 JOIN f c ON c.doc_id = a.doc_id AND c.k = a.k + 2),
n AS (SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, i1) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(i1, i3 + 1)) AS i FROM n WHERE nth > 1),
kept AS (SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.i) AS text FROM x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL GROUP BY x.doc_id)
SELECT l.doc_id, coalesce(k.text, '') AS text, CAST(len(l.a) AS BIGINT) AS n_lines, coalesce(g.n, 0) AS n_removed FROM l LEFT JOIN kept k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)"""


def _escaped(c: str) -> str:
    return f"replace(replace(coalesce({c}, ''), chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')"


def op5(tricky: str) -> str:
    fixed = len(chat.START) + 1 + len(chat.END) + 1
    return f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{tricky}' UNION ALL SELECT -1, 1, 'assistant', '{tricky}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({fixed} + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""


OP6 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10"""


def op7() -> str:
    fits = []
    for host, path, verdict in sorted(urls.RULES, key=lambda r: -len(r[0] + r[1])):
        fits.append((f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))", host + path, verdict))
    term = lambda words: f"regexp_matches(low, '(^|[^a-z])({'|'.join(words)})([^a-z]|$)')"
    kinds = " + ".join(f"CAST({term([t])} AS INT)" for t in urls.SOFT)
    weight = " + ".join(f"{w} * CAST({term([t])} AS INT)" for t, w in urls.SOFT.items())
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + f" WHEN {term(urls.STRICT)} OR (({kinds}) > 1 AND ({weight}) >= {urls.SOFT_LIMIT}) THEN 'block' ELSE 'allow' END"
    return f"""WITH u AS (SELECT page_id, lower(coalesce(url, '')) AS low, CASE WHEN contains(url, '://') THEN lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)) ELSE '' END AS host, CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM u"""


def op9() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    cap, n = mixing.MOST_REPEATS, len(mixing.WEIGHTS)
    return f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORD})) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{weights}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} + 1] AS weight FROM d GROUP BY source),
t AS (SELECT *, {cap} * source_size AS most, {cap} * source_size / weight AS full_at FROM s),
u AS (SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER w, 0) AS left_size, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS left_weight FROM t WINDOW w AS (ORDER BY full_at, weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT full_at AS level_first, left_size AS rest_size, left_weight AS rest_weight FROM u WHERE left_size / left_weight <= full_at ORDER BY full_at, weight, source LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN level_first IS NULL OR full_at < level_first THEN CAST(most AS DOUBLE) ELSE least(weight * CAST(rest_size AS DOUBLE) / rest_weight, most) END AS target FROM u LEFT JOIN f ON TRUE),
h AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, {cap}.0) ELSE 0.0 END AS rate FROM g)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source"""


def op10() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(quality.RULES.values()))
    base, policy = quality.mask("base"), quality.mask(quality.POLICY)
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d), k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM x),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(length(regexp_replace(text, '[^\pL]+', '', 'g')) AS BIGINT) AS n_letters, CAST(length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {base}) <> 0 AS base_failed, (failed & {policy}) = 0 AS kept, failed FROM b"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
x AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
v AS (SELECT lang, term, count(*) AS c FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS c FROM x GROUP BY ALL),
a AS (SELECT g.lang, g.source, v.term, v.c AS all_c, coalesce(n.c, 0) AS c FROM g JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = v.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w) AS p, 1 + (1000000000::HUGEINT * (all_c + 5)) // (sum(all_c) OVER w + 5 * count(*) OVER w) AS q FROM a WINDOW w AS (PARTITION BY lang, source)),
s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
e AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM e)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM k WHERE part = 'pair' OR rank <= 50"""

OP13 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
l AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0), t AS (SELECT count(*) AS docs, sum(n) AS terms FROM l),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, t GROUP BY term, docs),
s AS (SELECT i.item_id, l.r, l.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (50 + (50 * l.n * t.docs) // t.terms)))) AS score FROM i JOIN f USING (term) JOIN w USING (term) JOIN l USING (r), t GROUP BY ALL HAVING score > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE doc_id IS NOT NULL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 50"""
