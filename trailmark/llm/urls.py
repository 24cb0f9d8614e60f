"""URL filters: host rules first, then a weighted vocabulary.

A rule names a host, which stands for its subdomains too, and the start of a path; the longest rule
that fits decides. Where none fits, an Aho-Corasick automaton over the vocabulary reads the URL once
and counts strict and soft terms that stand between non-letters. One strict term, or soft terms whose
weights reach the limit with at least two different ones, block the page. Rules and vocabulary are
parameters of fixed size that travel with the code; pages aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host, start of the path) and what happens to pages there.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
STRICT = ("porn", "xxx", "casino", "viagra", "warez", "spam")
SOFT = {"adult": 2, "sex": 2, "nude": 2, "bet": 1, "betting": 2, "poker": 2, "escort": 2, "dating": 1, "loan": 1, "pills": 2, "torrent": 1, "crack": 1, "free": 1, "hot": 1, "cheap": 1}
SOFT_LIMIT = 3
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host, in lower case, and path; both empty without a `://`."""
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [k for c in "/?#" if (k := rest.find(c)) >= 0]
    end = min(ends, default=len(rest))
    path = rest[end:]
    stop = min((k for c in "?#" if (k := path.find(c)) >= 0), default=len(path))
    return rest[:end].translate(LOWER), path[:stop]


def matching_rule(host: str, path: str, rules: Mapping[str, Sequence[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule, by host and then by path, that fits."""
    best = None
    name = host
    while name:
        for start, verdict in rules.get(name, ()):
            if path.startswith(start) and (best is None or len(name + start) > len(best[0])):
                best = (name + start, verdict)
        name = name.partition(".")[2]
    return best


@cache
def _automaton(strict: tuple[str, ...], soft: tuple[tuple[str, int], ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in strict:
        a.add_word(t, (t, 0))
    for t, weight in soft:
        a.add_word(t, (t, weight))
    a.make_automaton()
    return a


def vocabulary_hits(url: str | None, strict: tuple[str, ...], soft: tuple[tuple[str, int], ...]) -> tuple[int, int, int]:
    """Strict hits, different soft terms, and the sum of these terms' weights, at word boundaries."""
    if not url or not (strict or soft):
        return 0, 0, 0
    low = url.translate(LOWER)
    hard, seen = 0, {}
    for end, (term, weight) in _automaton(strict, soft).iter(low):
        start = end - len(term) + 1
        if (start and low[start - 1].isalpha()) or (end + 1 < len(low) and low[end + 1].isalpha()):
            continue
        if weight:
            seen[term] = weight
        else:
            hard += 1
    return hard, len(seen), sum(seen.values())


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict and the vocabulary's counts: one row per row of pages.

    Null URLs and those without `://` have an empty host and path and no rule; the vocabulary still
    reads the latter. Repeated rows repeat. Very long URLs are read whole.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    strict, soft = tuple(strict), tuple(sorted(dict(soft).items()))

    def one(u: str | None) -> tuple:
        host, path = split_url(u)
        rule = matching_rule(host, path, by_host)
        hard, kinds, weight = vocabulary_hits(u, strict, soft)
        verdict = rule[1] if rule else "block" if hard or (kinds > 1 and weight >= soft_limit) else "allow"
        return host, path, rule and rule[0], verdict, hard, kinds, weight

    names = ["host", "path", "rule", "verdict", "strict_hits", "soft_terms", "soft_weight"]
    types = [pa.string()] * 4 + [pa.int32()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(one, b.column(1).to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["page_id", *names])

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, strict_hits int, soft_terms int, soft_weight int")
