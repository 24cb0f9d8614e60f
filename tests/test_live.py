"""Live positions: the stream with its cap, watermark and state, against the plain rule event by event."""

import math
import random

import pytest
from pyspark.sql import Row

from trailmark.streaming import live

SCHEMA = "id string, kind string, name string, lat double, lng double, ttl double, at double, seq long, accuracy double, heading double"


def plain(events, now, most=500):
    """The snapshot by a dictionary of trails, one event after the other."""
    tokens = {}

    def prune(t, at):
        if t in tokens and tokens[t]["at"] <= at - tokens[t]["ttl"]:
            del tokens[t]
        elif t in tokens:
            tokens[t]["trail"] = [p for p in tokens[t]["trail"] if p[2] > at - tokens[t]["ttl"]]

    for id, kind, name, lat, lng, ttl, at, _, accuracy, heading in sorted(events, key=lambda e: (e[6], e[7])):
        prune(id, at)
        if kind == "stop":
            tokens.pop(id, None)
            continue
        trail = tokens[id]["trail"] if id in tokens else []
        if not trail or at - trail[-1][2] >= 8 or live.metres(trail[-1], (lat, lng)) >= 12:
            trail = [*trail, (lat, lng, at, accuracy)][-most:]
        tokens[id] = {"name": name, "at": at, "ttl": ttl, "accuracy": accuracy, "heading": heading, "trail": trail}
    for t in list(tokens):
        prune(t, now)
    return {t: (x["name"], x["accuracy"], x["heading"], [(p[3], int(round(now - p[2]))) for p in x["trail"]]) for t, x in tokens.items()}


def seen(snap):
    return {r["id"]: (r["name"], r["accuracy"], r["heading"], [(p["accuracy"], p["age"]) for p in r["trail"]]) for r in snap.collect()}


def made(n, tokens, seed):
    rnd = random.Random(seed)
    at, out = 0.0, []
    for k in range(n):
        at += rnd.choice([0.25, 1.25, 3.0, 9.0])
        kind = "stop" if rnd.random() < 0.03 else "fix"
        out.append((f"a{rnd.randrange(tokens)}", kind, f"n{k}", rnd.randrange(9) / 1e4, rnd.randrange(9) / 1e4, float(rnd.choice([60, 90, 400])), at, k, rnd.choice([None, k / 2]), None))
    return out


def write(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_checked(spark):
    rows = [("ab-1", "fix", "  " + "n" * 50, 1.0, 1.0, 60.9, 0.0, 0, math.inf, 5.0), ("xyz", "fix", "x", 1.0, 1.0, 5.0, 0.0, 1, None, None), ("c", "fix", "x", 91.0, 1.0, 5.0, 0.0, 2, None, None), ("c", "fix", "x", math.nan, 1.0, None, 0.0, 3, None, None), ("d", "stop", None, None, None, None, 0.0, 4, None, None)]
    good, bad = live.validate_fix(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["error"] for r in bad.collect()) == ["coordinates", "range", "token"]
    a, d = good.orderBy("id").collect()
    assert (a["name"], a["ttl"], a["accuracy"], a["heading"]) == ("n" * 40, 60.0, None, 5.0) and d["ttl"] == 10_800


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_is_the_plain_rule(spark, seed):
    events = made(1500, 12, seed)
    now = events[-1][6] + 20
    df = spark.createDataFrame(events, SCHEMA).repartition(3)
    assert seen(live.batch_equivalent(df, now)) == plain(events, now)
    one = [("a", "fix", "n", 0.0, 0.0, 86_400.0, float(9 * k), k, float(k), None) for k in range(700)]
    got = seen(live.batch_equivalent(spark.createDataFrame(one, SCHEMA), 6300.0))
    assert got == plain(one, 6300.0) and len(got["a"][3]) == 500
    assert live.batch_equivalent(df.limit(0), now).collect() == []


def test_stream_in_two_stretches(spark, tmp_path):
    """Also a repeated fix, one that comes too late, a trail longer than the ring, and tokens that expire."""
    events = made(400, 6, 3)
    cut = 250
    again = events[cut - 1]
    late = (again[0], "fix", "late", 0.5, 0.5, 400.0, events[0][6] + 0.1, 10_000, None, None)
    folder, source = str(tmp_path / "run"), str(tmp_path / "in")
    stream = lambda: live.validate_fix(spark.readStream.schema(SCHEMA).parquet(source))[0]
    write(spark, events[:cut], source)
    heads, points = live.run_once(stream(), folder, points=7)
    middle = events[cut - 1][6]
    assert seen(live.snapshot(heads, points, middle)) == plain(events[:cut], middle, 7)
    write(spark, [*events[cut:], again, late], source)
    heads, points = live.run_once(stream(), folder, points=7)
    now = events[-1][6]
    assert seen(live.snapshot(heads, points, now)) == plain(events, now, 7)
    assert points.groupBy("id").count().agg({"count": "max"}).first()[0] <= 7
    changes = {r["event"] for r in spark.read.parquet(f"{folder}/changes").select("event").distinct().collect()}
    assert changes >= {"live"} and changes <= {"live", "stopped", "expired"}


def test_peer_cap_across_restarts(spark, tmp_path):
    """The first ones in, in the order of their fixes, whatever the batches; freed places are taken by those that
    come then; a batch may be repeated."""
    fix = lambda id, at, k, ttl=400.0, kind="fix": (id, kind, id, 0.0, 0.0, ttl, at, k, None, None)
    folder, source = str(tmp_path / "run"), str(tmp_path / "in")
    cap = live.PeerCap(folder, 5)
    batches = [
        [fix(f"a{k}", float(k), k) for k in range(3)],
        [fix(f"b{k}", 10.0 - k, 10 + k) for k in range(4)] + [fix("a0", 20.0, 20)],
        [fix("a1", 30.0, 30, kind="stop"), fix("b0", 31.0, 31), fix("b1", 32.0, 32), fix("a2", 33.0, 33)],
        [fix("c", 9000.0, 40)],
        [],
    ]
    peers = lambda n: {r["id"] for r in spark.read.parquet(f"{folder}/peers/batch={n}").collect()}
    table = lambda kind, n: sorted((r["id"], r["at"]) for r in spark.read.schema(SCHEMA).parquet(f"{folder}/{kind}/batch={n}").collect())
    want = [{"a0", "a1", "a2"}, {"a0", "a1", "a2", "b3", "b2"}, {"a0", "a2", "b3", "b2", "b0"}, {"c"}, {"c"}]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA)
        cap(df, n)
        cap(df, n)
        assert peers(n) == want[n]
    assert table("refused", 1) == [("b0", 10.0), ("b1", 9.0)] and table("refused", 2) == [("b1", 32.0)]
    assert ("a1", 30.0) in table("admitted", 2) and table("admitted", 4) == []
    more = str(tmp_path / "stream")
    for n in range(2):
        write(spark, [fix(f"{n:x}{k:04x}", float(1000 * n + k), k, 9000.0) for k in range(400)], source)
        q = spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(live.PeerCap(more)).option("checkpointLocation", f"{more}/cap").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(f"{more}/peers/batch=1").orderBy("since").select("id").collect()
    assert got == [Row(id=f"0{k:04x}") for k in range(400)] + [Row(id=f"1{k:04x}") for k in range(100)]
