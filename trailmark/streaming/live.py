"""Live positions: a stateful stream, and the same over a finished table."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.text import valid_token

NAME_CHARS, TTL_DEFAULT, TTL_LEAST, TTL_MOST = 40, 10_800, 60, 86_400
KEEP_S, KEEP_M, MOST_POINTS, MOST_PEERS = 8.0, 12.0, 500, 500
LATE = "2 minutes"
HEAD = "name string, lat double, lng double, accuracy double, heading double, ttl double, at double, kept_lat double, kept_lng double, kept_at double, n long, gone double"
POINT = "n long, lat double, lng double, at double, accuracy double"
PEER = "id string, since double, at double, ttl double"
#: The state store that live_positions() needs, by name of setting.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUTPUT = "id string, event string, name string, lat double, lng double, head double, n_trail int"


def checked(events: DataFrame) -> DataFrame:
    """events with error, null for good fixes and stops: token, coordinates; name trimmed and cut, lifetime clamped."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    error = F.when(~valid_token(F.col("id")), "token").when((F.col("kind") == "fix") & ~(finite("lat") & finite("lng")), "coordinates").when((F.col("kind") == "fix") & ((F.abs("lat") > 90) | (F.abs("lng") > 180)), "range")
    ttl = F.floor(F.greatest(F.lit(float(TTL_LEAST)), F.least(F.lit(float(TTL_MOST)), F.when(finite("ttl"), F.col("ttl")).otherwise(float(TTL_DEFAULT))))).cast("double")
    own = {"name": F.substring(F.regexp_replace("name", r"^\s+|\s+$", ""), 1, NAME_CHARS), "ttl": ttl, "error": error}
    own |= {c: F.when(finite(c), F.col(c)) for c in ("accuracy", "heading") if c in events.columns}
    return events.withColumns(own)


def validate_fix(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    x = checked(events)
    return x.filter("error is null").drop("error"), x.filter("error is not null")


def metres(a: tuple, b: tuple) -> float:
    la1, lo1, la2, lo2 = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(h)))


class Head(NamedTuple):
    """A token's last fix, and what its trail needs to go on: the last kept point, the number of kept points, and
    the time up to which points have outlived the lifetime that held then."""

    name: str | None
    lat: float
    lng: float
    accuracy: float | None
    heading: float | None
    ttl: float
    at: float
    kept_lat: float
    kept_lng: float
    kept_at: float
    n: int
    gone: float


def step(head: Head | None, r: dict) -> tuple[Head | None, bool]:
    """A token's head after an event, and whether the event's place joins the trail. A head whose n is 1 starts
    a new trail."""
    if head and r["at"] - head.at >= head.ttl:
        head = None
    if r["kind"] == "stop":
        return None, False
    gone = max(head.gone, r["at"] - head.ttl) if head else -math.inf
    here = (r["lat"], r["lng"])
    keep = head is None or head.kept_at <= gone or r["at"] - head.kept_at >= KEEP_S or metres((head.kept_lat, head.kept_lng), here) >= KEEP_M
    kept = (*here, r["at"], head.n + 1 if head else 1) if keep else (head.kept_lat, head.kept_lng, head.kept_at, head.n)
    some = lambda k: None if r.get(k) is None or math.isnan(r[k]) else float(r[k])
    return Head(r["name"], *here, some("accuracy"), some("heading"), r["ttl"], r["at"], *kept, gone), keep


class LiveToken(StatefulProcessor):
    """The state of a token: its head as one value, and its trail as a ring of `points` slots, so that a fix
    writes one of each at most, however long the trail is. A timer at the head's end of life clears both."""

    def __init__(self, points: int = MOST_POINTS) -> None:
        self.points = points

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.trail = handle.getMapState("trail", "slot int", POINT)

    def _clear(self) -> None:
        self.head.clear()
        self.trail.clear()

    def _timer(self, at: float | None) -> None:
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(int(at * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        head = Head(*self.head.get()) if self.head.exists() else None
        there = head is not None
        for r in pd.concat(rows).sort_values(["at", "seq"]).to_dict("records"):
            head, keep = step(head, r)
            if there and (head is None or (keep and head.n == 1)):
                self._clear()
                there = False
            if keep:
                self.trail.updateValue(((head.n - 1) % self.points,), (head.n, r["lat"], r["lng"], r["at"], head.accuracy))
                there = True
        if head is None:
            self._clear()
            self._timer(None)
            yield change(key[0], "stopped", None)
            return
        self.head.update(tuple(head))
        self._timer(head.at + head.ttl)
        yield change(key[0], "live", head, self.points)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._clear()
        yield change(key[0], "expired", None)


def change(token: str, event: str, head: Head | None, points: int = 0) -> pd.DataFrame:
    row = (token, event, head.name, head.lat, head.lng, head.at, min(head.n, points)) if head else (token, event, None, None, None, None, 0)
    return pd.DataFrame([row], columns=["id", "event", "name", "lat", "lng", "head", "n_trail"]).astype({"name": object, "lat": float, "lng": float, "head": float, "n_trail": "int32"})


def on_time(fixes: DataFrame, late: str = LATE) -> DataFrame:
    """A stream of events without repeated ones of a token, a kind and a source time (at, seconds), and without
    those that come later than `late` after the newest; `seen` is the source time."""
    return fixes.withColumn("seen", F.timestamp_seconds("at")).withWatermark("seen", late).dropDuplicatesWithinWatermark(["id", "kind", "at"])


def live_positions(fixes: DataFrame, points: int = MOST_POINTS) -> DataFrame:
    """A stream of checked events (id, kind, name, lat, lng, ttl, at, seq) that passed on_time(), to changes of
    each token's position. A token expires when the watermark passes its lifetime after its last fix. The state
    needs the RocksDB provider; start it with outputMode append. state_of() reads the state."""
    extra = [F.col(c) if c in fixes.columns else F.lit(None).cast("double").alias(c) for c in ("accuracy", "heading")]
    own = fixes.select("id", "kind", "name", "lat", "lng", "ttl", "at", "seq", "seen", *extra)
    return own.groupBy("id").transformWithStateInPandas(LiveToken(points), OUTPUT, "append", "eventTime")


def state_of(spark: SparkSession, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """(heads, points) that live_positions() keeps, as of the last batch that its query finished."""
    operators = [r["operatorId"] for r in spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorName").distinct().collect() if r["operatorName"].startswith("transformWithState")]
    read = lambda name: spark.read.format("statestore").option("operatorId", operators[0]).option("stateVarName", name).load(checkpoint)
    return read("head").select("key.id", "value.*"), read("trail").select("key.id", "user_map_value.*")


def final_state(fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, points) after all checked events of a finished table. A token's events are walked through in order,
    in one task, which holds its trail and no more than a batch of events."""
    extra = [F.col(c) if c in fixes.columns else F.lit(None).cast("double").alias(c) for c in ("accuracy", "heading")]
    own = fixes.select("id", "kind", "name", "lat", "lng", "ttl", "at", "seq", *extra).repartition("id").sortWithinPartitions("id", "at", "seq")
    names = [f.name for f in T._parse_datatype_string(HEAD).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token, head, trail = None, None, deque(maxlen=MOST_POINTS)

        def done() -> Iterator[pd.DataFrame]:
            if head:
                yield pd.DataFrame([(token, *head, list(trail))], columns=["id", *names, "trail"])

        for pdf in batches:
            for r in pdf.to_dict("records"):
                if r["id"] != token:
                    yield from done()
                    token, head = r["id"], None
                    trail.clear()
                head, keep = step(head, r)
                if head is None or (keep and head.n == 1):
                    trail.clear()
                if keep:
                    trail.append({"n": head.n, "lat": r["lat"], "lng": r["lng"], "at": r["at"], "accuracy": head.accuracy})
        yield from done()

    walked = own.mapInPandas(run, f"id string, {HEAD}, trail array<struct<{', '.join(x.strip().replace(' ', ': ') for x in POINT.split(','))}>>")
    return walked.drop("trail"), walked.select("id", F.inline("trail"))


def snapshot(heads: DataFrame, points: DataFrame, now: float) -> DataFrame:
    """What viewers see at `now` of the tokens that are alive: id, name, lat, lng, ts, age, accuracy, heading and the
    trail, whose points are [lat, lng, accuracy, age]: places to five decimals, ages to whole seconds. Points that
    outlived the lifetime have left."""
    alive = heads.filter(F.lit(now) - F.col("at") < F.col("ttl")).withColumn("least", F.greatest("gone", F.lit(now) - F.col("ttl")))
    seen = points.join(alive.select("id", "least"), "id").filter("at > least")
    point = F.struct("n", F.bround("lat", 5).alias("lat"), F.bround("lng", 5).alias("lng"), F.bround("accuracy", 1).alias("accuracy"), F.bround(F.lit(now) - F.col("at")).cast("long").alias("age"))
    trails = seen.groupBy("id").agg(F.array_sort(F.collect_list(point)).alias("trail"))
    own = alive.join(trails, "id", "left")
    trail = F.transform(F.coalesce("trail", F.array().cast(trails.schema["trail"].dataType)), lambda p: p.dropFields("n"))
    return own.select("id", "name", "lat", "lng", F.col("at").alias("ts"), F.bround(F.lit(now) - F.col("at"), 1).alias("age"), "accuracy", "heading", trail.alias("trail"))


def batch_equivalent(fixes: DataFrame, now: float) -> DataFrame:
    """The snapshot that the stream's state would give at `now`, from a finished table of checked events."""
    return snapshot(*final_state(fixes), now)


class PeerCap:
    """A foreachBatch sink that admits `most` tokens at a time, those that came first.

    It writes into a folder, by number of the batch: `peers`, who is admitted after it; `admitted`, the events to go
    on with, as a table to stream from; `refused`, the fixes of others. A batch is taken at once: of the known tokens,
    those go that stopped or whose life ended by its last event; then newcomers that still want in get the free
    places, in the order of their first fix, then of their names. A batch reads the peers of the one before it
    only, and what it writes replaces what a failed try of it wrote, so it may be repeated. Batch 0 starts anew.
    """

    def __init__(self, folder: str, most: int = MOST_PEERS) -> None:
        self.folder, self.most = folder, most

    def path(self, kind: str, batch_id: int) -> str:
        return f"{self.folder}/{kind}/batch={batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(PEER).parquet(self.path("peers", batch_id - 1)) if batch_id else spark.createDataFrame([], PEER)
        batch = batch.persist()
        try:
            order = F.struct("at", "seq")
            last = batch.groupBy("id").agg(F.min(F.when(F.col("kind") == "fix", F.col("at"))).alias("first_at"), F.max_by(F.struct("kind", "at", "ttl"), order).alias("x"), F.max("at").alias("newest"))
            now = last.agg(F.max("newest")).first()[0]
            here = last.select("id", "first_at", "x.*")
            both = known.select("id", "since", F.col("at").alias("was"), F.col("ttl").alias("had")).join(here, "id", "left")
            stay = both.select("id", "since", F.coalesce("at", "was").alias("at"), F.coalesce("ttl", "had").alias("ttl"), "kind").filter("kind is null or kind != 'stop'").drop("kind")
            stay = stay.filter(F.lit(now) - F.col("at") < F.col("ttl")) if now is not None else stay
            free = self.most - stay.count()
            fresh = here.join(known.select("id"), "id", "left_anti").filter("kind != 'stop' and first_at is not null")
            new = fresh.select("id", F.col("first_at").alias("since"), "at", "ttl").orderBy("since", "id").limit(max(0, free))
            stay.unionByName(new).coalesce(1).write.mode("overwrite").parquet(self.path("peers", batch_id))
            peers = spark.read.schema(PEER).parquet(self.path("peers", batch_id)).select("id").union(known.select("id")).distinct()
            batch.join(F.broadcast(peers), "id", "left_semi").write.mode("overwrite").parquet(self.path("admitted", batch_id))
            batch.filter("kind = 'fix'").join(F.broadcast(peers), "id", "left_anti").write.mode("overwrite").parquet(self.path("refused", batch_id))
        finally:
            batch.unpersist()


def head_positions(fixes: DataFrame) -> DataFrame:
    """The latest fix of each token, by arrival."""
    return fixes.groupBy("id").agg(F.max_by(F.struct("name", "lat", "lng", "ttl", "at"), F.struct("at", "seq")).alias("x")).select("id", "x.*")


def peer_cap(snapshot: DataFrame, first_seen: str = "first_seen", most: int = MOST_PEERS) -> DataFrame:
    """The tokens that came first; others are refused. A limit on the whole snapshot, so on one list of `most`."""
    kept = snapshot.orderBy(first_seen, "id").limit(most)
    return kept


def run_once(fixes: DataFrame, folder: str, most: int = MOST_PEERS, points: int = MOST_POINTS, late: str = LATE) -> tuple[DataFrame, DataFrame]:
    """What a stream of checked events has ready, through on_time(), the cap and live_positions(); (heads, points) after
    it. Two queries, each with a checkpoint in the folder, which the cap's tables connect; a later call goes on there."""
    spark = fixes.sparkSession
    capped = on_time(fixes, late).drop("seen").writeStream.foreachBatch(PeerCap(folder, most)).option("checkpointLocation", f"{folder}/cap").trigger(availableNow=True).start()
    capped.awaitTermination()
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, x in STATE_STORE.items():
        spark.conf.set(k, x)
    try:
        schema = T.StructType([f for f in fixes.schema.fields if f.name != "seen"] + [T.StructField("batch", T.LongType())])
        admitted = spark.readStream.schema(schema).parquet(f"{folder}/admitted").drop("batch")
        changes = live_positions(on_time(admitted, late), points)
        state = changes.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        state.awaitTermination()
    finally:
        for k, x in before.items():
            if x is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, x)
    return state_of(spark, f"{folder}/state")


def snapshot_view(positions: DataFrame, now: float) -> DataFrame:
    return positions.select("id", "name", "lat", "lng", F.bround(F.lit(now) - F.col("at"), 1).alias("age"))


def last_points(points: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """points (id, at, ...): the newest of each token."""
    return points.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at")))).filter(F.col("__n") <= most).drop("__n")
