"""Joins that match records: by time, place, name and similarity."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edit_distance_le1, external_route_id, hamming_hex, norm_key, own_route_slug, parse_folder_name
from ..scratch import settled

DAY_S = 86_400


def asof_tour(media: DataFrame, tours: DataFrame, before_s: int = 2 * 3600, after_s: int = 12 * 3600) -> DataFrame:
    """media (m, ts) and tours (tour, ts) to (m, tour): -before <= media - tour <= after, the nearest,
    ties to the earliest tour. Tours go to each day their window touches.

    Both sides are taken by seconds: the smallest tour of a second stands for all of it, and a second is matched
    once for all its media. So a day's window has at most its seconds and those of the tours around it, however
    many rows there are."""
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    m = media.select("m", sec.alias("s")).filter("s is not null")
    t = tours.select("tour", sec.alias("s")).groupBy("s").agg(F.min(F.struct("s", "tour")).alias("t"))
    days = F.explode(F.sequence(F.floor((F.col("s") - before_s) / DAY_S), F.floor((F.col("s") + after_s) / DAY_S)))
    asked = m.select("s").distinct().select(F.floor(F.col("s") / DAY_S).alias("day"), "s", F.lit(None).cast(t.schema["t"].dataType).alias("t"))
    both = t.select(days.alias("day"), "s", "t").unionByName(asked)
    w = Window.partitionBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"was": F.last("t", True).over(w.orderBy("s")), "next": F.last("t", True).over(w.orderBy(F.desc("s")))})
    of = lambda k: F.when((F.col("s") - F.col(f"{k}.s")).between(-before_s, after_s), F.struct(F.abs(F.col("s") - F.col(f"{k}.s")).alias("d"), F.col(f"{k}.s").alias("tt"), F.col(f"{k}.tour").alias("tour")))
    near = both.filter("t is null").select("s", F.least(of("was"), of("next")).alias("x")).filter("x is not null")
    return m.join(near, "s").groupBy("m").agg(F.min("x")["tour"].alias("tour"))


BLOCKS_AT_ONCE = 8


def match_folders(folders: DataFrame, tours: DataFrame, block: int = 40_000) -> DataFrame:
    """folders (name, date, number) and tours (tour, date, seq) to (name, tour), tour null for orphans.

    The rule is sequential: in the order of names, a folder takes the first free tour of its day, the day
    before or the day after, preferring one of its number. That is one fixed list of preferences a folder, and
    all tours prefer the smaller name; so offers in any order end the same way, where a tour keeps the smallest
    name that made one and the others go on in their lists.

    Tours lie in blocks of less than 2 * `block`: successive days, or parts of a day that is larger. In rounds each
    block takes up to `block` of the folders that come to it, with those that hold its tours, and lets them make
    offers until all that are left have to go on; the rest of a crowd waits. BLOCKS_AT_ONCE successive blocks are
    one group, and the groups of one round overlap those of the next by half, so that folders at a block's end don't
    take a round for each step in their lists. So no task gets more than some blocks' rows, and a round moves each
    chain of displacements to the end of its group. Folders of one name come in the order of their dates and numbers.
    """
    per_day = tours.filter("date is not null").groupBy("date").agg(F.count("*").alias("n"))
    by = Window.partitionBy(F.lit(1)).orderBy("date")  # one row per calendar date
    large = F.col("n") > block
    before = F.sum(F.when(large, 0).otherwise(F.col("n"))).over(by) - F.col("n")
    days = settled(per_day.select("date", F.when(large, -F.row_number().over(by)).otherwise(F.floor(before / block)).cast("long").alias("g"), F.when(large, F.ceil(F.col("n") / block)).otherwise(1).cast("long").alias("parts")))
    part = F.when(F.col("parts") == 1, 0).otherwise(F.floor((F.row_number().over(Window.partitionBy("date").orderBy("tour")) - 1) / block)).cast("long")
    placed = settled(tours.join(days, "date").select("g", part.alias("c"), F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"), "tour", F.col("seq").cast("long").alias("seq")))
    state = folders.filter("date is not null").select("name", F.col("number").cast("long").alias("number"), "date")
    for k, at in enumerate(("0", "_before", "_after")):
        there = days.select(F.date_sub("date", (0, -1, 1)[k]).alias("date"), F.col("g").alias(f"g{at}"), F.col("parts").alias(f"parts{at}"))
        state = state.join(there, "date", "left")
    first = F.when(F.col("number").isNull(), 3).otherwise(0)
    kind = "name string, number long, day int, g0 long, parts0 long, g_before long, parts_before long, g_after long, parts_after long, i int, c long, g long, tour string"
    names = [x.split()[0] for x in kind.split(", ")]
    near = ("0", "_before", "_after")
    at = F.coalesce(*[F.when(F.col(f"g{x}").isNotNull(), F.lit(k)) for k, x in enumerate(near)])
    state = state.withColumns({"day": F.datediff("date", F.lit("1970-01-01").cast("date")), "i": (first + at).cast("int"), "g": F.coalesce(*[f"g{x}" for x in near]), "c": F.lit(0).cast("long"), "tour": F.lit(None).cast("string")})
    state = settled(state.select(names))

    def offers(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """A folder's list is its number's tours of its day, the day before and the day after, then all tours of
        these days; i tells where in the list it is, c in which part of the day."""
        group, part, shift = (x.as_py() for x in key)
        inside = lambda g, c: g is not None and c == part and ((g + shift) // BLOCKS_AT_ONCE if g >= 0 else g) == group
        of_day, of_number = defaultdict(list), defaultdict(list)
        for tour, day, seq in sorted(zip(*(right[x].to_pylist() for x in ("tour", "day", "seq"))), key=lambda t: t[0]):
            of_day[day].append(tour)
            if seq is not None:
                of_number[day, seq].append(tour)
        # A folder is its place in here.
        left = left.take(pc.sort_indices(left, sort_keys=[(x, "ascending") for x in ("name", "day", "number")], null_placement="at_start"))
        number, day, i, c, g, own = (left[x].to_pylist() for x in ("number", "day", "i", "c", "g", "tour"))
        blocks, parts = (list(zip(*(left[f"{x}{at}"].to_pylist() for at in near))) for x in ("g", "parts"))
        holder = {tour: k for k, tour in enumerate(own) if tour is not None}
        waiting = [k for k, tour in enumerate(own) if tour is None]
        passed = defaultdict(int)  # tours at the head of a list that smaller names hold
        while waiting:
            k = heapq.heappop(waiting)
            while inside(g[k], c[k]):
                on = day[k] + (0, -1, 1)[i[k] % 3]
                at = (on, number[k]) if i[k] < 3 else on
                pool = (of_number if i[k] < 3 else of_day).get(at, ())
                n = passed[at]
                while n < len(pool) and holder.get(pool[n], k) < k:
                    n += 1
                passed[at] = n
                if n < len(pool):
                    tour = pool[n]
                    if tour in holder:
                        own[holder[tour]] = None
                        heapq.heappush(waiting, holder[tour])
                    holder[tour], own[k] = k, tour
                    break
                c[k] += 1
                if c[k] == parts[k][i[k] % 3]:
                    c[k], i[k] = 0, i[k] + 1
                    while i[k] < 6 and blocks[k][i[k] % 3] is None:
                        i[k] += 1
                    g[k] = blocks[k][i[k] % 3] if i[k] < 6 else None
        for x, values in (("i", i), ("c", c), ("g", g), ("tour", own)):
            left = left.set_column(left.schema.get_field_index(x), left.schema.field(x), pa.array(values, left.schema.field(x).type))
        return left.select(names)

    for turns in count():
        free = F.col("tour").isNull() & F.col("g").isNotNull()
        if not state.filter(free).limit(1).count():
            break
        turn = Window.partitionBy("g", "c").orderBy("name", "day", "number")
        coming = settled(state.filter(free).withColumn("turn", F.row_number().over(turn)))
        shift = F.lit(turns % 2 * (BLOCKS_AT_ONCE // 2)).cast("long")
        by = {"group": F.when(F.col("g") >= 0, F.floor((F.col("g") + shift) / BLOCKS_AT_ONCE)).otherwise(F.col("g")), "part": F.col("c"), "shift": shift}
        now = coming.filter(F.col("turn") <= block).drop("turn").withColumns(by)
        here = now.select("group", "part").distinct()
        holding = state.filter("tour is not null").withColumns(by)
        left = now.unionByName(holding.join(here, ["group", "part"], "left_semi"))
        right = placed.withColumns(by).join(here, ["group", "part"], "left_semi")
        done = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(offers, kind)
        idle = coming.filter(F.col("turn") > block).unionByName(holding.join(here, ["group", "part"], "left_anti"), True).unionByName(state.filter("tour is null and g is null"), True).select(names)
        state = settled(done.unionByName(idle))
    return state.select("name", "tour").unionByName(folders.filter("date is null").select("name", F.lit(None).cast("string").alias("tour")))


def match_census(census: DataFrame, tours: DataFrame) -> DataFrame:
    """census (row, date, route) and tours (tour, date, route, has_activity) to (row, tour, how): by unique
    route, by route within a day, by exact date, by the only neighbour; else how says why not. A tour is
    taken by the first row; one that has a recording is reported as skipped.

    Tours are counted per route, per route and day, and per day first, so a row meets one row of each and never the
    tours of its days."""
    tour = F.struct("tour", "has_activity")
    count = lambda kind, *by: tours.groupBy(*by).agg(F.count("*").alias(f"n{kind}"), F.min(tour).alias(f"t{kind}"))
    day = count("d", "date")
    near = lambda df: df.withColumn("date", F.explode(F.array(F.date_sub("date", 1), F.date_add("date", 1), *([] if df is day else ["date"]))))
    around = near(count("w", "route", "date")).groupBy("route", "date").agg(F.sum("nw").alias("nn"), F.min("tw").alias("r2"))
    next_to = near(day).groupBy("date").agg(F.sum("nd").alias("n1"), F.min("td").alias("d1"))
    of_day = day.select("date", F.col("nd").alias("n0"), F.col("td").alias("d0"))
    x = census.join(count("r", "route").select("route", F.col("nr"), F.col("tr").alias("r1")), "route", "left").join(around, ["route", "date"], "left").join(of_day, "date", "left").join(next_to, "date", "left").fillna(0, ["nr", "nn", "n0", "n1"])
    how = F.when(F.col("nr") == 1, "route").when(F.col("nn") == 1, "route+date").when(F.col("n0") == 1, "date").when(F.col("n0") > 1, "two tours on that date").when(F.col("n1") == 1, "date+-1").when(F.col("n1") == 0, "no tour").otherwise("ambiguous within a day")
    pick = F.when(how == "route", F.col("r1")).when(how == "route+date", F.col("r2")).when(how == "date", F.col("d0")).when(how == "date+-1", F.col("d1"))
    x = x.select("row", pick.alias("t"), how.alias("how")).select("row", "t.tour", "t.has_activity", "how")
    # Rows without a tour are no group.
    turn = Window.partitionBy("tour", F.when(F.col("tour").isNull(), F.col("row"))).orderBy("row")
    x = x.withColumn("n", F.when(F.col("tour").isNotNull(), F.row_number().over(turn)).otherwise(1))
    how2 = F.when(F.col("n") > 1, "taken").when(F.coalesce("has_activity", F.lit(False)), "skipped").otherwise(F.col("how"))
    return x.select("row", F.when(F.col("n") == 1, F.col("tour")).alias("tour"), how2.alias("how"))


BBOX_PAD = 0.003


#: Rows of a day's tours, and of its trips, that meet in one task.
TOURS_A_BLOCK, TRIPS_A_BLOCK = 65_536, 65_536


def in_blocks(tours: DataFrame, routes: DataFrame, trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tours with their routes, trips), by date, block and part: the tours of a day lie in blocks and its trips in
    parts, and each block meets each part once. So a row is copied once for TRIPS_A_BLOCK or TOURS_A_BLOCK rows of
    the other side, and the tasks are as many as there are pairs of blocks."""
    t = trips.withColumn("date", F.explode(F.when(F.hour("departed") < 4, F.array(F.to_date("departed"), F.date_sub(F.to_date("departed"), 1))).otherwise(F.array(F.to_date("departed")))))
    rides = tours.join(routes, "tour")
    dealt = lambda df, name, size: df.groupBy("date").agg(F.ceil(F.count("*") / size).alias(name))
    per_day = dealt(rides, "blocks", TOURS_A_BLOCK).join(dealt(t, "parts", TRIPS_A_BLOCK), "date")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rides = rides.join(per_day, "date").withColumn("block", own("tour", "blocks")).withColumn("part", each("parts"))
    t = t.join(per_day, "date").withColumn("part", own("trip", "parts")).withColumn("block", each("blocks"))
    # Work grows with the product of both sides, so small partitions aren't put together.
    n = int(tours.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tuple(x.drop("blocks", "parts").repartition(n, "date", "block", "part") for x in (rides, t))


def candidate_trips(tours: DataFrame, routes: DataFrame, trips: DataFrame) -> DataFrame:
    """What trip_candidates() pairs, with the columns of both sides, one row per pair of a row of tours and routes with
    a row of trips."""
    rides, t = in_blocks(tours, routes, trips)
    boxed = F.col("sw_lat").isNotNull() & F.col("ne_lat").isNotNull() & F.col("sw_lng").isNotNull() & F.col("ne_lng").isNotNull() & (F.col("ne_lat") > F.col("sw_lat")) & (F.col("ne_lng") > F.col("sw_lng"))
    inside = F.col("lat").between(F.col("sw_lat") - BBOX_PAD, F.col("ne_lat") + BBOX_PAD) & F.col("lng").between(F.col("sw_lng") - BBOX_PAD, F.col("ne_lng") + BBOX_PAD)
    return t.join(rides, ["date", "block", "part"]).filter((~boxed | inside) & (F.col("distance") >= 0.9 * F.col("dist_m"))).drop("block", "part")


#: Tours that are compared at once, and the trips that they are compared with first.
TOURS_AT_ONCE, TRIPS_AT_FIRST = 128, 1024
NO_TRIP = np.iinfo(np.int64).max


def closest_trips(tours: DataFrame, routes: DataFrame, trips: DataFrame, scale: float, most: float) -> DataFrame:
    """Of trip_candidates()' pairs those that best_trip() needs: (tour, trip, d_start, d_end), where d_start and d_end
    are how far the start's latitude is from the box's lower and upper one, in whole parts of 1 / scale. A tour has
    the two trips of the least sum, ties to the smaller trip, of those whose d_start is `most` at most. A trip has
    one row.

    Pairs aren't made: a task holds a block of tours and a part of the trips of a day, takes tours of near latitudes
    together and looks at trips in the order of the least sum that they may have, until no other can be among the
    first two."""
    rides, t = in_blocks(tours, routes, trips)
    kind = {**dict(rides.dtypes), **dict(t.dtypes)}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right["trip"]))
        number = lambda table, x: pc.fill_null(table[x].cast(pa.float64()), np.nan).to_numpy()
        sw, ne, west, east, far = (number(right, x) for x in ("sw_lat", "ne_lat", "sw_lng", "ne_lng", "distance"))
        lat, lng, least = number(left, "lat"), number(left, "lng"), 0.9 * number(left, "dist_m")
        boxed = (ne > sw) & (east > west)
        whole = np.flatnonzero(~np.isnan(sw) & ~np.isnan(ne) & ~np.isnan(far))
        n = len(sw)
        best = np.full((len(lat), 2), NO_TRIP)
        use = np.flatnonzero(~np.isnan(lat) & ~np.isnan(least))
        use = use[np.argsort(lat[use], kind="stable")]

        def keys(at: np.ndarray, k: np.ndarray) -> np.ndarray:
            """Sum and place among the trips as one number, of the tours `at` by the trips k."""
            y, x = lat[at, None], lng[at, None]
            start, end = np.floor(np.abs(y - sw[k]) * scale), np.floor(np.abs(ne[k] - y) * scale)
            inside = (y >= sw[k] - BBOX_PAD) & (y <= ne[k] + BBOX_PAD) & (x >= west[k] - BBOX_PAD) & (x <= east[k] + BBOX_PAD)
            ok = (~boxed[k] | inside) & (far[k] >= least[at, None]) & (start <= most)
            return np.where(ok, np.where(ok, start + end, 0).astype(np.int64) * n + k, NO_TRIP)

        for first in range(0, len(use), TOURS_AT_ONCE):
            at = use[first : first + TOURS_AT_ONCE]
            low, high = lat[at[0]], lat[at[-1]]
            beyond = lambda x: np.floor(np.maximum(np.maximum(low - x, x - high), 0.0) * scale)
            start = beyond(sw[whole])
            some = (start <= most) & (far[whole] >= least[at].min())
            k, bound = whole[some], (start + beyond(ne[whole]))[some]
            done, size = 0, TRIPS_AT_FIRST
            if len(k) > 4 * size:
                by = np.argpartition(bound, size)
                k, bound = k[by], bound[by]
                head = np.argsort(bound[:size], kind="stable")
                k[:size], bound[:size] = k[:size][head], bound[:size][head]
                ordered = size
            else:
                by = np.argsort(bound, kind="stable")
                k, bound = k[by], bound[by]
                ordered = len(k)
            while done < len(k) and len(at):
                if done >= ordered:
                    by = done + np.argsort(bound[done:], kind="stable")
                    k[done:], bound[done:] = k[by], bound[by]
                    ordered = len(k)
                # A tour is left if its second best may be beaten, or met by a smaller trip.
                at = at[(best[at, 1] == NO_TRIP) | (best[at, 1] // n >= bound[done])]
                if not len(at):
                    break
                took = k[done : done + size]
                new = np.concatenate([best[at], keys(at, took)], axis=1)
                best[at] = np.sort(np.partition(new, 1, axis=1)[:, :2], axis=1)
                done, size = done + size, min(2 * size, 16 * TRIPS_AT_FIRST)
        row, nth = np.nonzero(best != NO_TRIP)
        k = best[row, nth] % n if n else best[row, nth]
        trip = right["trip"].take(pa.array(k))
        return pa.table({"tour": left["tour"].take(pa.array(row)), "trip": trip, "a": lat[row] - sw[k], "b": ne[k] - lat[row]})

    by = ("date", "block", "part")
    own = rides.select(*by, "tour", "lat", "lng", "dist_m").groupBy(*by)
    found = own.cogroup(t.select(*by, "trip", "distance", "sw_lat", "sw_lng", "ne_lat", "ne_lng").groupBy(*by)).applyInArrow(run, f"tour {kind['tour']}, trip {kind['trip']}, a double, b double")
    found = found.groupBy("tour").agg(F.collect_set(F.struct("trip", "a", "b")).alias("x")).select("tour", F.inline("x"))
    away = lambda c: F.floor(F.abs(F.col(c)) * scale)
    return found.select("tour", "trip", away("a").alias("d_start"), away("b").alias("d_end"))


def trip_candidates(tours: DataFrame, routes: DataFrame, trips: DataFrame) -> DataFrame:
    """tours (tour, date), routes (tour, lat, lng, dist_m: start and length), trips (trip, departed: local
    time, distance, sw_lat, sw_lng, ne_lat, ne_lng) to (tour, trip): same day, or the next before four in
    the morning; the box, unless missing or degenerate, holds the start; at least 0.9 of the length.

    A trip meets a row of a tour on one of its days, so pairs repeat only where tours or trips do; only then are
    they made distinct."""
    pairs = candidate_trips(tours, routes, trips).select("tour", "trip")
    repeated = lambda df, k: df.groupBy(k).count().filter("count > 1").limit(1).count()
    once = not repeated(tours, "tour") and not repeated(routes, "tour") and not repeated(trips, "trip")
    return pairs if once else pairs.distinct()


def best_trip(scored: DataFrame) -> DataFrame:
    """scored (tour, trip, d_start, d_end) to the best trip per tour with confidence and reason."""
    score = F.col("d_start") + F.col("d_end")
    w = Window.partitionBy("tour").orderBy("score", "trip")
    x = scored.filter("d_start <= 400").withColumn("score", score).withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).filter("n = 1")
    close = F.coalesce(F.col("next") < 2 * F.col("score") + 100, F.lit(False))
    confidence = F.when(close, "baixa").when(F.col("d_end") > 400, "media").when((F.col("d_start") <= 150) & (F.col("d_end") <= 150), "alta").otherwise("media")
    reason = F.when(close, "runner-up is close").when(F.col("d_end") > 400, "ends far from the route").otherwise("")
    return x.select("tour", "trip", "score", confidence.alias("confidence"), reason.alias("reason"))


def fields_to_write(matches: DataFrame, force: bool = False) -> DataFrame:
    """matches (tour, has_link, departed_at, arrived_at, moving_s, energy: as known; new_*: as derived;
    duration_s, d_arrival) to (tour, fields): a link if new; others if empty or forced."""
    plausible, reliable = F.col("duration_s") >= 900, F.col("d_arrival") <= 500
    free = lambda c: F.col(c).isNull() | F.lit(force)
    picks = [F.when(~F.col("has_link"), F.lit("link")), F.when(plausible & free("departed_at"), F.lit("departed_at")), F.when(plausible & reliable & free("arrived_at"), F.lit("arrived_at")), F.when(plausible & reliable & free("moving_s"), F.lit("moving_s")), F.when(plausible & reliable & free("energy"), F.lit("energy"))]
    return matches.select("tour", F.filter(F.array(*picks), lambda x: x.isNotNull()).alias("fields"))


def review_flags(matches: DataFrame) -> DataFrame:
    """Reasons for a person to look at a match (confidence, duration_s, d_arrival, by_stop, energy, new_energy)."""
    flags = [F.when(F.col("confidence") == "baixa", F.lit("low confidence")), F.when(F.col("duration_s") < 900, F.lit("implausibly short")), F.when(F.col("d_arrival") > 500, F.lit("arrival far from the route's end")), F.when(~F.col("by_stop"), F.lit("departure without a stop")), F.when(F.abs(F.col("new_energy") - F.col("energy")) > 0.2 * F.col("energy"), F.lit("energy differs"))]
    return matches.select("tour", F.filter(F.array(*flags), lambda x: x.isNotNull()).alias("reasons")).filter(F.size("reasons") > 0)


def resolve_handles(handles: DataFrame, people: DataFrame) -> DataFrame:
    """handles (handle), people (iri, alt_names, instagram, name) to (handle, person): by alias (the last
    person wins), else the profile's path, else the name (the first wins)."""
    keyed = people.select("iri", F.explode(F.coalesce("alt_names", F.array().cast("array<string>"))).alias("k"), F.lit(0).alias("rank")).union(people.select("iri", F.regexp_extract("instagram", r"instagram[.]com/([^/?]+)", 1), F.lit(1))).union(people.select("iri", "name", F.lit(2)))
    keyed = keyed.select("iri", norm_key(F.col("k")).alias("k"), "rank").filter("k != ''")
    best = keyed.groupBy("k", "rank").agg(F.max("iri").alias("last"), F.min("iri").alias("first")).groupBy("k").agg(F.min_by(F.when(F.col("rank") == 0, F.col("last")).otherwise(F.col("first")), "rank").alias("person"))
    return handles.withColumn("k", norm_key(F.col("handle"))).join(best, "k", "left").select("handle", "person")


def near_duplicate_handles(handles: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of handles that are equal as keys, or one letter apart from five letters on, or
    of which the shorter, of three letters or more, begins the longer.

    Blocks: the key, its one-letter deletions (two keys one edit apart share one), and its prefixes.
    """
    k = handles.select("handle").distinct().withColumn("k", norm_key(F.col("handle"))).filter("k != ''")
    pos = F.sequence(F.lit(1), F.length("k"))
    cut = F.transform(pos, lambda i: F.concat(F.lit("d:"), F.substr(F.col("k"), F.lit(1), i - 1), F.substr(F.col("k"), i + 1)))
    blocks = F.array_distinct(F.concat(F.array(F.concat(F.lit("d:"), "k")), F.when(F.length("k") >= 5, cut).otherwise(F.array().cast("array<string>"))))
    near = k.select("handle", "k", F.explode(blocks).alias("block"))
    typo = near.alias("x").join(near.alias("y"), "block").filter((F.col("x.handle") < F.col("y.handle")) & ((F.col("x.k") == F.col("y.k")) | ((F.length("x.k") >= 5) & (F.length("y.k") >= 5) & edit_distance_le1(F.col("x.k"), F.col("y.k"))))).select(F.col("x.handle").alias("a"), F.col("y.handle").alias("b"))
    starts = k.filter(F.length("k") >= 3).select(F.col("handle").alias("h2"), F.explode(F.transform(F.sequence(F.lit(3), F.length("k")), lambda i: F.substr(F.col("k"), F.lit(1), i))).alias("k"))
    prefix = k.filter(F.length("k") >= 3).join(starts, "k").filter(F.col("handle") != F.col("h2")).select(F.least("handle", "h2").alias("a"), F.greatest("handle", "h2").alias("b"))
    return typo.union(prefix).distinct()



def hamming_bands(hash_: Column, most: int = 5) -> Column:
    """Every choice of 8 - most of the eight bytes of 16 hex digits: within that many bits, one at least is equal.
    Three bytes, 24 bits, keep the lists of unrelated hashes short."""
    byte = lambda k: F.substring(hash_, 2 * k + 1, 2)
    return F.array(*[F.concat(F.lit("".join(map(str, ks)) + ":"), *map(byte, ks)) for ks in combinations(range(8), 8 - most)])


def hamming_dedup(incoming: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """incoming (row, kind, hash) and known (id, kind, hash) to (row, dup_of): the first known one, else the
    first earlier row, of the same kind within `most` bits. Equal hashes are compared as one.

    Known and incoming hashes are dealt by their bands together, once; bands are sent as numbers, and a clash of
    those only adds a comparison."""
    k = known.groupBy("kind", "hash").agg(F.min("id").alias("id"))
    i = incoming.groupBy("kind", "hash").agg(F.min("row").alias("first"))
    one = settled(i.join(k, ["kind", "hash"], "full"))
    banded = one.select("kind", "hash", "id", "first", F.explode(hamming_bands(F.col("hash"), most)).alias("band")).withColumn("band", F.xxhash64("kind", "band"))
    near = (F.col("x.band") == F.col("y.band")) & (F.col("x.kind") == F.col("y.kind")) & (hamming_hex(F.col("x.hash"), F.col("y.hash")) <= most)
    best = banded.alias("x").join(banded.alias("y"), near).groupBy("x.kind", "x.hash")
    # A hash is near itself, so its own values change nothing; with them both sides are the same rows, dealt once.
    best = best.agg(F.min(F.least("x.id", "y.id")).alias("id"), F.min(F.least("x.first", "y.first")).alias("f2"))
    out = incoming.join(best, ["kind", "hash"], "left")
    dup = F.coalesce(F.col("id").cast("string"), F.when(F.col("f2") < F.col("row"), F.col("f2").cast("string")))
    return out.select("row", dup.alias("dup_of"))


def luma(pixels: DataFrame, n: int = 32) -> DataFrame:
    """pixels (img, r, c, red, green, blue) to an n by n grid of brightness (img, r, c, luma), sampled between
    the four nearest pixels. Of a picture only the lines and columns that samples lie between are gathered, about
    4 * n * n pixels at most."""
    size = pixels.groupBy("img").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    y = 0.299 * F.col("red") + 0.587 * F.col("green") + 0.114 * F.col("blue")
    own = pixels.select("img", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), y.alias("y")).join(size, "img")

    def near(at: str, full: str) -> Column:
        """Whether some sample lies less than a pixel away."""
        k = lambda d: (F.col(at) + d + 0.5) * n / F.col(full) - 0.5
        return F.greatest(F.lit(0), F.ceil(k(-1) - 1e-6)) <= F.least(F.lit(n - 1), F.floor(k(1) + 1e-6))

    own = own.filter(near("r", "h") & near("c", "w")).groupBy("img").agg(F.first("h").alias("h"), F.first("w").alias("w"), F.collect_list(F.struct("r", "c", "y")).alias("p"))
    own = own.select("img", "h", "w", *[F.col(f"p.{k}").alias(k) for k in ("r", "c", "y")])

    def between(have: np.ndarray, full: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The lines before and after each sample: their places among those there are, whether they are, their shares."""
        u = (np.arange(n) + 0.5) * full / n - 0.5
        low = np.floor(u)
        lines = [(np.clip(low + d, 0, full - 1), 1 - (u - low) if d == 0 else u - low) for d in (0, 1)]
        at = [np.minimum(np.searchsorted(have, x), len(have) - 1) for x, _ in lines]
        return [(k, have[k] == x, share) for k, (x, share) in zip(at, lines)]

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples():
                (rows, r), (cols, c) = np.unique(x.r, return_inverse=True), np.unique(x.c, return_inverse=True)
                y = np.array(x.y, dtype=float)
                grid, there = np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)), dtype=bool)
                known = ~np.isnan(y)
                np.add.at(grid, (r[known], c[known]), y[known])
                there[r, c] = True
                out, some = np.zeros((n, n)), np.zeros((n, n), dtype=bool)
                for i, is_row, a in between(rows, x.h):
                    for j, is_col, b in between(cols, x.w):
                        has = there[np.ix_(i, j)] & is_row[:, None] & is_col[None, :]
                        out += np.where(has, grid[np.ix_(i, j)] * a[:, None] * b[None, :], 0.0)
                        some |= has
                i, j = np.nonzero(some)
                yield pd.DataFrame({"img": [x.img] * len(i), "r": i.astype("int32"), "c": j.astype("int32"), "luma": out[i, j]})

    return own.mapInPandas(sample, f"img {dict(own.dtypes)['img']}, r int, c int, luma double")


def phash(grid: DataFrame, n: int = 32) -> DataFrame:
    """luma() to (img, hash): the 8 by 8 lowest frequencies of the cosine transform against their median
    without the first; 16 hex digits. A picture's n * n samples are transformed at once."""
    own = grid.filter(F.col("r").between(0, n - 1) & F.col("c").between(0, n - 1)).groupBy("img").agg(F.collect_list(F.struct("r", "c", "luma")).alias("p"))
    own = own.select("img", *[F.col(f"p.{k}").alias(k) for k in ("r", "c", "luma")])

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cos = np.array([[math.cos((2 * m + 1) * math.pi * k / (2 * n)) for m in range(n)] for k in range(8)])
        for pdf in batches:
            out = []
            for x in pdf.itertuples():
                y = np.array(x.luma, dtype=float)
                full = np.zeros((n, n))
                np.add.at(full, (x.r[~np.isnan(y)], x.c[~np.isnan(y)]), y[~np.isnan(y)])
                v = (cos @ full @ cos.T).astype("float32").ravel()
                out.append((x.img, np.packbits(v > np.sort(v[1:])[31]).tobytes().hex()))
            yield pd.DataFrame(out, columns=["img", "hash"])

    return own.mapInPandas(hashes, f"img {dict(own.dtypes)['img']}, hash string")


def enrich_ingest(files: DataFrame, folders: DataFrame, people: DataFrame, exif: DataFrame, dups: DataFrame) -> DataFrame:
    """files (path, folder, handle, kind), folders (folder, tour), people (handle, person), exif (path, lat,
    lng), dups (path, dup_of): each file with what is known and the bucket it falls into."""
    x = files.join(folders, "folder", "left").join(people, "handle", "left").join(exif, "path", "left").join(dups, "path", "left")
    bucket = F.when(F.col("lat").isNull() | F.col("lng").isNull(), "no_gps").when(F.col("kind") != "image", "unsupported").when(F.col("dup_of").isNotNull(), "duplicate").when(F.col("person").isNull(), "no_person").when(F.col("tour").isNull(), "no_tour").otherwise("ready")
    return x.withColumn("bucket", bucket)


def tour_media_count(triples: DataFrame, p: str = "capturedDuring") -> DataFrame:
    return triples.filter(F.col("p") == p).groupBy(F.col("o").alias("tour")).agg(F.countDistinct("s").alias("n"))


CODE_ORDER = ("PH", "eH", "BT", "BP", "S")


def folder_to_ride(folders: DataFrame, sheet: DataFrame) -> DataFrame:
    """folders (name), sheet (date, codes map) to (name, code, title): from the sheet's row of that date,
    the first code in order, else as the name says."""
    f = folders.withColumn("p", parse_folder_name(F.col("name"))).withColumn("date", F.col("p.date"))
    code = F.coalesce(*[F.when(F.col("codes")[c].isNotNull(), F.concat_ws(" ", F.lit(c), F.col("codes")[c])) for c in CODE_ORDER])
    own = F.when(F.col("p.number").isNotNull(), F.concat_ws(" ", F.coalesce("p.series", F.lit("PH")), F.col("p.number").cast("string")))
    return f.join(sheet, "date", "left").select("name", F.coalesce(code, own).alias("code"), F.coalesce("sheet_title", "p.title").alias("title"))


def unique_routes(meta: DataFrame, fetched: DataFrame) -> DataFrame:
    """Every tour of meta (tour, provider, id) with the geometry that was fetched once per route, or an error."""
    got = fetched.dropDuplicates(["provider", "id"])
    return meta.join(got, ["provider", "id"], "left").withColumn("error", F.when(F.col("geometry").isNull(), F.coalesce("error", F.lit("not fetched"))))


def routes_to_fetch(meta: DataFrame) -> DataFrame:
    return meta.select("provider", "id").distinct()


def orphans(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right, on, "left_anti")


def tour_route_meta(tours: DataFrame) -> DataFrame:
    """tours (tour, title, date, instagram, url, editions) with provider and id; those without a route go."""
    ext, own = external_route_id(F.col("url")), own_route_slug(F.col("url"))
    return tours.withColumn("provider", F.when(ext.isNotNull(), "external").when(own.isNotNull(), "own")).withColumn("id", F.coalesce(ext, own)).filter("provider is not null")


def live_peer_lookup(positions: DataFrame, key: str) -> DataFrame:
    return positions.filter((F.lower("name") == key.lower()) | (F.col("id") == key))
