"""Terrain rasters as rows: cells (r, c, h, mask). Neighbourhoods are equi-joins on moved coordinates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import Cost, leg_energy
from ..scratch import settled

DISAGREE_M = 100.0


def fuse_dem(local: DataFrame, world: DataFrame) -> DataFrame:
    """(r, c, h) twice to cells with how: the local height unless both exist and differ too much."""
    x = local.select("r", "c", F.col("h").alias("a")).join(world.select("r", "c", F.col("h").alias("b")), ["r", "c"], "full")
    off = F.coalesce(F.abs(F.col("a") - F.col("b")) > DISAGREE_M, F.lit(False))
    h = F.when(off, F.col("b")).otherwise(F.coalesce("a", "b"))
    return x.select("r", "c", h.alias("h"), h.isNotNull().alias("mask"), F.when(off, "discarded").when(F.col("a").isNotNull(), "local").otherwise("world").alias("how"))


def _blur(cells: DataFrame, axis: str, other: str, sigma_cells: float) -> DataFrame:
    reach = int(math.ceil(3 * sigma_cells))
    k = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    spread = cells.filter("mask").select(other, axis, "h", k.alias("k")).select(F.col(other), (F.col(axis) + F.col("k")).alias(axis), F.exp(-F.pow(F.col("k") / sigma_cells, 2) / 2).alias("w"), "h")
    mean = spread.groupBy(other, axis).agg((F.sum(F.col("w") * F.col("h")) / F.sum("w")).alias("__h"))
    return cells.join(mean, [other, axis], "left").select("r", "c", F.when(F.col("mask"), F.col("__h")).otherwise(F.col("h")).alias("h"), "mask")


def smooth_gaussian(cells: DataFrame, sigma_m: float, dx: float, dy: float) -> DataFrame:
    """Along rows, then along columns, over masked cells only, cut off at three sigmas."""
    return _blur(_blur(cells, "c", "r", sigma_m / dx), "r", "c", sigma_m / dy)


def sample_bilinear(points: DataFrame, cells: DataFrame, height: int, width: int) -> DataFrame:
    """points (id, r, c) with h. Values sit at cell centres; corners without data don't count; if none has
    any, the height of the floor cell."""
    clamp = lambda x, top: F.greatest(F.lit(0.0), F.least(x - 0.5, F.lit(float(top - 1))))
    x = points.withColumns({"__r": clamp(F.col("r"), height), "__c": clamp(F.col("c"), width)})
    r0, c0 = F.floor("__r"), F.floor("__c")
    r1, c1 = F.least(r0 + 1, F.lit(height - 1)), F.least(c0 + 1, F.lit(width - 1))
    fr, fc = F.col("__r") - r0, F.col("__c") - c0
    tap = lambda rr, cc, w, n: F.struct(rr.cast("int").alias("tr"), cc.cast("int").alias("tc"), w.alias("w"), F.lit(n).alias("n"))
    taps = x.select("id", F.inline(F.array(tap(r0, c0, (1 - fr) * (1 - fc), 0), tap(r0, c1, (1 - fr) * fc, 1), tap(r1, c0, fr * (1 - fc), 2), tap(r1, c1, fr * fc, 3))))
    on = taps.join(cells.select(F.col("r").alias("tr"), F.col("c").alias("tc"), "h", "mask"), ["tr", "tc"], "left")
    ok = F.coalesce("mask", F.lit(False))
    return on.groupBy("id").agg(F.coalesce(F.try_divide(F.sum(F.when(ok, F.col("h") * F.col("w"))), F.sum(F.when(ok, F.col("w")))), F.min(F.when(F.col("n") == 0, F.col("h")))).alias("h"))


def sample_nearest(points: DataFrame, cells: DataFrame) -> DataFrame:
    at = points.select("id", F.bround("r", 0).cast("int").alias("r"), F.bround("c", 0).cast("int").alias("c"))
    return at.join(cells.filter("mask"), ["r", "c"], "left").select("id", F.coalesce("h", F.lit(0.0)).alias("h"))


def idw_fill(cells: DataFrame, values: DataFrame, most: int) -> DataFrame:
    """cells (r, c), values (r, c, v) of network cells: each other cell from the first value along each of
    eight rays of at most `most` steps, weighted by 1 / d**2."""
    x = cells.select("r", "c").join(values, ["r", "c"], "left")
    lines = {"c": ("r", 1.0), "r": ("c", 1.0), "d1": (F.col("r") - F.col("c"), math.sqrt(2)), "d2": (F.col("r") + F.col("c"), math.sqrt(2))}
    num, den = [], []
    for name, (key, unit) in lines.items():
        along = F.col("c") if name == "c" else F.col("r")
        key = F.col(key) if isinstance(key, str) else key
        for back in (False, True):
            w = Window.partitionBy(key).orderBy(along.desc() if back else along.asc()).rowsBetween(Window.unboundedPreceding, -1)
            seen = F.last(F.when(F.col("v").isNotNull(), F.struct(along.alias("at"), F.col("v").alias("v"))), ignorenulls=True).over(w)
            col = f"__{name}{int(back)}"
            x = x.withColumn(col, seen)
            steps = F.abs(along - F.col(f"{col}.at"))
            ok = F.col(col).isNotNull() & (steps <= most)
            weight = 1.0 / F.pow(steps * unit, 2)
            num.append(F.when(ok, weight * F.col(f"{col}.v")).otherwise(0.0))
            den.append(F.when(ok, weight).otherwise(0.0))
    filled = F.try_divide(sum(num[1:], num[0]), sum(den[1:], den[0]))
    return x.select("r", "c", F.coalesce("v", filled).alias("v"), F.col("v").isNotNull().alias("network"))


def box_smooth(cells: DataFrame, times: int = 1) -> DataFrame:
    """cells (r, c, v, network): the mean of the 3 by 3 cells with a value; network cells stay."""
    for _ in range(times):
        offs = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        spread = cells.filter("v is not null").select("r", "c", "v", F.inline(offs)).select((F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "v")
        mean = spread.groupBy("r", "c").agg(F.avg("v").alias("__m"))
        cells = cells.join(mean, ["r", "c"], "left").select("r", "c", F.when(F.col("network"), F.col("v")).otherwise(F.col("__m")).alias("v"), "network")
    return cells


def _quotients(a: int, b: int) -> int:
    """Sum of the partial quotients of a / b."""
    return 0 if b == 0 else a // b + _quotients(b, a % b)


def move_list(n_dirs: int = 8, dx: float = 1.0, dy: float = 1.0) -> list[tuple[int, int, float, int]]:
    """(dr, dc, len_m, steps): 4 or 8 neighbours; for 8 * 2^k directions all moves without a common factor whose
    slopes have partial quotients of a sum up to k + 1."""
    near = range(-n_dirs // 8 - 1, n_dirs // 8 + 2)
    vectors = [(r, c) for r in near for c in near if math.gcd(r, c) == 1]
    if n_dirs == 4:
        vectors = [v for v in vectors if 0 in v]
    else:
        most = n_dirs.bit_length() - 3
        vectors = [v for v in vectors if _quotients(max(map(abs, v)), min(map(abs, v))) <= most]
    return [(r, c, math.hypot(r * dy, c * dx), max(abs(r), abs(c))) for r, c in sorted(vectors)]


def grid_moves(spark: SparkSession, n_dirs: int = 8, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    return spark.createDataFrame(move_list(n_dirs, dx, dy), "dr int, dc int, len_m double, steps int")


def _moved(cells: DataFrame, moves: list[tuple]) -> DataFrame:
    """cells (r, c, ...) once for each move, with dr, dc, len_m, steps and the cell it leads to."""
    each = F.inline(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(float(d)).alias("len_m"), F.lit(n).alias("steps")) for a, b, d, n in moves]))
    return cells.select("*", each).withColumns({"dst_r": F.col("r") + F.col("dr"), "dst_c": F.col("c") + F.col("dc")})


def grid_edges(cells: DataFrame, moves: list[tuple], cost: Cost = Cost(), height: int = 0, width: int = 0) -> DataFrame:
    """(src_r, src_c, dst_r, dst_c, len_m, dh, energy) between masked cells. Moves of several cells add up the
    energy of 2 * steps parts of the profile, and are dropped where a part lies on missing data."""
    m = cells.filter("mask").select("r", "c", "h")
    at = m.select(F.col("r").alias("dst_r"), F.col("c").alias("dst_c"), F.col("h").alias("h2"))
    e = _moved(m, moves).join(at, ["dst_r", "dst_c"]).select(F.col("r").alias("src_r"), F.col("c").alias("src_c"), "dst_r", "dst_c", "len_m", "steps", (F.col("h2") - F.col("h")).alias("dh"))
    short = e.filter("steps = 1").withColumn("energy", leg_energy(F.col("len_m"), F.col("dh"), cost))
    n = F.col("steps") * 2
    long = e.filter("steps > 1").withColumn("id", F.concat_ws(",", "src_r", "src_c", "dst_r", "dst_c")).withColumn("k", F.explode(F.sequence(F.lit(0), n)))
    pts = long.select(F.concat_ws("#", "id", "k").alias("id"), (F.col("src_r") + (F.col("dst_r") - F.col("src_r")) * F.col("k") / n + 0.5).alias("r"), (F.col("src_c") + (F.col("dst_c") - F.col("src_c")) * F.col("k") / n + 0.5).alias("c"))
    h = sample_bilinear(pts, m.withColumn("mask", F.lit(True)), height or 1 << 30, width or 1 << 30)
    prof = long.withColumn("pid", F.concat_ws("#", "id", "k")).join(h.withColumnRenamed("id", "pid"), "pid", "left")
    w = Window.partitionBy("id").orderBy("k")
    step = leg_energy(F.col("len_m") / n, F.col("h") - F.lag("h").over(w), cost)
    sums = prof.withColumn("part", step).groupBy("src_r", "src_c", "dst_r", "dst_c", "len_m", "steps", "dh").agg(F.sum("part").alias("energy"), F.count_if(F.col("h").isNull()).alias("holes")).filter("holes = 0").drop("holes")
    return short.unionByName(sums).drop("steps")


def portal_edges(portals: DataFrame, cells: DataFrame, cost: Cost = Cost()) -> DataFrame:
    """portals (r1, c1, r2, c2, len_m, z1, z2): bridges, both ways, at their surveyed heights or the ground's."""
    end = lambda k: cells.filter("mask").select(F.col("r").alias(f"r{k}"), F.col("c").alias(f"c{k}"), F.col("h").alias(f"h{k}"))
    x = portals.join(end(1), ["r1", "c1"]).join(end(2), ["r2", "c2"]).withColumn("dh", F.coalesce("z2", "h2") - F.coalesce("z1", "h1"))
    way = lambda a, b, s: x.select(F.col(f"r{a}").alias("src_r"), F.col(f"c{a}").alias("src_c"), F.col(f"r{b}").alias("dst_r"), F.col(f"c{b}").alias("dst_c"), "len_m", (s * F.col("dh")).alias("dh"))
    both = way(1, 2, 1).unionByName(way(2, 1, -1))
    return both.withColumn("energy", leg_energy(F.col("len_m"), F.col("dh"), cost))


def effective_mask(cells: DataFrame, network: DataFrame) -> DataFrame:
    on = network.select("r", "c").distinct().withColumn("__n", F.lit(True))
    return cells.join(on, ["r", "c"], "left").withColumn("mask", F.col("mask") & F.col("__n").isNotNull()).drop("__n")


def max_edge_cost(cells: DataFrame, dx: float, dy: float, cost: Cost = Cost()) -> DataFrame:
    d = F.lit(math.hypot(dx, dy))
    return cells.filter("mask").agg((F.max("h") - F.min("h")).alias("rise")).select((((cost.a_roll + cost.a_aero) * d + cost.beta * F.col("rise")) * 1.001).alias("most"))


TILE_CELLS = 256


def distance_to_used(cells: DataFrame, seeds: DataFrame, tile: int = TILE_CELLS) -> DataFrame:
    """(r, c, d) of the cells that a walk over cells reaches from a seed among them: the distance to the nearest one, 3
    for a side and 4 for a diagonal step, over three.

    Cells lie in square tiles. A tile takes the distances that got smaller at its neighbours' borders and works
    them in to the end; then its own border's go on. So rounds grow with the tiles that a way crosses, not with
    cells, a task holds one tile, and a round touches the tiles only that something comes to.
    """
    far = 1 << 60
    seed = seeds.select("r", "c").distinct().withColumn("__d", F.lit(0).cast("long"))
    own = lambda c: F.floor(F.col(c) / tile).alias(f"t{c}")
    x = cells.select("r", "c").distinct().join(seed, ["r", "c"], "left")
    x = settled(x.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.coalesce("__d", F.lit(far)).alias("d"), own("r"), own("c"), F.col("__d").isNotNull().alias("new")))
    touched = F.explode(F.array_distinct(F.array(*[F.struct(F.floor((F.col("r") + i) / tile).alias("tr"), F.floor((F.col("c") + j) / tile).alias("tc")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))

    def settle(key: tuple, mine: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        size = tile + 2  # with a frame for the neighbours' cells
        d = np.full((size, size), far, np.int64)
        put = lambda f: (f["r"].to_numpy() - key[0] * tile + 1, f["c"].to_numpy() - key[1] * tile + 1)
        there = np.zeros((size, size), bool)
        d[put(mine)], there[put(mine)] = mine["d"], True
        d[put(come.rename(columns={"come_r": "r", "come_c": "c"}))] = come["come_d"]
        while True:
            sides = np.minimum.reduce([np.roll(d, s, a) for s in (1, -1) for a in (0, 1)]) + 3
            corners = np.minimum.reduce([np.roll(d, (i, j), (0, 1)) for i in (1, -1) for j in (1, -1)]) + 4
            better = there & (np.minimum(sides, corners) < d)
            if not better.any():
                break
            d = np.where(better, np.minimum(sides, corners), d)
        now = d[put(mine)]
        return mine.assign(new=now < mine["d"].to_numpy(), d=now)

    first = True
    while True:
        front = x.filter("new").select("r", "c", "d", F.col("tr").alias("from_r"), F.col("tc").alias("from_c"), touched.alias("t")).select("r", "c", "d", "from_r", "from_c", "t.*")
        front = settled(front if first else front.filter("tr != from_r or tc != from_c")).drop("from_r", "from_c")
        come = front.toDF("come_r", "come_c", "come_d", "to_r", "to_c")
        active = come.select(F.col("to_r").alias("tr"), F.col("to_c").alias("tc")).distinct()
        if not front.limit(1).count():
            kind = dict(cells.dtypes)
            return x.filter(F.col("d") < far).select(F.col("r").cast(kind["r"]).alias("r"), F.col("c").cast(kind["c"]).alias("c"), (F.col("d") / 3).alias("d"))
        done = x.join(active, ["tr", "tc"], "left_semi").groupBy("tr", "tc").cogroup(come.groupBy("to_r", "to_c")).applyInPandas(settle, "tr long, tc long, r long, c long, d long, new boolean")
        idle = x.join(active, ["tr", "tc"], "left_anti").withColumn("new", F.lit(False))
        x, first = settled(done.unionByName(idle)), False
