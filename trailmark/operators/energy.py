"""Analytics over graphs with energy costs: reach, flows, routes. Iterations are joins; each round's
frontier is cut off from its lineage by a checkpoint."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import Cost, leg_energy
from ..llm.common import Scratch
from ..scratch import dealt, settled


def directed_costs(edges: DataFrame, cost: Cost = Cost()) -> DataFrame:
    """edges (edge, step_m, profile) with cost_ab and cost_ba, step by step along the profile."""
    steps = F.zip_with(F.slice("profile", 1, F.size("profile") - 1), F.slice("profile", 2, F.size("profile") - 1), lambda a, b: b - a)
    total = lambda sign: F.aggregate(F.transform(steps, lambda dh: leg_energy(F.col("step_m"), sign * dh, cost)), F.lit(0.0), lambda a, x: a + x)
    return edges.withColumn("cost_ab", total(1)).withColumn("cost_ba", total(-1))


FRONT_TO_SEND = 200_000


FEW_ROUNDS = 8


@contextmanager
def within(half: DataFrame, sources: DataFrame) -> Iterator[DataFrame]:
    """half's edges that ways from the sources (node) can use, if FEW_ROUNDS steps end at FRONT_TO_SEND nodes at most;
    else all of half. So a search in one of many components deals and reads that one only.

    The edges are written once, as they come, and a step reads the ends of all. The table goes at the end."""
    made = Scratch(half.sparkSession)
    known = front = settled(sources.select("node").distinct())
    size = known.count()
    if size <= FRONT_TO_SEND:
        half = made.table(half, "half")
    try:
        for _ in range(FEW_ROUNDS):
            if size > FRONT_TO_SEND:
                break
            next_to = half.join(F.broadcast(front.withColumnRenamed("node", "src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
            front = settled(next_to.join(F.broadcast(known), "node", "left_anti"))
            more = front.count()
            if not more:
                half = made.table(half.join(F.broadcast(known.withColumnRenamed("node", "src")), "src", "left_semi"), "near")
                made.keep("near")
                break
            known, size = known.unionByName(front), size + more
        yield half
    finally:
        made.keep()


def relax(half: DataFrame, sources: DataFrame, *, e_max: float | None = None, valid: DataFrame | None = None, max_rounds: int = 10_000, checkpoint_every: int = 1) -> DataFrame:
    """half (src, dst, cost, edge), sources (origin, node): (origin, node, energy, parent, edge) of the cheapest
    path from the origin's nodes to every node within the budget.

    Each round the nodes that got cheaper offer their neighbours a path; the best offer per node counts if it
    improves. Ties go to the smaller parent. All origins advance in the same rounds.

    The edges are dealt by src once, so a round shuffles offers and what is known, not edges: a front of up to
    FRONT_TO_SEND rows is sent to them, a larger one is dealt like them. Each round's table of best paths replaces
    that before it. Only edges that the sources' ways can use are dealt, see within().
    """
    if valid is not None:
        half = half.join(valid.select(F.col("node").alias("dst")), "dst", "left_semi")
    with within(half.select("src", "dst", "cost", "edge"), sources) as half, dealt(half, "src") as half:
        return _relax(half, sources, e_max, max_rounds, checkpoint_every)


def _relax(half: DataFrame, sources: DataFrame, e_max: float | None = None, max_rounds: int = 10_000, checkpoint_every: int = 1) -> DataFrame:
    """relax() over edges that are dealt."""
    kind = dict(half.dtypes)
    null = lambda c: F.lit(None).cast(kind[c])
    start = sources.distinct().select("origin", "node", F.lit(0.0).alias("energy"), null("src").alias("parent"), null("edge").alias("edge"), F.lit(0).alias("round"))
    best = settled(start)
    size = best.count()
    for n in range(1, max_rounds + 1):
        front = best.filter(F.col("round") == n - 1).select("origin", F.col("node").alias("src"), F.col("energy").alias("so_far"))
        front = F.broadcast(front) if size <= FRONT_TO_SEND else front.hint("merge")
        offers = half.join(front, "src").select("origin", F.col("dst").alias("node"), (F.col("so_far") + F.col("cost")).alias("energy"), F.col("src").alias("parent"), "edge")
        if e_max is not None:
            offers = offers.filter(F.col("energy") <= e_max)
        offers = offers.groupBy("origin", "node").agg(F.min(F.struct("energy", "parent", "edge")).alias("new"))
        both = best.join(offers, ["origin", "node"], "full")
        # At equal energy a smaller parent is taken without another round: nothing gets cheaper beyond it.
        cheaper = F.col("new").isNotNull() & (F.col("energy").isNull() | (F.col("new.energy") < F.col("energy")))
        tie = F.col("new").isNotNull() & (F.col("new.energy") == F.col("energy")) & F.col("parent").isNotNull() & (F.col("new.parent") < F.col("parent"))
        take = cheaper | F.coalesce(tie, F.lit(False))
        pick = lambda c: F.when(take, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
        now = both.select("origin", "node", pick("energy"), pick("parent"), pick("edge"), F.when(cheaper, n).otherwise(F.col("round")).alias("round"))
        if n % checkpoint_every == 0:
            now = settled(now)
        size = now.filter(F.col("round") == n).count()
        best = now
        if not size:
            return (best if n % checkpoint_every == 0 else settled(best)).drop("round")
    raise RuntimeError(f"still improving after {max_rounds} rounds")


def reach(half: DataFrame, sources: DataFrame, *, mode: str = "from", e_max: float | None = None, valid: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """From the sources to every node, or from every node to them ("to": costs of the way back)."""
    if mode == "to":
        half = half.withColumn("cost", F.col("back"))
    return relax(half, sources, e_max=e_max, valid=valid, max_rounds=max_rounds)


def reach_round(half: DataFrame, sources: DataFrame, *, e_max: float | None = None, per_leg: bool = True, max_rounds: int = 10_000) -> DataFrame:
    """There and back: (origin, node, energy), with a budget for each leg or for both. Both searches use edges that
    were dealt once."""
    with within(half.select("src", "dst", "cost", "back", "edge"), sources) as half, dealt(half, "src") as half:
        out = _relax(half.drop("back"), sources, e_max, max_rounds).select("origin", "node", F.col("energy").alias("there"))
        back = _relax(half.drop("cost").withColumnRenamed("back", "cost"), sources, e_max, max_rounds).select("origin", "node", F.col("energy").alias("back"))
    both = out.join(back, ["origin", "node"]).withColumn("energy", F.col("there") + F.col("back"))
    return (both if per_leg or e_max is None else both.filter(F.col("energy") <= e_max)).select("origin", "node", "energy")


def passes(tree: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(origin, node, parent, edge, passes): how many nodes' best paths lead through each node, itself included.
    Only destinations in keep (origin, node) count, if given.

    After k rounds a node knows the sum over those up to 2^k - 1 steps below it, and its ancestor 2^k steps above.
    In a round it gives its sum to that ancestor, and jumps on; so rounds are the logarithm of the tree's depth.
    """
    x = tree.select("origin", "node", "parent", "edge", F.col("parent").alias("up"))
    if keep is not None:
        x = x.join(keep.select("origin", "node", F.lit(1).alias("own")).distinct(), ["origin", "node"], "left")
        x = x.withColumn("passes", F.coalesce("own", F.lit(0)).cast("long")).drop("own")
    else:
        x = x.withColumn("passes", F.lit(1).cast("long"))
    x = settled(x)
    while x.filter("up is not null").limit(1).count():
        more = x.filter("up is not null").groupBy("origin", F.col("up").alias("node")).agg(F.sum("passes").alias("more"))
        jump = x.select("origin", F.col("node").alias("up"), F.col("up").alias("up2"))
        both = x.join(more, ["origin", "node"], "left").join(jump, ["origin", "up"], "left")
        x = settled(both.select("origin", "node", "parent", "edge", F.col("up2").alias("up"), (F.col("passes") + F.coalesce("more", F.lit(0))).alias("passes")))
    return x.drop("up")


def edge_passes(flow: DataFrame) -> DataFrame:
    return flow.filter("edge is not null").groupBy("origin", "edge").agg(F.sum("passes").alias("passes"))


def swept_passes(flow: DataFrame, sweep: DataFrame) -> DataFrame:
    """sweep (edge, node): cells that a long move crosses also get its passes, if they were reached."""
    over = flow.join(sweep.withColumnRenamed("node", "crossed"), "edge").select("origin", F.col("crossed").alias("node"), F.col("passes").alias("more"))
    more = over.groupBy("origin", "node").agg(F.sum("more").alias("more"))
    return flow.join(more, ["origin", "node"], "left").withColumn("passes", F.col("passes") + F.coalesce("more", F.lit(0))).drop("more")


def extract_path(tree: DataFrame, wanted: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """wanted (origin, target) to (origin, target, node, edge, back): the nodes from the target back to the
    origin. Unreached targets have no rows."""
    step = tree.select("origin", "node", "parent", "edge")
    front = settled(wanted.join(step.withColumnRenamed("node", "target"), ["origin", "target"]).select("origin", "target", F.col("target").alias("node"), "edge", "parent", F.lit(0).alias("back")))
    found = front
    for n in range(1, max_rounds + 1):
        front = settled(front.filter("parent is not null").select("origin", "target", F.col("parent").alias("node")).join(step, ["origin", "node"]).select("origin", "target", "node", "edge", "parent", F.lit(n).alias("back")))
        if not front.limit(1).count():
            return found.drop("parent")
        found = found.unionByName(front)
    raise RuntimeError("path is longer than max_rounds")


def top_n_routes(half: DataFrame, src, dst, n: int = 3, penalty: float = 1.5, dist_coeff: float = 0.01, max_rounds: int = 10_000) -> DataFrame:
    """half (src, dst, edge, cost, len_m): (route, node, edge, back, energy, shared) of up to n routes. Each search
    adds (penalty**used - 1) * dist_coeff * len to edges that earlier routes used, over edges that were made once."""
    spark = half.sparkSession
    kind = dict(half.dtypes)["src"]
    start = spark.range(1).select(F.lit("o").alias("origin"), F.lit(src).cast(kind).alias("node"))
    goal = spark.range(1).select(F.lit("o").alias("origin"), F.lit(dst).cast(kind).alias("target"))
    used, out = None, None
    with within(half.select("src", "dst", "edge", "cost", "len_m"), start) as half:
        for k in range(n):
            h = half if used is None else half.join(used, "edge", "left").withColumn("cost", F.col("cost") + (F.pow(F.lit(penalty), F.coalesce("used", F.lit(0))) - 1) * dist_coeff * F.col("len_m")).drop("used")
            with dealt(h.select("src", "dst", "cost", "edge"), "src") as near:
                path = extract_path(_relax(near, start, max_rounds=max_rounds), goal, max_rounds)
            true = half.select("edge", F.col("dst").alias("node"), F.col("cost").alias("true"))
            path = settled(path.join(true, ["edge", "node"], "left").select(F.lit(k).alias("route"), "node", "edge", "back", F.coalesce("true", F.lit(0.0)).alias("energy")))
            if not path.limit(1).count():
                break
            path = path.withColumn("shared", F.lit(False)) if used is None else path.join(used.select("edge", F.lit(True).alias("shared")), "edge", "left").withColumn("shared", F.coalesce("shared", F.lit(False))).select("route", "node", "edge", "back", "energy", "shared")
            out = path if out is None else out.unionByName(path)
            used = settled(out.filter("edge is not null").groupBy("edge").agg(F.countDistinct("route").alias("used")))
    return out


def repulsion_cost(used: Column, distance: Column, mode: str = "power", penalty: float = 1.5) -> Column:
    """The factor on an edge's distance cost: by use of its cell, or by distance to used cells."""
    if mode == "power":
        return F.pow(F.lit(penalty), used)
    return 1 + penalty / (distance + 1 if mode == "linear" else distance * distance + 1)


def max_energy_walk(half: DataFrame, src, steps: int, dst=None, on_unreachable: str = "argmax") -> tuple[DataFrame, DataFrame]:
    """A walk of exactly so many edges with the most energy, revisits allowed: (layer, node, energy), and the best
    energy per node over all layers."""
    spark = half.sparkSession
    half = settled(half.select("src", "dst", "cost"))
    kind = dict(half.dtypes)["src"]
    layers = [settled(spark.range(1).select(F.lit(src).cast(kind).alias("node"), F.lit(0.0).alias("energy"), F.lit(None).cast(kind).alias("parent")))]
    for _ in range(steps):
        nxt = layers[-1].select(F.col("node").alias("src"), F.col("energy").alias("e")).join(half, "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.struct((F.col("e") + F.col("cost")).alias("energy"), F.col("src").alias("parent"))).alias("x"))
        layers.append(settled(nxt.select("node", "x.energy", "x.parent")))
    last = layers[-1]
    end = last.filter(F.col("node") == F.lit(dst).cast(kind)) if dst is not None else last
    if not end.limit(1).count():
        if on_unreachable == "error":
            raise ValueError("the end isn't reached in that many steps")
        end = last
    at = end.orderBy(F.desc("energy"), "node").limit(1)
    walk = at.select(F.lit(steps).alias("layer"), "node", "energy", "parent")
    rows = walk
    for k in range(steps - 1, -1, -1):
        walk = settled(layers[k].join(walk.select(F.col("parent").alias("node")), "node", "left_semi").select(F.lit(k).alias("layer"), "node", "energy", "parent"))
        rows = rows.unionByName(walk)
    every = layers[0].select("node", "energy")
    for x in layers[1:]:
        every = every.unionByName(x.select("node", "energy"))
    return rows.drop("parent"), every.groupBy("node").agg(F.max("energy").alias("energy"))


def inverted_reach(edges: DataFrame, sources: DataFrame, most: float, max_rounds: int = 10_000) -> DataFrame:
    """Prefer expensive edges: cost is what is left to the most expensive one."""
    return relax(edges.withColumn("cost", F.greatest(F.lit(most) - F.col("cost"), F.lit(0.0))), sources, max_rounds=max_rounds)


def density(half: DataFrame, refs: DataFrame, *, mode: str = "from", e_max: float | None = None, normalise: float = 1.0, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Many references at once: passes per edge over all of them, and the mean energy per node over those that
    reach it. refs (origin, node).

    Components of the graph that fit into a task are searched there, a block of origins at a time, and only sums
    come out. Larger ones, and those with costs of 0, have a row per origin and node in relax() and passes()."""
    from . import searches as many

    if mode == "to":
        half = half.withColumn("cost", F.col("back"))
    made = Scratch(half.sparkSession)
    half, refs, size = many.by_component(half, refs, made)
    found = made.table(many.through(half, refs, size, made, e_max=e_max, max_rounds=max_rounds), "through")
    by_edge, by_node = found.filter("edge is not null").select("edge", "passes"), found.filter("node is not null").select("node", "energy_sum", "reached")
    large = size.filter("not fits")
    if large.limit(1).count():
        tree = relax(half.join(large, "comp", "left_semi"), refs.join(large, "comp", "left_semi"), e_max=e_max, max_rounds=max_rounds)
        by_edge = by_edge.unionByName(passes(tree).filter("edge is not null").select("edge", F.col("passes").cast("double").alias("passes")))
        by_node = by_node.unionByName(partial_energy(tree))
    made.keep("through")
    return by_edge.groupBy("edge").agg((F.sum("passes") / normalise).alias("passes")), mean_energy(merge_partials([by_node]))


def reached_energy(half: DataFrame, refs: DataFrame, *, e_max: float | None = None, max_rounds: int = 10_000) -> DataFrame:
    """density()'s mean energy per node, without counting passes. Only components that don't fit into a task have a
    row per origin and node."""
    from . import searches as many

    made = Scratch(half.sparkSession)
    half, refs, size = many.by_component(half.select("src", "dst", "cost"), refs, made)
    found = many.through(half, refs, size, made, e_max=e_max, max_rounds=max_rounds).select("node", "energy_sum", "reached")
    large = size.filter("not fits").select("comp")
    if large.limit(1).count():
        tree = many.energies_in_blocks(half.join(large, "comp", "left_semi"), refs.join(large, "comp", "left_semi"), e_max=e_max, max_rounds=max_rounds)
        found = found.unionByName(partial_energy(tree))
    return mean_energy(merge_partials([found]))


def partial_energy(tree: DataFrame) -> DataFrame:
    return tree.groupBy("node").agg(F.sum("energy").alias("energy_sum"), F.count("*").alias("reached"))


def merge_partials(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("node").agg(F.sum("energy_sum").alias("energy_sum"), F.sum("reached").alias("reached"))


def mean_energy(parts: DataFrame) -> DataFrame:
    return parts.select("node", (F.col("energy_sum") / F.col("reached")).alias("energy"), "reached")


REFERENCES_A_BLOCK = 512


def accessibility_matrix(tree: DataFrame, refs: DataFrame) -> DataFrame:
    """(origin, target, energy) of every ordered pair of the references (origin, node); infinite where none leads.

    What the tree reaches is a join. The other pairs, which are part of the result, come from blocks: targets lie in
    blocks by hash, and an origin's row of a block is its targets without those that were reached. So pairs are made
    where they leave, and only reached ones are dealt.
    """
    r = settled(refs.select("origin", "node").distinct())
    blocks = -(-r.count() // REFERENCES_A_BLOCK)
    target = r.select(F.col("origin").alias("target"), "node")
    reached = tree.select("origin", "node", "energy").join(target, "node").join(r.select("origin").distinct(), "origin", "left_semi").filter("origin != target").select("origin", "target", "energy")
    if not blocks:
        return reached
    block = F.pmod(F.xxhash64("target"), F.lit(blocks)).cast("int").alias("block")
    own = reached.groupBy("origin", block).agg(F.collect_list(F.struct("target", "energy")).alias("own"))
    each = r.select("origin", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).distinct()
    of_block = target.select("target", block).groupBy("block").agg(F.collect_set("target").alias("targets"))
    x = each.join(own, ["origin", "block"], "left").join(of_block, "block")
    parts = int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.coalesce("own", F.array().cast(own.schema["own"].dataType))
    others = F.array_except("targets", F.concat(F.transform(own, lambda t: t["target"]), F.array("origin")))
    others = F.transform(others, lambda t: F.struct(t.alias("target"), F.lit(float("inf")).alias("energy")))
    return x.select("origin", F.inline(F.concat(own, others)))


def edge_energy(edges: DataFrame, node_energy: DataFrame) -> DataFrame:
    """edges (edge, a, b): the mean of both ends' energies, the one there is, or null."""
    e = lambda k: node_energy.select(F.col("node").alias(k), F.when(F.abs("energy") < float("inf"), F.col("energy")).alias(f"e{k}"))
    x = edges.join(e("a"), "a", "left").join(e("b"), "b", "left")
    return x.select("edge", "a", "b", F.coalesce((F.col("ea") + F.col("eb")) / 2, F.col("ea"), F.col("eb")).alias("energy"))


def constrained_fill(cells: DataFrame, reached: DataFrame, most: int, times: int = 1) -> DataFrame:
    """reached (r, c, v) of network cells, spread over all cells for display."""
    from .raster import box_smooth, idw_fill

    return box_smooth(idw_fill(cells, reached, most), times)
