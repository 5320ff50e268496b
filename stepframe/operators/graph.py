"""Graph walks as rounds of DataFrame joins: reach, levels, roots and cycles.

The SQL form of recursion lists paths, which explodes on diamonds and never ends on cycles. Here a round works on distinct
nodes only and is one job: its result is written to the shared folder, and the same write counts what the next round needs.
Edges are written once, in buckets of the node they are followed from, so a round shuffles its frontier and not the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.semantics import StepError
from stepframe.sizing import cut_bucketed, cut_counting, cut_lineage

_COMPACT_EVERY = 8
# Rows that share a key from which on the key is broadcast.
_MANY = 20_000


def _known(parts: list[DataFrame]) -> list[DataFrame]:
    """Keep the union of past rounds short, so that plans stay small on deep graphs."""
    if len(parts) < _COMPACT_EVERY:
        return parts
    return [cut_lineage(reduce(DataFrame.unionByName, parts))]


def reach(edges: DataFrame, seeds: DataFrame, *, backwards: bool = False) -> DataFrame:
    """Distinct nodes (`node`, `distance`) reachable along `src -> dst` from the seed column `node`, seeds included."""
    steps = edges.select(F.col("dst" if backwards else "src").alias("node"), F.col("src" if backwards else "dst").alias("next")).distinct()
    steps = cut_bucketed(steps.where(F.col("node").isNotNull()), "node")
    latest, new = cut_counting(seeds.select("node").distinct().withColumn("distance", F.lit(0)), rows=F.lit(True))
    parts, distance = [latest], 0
    while new["rows"]:
        distance += 1
        parts = _known(parts)
        seen = reduce(DataFrame.unionByName, parts).select("node")
        found = latest.join(steps, "node").select(F.col("next").alias("node")).distinct()
        latest, new = cut_counting(found.join(seen, "node", "left_anti").withColumn("distance", F.lit(distance)), rows=F.lit(True))
        parts.append(latest)
    return reduce(DataFrame.unionByName, parts)


def peel(nodes: DataFrame, edges: DataFrame, *, backwards: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take off nodes without an incoming edge, round by round.

    Returns (node, level) of all nodes taken, the nodes left and the edges left; both are empty iff there is
    no cycle. The level of a node is the length of the longest path to it. Each edge carries how many edges its target
    has; a round counts down the targets of the nodes just taken, and keeps the counts of those that still wait.
    """
    source, target = ("dst", "src") if backwards else ("src", "dst")
    nodes = nodes.select("node").distinct()
    edges = cut_lineage(edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    needs = edges.groupBy(target).agg(F.count("*").alias("need"))
    carried = cut_bucketed(edges.join(needs, target).select(F.col(source).alias("node"), F.col(target).alias("next"), "need"), "node")
    free, new = cut_counting(nodes.join(needs.select(F.col(target).alias("node")), "node", "left_anti").withColumn("level", F.lit(0)), rows=F.lit(True))
    parts, waiting, level = [free], None, 0
    while new["rows"]:
        level += 1
        met = free.join(carried, "node").select(F.col("next").alias("node"), "need", F.lit(1).cast("long").alias("got"))
        met = met if waiting is None else met.unionByName(waiting)
        state, new = cut_counting(met.groupBy("node", "need").agg(F.sum("got").alias("got")), rows=F.col("need") == F.col("got"))
        free = state.where("need = got").select("node", F.lit(level).alias("level"))
        waiting = state.where("need > got")
        parts = _known([*parts, free])
    taken = cut_lineage(reduce(DataFrame.unionByName, parts))
    rest = cut_lineage(edges.join(taken.select(F.col("node").alias(source)), source, "left_anti"))
    return taken, cut_lineage(nodes.join(taken, "node", "left_anti")), rest


def trim(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left when nodes without an edge in, or without one out, are taken off for as long as there are any.

    Both directions count down in one loop. A node that is gone stays in the state, so that it is taken off once.
    """
    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.lit(1).cast("long").alias("ins"), F.lit(0).cast("long").alias("outs")).unionByName(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("next"), F.lit(0).cast("long").alias("ins"), F.lit(1).cast("long").alias("outs")))
    needs = links.groupBy("next").agg(F.sum("ins").alias("all_ins"), F.sum("outs").alias("all_outs"))
    carried = cut_bucketed(links.join(needs, "next"), "node")
    held = carried.where("all_ins > 0 AND all_outs > 0").select(F.col("next").alias("node")).distinct()
    free, new = cut_counting(nodes.select("node").distinct().join(held, "node", "left_anti"), rows=F.lit(True))
    gone, state = [free], None
    while new["rows"]:
        met = free.join(carried, "node").where("all_ins > 0 AND all_outs > 0").select(F.col("next").alias("node"), "ins", "outs", "all_ins", "all_outs", F.lit(False).alias("gone"))
        met = met if state is None else met.unionByName(state)
        summed = met.groupBy("node", "all_ins", "all_outs").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"), F.max("gone").alias("gone"))
        now = ~F.col("gone") & ((F.col("ins") == F.col("all_ins")) | (F.col("outs") == F.col("all_outs")))
        found, new = cut_counting(summed.withColumn("now", now), rows=F.col("now"))
        free = found.where("now").select("node")
        state = found.select("node", "ins", "outs", "all_ins", "all_outs", (F.col("gone") | F.col("now")).alias("gone"))
        gone = _known([*gone, free])
    off = cut_lineage(reduce(DataFrame.unionByName, gone))
    left = nodes.select("node").distinct().join(off, "node", "left_anti")
    rest = edges.join(off.withColumnRenamed("node", "src"), "src", "left_anti").join(off.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return left, rest


def _looked_up(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """`rows` with what `targets` holds for their key (unique there, NULL if it holds nothing).

    The keys are counted first. One that many rows share is looked up once and its answer broadcast, so that no task gets
    all rows of a key; the other rows meet theirs in a shuffle.
    """
    wanted = rows.groupBy(key).agg(F.count("*").alias("__n"))
    answers = cut_lineage(wanted.join(targets, key, "left"))
    # At most one key for each _MANY rows.
    often = answers.where(F.col("__n") > _MANY).withColumn("__hit", F.lit(True)).drop("__n")
    seldom = answers.where(F.col("__n") <= _MANY).drop("__n")
    met = rows.join(F.broadcast(often), key, "left")
    return met.where("__hit").drop("__hit").unionByName(met.where("__hit IS NULL").select(*rows.columns).join(seldom, key))


def roots(parents: DataFrame) -> DataFrame:
    """(`node`, `parent` or NULL) -> (`node`, `root`, `depth`) by pointer doubling: log2(depth) rounds.

    A parent that is not in the table ends the walk. A circle of parents is an error that names one of its nodes. A node
    whose root is known takes no part in later rounds, except that others may jump to it.
    """
    parents = parents.select("node", "parent")
    zero, one = (F.lit(n).cast("long") for n in (0, 1))
    known = parents.where("node IS NOT NULL").select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    alone = parents.where("parent IS NULL").select("node", F.col("node").alias("root"), zero.alias("depth"), F.lit(True).alias("ended"))
    first = _looked_up(parents.where("parent IS NOT NULL"), known, "parent").select(
        "node", F.when(F.col("known"), F.col("parent")).otherwise(F.col("node")).alias("root"), F.when(F.col("known"), one).otherwise(zero).alias("depth"), F.col("known").isNull().alias("ended"))
    state, new = cut_counting(alone.unionByName(first), rows=F.lit(True), open=~F.col("ended"))
    done: list[DataFrame] = []
    # Doubling reaches every root in this many rounds, for no path is longer than the table.
    for left in reversed(range(new["rows"].bit_length() + 2)):
        done = _known([*done, state.where("ended")])
        if not new["open"]:
            break
        walking = state.where("NOT ended").select("node", "root", "depth")
        ahead = reduce(DataFrame.unionByName, [*done, state.where("NOT ended")]).select(
            F.col("node").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"), F.col("ended").alias("there"))
        state, new = cut_counting(_looked_up(walking, ahead, "root").select(
            "node", F.col("further").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("ended")), open=~F.col("ended"))
        if not left and new["open"]:
            raise StepError(f"the parents of {state.where('NOT ended').first()['root']!r} form a circle")
    else:
        done.append(state.where("ended"))
    return reduce(DataFrame.unionByName, done).select("node", "root", "depth")


def _pass_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Edges that pass over chains of nodes with one edge in and one out; (node, before, after) of the nodes passed over,
    (node, part) of rings that are nothing but such nodes. None if there are no such nodes.

    A node passed over lies on a cycle iff the chain's two ends are in one part.
    """
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ins"), F.min("src").alias("before"))
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outs"), F.min("dst").alias("after"))
    links, found = cut_counting(ins.where("ins = 1").join(outs.where("outs = 1"), "node").select("node", "before", "after"), rows=F.lit(True))
    if not found["rows"]:
        return None
    inner = links.select(F.col("node").alias("before"))
    follows = links.join(inner, "before", "left_semi").select("node", F.col("before").alias("jump"))
    state = cut_lineage(links.select("node").join(follows, "node", "left").select(
        "node", F.coalesce("jump", "node").alias("head"), F.col("jump").isNull().alias("ended"), F.coalesce(F.least("jump", "node"), "node").alias("least")))
    for _ in range(found["rows"].bit_length() + 1):
        ahead = state.select(F.col("node").alias("head"), F.col("head").alias("further"), F.col("ended").alias("there"), F.col("least").alias("lower"))
        state, new = cut_counting(state.where("NOT ended").join(ahead, "head").select(
            "node", F.col("further").alias("head"), F.col("there").alias("ended"), F.least("least", "lower").alias("least")).unionByName(state.where("ended")),
            open=~F.col("ended"))
        if not new["open"]:
            break
    # What has not ended after so many doublings goes round; by then the least node of the ring is known.
    rings = state.where("NOT ended").select("node", F.col("least").alias("part"))
    placed = state.where("ended").select("node", "head").join(links, "node")
    ends = placed.groupBy("head").agg(F.max(F.when(F.col("node") == F.col("head"), F.col("before"))).alias("first"), F.count("*").alias("n"))
    last = placed.join(inner.select(F.col("before").alias("after")), "after", "left_anti").select("head", F.col("after").alias("last"))
    chains = cut_lineage(ends.join(last, "head").select("head", "first", "last"))
    passed = cut_lineage(placed.select("node", "head").join(chains, "head").select("node", F.col("first").alias("before"), F.col("last").alias("after")))
    gone = links.select("node")
    kept = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    over = chains.where(F.col("first") != F.col("last")).select(F.col("first").alias("src"), F.col("last").alias("dst"))
    return cut_lineage(kept.unionByName(over).distinct()), passed, cut_lineage(rings)


def _found_parts(left: DataFrame, rest: DataFrame) -> DataFrame:
    """Some strongly connected parts: nodes take the highest-ranking node that reaches them as colour; those the colour's
    own node can be reached from, inside the colour, are its part. Ranks are hashes, so that many parts are found at once."""
    colours = cut_lineage(left.withColumn("colour", F.struct(F.xxhash64("node").alias("rank"), "node")))
    edges = cut_bucketed(rest, "src")
    fresh, new = colours, {"rows": 1}
    while new["rows"]:
        offered = fresh.withColumnRenamed("node", "src").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("offer"))
        state, new = cut_counting(colours.join(offered, "node", "left").select(
            "node", F.greatest("colour", "offer").alias("colour"), F.coalesce(F.col("offer") > F.col("colour"), F.lit(False)).alias("changed")), rows=F.col("changed"))
        colours, fresh = state.drop("changed"), state.where("changed").drop("changed")
    named = colours.select("node", F.col("colour.node").alias("part"))
    inside = (rest.join(named.select(F.col("node").alias("src"), F.col("part").alias("p1")), "src")
              .join(named.select(F.col("node").alias("dst"), F.col("part").alias("p2")), "dst").filter("p1 = p2").select("src", "dst"))
    members = reach(cut_lineage(inside), named.where(F.col("node") == F.col("part")).select("node"), backwards=True).select("node")
    return cut_lineage(members.join(named, "node"))


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that can reach themselves, with the smallest node of their cycle group: (`node`, `cycle`).

    Chains are passed over (pointer doubling), so rings and long tails of any length take few rounds; peeling from both
    ends removes what lies on no cycle; parts of what is left are found from pivots all over the graph at once and taken
    out, until nothing is left. Then the nodes passed over join the part of their two ends.
    """
    own = edges.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("node")).distinct()
    left, rest = nodes.select("node").distinct(), cut_lineage(edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    found: list[DataFrame] = []
    passed: list[DataFrame] = []
    while True:
        short = _pass_chains(rest)
        if short is not None:
            rest, over, rings = short
            passed.append(over)
            found.append(rings)
            left = left.join(over.select("node").unionByName(rings.select("node")), "node", "left_anti")
        left, rest = trim(left, rest)
        rest, edges_left = cut_counting(rest, rows=F.lit(True))
        if not edges_left["rows"]:
            break
        left = cut_lineage(left)
        parts = _found_parts(left, rest)
        found.append(parts.join(parts.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1"), "part", "left_semi").select("node", "part"))
        left = left.join(parts, "node", "left_anti")
        rest = cut_lineage(rest.join(parts.select(F.col("node").alias("src")), "src", "left_anti").join(parts.select(F.col("node").alias("dst")), "dst", "left_anti"))
    members = reduce(DataFrame.unionByName, found) if found else own.withColumn("part", F.col("node")).limit(0)
    for over in reversed(passed):
        members = cut_lineage(members)
        part = lambda end: members.select(F.col("node").alias(end), F.col("part").alias(f"part_{end}"))
        ends = over.join(part("before"), "before", "left").join(part("after"), "after", "left")
        # A chain from a node back to itself makes a part of the two, if the node has none.
        back = ends.where(F.col("before") == F.col("after")).select("node", "before", F.coalesce("part_before", "before").alias("part"))
        anew = back.select(F.explode(F.array("node", "before")).alias("node"), "part").distinct()
        closed = ends.where((F.col("before") != F.col("after")) & (F.col("part_before") == F.col("part_after"))).select("node", F.col("part_before").alias("part"))
        members = members.unionByName(closed).unionByName(anew).distinct()
    members = cut_lineage(members)
    named = members.join(members.groupBy("part").agg(F.min("node").alias("cycle")), "part").select("node", "cycle")
    # A node with an edge to itself may also lie on a longer cycle: the longer one names it.
    return named.unionByName(own.join(named, "node", "left_anti").select("node", F.col("node").alias("cycle")))
