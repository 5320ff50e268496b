"""A uniform shuffle into shards of exact sizes: a hypergeometric communication matrix between input partitions and shards.

Only DataFrame functions: the draws are folds over short arrays, so a lost task draws the same numbers again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepframe.llm.expressions import bind
from stepframe.sizing import cut_lineage

FAN_OUT = 32


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.xxhash64(*parts).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))


def _sequence(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(u: Column, good: Column, total: Column, draws: Column) -> Column:
    """How many of `draws` without replacement from `total` are among the `good` ones, by inversion of u in [0, 1).

    The probabilities relative to that of the mode follow from ratios of neighbours, upwards and downwards, as far as
    12 standard deviations and 30 more, where they no longer change a double; their sum stands for 1.
    """
    count = {"good": good, "draws": draws, "bad": total - good}
    given = F.struct(*[v.cast("long").alias(k) for k, v in count.items()], u.alias("u"))

    def bounded(x: Column) -> Column:
        n = (x.good + x.bad).cast("double")
        low, high = F.greatest(F.lit(0).cast("long"), x.draws - x.bad), F.least(x.good, x.draws)
        mode = F.floor((x.draws + 1) * ((x.good + 1) / (n + 2))).cast("long")
        reach = F.ceil(12 * F.sqrt(x.draws * (x.good / n) * (x.bad / n))).cast("long") + 30
        return F.struct(x.good.alias("good"), x.draws.alias("draws"), x.bad.alias("bad"), x.u.alias("u"), low.alias("low"), high.alias("high"),
                        F.greatest(F.least(mode, high), low).alias("mode"), reach.alias("reach"))

    def draw(x: Column) -> Column:
        def rising(k: Column) -> Column:
            """The probability of k over that of k - 1."""
            return (x.good - k + 1).cast("double") * (x.draws - k + 1) / (k.cast("double") * (x.bad - x.draws + k))

        one = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s"), F.lit(None).cast("long").alias("k"))
        up = _sequence(x.mode + 1, F.least(x.high, x.mode + x.reach))
        down = _sequence(F.lit(1).cast("long"), F.least(x.mode - x.low, x.reach))

        def walk(steps: Column, start: Column, goal: Column, factor: Callable, value: Callable) -> Column:
            return F.aggregate(steps, start, lambda a, k: bind(a.w * factor(k), lambda w: F.struct(
                w.alias("w"), (a.s + w).alias("s"), F.when(a.k.isNull() & (a.s + w > goal), value(k)).otherwise(a.k).alias("k"))))

        def both(start: Column, goal: Column) -> Column:
            above = walk(up, start, goal, rising, lambda k: k)
            return bind(above, lambda a: walk(down, F.struct(F.lit(1.0).alias("w"), a.s.alias("s"), a.k.alias("k")), goal,
                                               lambda k: 1 / rising(x.mode - k + 1), lambda k: x.mode - k))

        def chosen(goal: Column) -> Column:
            return F.when(goal < 1, x.mode).otherwise(F.coalesce(both(one, goal).k, x.mode))

        return bind(x.u * both(one, F.lit(float("inf"))).s, chosen)

    return F.when(total <= 0, F.lit(0).cast("long")).otherwise(bind(given, lambda x: bind(bounded(x), draw)))


def split_counts(capacity: Column, draws: Column, *seeds: Column) -> Column:
    """A multivariate hypergeometric draw: how many of `draws` go to each of the shards with these remaining capacities."""
    whole = F.aggregate(capacity, F.lit(0).cast("long"), lambda a, x: a + x)
    state = F.struct(draws.cast("long").alias("left"), whole.alias("total"), F.array().cast("array<bigint>").alias("got"))

    def take(a: Column, x: Column) -> Column:
        return bind(hypergeometric(_uniform(*seeds, F.size(a.got)), x, a.total, a.left), lambda n: F.struct(
            (a.left - n).alias("left"), (a.total - x).alias("total"), F.concat(a.got, F.array(n)).alias("got")))

    return F.aggregate(capacity, state, take).got


def communication_matrix(sizes: DataFrame, shards: int, total: int, seed: int) -> DataFrame:
    """(part, counts): how many rows of each part go to each shard, for parts 0.. of given `n`; shard sizes differ by one at most.

    Parts are the leaves of a tree; a node deals the capacities it was given to its children one by one, so nodes of
    one level are independent rows and a draw needs no state besides its parent's.
    """
    leaf = sizes.select(F.col("part").cast("long").alias("node"), F.col("n").cast("long").alias("n"))
    levels = [leaf]
    highest = leaf.agg(F.max("node")).first()[0] or 0
    while highest:
        highest //= FAN_OUT
        levels.append(levels[-1].groupBy((F.floor(F.col("node") / FAN_OUT)).cast("long").alias("node")).agg(F.sum("n").alias("n")))
    even, more = divmod(total, shards)
    full = F.array(*[F.lit(even + (s < more)).cast("long") for s in range(shards)])
    current = levels[-1].select("node", full.alias("counts"))
    for depth in range(len(levels) - 2, -1, -1):
        children = levels[depth].groupBy(F.floor(F.col("node") / FAN_OUT).cast("long").alias("parent")).agg(
            F.sort_array(F.collect_list(F.struct("node", "n"))).alias("children"))
        state = F.struct(F.col("counts").alias("rest"), F.array().cast("array<array<bigint>>").alias("dealt"))

        def deal(a: Column, child: Column) -> Column:
            drawn = split_counts(a.rest, child.n, F.lit(seed), F.lit(depth), child.node)
            return bind(drawn, lambda got: F.struct(
                F.zip_with(a.rest, got, lambda x, y: x - y).alias("rest"), F.concat(a.dealt, F.array(got)).alias("dealt")))

        both = current.join(children, F.col("node") == F.col("parent"))
        both = both.select("children", F.aggregate("children", state, deal).dealt.alias("dealt"))
        current = both.select(F.explode(F.arrays_zip("children", "dealt")).alias("c")).select(F.col("c.children.node").alias("node"), F.col("c.dealt").alias("counts"))
    return current.withColumnRenamed("node", "part")


def shuffle_into_shards(rows: DataFrame, shards: int = 40, seed: int = 42, rows_per_block: int = 200_000) -> DataFrame:
    """All columns of `rows`, with `shard` (0 .. shards - 1) and `slot` (gapless from 0 in each shard).

    Every placement of the rows is equally likely, as far as the hash is random; shards hold the same number of rows or
    one more. The rows are written once with the partition they came from. The matrix says how many of a partition go
    to each shard; a local permutation says which. In its shard a row falls into one of several blocks and takes its place
    there by a second permutation, so no task has to hold a shard. Repeated rows, nulls and long values make no
    difference: rows are told apart by their place. Input columns named shard or slot are replaced. No rows give none.
    """
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    kept = cut_lineage(rows.select(F.struct(*columns).alias("payload"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    sizes = cut_lineage(kept.groupBy("part").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // (shards * rows_per_block)) or 1

    matrix = communication_matrix(sizes, shards, total, seed).select(F.col("part").alias("of"), F.transform(
        F.sequence(F.lit(1), F.lit(shards)), lambda s: F.aggregate(F.slice("counts", 1, s), F.lit(0).cast("long"), lambda a, x: a + x)).alias("ends"))
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "row"), "row")
    dealt = kept.select("part", "row", F.row_number().over(local).alias("place")).join(matrix, F.col("part") == F.col("of"))
    second = F.xxhash64(F.lit(seed), F.lit("shard"), "row")
    dealt = cut_lineage(dealt.select("row", F.size(F.filter("ends", lambda e: e < F.col("place"))).alias("shard"), F.pmod(second, F.lit(blocks)).alias("block")))

    in_shard = Window.partitionBy("shard").orderBy("block")
    before = dealt.groupBy("shard", "block").agg(F.count("*").alias("n")).select(
        F.col("shard").alias("s"), F.col("block").alias("b"), (F.sum("n").over(in_shard) - F.col("n")).alias("before"))
    in_block = Window.partitionBy("shard", "block").orderBy(second, "row")
    placed = dealt.withColumn("n", F.row_number().over(in_block)).join(before, (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b")))
    placed = placed.select("row", "shard", (F.col("before") + F.col("n") - 1).alias("slot"))
    # Rows move once, by their number, at every size.
    return kept.join(placed.hint("merge"), "row").select("payload.*", "shard", "slot")
