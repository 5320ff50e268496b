"""Exact top-k inner products: lists sorted by each component are read in step, without random access, until no outsider can qualify."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepframe.sizing import cut_lineage


# Shares of the lists after which bounds are formed: each leaves half as much unread as the one before.
DEPTHS = (1 / 2, 3 / 4, 7 / 8, 15 / 16, 1.0)
# A query stops where at most this share of the items can still qualify, or 4 k of them.
OPEN = 1 / 16


class Lists:
    """Each component's list of a block of items, by falling value for positive weights and by rising value for negative ones."""

    def __init__(self, items: np.ndarray, kind: type):
        self.n, width = items.shape
        self.x = items.astype(kind)
        order = np.argsort(self.x, axis=0, kind="stable")
        self.rising = np.empty_like(order)
        np.put_along_axis(self.rising, order, np.arange(self.n)[:, None].repeat(width, axis=1), axis=0)
        self.ordered = np.take_along_axis(self.x, order, axis=0)
        self.squares = self.x * self.x
        self.norms = self.squares.sum(axis=1)

    def bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores (items x queries) after `depth` entries of each list.

        Entries read count as they are. Those that are not lie between the list's last value and the last one read, and
        their products sum to no more, up or down, than the length of the query's part times that of the item's
        part (Cauchy-Schwarz); the item's is known from its whole length, which is stored with it.
        """
        plus, minus = np.maximum(queries, 0).T, np.minimum(queries, 0).T
        down, up = self.rising >= self.n - depth, self.rising < depth
        least, most = self.ordered[0], self.ordered[-1]
        read = np.where(down, self.x, 0) @ plus + np.where(up, self.x, 0) @ minus
        if depth == self.n:
            return read, read
        no_down, no_up = (~down).astype(self.x.dtype), (~up).astype(self.x.dtype)
        high = (no_down * self.ordered[self.n - depth]) @ plus + (no_up * self.ordered[depth - 1]) @ minus
        low = (no_down * least) @ plus + (no_up * most) @ minus
        asked = no_down @ (plus * plus) + no_up @ (minus * minus)
        seen = (self.squares * down) @ (plus > 0).astype(self.x.dtype) + (self.squares * up) @ (minus < 0).astype(self.x.dtype)
        # Roots are rounded; the bound is not.
        reach = np.sqrt(asked * np.maximum(self.norms[:, None] - seen, 0)) * self.x.dtype.type(1.00001) + 1
        return read + np.maximum(low, -reach), read + np.minimum(high, reach)


def read_lists(queries: np.ndarray, items: np.ndarray, k: int, scouts: int = 16) -> tuple[list[np.ndarray], np.ndarray]:
    """For each query the places of all items that can be among its k best, ties included, and the share of its lists read.

    Lists are read in step to the depths of `DEPTHS`. A query stops when the upper bounds of all but a few items
    (`OPEN`) are below its k-th lower bound; those few are left to be resolved. All queries of a block read at the same
    depths, so a step is a few matrix products. The first `scouts` queries form bounds at every depth; the others do so from the
    first one on at which a scout stopped, and have read what lies before.
    """
    n, width = items.shape
    if n <= k:
        return [np.arange(n)] * len(queries), np.ones(len(queries))
    # Whole numbers and their sums are exact in single precision up to 2**24, in double up to 2**53.
    largest = max(int(np.abs(items).max(initial=0)), int(np.abs(queries).max(initial=0))) ** 2 * width
    kind = np.float32 if largest < 1 << 24 else np.float64
    lists, weights = Lists(items, kind), queries.astype(kind)
    kept: list[np.ndarray | None] = [None] * len(queries)
    share = np.ones(len(queries))

    def read(active: np.ndarray, depths: tuple[float, ...]) -> None:
        for part in depths:
            if not len(active):
                return
            lower, upper = lists.bounds(weights[active], n if part == 1 else max(k, int(n * part)))
            floor = np.partition(lower, n - k, axis=0)[n - k]
            possible = upper >= floor
            done = possible.sum(axis=0) <= max(4 * k, n * OPEN)
            if part == 1:
                done[:] = True
            for j in np.flatnonzero(done).tolist():
                kept[active[j]] = np.flatnonzero(possible[:, j])
            share[active[done]] = part
            active = active[~done]

    places = np.arange(len(queries))
    read(places[:scouts], DEPTHS)
    first = min(share[:scouts], default=1.0)
    read(places[scouts:], tuple(d for d in DEPTHS if d >= first))
    return kept, share


def sorted_access(queries: np.ndarray, items: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the places of all items that can be among its k best, ties included."""
    return read_lists(queries, items, k)[0]


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, item_ids: np.ndarray, items: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k best items of a block, without itself: by score, then by id; final scores of what is left are exact. `share`: of the lists read."""
    out = []
    # As many more candidates as rows bear the query's own id, for all of those are left out.
    names, copies = np.unique(item_ids, return_counts=True)
    at = np.minimum(np.searchsorted(names, query_ids), len(names) - 1)
    own = np.maximum(np.where(names[at] == query_ids, copies[at], 0), 1)
    for m in np.unique(own).tolist():
        alike = np.flatnonzero(own == m)
        for i, places, share in zip(alike.tolist(), *read_lists(queries[alike], items, k + m)):
            places = places[item_ids[places] != query_ids[i]]
            scores = items[places] @ queries[i]
            top = np.lexsort((item_ids[places], -scores))[:k]
            out.append(pd.DataFrame({"query_id": query_ids[i], "vec_id": item_ids[places][top], "score": scores[top], "share": share}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "share": []})


def block_results(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, per_block: int = 4096, queries_per_block: int = 2048) -> DataFrame:
    """(query_id, block, size, vec_id, score, share): each query's k best rows of each block, the block's rows, and the share of its lists that was read.

    Components x become floor(scale * x); ties go to the smaller id. Rows fall into blocks by a hash, a block of
    queries meets every block of rows, each pair in a task of its own; per query and block at most k rows come back. The
    pairs of blocks grow with queries x rows, which is the question asked; a task's size does not. Vectors that are null,
    empty, or hold null or non-finite components, null ids, and vectors shorter or longer than the most frequent length
    take no part. A repeated id stands for each of its rows. Scores must fit a long.
    """
    spark = vectors.sparkSession
    value = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & sound & (F.size("embedding") > 0))
    rows = cut_lineage(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), value.alias("v")))
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    schema = "query_id long, block int, size int, vec_id long, score long, share double"
    if widths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == widths.w)
    asking = rows.where("asks")
    n_blocks, q_blocks = -(-widths["count"] // per_block), -(-asking.count() // queries_per_block) or 1
    # One row of a block lies next to all others of it, so equal vectors spread evenly: the hash takes the id only.
    block = F.pmod(F.xxhash64(F.lit("rows"), "vec_id"), F.lit(n_blocks)).cast("int")
    q_block = F.pmod(F.xxhash64(F.lit("queries"), "vec_id"), F.lit(q_blocks)).cast("int")
    items = rows.select(block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"), "vec_id", "v")
    asked = asking.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), q_block.alias("q"), F.col("vec_id").alias("query_id"), F.col("v").alias("weights"))

    def meet(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(others):
            return pd.DataFrame({name.split(" ")[0]: [] for name in schema.split(", ")})
        best = best_of_block(mine.query_id.to_numpy(), np.stack(mine.weights.to_numpy()), others.vec_id.to_numpy(), np.stack(others.v.to_numpy()), k)
        return best.assign(block=mine.b.iloc[0], size=len(others))

    return asked.groupBy("b", "q").cogroup(items.groupBy("b", "q")).applyInPandas(meet, schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, per_block: int = 4096, queries_per_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k other rows with the largest integer inner products, see `block_results`."""
    parts = block_results(vectors, is_query, k, scale, per_block, queries_per_block)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def share_read(parts: DataFrame) -> DataFrame:
    """(query_id, share): how much of all list entries each query read before it stopped, from `block_results`."""
    read = parts.groupBy("query_id", "block").agg(F.max("size").alias("size"), F.max("share").alias("share"))
    return read.groupBy("query_id").agg((F.sum(F.col("size") * F.col("share")) / F.sum("size")).alias("share"))
