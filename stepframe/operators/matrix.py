"""PROC IML on tables: vectors, long-form matrices (i, j, v), products and Gram matrices."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.operators.combine import with_group_statistics
from stepframe.operators.step import choose
from stepframe.semantics import names_of, require_columns

# Rows and columns of a dense block, about: 2 MB of doubles.
BLOCK = 512
# Numbers of a packed triangle that are added up as one row.
_CHUNK = 65_536


def read_vector(df: DataFrame, row_key: str, variable: str) -> DataFrame:
    """READ ALL VAR {x} INTO v: the vector keeps its row key."""
    require_columns(df, [row_key, variable])
    return df.select(row_key, variable)


def bind_columns(row_key: str, *vectors: DataFrame) -> DataFrame:
    """a || b: vectors side by side, matched on the row key."""
    first, *rest = vectors
    for other in rest:
        first = first.join(other, row_key)
    return first


def constant_vector(df: DataFrame, row_key: str, value: float, name: str) -> DataFrame:
    """J(n, 1, value) with one entry per row of df."""
    return df.select(row_key, F.lit(value).alias(name))


def n_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def tiers(score: Column, thresholds: Sequence[tuple[float, int]], lowest: int) -> Column:
    """The loop over a vector as one expression: first threshold reached wins."""
    return choose([(score >= low, tier) for low, tier in thresholds], lowest)


def z_scores(df: DataFrame, columns: str | Sequence[str], by: str | Sequence[str] = ()) -> DataFrame:
    """`z_<c>` with the sample standard deviation, overall or per group."""
    columns = names_of(columns)
    require_columns(df, columns)
    stats = {f"__{s}_{c}": f(c) for c in columns for s, f in (("mean", F.avg), ("std", F.stddev_samp))}
    scored = with_group_statistics(df, by, **stats)
    return scored.withColumns({f"z_{c}": F.try_divide(F.col(c) - F.col(f"__mean_{c}"), F.col(f"__std_{c}")) for c in columns}).drop(*stats)


def to_long(df: DataFrame, row_key: str, array: str) -> DataFrame:
    """Rows of arrays -> (i, j, v), j from 0."""
    return df.select(F.col(row_key).alias("i"), F.posexplode(array).alias("j", "v")).withColumn("v", F.col("v").cast("double"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """A * B in long form, block by block on a grid, whatever the sizes.

    Row, inner and column indices fall into groups of about `block` by hash. A block of A goes to every group of columns,
    one of B to every group of rows; each pair that shares its inner group is a dense product in one task, and the products
    are summed by (i, j). An inner index that most entries have is spread over all groups of rows and of columns. Entries
    exist where A and B share an inner index; missing values add nothing, and all missing give a missing entry.
    """
    left = a.select("i", F.col("j").alias("k"), F.col("v").cast("double").alias("x")).where("k IS NOT NULL")
    right = b.select(F.col("i").alias("k"), "j", F.col("v").cast("double").alias("y")).where("k IS NOT NULL")
    kind = "string" if left.schema["k"].dataType != right.schema["k"].dataType else left.schema["k"].dataType.simpleString()
    left, right = left.withColumn("k", F.col("k").cast(kind)), right.withColumn("k", F.col("k").cast(kind))
    sizes = left.agg(F.approx_count_distinct("i").alias("i"), F.approx_count_distinct("k").alias("k")).first(), right.agg(F.approx_count_distinct("j").alias("j")).first()
    n_i, n_k, n_j = (-(-n // block) or 1 for n in (sizes[0].i, sizes[0].k, sizes[1].j))

    def group(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def everywhere(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    rows = left.select(group("i", n_i).alias("p"), group("k", n_k).alias("q"), everywhere(n_j).alias("r"), "i", "k", "x")
    columns = right.select(everywhere(n_i).alias("p"), group("k", n_k).alias("q"), group("j", n_j).alias("r"), "k", "j", "y")
    parts = rows.groupBy("p", "q", "r").cogroup(columns.groupBy("p", "q", "r")).applyInArrow(
        _block_product, f"i {a.schema['i'].dataType.simpleString()}, j {b.schema['j'].dataType.simpleString()}, v double")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    found = column.combine_chunks().dictionary_encode(null_encoding="encode")
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def _block_product(left: pa.Table, right: pa.Table) -> pa.Table:
    """One dense product, with the numbers of shared inner indices and of products that are not missing."""
    (rows, names_i), (columns, names_j) = _coded(left.column("i")), _coded(right.column("j"))
    inner, names_k = _coded(pa.chunked_array([*left.column("k").chunks, *right.column("k").chunks], left.schema.field("k").type))
    x, y = left.column("x").to_numpy(), right.column("y").to_numpy()
    k_x, k_y = inner[:len(x)], inner[len(x):]
    has_x, has_y = left.column("x").is_valid().to_numpy(), right.column("y").is_valid().to_numpy()

    def dense(at: tuple, values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        out = np.zeros(shape)
        np.add.at(out, at, values)
        return out

    shape_x, shape_y = (len(names_i), len(names_k)), (len(names_k), len(names_j))
    plain_x, plain_y = has_x & np.isfinite(x), has_y & np.isfinite(y)
    product = dense((rows, k_x), np.where(plain_x, x, 0), shape_x) @ dense((k_y, columns), np.where(plain_y, y, 0), shape_y)
    shared = dense((rows, k_x), np.ones(len(x)), shape_x) @ dense((k_y, columns), np.ones(len(y)), shape_y)
    known = dense((rows, k_x), has_x, shape_x) @ dense((k_y, columns), has_y, shape_y)
    # Infinities and NaN would spread over a dense product by way of its zeros: they are paired with what they meet.
    for r, k, value in zip(rows[has_x & ~plain_x], k_x[has_x & ~plain_x], x[has_x & ~plain_x]):
        meets = (k_y == k) & has_y
        np.add.at(product[r], columns[meets], value * y[meets])
    for c, k, value in zip(columns[has_y & ~plain_y], k_y[has_y & ~plain_y], y[has_y & ~plain_y]):
        meets = (k_x == k) & plain_x
        np.add.at(product[:, c], rows[meets], value * x[meets])
    r, c = np.nonzero(shared)
    values = pa.array(product[r, c], pa.float64(), mask=known[r, c] == 0)
    return pa.table({"i": names_i.take(pa.array(r)), "j": names_j.take(pa.array(c)), "v": values})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's products, and in the last row and column its sums and count: the upper triangle row by row, in chunks."""
    total = None
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(0).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            rows = np.column_stack([flat.reshape(batch.num_rows, -1), np.ones(batch.num_rows)])
            total = rows.T @ rows if total is None else total + rows.T @ rows
    if total is not None:
        packed = total[np.triu_indices(len(total))]
        starts = list(range(0, len(packed), _CHUNK))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int32()), pa.array([packed[s:s + _CHUNK] for s in starts], pa.list_(pa.float64()))], names=["chunk", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, values in zip(batch.column(0).to_pylist(), batch.column(1)):
            more = values.values.to_numpy()
            sums[chunk] = sums[chunk] + more if chunk in sums else more
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["chunk", "sums"])


def gram(df: DataFrame, array: str, *, centred: bool = False) -> DataFrame:
    """A' A in long form (i, j, v), the mean removed from each column if `centred`.

    Each task adds up its rows' products; packed triangles of some tasks are added up in each of about sqrt(tasks) groups, those of
    the groups at the end. Long form comes last. A task holds d x d numbers, as the result has. Rows must be of one length.
    """
    require_columns(df, [array])
    width = df.agg(F.max(F.size(array))).first()[0] or 0
    d = F.lit(width)
    schema, groups = "chunk int, sums array<double>", math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    partial = df.select(array).mapInArrow(_packed, schema)
    salted = partial.withColumn("__group", F.spark_partition_id() % groups).repartition(groups, "chunk", "__group").drop("__group").mapInArrow(_added, schema)
    whole = salted.repartition(groups, "chunk").mapInArrow(_added, schema)
    # Place n of the packed triangle of m rows lies in row i, where i * m - i * (i - 1) / 2 numbers come before that row.
    m = width + 1
    place = whole.select(F.posexplode("sums").alias("at", "v"), "chunk").select((F.col("chunk").cast("long") * _CHUNK + F.col("at")).alias("n"), "v")
    guess = F.floor((2 * m + 1 - F.sqrt(F.lit(float((2 * m + 1) ** 2)) - 8.0 * F.col("n"))) / 2).cast("long")
    before = lambda i: i * m - F.floor(i * (i - 1) / 2)
    # The root is rounded: one row up or down is put right.
    row = F.when(before(F.col("g")) > F.col("n"), F.col("g") - 1).when(before(F.col("g") + 1) <= F.col("n"), F.col("g") + 1).otherwise(F.col("g"))
    upper = place.withColumn("g", guess).withColumn("i", row).select(F.col("i").cast("int").alias("i"), (F.col("n") - before(F.col("i")) + F.col("i")).cast("int").alias("j"), "v")
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    sums = upper.select(F.inline(both), "v")
    # The last row and column hold column sums and the row count.
    body = sums.filter((F.col("i") < d) & (F.col("j") < d))
    if not centred:
        return body
    edge = sums.filter((F.col("i") == d) & (F.col("j") < d))
    count = sums.filter((F.col("i") == d) & (F.col("j") == d)).select(F.col("v").alias("n"))
    return (
        body.join(edge.select(F.col("j").alias("i"), F.col("v").alias("si")), "i")
        .join(edge.select("j", F.col("v").alias("sj")), "j")
        .join(F.broadcast(count))
        .select("i", "j", (F.col("v") - F.col("si") * F.col("sj") / F.col("n")).alias("v"))
    )


def covariance(df: DataFrame, array: str) -> DataFrame:
    """Sample covariance matrix in long form."""
    products = gram(df, array, centred=True)
    return products.join(F.broadcast(df.agg(F.count("*").alias("n")))).select("i", "j", F.try_divide(F.col("v"), F.col("n") - 1).alias("v"))


def correlation(df: DataFrame, array: str) -> DataFrame:
    products = gram(df, array, centred=True)
    scale = products.filter("i = j").select(F.col("i").alias("k"), F.sqrt("v").alias("s"))
    return (
        products.join(scale.select(F.col("k").alias("i"), F.col("s").alias("si")), "i")
        .join(scale.select(F.col("k").alias("j"), F.col("s").alias("sj")), "j")
        .select("i", "j", F.try_divide(F.col("v"), F.col("si") * F.col("sj")).alias("v"))
    )
