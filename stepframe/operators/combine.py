"""Putting tables together: concatenation, match-merge, merge audit, joins safe against hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.semantics import StepError, names_of, require_columns, same_keys
from stepframe.sizing import cut_lineage


def concatenate(*frames: DataFrame) -> DataFrame:
    """SET a b c: rows by column name, missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append(base: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT INTO base SELECT: the columns must match by name."""
    return base.unionByName(rows)


def has_duplicate_keys(df: DataFrame, keys: Sequence[str]) -> bool:
    return not df.groupBy(*keys).count().filter("count > 1").isEmpty()


def full_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], *, missing_matches: bool = False) -> DataFrame:
    """Full outer join on named keys, as a left join and the rows of the right side that it doesn't reach.

    A missing key matches nothing, as in SQL, or with `missing_matches` another missing key, as in a match-merge.

    Spark splits a hot key of a left or anti join at run time but never one of a full outer join, and the key list of
    the anti join is de-duplicated before the shuffle. Each side is read twice.
    """
    on = names_of(on)
    join = same_keys if missing_matches else DataFrame.join
    from_left = join(left, right, on, "left")
    right_only = join(right, left.select(*on).distinct(), on, "left_anti")
    return from_left.unionByName(right_only, allowMissingColumns=True)


def _plain_full_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    right = right.withColumnsRenamed({k: f"__same_{k}" for k in on})
    joined = left.join(right, [F.col(k).eqNullSafe(F.col(f"__same_{k}")) for k in on], "full")
    return joined.withColumns({k: F.coalesce(k, f"__same_{k}") for k in on}).drop(*[f"__same_{k}" for k in on])


def match_merge(left: DataFrame, right: DataFrame, by: str | Sequence[str], overlap: str = "right", *,
                many_to_many: bool = False, check_keys: bool = True, unique: bool = False) -> DataFrame:
    """MERGE left right; BY keys. A missing BY value matches a missing one.

    `overlap` says what happens to other columns both sides have: the right (last named) or left value wins
    where its side is present, or `suffix` keeps both as `<c>_left` and `<c>_right`. Duplicate keys on both
    sides are an error unless `many_to_many`. `unique=True` promises unique keys on both sides, which allows
    one plain full outer join. The rows come in no order; sort them where order matters.
    """
    by = names_of(by)
    require_columns(left, by, "BY variable")
    require_columns(right, by, "BY variable")
    if overlap not in ("right", "left", "suffix"):
        raise StepError(f"overlap must be right, left or suffix, not {overlap!r}")
    if check_keys and not unique and not many_to_many and has_duplicate_keys(left, by) and has_duplicate_keys(right, by):
        raise StepError(f"both sides repeat values of {by}; pass many_to_many=True to pair them all")
    shared = [c for c in left.columns if c in right.columns and c not in by]
    a = left.withColumnsRenamed({c: f"{c}_left" for c in shared}).withColumn("__in_left", F.lit(True))
    b = right.withColumnsRenamed({c: f"{c}_right" for c in shared}).withColumn("__in_right", F.lit(True))
    merged = _plain_full_join(a, b, by) if unique else full_join(a, b, by, missing_matches=True)
    if overlap == "suffix":
        return merged.drop("__in_left", "__in_right")
    winner, loser = ("right", "left") if overlap == "right" else ("left", "right")
    picked = {c: F.when(F.col(f"__in_{winner}"), F.col(f"{c}_{winner}")).otherwise(F.col(f"{c}_{loser}")) for c in shared}
    columns = [*left.columns, *[c for c in right.columns if c not in left.columns]]
    return merged.select(*[picked[c].alias(c) if c in picked else F.col(c) for c in columns])


def merge_audit(left: DataFrame, right: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """How many keys and rows are matched, left-only and right-only.

    Both sides are counted per key in one aggregate over their union, so no row is joined.
    """
    by = names_of(by)
    sides = left.select(*by, F.lit(1).cast("long").alias("l"), F.lit(0).cast("long").alias("r")).unionByName(
        right.select(*by, F.lit(0).cast("long").alias("l"), F.lit(1).cast("long").alias("r")))
    per_key = sides.groupBy(*by).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    # A missing key matches a missing key, as in the merge.
    presence = F.explode(
        F.when((F.col("l") > 0) & (F.col("r") > 0), F.array(F.lit("matched")))
        .otherwise(F.filter(F.array(F.when(F.col("l") > 0, "left_only"), F.when(F.col("r") > 0, "right_only")), lambda x: x.isNotNull()))
    )
    return (
        per_key.select("l", "r", presence.alias("presence"))
        .groupBy("presence")
        .agg(
            F.count("*").alias("keys"),
            F.sum(F.when(F.col("presence") == "right_only", 0).otherwise(F.col("l"))).alias("left_rows"),
            F.sum(F.when(F.col("presence") == "left_only", 0).otherwise(F.col("r"))).alias("right_rows"),
        )
    )


def with_group_statistics(df: DataFrame, by: str | Sequence[str], *, write: bool = True, **aggregates: Column) -> DataFrame:
    """Detail rows with statistics of their group (`SUM() OVER (PARTITION BY)`, PROC SQL remerge).

    A window would hold a hot group in one task. The aggregate is combined before its shuffle and written to the
    shared folder, so that its real size decides the join: broadcast if small, and then the detail rows are not
    shuffled at all; else a sort-merge join whose hot keys Spark splits. `write=False` keeps it all lazy.
    """
    by = names_of(by)
    require_columns(df, by)
    if not by:
        return df.join(F.broadcast(df.agg(*[a.alias(n) for n, a in aggregates.items()])))
    stats = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggregates.items()])
    return same_keys(df, cut_lineage(stats) if write else stats, by, "left")


def upsert(base: DataFrame, updates: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Override merge: a row with a known key is replaced whole, others are appended. Keys are unique per side."""
    key = names_of(key)
    values = [c for c in base.columns if c not in key]
    old = base.select(*key, F.struct(*values).alias("__old"))
    new = updates.select(*key, F.struct(*values).alias("__new"))
    merged = old.join(new, key, "full").withColumn("__row", F.coalesce("__new", "__old"))
    return merged.select(*[F.col(c) if c in key else F.col("__row")[c].alias(c) for c in base.columns])
