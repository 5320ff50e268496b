"""DATA-step operators on one table: keep, drop, filter, assign, band, flag, arrays, outputs, metadata."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.semantics import StepError, by_keys, names_of, require_columns


def copy(df: DataFrame) -> DataFrame:
    """SET with the implicit OUTPUT of every row."""
    return df.select("*")


def keep(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    columns = names_of(columns)
    require_columns(df, columns)
    return df.select(*columns)


def drop(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    columns = names_of(columns)
    require_columns(df, columns)
    return df.drop(*columns)


def where(df: DataFrame, condition: Column | str) -> DataFrame:
    """Filter on the input columns, before any assignment; a missing condition drops the row."""
    return df.filter(condition)


def assign(df: DataFrame, **columns: Column) -> DataFrame:
    """New columns; later ones may use earlier ones."""
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df


def subsetting_if(df: DataFrame, condition: Column | str) -> DataFrame:
    """Keep a row only if the condition holds after the assignments made so far."""
    return df.filter(condition)


def choose(branches: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """IF/ELSE IF/ELSE or SELECT/WHEN/OTHERWISE; a missing condition falls through to the next branch."""
    if not branches:
        raise StepError("choose() needs at least one branch")
    (condition, value), *rest = branches
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def band(column: str | Column, edges: Sequence[float], labels: Sequence[object]) -> Column:
    """Half-open bands [edge, next edge); NULL outside all bands. None leaves an end open."""
    if len(labels) != len(edges) - 1:
        raise StepError(f"{len(edges)} edges make {len(edges) - 1} bands, got {len(labels)} labels")
    value = F.col(column) if isinstance(column, str) else column
    branches = []
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = value.isNotNull()
        if low is not None:
            inside = inside & (value >= low)
        if high is not None:
            inside = inside & (value < high)
        branches.append((inside, label))
    return choose(branches)


def flag(condition: Column) -> Column:
    """1 if the condition holds, else 0, also when it is missing."""
    return F.when(condition, 1).otherwise(0)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    require_columns(df, names)
    return df.withColumnsRenamed(dict(names))


def over_array(df: DataFrame, columns: Sequence[str], expression: Callable[[Column], Column], names: Sequence[str] | None = None) -> DataFrame:
    """The same expression over each column of an ARRAY, in place or under new names."""
    require_columns(df, columns)
    return df.withColumns({new: expression(F.col(c)) for c, new in zip(columns, names or columns, strict=True)})


def output_each(df: DataFrame, index: str, start: Column | int, stop: Column | int) -> DataFrame:
    """DO index = start TO stop; OUTPUT: one row per value, none if stop < start."""
    first = F.lit(start) if isinstance(start, int) else start
    last = F.lit(stop) if isinstance(stop, int) else stop
    values = F.when(last >= first, F.sequence(first.cast("long"), last.cast("long")))
    return df.withColumn(index, F.explode(values))


def output_rows(df: DataFrame, rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Several explicit OUTPUTs per input row, each with its own values for the named columns."""
    structs = [F.struct(*[v.alias(k) for k, v in row.items()]) for row in rows]
    named = list(rows[0])
    base = [c for c in df.columns if c not in named]
    return df.withColumn("__row", F.explode(F.array(*structs))).select(*base, *[F.col("__row")[n].alias(n) for n in named])


def split_outputs(df: DataFrame, conditions: Mapping[str, Column]) -> dict[str, DataFrame]:
    """DATA a b c: one lazy filter per output over the same input; a row may go to several outputs.

    For outputs that are wanted together, `tag_outputs` and `write_outputs` read the input once.
    """
    return {name: df.filter(condition) for name, condition in conditions.items()}


def tag_outputs(df: DataFrame, conditions: Mapping[str, Column], tag: str = "output") -> DataFrame:
    """All outputs in one pass: each row once for each output it goes to, with the output's name."""
    names = [F.when(F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in conditions.items()]
    return df.withColumn(tag, F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())))


def write_outputs(df: DataFrame, conditions: Mapping[str, Column], path: str, tag: str = "output") -> dict[str, DataFrame]:
    """All outputs written in one pass, partitioned by their names; each frame reads its own folder."""
    tag_outputs(df, conditions, tag).write.mode("overwrite").partitionBy(tag).parquet(path)
    whole = df.sparkSession.read.schema(T.StructType([*[f for f in df.schema.fields if f.name != tag], T.StructField(tag, T.StringType())])).parquet(path)
    return {name: whole.filter(F.col(tag) == name).drop(tag) for name in conditions}


def with_metadata(df: DataFrame, formats: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Keep LENGTH, FORMAT, INFORMAT and LABEL as column metadata."""
    require_columns(df, formats)
    for column, facts in formats.items():
        df = df.withMetadata(column, {**df.schema[column].metadata, **facts})
    return df


def metadata_table(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, class and metadata entries (PROC CONTENTS style facts)."""
    rows = [(i, f.name, f.dataType.simpleString(), {k: str(v) for k, v in f.metadata.items()})
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, metadata map<string,string>")


def sort(df: DataFrame, by: str | Sequence, na_position: str = "default") -> DataFrame:
    """PROC SORT: BY variables in order, each ascending unless DESCENDING precedes it."""
    keys = by_keys(by)
    if not keys:
        raise StepError("sort needs BY variables")
    require_columns(df, [k.name for k in keys], "BY variable")
    return df.orderBy(*[k.column(na_position) for k in keys])
