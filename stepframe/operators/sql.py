"""SQL steps: named frames, parameters, scalars taken from data, recursion."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stepframe.semantics import StepError, dataset_name
from stepframe.sizing import cut_lineage


def run_sql(spark: SparkSession, query: str, frames: Mapping[str, DataFrame] | None = None, **parameters) -> DataFrame:
    """Run SQL text against named frames. `:name` is a value, `IDENTIFIER(:name)` a column or table name.

    The names hold for this query alone: views of the same names that the session had before are put back.
    """
    for name, frame in (frames or {}).items():
        if not isinstance(frame, DataFrame):
            raise TypeError(f"frames[{name!r}] must be a DataFrame, got {type(frame).__name__}")
    names = {dataset_name(name): frame for name, frame in (frames or {}).items()}
    own = {t.name for t in spark.catalog.listTables() if t.isTemporary} if names else set()
    before = {name: spark.table(name) for name in names if name in own}
    try:
        for name, frame in names.items():
            frame.createOrReplaceTempView(name)
        return spark.sql(query, args=parameters or None)
    finally:
        for name in names:
            spark.catalog.dropTempView(name)
        for name, frame in before.items():
            frame.createOrReplaceTempView(name)


class Datasets:
    """A registry of lazy frames under normalised names: what DATA, CREATE TABLE and PROC ... OUT= write to."""

    def __init__(self, spark: SparkSession, **frames: DataFrame) -> None:
        self.spark = spark
        self._frames: dict[str, DataFrame] = {}
        for name, frame in frames.items():
            self[name] = frame

    def __setitem__(self, name: str, frame: DataFrame) -> None:
        if not isinstance(frame, DataFrame):
            raise TypeError(f"dataset {name!r} must be a DataFrame, got {type(frame).__name__}")
        self._frames[dataset_name(name)] = frame

    def __getitem__(self, name: str) -> DataFrame:
        try:
            return self._frames[dataset_name(name)]
        except KeyError:
            raise StepError(f"unknown dataset {name!r}; known: {sorted(self._frames)}") from None

    def __contains__(self, name: str) -> bool:
        return dataset_name(name) in self._frames

    def sql(self, query: str, **parameters) -> DataFrame:
        return run_sql(self.spark, query, self._frames, **parameters)

    def create_table(self, name: str, query: str, *, save: bool = False, **parameters) -> DataFrame:
        """CREATE TABLE name AS query: a lazy frame, saved to the catalog only if asked."""
        self[name] = self.sql(query, **parameters)
        if save:
            self[name].write.mode("overwrite").saveAsTable(dataset_name(name))
        return self[name]

    def insert_into(self, name: str, rows: DataFrame) -> DataFrame:
        self[name] = self[name].unionByName(rows)
        return self[name]

    def sort(self, data: str, by, out: str | None = None, na_position: str = "default") -> DataFrame:
        """PROC SORT DATA= OUT=: without OUT= the sorted frame replaces its input."""
        from stepframe.operators.step import sort

        self[out or data] = sort(self[data], by, na_position)
        return self[out or data]


def with_scalar(df: DataFrame, name: str, source: DataFrame, aggregate: Column) -> DataFrame:
    """CALL SYMPUT / SELECT INTO :v kept in the plan: one aggregated row, broadcast to every row."""
    return df.join(F.broadcast(source.agg(aggregate.alias(name))))


def scalar(source: DataFrame, aggregate: Column):
    """The same value brought to the driver, for callers that steer the program with it."""
    return source.agg(aggregate).first()[0]


def recurse(seed: DataFrame, step: Callable[[DataFrame], DataFrame], *, level: str = "level") -> DataFrame:
    """WITH RECURSIVE ... UNION ALL without the row and level limits of the SQL form.

    Each round is one job: it sees only the rows of the round before, and its write counts and digests its own. A round
    with the very rows of an earlier one would go on for ever: that is an error, whatever the number of rounds.
    """
    rounds: list[DataFrame] = []
    seen: dict[tuple, int] = {}
    latest = seed
    while True:
        columns = latest.columns
        digest = F.xxhash64(*columns, F.concat_ws("", *[F.col(c).isNull().cast("string") for c in columns]))
        facts = Observation()
        # Two halves of order-free sums stand for the rows; decimals, because longs could overflow.
        marked = latest.observe(facts, F.count("*").alias("n"), F.sum(digest.cast("decimal(20,0)")).alias("sum"), F.sum(F.xxhash64(digest).cast("decimal(20,0)")).alias("check"))
        written = cut_lineage(marked.withColumn(level, F.lit(len(rounds))))
        state = (facts.get["n"], facts.get["sum"], facts.get["check"])
        if not state[0] and rounds:
            return reduce(DataFrame.unionByName, rounds)
        if state[0] and state in seen:
            raise StepError(f"round {len(rounds)} has the rows of round {seen[state]}: the recursion runs in a circle")
        seen[state] = len(rounds)
        rounds.append(written)
        if not state[0]:
            return written
        latest = step(written.drop(level))
