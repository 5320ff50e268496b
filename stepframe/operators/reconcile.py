"""Reconciliation: prove that an actual table equals a reference table.

Totals are one aggregate per side. Keyed and keyless comparisons look at the two tables as one tagged union,
aggregated once, so that nothing is joined row by row and repeated keys or copies are combined before the shuffle.
Values are fetched only for rows known to differ.
"""

from __future__ import annotations

import textwrap
import traceback
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.operators.digests import differing_hashes, differing_ranges, range_of
from stepframe.operators.ordered import first_of_group
from stepframe.operators.summaries import quantiles
from stepframe.semantics import StepError, names_of, numeric_columns, require_columns, same_keys, value_class
from stepframe.sizing import cut_lineage

# SUM parity fails when the relative difference is strictly greater than this.
RELATIVE_TOLERANCE = 0.001
DETAIL_LENGTH = 300

CHECKS = "seq int, name string, status string, detail string"
_REF, _ACT = "ref", "actual"


def schema_differences(ref: DataFrame, actual: DataFrame) -> str:
    """Empty if names agree in any order and every column has the same class; else what differs."""
    ref_names, actual_names = set(ref.columns), set(actual.columns)
    if ref_names != actual_names:
        return f"missing={sorted(ref_names - actual_names)}, extra={sorted(actual_names - ref_names)}"
    classes = [(f.name, value_class(f.dataType), value_class(actual.schema[f.name].dataType)) for f in ref.schema.fields]
    return "; ".join(f"{name}: ref={r}, actual={a}" for name, r, a in classes if r != a)


def schema_comparison(ref: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per column of either side: class on each side and status. Metadata only, no data is read."""
    rows = []
    for name in sorted({*ref.columns, *actual.columns}):
        classes = [value_class(df.schema[name].dataType) if name in df.columns else None for df in (ref, actual)]
        status = "missing" if classes[1] is None else "extra" if classes[0] is None else "pass" if classes[0] == classes[1] else "class_mismatch"
        rows.append((name, *classes, status))
    return ref.sparkSession.createDataFrame(rows, "column string, ref_class string, actual_class string, status string")


def _comparable(ref: DataFrame, actual: DataFrame) -> list[str]:
    return [c for c in numeric_columns(ref) if c in actual.columns and value_class(actual.schema[c].dataType) == "numeric"]


def _number(column: str) -> Column:
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def _summed(column: str, data_type: T.DataType) -> Column:
    """The sum as a double. Whole and decimal numbers are added exactly and rounded once, so that the order of the rows,
    which decides the last digits of a sum of doubles beyond 2**53, plays no part."""
    if isinstance(data_type, T.IntegralType):
        return F.sum(F.col(column).cast("decimal(19,0)")).cast("double")
    if isinstance(data_type, T.DecimalType) and data_type.precision <= 28:
        return F.sum(column).cast("double")
    return F.sum(_number(column))


def _fixed(value: Column, digits: int = 4) -> Column:
    """A double with `digits` decimal places. From 2**53 on doubles are whole and all their digits are shown, where
    format_string would fill up with zeros."""
    whole = (F.abs(value) >= 2.0**53) & (F.abs(value) < 2.0**63)
    return F.when(whole, F.concat(value.try_cast("long").cast("string"), F.lit("." + "0" * digits))).otherwise(F.format_string(f"%.{digits}f", value))


def _tagged(ref: DataFrame, actual: DataFrame, columns: Sequence[Column]) -> DataFrame:
    return ref.select(F.lit(_REF).alias("__side"), *columns).unionByName(actual.select(F.lit(_ACT).alias("__side"), *columns))


def _on(side: str, value: Column) -> Column:
    return F.when(F.col("__side") == side, value)


def _totals(ref: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: row counts and, per comparable column, sum and count on each side. Missing values sum to 0.

    Each side is aggregated on its own to one row; the two rows are then laid side by side.
    """
    columns = _comparable(ref, actual)
    names = ["rows", *[f"{k}_{c}" for c in columns for k in ("sum", "count")]]

    def side(tag: str, df: DataFrame) -> DataFrame:
        values = [F.count("*")]
        for c in columns:
            values += [F.coalesce(_summed(c, df.schema[c].dataType), F.lit(0.0)), F.count(_number(c))]
        return df.agg(*[v.alias(n) for v, n in zip(values, names, strict=True)]).withColumn("__side", F.lit(tag))

    both = side(_REF, ref).unionByName(side(_ACT, actual))
    return both.agg(*[F.max(_on(s, F.col(n))).alias(f"{s}_{n}") for s in (_REF, _ACT) for n in names])


def _relative(ref: Column, actual: Column) -> Column:
    return F.try_divide(F.abs(ref - actual), F.abs(ref))


def _off(ref: Column, actual: Column, rtol: float) -> Column:
    """A zero reference asks for exactly zero; else strictly more than the tolerance fails."""
    return F.when(ref == 0, actual != 0).otherwise(F.coalesce(_relative(ref, actual) > rtol, F.lit(False)))


def aggregate_comparison(ref: DataFrame, actual: DataFrame, rtol: float = RELATIVE_TOLERANCE) -> DataFrame:
    """Per numeric reference column: sum, count and mean on both sides, with the status of each."""
    totals = _totals(ref, actual)
    comparable = _comparable(ref, actual)
    rows = []
    for c in numeric_columns(ref):
        if c not in comparable:
            nothing = F.lit(None).cast("double")
            values = [nothing, nothing, nothing, F.lit(None).cast("long"), F.lit(None).cast("long"), nothing, nothing]
            statuses = [F.lit("missing")] * 3
        else:
            rs, as_, rn, an = (F.col(f"{s}_{k}_{c}") for k in ("sum", "count") for s in (_REF, _ACT))
            rm, am = F.try_divide(rs, rn), F.try_divide(as_, an)
            values = [rs, as_, _relative(rs, as_), rn, an, rm, am]
            mean_off = _off(rm, am, rtol) | (rm.isNull() != am.isNull())
            statuses = [F.when(bad, "fail").otherwise("pass") for bad in (_off(rs, as_, rtol), rn != an, F.coalesce(mean_off, F.lit(False)))]
        names = ["ref_sum", "actual_sum", "rel_diff", "ref_count", "actual_count", "ref_avg", "actual_avg"]
        rows.append(F.struct(F.lit(c).alias("column"), *[v.alias(n) for v, n in zip(values, names, strict=True)],
                             *[s.alias(n) for s, n in zip(statuses, ["sum_status", "count_status", "avg_status"], strict=True)]))
    if not rows:
        return ref.sparkSession.createDataFrame([], "column string, ref_sum double, actual_sum double, rel_diff double, ref_count long, "
                                                "actual_count long, ref_avg double, actual_avg double, sum_status string, count_status string, avg_status string")
    return totals.select(F.inline(F.array(*rows)))


def _check(seq: int, name: str, detail: Column) -> Column:
    failed = detail != ""
    return F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("name"), F.when(failed, "fail").otherwise("pass").alias("status"),
                    F.when(failed, detail).alias("detail"))


def reconcile(ref: DataFrame, actual: DataFrame, rtol: float = RELATIVE_TOLERANCE) -> DataFrame:
    """The report (seq, name, status, detail): schema_parity, row_count, aggregate_parity.

    Lazy, one aggregate per side; names and classes come from the schemas.
    """
    comparable = _comparable(ref, actual)
    parts = []
    for c in numeric_columns(ref):
        if c not in comparable:
            parts.append(F.lit(f"{c}: missing in actual"))
            continue
        r, a = F.col(f"{_REF}_sum_{c}"), F.col(f"{_ACT}_sum_{c}")
        zero = F.concat(F.lit(f"{c}: ref=0, actual="), a.cast("string"))
        off = F.concat(F.lit(f"{c}: "), F.format_string("ref_sum=%s, actual_sum=%s, rel_diff=%.6f", _fixed(r), _fixed(a), F.coalesce(_relative(r, a), F.lit(0.0))))
        parts.append(F.when(_off(r, a, rtol), F.when(r == 0, zero).otherwise(off)))
    rows = F.when(F.col("ref_rows") != F.col("actual_rows"),
                  F.concat(F.lit("ref="), F.col("ref_rows").cast("string"), F.lit(", actual="), F.col("actual_rows").cast("string"))).otherwise("")
    checks = F.array(
        _check(1, "schema_parity", F.lit(schema_differences(ref, actual))),
        _check(2, "row_count", rows),
        _check(3, "aggregate_parity", F.concat_ws("; ", *parts) if parts else F.lit("")),
    )
    return _totals(ref, actual).select(F.inline(checks))


def full_report(ref: DataFrame, actual: DataFrame, keys: str | Sequence[str], rtol: float = RELATIVE_TOLERANCE, *, per_column: int = 3, unique_keys: bool = False) -> DataFrame:
    """All checks as rows (seq, name, status, detail): those of `reconcile`, then count_parity, mean_parity, row_hash,
    distribution and sample, which shows the first mismatches of each column. Tables of the same columns only.
    """
    keys = names_of(keys)

    def row(seq: int, name: str, failures: DataFrame, order: Sequence[str], words: Column) -> DataFrame:
        texts = F.array_sort(F.collect_list(F.struct(*order, words.alias("__words"))))
        return failures.agg(F.array_join(F.transform(texts, lambda x: x["__words"]), "; ").alias("d")).select(F.inline(F.array(_check(seq, name, F.col("d")))))

    totals = cut_lineage(aggregate_comparison(ref, actual, rtol))
    kinds = hash_diff(ref, actual, keys, unique_keys=unique_keys).groupBy("difference").agg(F.count("*").alias("n"))
    far = distribution_comparison(ref, actual, rtol=rtol).where("status = 'fail'")
    cells = mismatch_sample(record_diff(ref, actual, keys, allow_duplicates=True, unique_keys=unique_keys), keys, per_column)
    key = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    parts = [
        row(4, "count_parity", totals.where("count_status = 'fail'"), ["column"], F.format_string("%s: ref_count=%d, actual_count=%d", "column", "ref_count", "actual_count")),
        row(5, "mean_parity", totals.where("avg_status = 'fail'"), ["column"], F.format_string("%s: ref_mean=%.4f, actual_mean=%.4f", "column", "ref_avg", "actual_avg")),
        row(6, "row_hash", kinds, ["difference"], F.format_string("%s=%d", "difference", "n")),
        row(7, "distribution", far, ["column", "p"], F.format_string("%s p%d: ref=%.4f, actual=%.4f", "column", (F.col("p") * 100).cast("int"), "ref_value", "actual_value")),
        # As many cells as columns times `per_column`.
        row(8, "sample", cells, ["column", *keys], F.format_string("%s at %s: ref=%s, actual=%s", "column", key, "ref_value", "actual_value")),
    ]
    return reduce(DataFrame.unionByName, parts, reconcile(ref, actual, rtol))


def no_checks(spark) -> DataFrame:
    return spark.createDataFrame([], CHECKS)


def run_checks(spark, reference: Callable[[], DataFrame] | None, build: Callable[[], DataFrame], rtol: float = RELATIVE_TOLERANCE) -> DataFrame:
    """Build both sides and reconcile them now; a failure of either becomes a single failed `execution` check.

    Without a reference there is nothing to check. The three report rows are brought to the driver, so that errors
    inside tasks are caught too.
    """
    if reference is None:
        return no_checks(spark)
    try:
        actual = build()
        if not isinstance(actual, DataFrame):
            raise StepError(f"the steps must return a DataFrame, got {type(actual).__name__}")
        rows = reconcile(reference(), actual, rtol).collect()
    except Exception:
        return spark.createDataFrame([(1, "execution", "fail", textwrap.shorten(traceback.format_exc(), width=DETAIL_LENGTH))], CHECKS)
    return spark.createDataFrame(rows, CHECKS)


def summarize_checks(checks: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Per report: counts, overall verdict and joined details. No checks at all counts as passed."""
    by = names_of(by)
    passed = F.col("status") == "pass"
    details = F.array_sort(F.collect_list(F.when(~passed & (F.coalesce(F.col("detail"), F.lit("")) != ""), F.struct("seq", "detail"))))
    one = lambda name: F.coalesce(F.max(F.when((F.col("name") == name) & passed, True)), F.lit(False))
    none = F.count("*") == 0
    counted = checks.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(passed).alias("passed"),
        F.count_if(~passed).alias("failed"),
        (F.count_if(~passed) == 0).alias("all_passed"),
        (none | one("row_count")).alias("row_count_match"),
        (none | one("schema_parity")).alias("column_match"),
        F.array_join(F.transform(details, lambda d: d["detail"]), "; ").alias("__details"),
    )
    score = F.format_string("%d/%d checks passed", "passed", "total")
    summary = F.when(F.col("total") == 0, "no checks run").when(F.col("__details") != "", F.col("__details")).otherwise(score)
    return counted.withColumn("diff_summary", summary).drop("__details")


def report_as_json(checks: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """The report as one JSON document per group: {"checks": [{name, status, detail?}]}."""
    by = names_of(by)
    items = F.array_sort(F.collect_list(F.struct("seq", "name", "status", "detail")))
    bare = F.transform(items, lambda c: F.struct(c["name"].alias("name"), c["status"].alias("status"), c["detail"].alias("detail")))
    return checks.groupBy(*by).agg(F.to_json(F.struct(bare.alias("checks"))).alias("report"))


_EXACT_TEXT = "exact text"


def _common_form(ref_type: T.DataType, actual_type: T.DataType) -> str | None:
    """The type in which two columns compare without losing digits; None means as they are."""
    floating = (T.DoubleType, T.FloatType)
    if ref_type == actual_type and not isinstance(ref_type, floating):
        return None
    if all(isinstance(t, T.IntegralType) for t in (ref_type, actual_type)):
        return "long"
    if any(isinstance(t, floating) for t in (ref_type, actual_type)):
        return "double" if all(value_class(t) == "numeric" for t in (ref_type, actual_type)) else "string"
    if all(isinstance(t, (T.IntegralType, T.DecimalType)) for t in (ref_type, actual_type)):
        parts = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (19, 0) for t in (ref_type, actual_type)]
        whole, scale = max(p[0] for p in parts), max(p[1] for p in parts)
        return f"decimal({whole + scale},{scale})" if whole + scale <= 38 else _EXACT_TEXT
    return "string"


def _shown(column: Column, form: str | None) -> Column:
    """A value in its common form; numbers too wide for one decimal type as text without trailing zeros."""
    if form == _EXACT_TEXT:
        text = F.regexp_replace(column.cast("string"), r"(\.\d*?)0+$", "$1")
        return F.regexp_replace(text, r"\.$", "")
    return column if form is None else column.cast(form)


def _forms(ref: DataFrame, actual: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    return {c: _common_form(ref.schema[c].dataType, actual.schema[c].dataType) for c in columns}


def row_hash(forms: dict[str, str | None]) -> Column:
    """64-bit hash of the values in their common form; NaN as NULL, -0.0 as 0.0."""
    shown = {c: _number(c) + F.lit(0.0) if form == "double" else _shown(F.col(c), form) for c, form in forms.items()}
    # xxhash64 skips NULLs, so their places are hashed as well.
    places = F.concat_ws("", *[F.when(v.isNull(), "1").otherwise("0") for v in shown.values()])
    return F.xxhash64(*shown.values(), places)


def _shared_values(ref: DataFrame, actual: DataFrame, keys: Sequence[str], values: Sequence[str] | None) -> list[str]:
    require_columns(ref, keys, "key")
    require_columns(actual, keys, "key")
    values = list(values) if values is not None else [c for c in ref.columns if c not in keys]
    require_columns(ref, values)
    require_columns(actual, values)
    return values


def duplicate_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keys held by more than one row: a keyed comparison needs none."""
    keys = names_of(keys)
    require_columns(df, keys, "key")
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def _opened(ref: DataFrame, actual: DataFrame, keys: Sequence[str], values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Of both sides the rows in ranges of keys whose digests differ; equal tables cost one scan and shuffle no rows."""
    key_hash = row_hash(_forms(ref, actual, keys))
    hashed = [df.select(key_hash.alias("__k"), F.xxhash64(key_hash, row_hash(_forms(ref, actual, values))).alias("__r")) for df in (ref, actual)]
    bits, ranges = differing_ranges(*hashed)
    # At most 2**18 numbers.
    return tuple(df.join(F.broadcast(ranges), range_of(key_hash, bits) == F.col("range"), "left_semi") for df in (ref, actual))


def hash_diff(ref: DataFrame, actual: DataFrame, keys: str | Sequence[str], values: Sequence[str] | None = None, *, unique_keys: bool = False) -> DataFrame:
    """Keys whose rows differ: `missing` in actual, `extra` in actual, `changed`, or `duplicate` on a side.

    Only (key, side, hash) is shuffled, once, and combined per key before that. Where the keys are known to be unique
    (`unique_keys`), digests of key ranges are compared first and only ranges that differ are looked into; a key that is
    repeated alike on both sides is then no difference.
    """
    keys = names_of(keys)
    values = _shared_values(ref, actual, keys, values)
    if unique_keys:
        ref, actual = _opened(ref, actual, keys, values)
    sides = [df.select(*keys, F.lit(s).alias("__side"), row_hash(_forms(ref, actual, values)).alias("__h")) for s, df in ((_REF, ref), (_ACT, actual))]
    counted = sides[0].unionByName(sides[1]).groupBy(*keys).agg(
        *[F.count(_on(s, F.lit(1))).alias(f"{s}_n") for s in (_REF, _ACT)],
        *[F.max(_on(s, F.col("__h"))).alias(f"{s}_h") for s in (_REF, _ACT)],
    )
    kind = (
        F.when((F.col("ref_n") > 1) | (F.col("actual_n") > 1), "duplicate")
        .when(F.col("actual_n") == 0, "missing")
        .when(F.col("ref_n") == 0, "extra")
        .when(F.col("ref_h") != F.col("actual_h"), "changed")
    )
    return counted.select(*keys, kind.alias("difference")).filter(F.col("difference").isNotNull())


def one_sided_keys(ref: DataFrame, actual: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keys found on one side only (`ref_only`, `actual_only`)."""
    keys = names_of(keys)
    require_columns(ref, keys, "key")
    require_columns(actual, keys, "key")
    ref, actual = _opened(ref, actual, keys, [])
    sides = _tagged(ref, actual, [F.col(k) for k in keys]).groupBy(*keys).agg(*[F.count(_on(s, F.lit(1))).alias(s) for s in (_REF, _ACT)])
    found = F.when(F.col(_ACT) == 0, "ref_only").when(F.col(_REF) == 0, "actual_only")
    return sides.select(*keys, found.alias("side")).filter(F.col("side").isNotNull())


def multiset_diff(ref: DataFrame, actual: DataFrame, **options) -> DataFrame:
    """Rows whose number of copies differs: the row, its copies on each side. No key needed.

    The hashes of such rows come from the difference of two small tables of hash sums (`digests.differing_hashes`), and
    the rows are read back by hash, so equal rows are not shuffled. If too many rows differ for that, all are grouped.
    """
    if set(ref.columns) != set(actual.columns):
        raise StepError(f"different columns: {schema_differences(ref, actual)}")
    columns = ref.columns
    both = _tagged(ref, actual, [F.col(c) for c in columns])
    # NULLs are skipped by the hash, so their places are hashed as well.
    hashed = both.withColumn("__h", F.xxhash64(*columns, F.concat_ws("", *[F.col(c).isNull().cast("string") for c in columns])))
    found = differing_hashes(hashed.where(F.col("__side") == _REF), hashed.where(F.col("__side") == _ACT), **options)
    if found is not None:
        # At most as many as the cells of the table.
        wanted = ref.sparkSession.createDataFrame([(h,) for h in found], "__wanted long")
        both = hashed.join(F.broadcast(wanted), F.col("__h") == F.col("__wanted"), "left_semi").drop("__h")
    counted = both.groupBy(*columns).agg(*[F.count(_on(s, F.lit(1))).alias(f"{s}_copies") for s in (_REF, _ACT)])
    return counted.filter(F.col("ref_copies") != F.col("actual_copies"))


def record_diff(ref: DataFrame, actual: DataFrame, keys: str | Sequence[str], values: Sequence[str] | None = None, *,
                atol: float = 0.0, rtol: float = 0.0, allow_duplicates: bool = False, unique_keys: bool = False) -> DataFrame:
    """Per differing cell of rows on both sides: key, column, both values as text, delta.

    A numeric cell differs when |ref - actual| > atol + rtol * |ref| or one side is missing. Rows are compared by
    hash first (with `unique_keys` by digests of key ranges before that). The changed keys are written to the shared folder, so that their real number decides whether the
    wide rows are shuffled at all, and only their values are read again and paired.
    """
    keys = names_of(keys)
    values = _shared_values(ref, actual, keys, values)
    differences = hash_diff(ref, actual, keys, values, unique_keys=unique_keys)
    if not allow_duplicates:
        differences = differences.withColumn("difference", F.when(
            F.col("difference") == "duplicate",
            F.raise_error(F.concat(F.lit("record_diff: repeated key "), F.to_json(F.struct(*keys)))).cast("string"),
        ).otherwise(F.col("difference")))
    changed = cut_lineage(differences.filter(F.col("difference") == "changed").select(*keys))
    left = same_keys(ref, changed, keys, "left_semi").select(*keys, *[F.col(c).alias(f"__r_{c}") for c in values])
    right = same_keys(actual, changed, keys, "left_semi").select(*keys, *[F.col(c).alias(f"__a_{c}") for c in values])
    forms = _forms(ref, actual, values)
    cells = []
    for c in values:
        r, a = F.col(f"__r_{c}"), F.col(f"__a_{c}")
        if value_class(ref.schema[c].dataType) == value_class(actual.schema[c].dataType) == "numeric":
            if forms[c] == "long" or isinstance(ref.schema[c].dataType, T.IntegralType) and forms[c] is None:
                delta = F.try_subtract(a.cast("long"), r.cast("long")).cast("double")
            elif forms[c] is not None and forms[c].startswith("decimal") or isinstance(ref.schema[c].dataType, T.DecimalType) and forms[c] is None:
                wide = forms[c] or ref.schema[c].dataType.simpleString()
                delta = (a.cast(wide) - r.cast(wide)).cast("double")
            elif forms[c] == _EXACT_TEXT:
                # No type holds both exactly: the texts decide, the delta is rounded and never 0.
                rounded = a.cast("double") - r.cast("double")
                delta = F.when(_shown(a, forms[c]) == _shown(r, forms[c]), 0.0).when(rounded == 0, 4.9e-324).otherwise(rounded)
            else:
                # NaN counts as missing on either side.
                r, a = (F.nanvl(x.cast("double"), F.lit(None).cast("double")) for x in (r, a))
                delta = a - r
            differs = (F.abs(delta) > atol + rtol * F.abs(r.cast("double"))) | (r.isNull() != a.isNull())
        else:
            delta = F.lit(None).cast("double")
            differs = ~r.cast("string").eqNullSafe(a.cast("string"))
        cells.append(F.when(differs, F.struct(F.lit(c).alias("column"), r.cast("string").alias("ref_value"), a.cast("string").alias("actual_value"), delta.alias("delta"))))
    found = F.filter(F.array(*cells), lambda x: x.isNotNull())
    return same_keys(left, right, keys).select(*keys, F.inline(found))


def mismatch_counts(differences: DataFrame) -> DataFrame:
    """How many cells differ per column, and the largest absolute delta."""
    return differences.groupBy("column").agg(F.count("*").alias("mismatches"), F.max(F.abs("delta")).alias("largest_delta"))


def mismatch_sample(differences: DataFrame, keys: str | Sequence[str], per_column: int = 5) -> DataFrame:
    """The first `per_column` mismatches of each column in key order, for the report's sample section."""
    return first_of_group(differences, ["column"], names_of(keys), per_column)


def distribution_comparison(ref: DataFrame, actual: DataFrame, columns: Sequence[str] | None = None,
                            probabilities: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95), rtol: float = RELATIVE_TOLERANCE) -> DataFrame:
    """Percentiles of each numeric column on both sides within a relative tolerance. Exact at any size."""
    columns = list(columns) if columns is not None else _comparable(ref, actual)
    require_columns(ref, columns)
    require_columns(actual, columns)
    both = _tagged(ref, actual, [_number(c).alias(c) for c in columns])
    found = quantiles(both, ["__side"], columns, probabilities)
    paired = found.groupBy("variable", "p").agg(*[F.max(_on(s, F.col("quantile"))).alias(f"{s}_value") for s in (_REF, _ACT)])
    r, a = F.col("ref_value"), F.col("actual_value")
    bad = _off(r, a, rtol) | (r.isNull() != a.isNull())
    return paired.select(F.col("variable").alias("column"), "p", "ref_value", "actual_value", F.when(F.coalesce(bad, F.lit(False)), "fail").otherwise("pass").alias("status"))


# Which kind of mismatch a failed check shows, and its likely causes.
CAUSES = [
    ("row_count", "row count mismatch", "rows lost or doubled by a join, a condition left out, or rows written once too few or too often"),
    ("aggregate_parity", "column value mismatch", "a running value that starts wrong, a branch that takes other rows, or rounding"),
    ("schema_names", "column name mismatch", "names in another case, or the list of columns to keep or drop was not followed"),
    ("schema_classes", "type mismatch", "numbers held as text or the reverse, or dates counted from another day"),
]


def classify_failures(checks: DataFrame) -> DataFrame:
    """Failed checks with the pattern they show and its probable causes."""
    rules = checks.sparkSession.createDataFrame(CAUSES, "__rule string, pattern string, probable_cause string")
    by_name = (F.col("name") == "schema_parity") & F.coalesce(F.col("detail").startswith("missing="), F.lit(False))
    rule = F.when(by_name, "schema_names").when(F.col("name") == "schema_parity", "schema_classes").otherwise(F.col("name"))
    failed = checks.filter(F.col("status") != "pass").withColumn("__rule", rule)
    return failed.join(F.broadcast(rules), "__rule", "left").drop("__rule")
