"""Validation of raw bars: one wide aggregate per dataset, turned into findings rows.

Input frames hold a `dataset` column and raw columns, as text or typed. Two rule sets are offered: `findings`
collects every error and warning, `first_failure` stops at the first broken rule. Raw data may repeat a day or a
source any number of times, so every rule is an aggregate that combines before its shuffle; no window ever
spans raw rows.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.columns import ratio
from barline.operators.quantiles import at_fractions, by_size, exact_quantiles, known_values, quantiles_of_counts, value_counts
from barline.sources.scratch import stage

REQUIRED = ("date", "open", "high", "low", "close")
OPTIONAL = ("volume", "market_cap")
PRICES = ("open", "high", "low", "close")
STRICT_ORDER = ("high", "low", "open", "close")
STRUCTURE = {  # name -> (left, right): a row is inconsistent when left < right
    "high_below_low": ("high", "low"),
    "high_below_open": ("high", "open"),
    "high_below_close": ("high", "close"),
    "open_below_low": ("open", "low"),
    "close_below_low": ("close", "low"),
}
MIN_YEARS = 2
BOUND_FRACTIONS = (0.01, 0.25, 0.75, 0.99)
BESIDE = ("dataset", "_rank")  # columns of a raw frame that say where a row is from


def _plain(name: str) -> str:
    return name.lower().replace(" ", "_")


def missing_columns(raw: DataFrame, required=REQUIRED) -> list[str]:
    have = {_plain(c) for c in raw.columns}
    return [c for c in required if c not in have]


def unexpected_columns(raw: DataFrame) -> list[str]:
    expected = {*REQUIRED, *OPTIONAL, *BESIDE}
    return [c for c in raw.columns if _plain(c) not in expected]


def _typed(raw: DataFrame) -> DataFrame:
    """Lower-case names; per known column the source (`x__raw`) and its cast, NULL where the cast fails."""
    out = [F.col("dataset")]
    for c in raw.columns:
        name = _plain(c)
        if name in BESIDE:
            continue
        source = F.col(f"`{c}`")
        if name == "date":
            cast = source.try_cast("date")
        elif name in (*PRICES, *OPTIONAL):
            cast = source.try_cast("double")
            cast = F.when(~F.isnan(cast), cast)
        else:
            cast = source
        text = source.cast("string")
        out += [F.when(~text.isin("", "NaN", "nan"), text).alias(f"{name}__raw"), cast.alias(name)]
    return raw.select(*out)


def columns_of(raw: DataFrame) -> list[str]:
    return [_plain(c) for c in raw.columns if _plain(c) not in BESIDE]


def _flags(raw: DataFrame) -> dict[str, Column]:
    """What a row of typed columns is counted for, by name."""
    have, out = columns_of(raw), {}
    for c in have:
        out[f"{c}__missing"] = F.col(f"{c}__raw").isNull()
        if c in (*REQUIRED, *OPTIONAL):
            out[f"{c}__uncastable"] = F.col(f"{c}__raw").isNotNull() & F.col(c).isNull()
    for c in PRICES:
        if c in have:
            out |= {f"{c}__negative": F.col(c) < 0, f"{c}__zero": F.col(c) == 0}
    if not missing_columns(raw, PRICES):
        broken = {name: F.coalesce(F.col(a) < F.col(b), F.lit(False)) for name, (a, b) in STRUCTURE.items()}
        out |= broken
        out["inconsistent"] = reduce(or_, broken.values())
    return {n: F.coalesce(f, F.lit(False)) for n, f in out.items()}


def profile(raw: DataFrame) -> DataFrame:
    """Per dataset, in one aggregate: rows, missing / uncastable / negative / zero counts, broken price relations,
    first and last day, span, repeated days."""
    aggs = [F.count("*").alias("rows"), *[F.count_if(f).alias(n) for n, f in _flags(raw).items()]]
    if "date" in columns_of(raw):
        empty_days = (F.count_if(F.col("date").isNull()) > 0).cast("bigint")
        aggs += [
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
            F.datediff(F.max("date"), F.min("date")).alias("span_days"),
            (F.count("*") - F.count_distinct("date") - empty_days).alias("duplicates"),
        ]
    return _typed(raw).groupBy("dataset").agg(*aggs)


def profile_of_scan(raw: DataFrame, seen: DataFrame) -> DataFrame:
    """As profile, and the gaps, from the rows of one_scan. Days are counted before they are put in order, so that part is bounded by the calendar."""
    aggs = [F.count("*").alias("rows"), *[F.count_if(n).alias(n) for n in _flags(raw)]]
    if "date" not in columns_of(raw):
        return seen.groupBy("dataset").agg(*aggs)
    facts = seen.groupBy("dataset").agg(
        *aggs, F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.datediff(F.max("day"), F.min("day")).alias("span_days"),
        F.greatest(F.count_if(F.col("day").isNull()) - 1, F.lit(0)).alias("dayless"))  # rows without a day are one row, as one more day
    held = seen.where(F.col("day").isNotNull()).groupBy("dataset", F.col("day").alias("date")).agg(F.count("*").alias("held"))
    steps = _gaps(_steps(held)).withColumnRenamed("dataset", "_of")
    return facts.join(steps, F.col("dataset").eqNullSafe(F.col("_of")), "left").withColumn(
        "duplicates", F.col("dayless") + F.coalesce("repeated", F.lit(0))).drop("_of", "dayless", "repeated")


def dataset_info(raw: DataFrame) -> DataFrame:
    """Rows, columns, column names and covered period of each dataset."""
    names = [c for c in raw.columns if c not in BESIDE]
    return profile(raw).select(
        "dataset", "rows", F.lit(len(names)).alias("columns"), F.lit(",".join(names)).alias("column_names"),
        "first_date", "last_date", "span_days", (F.col("span_days") / 365.25).alias("span_years"),
    )


def day_steps(raw: DataFrame) -> DataFrame:
    """(dataset, step, times): how often consecutive rows in date order lie `step` days apart.

    Works on one row per day (repeats of a day are steps of 0), so the ordered part is bounded by the calendar.
    """
    days = _typed(raw.select("dataset", *[c for c in raw.columns if _plain(c) == "date"]))
    return _steps(days.where(F.col("date").isNotNull()).groupBy("dataset", "date").agg(F.count("*").alias("held")))


def _steps(days: DataFrame) -> DataFrame:
    """Steps from dataset, date, held (rows of the day)."""
    series = Window.partitionBy("dataset").orderBy("date")
    steps = days.withColumn("step", F.datediff("date", F.lag("date").over(series)))
    both = F.array(
        F.struct(F.col("step"), F.lit(1).cast("bigint").alias("times")),
        F.struct(F.lit(0).alias("step"), (F.col("held") - 1).alias("times")),
    )
    return (
        steps.select("dataset", F.inline(both))
        .where(F.col("step").isNotNull() & (F.col("times") > 0))
        .groupBy("dataset", "step").agg(F.sum("times").alias("times"))
    )


def usual_step(steps: DataFrame) -> DataFrame:
    """Most frequent step per dataset, the smallest one on a tie."""
    pick = F.max_by("step", F.struct(F.col("times"), -F.col("step")))
    return steps.groupBy("dataset").agg(pick.alias("usual_step"))


def large_gaps(raw: DataFrame) -> DataFrame:
    """Per dataset the usual step and the number of steps longer than twice of it.

    Ranks the distinct step lengths of a dataset (a handful), so the rows are scanned once.
    """
    return _gaps(day_steps(raw)).drop("repeated")


def _gaps(steps: DataFrame) -> DataFrame:
    ranked = Window.partitionBy("dataset").orderBy(F.desc("times"), "step")
    steps = steps.withColumn("usual_step", F.first("step").over(ranked))
    wide = F.col("step") > 2 * F.col("usual_step")
    return steps.groupBy("dataset", "usual_step").agg(
        F.sum(F.when(wide, F.col("times")).otherwise(0)).alias("gaps"), F.sum(F.when(F.col("step") == 0, F.col("times")).otherwise(0)).alias("repeated")
    )


def _bounds(quantiles: DataFrame) -> DataFrame:
    """dataset, column, low, high: q01 - 3 IQR and q99 + 3 IQR."""
    def q(p: float) -> Column:
        return F.max(F.when(F.col("fraction") == p, F.col("quantile")))

    iqr = q(0.75) - q(0.25)
    return quantiles.groupBy("dataset", "column").agg((q(0.01) - 3 * iqr).alias("low"), (q(0.99) + 3 * iqr).alias("high"))


def outlier_bounds(raw: DataFrame) -> DataFrame:
    """Per dataset and price column q01 - 3 IQR and q99 + 3 IQR, from exact quantiles."""
    return _bounds(exact_quantiles(_typed(raw), "dataset", PRICES, BOUND_FRACTIONS))


def outliers_of_counts(counts: DataFrame) -> DataFrame:
    """(dataset, <price>__outliers ...) from dataset, column, value, held: values outside the bounds."""
    bounds = _bounds(quantiles_of_counts(counts, "dataset", BOUND_FRACTIONS))
    outside = (F.col("value") > F.col("high")) | (F.col("value") < F.col("low"))
    rows = counts.join(bounds, ["dataset", "column"])
    return rows.groupBy("dataset").agg(*[
        F.sum(F.when((F.col("column") == c) & outside, F.col("held")).otherwise(0)).alias(f"{c}__outliers") for c in PRICES])


def _outliers_of_few(own: pa.Table) -> pa.Table:
    """outliers_of_counts of one dataset that a task may sort."""
    fractions, out, known = np.array(BOUND_FRACTIONS), {}, 0
    for c in PRICES:
        values = known_values(own.column(c))
        known += len(values)
        q01, q25, q75, q99 = at_fractions(values, fractions) if len(values) else np.zeros(4)
        with np.errstate(invalid="ignore"):
            low, high = q01 - 3 * (q75 - q25), q99 + 3 * (q75 - q25)
        # as in SQL, every number is less than a bound that is none
        out[f"{c}__outliers"] = [int(((values > high) | (values < low) | np.isnan(low)).sum())]
    return pa.table({"dataset": own.column("dataset").slice(0, 1), **out}).slice(0, min(known, 1))


def _outliers(rows: DataFrame) -> DataFrame:
    few, many = by_size(rows.select("dataset", *PRICES), "dataset")
    schema = T.StructType([few.schema["dataset"], *[T.StructField(f"{c}__outliers", T.LongType()) for c in PRICES]])
    out = few.groupBy("dataset").applyInArrow(_outliers_of_few, schema)
    return out if many is None else out.unionByName(outliers_of_counts(stage(value_counts(many, "dataset", PRICES), "value-counts")))


def outlier_counts(raw: DataFrame) -> DataFrame:
    """(dataset, <price>__outliers ...): values outside the bounds. Reads raw twice: sizes of datasets first."""
    return _outliers(_typed(raw))


def one_scan(raw: DataFrame) -> DataFrame:
    """What all rules need of a row, from one pass over the raw rows: dataset, day, prices, and for each count of a profile whether the row is counted.
    Nothing is shuffled; each rule reads its few columns of this table."""
    day = F.col("date") if "date" in columns_of(raw) else F.lit(None).cast("date")
    prices = [c for c in PRICES if c in columns_of(raw)]
    return stage(_typed(raw).select("dataset", day.alias("day"), *prices, *[f.alias(n) for n, f in _flags(raw).items()]), "one-scan")


def _finding(check: str, column: str, severity: Column, n: Column, message: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"), F.lit(column).alias("column"), severity.alias("severity"),
        n.cast("bigint").alias("n"), message.alias("message"),
    )


def _text(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *args)


def findings(
    raw: DataFrame, min_years: float = MIN_YEARS, expected: DataFrame | None = None, headers: DataFrame | None = None,
    checks: Collection[str] | None = None,
) -> DataFrame:
    """dataset, check, column, severity (error / warning), n, message of every broken or reported rule.

    `expected` lists datasets that should be there; those without rows are reported as empty. `headers` (dataset, columns) says which columns each
    dataset has; without it all have those of the frame. A rule about a column is asked of the datasets that have it.
    `checks` names the rules that are asked for (all without it): what headers say of columns needs no scan of the rows.
    """
    if checks is not None:
        if headers is not None and set(checks) <= {"columns"}:
            return header_findings(headers).where(F.col("check").isin(*checks))
        return findings(raw, min_years, expected, headers).where(F.col("check").isin(*checks))
    have = columns_of(raw)
    seen = one_scan(raw)
    facts = profile_of_scan(raw, seen)
    if not missing_columns(raw, PRICES):
        facts = facts.join(_outliers(seen), "dataset", "left")

    def count_rule(check: str, column: str, fact: str, severity: str, text: str) -> Column:
        n = F.col(fact)
        return _finding(check, column, F.when(n > 0, F.lit(severity)), n, _text(text, n))

    rules = []
    if headers is None:
        for c in missing_columns(raw):
            rules.append(_finding("columns", c, F.lit("error"), F.lit(1), F.lit(f"Missing required column: {c}")))
        for c in unexpected_columns(raw):
            rules.append(_finding("columns", c, F.lit("warning"), F.lit(1), F.lit(f"Unexpected column: {c}")))
    for c in have:
        if c in REQUIRED:
            rules.append(count_rule("type", c, f"{c}__uncastable", "error", f"Column '{c}': %d values of a wrong type"))
        elif c in OPTIONAL:
            rules.append(count_rule("type", c, f"{c}__uncastable", "warning", f"Optional column '{c}': %d values of a wrong type"))
    for c in REQUIRED:
        if c in have:
            n = F.col(f"{c}__missing")
            pct = n / F.col("rows") * 100
            severity = F.when(pct > 10, "error").when(n > 0, "warning")
            rules.append(_finding("missing", c, severity, n, _text(f"Column '{c}': %.1f%% missing (%d of %d)", pct, n, F.col("rows"))))
    if "date" in have:
        usable = F.col("date__uncastable") == 0
        n = F.col("duplicates")
        rules.append(_finding("duplicates", "date", F.when(usable & (n > 0), "error"), n, _text("%d repeated dates", n)))
        rules.append(_finding(
            "date_range", "date", F.when(usable & F.col("span_days").isNotNull(), "warning"), F.col("span_days"),
            _text("%s to %s (%d days)", F.col("first_date").cast("string"), F.col("last_date").cast("string"), F.col("span_days")),
        ))
        rules.append(_finding(
            "gaps", "date", F.when(usable & (F.col("gaps") > 0), "warning"), F.col("gaps"), _text("%d potential gaps", F.col("gaps")),
        ))
        years = F.col("span_days") / 365.25
        rules.append(_finding(
            "length", "date",
            F.when(~usable | (years < min_years), "error").when(years >= min_years, "warning"), F.col("span_days"),
            _text("%.1f years of data, at least %.1f required", years, F.lit(float(min_years))),
        ))
        rules.append(_finding(
            "dates_unusable", "date", F.when(~usable, "error"), F.col("date__uncastable"), F.lit("Dates could not be checked"),
        ))
    for c in PRICES:
        if c in have:
            rules.append(count_rule("negative", c, f"{c}__negative", "error", f"Column '{c}': %d negative values"))
            rules.append(count_rule("zero", c, f"{c}__zero", "warning", f"Column '{c}': %d zero values"))
    if not missing_columns(raw, PRICES):
        for c in PRICES:
            rules.append(count_rule("outliers", c, f"{c}__outliers", "warning", f"Column '{c}': %d potential outliers"))
        for name, (a, b) in STRUCTURE.items():
            rules.append(count_rule(name, a, name, "error", f"%d rows with {a} < {b}"))

    rules = rules or [_finding("none", "", F.lit(None).cast("string"), F.lit(0), F.lit(""))]
    if headers is None:
        found = facts.select("dataset", F.inline(F.array(*rules))).where(F.col("severity").isNotNull())
    else:
        found = facts.join(headers, "dataset").select("dataset", "columns", F.inline(F.array(*rules))).where(
            F.col("severity").isNotNull() & F.expr("array_contains(columns, `column`)")).drop("columns").unionByName(header_findings(headers))
    if expected is not None:
        empty = expected.select("dataset").distinct().join(seen.select("dataset").distinct(), "dataset", "left_anti")
        found = found.unionByName(empty.select(
            "dataset", F.lit("empty").alias("check"), F.lit("").alias("column"), F.lit("error").alias("severity"),
            F.lit(0).cast("bigint").alias("n"), F.lit("Dataset is empty").alias("message"),
        ))
    return found


def header_findings(headers: DataFrame) -> DataFrame:
    """Missing and unexpected columns of each dataset, from its own header."""
    known = F.array(*[F.lit(c) for c in (*REQUIRED, *OPTIONAL)])
    both = F.concat(
        F.transform(F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), "columns"), lambda c: F.struct(
            c.alias("column"), F.lit("error").alias("severity"), F.concat(F.lit("Missing required column: "), c).alias("message"))),
        F.transform(F.array_except("columns", known), lambda c: F.struct(
            c.alias("column"), F.lit("warning").alias("severity"), F.concat(F.lit("Unexpected column: "), c).alias("message"))))
    return headers.select("dataset", F.explode(both).alias("f")).select(
        "dataset", F.lit("columns").alias("check"), "f.column", "f.severity", F.lit(1).cast("bigint").alias("n"), "f.message")


def verdicts(raw: DataFrame, found: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(dataset, errors, warnings, is_valid) for every dataset, also those without any finding."""
    datasets = (raw if expected is None else expected).select("dataset").distinct()
    counts = found.groupBy("dataset").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    zero = F.lit(0).cast("bigint")
    return datasets.join(counts, "dataset", "left").select(
        "dataset", F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"),
        (F.coalesce("errors", zero) == 0).alias("is_valid"),
    )


def totals(verdict: DataFrame) -> DataFrame:
    return verdict.agg(
        F.count("*").alias("datasets"), F.count_if("is_valid").alias("passed"), F.count_if(~F.col("is_valid")).alias("failed")
    )


def first_failure(raw: DataFrame, min_years: float = MIN_YEARS) -> DataFrame:
    """Fail-fast rule set: (dataset, passed, failed_check, failed_column, n), the first broken rule in order.

    Order: structure, types, per price column negative then missing, length, more than 5 % missing in any
    column, inconsistent prices.
    """
    gone = missing_columns(raw)
    facts = profile(raw)
    rules: list[Column] = []

    def rule(check: str, column: str, broken: Column, n: Column) -> None:
        rules.append(F.when(broken, F.struct(
            F.lit(check).alias("failed_check"), F.lit(column).alias("failed_column"), n.cast("bigint").alias("n"))))

    if gone:
        rule("columns", ",".join(gone), F.lit(True), F.lit(len(gone)))
    else:
        for c in ("date", *STRICT_ORDER):
            rule("type", c, F.col(f"{c}__uncastable") > 0, F.col(f"{c}__uncastable"))
        for c in STRICT_ORDER:
            rule("negative", c, F.col(f"{c}__negative") > 0, F.col(f"{c}__negative"))
            rule("missing", c, F.col(f"{c}__missing") > 0, F.col(f"{c}__missing"))
        rule("length", "date", F.coalesce(F.col("span_days") < min_years * 365, F.lit(True)), F.col("span_days"))
        for c in columns_of(raw):
            rule("completeness", c, ratio(F.col(f"{c}__missing") * 100, "rows") > 5, F.col(f"{c}__missing"))
        rule("prices", "", F.col("inconsistent") > 0, F.col("inconsistent"))
    first = F.coalesce(*rules)
    return facts.select("dataset", first.isNull().alias("passed"), first.alias("first")).select(
        "dataset", "passed", "first.failed_check", "first.failed_column", "first.n"
    )


def completeness(raw: DataFrame) -> DataFrame:
    """(dataset, column, missing, pct, severity) over every column: more than 5 % is an error, more than 0 a warning."""
    facts = profile(raw)
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"{c}__missing").alias("missing"),
            (F.col(f"{c}__missing") / F.col("rows") * 100).alias("pct"),
        ) for c in columns_of(raw)
    ]
    severity = F.when(F.col("pct") > 5, "error").when(F.col("pct") > 0, "warning").otherwise("ok")
    return facts.select("dataset", F.inline(F.array(*cells))).withColumn("severity", severity)


def inconsistent_rows(raw: DataFrame) -> DataFrame:
    """Rows that break a price relation, with the first relation they break."""
    broken = F.coalesce(*[
        F.when(F.col(a) < F.col(b), F.lit(name)) for name, (a, b) in STRUCTURE.items()
    ])
    return _typed(raw).select("dataset", "date", *PRICES, broken.alias("relation")).where(F.col("relation").isNotNull())


def structurally_valid(raw: DataFrame) -> DataFrame:
    """Datasets with rows and all required columns."""
    found = raw.select("dataset").distinct()
    return found if not missing_columns(raw) else found.limit(0)


def quality_gate(raw: DataFrame, min_years: float = MIN_YEARS) -> DataFrame:
    """Rows of datasets that pass structure, quality (no negative or missing price) and length."""
    gone = missing_columns(raw)
    if gone:
        raise ValueError(f"Missing required columns: {gone}")
    ok = F.col("span_days") >= min_years * 365
    for c in PRICES:
        ok = ok & (F.col(f"{c}__negative") == 0) & (F.col(f"{c}__missing") == 0)
    return raw.join(profile(raw).where(ok).select("dataset"), "dataset", "left_semi")
