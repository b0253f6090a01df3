"""Quality dimensions of a table: completeness, uniqueness, validity, consistency, freshness; rules and alerts.

Metrics of one table are planned as one aggregate, so that a table is scanned once however many columns and checks there are; the
row of results is turned into one row per metric with an inline table. Only key-wise checks (duplicates, references) shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# The named validity patterns.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone_br": r"^[\+]?[(]?[0-9]{2,3}[)]?[-\s\.]?[0-9]{4,5}[-\s\.]?[0-9]{4}$",
    "cpf": r"^\d{3}\.?\d{3}\.?\d{3}-?\d{2}$",
    "cnpj": r"^\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}$",
    "cep": r"^\d{5}-?\d{3}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "date_br": r"^\d{2}/\d{2}/\d{4}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "url": r"^https?://[^\s]+$",
    "integer": r"^-?\d+$",
    "decimal": r"^-?\d+\.?\d*$",
    "boolean": r"^(true|false|0|1|yes|no|sim|não)$",
}


def stripped(c: Column) -> Column:
    """The text without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def missing(c: Column, dtype: T.DataType, blank: bool = True) -> Column:
    """Null, NaN, or (if ``blank``) a text of white space alone."""
    out = c.isNull()
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        out = out | F.isnan(c)
    if blank and isinstance(dtype, T.StringType):
        out = out | (stripped(c) == "")
    return F.coalesce(out, F.lit(True))


def status(value: Column, threshold: float, slack: float) -> Column:
    return F.when(value >= threshold, "passed").when(value >= threshold * slack, "warning").otherwise("failed")


def _unpivot(one: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """The structs of a single row as rows."""
    return one.select(F.inline(F.array(*rows)))


def completeness(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.95, blank: bool = True, required: Sequence[str] = ()) -> DataFrame:
    """column_name, total_rows, null_count, completeness, status: a row per column and one, named ``*``, for all cells."""
    aggs, rows = _complete(df, list(columns or df.columns), threshold, blank, required)
    return _unpivot(df.agg(*aggs), rows)


def _complete(df: DataFrame, columns: Sequence[str], threshold: float = 0.95, blank: bool = True, required: Sequence[str] = ()) -> tuple[list[Column], list[Column]]:
    kinds = {f.name: f.dataType for f in df.schema}
    aggs = [F.count(F.lit(1)).alias("n"), *[F.count_if(missing(F.col(c), kinds[c], blank)).alias(f"m{i}") for i, c in enumerate(columns)]]

    def row(name: str, cells: Column, nulls: Column) -> Column:
        value = F.when(cells > 0, 1 - nulls / cells).otherwise(F.lit(1.0))
        lacks = nulls > 0 if name in required else F.lit(False)
        if name == "*" and required:
            lacks = F.greatest(*[F.col(f"m{columns.index(c)}") for c in required], F.lit(0)) > 0
        state = F.when(lacks, "failed").otherwise(status(value, threshold, 0.9))
        return F.struct(F.lit(name).alias("column_name"), cells.cast("long").alias("total_rows"), nulls.cast("long").alias("null_count"), value.alias("completeness"), state.alias("status"))

    each = [row(c, F.col("n"), F.col(f"m{i}")) for i, c in enumerate(columns)]
    total = sum((F.col(f"m{i}") for i in range(len(columns))), F.lit(0))
    return aggs, [*each, row("*", F.col("n") * len(columns), total)]


def worst_columns(metrics: DataFrame, n: int = 5) -> DataFrame:
    return metrics.filter("column_name <> '*'").orderBy("completeness", "column_name").limit(n)


def uniqueness(df: DataFrame, column: str | None = None, key: Sequence[str] = (), case_sensitive: bool = True, threshold: float = 1.0, ignore_nulls: bool = False) -> DataFrame:
    """total_rows, distinct_count, duplicate_count, uniqueness, status of a column, a key (null is a value), or whole rows.

    Distinct values are counted by grouping, so that the keys spread over tasks; equal keys are summed up before they move.
    """
    if column is not None:
        value = F.col(column).cast("string")
        value = value if case_sensitive else F.lower(value)
        grouped = df.groupBy(value.alias("k")).count()
        distinct = F.count("k")
        rows = F.sum(F.when(F.col("k").isNotNull(), F.col("count"))) if ignore_nulls else F.sum("count")
        extra = F.sum(F.when(F.col("k").isNotNull(), F.col("count") - 1))
    else:
        grouped = df.groupBy(*(key or df.columns)).count()
        distinct, rows, extra = F.count(F.lit(1)), F.sum("count"), F.sum(F.col("count") - 1)
    one = grouped.agg(F.coalesce(rows, F.lit(0)).alias("total_rows"), distinct.alias("distinct_count"), F.coalesce(extra, F.lit(0)).alias("duplicate_count"))
    value = F.when(F.col("total_rows") > 0, F.col("distinct_count") / F.col("total_rows")).otherwise(F.lit(1.0))
    return one.select("*", value.alias("uniqueness"), status(value, threshold, 0.95).alias("status"))


def duplicates(df: DataFrame, key: Sequence[str], n: int = 10) -> DataFrame:
    """The n largest groups of rows with the same key, ties by key."""
    return df.groupBy(*key).count().filter("count > 1").orderBy(F.desc("count"), *key).limit(n)


def invalid_reason(c: Column, pattern: str | None = None, low: float | None = None, high: float | None = None, allowed: Sequence | None = None) -> Column:
    """The first check that a present value fails, else null."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    if pattern is not None:
        out = out.when(~stripped(c.cast("string")).rlike("(?i)" + pattern), "pattern")
    if low is not None or high is not None:
        number = c.try_cast("double")
        out = out.when(number.isNull(), "not_numeric")
        if low is not None:
            out = out.when(number < low, "below_min")
        if high is not None:
            out = out.when(number > high, "above_max")
    if allowed is not None:
        out = out.when(~c.cast("string").isin([str(a) for a in allowed]), "not_allowed")
    return out


def validity(df: DataFrame, checks: Iterable[tuple[str, dict]], threshold: float = 0.95) -> DataFrame:
    """column_name, checked, valid, validity, status, and counts by reason for each (column, arguments of invalid_reason)."""
    aggs, rows = _valid(list(checks), threshold)
    return _unpivot(df.agg(*aggs), rows)


def _valid(checks: Sequence[tuple[str, dict]], threshold: float = 0.95) -> tuple[list[Column], list[Column]]:
    reasons = ("pattern", "not_numeric", "below_min", "above_max", "not_allowed")
    aggs = []
    for i, (c, how) in enumerate(checks):
        why = invalid_reason(F.col(c), **how)
        aggs += [F.count(c).alias(f"n{i}"), *[F.count_if(why == r).alias(f"r{i}_{r}") for r in reasons]]
    rows = []
    for i, (c, _) in enumerate(checks):
        bad = sum((F.col(f"r{i}_{r}") for r in reasons), F.lit(0))
        good = F.col(f"n{i}") - bad
        value = F.when(F.col(f"n{i}") > 0, good / F.col(f"n{i}")).otherwise(F.lit(1.0))
        rows.append(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("checked"), good.cast("long").alias("valid"), value.alias("validity"), status(value, threshold, 0.9).alias("status"), *[F.col(f"r{i}_{r}").alias(r) for r in reasons]))
    return aggs, rows


def invalid_samples(df: DataFrame, column: str, key: str, n: int = 10, **how) -> DataFrame:
    """The first n invalid values by key, cut to 50 characters."""
    bad = df.select(key, F.substring(F.col(column).cast("string"), 1, 50).alias("value"), invalid_reason(F.col(column), **how).alias("reason"))
    return bad.filter("reason is not null").orderBy(key).limit(n)


def not_null_if(df: DataFrame, condition: Column, column: str) -> DataFrame:
    """applicable, violations, consistency of "where the condition holds, the column is present"."""
    one = df.agg(F.count_if(condition).alias("applicable"), F.count_if(condition & F.col(column).isNull()).alias("violations"))
    return one.withColumn("consistency", F.when(F.col("applicable") > 0, 1 - F.col("violations") / F.col("applicable")).otherwise(F.lit(1.0)))


def equals_if(df: DataFrame, condition: Column, left: str, right: str) -> DataFrame:
    """As not_null_if for "left equals right"; two nulls are equal."""
    one = df.agg(F.count_if(condition).alias("applicable"), F.count_if(condition & ~F.col(left).eqNullSafe(F.col(right))).alias("violations"))
    return one.withColumn("consistency", F.when(F.col("applicable") > 0, 1 - F.col("violations") / F.col("applicable")).otherwise(F.lit(1.0)))


def referential(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """applicable, violations, consistency of child values, compared as text, in the parent's keys; nulls are passed over.

    The child is summed up by value first: what is joined are distinct values, and a hot one is a single row.
    """
    values = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("k")).count()
    keys = parent.select(F.col(key).cast("string").alias("k"), F.lit(True).alias("there")).distinct()
    joined = values.join(keys, "k", "left")
    one = joined.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("applicable"), F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("count"))), F.lit(0)).alias("violations"))
    return one.withColumn("consistency", F.when(F.col("applicable") > 0, 1 - F.col("violations") / F.col("applicable")).otherwise(F.lit(1.0)))


def parse_timestamp(c: Column, fmt: str | None = None) -> Column:
    """A text as a timestamp: in the given form, as a date, ISO, with fractions."""
    forms = [*([fmt] if fmt else []), "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSSSSS"]
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in forms])


def freshness(df: DataFrame, column: str, reference: str, max_age_hours: float = 24, sla_hours: float | None = None, threshold: float = 0.9) -> DataFrame:
    """rows, latest, oldest, age_hours, freshness, sla_met, stale_share, status against a reference time.

    The score is 1 up to the SLA, falls to 0 at twice the SLA, and just beyond stands at half, falling to 0 at four times.
    """
    aggs, row = _fresh(column, reference, max_age_hours, sla_hours, threshold)
    return df.agg(*aggs).select(row.alias("r")).select("r.*")


def _fresh(column: str, reference: str, max_age_hours: float = 24, sla_hours: float | None = None, threshold: float = 0.9) -> tuple[list[Column], Column]:
    sla = float(sla_hours or max_age_hours)
    now = F.lit(reference).cast("timestamp")
    hours = lambda c: (F.unix_micros(now) - F.unix_micros(c)) / 3.6e9
    ts = F.col(column).cast("timestamp")
    aggs = [F.count(ts).alias("rows"), F.max(ts).alias("latest"), F.min(ts).alias("oldest"), F.count_if(hours(ts) > max_age_hours).alias("stale")]
    age = hours(F.col("latest"))
    score = F.when(age <= sla, 1.0).when(age <= 2 * sla, 1 - (age - sla) / sla).otherwise(F.greatest(F.lit(0.0), 1 - age / (4 * sla)))
    state = F.when(F.col("latest").isNull(), "skipped").when((age <= sla) & (score >= threshold), "passed").when(age <= 1.5 * sla, "warning").otherwise("failed")
    stale = F.when(F.col("rows") > 0, F.col("stale") / F.col("rows"))
    return aggs, F.struct(F.col("rows"), F.col("latest"), F.col("oldest"), age.alias("age_hours"), F.when(age.isNotNull(), score).alias("freshness"), (age <= sla).alias("sla_met"), stale.alias("stale_share"), state.alias("status"))


METRIC = "dimension string, column_name string, value double, threshold double, status string"


def report(parts: Sequence[DataFrame]) -> DataFrame:
    """Metric rows of all dimensions as one table, numbered in order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def as_metric(df: DataFrame, dimension: str, column: str | None, value: str, threshold: float) -> DataFrame:
    name = F.col("column_name") if "column_name" in df.columns else F.lit(column)
    return df.select(F.lit(dimension).alias("dimension"), name.alias("column_name"), F.col(value).cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"), F.col("status"))


def _rank(c: Column) -> Column:
    return F.when(c == "failed", 3).when(c == "warning", 2).when(c == "passed", 1).otherwise(0)


def dimension_scores(metrics: DataFrame) -> DataFrame:
    """dimension, checks, score (mean without skipped), worst status."""
    worst = F.max(F.struct(_rank(F.col("status")).alias("r"), F.col("status").alias("s")))
    return metrics.groupBy("dimension").agg(F.count(F.lit(1)).alias("checks"), F.avg(F.when(F.col("status") != "skipped", F.col("value"))).alias("score"), worst["s"].alias("worst_status"))


def summary(metrics: DataFrame) -> DataFrame:
    """checks, passed, warning, failed, skipped, score and the worst status of all."""
    worst = F.max(F.struct(_rank(F.col("status")).alias("r"), F.col("status").alias("s")))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("passed", "warning", "failed", "skipped")]
    return metrics.agg(F.count(F.lit(1)).alias("checks"), *counts, F.avg(F.when(F.col("status") != "skipped", F.col("value"))).alias("score"), worst["s"].alias("worst_status"))


def overall_status(metrics: DataFrame, alerts: DataFrame, breaking_changes: int = 0) -> DataFrame:
    """critical alert, failed metric, breaking drift or warning, whichever comes first, else passed; with the mean score."""
    a = alerts.agg(F.count_if(F.col("level") == "critical").alias("critical"))
    m = summary(metrics)
    state = F.when(F.col("critical") > 0, "critical").when(F.col("failed") > 0, "failed").when(F.lit(breaking_changes) > 0, "failed").when(F.col("warning") > 0, "warning").otherwise("passed")
    return m.join(a).select("score", state.alias("overall_status"))


def alerts(rules: DataFrame, metrics: DataFrame) -> DataFrame:
    """Alerts of enabled rules whose first matching metric lies below their threshold.

    rules: rule, table_name, dimension, column_name (null: any), threshold, level, enabled; metrics: seq, dimension, column_name, value.
    The rule table is small beside the metrics and is left to Spark's own size check.
    """
    r, m = rules.filter("enabled").alias("r"), metrics.alias("m")
    same = (F.col("r.dimension") == F.col("m.dimension")) & (F.col("r.column_name").isNull() | F.col("r.column_name").eqNullSafe(F.col("m.column_name")))
    first = F.row_number().over(W.partitionBy("r.rule").orderBy("m.seq"))
    hit = r.join(m, same).withColumn("k", first).filter("k = 1 and m.value < r.threshold")
    return hit.select("r.rule", "r.table_name", "r.level", F.col("m.column_name").alias("column_name"), F.col("m.value").alias("value"), F.col("r.threshold").alias("threshold"), F.format_string("%s below threshold on %s", F.col("r.dimension"), F.col("r.table_name")).alias("message"))


def alert_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("level").count()


def default_rules(columns: DataFrame) -> DataFrame:
    """Completeness at 0.95 for every column, uniqueness at 1.0 for names with ``id`` or ending in ``_key``."""
    name = F.lower("column_name")
    base = columns.select("table_name", "column_name", F.lit("completeness").alias("dimension"), F.lit(0.95).alias("threshold"), F.lit("warning").alias("level"))
    keys = columns.filter(name.contains("id") | name.endswith("_key")).select("table_name", "column_name", F.lit("uniqueness").alias("dimension"), F.lit(1.0).alias("threshold"), F.lit("critical").alias("level"))
    return base.unionByName(keys)


def active_alerts(found: DataFrame, acknowledged: DataFrame, level: str | None = None) -> DataFrame:
    out = found.join(acknowledged.select("rule").distinct(), "rule", "left_anti")
    return out.filter(F.col("level") == level) if level else out


def evaluate(df: DataFrame, columns: Sequence[str] | None = None, unique: str | None = None, checks: Iterable[tuple[str, dict]] = (), fresh: dict | None = None, references: Sequence[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """Metric rows (METRIC) of all dimensions that are asked for, from one scan of the table.

    Completeness, validity, freshness and the different values of one column are a single aggregate: with one distinct count, values are summed up where they
    lie before they move. References need a join: the distinct values of their column alone, in a scan of that column.
    ``fresh``: arguments of freshness; references: (column, parent, key).
    """
    checks = list(checks)
    aggs, rows = _complete(df, list(columns or df.columns))
    metric = lambda dim, col, value, limit, state: F.struct(F.lit(dim).alias("dimension"), col.alias("column_name"), value.cast("double").alias("value"), F.lit(float(limit)).alias("threshold"), state.alias("status"))
    out = [metric("completeness", r["column_name"], r["completeness"], 0.95, r["status"]) for r in rows]
    if unique is not None:
        aggs.append(F.count_distinct(F.col(unique)).alias("different"))
        share = F.when(F.col("n") > 0, F.col("different") / F.col("n")).otherwise(F.lit(1.0))
        out.append(metric("uniqueness", F.lit(unique), share, 1.0, status(share, 1.0, 0.95)))
    if checks:
        more, rows = _valid(checks)
        # the aggregates of validity are named apart from those of completeness
        aggs += more
        out += [metric("validity", r["column_name"], r["validity"], 0.95, r["status"]) for r in rows]
    if fresh is not None:
        more, row = _fresh(**fresh)
        aggs += more
        out.append(metric("freshness", F.lit(fresh["column"]), F.round(row["freshness"], 6), fresh.get("threshold", 0.9), row["status"]))
    found = _unpivot(df.agg(*aggs), out)
    for column, parent, key in references:
        ref = referential(df, column, parent, key)
        found = found.unionByName(ref.select(F.lit("consistency").alias("dimension"), F.lit(column).alias("column_name"), F.col("consistency").cast("double").alias("value"), F.lit(1.0).alias("threshold"), status(F.col("consistency"), 1.0, 0.9).alias("status")))
    return found
