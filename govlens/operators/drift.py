"""Schema drift between versions, and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from govlens.operators.profile import canonical
from govlens.operators.quality import missing

# The types that each type may become without breaking readers.
COMPATIBLE = {
    "int": ["int", "bigint", "float", "double", "string"],
    "bigint": ["bigint", "float", "double", "string"],
    "float": ["float", "double", "string"],
    "double": ["double", "string"],
    "string": ["string"],
    "boolean": ["boolean", "string", "int"],
    "date": ["date", "datetime", "timestamp", "string"],
    "datetime": ["datetime", "timestamp", "string"],
    "timestamp": ["timestamp", "string"],
}


def normal_type(c: Column) -> Column:
    t = F.lower(c)
    return (
        F.when(t.contains("int") & t.contains("big"), "bigint").when(t.contains("int"), "int").when(t.contains("float") | t.contains("double"), "float").when(t.contains("bool"), "boolean")
        .when(t.contains("timestamp"), "timestamp").when(t.contains("datetime"), "datetime").when(t.contains("date"), "date")
        .when(t.contains("str") | t.contains("object") | t.contains("varchar"), "string").otherwise(t)
    )


def breaking(old: Column, new: Column) -> Column:
    """Whether a change between normalised types breaks readers; a type without entry may only stay."""
    allowed = F.create_map(*[x for k, v in COMPATIBLE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return ~F.array_contains(F.coalesce(F.try_element_at(allowed, old), F.array(old)), new)


def renames(removed: DataFrame, added: DataFrame) -> DataFrame:
    """old_name, new_name: the same type and the same position, or the same name but for case and underscores.

    One to one: by position first, then by name; an equi-join on type keeps the pairs few.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "_", "")
    o = removed.select(F.col("column_name").alias("old_name"), normal_type(F.col("type")).alias("t"), F.col("position").alias("op"))
    n = added.select(F.col("column_name").alias("new_name"), normal_type(F.col("type")).alias("t"), F.col("position").alias("np"))
    pairs = o.join(n, "t").filter((F.col("op") == F.col("np")) | (plain(F.col("old_name")) == plain(F.col("new_name"))))
    rank = lambda by: F.row_number().over(W.partitionBy(by).orderBy(F.when(F.col("op") == F.col("np"), 0).otherwise(1), "np", "op"))
    return pairs.withColumn("k", rank("old_name")).filter("k = 1").withColumn("k", rank("new_name")).filter("k = 1").select("old_name", "new_name")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """change_type, severity, column_name, old_value, new_value between two schema tables."""
    removed, added = old.join(new, "column_name", "left_anti"), new.join(old, "column_name", "left_anti")
    renamed = renames(removed, added)
    o, n = old.alias("o"), new.alias("n")
    common = o.join(n, "column_name")
    row = lambda kind, severity, name, before, after: [F.lit(kind).alias("change_type"), severity.alias("severity"), name.alias("column_name"), before.cast("string").alias("old_value"), after.cast("string").alias("new_value")]
    gone = removed.join(renamed, removed.column_name == renamed.old_name, "left_anti")
    came = added.join(renamed, added.column_name == renamed.new_name, "left_anti")
    none = F.lit(None)
    ot, nt = normal_type(F.col("o.type")), normal_type(F.col("n.type"))
    return (
        renamed.select(*row("column_renamed", F.lit("warning"), F.col("old_name"), F.col("old_name"), F.col("new_name")))
        .unionByName(gone.select(*row("column_removed", F.lit("critical"), F.col("column_name"), F.col("type"), none)))
        .unionByName(came.select(*row("column_added", F.when(F.col("nullable"), "info").otherwise("warning"), F.col("column_name"), none, F.col("type"))))
        .unionByName(common.filter(ot != nt).select(*row("type_changed", F.when(breaking(ot, nt), "critical").otherwise("warning"), F.col("column_name"), F.col("o.type"), F.col("n.type"))))
        .unionByName(common.filter("o.nullable <> n.nullable").select(*row("nullable_changed", F.when(F.col("n.nullable"), "warning").otherwise("critical"), F.col("column_name"), F.col("o.nullable"), F.col("n.nullable"))))
    )


def drift_summary(found: DataFrame) -> DataFrame:
    one = found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])
    text = (
        F.when((F.col("critical") + F.col("warning") + F.col("info")) == 0, "No schema changes detected")
        .when(F.col("critical") > 0, F.format_string("BREAKING CHANGES: %d critical, %d warnings, %d info", "critical", "warning", "info"))
        .when(F.col("warning") > 0, F.format_string("Schema changes detected: %d warnings, %d info", "warning", "info"))
        .otherwise(F.format_string("Minor schema changes: %d info-level changes", "info"))
    )
    return one.withColumn("summary", text)


def data_snapshot(df: DataFrame, table: str) -> DataFrame:
    """table_name, column_name, type, nullable (there are nulls, NaN among them), position; one scan for all columns."""
    rows = []
    for i, f in enumerate(df.schema):
        rows.append(F.struct(F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), (F.col(f"m{i}") > 0).alias("nullable"), F.lit(i).alias("position")))
    one = df.agg(*[F.count_if(missing(F.col(f"`{f.name}`"), f.dataType, blank=False)).alias(f"m{i}") for i, f in enumerate(df.schema)])
    return one.select(F.inline(F.array(*rows)))


def snapshot_statistics(history: DataFrame) -> DataFrame:
    """table_name, versions, first and last version, hashes (different ones) of the snapshots kept."""
    return history.groupBy("table_name").agg(F.count(F.lit(1)).alias("versions"), F.min("version").alias("first_version"), F.max("version").alias("last_version"), F.count_distinct("hash").alias("hashes"))


def snapshot_hash(schema: DataFrame) -> DataFrame:
    """table_name and the MD5 of its columns in order of name."""
    entry = F.concat_ws(":", "column_name", "type", F.col("nullable").cast("string"), F.col("position").cast("string"))
    return schema.groupBy("table_name").agg(F.md5(F.array_join(F.sort_array(F.collect_list(entry)), "|").cast("binary")).alias("hash"))


def next_snapshots(history: DataFrame, hashes: DataFrame) -> DataFrame:
    """table_name, version, hash of the snapshots to append: those whose latest version has another hash."""
    last = history.groupBy("table_name").agg(F.max_by("hash", "version").alias("known"), F.max("version").alias("v"))
    return hashes.join(last, "table_name", "left").filter(~F.col("hash").eqNullSafe(F.col("known"))).select("table_name", (F.coalesce("v", F.lit(0)) + 1).alias("version"), "hash")


def newest(history: DataFrame, n: int = 10) -> DataFrame:
    return history.withColumn("k", F.row_number().over(W.partitionBy("table_name").orderBy(F.desc("version")))).filter(F.col("k") <= n).drop("k")


def contract_findings(df: DataFrame, fields: list[dict], rules: list[dict]) -> DataFrame:
    """level, code, column_name, share of what a table lacks of its contract; one scan for all fields and rules.

    fields: name, type, required, and min, max, regex; rules: name, type (not_null, unique, range, regex, allowed_values), column, severity, and their
    limits. A null fails regex and allowed_values, is one value for unique and passes range.
    """
    kinds = {f.name: canonical(f.dataType) for f in df.schema}
    aggs, rows, fixed = [], [], []

    def found(level: str, code: str, column: str, share: Column, limit: float = 0.0) -> None:
        name = f"x{len(aggs)}"
        aggs.append(share.alias(name))
        rows.append(F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(column).alias("column_name"), F.coalesce(F.col(name), F.lit(0.0)).alias("share"), F.lit(float(limit)).alias("lim")))

    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    for f in fields:
        name = f["name"]
        if name not in kinds:
            fixed.append(("error", "missing_column", name, 1.0))
            continue
        c = F.col(name)
        if f["type"] != kinds[name]:
            fixed.append(("error", "type_mismatch", name, 1.0))
        if f.get("required"):
            found("error", "required_null", name, rate(c.isNull()))
        if "min" in f:
            found("warning", "below_min", name, rate(c < f["min"]))
        if "max" in f:
            found("warning", "above_max", name, rate(c > f["max"]))
        if "regex" in f:
            found("warning", "regex", name, rate(~c.cast("string").rlike(f["regex"])))
    for r in rules:
        name, level = r["column"], "error" if r.get("severity") == "critical" else "warning"
        if name not in kinds:
            fixed.append((level, "missing_rule_column", name, 1.0))
            continue
        c = F.col(name)
        if r["type"] == "not_null":
            found(level, r["name"], name, rate(c.isNull()), r.get("max_null_pct", 0.0))
        elif r["type"] == "unique":
            found(level, r["name"], name, 1 - (F.countDistinct(c) + F.max(c.isNull().cast("int"))) / F.count(F.lit(1)), r.get("max_duplicate_pct", 0.0))
        elif r["type"] == "range":
            found(level, r["name"], name, rate((c < r["min"]) | (c > r["max"])))
        elif r["type"] == "regex":
            found(level, r["name"], name, F.avg((~F.coalesce(c.cast("string").rlike(r["regex"]), F.lit(False))).cast("int")))
        elif r["type"] == "allowed_values":
            found(level, r["name"], name, F.avg((~F.coalesce(c.cast("string").isin(r["values"]), F.lit(False))).cast("int")))
    spark = df.sparkSession
    out = spark.createDataFrame(fixed, "level string, code string, column_name string, share double")
    if aggs:
        out = out.unionByName(df.agg(*aggs).select(F.inline(F.array(*rows))).filter("share > lim").drop("lim"))
    return out


def verdict(findings: DataFrame) -> DataFrame:
    one = findings.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return one.withColumn("status", F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "warning").otherwise("passed"))
