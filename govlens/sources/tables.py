"""Readers: the driver's tables and the formats the engine scans."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; only the columns and row groups that a query needs are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_source(spark: SparkSession, kind: str, path: str = "", **options) -> DataFrame:
    """One entry for all kinds: parquet, csv, json, orc, text, delta (where its package is there), table, jdbc."""
    if kind == "table":
        return spark.table(path)
    reader = spark.read
    if kind == "csv":
        options = {"header": True, "inferSchema": True, **options}
    for k, v in options.items():
        reader = reader.option(k, v)
    if kind == "jdbc":
        return reader.format("jdbc").load()
    return reader.format(kind).load(path)


def recent(df: DataFrame, ts: str, since: str, limit: int, key: str) -> DataFrame:
    """Rows not older than ``since``, newest first, ties by key."""
    return df.filter(F.col(ts) >= F.lit(since).cast("timestamp")).orderBy(F.desc(ts), key).limit(limit)


def schema_table(df: DataFrame, table: str) -> DataFrame:
    """table_name, column_name, type, nullable, position of a DataFrame's schema."""
    rows = [(table, f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, type string, nullable boolean, position int")


def inventory(df: DataFrame) -> DataFrame:
    """Files, bytes and rows of a scan, by folder; hive partition keys as a list."""
    files = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).groupBy("file", "bytes").count()
    folder = F.regexp_replace("file", "/[^/]*$", "")
    return files.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("count").alias("rows"), F.first(F.regexp_extract_all(folder, F.lit("([^/=]+)=[^/]*"), F.lit(1))).alias("partition_keys"))


def run_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Run events from JSON lines or a JSON array; lines that aren't JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def delta_history(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a Delta table from its JSON log, newest first."""
    log = spark.read.json(f"{path}/_delta_log/*.json").filter("commitInfo is not null")
    version = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.json$", 1).cast("long")
    return log.select(version.alias("version"), "commitInfo.*").orderBy(F.desc("version"))


_ACTIONS = "add struct<path:string,partitionValues:map<string,string>,deletionVector:struct<storageType:string>>, remove struct<path:string>, metaData struct<schemaString:string,partitionColumns:array<string>,configuration:map<string,string>>"


def read_delta(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A Delta table as of a version, the latest unless given, by its log: the last whole checkpoint at or before it, and the commits after that.

    Of each file the latest action counts. The log is read and reduced on the executors; the names of the files that are left, and their partitions' values, come to
    the driver, as any scan's do. Deletion vectors and mapped column names are refused; a version that the log doesn't reach is an error.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_delta_log")
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    commits = {int(n[:20]): n for n in names if re.fullmatch(r"\d{20}\.json", n)}
    checkpoints: dict[int, list[str]] = {}
    for n in names:
        if m := re.fullmatch(r"(\d{20})\.checkpoint(?:\.\d{10}\.(\d{10}))?\.parquet", n):
            checkpoints.setdefault(int(m[1]), []).append(n)
    whole = {v: own for v, own in checkpoints.items() if len(own) == int((re.search(r"\.(\d{10})\.parquet$", own[0]) or [0, 1])[1])}
    last = max([*commits, *whole], default=-1) if version is None else version
    start = max((v for v in whole if v <= last), default=-1)
    if last < 0 or any(v not in commits for v in range(start + 1, last + 1)):
        raise ValueError(f"the log doesn't reach version {last}")
    parts = []
    if start >= 0:
        parts.append(spark.read.schema(_ACTIONS).parquet(*[f"{path}/_delta_log/{n}" for n in whole[start]]).withColumn("version", F.lit(start)))
    if later := [f"{path}/_delta_log/{commits[v]}" for v in range(start + 1, last + 1)]:
        number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("int")
        parts.append(spark.read.schema(_ACTIONS).json(later).withColumn("version", number))
    actions = reduce(DataFrame.unionByName, parts)
    meta = actions.filter("metaData is not null").agg(F.max_by("metaData", "version").alias("m")).first().m
    if any(k.startswith("delta.columnMapping") and v != "none" for k, v in (meta.configuration or {}).items()):
        raise ValueError("mapped column names")
    files = actions.filter("add is not null or remove is not null").select(F.coalesce("add.path", "remove.path").alias("path"), F.struct("version", F.col("add").isNotNull().alias("there")).alias("at"), "add")
    left = files.groupBy("path").agg(F.max("at").alias("at"), F.max_by("add", "at").alias("add")).filter("at.there").select("path", "add.partitionValues", "add.deletionVector").collect()
    if any(f.deletionVector for f in left):
        raise ValueError("deletion vectors")
    schema, keys = StructType.fromJson(json.loads(meta.schemaString)), list(meta.partitionColumns or [])
    if not left:
        return spark.createDataFrame([], schema)
    full = lambda p: p if re.match(r"[a-z0-9]+:|/", p) else f"{path}/{p}"
    stored = StructType([f for f in schema.fields if f.name not in keys])
    rows = spark.read.schema(stored).parquet(*[full(unquote(f.path)) for f in left])
    if not keys:
        return rows
    # a file's values of the partition's columns are those of the log, whatever its folder is called
    values = spark.createDataFrame([(unquote(f.path).rsplit("/", 1)[-1], *[f.partitionValues.get(k) for k in keys]) for f in left], f"file string, {', '.join(f'`{k}` string' for k in keys)}")
    values = values.select("file", *[F.col(f"`{k}`").cast(schema[k].dataType).alias(k) for k in keys])
    return rows.withColumn("file", F.col("_metadata.file_name")).join(F.broadcast(values), "file").select(*schema.names)


def outcomes(spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame]], work: Callable[[str, DataFrame], int], threads: int = 8) -> DataFrame:
    """source, status (ok, failed), rows, error: each source is opened and worked on by itself, some at a time, and one that fails stops none of the others.

    ``work`` gets a source's name and rows, does what is to be done (a write, a count) and gives a number of rows. The error is Spark's error class, or the exception's name.
    """

    def one(name: str) -> tuple:
        try:
            return name, "ok", work(name, sources[name]()), None
        except Exception as e:
            return name, "failed", None, (e.getCondition() if isinstance(e, PySparkException) else None) or type(e).__name__

    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), sources))
    return spark.createDataFrame(rows, "source string, status string, rows long, error string")


def catalog_names(lines: DataFrame) -> DataFrame:
    """Dotted names of two or three parts found in lines of text."""
    return lines.select(F.explode(F.regexp_extract_all("value", F.lit(r"([A-Za-z0-9_]+\.[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)?)"), F.lit(1))).alias("name")).distinct()


def markdown_sections(files: DataFrame) -> DataFrame:
    """title, content, seq of the sections of whole-text files, cut at second-level headings."""
    parts = files.select(F.posexplode(F.split("value", r"\n## ")).alias("seq", "part"))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return parts.select("seq", bare(F.regexp_extract("part", r"^[^\n]*", 0)).alias("title"), bare(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("content"))


def sample(df: DataFrame, n: int, most: int = 10_000) -> DataFrame:
    """At most n rows, and at most ``most``: a read for looking at, pushed down to the source."""
    return df.limit(min(n, most))


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """database, table_name, column_name, type, nullable of all tables and views that the session's catalog lists."""
    rows = []
    for name in [database] if database else [x.name for x in spark.catalog.listDatabases()]:
        for t in spark.catalog.listTables(name):
            full = t.name if t.isTemporary else f"{name}.{t.name}"
            rows += [(name, t.name, c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(full)]
    return spark.createDataFrame(rows, "database string, table_name string, column_name string, type string, nullable boolean")


def write_report(df: DataFrame, path: str, kind: str = "json", mode: str = "overwrite") -> DataFrame:
    """A report written as json, csv, parquet or orc (``append`` for logs), as it reads back."""
    # text forms keep milliseconds alone unless told otherwise
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"} if kind in ("json", "csv") else {}
    df.write.mode(mode).format(kind).options(**exact).save(path)
    return df.sparkSession.read.schema(df.schema).format(kind).options(**exact).load(path)
