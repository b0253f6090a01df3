"""Smaller governance steps: naming, merges of labels, term conflicts, escalation, approvers, evidence, references, plans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.functions.scratch import table

#: Rules, or changes, of a block that meets others as a whole, changes that a rule gets in a row, and pairs of a task if blocks are even.
BLOCK, RUN, PAIRS_OF_TASK = 16_384, 1_024, 1 << 24

# Privacy classes of categories.
LAW = {"pii": "personal data", "phi": "sensitive personal data", "financial": "financial data"}


def search_names(catalog: DataFrame, column: str, text: str, limit: int = 20) -> DataFrame:
    """Names that hold the text, whatever its case; the first ones in order."""
    return catalog.filter(F.lower(column).contains(text.lower())).orderBy(column, *[c for c in catalog.columns if c != column]).limit(limit)


def naming_violations(names: DataFrame, rules: DataFrame) -> DataFrame:
    """scope, name, rule of names that break a rule of their scope: its pattern, or one of its forbidden parts."""
    joined = names.join(rules, "scope")
    bad = ~F.regexp_like("name", "pattern") | F.exists("forbidden", lambda w: F.contains(F.lower("name"), w))
    return joined.filter(bad).select("scope", "name", "rule")


def merge_labels(by_name: DataFrame, by_value: DataFrame) -> DataFrame:
    """column_name, categories of both, and the greater confidence."""
    a = by_name.select("column_name", F.col("categories").alias("ca"), F.col("confidence").alias("pa"))
    b = by_value.select("column_name", F.col("categories").alias("cb"), F.col("confidence").alias("pb"))
    none = F.array().cast("array<string>")
    return a.join(b, "column_name", "full_outer").select("column_name", F.sort_array(F.array_union(F.coalesce("ca", none), F.coalesce("cb", none))).alias("categories"), F.greatest(F.coalesce("pa", F.lit(0.0)), F.coalesce("pb", F.lit(0.0))).alias("confidence"))


def law_classes(categories: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.array_contains(categories, k), v) for k, v in LAW.items()]))


def term_conflicts(new: DataFrame, known: DataFrame) -> DataFrame:
    """term, known_term, kind: exact (deprecated terms don't count) or containment either way (over three letters), by equi joins.

    A term that lies in another begins at one of its places, so the first four letters of the shorter meet the four letters at every place
    of the longer; what meets is confirmed on the whole terms. Null terms have no conflicts.
    """
    a = new.select("term", F.lower(F.trim("term")).alias("x")).distinct()
    b = known.select(F.col("term").alias("known_term"), F.lower(F.trim("term")).alias("y"), "deprecated").distinct()
    exact = a.join(b.filter("not deprecated"), F.col("x") == F.col("y")).select("term", "known_term", F.lit("exact").alias("kind"))
    first = lambda t, c: t.filter(F.length(c) > 3).withColumn("gram", F.substring(c, 1, 4))
    every = lambda t, c: t.filter(F.length(c) > 3).withColumn("gram", F.explode(grams(F.col(c), 4)))
    longer = every(a, "x").join(first(b, "y"), "gram").filter(F.col("x").contains(F.col("y")))
    shorter = first(a, "x").join(every(b, "y"), "gram").filter(F.col("y").contains(F.col("x")))
    part = longer.unionByName(shorter).filter("x <> y").select("term", "known_term", "deprecated", F.lit("contains").alias("kind")).distinct()
    return exact.unionByName(part.select("term", "known_term", "kind"))


def grams(c: Column, n: int) -> Column:
    """The distinct pieces of n letters of a text; none where it is shorter or null."""
    starts = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(n))))


def _arrays(df: DataFrame, keys: list[str], item: Column, size: int, name: str) -> DataFrame:
    """keys, part, items: rows of equal keys as sorted arrays of about ``size`` items at most, parted by hash where there are more; blank keys fall away."""
    df = df.filter(F.col(keys[0]).isNotNull()).withColumn("item", item)
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("parts")).select(*[F.col(k).alias(f"own_{k}") for k in keys], "parts")
    met = df.join(sizes, F.expr(" AND ".join(f"{k} <=> own_{k}" for k in keys)))
    return met.groupBy(*keys, F.pmod(F.xxhash64("item"), F.col("parts")).alias("part")).agg(F.sort_array(F.collect_list("item")).alias("items")).withColumnRenamed("items", name)


def impacted_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """rule, change of rules on a change's attribute or dataset, each pair once: two equi joins, the second without the pairs that the first has.

    Rules and changes that have one row each can't give a pair twice, so their pairs, which are nearly all, are neither shuffled nor compared; only those of
    rules or changes of several rows are made distinct. Blocks of rules meet runs of changes as arrays and are dealt to all tasks, where each rule gets the whole run
    after the one before it. So a task has few different ids, in equal runs, and the pairs, which grow with the product of the tables, take little room when they are written.
    """

    def parted(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        own = table(df.select(key, "attribute", "dataset").distinct(), "impacted")
        several = own.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).alias("again"))
        return tuple(own.join(several, F.col(key).eqNullSafe(F.col("again")), how) for how in ("left_anti", "left_semi"))

    parts = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(r: DataFrame, c: DataFrame, key: str, *also: str) -> DataFrame:
        blocks = table(_arrays(r, [key, *also], F.struct("rule"), BLOCK, "rules"), "impacted-rules").withColumnRenamed("part", "block")
        runs = table(_arrays(c, [key], F.struct(*also, "change"), BLOCK, "changes"), "impacted-changes")
        tiles = blocks.join(runs, key)
        # runs are of one length, whose ids are packed alike each time, but for the last
        starts = F.sequence(F.lit(1), F.size("changes"), F.lit(RUN))
        pairs_ = tiles.agg(F.sum(F.size("rules").cast("long") * F.size("changes"))).first()[0] or 0
        dealt = tiles.repartition(max(parts, -(-pairs_ // PAIRS_OF_TASK)))
        return dealt.select(F.transform("rules", lambda x: x["rule"]).alias("rules"), *also, F.explode(F.transform(starts, lambda i: F.slice("changes", i, F.lit(RUN)))).alias("changes"))

    def pairs(r: DataFrame, c: DataFrame) -> DataFrame:
        other = F.filter("changes", lambda x: ~F.coalesce(x["attribute"] == F.col("attribute"), F.lit(False)))
        by_attribute = met(r, c, "attribute").select("rules", F.transform("changes", lambda x: x["change"]).alias("changes"))
        by_dataset = met(r, c, "dataset", "attribute").select("rules", F.transform(other, lambda x: x["change"]).alias("changes"))
        each = [t.select(F.explode("rules").alias("rule"), "changes").select("rule", F.explode("changes").alias("change")) for t in (by_attribute, by_dataset)]
        return each[0].unionByName(each[1])

    (r, rs), (c, cs) = parted(rules, "rule"), parted(changes, "change")
    out, sides = pairs(r, c), [(x, y) for x, y in ((r, cs), (rs, c), (rs, cs)) if not x.isEmpty() and not y.isEmpty()]
    return out.unionByName(reduce(DataFrame.unionByName, [pairs(x, y) for x, y in sides]).distinct()) if sides else out


def dataset_type(name: Column) -> Column:
    n = F.lower(name)
    return (
        F.when(n.rlike(r"^(s3|gs|abfss?|hdfs|file)://"), "storage").when(n.rlike(r"^jdbc:"), "database").when(n.rlike(r"^https?://"), "api")
        .when(n.rlike(r"\.(parquet|orc|avro)$"), "file").when(n.rlike(r"\.(csv|json|txt|html)$"), "text").when(n.contains("kafka"), "stream").otherwise("table")
    )


def split_name(name: Column, default: str) -> tuple[Column, Column]:
    """(namespace, name): cut at the first slash, else at the last dot."""
    slash, dot = F.instr(name, "/") > 0, F.instr(name, ".") > 0
    space = F.when(slash, F.substring_index(name, "/", 1)).when(dot, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(default)
    return space, F.when(slash, F.regexp_extract(name, r"^[^/]*/(.*)$", 1)).when(dot, F.substring_index(name, ".", -1)).otherwise(name)


def reference_type(c: Column) -> Column:
    """proto of ``proto://path``, type of ``type:name``, else unknown."""
    return F.when(c.rlike(r"^\w+://"), F.substring_index(c, "://", 1)).when(c.rlike(r"^\w+:"), F.substring_index(c, ":", 1)).otherwise("unknown")


def table_text(columns: DataFrame) -> DataFrame:
    """table_name, text: one line of text per table, columns in order."""
    each = F.struct("position", F.concat("column_name", F.lit(" "), F.col("type")).alias("t"))
    return columns.groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["t"]), ", ").alias("text"))


def escalate(issues: DataFrame, quality: DataFrame, classes: DataFrame) -> DataFrame:
    """Severity of issues, raised to high where the dataset's quality failed and to critical where it is restricted."""
    q = quality.filter("status = 'failed'").select("dataset", F.lit(True).alias("failed")).distinct()
    c = classes.filter("level = 'restricted'").select("dataset", F.lit(True).alias("restricted")).distinct()
    out = issues.join(q, "dataset", "left").join(c, "dataset", "left")
    return out.select("issue_id", "dataset", F.when(F.col("restricted"), "critical").when(F.col("failed") & F.col("severity").isin("low", "medium"), "high").otherwise(F.col("severity")).alias("severity"))


def approvers(assignments: DataFrame) -> DataFrame:
    """domain, approvers: active owners first, then stewards, each name once."""
    rank = F.when(F.col("role") == "owner", 0).otherwise(1)
    per = assignments.filter("active").groupBy("domain", "person").agg(F.min(rank).alias("r"))
    return per.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "person"))), lambda x: x["person"]).alias("approvers"))


def pending(requests: DataFrame, decided: DataFrame, approver: str) -> DataFrame:
    """Requests without a decision that name the approver."""
    return requests.filter(F.array_contains("approvers", approver)).join(decided.select("request_id").distinct(), "request_id", "left_anti")


def task_flags(tasks: DataFrame) -> DataFrame:
    """dag and whether its tasks extract, transform and load, check, notify, wait, branch, retry."""
    n = F.lower("task")
    has = lambda *w: F.max(sum((n.contains(x).cast("int") for x in w), F.lit(0)) > 0)
    return tasks.groupBy("dag").agg(
        (has("extract") & has("transform") & has("load")).alias("etl"), has("check", "valid", "quality").alias("checks"), has("notify", "alert", "mail").alias("notifies"), has("sensor", "wait").alias("waits"),
        has("branch").alias("branches"), F.max(F.col("retries") > 0).alias("retries"),
    )


# Parts of operator types and of task names that tell what a task does.
TASK_SIGNS = {
    "extracts": (["extract"], ["S3", "GCS", "SFTP", "Http"]),
    "transforms": (["transform"], ["Spark", "Python"]),
    "loads": (["load"], ["BigQuery", "Redshift", "Postgres"]),
    "checks": (["check", "validate", "quality", "test"], []),
    "notifies": ([], ["Email", "Slack", "SNS", "Webhook"]),
    "senses": ([], ["Sensor"]),
    "branches": ([], ["Branch"]),
}


def task_patterns(tasks: DataFrame) -> DataFrame:
    """dag, etl (all three steps), and how many of its tasks check, notify, sense, branch, retry and wait for another dag, with those dags.

    tasks: dag, task, operator, retries, external_dag. One grouping; a dag's tasks are summed before they move.
    """
    n = F.lower("task")

    def is_(kind: str) -> Column:
        names, types = TASK_SIGNS[kind]
        hits = [n.contains(w) for w in names] + [F.col("operator").contains(w) for w in types]
        out = F.lit(False)
        for h in hits:
            out = out | F.coalesce(h, F.lit(False))
        return out

    cross = F.col("operator") == "ExternalTaskSensor"
    count = lambda c, name: F.count_if(c).alias(name)
    return tasks.groupBy("dag").agg(
        (F.max(is_("extracts")) & F.max(is_("transforms")) & F.max(is_("loads"))).alias("etl"), count(is_("checks"), "checks"), count(is_("notifies"), "notifies"), count(is_("senses"), "sensors"),
        count(is_("branches"), "branches"), count(F.col("retries") > 0, "retries"), count(cross, "cross_dag"), F.sort_array(F.collect_set(F.when(cross, F.col("external_dag")))).alias("waits_for"),
    )


def task_edges(tasks: DataFrame) -> DataFrame:
    """src, dst, kind of tasks with inputs, outputs and dependencies."""
    parts = [("depends_on", "dependency", True), ("inputs", "input", True), ("outputs", "output", False)]
    out = None
    for column, kind, into in parts:
        each = tasks.select("task", F.explode(column).alias("other"))
        e = each.select(F.col("other" if into else "task").alias("src"), F.col("task" if into else "other").alias("dst"), F.lit(kind).alias("kind"))
        out = e if out is None else out.unionByName(e)
    return out.distinct()


def discovery_confidence(ranked: DataFrame, resolved: DataFrame, q: str, name: str, k: int = 5) -> DataFrame:
    """q, mean_score, rate, confidence: 0.7 times the mean score of the first k and 0.3 times the share of them that the catalog knows."""
    own = ranked.filter(F.col("rank") <= k).join(resolved.select(name, F.col("match").isNotNull().cast("int").alias("ok")), name, "left")
    per = own.groupBy(q).agg(F.avg("score").alias("mean_score"), F.avg(F.coalesce("ok", F.lit(0))).alias("rate"))
    return per.withColumn("confidence", 0.7 * F.col("mean_score") + 0.3 * F.col("rate"))


def guided_plan(tables: DataFrame) -> DataFrame:
    """domain, first (mature tables, level 3 and more), later, warnings (private or stale tables), effort by number of tables."""
    per = tables.groupBy("domain").agg(
        F.sort_array(F.collect_list(F.when(F.col("maturity") >= 3, F.col("name")))).alias("first"), F.sort_array(F.collect_list(F.when(F.col("maturity") < 3, F.col("name")))).alias("later"),
        F.count_if(F.col("private")).alias("private"), F.count_if(F.col("hours") > 24).alias("stale"), F.count(F.lit(1)).alias("n"),
    )
    return per.withColumn("effort", F.when(F.col("n") > 10, "high").when(F.col("n") > 4, "medium").otherwise("low")).drop("n")


def cost_totals(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Sums of cost columns by group, the initial cost (without operations) and that of the first year."""
    out = df
    for g, cols in groups.items():
        out = out.withColumn(f"{g}_total", sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0)))
    first = [g for g in groups if g != "operational"]
    initial = sum((F.col(f"{g}_total") for g in first), F.lit(0.0))
    return out.withColumn("initial", initial).withColumn("year_one", F.col("initial") + (F.col("operational_total") if "operational" in groups else F.lit(0.0)))


def runtime_denials(requests: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Requests to an external provider whose text holds personal data, by an equi join with the entities found in it."""
    personal = found.filter("category = 'pii'").select(key).distinct()
    hit = requests.filter("provider = 'external_llm'").join(personal, key, "left_semi")
    return hit.select(key, F.lit("personal data to an external provider").alias("reason"))


def suggested_dimensions(columns: DataFrame) -> DataFrame:
    """table_name and the quality dimensions that its columns' names call for."""
    low = F.lower("column_name")
    kinds = F.array_compact(F.array(F.lit("completeness"), F.when(low.contains("id") | low.endswith("key"), "uniqueness"), F.when(low.contains("date") | low.contains("ts"), "freshness"), F.when(low.contains("status") | low.contains("type"), "validity")))
    return columns.select("table_name", F.explode(kinds).alias("dimension")).groupBy("table_name").agg(F.sort_array(F.collect_set("dimension")).alias("dimensions"))


def evidence(requests: DataFrame, quality: DataFrame, classes: DataFrame) -> DataFrame:
    """Requests with what is known of their dataset: quality score, class, and whether anything is missing."""
    out = requests.join(quality.select("dataset", "score"), "dataset", "left").join(classes.select("dataset", "level"), "dataset", "left")
    return out.select("request_id", "dataset", "score", "level", (F.col("score").isNotNull() & F.col("level").isNotNull()).alias("complete"))


def compared(scored: DataFrame, ids: Sequence, key: str, score: str) -> DataFrame:
    """The given items, the best first, with their distance to it."""
    own = scored.filter(F.col(key).isin(list(ids)))
    top = own.agg(F.max(score).alias("top"))
    return own.join(F.broadcast(top)).select(key, score, (F.col("top") - F.col(score)).alias("behind")).orderBy(F.desc(score), key)


def flat_concepts(groups: DataFrame) -> DataFrame:
    """taxonomy, concepts, aliases of nested groups of concepts."""
    each = groups.select("taxonomy", F.explode("concepts").alias("c"))
    return each.groupBy("taxonomy").agg(F.count(F.lit(1)).alias("concepts"), F.sum(F.size("c.aliases")).alias("aliases"))


def snippets(ranked: DataFrame, docs: DataFrame, key: str, text: str = "text", length: int = 300) -> DataFrame:
    """Ranked rows with the beginning of their text."""
    return ranked.join(docs.select(key, F.substring(text, 1, length).alias("snippet")), key)


def contexts(found: DataFrame, key: str, category: str, text: str, n: int = 3) -> DataFrame:
    """key and the n best texts of each category, joined; found: key, category, rank, text."""
    best = found.filter(F.col("rank") <= n)
    each = F.struct(category, "rank", F.col(text).alias("t"))
    return best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["t"]), "\n").alias("context"))


def insights(measures: DataFrame) -> DataFrame:
    """kind, severity, value rows of graph measures over their limits, the gravest first; measures: kind, value, limit, severity."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return measures.filter("value > limit").select("kind", "severity", "value").orderBy(rank, "kind")


def graph_risk(failure_points: Column, cyclic: Column, bottlenecks: Column) -> Column:
    """high over 10 points, medium over 5: two for a point of failure, five for a cycle, one for a bottleneck."""
    points = 2 * failure_points + F.when(cyclic, 5).otherwise(0) + bottlenecks
    return F.when(points > 10, "high").when(points > 5, "medium").otherwise("low")
