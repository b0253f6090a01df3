"""Joins and filters that bring findings of one part of governance to another: labels, values, requests, attributes, audits, impact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from govlens.functions.scratch import table
from govlens.operators import classify, graph

# Words that mark reports, teams and sensitive attributes; categories of value patterns and of semantic types.
REPORTS = ("report", "dash", "kpi", "bi_", "analytics")
TEAMS = {
    "Financeiro": ["finance", "financ", "contab", "revenue"],
    "Comercial/CRM": ["customer", "client", "crm", "sales", "vend"],
    "RH": ["hr", "rh", "people", "employee"],
    "Marketing": ["market", "campaign", "lead"],
    "Produto": ["product", "catalog"],
}
SENSITIVE = ("cpf", "cnpj", "email", "telefone", "endereco", "nome", "pii", "lgpd", "gdpr", "sensivel")
PATTERN_TAGS = {"cpf": "pii", "email": "pii", "phone": "pii", "ip_address": "pii", "cep": "pii", "cnpj": "financial", "credit_card": "financial"}
TYPE_TAGS = {"pii": "pii", "email": "pii", "phone": "pii", "name": "pii", "address": "pii"}
SENSITIVE_TAGS = ("pii", "phi", "pci", "financial")


def _any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def model_labels(baseline: DataFrame, labels: DataFrame) -> DataFrame:
    """column_name, categories, confidence, sensitivity: a baseline with labels from elsewhere, joined on the name whatever its case.

    Categories are those of both, the confidence the greater, the sensitivity the label's or else that of categories and confidence.
    """
    own = labels.groupBy(F.lower("column_name").alias("low")).agg(
        F.transform(F.flatten(F.collect_set("categories")), lambda c: F.lower(c)).alias("more"), F.max("confidence").alias("told"), F.max("sensitivity").alias("given"))
    out = baseline.withColumn("low", F.lower("column_name")).join(own, "low", "left")
    categories = F.array_sort(F.array_distinct(F.concat("categories", F.coalesce("more", F.array().cast("array<string>")))))
    out = out.select("column_name", categories.alias("categories"), F.greatest("confidence", F.coalesce("told", F.lit(0.0))).alias("confidence"), "given")
    return out.select("column_name", "categories", "confidence", F.coalesce("given", classify.sensitivity(F.col("categories"), F.col("confidence"))).alias("sensitivity"))


def schema_only(columns: DataFrame, terms: Sequence[str] = ()) -> DataFrame:
    """column_name, categories, confidence, sensitivity from name, type, description and tags alone: hints .35, names of patterns .4, tags .45, terms .35."""
    name, text, kind = F.lower("column_name"), F.lower(F.coalesce("description", F.lit(""))), F.lower(F.coalesce("type", F.lit("")))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t))
    found, strength = [], [F.lit(0.0)]
    for category, patterns in classify.PATTERNS.items():
        hint = _any(name, classify.HINTS.get(category, ()))
        where = (name, text, kind) if category == "financial" else (name, text)
        pattern = F.lit(False)
        for c in where:
            pattern = pattern | _any(c, tuple(patterns))
        found.append(F.when(hint | pattern, category))
        strength += [F.when(pattern, 0.4).when(hint, 0.35).otherwise(0.0)]
    card = _any(name, ("credit_card",)) | _any(text, ("credit_card",)) | _any(kind, ("credit_card",))
    tagged = F.filter(tags, lambda t: t.isin(list(SENSITIVE_TAGS)))
    term = _any(name, terms) | _any(text, terms)
    strength += [F.when(F.size(tagged) > 0, 0.45).otherwise(0.0), F.when(term, 0.35).otherwise(0.0)]
    categories = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*found, F.when(card, "pci"), F.when(term, "proprietary"))), tagged)))
    out = columns.select("table_name", "column_name", categories.alias("categories"), F.greatest(*strength).alias("confidence"))
    return out.withColumn("sensitivity", classify.sensitivity(F.col("categories"), F.col("confidence")))


def sample_tags(profiled: DataFrame) -> DataFrame:
    """table_name, column_name, tags of sampled columns (patterns array, semantic_type): what keyword rules take as tags."""
    by_pattern = F.transform(F.coalesce("patterns", F.array().cast("array<string>")), lambda p: _map(PATTERN_TAGS)[p])
    tags = F.array_sort(F.array_distinct(F.array_compact(F.concat(by_pattern, F.array(_map(TYPE_TAGS)[F.col("semantic_type")])))))
    return profiled.select("table_name", "column_name", "type", tags.alias("tags"))


def mean_value(products: DataFrame, scored: DataFrame) -> DataFrame:
    """product, value (mean score of its assets, names whatever their case, 0 without any), found."""
    assets = products.select("product", F.explode("assets").alias("a")).select("product", F.lower("a").alias("asset")).distinct()
    hit = assets.join(scored.select(F.lower("asset").alias("asset"), "score"), "asset").groupBy("product").agg(F.round(F.avg("score"), 2).alias("value"), F.count(F.lit(1)).alias("found"))
    return products.select("product").join(hit, "product", "left").select("product", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("found", F.lit(0)).alias("found"))


def with_reports(products: DataFrame, quality: DataFrame, value: DataFrame) -> DataFrame:
    """Products with their quality and value reports, where there are any."""
    return products.join(quality.select("product", "quality"), "product", "left").join(value.select("product", "value"), "product", "left")


def with_defaults(rows: DataFrame, key: str, parts: Sequence[tuple[DataFrame, dict[str, float]]]) -> DataFrame:
    """Rows with the columns of further tables by key; what is absent takes the given default."""
    for more, defaults in parts:
        rows = rows.join(more.select(key, *defaults), key, "left").fillna(defaults)
    return rows


def catalog_attributes(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Discovered tables with maturity, classification, quality, freshness and source of the catalog; maturity 0 and blanks where it has none."""
    more = catalog.select("name", "maturity", "classification", "quality", "freshness", "source")
    return found.join(more, "name", "left").withColumns({"maturity": F.coalesce("maturity", F.lit(0)), **{c: F.coalesce(c, F.lit("")) for c in ("classification", "source")}})


def request_history(requests: DataFrame, sessions: DataFrame, since: str, user: str | None = None, limit: int = 100) -> DataFrame:
    """Newest finished requests since a time with the name of their session's user; ties by id."""
    out = requests.filter(F.col("status").isin("Completed", "Failed", "Cancelled") & (F.col("ts") >= F.lit(since).cast("timestamp")))
    out = out.join(sessions.select("session", "login"), "session", "left")
    return (out.filter(F.col("login") == user) if user else out).orderBy(F.desc("ts"), "request_id").limit(limit)


def log_rows(log: DataFrame, key: str, equal: dict[str, Sequence] | None = None, since: str | None = None, until: str | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Rows of a log whose columns have one of the given values, from ``since`` to ``until``, newest first, ties by key, page by page."""
    for c, values in (equal or {}).items():
        log = log.filter(F.col(c).isin(list(values)))
    if since:
        log = log.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until:
        log = log.filter(F.col("ts") <= F.lit(until).cast("timestamp"))
    if limit is None:
        return log
    return log.orderBy(F.desc("ts"), key).offset(offset).limit(limit)


def search_models(models: DataFrame, text: str, columns: Sequence[str] = ("name", "purpose", "description"), limit: int | None = 50) -> DataFrame:
    """Models that have the text, whatever its case, in one of the columns or tags; the first by model_id, or all without a limit."""
    low = text.lower()
    hit = F.exists("tags", lambda t: F.lower(t).contains(low))
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(low), F.lit(False))
    found = models.filter(hit)
    return found if limit is None else found.orderBy("model_id").limit(limit)


def model_impact(dependencies: DataFrame, models: DataFrame, changed: DataFrame) -> DataFrame:
    """changed, direct, affected, high_risk, production: the dependents of models, direct and by any way; dependencies: src is needed by dst."""
    reached = reach_pairs(dependencies, changed)
    per = reached.join(models.select(F.col("model_id").alias("id"), "risk_level", "production"), "id", "left").groupBy("key").agg(
        F.count_if(F.col("hops") == 1).alias("direct"), F.count(F.lit(1)).alias("affected"), F.count_if(F.col("risk_level") == "high").alias("high_risk"), F.count_if("production").alias("production"))
    out = changed.select(F.col("id").alias("key")).distinct().join(per, "key", "left")
    return out.select(F.col("key").alias("changed"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("direct", "affected", "high_risk", "production")])


def reach_pairs(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(key, id, hops) of what is downstream of each start id, which is its key: the closures of many starts at once, a round a hop."""
    e = table(graph.distinct_edges(edges), "pairs-edges")
    front = start.select(F.col("id").alias("key"), "id").distinct()
    seen, hops = None, 0
    while True:
        hops += 1
        found = front.join(e, front["id"] == e["src"]).select("key", F.col("dst").alias("id")).distinct()
        if seen is not None:
            found = found.join(seen, ["key", "id"], "left_anti")
        found = table(found.withColumn("hops", F.lit(hops)), "pairs-front")
        if found.isEmpty():
            return seen if seen is not None else found
        seen = found if seen is None else seen.unionByName(found)
        front = found.select("key", "id")


def teams_of(name: Column) -> Column:
    low = F.lower(name)
    return F.array_compact(F.array(*[F.when(_any(low, words), team) for team, words in TEAMS.items()]))


def rules_per_change(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """change, rules: how many different rules a change's datasets and attributes have, where there are any.

    Rules are counted by dataset, by attribute and by both before changes meet them, so no pair of a change and a rule is built: the rules of either are those of
    one and of the other less those of both. A change of several rows, for which this sum doesn't hold, meets its rules one by one.
    """
    r = table(rules.select("rule", "dataset", "attribute").distinct(), "impact-rules")
    c = table(changes.select("change", "dataset", "attribute").distinct(), "impact-changes")
    by = [r.select("rule", x).filter(F.col(x).isNotNull()).distinct() for x in ("dataset", "attribute")]
    n = F.count(F.lit(1))
    of_dataset, of_attribute = by[0].groupBy("dataset").agg(n.alias("nd")), by[1].groupBy("attribute").agg(n.alias("na"))
    other = by[1].withColumnRenamed("rule", "same")
    of_both = by[0].join(other, F.col("rule").eqNullSafe(F.col("same"))).groupBy("dataset", "attribute").agg(n.alias("nb"))
    rows = c.groupBy("change").agg(F.count(F.lit(1)).alias("rows"))
    single = c.join(rows.filter("rows = 1"), "change", "left_semi").join(of_dataset, "dataset", "left").join(of_attribute, "attribute", "left").join(of_both, ["dataset", "attribute"], "left")
    counted = single.select("change", (F.coalesce("nd", F.lit(0)) + F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0))).alias("rules")).filter("rules > 0")
    several = c.join(rows.filter("rows > 1"), "change", "left_semi")
    hit = by[0].join(several.select("change", "dataset"), "dataset").select("change", "rule").unionByName(by[1].join(several.select("change", "attribute"), "attribute").select("change", "rule"))
    return counted.unionByName(hit.distinct().groupBy("change").agg(F.count(F.lit(1)).alias("rules")))


def change_impact(changes: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """change, reports, teams, rules, regulated, risk of changes (change, dataset, attribute, text).

    Reports and teams are told by the names of what is downstream; rules are those of the dataset or the attribute, by ``rules_per_change``; risk is high
    with a report or a sensitive word, medium with a rule or team, else low.
    """
    down = reach_pairs(edges, changes.select(F.col("dataset").alias("id"))).withColumnRenamed("key", "dataset")
    low = F.lower("id")
    per = down.groupBy("dataset").agg(F.count_if(_any(low, REPORTS)).alias("reports"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(teams_of(F.col("id")))))).alias("teams"))
    ruled = rules_per_change(changes, rules)
    out = changes.join(per, "dataset", "left").join(ruled, "change", "left")
    regulated = _any(F.lower(F.concat_ws(" ", "text", "attribute")), SENSITIVE)
    out = out.select("change", F.coalesce("reports", F.lit(0)).alias("reports"), F.coalesce("teams", F.array().cast("array<string>")).alias("teams"), F.coalesce("rules", F.lit(0)).alias("rules"), regulated.alias("regulated"))
    return out.withColumn("risk", F.when((F.col("reports") > 0) | F.col("regulated"), "high").when((F.col("rules") > 0) | (F.size("teams") > 0), "medium").otherwise("low"))


def containment(files: DataFrame) -> DataFrame:
    """src, dst, kind: edges from datasets to the files that they hold; files: file, folder."""
    return files.select(F.col("folder").alias("src"), F.col("file").alias("dst"), F.lit("contains").alias("kind")).distinct()


def activity_metrics(activities: DataFrame, edges: DataFrame) -> DataFrame:
    """pipeline, activities, copies, depth, entries, exits of activities (pipeline, activity, kind) and what they depend on (pipeline, src, dst)."""
    name = lambda a: F.concat_ws("\u0001", "pipeline", a)
    levels, _ = graph.peel(activities.select(name("activity").alias("id")), edges.select(name("src").alias("src"), name("dst").alias("dst")))
    a = activities.select("pipeline", "activity", "kind", name("activity").alias("id")).distinct()
    flow = edges.select("pipeline", "src", "dst").distinct()
    a = a.join(flow.select("pipeline", F.col("dst").alias("activity"), F.lit(True).alias("needs")).distinct(), ["pipeline", "activity"], "left")
    a = a.join(flow.select("pipeline", F.col("src").alias("activity"), F.lit(True).alias("feeds")).distinct(), ["pipeline", "activity"], "left").join(levels, "id", "left")
    return a.groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("activities"), F.count_if(F.col("kind") == "Copy").alias("copies"), (F.max("level") + 1).alias("depth"), F.count_if(F.col("needs").isNull()).alias("entries"),
        F.count_if(F.col("feeds").isNull()).alias("exits"),
    )


def graph_inventory(nodes: DataFrame, edges: DataFrame, neighbours: int = 3) -> DataFrame:
    """id, kind, in_degree, out_degree, inputs, outputs (the first ones in order) of busy nodes; the kind stands before the colon."""
    e = table(graph.distinct_edges(edges), "inventory-edges")
    d = table(graph.degrees(nodes, e).filter("in_degree > 5 or out_degree > 5"), "inventory-busy")

    def some(at: str, other: str, name: str) -> DataFrame:
        # each task hands on its least neighbours of a node only, so that neither a list nor a shuffle grows with a node's degree
        order = F.row_number().over(W.partitionBy(at).orderBy(other))
        least = e.filter(F.col(other).isNotNull()).withColumn("rank", order).filter(F.col("rank") <= neighbours)
        return least.groupBy(F.col(at).alias("id")).agg(F.sort_array(F.collect_list(other)).alias(name))

    out = d.join(some("dst", "src", "inputs"), "id", "left").join(some("src", "dst", "outputs"), "id", "left")
    none = F.array().cast("array<string>")
    return out.select("id", F.substring_index("id", ":", 1).alias("kind"), "in_degree", "out_degree", F.coalesce("inputs", none).alias("inputs"), F.coalesce("outputs", none).alias("outputs"))


def recommendations(insights: DataFrame, measures: DataFrame) -> DataFrame:
    """priority, title, findings: what insights (kind, severity) and one row of measures (components, cyclic, nodes) call for, the most urgent first."""
    seen = insights.agg(
        F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("kind").isin("optimization", "bottleneck")).alias("slow"), F.count_if(F.col("kind") == "orphaned").alias("orphaned"))
    rows = [
        (0, "IMMEDIATE", "Address critical issues", F.col("critical") > 0, F.col("critical")), (1, "HIGH", "Optimize performance", F.col("slow") > 0, F.col("slow")),
        (2, "MEDIUM", "Consolidate the architecture", F.col("components") > 3, F.col("components")), (2, "MEDIUM", "Improve quality controls", (F.col("orphaned") > 0) | F.col("cyclic"), F.col("orphaned")),
        (3, "LOW", "Document and govern", F.col("nodes") > 50, F.col("nodes")),
    ]
    each = [F.when(holds, F.struct(F.lit(o).alias("o"), F.lit(p).alias("priority"), F.lit(t).alias("title"), n.cast("long").alias("findings"))) for o, p, t, holds, n in rows]
    return seen.join(F.broadcast(measures)).select(F.inline(F.array_compact(F.array(*each)))).orderBy("o", "title").drop("o")


def compare_schemas(old: DataFrame, new: DataFrame) -> DataFrame:
    """column_name, old_type, new_type, change (added, removed, type, same) of two schema tables, by one full join."""
    a, b = old.select("column_name", F.col("type").alias("old_type")), new.select("column_name", F.col("type").alias("new_type"))
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "type").otherwise("same")
    return a.join(b, "column_name", "full_outer").select("column_name", "old_type", "new_type", change.alias("change"))


def flattened(tables: DataFrame) -> DataFrame:
    """name and the record of a table as text: lists joined, nulls blank, columns as JSON."""
    lists = {c: F.concat_ws(",", c) for c in ("tags", "keys")}
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("owner", "description", "rows")}
    return tables.select("name", *[x.alias(c) for c, x in {**lists, **blank}.items()], F.to_json("columns").alias("columns"))
