"""Policies, triage, ownership, glossary, approvals, registry and audit logs as table jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Keywords of issue categories and severities, hours to answer, and the four policies.
CATEGORY_KEYWORDS = {
    "quality": ["vazio", "nulo", "null", "duplicado", "invalido", "errado", "inconsistente", "empty", "duplicate", "invalid", "wrong", "broken", "missing value"],
    "metadata": ["definicao", "significado", "descricao", "glossario", "definition", "meaning", "what is", "what does", "describe"],
    "ownership": ["responsavel", "dono", "owner", "quem aprova", "who owns", "who approves", "accountable"],
    "compliance": ["lgpd", "gdpr", "sensivel", "pii", "vazamento", "sensitive", "leak", "exposed", "regulat"],
    "lineage": ["origem", "fonte", "sistema correto", "de onde vem", "source", "lineage", "upstream", "downstream", "pipeline"],
    "change_request": ["alterar", "mudar", "atualizar", "remover", "adicionar", "change", "update", "modify", "remove", "add", "deprecate"],
}
SEVERITY_KEYWORDS = {
    "critical": ["urgente", "critico", "producao", "urgent", "critical", "production", "outage", "break", "down"],
    "high": ["importante", "impacto", "kpi", "receita", "important", "impact", "revenue", "financial"],
    "medium": ["moderado", "medium", "moderate", "review"],
    "low": ["menor", "cosmetic", "minor", "low", "nice to have"],
}
SLA_HOURS = {"critical": 4, "high": 24, "medium": 72, "low": 168}
POLICIES = [
    {
        "id": "gate-risk-approved",
        "when": [("event", "in", ["registry.transition"]), ("next_stage", "==", "prod")],
        "require": [("risk_status", "==", "approved"), ("risk_tier", "in", ["low", "medium"])],
        "deny_if": [],
        "on_fail": "block",
    },
    {
        "id": "gate-validation-baseline",
        "when": [("event", "in", ["cicd.deploy"]), ("env", "==", "prod")],
        "require": [("auc", ">=", 0.85), ("robustness", ">=", 0.70)],
        "deny_if": [],
        "on_fail": "block",
    },
    {
        "id": "gate-compliance-lgpd",
        "when": [("event", "in", ["train.start", "registry.transition"])],
        "require": [("lgpd", "==", "complete"), ("contains_pii", "is", False)],
        "deny_if": [],
        "on_fail": "block",
    },
    {
        "id": "runtime-no-external-llm-with-pii",
        "when": [("event", "in", ["inference.request"]), ("provider", "==", "external_llm")],
        "require": [],
        "deny_if": [("contains_pii", "is", True)],
        "on_fail": "deny",
    },
]


def condition(field: str, op: str, value) -> Column:
    """A policy condition on a column: a missing field compares as the text None, is false, and reaches no number."""
    c = F.col(field)
    if op == "==":
        return F.coalesce(c.cast("string"), F.lit("None")) == value
    if op == "in":
        return F.coalesce(c.cast("string"), F.lit("None")).isin(list(value))
    if op == "is":
        return F.coalesce(c.cast("boolean"), F.lit(False)) == F.lit(value)
    if op == ">=":
        return F.coalesce(c >= value, F.lit(False))
    raise ValueError(op)


def _all(conditions: Sequence[tuple]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & condition(*c)
    return out


def decisions(events: DataFrame, policies: Sequence[dict] = POLICIES, key: str = "event_id") -> DataFrame:
    """key, policy, decision (not_applicable, block, deny, allow): every policy is a column of one projection, unpivoted."""
    rows = []
    for p in policies:
        denied = F.lit(False)
        for c in p["deny_if"]:
            denied = denied | condition(*c)
        d = F.when(~_all(p["when"]), "not_applicable").when(denied | ~_all(p["require"]), p["on_fail"]).otherwise("allow")
        rows.append(F.struct(F.lit(p["id"]).alias("policy"), d.alias("decision")))
    return events.select(key, F.inline(F.array(*rows)))


def excused(found: DataFrame, exceptions: DataFrame, on: str, days: int = 30, approvers: Sequence[str] = ("DPO", "CISO")) -> DataFrame:
    """Blocked decisions that a valid exception turns into ``excepted``; exceptions: key, policy, approver, granted."""
    valid = exceptions.filter(F.col("approver").isin(list(approvers)) & (F.datediff(F.lit(on).cast("date"), F.col("granted")) <= days))
    key = found.columns[0]
    hit = found.join(valid.select(key, "policy", F.lit(True).alias("excepted")).distinct(), [key, "policy"], "left")
    return hit.select(key, "policy", F.when((F.col("decision") == "block") & F.col("excepted"), "excepted").otherwise(F.col("decision")).alias("decision"))


def _most(text: Column, words: dict[str, list[str]], default: str) -> Column:
    """The key with most keywords in the text, the first in a tie."""
    hits = [F.struct(sum((text.contains(w).cast("int") for w in ws), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, ws) in enumerate(words.items())]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["k"]).otherwise(default)


def triage(issues: DataFrame, text: str = "text") -> DataFrame:
    """Adds title (first line, 80 characters), category, severity and sla_hours."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    title = F.substring(F.regexp_extract(F.trim(F.coalesce(F.col(text), F.lit(""))), r"^[^\n]*", 0), 1, 80)
    severity = _most(low, SEVERITY_KEYWORDS, "medium")
    hours = F.create_map(*[F.lit(x) for kv in SLA_HOURS.items() for x in kv])
    return issues.withColumns({"title": title, "category": _most(low, CATEGORY_KEYWORDS, "quality"), "severity": severity}).withColumn("sla_hours", hours[F.col("severity")])


def owners(issues: DataFrame, assignments: DataFrame) -> DataFrame:
    """issue_id, owner, steward: the last active assignment whose domain or dataset is the issue's; two equi joins instead of an OR.

    Assignments are reduced to the last one of each domain and of each dataset before they meet the issues.
    """
    roles = ("owner", "steward")

    def last(rows: DataFrame, key: str, own: str) -> DataFrame:
        each = [F.max(F.when(F.col("role") == r, F.struct("seq", "person"))).alias(f"{own}_{r}") for r in roles]
        return rows.groupBy(F.col(key).alias(own)).agg(*each)

    a = assignments.filter("active")
    domains = last(a.select(F.lower("domain").alias("low"), "role", "seq", "person"), "low", "of_domain")
    datasets = last(a.select("role", "seq", "person", F.explode("datasets").alias("dataset")), "dataset", "of_dataset")
    out = issues.select("issue_id", F.lower("domain").alias("of_domain"), F.col("dataset").alias("of_dataset")).join(domains, "of_domain", "left").join(datasets, "of_dataset", "left")
    best = out.groupBy("issue_id").agg(*[F.max(F.greatest(f"of_domain_{r}", f"of_dataset_{r}")).alias(r) for r in roles])
    return best.select("issue_id", *[F.col(f"{r}.person").alias(r) for r in roles])


def definition_conflicts(terms: DataFrame) -> DataFrame:
    """term, first_source, second_source of definitions of a term that differ: each pair of differing texts once, by its first source.

    Definitions that are the same but for case and edges are one text first, so copies don't multiply pairs; a pair may have one source.
    """
    text = F.lower(F.trim("definition"))
    own = terms.groupBy(F.lower(F.trim("term")).alias("term"), text.alias("d")).agg(F.min("source").alias("source"))
    a, b = own.alias("a"), own.alias("b")
    first, second = F.struct("a.source", "a.d"), F.struct("b.source", "b.d")
    return a.join(b, (F.col("a.term") == F.col("b.term")) & (first < second)).select("a.term", F.col("a.source").alias("first_source"), F.col("b.source").alias("second_source"))


def resolve_names(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """name, match, confidence: exact (high), a dotted suffix of a catalog name or its last part (medium), a part of a catalog name (low); the first kind and
    then name wins.

    The catalog is reduced to the least name of each suffix before names meet it, so these kinds are equi joins that give a row at most. Names that none
    of them finds meet the parts of catalog names that begin with the same four characters and are as long, each with the least name that has it: an equi
    join, too.
    """
    names = catalog.select(F.lower("name").alias("full")).distinct()
    parts = F.split("full", r"\.")
    ends = names.select("full", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k")).select("full", F.expr("substring_index(full, '.', -k)").alias("suffix"), F.when(F.col("k") == F.size(F.split("full", r"\.")), 0).otherwise(1).alias("kind"), "k")
    least = ends.groupBy("suffix").agg(F.min(F.struct("kind", "full")).alias("s"), F.min(F.when(F.col("k") == 1, F.col("full"))).alias("last"))
    f = found.select("name", F.lower("name").alias("low")).distinct()
    whole = f.join(least.select("suffix", "s"), F.col("low") == F.col("suffix"), "left").select("name", "low", "s")
    both = whole.join(least.select(F.col("suffix").alias("end"), "last"), F.substring_index("low", ".", -1) == F.col("end"), "left")
    best = both.select("name", "low", F.coalesce("s", F.when(F.col("last").isNotNull(), F.struct(F.lit(2).alias("kind"), F.col("last").alias("full")))).alias("b"))
    rest = best.filter("b is null and low <> ''").select("name", "low", F.substring("low", 1, 4).alias("gram"))
    lengths = rest.groupBy("gram").agg(F.collect_set(F.length("low")).alias("lengths"))
    starts = names.select("full", F.explode(F.sequence(F.lit(1), F.length("full"))).alias("at")).filter("full <> ''")
    # a name of fewer than four characters is its own beginning
    begun = starts.select("full", "at", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.length("full") - F.col("at") + 1)), lambda n: F.col("full").substr(F.col("at"), n)))).alias("gram"))
    pieces = begun.join(lengths, "gram").select("full", "at", F.explode("lengths").alias("n")).filter("at + n - 1 <= length(full)")
    inner = pieces.groupBy(F.expr("substring(full, at, n)").alias("low")).agg(F.min("full").alias("inner"))
    within = rest.join(inner, "low").select("name", "inner")
    out = best.join(within, "name", "left")
    confidence = F.when(F.col("b.kind") == 0, "high").when(F.col("b").isNotNull(), "medium").when(F.col("inner").isNotNull(), "low")
    return out.select("name", F.coalesce("b.full", "inner").alias("match"), confidence.alias("confidence"))


def current_state(decided: DataFrame, key: str = "request_id") -> DataFrame:
    """The last decision of each request; approved items become active, rejected ones draft."""
    last = decided.groupBy(key).agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.count(F.lit(1)).alias("steps"))
    return last.withColumn("item_state", F.when(F.col("status") == "approved", "active").when(F.col("status") == "rejected", "draft").otherwise("pending"))


def registry_statistics(models: DataFrame) -> DataFrame:
    """dimension, value, n by type, risk and team of models, and by stage and status of their versions: one grouping-sets job."""
    v = models.select("model_id", "model_type", "risk_level", "owner_team", F.explode_outer("versions").alias("v"))
    each = v.select("model_id", F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("value")) for d, c in (("type", F.col("model_type")), ("risk", F.col("risk_level")), ("team", F.col("owner_team")), ("stage", F.col("v.stage")), ("status", F.col("v.status")))])))
    return each.filter("value is not null").groupBy("dimension", "value").agg(F.countDistinct("model_id").alias("n"))


def find_models(models: DataFrame, stage: str | None = None, status: str | None = None, risk: str | None = None, tag: str | None = None) -> DataFrame:
    """Models with a version of that stage and status (the same one), that risk and that tag."""
    out = models
    if stage or status:
        out = out.filter(F.exists("versions", lambda v: (F.lit(stage).isNull() | (v["stage"] == F.lit(stage))) & (F.lit(status).isNull() | (v["status"] == F.lit(status)))))
    if risk:
        out = out.filter(F.col("risk_level") == risk)
    return out.filter(F.array_contains("tags", tag)) if tag else out


def production_versions(models: DataFrame) -> DataFrame:
    """model_id and its active production version, the one promoted last."""
    live = F.filter("versions", lambda v: (v["stage"] == "production") & (v["status"] == "active"))
    return models.select("model_id", F.explode(live).alias("v")).groupBy("model_id").agg(F.max_by("v.version", "v.promoted").alias("version"))


def compliance(models: DataFrame) -> DataFrame:
    """Counts: without risk, high risk in production, shadow in production, without owner, with each kind of sensitive data."""
    live = F.exists("versions", lambda v: v["stage"] == "production")
    flags = {
        "unassessed": F.col("risk_level").isNull(),
        "high_risk_live": F.col("risk_level").isin("high", "critical") & live,
        "shadow_live": F.col("is_shadow") & live,
        "no_owner": F.col("owner_team").isNull(),
        "pii": F.array_contains("data_classes", "pii"),
        "phi": F.array_contains("data_classes", "phi"),
    }
    return models.agg(*[F.count_if(c).alias(k) for k, c in flags.items()])


def chain_breaks(log: DataFrame, fields: Sequence[str], shard: str = "shard", order: str = "seq") -> DataFrame:
    """Rows whose hash isn't that of their fields or whose previous_hash isn't the hash before; the first row of a shard follows the hash that
    ``anchor`` says the shard before ended with, or GENESIS."""
    hashed = F.sha2(F.concat_ws("|", *[F.col(f).cast("string") for f in fields]), 256)
    before = F.lag("event_hash").over(W.partitionBy(shard).orderBy(order))
    ends = log.groupBy(shard).agg(F.max_by("event_hash", order).alias("end"), F.max(order).alias("top"))
    anchors = ends.select(shard, F.coalesce(F.lag("end").over(W.orderBy("top")), F.lit("GENESIS")).alias("anchor"))
    checked = log.withColumn("before", before).join(anchors, shard)
    wrong = F.when(F.col("event_hash") != hashed, "hash").when(F.col("previous_hash") != F.coalesce("before", "anchor"), "link")
    return checked.select(shard, order, wrong.alias("fault")).filter("fault is not null")


def latency_statistics(log: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, min, max and p95 per group: element floor(0.95 n) of the sorted values where n is over 20, else the maximum.

    Equal values are counted first, and ranges of values before single ones: the range that holds the element is found on the counts of at most 256
    ranges a group, so that a group is never sorted in one task unless its values lie in one range.
    """
    counted = log.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    per = counted.groupBy(group).agg(F.sum("c").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    goal = F.floor(0.95 * F.col("n")).cast("long") + 1
    width = F.when(F.col("high") > F.col("low"), F.least(F.lit(255), F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * 256))).otherwise(F.lit(0))
    cut = counted.join(F.broadcast(per) if per.count() <= 100_000 else per, group).withColumn("range", width.cast("int"))
    up = W.partitionBy(group).orderBy("range")
    ranges = cut.groupBy(group, "range").agg(F.sum("c").alias("held"), F.first("n").alias("n"))
    ranges = ranges.withColumn("before", F.sum("held").over(up) - F.col("held")).filter((F.col("n") > 20) & (F.col("before") < goal) & (goal <= F.col("before") + F.col("held")))
    inner = cut.select(group, "range", value, "c").join(ranges.select(group, "range", "n", "before"), [group, "range"])
    order = W.partitionBy(group).orderBy(value)
    hit = inner.withColumn("upto", F.col("before") + F.sum("c").over(order)).filter((F.col("upto") >= goal) & (F.col("upto") - F.col("c") < goal)).select(group, F.col(value).alias("p"))
    return per.join(hit, group, "left").select(group, "n", "mean", "low", "high", F.coalesce("p", "high").alias("p95"))


def user_activity(log: DataFrame) -> DataFrame:
    """user_id, event_type, n, sessions, last activity."""
    return log.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("sessions"), F.max("ts").alias("last_ts"))


def vault_statistics(mappings: DataFrame) -> DataFrame:
    """dimension (type or category), value, n by grouping sets."""
    sets = mappings.groupingSets([["entity_type"], ["category"]], "entity_type", "category").agg(F.count(F.lit(1)).alias("n"), F.grouping("entity_type").alias("g"))
    return sets.select(F.when(F.col("g") == 0, "type").otherwise("category").alias("dimension"), F.coalesce("entity_type", "category").alias("value"), "n")


def query_history(log: DataFrame, since: str, user: str | None = None, text: str | None = None, limit: int = 100) -> DataFrame:
    """Newest queries since a time, with every filter applied; ties by id."""
    out = log.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    if user:
        out = out.filter(F.col("user") == user)
    if text:
        out = out.filter(F.col("query").ilike(f"%{text}%"))
    return out.orderBy(F.desc("ts"), "log_id").limit(limit)
