"""Metadata jobs: keyword classification of schemas, taxonomy scores, drafted rules, inferred keys, rejoined texts, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from govlens.operators.workflow import grams

# Keyword rules (category, weight, keywords, type hints, tags) and taxonomy weights.
RULES = (
    (
        "PII", 1.0,
        ["cpf", "rg", "ssn", "tax_id", "passport", "passaporte", "identidade", "documento", "document", "nome", "name", "razao_social", "nomecomp", "email", "e-mail", "e_mail", "phone",
         "telefone", "celular", "fone", "address", "endereco", "logradouro", "rua", "zipcode", "cep", "zip_code", "birth", "nascimento", "birthday", "birth_date", "dt_nasc", "data_nasc",
         "ip_address", "ip_addr", "endereco_ip"],
        ["string", "varchar", "email", "phone", "uuid"], ["pii", "personal"],
    ),
    (
        "PHI", 1.1,
        ["patient", "paciente", "diagnosis", "diagnostico", "cid", "medical", "clinico", "health", "saude", "doenca", "lab", "exame", "prescription", "receita", "insurance", "biometria",
         "biometric", "fingerprint", "foto", "photo", "senha", "password", "pwd", "hash_senha"],
        ["clinical", "disease", "health", "json"], ["phi", "health", "biometric"],
    ),
    (
        "FINANCIAL", 1.05,
        ["credit_card", "card", "cartao", "card_number", "num_cartao", "cvv", "iban", "swift", "routing", "account", "conta", "agencia", "banco", "transaction", "transacao", "invoice",
         "fatura", "salary", "salario", "renda", "income"],
        ["decimal", "double", "money", "currency", "card"], ["financial", "pci"],
    ),
)
ACCEPT = 0.45
TAXONOMY = {
    "naming": 0.15, "definitions": 0.15, "aliases": 0.10, "context": 0.10, "structure": 0.15, "types": 0.10, "governance": 0.15, "platform": 0.10,
}


def keyword_classes(columns: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """table_name, column_name, category, score of rules that reach ``accept``: name .5 (whole words, or compounds anywhere), description .35, type .25, tag .2."""
    tokens = F.split(F.lower("column_name"), r"[_\s]+")
    low, text, kind, tags = F.lower("column_name"), F.lower(F.coalesce("description", F.lit(""))), F.lower("type"), F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t))
    rows = []
    for category, weight, words, types, marks in RULES:
        score = F.lit(0.0)
        for w in words:
            named = low.contains(w) if "_" in w or " " in w else F.array_contains(tokens, w)
            score = score + F.when(named, 0.5 * weight).when(text.contains(w), 0.35 * weight).otherwise(0.0)
        for t in types:
            score = score + F.when(kind.contains(t), 0.25 * weight).otherwise(0.0)
        for m in marks:
            score = score + F.when(F.array_contains(tags, m), 0.2 * weight).otherwise(0.0)
        rows.append(F.struct(F.lit(category).alias("category"), score.alias("score")))
    return columns.select("table_name", "column_name", F.inline(F.array(*rows))).filter(F.col("score") >= accept - 1e-9)


def table_levels(classes: DataFrame, tables: DataFrame) -> DataFrame:
    """table_name, categories, level: health CRITICAL, financial HIGH, any other MEDIUM, none LOW."""
    per = classes.groupBy("table_name").agg(F.sort_array(F.collect_set("category")).alias("categories"))
    out = tables.select("table_name").distinct().join(per, "table_name", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    has = lambda c: F.array_contains("categories", c)
    return out.withColumn("level", F.when(F.size("categories") == 0, "LOW").when(has("PHI"), "CRITICAL").when(has("FINANCIAL"), "HIGH").otherwise("MEDIUM"))


# Labels, privacy-law categories and controls of categories; classes of access by level.
LABELS = {"PII": "PII Pessoal", "PHI": "PHI / Saúde", "FINANCIAL": "Financeiro / Pagamento"}
LAW = {"PII": "pessoal_ordinario", "PHI": "pessoal_sensivel", "FINANCIAL": "pessoal_sensivel"}
CONTROLS = {
    "PII": ["mascaramento", "tokenização", "registro de consentimento"],
    "PHI": ["mascaramento", "tokenização", "registro de consentimento", "acesso mínimo necessário", "trilhas de auditoria"],
    "FINANCIAL": ["criptografia forte", "segregação de funções", "monitoramento de acesso"],
}
CLASSES = {"CRITICAL": "restricted", "HIGH": "restricted", "MEDIUM": "confidential", "LOW": "internal"}
# What is to be done at each level; a parameter, as laws differ.
ACTIONS = {
    "CRITICAL": ["impact assessment", "isolated zone", "approval of new purposes"],
    "HIGH": ["masking in shared environments", "access audit", "least retention"],
    "MEDIUM": ["basic access and retention controls", "consent check"],
    "LOW": ["standard monitoring"],
}


def _chosen(categories: Column, values: dict[str, list[str]]) -> Column:
    """The values of the categories that are there, each once, in order."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.when(F.array_contains(categories, k), F.array(*map(F.lit, v))).otherwise(none) for k, v in values.items()]))))


def column_labels(classes: DataFrame) -> DataFrame:
    """table_name, column_name, categories, confidence (the greatest score, at most 1), labels, law, risk (high: health, money, or personal from 0.45; else medium)."""
    per = classes.groupBy("table_name", "column_name").agg(F.sort_array(F.collect_set("category")).alias("categories"), F.least(F.max("score"), F.lit(1.0)).alias("confidence"))
    one = lambda m: {k: [v] for k, v in m.items()}
    has = lambda c: F.array_contains("categories", c)
    risk = F.when(has("PHI") | has("FINANCIAL"), "high").when(has("PII"), F.when(F.col("confidence") >= 0.45, "high").otherwise("medium")).otherwise("none")
    return per.select("table_name", "column_name", "categories", "confidence", _chosen(F.col("categories"), one(LABELS)).alias("labels"), _chosen(F.col("categories"), one(LAW)).alias("law"), risk.alias("risk"))


def table_findings(levels: DataFrame, tables: DataFrame, actions: dict[str, list[str]] = ACTIONS) -> DataFrame:
    """What ``table_levels`` found with controls, actions, reasons (from the table's description and tags, and its categories), risk and recommended class.

    tables: table_name, description, tags; a table without a row there has neither, nulls are blank.
    """
    t = tables.groupBy("table_name").agg(F.lower(F.coalesce(F.max("description"), F.lit(""))).alias("d"), F.transform(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>"))))), lambda x: F.lower(x)).alias("g"))
    x = levels.join(t, "table_name", "left").withColumn("d", F.coalesce("d", F.lit(""))).withColumn("g", F.coalesce("g", F.array().cast("array<string>")))
    said = lambda *words: F.greatest(*[F.col("d").contains(w) for w in words], F.lit(False))
    tagged = lambda *words: F.greatest(*[F.array_contains("g", w) for w in words], F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(said("pii"), "description: PII"), F.when(said("phi", "health"), "description: PHI"), F.when(said("financial", "financeiro"), "description: FINANCIAL"),
        F.when(tagged("pii"), "tag: pii"), F.when(tagged("phi"), "tag: phi"), F.when(tagged("financial", "pci"), "tag: financial/pci"),
        F.when(F.size("categories") > 0, F.concat(F.lit("columns: "), F.array_join("categories", ", "))),
    ))
    of = lambda m: F.create_map(*[c for k, v in m.items() for c in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])[F.col("level")]
    risk = F.when(F.col("level").isin("CRITICAL", "HIGH"), "high").when(F.col("level") == "MEDIUM", "medium").when(F.size("categories") > 0, "low").otherwise("none")
    return x.select("table_name", "level", "categories", _chosen(F.col("categories"), CONTROLS).alias("controls"), of(actions).alias("actions"), reasons.alias("reasons"), risk.alias("risk"), of(CLASSES).alias("recommended"))


def taxonomy_scores(taxonomies: DataFrame, concepts: DataFrame) -> DataFrame:
    """Eight weighted dimensions, the overall score and the level (1 to 5 at 20, 40, 60, 80) of each taxonomy.

    taxonomies: taxonomy, groups, rules, ambiguous, conventions (points), datetime, owner, steward, agents, zones, projects; concepts: taxonomy, concept,
    definition, aliases, types.
    """
    per = concepts.groupBy("taxonomy").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("definition") != "", F.lit(False))).alias("d"), F.count_if(F.size("aliases") > 0).alias("a"), F.count_if(F.size("types") > 0).alias("t"))
    x = taxonomies.join(per, "taxonomy", "left")
    share = lambda c, f: F.when(F.coalesce("n", F.lit(0)) > 0, F.col(c) / F.col("n") * f).otherwise(F.lit(0.0))
    cap = lambda c: F.least(F.lit(100.0), c)
    parts = {
        "naming": F.col("conventions").cast("double"), "definitions": share("d", 100), "aliases": cap(cap(share("a", 150)) + F.when(F.col("ambiguous"), 20).otherwise(0)), "context": cap(F.col("rules") * 50.0),
        "structure": cap(F.col("groups") * 10.0), "types": share("t", 80) + F.when(F.col("datetime"), 20).otherwise(0), "governance": F.when(F.col("owner"), 30.0).otherwise(0.0) + F.when(F.col("steward"), 30.0).otherwise(0.0) + F.when(F.col("agents"), 40.0).otherwise(0.0),
        "platform": F.when(F.col("zones") > 0, 60.0).otherwise(0.0) + F.when(F.col("projects"), 40.0).otherwise(0.0),
    }
    out = x.select("taxonomy", *[c.alias(k) for k, c in parts.items()])
    overall = sum((F.col(k) * w for k, w in TAXONOMY.items()), F.lit(0.0))
    return out.withColumn("overall", overall).withColumn("level", F.when(F.col("overall") < 20, 1).when(F.col("overall") < 40, 2).when(F.col("overall") < 60, 3).when(F.col("overall") < 80, 4).otherwise(5))


def taxonomy_gaps(scored: DataFrame) -> DataFrame:
    """taxonomy, dimension, score, severity (critical under 20, major under 50, minor under 80), priority."""
    rows = scored.select("taxonomy", F.inline(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("score")) for k in TAXONOMY])))
    gaps = rows.filter("score < 80").withColumn("severity", F.when(F.col("score") < 20, "critical").when(F.col("score") < 50, "major").otherwise("minor"))
    return gaps.withColumn("priority", F.row_number().over(W.partitionBy("taxonomy").orderBy("score", "dimension")))


def drafted_rules(columns: DataFrame) -> DataFrame:
    """table_name, column_name, dimension, severity: completeness for NOT NULL columns, uniqueness for names like identifiers."""
    low = F.lower("column_name")
    like = F.lit(False)
    for w in ("_id", "id_", "cpf", "cnpj", "email", "code", "codigo"):
        like = like | low.contains(w)
    person = low.contains("cpf") | low.contains("cnpj") | low.contains("email")
    full = columns.filter(~F.col("nullable")).select("table_name", "column_name", F.lit("completeness").alias("dimension"), F.lit("high").alias("severity"))
    return full.unionByName(columns.filter(like).select("table_name", "column_name", F.lit("uniqueness").alias("dimension"), F.when(person, "critical").otherwise("high").alias("severity")))


def inferred_keys(columns: DataFrame) -> DataFrame:
    """column_name, entity, referenced: columns named x_id, x_key or id_x, and the tables whose names contain x.

    An entity's first letters (three, or all it has) meet the pieces of the tables' names by an equi join; what meets is confirmed.
    """
    low = F.lower("column_name")
    entity = F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in (r"^(.+)_id$", r"^(.+)_key$", r"^id_(.+)$")])
    keys = columns.select("column_name", entity.alias("entity")).filter("entity is not null").distinct().withColumn("gram", F.substring("entity", 1, 3))
    names = columns.select(F.lower("table_name").alias("referenced")).distinct()
    pieces = names.select("referenced", F.explode(F.flatten(F.array(*[F.coalesce(grams(F.col("referenced"), n), F.array().cast("array<string>")) for n in (1, 2, 3)]))).alias("gram"))
    return keys.join(pieces, "gram").filter(F.col("referenced").contains(F.col("entity"))).select("column_name", "entity", "referenced")


def rejoined(chunks: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """Texts that were cut into numbered chunks, whole again; a text is one row's worth of data."""
    return chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda x: x[text]), "").alias(text))


def session_usage(reads: DataFrame) -> DataFrame:
    return reads.groupBy("session").agg(F.count(F.lit(1)).alias("queries"), F.sum("rows").alias("rows_read"))


def changed_state(log: DataFrame, key: str = "model_id") -> DataFrame:
    """The state of each model after its log of changes, the last change of each kind counting."""
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, F.col("seq")))
    out = log.groupBy(key).agg(last("stage").alias("stage"), last("status").alias("status"), last("owner").alias("owner"), F.count(F.lit(1)).alias("changes"))
    return out.withColumn("status", F.when(F.col("stage") == "archived", "inactive").otherwise(F.col("status")))


def text_form(name: Column, kind: Column, comment: Column) -> Column:
    """One line of a column's metadata."""
    return F.concat_ws(" ", name, F.concat(F.lit("("), kind, F.lit(")")), F.when(comment.isNotNull(), F.concat(F.lit("- "), comment)))


def flat_records(df: DataFrame, glue: str = ", ") -> DataFrame:
    """The rows with scalar columns alone: lists of texts joined, other nested values as JSON, nulls blank in texts."""
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind == "array<string>":
            c = F.array_join(F.coalesce(c, F.array().cast(kind)), glue)
        elif kind.startswith(("array", "map", "struct")):
            c = F.coalesce(F.to_json(c), F.lit(""))
        elif kind == "string":
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)
