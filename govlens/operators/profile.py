"""Column profiles, warehouse statistics, semantic types and domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The sampler's value patterns, hints in column names, and domain keywords.
VALUE_PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[\+]?[(]?[0-9]{2,3}[)]?[-\s\.]?[0-9]{4,5}[-\s\.]?[0-9]{4}$",
    "cpf": r"^\d{3}\.?\d{3}\.?\d{3}-?\d{2}$",
    "cnpj": r"^\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}$",
    "cep": r"^\d{5}-?\d{3}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}",
    "date_br": r"^\d{2}/\d{2}/\d{4}$",
    "currency": r"^R?\$?\s?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?$",
    "ip_address": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    "url": r"^https?://[^\s]+$",
    "credit_card": r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}$",
}
NAME_HINTS = {
    "pii": ["cpf", "cnpj", "rg", "ssn", "passport", "documento"],
    "email": ["email", "e_mail", "e-mail", "mail"],
    "phone": ["phone", "telefone", "celular", "fone", "tel"],
    "name": ["nome", "name", "primeiro_nome", "sobrenome", "full_name"],
    "address": ["endereco", "address", "logradouro", "rua", "cep", "zip"],
    "date": ["data", "date", "dt_", "_dt", "created", "updated", "born"],
    "id": ["_id", "id_", "codigo", "code", "key", "pk", "fk"],
    "amount": ["valor", "amount", "price", "preco", "total", "subtotal"],
    "flag": ["flag", "is_", "has_", "ind_", "flg_", "ativo", "active"],
}
DOMAINS = {
    "customer": ["customer", "cliente", "client", "user", "usuario", "account", "conta"],
    "sales": ["sale", "venda", "order", "pedido", "transaction", "transacao", "payment", "pagamento"],
    "finance": ["finance", "financeiro", "invoice", "fatura", "billing", "cobranca", "revenue", "receita"],
    "product": ["product", "produto", "item", "sku", "catalog", "catalogo", "inventory", "estoque"],
    "marketing": ["campaign", "campanha", "lead", "marketing", "promotion", "promocao"],
    "hr": ["employee", "funcionario", "salary", "salario", "hiring", "contratacao"],
    "operations": ["operation", "operacao", "logistics", "logistica", "shipping", "envio"],
    "analytics": ["metric", "metrica", "kpi", "report", "relatorio", "dashboard", "analytics"],
}


def profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """column_name, total, null_count, distinct_count, min_value, max_value, avg_length, null_ratio, distinct_ratio, by one scan.

    Exact distinct counts of many columns expand rows by column; ``approximate`` keeps a sketch per column instead.
    """
    columns = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        distinct = F.approx_count_distinct(c) if approximate else F.countDistinct(c)
        aggs += [F.count(c).alias(f"c{i}"), distinct.alias(f"d{i}"), F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"z{i}"), F.avg(F.length(F.col(c).cast("string"))).alias(f"l{i}")]
    one = df.agg(*aggs)
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col("n").alias("total"), (F.col("n") - F.col(f"c{i}")).alias("null_count"), F.col(f"d{i}").alias("distinct_count"), F.col(f"a{i}").alias("min_value"), F.col(f"z{i}").alias("max_value"), F.col(f"l{i}").alias("avg_length"))
        for i, c in enumerate(columns)
    ]
    ratio = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(F.lit(0.0))
    return one.select(F.inline(F.array(*rows))).select("*", ratio("null_count").alias("null_ratio"), ratio("distinct_count").alias("distinct_ratio"))


def samples(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n smallest distinct values."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(n)


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows that a seed picks by key: the same ones on every run and layout."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def pattern_shares(df: DataFrame, columns: Sequence[str], patterns: dict[str, str] = VALUE_PATTERNS) -> DataFrame:
    """column_name, pattern, share of the present values that match, present (half and more); all in one scan."""
    one = df.agg(*[F.avg(F.col(c).cast("string").rlike("(?i)" + p).cast("int")).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, p in patterns.items()])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("pattern"), F.coalesce(F.col(f"{i}_{k}"), F.lit(0.0)).alias("share")) for i, c in enumerate(columns) for k in patterns]
    return one.select(F.inline(F.array(*rows))).withColumn("present", F.col("share") >= 0.5)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def name_type(name: Column) -> Column:
    """The first family whose hints a column name has, else null."""
    low, out = F.lower(name), None
    for kind, words in NAME_HINTS.items():
        hit = contains_any(low, words)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def semantic_types(columns: DataFrame, shares: DataFrame) -> DataFrame:
    """column_name and semantic_type: the last pattern that values have, else the name's family."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(VALUE_PATTERNS) for x in (k, i)])
    best = shares.filter("present").groupBy("column_name").agg(F.max_by("pattern", order[F.col("pattern")]).alias("pattern"))
    return columns.select("column_name").join(best, "column_name", "left").select("column_name", F.coalesce("pattern", name_type(F.col("column_name"))).alias("semantic_type"))


def domains(columns: DataFrame) -> DataFrame:
    """table_name and domain: most keywords found in its name and columns' names, first domain in a tie, else general."""
    text = F.lower(F.concat_ws(" ", F.col("table_name"), F.array_join(F.sort_array(F.collect_list("column_name")), " ")))
    per = columns.groupBy("table_name").agg(text.alias("text"))
    hits = [F.struct(sum((F.col("text").contains(w).cast("int") for w in ws), F.lit(0)).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("domain")) for i, (k, ws) in enumerate(DOMAINS.items())]
    best = F.array_max(F.array(*hits))
    return per.select("table_name", F.when(best["n"] > 0, best["domain"]).otherwise("general").alias("domain"))


def table_class(profiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Column rows with nullable and the table's class: restricted if any column is personal."""
    joined = profiles.join(labels, "column_name", "left").withColumn("is_pii", F.coalesce("is_pii", F.lit(False)))
    any_ = joined.agg(F.coalesce(F.max("is_pii"), F.lit(False)).alias("personal"))
    level = F.when(F.col("personal"), "restricted").otherwise("internal")
    return joined.join(F.broadcast(any_)).select("column_name", "is_pii", (F.col("null_ratio") > 0).alias("nullable"), level.alias("table_class"))


def canonical(dtype: T.DataType) -> str:
    """Contract type of a Spark type."""
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return "integer"
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "string" if isinstance(dtype, T.StringType) else dtype.simpleString()
