"""Sensitivity classification of columns by names and values, and of tables by their columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.operators.profile import contains_any

# Patterns of values and hints in names, by category.
PATTERNS = {
    "pii": {
        "cpf": r"\d{3}\.?\d{3}\.?\d{3}-?\d{2}",
        "cnpj": r"\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}",
        "rg": r"\d{1,2}\.?\d{3}\.?\d{3}-?[\dxX]",
        "ssn": r"\d{3}-\d{2}-\d{4}",
        "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
        "phone_br": r"\(?\d{2}\)?[\s.-]?\d{4,5}[-.]?\d{4}",
        "phone_intl": r"\+\d{1,3}[\s.-]?\(?\d{1,4}\)?[\s.-]?\d{1,4}[\s.-]?\d{1,9}",
        "passport": r"[A-Z]{2}\d{6,7}",
        "drivers_license": r"[A-Z]{2}\d{7,10}",
        "ip_address": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
        "mac_address": r"([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}",
        "nis_pis": r"\d{3}\.?\d{5}\.?\d{2}-?\d",
        "titulo_eleitor": r"\d{4}\s?\d{4}\s?\d{4}",
        "cep": r"\d{5}-?\d{3}",
    },
    "phi": {
        "cid10": r"[A-Z]\d{2}\.?\d{0,2}",
        "cns": r"\d{15}",
        "crm": r"CRM[\s/-]?\d{4,6}[\s/-]?[A-Z]{2}",
        "medical_record": r"MR[\s-]?\d{6,10}",
        "blood_type": r"\b(A|B|AB|O)[+-]\b",
    },
    "financial": {
        "credit_card": r"\b(?:\d{4}[\s-]?){3}\d{4}\b",
        "bank_account_br": r"\d{4,5}-?\d{1}",
        "agency": r"\d{4}-?\d{1}",
        "iban": r"[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z0-9]?){0,16}",
        "swift": r"[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?",
        "cvv": r"\b\d{3,4}\b",
    },
}
HINTS = {
    "pii": [
        "cpf", "cnpj", "rg", "ssn", "social_security", "email", "e_mail", "telefone", "phone", "celular", "mobile", "endereco", "address",
        "nome", "name", "sobrenome", "surname", "nascimento", "birth", "documento", "document", "identidade", "identity", "passaporte",
        "passport", "cep", "zip", "postal", "ip", "mac", "cnh", "license",
    ],
    "phi": [
        "diagnostico", "diagnosis", "cid", "icd", "prontuario", "medical_record", "prescricao", "prescription", "medicamento", "medication",
        "alergia", "allergy", "doenca", "disease", "tratamento", "treatment", "exame", "exam", "resultado", "result", "hospital", "clinica",
        "clinic", "medico", "doctor", "crm", "cns", "cartao_saude", "health_card", "sangue", "blood", "tipo_sanguineo", "blood_type", "peso",
        "weight", "altura", "height", "pressao", "pressure", "glicemia", "glucose",
    ],
    "financial": [
        "cartao", "card", "credito", "credit", "debito", "debit", "conta", "account", "banco", "bank", "agencia", "branch", "saldo", "balance",
        "transacao", "transaction", "pagamento", "payment", "fatura", "invoice", "cvv", "cvc", "iban", "swift", "pix", "boleto", "valor",
        "amount", "preco", "price", "receita", "revenue", "despesa", "expense", "lucro", "profit", "salario", "salary", "renda", "income",
    ],
}
NAME_SCORE = 0.3
LEVELS = ("public", "internal", "confidential", "restricted")


def value_rates(df: DataFrame, columns: Sequence[str], custom: dict[str, str] | None = None, terms: Sequence[str] = ()) -> DataFrame:
    """column_name, category, pattern, rate of present values that have the pattern; one scan for all of them."""
    all_patterns = [(c, k, p) for c, ps in PATTERNS.items() for k, p in ps.items()] + [("custom", k, p) for k, p in (custom or {}).items()]
    all_patterns += [("proprietary", t, rf"\b{t}\b") for t in terms]
    one = df.agg(*[F.avg(F.col(col).cast("string").rlike("(?i)" + p).cast("int")).alias(f"x{i}_{j}") for i, col in enumerate(columns) for j, (_, _, p) in enumerate(all_patterns)])
    rows = [F.struct(F.lit(col).alias("column_name"), F.lit(c).alias("category"), F.lit(k).alias("pattern"), F.coalesce(F.col(f"x{i}_{j}"), F.lit(0.0)).alias("rate")) for i, col in enumerate(columns) for j, (c, k, _) in enumerate(all_patterns)]
    return one.select(F.inline(F.array(*rows)))


def name_categories(name: Column) -> Column:
    low = F.lower(name)
    return F.array_compact(F.array(*[F.when(contains_any(low, words), c) for c, words in HINTS.items()]))


def sensitivity(categories: Column, confidence: Column) -> Column:
    has = lambda c: F.array_contains(categories, c)
    return (
        F.when(F.size(categories) == 0, "public").when(has("phi") | has("pci") | has("proprietary"), "restricted").when(has("pii") & (confidence > 0.7), "restricted")
        .when(has("pii") | has("financial"), "confidential").otherwise("internal")
    )


def classify_columns(rates: DataFrame) -> DataFrame:
    """column_name, categories, confidence, sensitivity from value rates (over a tenth; terms over a twentieth) and names."""
    hit = F.when(F.col("category") == "proprietary", F.col("rate") > 0.05).otherwise(F.col("rate") > 0.1)
    strength = F.least(F.lit(1.0), 0.5 + 0.5 * F.col("rate"))
    per = rates.groupBy("column_name").agg(
        F.collect_set(F.when(hit & (F.col("category") != "custom"), F.col("category"))).alias("by_value"),
        F.coalesce(F.max(F.when(hit, strength)), F.lit(0.0)).alias("match"),
    )
    named = name_categories(F.col("column_name"))
    hint = F.when(F.size(named) > 0, F.lit(NAME_SCORE)).otherwise(F.lit(0.0))
    both = F.when((F.col("match") > 0) & (hint > 0), F.least(F.lit(1.0), F.col("match") + 0.5 * hint)).otherwise(F.greatest("match", hint))
    out = per.select("column_name", F.sort_array(F.array_union("by_value", named)).alias("categories"), both.alias("confidence"))
    return out.select("*", sensitivity(F.col("categories"), F.col("confidence")).alias("sensitivity"))


def classify_table(columns: DataFrame) -> DataFrame:
    """columns, sensitivity (the highest level), high_risk (restricted columns), and whether each category is there."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("sensitivity"))
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce(F.max(rank), F.lit(1)).cast("int"))
    flags = [F.coalesce(F.max(F.array_contains("categories", c)), F.lit(False)).alias(f"has_{c}") for c in PATTERNS]
    return columns.agg(F.count(F.lit(1)).alias("columns"), level.alias("sensitivity"), F.count_if(F.col("sensitivity") == "restricted").alias("high_risk"), *flags)
