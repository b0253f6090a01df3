"""Sensitive-text queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.functions import checks
from govlens.operators import entities as n
from govlens.sources.tables import read


def counts(spark, d):
    return n.pattern_counts(read(spark, d, "documents"), ["doc_id"], terms=["license"])


def chat_counts(spark, d):
    return n.pattern_counts(read(spark, d, "conversations"), ["conv_id", "turn"], terms=["the"])


def _sql_text(accents: bool) -> str:
    """The text for SQL, whose word boundaries know ASCII only: other letters as an underscore, or those of names as a letter, one for one."""
    text = "translate(coalesce(text, ''), 'áàâãéèêíïóôõöúçñ', 'aaaaaaaaaaaaaaaa')" if accents else "coalesce(text, '')"
    return f"regexp_replace({text}, '[\\x{{00C0}}-\\x{{00D6}}\\x{{00D8}}-\\x{{00F6}}\\x{{00F8}}-\\x{{02AF}}\\x{{0370}}-\\x{{1FFF}}\\x{{2C00}}-\\x{{D7FF}}]', '_', 'g')"


def _counts_sql(table: str, keys: str, terms: list[str]) -> str:
    each = [(name, p.replace("'", "''")) for name, _, p, _ in n.PATTERNS] + [(f"term:{t}", rf"(?i)\b{t}\b") for t in terms]
    return " UNION ALL ".join(f"SELECT {keys}, '{name}' AS pattern, len(regexp_extract_all({_sql_text(name == 'person_name')}, '{p}')) AS n FROM {table} WHERE regexp_matches({_sql_text(name == 'person_name')}, '{p}')" for name, p in each)


def spans(spark, d):
    return n.spans(read(spark, d, "documents"), "doc_id").withColumn("confidence", F.round("confidence", 6))


def risk(spark, d):
    return n.risk(n.spans(read(spark, d, "documents"), "doc_id"), "doc_id").withColumn("risk", F.round("risk", 6))


def summary(spark, d):
    return n.summary(n.spans(read(spark, d, "documents"), "doc_id", terms=["license"])).withColumn("confidence", F.round("confidence", 6))


def stored(spark, d):
    """What is stored of anonymised conversations: texts without their entities, and how many values lie sealed beside each."""
    docs = read(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"), "text")
    sessions, mappings = n.stored(docs, n.spans(docs, "turn_id"), "turn_id", F.lit("0123456789abcdef"))
    return sessions.join(mappings.groupBy("turn_id").agg(F.count("sealed").alias("sealed")), "turn_id", "left")


def guardrail(spark, d):
    prompts = read(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("prompt_id"), "text")
    return n.guardrail(prompts, "prompt_id")


def redacted(spark, d):
    """Length and labels of the redacted texts."""
    out = read(spark, d, "documents").select("doc_id", n.redact(F.coalesce("text", F.lit(""))).alias("clean"))
    return out.select("doc_id", F.length("clean").alias("characters"), *[F.regexp_count("clean", F.lit(v.replace("[", r"\[").replace("]", r"\]"))).alias(k) for k, v in n.LABEL.items()])


def _redact_sql() -> str:
    out = _sql_text(True)
    for _, category, p, _ in sorted(n.PATTERNS, key=lambda x: -x[3]):
        pattern = p.replace("'", "''")
        out = f"regexp_replace({out}, '{pattern}', '{n.LABEL[category]}', 'g')"
    return out


def numbers(spark, d):
    """Check digits of every number-like run in the documents."""
    found = read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:[0-9]{13,19})|(?:[0-9]{3}-[0-9]{2}-[0-9]{4})|(?:[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})"), F.lit(0))).alias("value"))
    v = F.col("value")
    return found.select("doc_id", "value", checks.card(v).alias("card"), checks.ssn(v).alias("ssn"), checks.ipv4(v).alias("ip"))


_NUM_SQL = """WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:[0-9]{13,19})|(?:[0-9]{3}-[0-9]{2}-[0-9]{4})|(?:[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})')) AS value FROM documents),
  g AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d, string_split(value, '.') AS o FROM f)
  SELECT doc_id, value, length(d) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN substr(reverse(d), i, 1)::INT ELSE CASE WHEN substr(reverse(d), i, 1)::INT * 2 > 9 THEN substr(reverse(d), i, 1)::INT * 2 - 9 ELSE substr(reverse(d), i, 1)::INT * 2 END END FOR i IN range(1, length(d) + 1)]) % 10 = 0 AS card,
    length(d) = 9 AND substr(d, 1, 3) NOT IN ('000', '666') AND substr(d, 1, 3) < '900' AND substr(d, 4, 2) <> '00' AND substr(d, 6, 4) <> '0000' AS ssn,
    len(o) = 4 AND len(list_filter(o, lambda x: x::BIGINT > 255 OR (length(x) > 1 AND x[1] = '0'))) = 0 AS ip FROM g"""


def anonymised(spark, d):
    c = F.col("c_name")
    pool = ["Ana", "Bob", "Cid", "Dora", "Eva"]
    return read(spark, d, "customer").select("c_custkey", checks.mask(c).alias("masked"), checks.salted(c, "name", "s1").alias("hashed"), checks.partial(c).alias("revealed"), checks.pseudonym(c, pool, "7").alias("pseudonym"))


_ANON = """SELECT c_custkey, regexp_replace(c_name, '[A-Za-z0-9]', '*', 'g') AS masked, 'NAME_' || substr(sha256('s1:' || c_name), 1, 8) AS hashed,
  substr(c_name, 1, 2) || regexp_replace(substr(c_name, 3, length(c_name) - 4), '[A-Za-z0-9]', '*', 'g') || right(c_name, 2) AS revealed,
  ['Ana', 'Bob', 'Cid', 'Dora', 'Eva'][1 + (list_sum([(strpos('0123456789abcdef', substr(md5('7:' || c_name), i, 1)) - 1) FOR i IN range(1, 33)]) % 5)::BIGINT] AS pseudonym FROM customer"""


#: Kinds of values and how a customer, an order or a line stands for each.
_KINDS = ("person_name", "email", "phone_br", "cpf", "iban", "unknown")


def _values(spark, d):
    """A value of each kind for every customer."""
    c = read(spark, d, "customer").select("c_custkey", "c_name", F.lpad(F.col("c_custkey").cast("string"), 11, "5").alias("number"), F.posexplode(F.array(*map(F.lit, _KINDS))).alias("i", "entity"))
    value = F.when(F.col("i") == 1, F.concat(F.lower("c_name"), F.lit("@x.org"))).when(F.col("i").isin(2, 3), F.col("number")).otherwise(F.col("c_name"))
    return c.select("c_custkey", "entity", F.element_at(F.array(*map(F.lit, ("pii", "pii", "pii", "pii", "financial", "custom"))), F.col("i") + 1).alias("category"), value.alias("value"))


def stand_ins(spark, d):
    """What stands in for values of each kind, and their labels."""
    return _values(spark, d).select("c_custkey", "entity", checks.stand_in(F.col("value"), F.col("entity"), "7").alias("stand_in"), n.label_of(F.col("entity"), F.col("category")).alias("label"))


def _stand_in_sql() -> str:
    def pool(values):
        items = ", ".join(f"'{v}'" for v in values)
        # digit by digit, as the digest is a number beyond SQL's
        return f"[{items}][1 + list_reduce(list_concat([0], list_transform(string_split(h, ''), lambda x: strpos('0123456789abcdef', x) - 1)), lambda a, x: (a * 16 + x) % {len(values)})::BIGINT]"

    own = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in n.ENTITY_LABEL.items())
    by = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in n.LABEL.items())
    return f"""WITH v AS (SELECT c_custkey, unnest([{', '.join(f"'{k}'" for k in _KINDS)}]) AS entity, unnest(['pii', 'pii', 'pii', 'pii', 'financial', 'custom']) AS category,
        unnest([c_name, lower(c_name) || '@x.org', lpad(c_custkey::VARCHAR, 11, '5'), lpad(c_custkey::VARCHAR, 11, '5'), c_name, c_name]) AS value FROM customer),
      h AS (SELECT *, md5('7:' || value) AS h FROM v)
      SELECT c_custkey, entity, coalesce(CASE entity {own} END, CASE category {by} END, '[' || upper(category) || ']') AS label,
        CASE WHEN entity = 'person_name' THEN {pool(checks.NAMES)} WHEN entity = 'email' THEN {pool(checks.EMAILS)} WHEN entity LIKE 'phone%' THEN {pool(checks.PHONES)}
             WHEN value[1] BETWEEN '0' AND '9' THEN translate(left(h, length(value)), 'abcdef', '789012') ELSE 'PSEUDO_' || left(h, 8) END AS stand_in FROM h"""


def sealed(spark, d):
    """Every name encrypted and opened again."""
    key = F.lit("0123456789abcdef")
    return read(spark, d, "customer").select("c_custkey", checks.opened(checks.sealed(F.col("c_name"), key), key).alias("c_name"))


def retention(spark, d):
    s = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("created"), F.when(F.col("o_orderkey") % 10 == 0, "forever").otherwise("days").alias("policy"))
    return n.retention(s, "1998-08-02").select("o_orderkey", "outcome", "days_left")


QUERIES = {
    "entity_counts": counts, "entity_chat_counts": chat_counts, "entity_spans": spans, "entity_summary": summary, "vault_stored": stored, "entity_risk": risk, "entity_guardrail": guardrail, "entity_redacted": redacted, "entity_check_digits": numbers,
    "entity_anonymised": anonymised, "entity_stand_ins": stand_ins, "entity_sealed": sealed, "entity_retention": retention,
}

ORACLE = {
    "entity_counts": _counts_sql("documents", "doc_id", ["license"]),
    "entity_chat_counts": _counts_sql("conversations", "conv_id, turn", ["the"]),
    "entity_redacted": f"WITH r AS (SELECT doc_id, {_redact_sql()} AS clean FROM documents) SELECT doc_id, length(clean) AS characters, {', '.join(f"len(regexp_extract_all(clean, '\\[{v[1:-1]}\\]')) AS {k}" for k, v in n.LABEL.items())} FROM r",
    "entity_check_digits": _NUM_SQL,
    "entity_anonymised": _ANON,
    "entity_stand_ins": _stand_in_sql(),
    "entity_sealed": "SELECT c_custkey, c_name FROM customer",
    "entity_retention": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'forever' WHEN DATE '1998-08-02' - o_orderdate::DATE >= 30 THEN 'delete_now' ELSE 'expires' END AS outcome,
      CASE WHEN o_orderkey % 10 <> 0 AND DATE '1998-08-02' - o_orderdate::DATE < 30 THEN 30 - (DATE '1998-08-02' - o_orderdate::DATE) END AS days_left FROM orders""",
}
