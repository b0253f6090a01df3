"""Sensitive text: pattern counts, spans with confidence, risk, action, redaction and the prompt guardrail.

Counts and single-pattern redaction are native. Spans need offsets, priorities and claims, so they come from one Python function per Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from govlens.functions import checks
from govlens.functions.entity_table import ENTITIES, KEYWORDS, NEGATIONS, Entity
from govlens.functions.gates import LONG, Gate, Scanner, gate
from govlens.functions.scratch import table

#: (name, category, pattern, priority) of all entities, for whoever counts or replaces by single patterns.
PATTERNS = tuple((e.name, e.category, e.regex, e.priority) for e in ENTITIES)
# Weights, actions and labels of categories.
WEIGHT = {"pii": 0.6, "phi": 0.9, "pci": 0.95, "financial": 0.7, "business": 0.8, "credentials": 0.99}
ACTION = {"pii": "anonymize", "phi": "block", "pci": "block", "financial": "anonymize", "business": "block", "credentials": "block"}
LABEL = {"pii": "[PII]", "phi": "[PHI]", "pci": "[CARTÃO]", "financial": "[FINANCEIRO]", "business": "[CONFIDENCIAL]", "credentials": "[CREDENCIAL]"}
# Labels of entities, which come before their category's.
ENTITY_LABEL = {
    "cpf": "[CPF]", "cnpj": "[CNPJ]", "email": "[EMAIL]", "phone": "[TELEFONE]", "credit_card": "[CARTÃO]", "ssn": "[SSN]", "name": "[NOME]", "address": "[ENDEREÇO]", "iban": "[IBAN]", "icd10": "[CID]",
    "openai_api_key": "[API_KEY]", "anthropic_api_key": "[API_KEY]", "aws_access_key": "[AWS_KEY]", "aws_secret_key": "[AWS_SECRET]", "github_token": "[GITHUB_TOKEN]", "jwt_token": "[JWT]", "private_key_rsa": "[PRIVATE_KEY]",
    "database_url": "[DB_URL]", "password_config": "[SENHA]", "generic_api_key": "[API_KEY]",
}
CONTEXT = 100
#: Confidence from which on an entity counts.
LEAST = 0.5
#: Base confidence of a match, and what a validator adds or takes.
BASE, VALID, INVALID, STRICT = 0.35, 0.35, -0.15, -0.5


def selected(locales: Sequence[str] | None = None, custom: Sequence[Entity] = ()) -> tuple[Entity, ...]:
    """Entities of everywhere and of the given locales (of all without any), and custom ones."""
    return (*(e for e in ENTITIES if locales is None or e.locale in ("universal", *locales)), *custom)


def pattern_counts(docs: DataFrame, key: Sequence[str], text: str = "text", terms: Sequence[str] = ()) -> DataFrame:
    """key, pattern, n of every pattern and whole-word term that a text has; a pattern runs only on texts that have what its gate needs."""
    all_ = [(n, p) for n, _, p, _ in PATTERNS] + [(f"term:{t}", rf"(?i)\b{t}\b") for t in terms]
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(*key, body.alias("_body"), F.lower(body).alias("_low"), body.rlike("[0-9*]").alias("_digits"), body.rlike(rf"\S{{{LONG}}}").alias("_long"))

    def passes(pattern: str) -> Column:
        needs = gate(pattern, re.IGNORECASE).needs
        if isinstance(needs, str):
            return F.col(f"_{needs}")
        # letters beyond ASCII fold otherwise in Python than in Spark
        if not needs or not all(w.isascii() for w in needs):
            return F.lit(True)
        return reduce(lambda x, y: x | y, [F.contains("_low", F.lit(w)) for w in sorted(needs)])

    rows = [F.struct(F.lit(n).alias("pattern"), F.when(passes(p), F.regexp_count("_body", F.lit(p))).otherwise(F.lit(0)).alias("n")) for n, p in all_]
    return texts.select(*key, F.inline(F.array(*rows))).filter("n > 0")


def _support(name: str, category: str, value: str, around: str, boost: float, against: list[re.Pattern]) -> float:
    """What speaks for a match besides a validator: base, words around it, form, half the pattern's own boost; less what speaks against it."""
    words = min(0.4, sum(k * sum(w in around for w in ws) for k, ws in KEYWORDS.get(category, {}).items()))
    form = 0.05
    if name in ("credit_card", "card_visa", "card_mastercard") and re.search(r"\D", value) or name in ("cpf", "cnpj") and re.search(r"[.-]", value):
        form = 0.15
    elif name == "email" and "." in value.split("@")[-1]:
        form = 0.1
    digits = re.sub(r"\D", "", value)
    penalty = 0.3 if any(p.search(around) for p in against) else 0.5 if re.fullmatch(r"0+|1+", digits) else 0.0
    return BASE + words + form + boost / 2 - penalty


def _spans_of(scanner: Scanner, i: int, compiled: list[tuple[Entity, re.Pattern, Gate]], against: list[re.Pattern]) -> list[tuple]:
    """Non-overlapping spans by priority: a match that begins or ends inside a taken span is passed over, one that encloses it isn't.

    What is taken is marked character by character, so a match is decided at once, however many spans there are.
    """
    text = scanner.texts[i]
    taken: list[tuple] = []
    marks = bytearray()
    for entity, rx, needs in compiled:
        for m in scanner.find(i, rx, needs):
            s, e = m.span()
            if e > s and not (marks and (marks[s] or marks[e - 1])):
                around = text[max(0, s - CONTEXT) : s].lower() + " " + text[e : e + CONTEXT].lower()
                taken.append((entity.name, entity.category, s, e, _support(entity.name, entity.category, m.group(), around, entity.boost, against)))
                marks = marks or bytearray(len(text))
                marks[s:e] = b"\1" * (e - s)
    return sorted(taken, key=lambda x: (x[2], x[3]))


def _parts(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch of (key, text) in parts of about so many bytes of text, so that long texts don't add up."""
    begin = held = 0
    for i, n in enumerate(x.as_py() or 0 for x in pc.binary_length(batch.column(1))):
        held += n
        if held >= size:
            yield batch.slice(begin, i + 1 - begin)
            begin, held = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def spans(docs: DataFrame, key: str, text: str = "text", entities: Sequence[Entity] = ENTITIES, terms: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """key, seq, entity, category, start, stop, value, validated, confidence of the spans of every text.

    Confidence is what speaks for a match (``_support``), .35 more if its check digits are valid, .15 (.5 if strict) less if they aren't, from 0 to 1. Business
    terms are whole words of priority 3.
    """
    kind = dict(docs.dtypes)[key]
    columns = {"seq": "int", "entity": "string", "category": "string", "start": "int", "stop": "int", "value": "string", "base": "double"}
    found = docs.select(key, text).mapInArrow(_finder(key, entities, terms, columns), ", ".join(f"{c} {t}" for c, t in {key: kind, **columns}.items()))
    return found.select(key, *_judged(F.col, strict))


_KINDS = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _finder(key: str, entities: Sequence[Entity], terms: Sequence[str], columns: dict[str, str], nested: str | None = None):
    """mapInArrow function over (key, text): a row a span, or with ``nested`` a row a text with its spans in a column of that name."""
    every = [*entities, *(Entity(f"term:{t}", "business", rf"\b{re.escape(t)}\b", 3, 0.5) for t in terms)]
    ordered = sorted(every, key=lambda e: -e.priority)
    kinds = [_KINDS[t] for t in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(e, re.compile(e.pattern, 0 if e.cased else re.I), gate(e.pattern, 0 if e.cased else re.I)) for e in ordered]
        against = [re.compile(p, re.I) for p in NEGATIONS]

        def found(part: pa.RecordBatch) -> pa.RecordBatch:
            scanner = Scanner([c[1:] for c in compiled], [t or "" for t in part.column(1).to_pylist()])
            spans = [_spans_of(scanner, i, compiled, against) for i in range(part.num_rows)]
            rows = [(k, n, c, s, e, scanner.texts[i][s:e], conf) for i, own in enumerate(spans) for k, (n, c, s, e, conf) in enumerate(own)]
            arrays = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            sizes = np.array([len(own) for own in spans], np.int64)
            if nested is None:
                return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(spans)), sizes))), *arrays], [key, *columns])
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(arrays, list(columns)))], [*part.schema.names, nested])

        for b in batches:
            yield from (found(part) for part in _parts(b))

    return run


def _judged(of: Callable[[str], Column], strict: bool) -> list[Column]:
    """The columns of a span, validated and confidence among them; ``of`` gives what was found of it."""
    valid = F.lit(None).cast("boolean")
    checked = {**checks.VALIDATORS, **{c: checks.card for c in ("card_visa", "card_mastercard", "card_amex")}, "person_name": checks.person_name}
    for n, f in checked.items():
        valid = F.when(of("entity") == n, f(of("value"))).otherwise(valid)
    told = F.when(valid, VALID).when(~valid, STRICT if strict else INVALID).otherwise(0.0)
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), of("base") + told))
    return [*(of(c).alias(c) for c in ("seq", "entity", "category", "start", "stop", "value")), F.coalesce(valid, F.lit(False)).alias("validated"), conf.alias("confidence")]


def screened(prompts: DataFrame, key: str, text: str = "text", least: float = LEAST, block_at: float = 0.8, block_count: int = 10) -> DataFrame:
    """key, action, risk, sent of every prompt, decided row by row: the rules of ``risk`` and ``guardrail`` without a shuffle or a table, so it runs on a stream as on a table."""
    kind = dict(prompts.dtypes)[key]
    columns = {"seq": "int", "entity": "string", "category": "string", "start": "int", "stop": "int", "value": "string", "base": "double"}
    own = prompts.select(F.col(key), F.col(text).alias("text")).mapInArrow(_finder(key, ENTITIES, (), columns, "spans"), f"{key} {kind}, text string, spans array<struct<{', '.join(f'{c}:{t}' for c, t in columns.items())}>>")
    own = own.withColumn("spans", F.filter(F.transform("spans", lambda x: F.struct(*_judged(lambda c: x[c], False))), lambda x: x["confidence"] >= least))
    weight, action = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (WEIGHT, ACTION))
    x = F.aggregate("spans", F.lit(0.0), lambda a, s: a + weight[s["category"]] * s["confidence"] * F.when(s["validated"], 1.2).otherwise(1.0))
    own = own.withColumn("risk", x / (x + 5))
    any_of = lambda what: F.exists("spans", lambda s: action[s["category"]] == what)
    decided = F.when(F.size("spans") == 0, "allow").when((F.col("risk") >= block_at) | (F.size("spans") >= block_count) | any_of("block"), "block").when(any_of("anonymize"), "anonymize").otherwise("warn")
    own = own.withColumn("action", decided)
    labelled = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("stop"), label_of(s["entity"], s["category"]).alias("label"))))
    own = own.withColumn("cuts", labelled)
    sent = F.when(F.col("action") == "anonymize", _cut(F.col("text"), F.col("cuts.start"), F.col("cuts.stop"), F.col("cuts.label"))).when(F.col("action") != "block", F.col("text"))
    return own.select(key, "action", "risk", sent.alias("sent"))


def summary(found: DataFrame) -> DataFrame:
    """category, entity, n, validated, mean confidence of all spans."""
    return found.groupBy("category", "entity").agg(F.count(F.lit(1)).alias("n"), F.count_if("validated").alias("validated"), F.avg("confidence").alias("confidence"))


def risk(found: DataFrame, key: str, least: float = LEAST, block_at: float = 0.8, block_count: int = 10) -> DataFrame:
    """key, entities, validated, strong, risk, action per document with an entity of at least ``least`` confidence."""
    w = F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv])[F.col("category")]
    a = F.create_map(*[F.lit(x) for kv in ACTION.items() for x in kv])[F.col("category")]
    own = found.filter(F.col("confidence") >= least)
    per = own.groupBy(key).agg(
        F.count(F.lit(1)).alias("entities"), F.count_if("validated").alias("validated"), F.count_if(F.col("confidence") >= 0.8).alias("strong"),
        F.sum(w * F.col("confidence") * F.when(F.col("validated"), 1.2).otherwise(1.0)).alias("x"), F.max((a == "block").cast("int")).alias("b"), F.max((a == "anonymize").cast("int")).alias("m"),
    )
    score = F.col("x") / (F.col("x") + 5)
    action = F.when(score >= block_at, "block").when(F.col("entities") >= block_count, "block").when(F.col("b") == 1, "block").when(F.col("m") == 1, "anonymize").otherwise("warn")
    return per.select(key, "entities", "validated", "strong", score.alias("risk"), action.alias("action"))


def label_of(entity: Column, category: Column) -> Column:
    """The label of an entity: its own, else its category's, else the category in capitals."""
    own, by_category = (F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) for labels in (ENTITY_LABEL, LABEL))
    return F.coalesce(own[entity], by_category[category], F.concat(F.lit("["), F.upper(category), F.lit("]")))


def redact(c: Column, patterns: Sequence[tuple] = PATTERNS) -> Column:
    """Text with every pattern, the stronger first, replaced by its category's label."""
    for _, category, p, _ in sorted(patterns, key=lambda x: -x[3]):
        c = F.regexp_replace(c, p, LABEL[category].replace("[", "\\[").replace("]", "\\]"))
    return c


def replaced(docs: DataFrame, found: DataFrame, key: str, text: str = "text", label: Column | None = None) -> DataFrame:
    """key and the text with every span replaced by its label, by ``label_of`` unless given; of spans that overlap the first one."""
    label = label_of(F.col("entity"), F.col("category")) if label is None else label
    per = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("stop")).alias("stop"), label.alias("label")))).alias("spans"))
    out = docs.select(key, text).join(per, key, "left")
    return out.select(key, F.when(F.col("spans").isNull(), F.col(text)).otherwise(_cut(F.col(text), F.col("spans.start"), F.col("spans.stop"), F.col("spans.label"))).alias(text))


@F.pandas_udf(StringType())
def _cut(text: pd.Series, starts: pd.Series, stops: pd.Series, labels: pd.Series) -> pd.Series:
    """Texts with labels in place of their sorted spans, whose stops are negative; what begins within the span before is passed over."""

    def one(t: str | None, spans: Iterator[tuple]) -> str | None:
        if t is None:
            return None
        at, pieces = 0, []
        for start, stop, label in spans:
            if start >= at:
                pieces += [t[at:start], label]
                at = -stop
        return "".join([*pieces, t[at:]])

    return pd.Series([one(t, zip(a, z, x, strict=True) if a is not None else ()) for t, a, z, x in zip(text, starts, stops, labels, strict=True)], dtype=object)


def guardrail(prompts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, action, text to send on: none where blocked, with its spans replaced where anonymised, else as it is."""
    found = table(spans(prompts, key, text), "guardrail-spans")
    acted = risk(found, key).select(key, "action")
    out = replaced(prompts, found.filter(F.col("confidence") >= LEAST), key, text).withColumnRenamed(text, "clean")
    out = prompts.select(key, text).join(out, key, "left").join(acted, key, "left").withColumn("action", F.coalesce("action", F.lit("allow")))
    return out.select(key, "action", F.when(F.col("action") == "anonymize", F.col("clean")).when(F.col("action") != "block", F.col(text)).alias("sent"))


def stored(prompts: DataFrame, found: DataFrame, key: str, secret: Column, text: str = "text", policy: str = "days") -> tuple[DataFrame, DataFrame]:
    """(sessions, mappings): the anonymised texts under their retention policy, and each span's value, encrypted, under its place."""
    clean = replaced(prompts, found, key, text).select(key, F.col(text).alias("anonymised"), F.lit(policy).alias("policy"))
    kept = found.select(key, "seq", "entity", "category", checks.sealed(F.col("value"), secret).alias("sealed"))
    return clean, kept


def retention(sessions: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Sessions with their outcome: delete_now, expires (with days left) or forever."""
    age = F.datediff(F.lit(now).cast("date"), F.col("created").cast("date"))
    keep = F.when(F.col("policy") == "forever", "forever").when(age >= days, "delete_now").otherwise("expires")
    return sessions.withColumn("outcome", keep).withColumn("days_left", F.when(F.col("outcome") == "expires", days - age))
