"""Spans of entities and streams: gates and claims against plain scans, the screening stream against its batch form, late rows and timers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from govlens.functions import checks
from govlens.functions.entity_table import ENTITIES, Entity
from govlens.functions.gates import Scanner, fold, gate, stretches
from govlens.functions.scratch import scratch
from govlens.operators import entities
from govlens.streaming import quality as stream

FLAGS = [(e, 0 if e.cased else re.I) for e in ENTITIES]


def sample(rng):
    """Texts of pieces that patterns are made of, so that matches and near misses are many."""
    pieces = ["4111 1111 1111 1111", "529.982.247-25", "a@b.org", "AKIA" + "A1" * 8, "sk-proj-" + "x" * 80, "ſk-x", "KEY", "ı", "İ", "١٢٣٤٥", "CPT 12345", "12345A", "0x" + "ab" * 20, "d" * 32, "-----BEGIN RSA PRIVATE KEY-----"]
    pieces += ["Maria Silva", "password = hunter2hunter2", "https://h.org/webhook/x", "12/12/2020", "DEUTDEFF", "CONTINUE", "bc1" + "q" * 40, "AB+", "$ 1,000.00", "word", "é", "\n", "api_key: " + "z9" * 12, "postgres://u:p@h", "99.99.9.9", "ab:cd:ef:01:02:03", "Bearer " + "t" * 30, "12", "x", "-", "E" * 45 + "=="]
    return "".join(rng.choice(pieces) + rng.choice([" ", "", ", "]) for _ in range(rng.randint(0, 40)))


def test_gated_matches_are_all_matches():
    rng = random.Random(7)
    texts = [sample(rng) for _ in range(300)] + ["", "1" * 3000, "word " * 3000 + "12345678901"]
    compiled = [(re.compile(e.pattern, f), gate(e.pattern, f)) for e, f in FLAGS]
    scanner, hits = Scanner(compiled, texts), 0
    for i, text in enumerate(texts):
        for rx, g in compiled:
            want = [m.span() for m in rx.finditer(text)]
            assert [m.span() for m in scanner.find(i, rx, g)] == want, (rx.pattern, text)
            hits += len(want)
    assert hits > 3000 and sum(bool(g.needs) for _, g in compiled) > 80


def test_gates_are_read_off_patterns():
    assert gate(r"\bghp_[a-z]{20,50}\b", re.I).needs == {"ghp_"} and gate(r"(?:AB|cd)\d+").needs == {"ab", "cd"}
    assert gate(r"\d{3}-?x").needs == "digits" and gate(r"[a-f0-9]{32}").needs == "long" and gate(r"[a-z]+").needs == frozenset()
    assert gate(r"(?:ab|[0-9])c?").needs == frozenset() and gate(r"(?:[0-8]\d|9[0-8])x|CPT\d").needs == "digits"
    assert fold("ſKİı") == fold("sKi̇i") and list(stretches([5, 9, 40], 3, 42)) == [(2, 13), (37, 42)]


def claims(text, ordered):
    taken = []
    for e, rx in ordered:
        for m in rx.finditer(text):
            s, z = m.span()
            if z > s and not any(a <= s < b or a <= z - 1 < b for _, a, b in taken):
                taken.append((e.name, s, z))
    return sorted(taken, key=lambda x: x[1:])


def test_claims_of_hundreds_of_spans(spark):
    # a block with many entities is enclosed by one match; what lies in the block but outside them is taken all the same
    inner = [Entity("num", "pii", r"\d{2}", 5), Entity("block", "phi", r"<[^>]*>", 4), Entity("z", "pci", r"zzz", 3), Entity("wide", "business", r"a.{0,30}b", 2)]
    rng = random.Random(3)
    texts = ["<" + "12 " * k + "zzz> zzz" for k in (0, 10, 64, 100, 400)] + ["".join(rng.choice(["12", "<", ">", "zzz", "a", "b", " "]) for _ in range(500)) for _ in range(20)]
    got = entities.spans(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", entities=inner).collect()
    ordered = [(e, re.compile(e.pattern, re.I)) for e in inner]
    for i, t in enumerate(texts):
        assert [(r.entity, r.start, r.stop) for r in sorted((r for r in got if r.id == i), key=lambda r: r.seq)] == claims(t, ordered)
    assert [sum(r.entity == "z" for r in got if r.id == i) for i in range(5)] == [1] * 5


def test_spans_are_those_of_a_plain_scan(spark):
    rng = random.Random(11)
    texts = [sample(rng) for _ in range(80)] + [None, ""]
    ordered = sorted(((e, re.compile(e.pattern, f)) for e, f in FLAGS), key=lambda x: -x[0].priority)
    got = entities.spans(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), "id").collect()
    for i, t in enumerate(texts):
        assert [(r.entity, r.start, r.stop) for r in sorted((r for r in got if r.id == i), key=lambda r: r.seq)] == claims(t or "", ordered)


def test_labels_and_replacement(spark):
    text = "a@b.org " * 300 + "x 漢😀 c@d.org end"
    df = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    out = {r.id: r.text for r in entities.replaced(df, entities.spans(df, "id"), "id").collect()}
    assert out == {1: "[EMAIL] " * 300 + "x 漢😀 [EMAIL] end", 2: None}
    kinds = spark.createDataFrame([("email", "pii"), ("cep", "pii"), ("x", "other")], "e string, c string")
    assert [r.x for r in kinds.select(entities.label_of(F.col("e"), F.col("c")).alias("x")).collect()] == ["[EMAIL]", "[PII]", "[OTHER]"]


@pytest.mark.parametrize("code, ok", [("DEUTDEFF", True), ("deutdeff500", True), (" DEUTDEFF ", True), ("CONTINUE", False), ("CONTROLE", False), ("DEUTXXFF", False), ("DEUTDE", False), (None, False), ("AAAAXK22", True)])
def test_swift(spark, code, ok):
    assert spark.createDataFrame([(code,)], "c string").select(checks.swift(F.col("c"))).first()[0] is ok
    assert len(checks.swift_countries()) == len(set(checks.swift_countries())) == 250


def prompts(spark):
    rng = random.Random(5)
    rows = [(i, sample(rng)) for i in range(60)] + [(60, None), (61, ""), (62, "write to x@y.org"), (63, "card 4111 1111 1111 1111"), (64, "plain words")]
    return spark.createDataFrame(rows, "id long, text string")


def test_screening_is_the_guardrail(spark):
    df = prompts(spark)
    row_by_row = {r.id: (r.action, r.sent) for r in entities.screened(df, "id").collect()}
    assert row_by_row == {r.id: (r.action, r.sent) for r in entities.guardrail(df, "id").collect()}
    assert {a for a, _ in row_by_row.values()} >= {"allow", "anonymize", "block"} and row_by_row[62] == ("anonymize", "write to [EMAIL]")
    risks = {r.id: round(r.risk, 9) for r in entities.risk(entities.spans(df, "id"), "id").collect()}
    assert {r.id: round(r.risk, 9) for r in entities.screened(df, "id").collect() if r.id in risks} == risks


def test_screening_stream_fills_two_sinks(spark, tmp_path):
    df = prompts(spark)
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    source = stream.source(spark, f"{tmp_path}/in", df.schema)
    stream.guardrail(source, f"{tmp_path}/sent", f"{tmp_path}/blocked", "id", state=f"{tmp_path}/state").awaitTermination()
    want = entities.screened(df, "id").collect()
    sent, blocked = (spark.read.parquet(f"{tmp_path}/{x}").collect() for x in ("sent", "blocked"))
    assert sorted((r.id, r.action, r.sent) for r in sent) == sorted((r.id, r.action, r.sent) for r in want if r.action != "block")
    assert sorted((r.id, r.risk) for r in blocked) == sorted((r.id, r.risk) for r in want if r.action == "block") and blocked
    # the stream goes on where it stopped
    spark.createDataFrame([(99, "plain")], df.schema).write.mode("append").parquet(f"{tmp_path}/in")
    stream.guardrail(stream.source(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/sent", f"{tmp_path}/blocked", "id", state=f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/sent").count() == len(sent) + 1


def batches(spark, folder, *parts):
    """A stream of one micro-batch a part."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "ts timestamp_ntz, g string, v string").coalesce(1).write.parquet(f"{folder}/{i}")
    schema = spark.read.parquet(f"{folder}/0").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*").withColumn("ts", F.col("ts").cast("timestamp"))


def at(text):
    from datetime import datetime

    return datetime.fromisoformat(text)


def run(spark, plan):
    out = scratch(spark, "stream-test")
    query = plan.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{out}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/out").collect()


def test_uniqueness_drops_late_rows(spark, tmp_path):
    first = [(at("2024-01-01 10:00:00"), "a", "x"), (at("2024-01-01 11:00:00"), "a", "x"), (at("2024-01-01 12:00:00"), "a", "y"), (at("2024-01-01 12:00:00"), "b", None), (at("2024-01-02 05:00:00"), "a", "x")]
    late = [(at("2024-01-01 13:00:00"), "a", "z"), (at("2024-01-02 06:00:00"), "a", "x"), (at("2024-01-03 04:00:00"), "a", "q")]
    # a batch drops what is later than the watermark of the batch before it
    between = [(at("2024-01-02 05:30:00"), "b", "k")]
    got = run(spark, stream.windowed_uniqueness(batches(spark, f"{tmp_path}/in", first, between, late), "ts", "v", "g"))
    assert sorted((str(r.day)[:10], r.g, r.n_rows, r.distinct_values, r.repeated, round(r.uniqueness, 3)) for r in got) == [("2024-01-01", "a", 3, 2, 1, 66.667), ("2024-01-02", "a", 2, 1, 1, 50.0), ("2024-01-02", "b", 1, 1, 0, 100.0)]


def test_timers_fire_for_silent_groups(spark, tmp_path):
    one = [(at("2024-01-01 00:00:00"), "a", ""), (at("2024-01-01 00:00:00"), "b", ""), (at("2024-01-01 01:00:00"), None, "")]
    two = [(at("2024-01-01 09:00:00"), "b", ""), (at("2024-01-01 12:00:00"), "c", "")]
    three = [(at("2024-01-01 13:00:00"), "c", "")]
    four = [(at("2024-01-01 20:00:00"), "a", ""), (at("2024-01-01 20:00:00"), "c", "")]
    with stream.rocksdb(spark):
        got = run(spark, stream.silent(batches(spark, f"{tmp_path}/in", one, two, three, four), "ts", "g", 10 * 3600))
    assert sorted((r.group, r.latest_ms // 3_600_000 % 24) for r in got) == [("a", 0), ("b", 9)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
