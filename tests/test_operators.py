"""Edge cases of operators on hand-made tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from govlens.functions import checks
from govlens.operators import discovery, drift, entities, governance, graph, portfolio, quality, usage
from govlens.plans import lineage
from govlens.plans.discovery import document_frequencies
from govlens.sources import tables


def one(df):
    return df.collect()[0]


def test_quality_example_table(spark):
    rows = [(i - 1 if i % 20 == 0 else i, "  " if i % 10 == 0 else f"Customer {i}", "invalid-email" if i % 25 == 0 else "" if i % 15 == 0 else f"c{i}@email.com") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, name string, email string")
    m = {r.column_name: r for r in quality.completeness(df).collect()}
    assert m["name"].null_count == 10 and m["email"].null_count == 5 and m["*"].total_rows == 300
    u = one(quality.uniqueness(df, column="id"))
    assert u.distinct_count == 96 and u.status == "warning"
    v = one(quality.validity(df.filter("trim(email) <> ''"), [("email", {"pattern": quality.PATTERNS["email"]})]))
    assert (v.checked, v.valid) == (95, 91)


def test_quality_of_nothing(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert {r.completeness for r in quality.completeness(df).collect()} == {1.0}
    assert one(quality.uniqueness(df, column="a")).uniqueness == 1.0
    assert one(quality.freshness(df.select(F.col("a").cast("timestamp").alias("t")), "t", "2024-01-01")).status == "skipped"
    assert one(quality.referential(df, "a", df, "a")).consistency == 1.0


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    assert quality.completeness(df).filter("column_name = 'x'").first().null_count == 2


@pytest.mark.parametrize(("hours", "score", "state"), [(48, 1.0, "passed"), (49, 1 - 1 / 48, "passed"), (96, 0.0, "failed"), (97, 1 - 97 / 192, "failed")])
def test_freshness_steps(spark, hours, score, state):
    df = spark.range(1).select((F.lit("2024-01-31").cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))).alias("t"))
    r = one(quality.freshness(df, "t", "2024-01-31", sla_hours=48, threshold=0.9))
    assert abs(r.freshness - score) < 1e-9 and r.status == ("warning" if hours == 49 else state)


def test_equal_nulls_are_consistent(spark):
    df = spark.createDataFrame([(1, None, None), (1, "a", None), (2, "a", "b")], "k int, a string, b string")
    r = one(quality.equals_if(df, F.col("k") == 1, "a", "b"))
    assert (r.applicable, r.violations) == (2, 1)


POLICY = [
    ("gate-risk-approved", {"event": "registry.transition", "next_stage": "prod", "risk_status": "pending", "risk_tier": "low"}, "block"),
    ("gate-risk-approved", {"event": "registry.transition", "next_stage": "prod", "risk_status": "approved", "risk_tier": "high"}, "block"),
    ("gate-risk-approved", {"event": "registry.transition", "next_stage": "prod", "risk_status": "approved", "risk_tier": "medium"}, "allow"),
    ("gate-risk-approved", {"event": "registry.transition", "next_stage": "staging"}, "not_applicable"),
    ("gate-validation-baseline", {"event": "cicd.deploy", "env": "prod", "auc": 0.80, "robustness": 0.75}, "block"),
    ("gate-validation-baseline", {"event": "cicd.deploy", "env": "prod", "auc": 0.90, "robustness": 0.60}, "block"),
    ("gate-validation-baseline", {"event": "cicd.deploy", "env": "prod", "auc": 0.92, "robustness": 0.80}, "allow"),
    ("gate-validation-baseline", {"event": "cicd.deploy", "env": "staging"}, "not_applicable"),
    ("gate-compliance-lgpd", {"event": "train.start", "lgpd": "open", "contains_pii": False}, "block"),
    ("gate-compliance-lgpd", {"event": "train.start", "lgpd": "complete", "contains_pii": True}, "block"),
    ("gate-compliance-lgpd", {"event": "registry.transition", "lgpd": "complete", "contains_pii": False}, "allow"),
    ("runtime-no-external-llm-with-pii", {"event": "inference.request", "provider": "external_llm", "contains_pii": True}, "deny"),
    ("runtime-no-external-llm-with-pii", {"event": "inference.request", "provider": "external_llm", "contains_pii": False}, "allow"),
    ("runtime-no-external-llm-with-pii", {"event": "inference.request", "provider": "internal", "contains_pii": True}, "not_applicable"),
]


def test_policy_truth_table(spark):
    fields = ["event", "next_stage", "risk_status", "risk_tier", "env", "auc", "robustness", "lgpd", "contains_pii", "provider"]
    rows = [(i, *[e.get(f) for f in fields]) for i, (_, e, _) in enumerate(POLICY)]
    df = spark.createDataFrame(rows, "event_id int, event string, next_stage string, risk_status string, risk_tier string, env string, auc double, robustness double, lgpd string, contains_pii boolean, provider string")
    got = {(r.event_id, r.policy): r.decision for r in governance.decisions(df).collect()}
    assert [got[i, p] for i, (p, _, _) in enumerate(POLICY)] == [d for _, _, d in POLICY]


@pytest.mark.parametrize(
    ("name", "good", "bad"),
    [
        ("cpf", ["529.982.247-25", "11144477735"], ["529.982.247-24", "11111111111", "123", None]),
        ("cnpj", ["11.222.333/0001-81"], ["11.222.333/0001-80", "00000000000000"]),
        ("credit_card", ["4111 1111 1111 1111", "5500-0000-0000-0004"], ["4111 1111 1111 1112", "0"]),
        ("ssn", ["123-45-6789"], ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000"]),
        ("iban", ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], ["GB82 WEST 1234 5698 7654 33", "XX"]),
        ("ip_address", ["1.2.3.4", "255.255.255.0"], ["256.1.1.1", "01.2.3.4", "1.2.3"]),
        ("email", ["a.b@c.org"], ["a..b@c.org", ".a@c.org", "a@c"]),
        ("swift_bic", ["DEUTDEFF", "DEUTDEFF500"], ["DEUTXXFF", "CONTINUE"]),
    ],
)
def test_check_digits(spark, name, good, bad):
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, want boolean")
    assert all(bool(r.got) == r.want for r in df.select("want", checks.VALIDATORS[name](F.col("v")).alias("got")).collect())


def test_anonymise(spark):
    df = spark.createDataFrame([("Ana-12 é",), ("abcd",), ("",)], "v string")
    r = df.select(checks.mask(F.col("v")).alias("m"), checks.partial(F.col("v")).alias("p")).collect()
    assert [(x.m, x.p) for x in r] == [("***-** *", "An*-*2 é"), ("****", "****"), ("", "")]


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def ids(e):
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()


def test_demo_graph(spark):
    e = edges(spark, ("r.o", "b.o"), ("b.o", "s.o"), ("s.o", "g.e"), ("g.e", "g.r"), ("r.c", "b.c"), ("b.c", "s.c"), ("s.c", "g.e"))
    assert one(graph.cycle_summary(ids(e), e)).longest_path == 5
    assert {r.id for r in graph.articulation_points(e).collect()} == {"b.o", "s.o", "g.e", "b.c", "s.c"}
    assert graph.reach(e, spark.createDataFrame([("b.o",)], "id string")).count() == 3
    assert one(graph.component_sizes(ids(e), e)).pattern == "convergent"


def cut_points(pairs):
    """By taking each node away and counting the parts that are left."""
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def parts(without):
        seen, n = {without}, 0
        for root in near:
            if root not in seen:
                seen.add(root)
                n, todo = n + 1, [root]
                while todo:
                    new = near[todo.pop()] - seen
                    seen |= new
                    todo += new
        return n

    whole = parts(None)
    return {x for x in near if parts(x) > whole}


def test_cut_points_of_random_graphs(spark):
    draw = random.Random(7)
    pairs = []
    for g in range(40):  # forty graphs of one table, thin to dense, with loops, repeats and both directions
        n = draw.randint(2, 14)
        pairs += [(f"{g:02d}-{draw.randrange(n)}", f"{g:02d}-{draw.randrange(n)}") for _ in range(draw.randint(1, 2 * n))]
    pairs += [("ring-%d" % i, "ring-%d" % ((i + 1) % 9)) for i in range(9)] + [("ring-4", "tail"), ("tail", "end"), ("loop", "loop")]
    found = [r.id for r in graph.articulation_points(edges(spark, *pairs)).collect()]
    assert len(found) == len(set(found)) and set(found) == cut_points(pairs) and {"ring-4", "tail"} <= set(found)
    assert graph.articulation_points(edges(spark, ("a", "b")).limit(0)).count() == 0


def test_cycles_and_isolated(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("c", "c"), ("b", "d"))
    nodes = ids(e).unionByName(spark.createDataFrame([("z",)], "id string"))
    assert one(graph.cycle_summary(nodes, e)).has_cycle
    strong = {r.id: r.component for r in graph.strong_components(e, nodes).collect()}
    assert strong["a"] == strong["b"] and len(set(strong.values())) == 4
    assert {tuple(r.path) for r in graph.cycles(e).collect()} == {("a", "b"), ("c",)}
    weak = {r.id: r.component for r in graph.weak_components(nodes, e).collect()}
    assert weak["z"] == "z" and weak["d"] == weak["a"]
    assert {r.id for r in graph.roles(nodes, e).filter("isolated").collect()} == {"z"}


def test_cut_points_and_labels_of_the_whole_dag(spark):
    d = "/root/testdata/sf0.001"
    near: dict = {}
    whole = [tuple(r) for r in lineage.dag(spark, d).select("src", "dst").collect()]
    for a, b in whole:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert {r.id for r in lineage.articulation(spark, d).collect()} == cut_points(whole)
    label = {x: x for x in near}
    for _ in range(5):
        votes = {x: Counter(label[y] for y in near[x]) for x in near}
        label = {x: min(v, key=lambda k: (-v[k], k)) for x, v in votes.items()}
    assert {r.id: r.community for r in lineage.communities(spark, d).collect()} == label


def test_betweenness_of_a_path(spark):
    got = {r.id: r.score for r in graph.betweenness(edges(spark, ("a", "b"), ("b", "c"), ("c", "d"))).collect()}
    assert got == {"b": 2.0, "c": 2.0}


def test_independent_paths_are_chosen_one_by_one(spark):
    rng = random.Random(5)
    pairs = {(f"n{a:02}", f"n{b:02}") for a, b in (rng.sample(range(60), 2) for _ in range(75)) if a != b}
    pairs |= {("n00", "n00"), ("lone", "n61"), *[(f"c{i}", f"c{i + 1}") for i in range(14)]}  # itself, an edge alone, and one too long
    near: dict = {}
    for a, b in sorted(pairs):
        near.setdefault(a, []).append(b)
    into = {b for _, b in pairs}
    want, used = {}, set()
    for source in sorted(set(near) - into):
        ways, front = {source: [source]}, [[source]]
        for _ in range(10):
            front = sorted([*w, x] for w in front for x in near.get(w[-1], []) if x not in ways)
            front = [w for k, w in enumerate(front) if all(w[-1] != o[-1] for o in front[:k])]
            ways |= {w[-1]: w for w in front}
        for sink in sorted(set(ways) - set(near)):
            if len(ways[sink]) > 2 and not used & set(ways[sink]):
                want[source, sink] = ways[sink]
                used |= set(ways[sink])
    e = edges(spark, *pairs)
    assert {(r.source, r.sink): r.path for r in graph.independent_paths(e, most=None).collect()} == want and len(want) > 2
    assert [(r.source, r.sink) for r in graph.independent_paths(e, most=2).collect()] == sorted(want)[:2]
    assert graph.independent_paths(e.limit(0)).count() == 0


def test_irr_and_payback(spark):
    df = spark.createDataFrame([(100.0, 60.0, 10.0), (0.0, 10.0, 0.0), (100.0, 5.0, 10.0)], "investment double, benefit double, cost double")
    r = portfolio.irr_of(df, "investment", "benefit", "cost").select("irr", portfolio.payback_months(F.col("investment"), F.col("benefit"), F.col("cost")).alias("m"), portfolio.roi(F.col("investment"), F.col("benefit")).alias("roi")).collect()
    flows = [-100, 50, 53, 56.15]
    assert abs(sum(f / (1 + r[0].irr / 100) ** t for t, f in enumerate(flows))) < 1e-3
    assert [x.m for x in r] == [24, 0, 999] and r[1].roi == 0.0


def test_zero_vector_and_unknown_term(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], [1.0, 0.0]), (2, [3.0, 4.0], [3.0, 4.0])], "i int, a array<float>, b array<float>")
    assert [round(r.c, 9) for r in df.orderBy("i").select(discovery.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 1.0]
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "doc_id long, text string")
    tf = discovery.terms(docs, bigrams=False)
    idfs = discovery.idf(tf, 2, max_df=1.0)
    query = discovery.weights(discovery.terms(spark.createDataFrame([(9, "unseen")], "doc_id long, text string"), bigrams=False), idfs)
    assert query.count() == 0


def test_document_frequencies_have_rare_terms(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta"), (2, "gamma beta"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.term: r.df for r in document_frequencies(spark, str(tmp_path)).collect()}
    assert got == {"alpha": 1, "beta": 2, "gamma": 1, "alpha beta": 1, "gamma beta": 1}


def test_nearest_takes_any_number_of_queries(spark):
    rows = [(i, [float(i % 7), float(i % 5) + 1, float(i)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asks = docs.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    want = {tuple(r) for r in discovery.nearest(asks, docs, 4).select("query_id", "vec_id", "rank").collect()}
    got = [tuple(r) for r in discovery.nearest(asks, docs, 4, block=6).select("query_id", "vec_id", "rank").collect()]
    assert len(got) == len(want) == 80 and set(got) == want


def test_spans_overlap_and_action(spark):
    df = spark.createDataFrame([(1, "mail a@b.org now"), (2, "card 4111 1111 1111 1111"), (3, None), (4, "nothing"), (5, "203.0.113.9"), (6, "Maria é de Souza"), (7, "my email: Ana.B@c.org, Carlos Silva Souza")], "id long, text string")
    found = entities.spans(df, "id")
    # an address of four numbers is claimed by the telephone pattern, which stands before its own
    assert {(r.id, r.entity, r.start) for r in found.collect()} == {(1, "email", 5), (2, "credit_card", 5), (5, "phone_intl", 0), (7, "email", 10), (7, "person_name", 23)}
    got = {r.id: r for r in entities.guardrail(df, "id").collect()}
    assert got[2].action == "block" and got[2].sent is None and got[4].sent == "nothing" and got[3].action == "allow"
    assert got[7].action == "anonymize" and got[7].sent == "my email: [EMAIL], [PII]"


def test_confidence_of_entities(spark):
    rows = [(1, "card 4111 1111 1111 1111"), (2, "4111 1111 1111 1112"), (3, "test x@y.org"), (4, "qq 529.982.247-25"), (5, "value 000000000")]
    df = spark.createDataFrame(rows, "id long, text string")
    conf = {(r.id, r.entity): round(r.confidence, 6) for r in entities.spans(df, "id").collect()}
    assert conf[1, "credit_card"] == 1.0  # .35 + .35 valid + .25 a word + .15 form + .1, at most 1
    assert conf[2, "credit_card"] == round(0.35 - 0.15 + 0.15 + 0.1, 6)
    assert conf[3, "email"] == round(0.35 + 0.35 + 0.1 + 0.1 - 0.3, 6)
    assert conf[4, "cpf"] == round(0.35 + 0.35 + 0.15 + 0.1, 6)
    strict = {(r.id, r.entity): round(r.confidence, 6) for r in entities.spans(df, "id", strict=True).collect()}
    assert strict[2, "credit_card"] == 0.1
    assert {e.locale for e in entities.selected(["br"])} == {"universal", "br"} and len(entities.selected()) == len(entities.ENTITIES) == 90


def test_replacing_and_storing(spark):
    df = spark.createDataFrame([(1, "a@b.org wrote to c@d.org"), (2, "none"), (3, None), (4, "at the end x@y.org")], "id long, text string")
    found = entities.spans(df, "id")
    assert {r.id: r.text for r in entities.replaced(df, found, "id").collect()} == {1: "[EMAIL] wrote to [EMAIL]", 2: "none", 3: None, 4: "at the end [EMAIL]"}
    key = F.lit("0123456789abcdef")
    sessions, kept = entities.stored(df, found, "id", key)
    assert sessions.count() == 4 and sorted(r.v for r in kept.select(checks.opened(F.col("sealed"), key).alias("v")).collect()) == ["a@b.org", "c@d.org", "x@y.org"]


def test_drift_without_changes(spark):
    s = spark.createDataFrame([("t", "a", "int", True, 0)], "table_name string, column_name string, type string, nullable boolean, position int")
    assert one(drift.drift_summary(drift.changes(s, s))).summary == "No schema changes detected"
    h = drift.snapshot_hash(s)
    assert drift.next_snapshots(h.withColumn("version", F.lit(1)), h).count() == 0 and drift.next_snapshots(h.limit(0).withColumn("version", F.lit(1)), h).first().version == 1


def test_query_log_shapes(spark):
    rows = [(1, 'SELECT * FROM "A"."B" x', "u"), (2, "insert into T select * from s.S JOIN q ON s.a = q.b", "u"), (3, "no table", "u")]
    log = spark.createDataFrame([(i, q, "2024-01-01 00:00:00", u, None) for i, q, u in rows], "log_id long, query string, ts string, user string, data_product string")
    got = {(r.log_id, r.asset, r.usage_type) for r in usage.usages(log).collect()}
    assert (2, "t", "etl_target") in got and (2, "s.s", "etl_source") in got and (2, "q", "etl_source") in got and not any(i == 3 for i, _, _ in got)


def test_definitions_of_one_source_conflict(spark):
    terms = spark.createDataFrame([("Churn", "left", "a"), ("churn ", "gone away", "a"), ("churn", "LEFT", "b"), ("other", "x", "a")], "term string, definition string, source string")
    assert [tuple(r) for r in governance.definition_conflicts(terms).collect()] == [("churn", "a", "a")]


def test_names_inside_catalog_names(spark):
    catalog = spark.createDataFrame([("db.sales_orders",), ("db.x",), ("db.sales_old",)], "name string")
    found = spark.createDataFrame([("sales_o",), ("X",), ("db.x",), ("none",), ("",), ("o",)], "name string")
    got = {r.name: (r.match, r.confidence) for r in governance.resolve_names(found, catalog).collect()}
    assert got == {"sales_o": ("db.sales_old", "low"), "X": ("db.x", "medium"), "db.x": ("db.x", "high"), "none": (None, None), "": (None, None), "o": ("db.sales_old", "low")}


@pytest.mark.parametrize("n", [3, 20, 21, 500])
def test_latency_takes_the_element(spark, n):
    values = [float((i * 37) % 101) ** 2 for i in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 5.0)] * 30 + [("c", None)], "g string, v double")
    got = {r.g: r for r in governance.latency_statistics(df, "g", "v").collect()}
    assert got["a"].p95 == (sorted(values)[int(0.95 * n)] if n > 20 else max(values)) and got["b"].p95 == 5.0 and got["a"].n == n and "c" not in got


def test_catalog_and_reports(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "x int, y string").createOrReplaceTempView("seen_view")
    assert {(r.table_name, r.column_name, r.type) for r in tables.catalog_columns(spark).collect()} >= {("seen_view", "x", "int"), ("seen_view", "y", "string")}
    spark.createDataFrame([("# T\nintro\n## One\nbody\n\n## Two\n",)], "value string").createOrReplaceTempView("md")
    assert [(r.seq, r.title, r.content) for r in tables.markdown_sections(spark.table("md")).collect()][1:] == [(1, "One", "body"), (2, "Two", "")]
    log = tmp_path / "t" / "_delta_log"
    log.mkdir(parents=True)
    for v in (0, 1):
        (log / f"{v:020}.json").write_text('{"commitInfo": {"operation": "W%d"}}\n{"add": {"path": "x"}}\n' % v)
    assert [(r.version, r.operation) for r in tables.delta_history(spark, str(tmp_path / "t")).collect()] == [(1, "W1"), (0, "W0")]
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n")
    assert tables.sample(tables.read_source(spark, "csv", str(tmp_path / "a.csv")), 5, most=1).count() == 1
    assert tables.read_source(spark, "table", "seen_view").count() == 1
