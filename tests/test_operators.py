import hashlib
import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.operators import audit, dedup, ingest, matching, metrics, monitor, relational, retention, transitions
from tessera.operators.security import Policy, secured
from tessera.sources import readers
from tessera.streaming import stateful

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize(
    ("actual", "operator", "required", "expected"),
    [
        (["pakistan"], "in", [" Pakistan ", "india"], True),
        (["pakistan"], "not_in", ["pakistan"], False),
        (["law", "computer science"], "in", ["Computer  Science"], True),
        (["law", "medicine"], "not_in", ["medicine"], False),
        (["any"], "equals", ["full_time"], True),
        (["any"], "not_in", ["x"], True),
        (["3.5"], "gte", ["3.0"], True),
        (["3.5"], "lte", ["3.0"], False),
        (["high"], "gte", ["3"], False),
    ],
)
def test_compare(spark, actual, operator, required, expected):
    df = spark.createDataFrame([(actual, operator, required)], "a array<string>, o string, r array<string>")
    assert df.select(matching.compare(F.col("a"), F.col("o"), F.col("r"))).first()[0] is expected


def test_structured_outcomes(spark):
    rows = [
        ("cgpa", ["3.5"], "gte", ["3.0"], 4.0, 4.0, "satisfied"),
        ("cgpa", ["3.5"], "gte", ["3.0"], 4.0, 5.0, "unknown"),
        ("cgpa", ["3.5"], "gte", ["3.0"], None, 4.0, "unknown"),
        ("nationality", None, "in", ["x"], None, None, "unknown"),
        ("nationality", [], "in", ["x"], None, None, "unknown"),
        ("gre_status", ["not_required"], "equals", ["taken"], None, None, "unknown"),
        ("gre_status", ["planned"], "equals", ["taken"], None, None, "failed"),
    ]
    df = spark.createDataFrame(rows, "k string, a array<string>, o string, r array<string>, s double, t double, want string")
    for row in df.withColumn("got", matching.structured_outcome(*[F.col(c) for c in "kaorst"])).collect():
        assert row.got == row.want, row


def results(spark):
    rows = [
        (1, 10, 0, "eligibility", 15, "satisfied", False, True, "a"), (1, 10, 1, "eligibility", 15, "failed", False, True, "b"), (1, 10, 2, "preference", 10, "unknown", False, True, "c"),
        (1, 11, 0, "eligibility", 15, "failed", True, True, "a"), (1, 11, 1, "preference", 10, "satisfied", False, True, "b"),
        (1, 12, 0, "eligibility", 20, "satisfied", False, False, "a"), (1, 12, 1, "freshness", 10, "failed", False, False, "b"),
    ]
    return spark.createDataFrame(rows, "p int, o int, place int, category string, weight int, outcome string, hard boolean, structured boolean, message string")


def test_scores_separate_preference_and_exclude_hard_failures(spark):
    got = {r.o: r for r in matching.scored(results(spark), ["p", "o"]).collect()}
    assert (got[10].score, got[10].preference_fit, got[10].completeness, got[10].status) == (50, None, 67, "requires_verification")
    assert (got[11].score, got[11].preference_fit, got[11].status) == (0, 100, "ineligible")
    assert (got[12].score, got[12].status) == (100, "unknown")
    ranks = matching.ranked(matching.scored(results(spark), ["p", "o"]), "p", F.col("o")).orderBy("rank").collect()
    assert [r.o for r in ranks] == [12, 10, 11]


def test_explanations_keep_rule_order(spark):
    got = {r.o: r for r in matching.explained(results(spark), ["p", "o"]).collect()}
    assert (got[10].satisfied, got[10].missing, got[10].uncertain) == (["a"], ["b"], ["c"])


def test_audit_chain_and_tampering(spark):
    rows = [(f"c{i % 3}", i, f"action {i}", None if i == 4 else i) for i in range(30)]
    chain = audit.build_chain(spark.createDataFrame(rows, "chain string, id long, action string, entity long"), "chain", ["id"], ["id", "action", "entity"]).cache()
    assert audit.broken_links(chain, "chain", ["id"], ["id", "action", "entity"]).count() == 0
    first = chain.filter("id = 0").first()
    assert first.integrity_hash == hashlib.sha256(f"{audit.FIRST}|0|action 0|0".encode()).hexdigest()
    forged = chain.withColumn("action", F.when(F.col("id") == 9, "forged").otherwise(F.col("action")))
    assert [r.id for r in audit.broken_links(forged, "chain", ["id"], ["id", "action", "entity"]).collect()] == [9]
    assert [r.id for r in audit.broken_links(chain.filter("id <> 9"), "chain", ["id"], ["id", "action", "entity"]).collect()] == [12]


def test_limiter_ignores_denied_requests(spark):
    seconds = [0, 1, 2, 3, 9, 10, 11, 12]
    df = spark.createDataFrame([("k", T0 + timedelta(seconds=s), s) for s in seconds], "key string, ts timestamp, event_id long")
    got = {r.event_id: (r.allowed, r.retry_after) for r in stateful.sliding_limits(df, 2, 10).collect()}
    assert got[0] == got[1] == (True, 0) and got[2] == (False, 8) and got[3] == (False, 7)
    assert got[9] == (False, 1) and got[10] == (True, 0) and got[11] == (True, 0) and got[12] == (False, 8)


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", T0 + timedelta(seconds=7 * i), i) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, event_id long")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = stateful.sliding_limits_stream(stream, 2, 60).writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("limits").collect()} == {tuple(r) for r in stateful.sliding_limits(df, 2, 60).collect()}
    counts = stateful.windowed_counts(stream, "1 minute", "10 minutes", "key").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 60


def test_hash_changes_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", "h1"), ("a", "h1"), ("a", "h2"), ("b", "x")], "source_id string, content_hash string").coalesce(1)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = stateful.hash_changes_stream(stream).writeStream.format("memory").queryName("hashes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("hashes").collect()) == [("a", "changed"), ("a", "initialised"), ("a", "unchanged"), ("b", "initialised")]


def test_monitoring_applies_changes(spark):
    sources = spark.createDataFrame([(1, "h", "verified", T0), (2, None, "verified", T0), (3, "h", "verified", T0), (4, "h", "verified", T0)], "id int, content_hash string, verification_status string, last_updated_at timestamp")
    found = monitor.changes(sources, spark.createDataFrame([(1, "h"), (2, "n"), (3, "x"), (4, None)], "id int, observed_hash string"), "id")
    assert {r.id: r.change for r in found.collect()} == {1: "unchanged", 2: "initialised", 3: "changed", 4: "failed"}
    after = {r.id: r for r in monitor.applied(sources, found, "id", F.lit(T0 + timedelta(days=1))).collect()}
    assert after[3].verification_status == "needs_review" and after[3].content_hash == "x" and after[4].last_updated_at == T0


def test_fuzzy_duplicates(spark):
    rows = [(1, "global masters award", "p|de", "u1"), (2, "global master award", "p|de", None), (3, "something else entirely", "p|de", "u1"), (4, "global masters award", "q|de", None)]
    df = spark.createDataFrame(rows, "id long, name string, block string, url string")
    got = {(r.id, r.other): r.score for r in dedup.suggestions(df).collect()}
    assert got.keys() == {(2, 1), (3, 1)} and got[(3, 1)] == 0.95 and got[(2, 1)] > 0.9
    known = spark.createDataFrame([(2, 1)], "id long, other long")
    assert {(r.id, r.other) for r in dedup.suggestions(df, known=known).collect()} == {(3, 1)}
    assert "CartesianProduct" not in dedup.suggestions(df)._jdf.queryExecution().toString()


def test_transitions(spark):
    df = spark.createDataFrame([("saved", "preparing"), ("saved", "accepted"), ("accepted", "saved"), ("nowhere", "saved")], "a string, b string")
    assert [r[0] for r in df.select(transitions.allowed(transitions.APPLICATION, F.col("a"), F.col("b"))).collect()] == [True, False, False, False]
    reviews = transitions.reviewed(spark.createDataFrame([("publish", None), ("expire", " "), ("expire", "gone"), ("bogus", "x")], "action string, notes string")).collect()
    assert [(r.outcome, r.status) for r in reviews] == [("applied", "active"), ("notes_required", None), ("applied", "expired"), ("unsupported", None)]


def test_nearest_rank_and_histogram(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (10, 60, 110, 300, 6000)], "route string, ms double")
    r = metrics.nearest_rank(df, "route", "ms", [0.5, 0.95]).first()
    assert (r.p50, r.p95, r["max"], r.n) == (110.0, 6000.0, 6000.0, 5)
    h = {x.bucket: x.n for x in metrics.histogram(df, "route", "ms").collect()}
    assert sum(h.values()) == 5 and len(h) == 8 and h["gt_5000"] == 1 and h["le_1000"] == 0


def test_retention_keeps_null_dates(spark):
    parents = spark.createDataFrame([(1, T0), (2, None), (3, T0 + timedelta(days=9))], "id int, at timestamp")
    left, kids = retention.purge_with_children(parents, {"c": spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")}, "id", F.col("at") <= F.lit(T0))
    assert {r.id for r in left.collect()} == {2, 3} and [r.v for r in kids["c"].collect()] == ["y"]
    kept = retention.purge_unused(parents, spark.createDataFrame([(1,), (None,)], "id int"), "id", F.col("at").isNotNull())
    assert {r.id for r in kept.collect()} == {1, 2}


def test_row_security(spark):
    tables = {"child": spark.createDataFrame([(1, 10), (2, 20)], "id int, parent int"), "parent": spark.createDataFrame([(10, "a"), (20, "b")], "key int, owner string"), "other": spark.range(3)}
    policies = {"parent": Policy(owner="owner"), "child": Policy(parent="parent", on=("parent", "key"))}
    seen = secured(tables, policies, "a")
    assert [r.id for r in seen["child"].collect()] == [1] and seen["other"].count() == 0
    assert secured(tables, policies, None)["parent"].count() == 0 and secured(tables, policies, None, bypass=True)["other"].count() == 3
    with pytest.raises(ValueError):
        secured({"x": tables["child"]}, {"x": Policy(parent="x", on=("id", "id"))}, "a")


def test_keyed_writes(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, version int")
    updates = spark.createDataFrame([(1, 1, "x"), (2, 4, "y"), (3, 1, "z")], "id int, expected_version int, v string")
    got = {r.id: (r.outcome, r.v, r.version) for r in relational.versioned_update(stored, updates, "id", ["v"]).collect()}
    assert got == {1: ("updated", "x", 2), 2: ("conflict", "b", 5), 3: ("not_found", None, None)}
    patches = spark.createDataFrame([(1, ["v"], None)], "id int, fields_set array<string>, v string")
    assert {r.id: (r.v, r.version) for r in relational.patched(stored, patches, "id", ["v"]).collect()} == {1: (None, 2), 2: ("b", 5)}
    new = relational.insert_absent(stored.select("id"), spark.createDataFrame([(2, 1), (3, 2), (3, 1)], "id int, n int"), ["id"], F.col("n"))
    assert [(r.id, r.n) for r in new.collect()] == [(3, 1)]
    with pytest.raises(ValueError):
        relational.page(stored, [F.col("id")], 0)


CSV = '﻿Name,Provider Name,country,funding-type,required documents,source url\nMasters,DAAD,Germany,full,"a; b;",https://x.org\n=cmd,P,UK,,,\n,,,,,\n'


def test_csv_import(spark, tmp_path):
    (tmp_path / "in.csv").write_text(CSV)
    raw = readers.csv_rows(spark, str(tmp_path / "in.csv"))
    rows = readers.import_rows(raw).orderBy("row_number").collect()
    assert [r.row_number for r in rows] == [2, 3]
    assert rows[0].required_documents == ["a", "b"] and rows[0].funding_type == "unknown" and rows[0].source.verification_status == "needs_review" and len(rows[0].warnings) == 1
    assert rows[1].name == "'=cmd" and rows[1].source is None and rows[1].warnings == ["name: Formula-like value was neutralized"]
    (tmp_path / "bad.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        readers.csv_rows(spark, str(tmp_path / "bad.csv"))


def test_json_seed(spark, tmp_path):
    (tmp_path / "seed.json").write_text('{"dataset_name": "d", "records": [{"name": "a"}, {"name": "b"}]}')
    from pyspark.sql import types as T

    assert readers.seed_records(spark, [str(tmp_path / "seed.json")], T.StructType([T.StructField("name", T.StringType())])).count() == 2


def test_import_outcomes(spark):
    schema = "row_number long, name string, provider_name string, country string, degree_level string, intake_year string, funding_type string"
    rows = [
        (2, "Masters", "DAAD", "Germany", "masters", None, None), (3, "masters ", "daad", "germany", "masters", None, None), (4, "x", "DAAD", "Germany", "masters", None, None),
        (5, "Bachelors", "DAAD", "Germany", "bachelors", "2026", None), (6, "Doctors", "DAAD", "Germany", None, None, None), (7, "Others", "DAAD", "Germany", "masters", None, "full"),
    ]
    existing = spark.createDataFrame([("bachelors", "daad", "germany", "2026")], "name string, provider_name string, country string, intake_year string")
    got = {r.row_number: r for r in ingest.outcomes(spark.createDataFrame(rows, schema), existing).collect()}
    assert {n: r.outcome for n, r in got.items()} == {2: "importable", 3: "duplicate", 4: "invalid", 5: "duplicate", 6: "invalid", 7: "invalid"}
    assert "degree_level: Field required" in got[6].errors and "Funding type is unknown" in got[2].quality_warnings


def expanded(rows, found):
    """All pairs (id, other): score, newer id first, that the class rows and the representatives' rows stand for."""
    name, block = {i: n for i, n, _ in rows}, {i: b for i, _, b in rows}
    first = {i: i for i in name} | {r.id: r.other for r in found if r.copies is not None}
    for r in found:
        assert r.copies is None or (r.score == 1.0 and r.copies == sum(o == r.other for o in first.values()))
    out = {(i, j): 1.0 for i in name for j in name if i > j and first[i] == first[j]}
    for r in found:
        if r.copies is None:
            of = lambda k: [i for i in name if (name[i], block[i]) == (name[k], block[k])]
            assert min(of(r.id)) == r.id and min(of(r.other)) == r.other
            out |= {(i, j): r.score for i in of(r.id) for j in of(r.other) if i > j}
    return out


def brute_pairs(rows, least=0.8):
    out = {}
    for i, x, b in rows:
        for j, y, c in rows:
            if i > j and x is not None and y is not None and (x == y or b == c):
                score = SequenceMatcher(None, x, y).ratio()
                if score >= least:
                    out[i, j] = round(score, 4)
    return out


def test_class_suggestions_match_brute_force(spark):
    draw = random.Random(6)
    names = [None, "", "abab", "baba", "ababa", "small ring", "small rings", "smal ring", "ring small", "red ring", "tide", "diet", "tided", "dieti"]
    names += ["".join(draw.choice("ab") for _ in range(8)) for _ in range(20)]
    rows = [(i, draw.choice(names), draw.choice(["p|de", "p|fr", "q|de"])) for i in range(220)]
    found = dedup.class_suggestions(spark.createDataFrame(rows, "id long, name string, block string")).collect()
    assert expanded(rows, found) == brute_pairs(rows)
    assert len(found) == len({(r.id, r.other) for r in found if r.copies is None}) + sum(r.copies is not None for r in found)


def test_parts_that_share_a_name_across_brands(spark):
    rows = [(r.p_partkey, r.p_name.lower(), f"{r.p_brand}|{r.p_type}") for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()]
    expected = brute_pairs(rows)
    block = {i: b for i, _, b in rows}
    assert any(block[i] != block[j] for i, j in expected)
    found = plans.QUERIES["dup_pairs_fuzzy"](spark, "/root/testdata/sf0.001").collect()
    assert expanded(rows, found) == expected and len(found) < len(expected)


def test_all_policies_for_all_tenants_at_once(spark):
    from tessera.operators.security import POLICIES, order_of, owned

    assert len(POLICIES) == 30 and sum(not p.all_parents() for p in POLICIES.values()) == 11
    order = order_of(POLICIES)
    assert all(order.index(p.table) < order.index(t) for t, policy in POLICIES.items() for p in policy.all_parents())
    frame = lambda rows, columns: spark.createDataFrame(rows, columns)
    tables = {
        "document_assets": frame([(1, "a"), (2, "b")], "id int, user_id string"),
        "document_versions": frame([(10, "a", 1), (11, "a", 2), (12, "b", 2), (13, None, 2)], "id int, user_id string, asset_id int"),
        "document_consents": frame([(20, "a", 10), (21, "b", 12)], "id int, user_id string, version_id int"),
        "document_analyses": frame([(30, "a", 10, 20), (31, "b", 12, 20), (32, "b", 12, 21)], "id int, user_id string, version_id int, consent_id int"),
        "document_feedback_items": frame([(40, 30), (41, 31), (42, 32), (43, None)], "id int, analysis_id int"),
        "document_analysis_jobs": frame([(50, "a", 10, None), (51, "a", 10, 30), (52, "a", 10, 32), (53, "b", 12, 99)], "id int, user_id string, version_id int, analysis_id int"),
        "match_rule_outcomes": frame([(60, 1)], "id int, evaluation_result_id int"),
        "unknown": frame([(1,)], "id int"),
    }
    all_ = owned(tables, POLICIES)
    for tenant in ("a", "b", "c"):
        own = secured(tables, POLICIES, tenant)
        for name in tables:
            assert sorted(r.id for r in own[name].collect()) == sorted(r.id for r in all_[name].filter(F.col("_owner") == tenant).collect()), (tenant, name)
    seen = {(name, r.id): r["_owner"] for name in tables for r in all_[name].collect()}
    assert {i for (_, i), o in seen.items() if o == "a"} == {1, 10, 20, 30, 40, 50, 51} and {i for (_, i), o in seen.items() if o == "b"} == {2, 12, 21, 32, 42}
