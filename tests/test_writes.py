"""Exactly-once loads, sequences of versioned updates and deletes over foreign keys, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.operators.foreign_keys import SET_NULL, ForeignKey, deleted, order_of
from tessera.operators.relational import update_sequence, updated_rows
from tessera.sources.catalogue import Catalogue

ROW = "row_number long, name string, provider_name string, country string, degree_level string, intake_year int, provider_website_url string, sources array<struct<url:string,title:string,relevant_excerpt:string>>"


def submitted():
    source = [("https://a.example", "Official call", "Stated on the official page."), ("https://b.example", "Second page", "Stated on another official page.")]
    name = lambda i: f"Grant {i % 7}" if i % 5 else " x "
    return [(i, name(i), f"Provider {i % 3}" if i % 2 else f" provider {i % 3}", "DE", "masters" if i % 11 else None, 2025, f"https://p{i}.example" if i % 4 == 1 else None, source[: 1 + i % 2]) for i in range(60)]


def contents(catalogue):
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    return [rows(catalogue.table("opportunities").drop("batch")), rows(catalogue.providers()), rows(catalogue.table("sources").drop("batch")), rows(catalogue.summary())]


def test_a_killed_stream_loads_what_a_clean_run_loads(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame(submitted()[20 * i : 20 * i + 20], ROW).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)

    def run(folder, then):
        catalogue = Catalogue(spark, str(tmp_path / folder))
        query = stream().writeStream.foreachBatch(lambda df, b: catalogue.load(df, b, lambda: then(b))).option("checkpointLocation", str(tmp_path / f"{folder}-checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        return catalogue

    clean = run("clean", lambda b: None)
    killed = []

    def kill(b):
        if b == 1 and not killed:
            killed.append(b)
            raise RuntimeError("killed between its writes and its entry")

    with pytest.raises(Exception, match="killed"):
        run("torn", kill)
    torn = Catalogue(spark, str(tmp_path / "torn"))
    assert torn.committed() == [0] and torn.table("opportunities").count() < clean.table("opportunities").count()
    torn = run("torn", kill)
    assert killed == [1] and torn.committed() == clean.committed() == [0, 1, 2] and contents(torn) == contents(clean)
    assert not torn.load(spark.createDataFrame(submitted()[:20], ROW), 0) and contents(torn) == contents(clean)
    by_outcome = dict(map(tuple, clean.summary().collect()))
    assert by_outcome["importable"] == clean.table("opportunities").count() == len({(r[1].lower(), r[2].strip().lower()) for r in submitted() if r[0] % 5 and r[0] % 11})
    firsts = {}
    for r in submitted():
        firsts.setdefault((r[1].lower(), r[2].strip().lower()), r) if r[0] % 5 and r[0] % 11 else None
    sites = {}
    for r in firsts.values():
        sites[r[2].strip().lower()] = sites.get(r[2].strip().lower()) or r[6]
    assert {r.name.lower(): r.website_url for r in clean.providers().collect()} == sites


def test_nothing_is_read_before_the_first_entry(spark, tmp_path):
    empty = Catalogue(spark, str(tmp_path / "none"))
    assert empty.committed() == [] and empty.table("opportunities") is None and empty.providers() is None and empty.summary() is None


def test_rules_and_cycles_of_a_row_are_checked(spark):
    rule = "struct<rule_type:string,operator:string,value:string,unit:string,grading_scale:string,confidence:string,curator_notes:string>"
    cycle = "struct<intake_year:int,application_opening_date:string,application_deadline:string,timezone:string>"
    rules = [
        ("cgpa", "gte", "3.5", None, "4", None, None), ("cgpa", "gte", "3.5", None, None, None, None), ("nationality", "in", '["x"]', None, None, "high", None), ("nationality", "in", '["x", 1]', None, None, None, None), ("ielts", "in", '[1, "x"]', None, None, None, None),
        ("ielts", "equals", "true", None, None, None, None), ("gre", "gte", "not json", None, None, None, None), ("toefl", "lte", "80", None, "0", None, None), ("nationality", None, '"x"', None, None, None, None), ("field", "in", "[]", None, None, None, None),
    ]
    cycles = [(2025, "2025-02-01", "2025-01-01", "UTC"), (1999, None, None, None), (None, None, None, " Europe/Berlin "), (None, None, None, "Mars/Base")]
    df = spark.createDataFrame([("Grant", rules, cycles, "masters"), ("Grant", None, None, "doctor")], f"name string, eligibility_rules array<{rule}>, application_cycles array<{cycle}>, degree_level string")
    first, second = (r[0] for r in df.select(ingest.validation_errors(df)).collect())
    at = {m.split(": ")[0]: m.split(": ", 1)[1] for m in first}
    assert set(at) == {*[f"eligibility_rules.{i}" for i in (1, 3, 4, 5, 6, 7, 8)], *[f"application_cycles.{i}" for i in (0, 1, 3)]}
    assert at["eligibility_rules.1"] == "CGPA rules require a grading_scale" and at["eligibility_rules.4"] == at["eligibility_rules.5"] == "Numeric eligibility rules require numeric values" and at["eligibility_rules.6"] == "value: Field required"
    assert second == ["degree_level: Input should be one of bachelors, masters, phd, postdoc, short_course"]


def test_updates_see_the_version_left_before(spark):
    draw = random.Random(2)
    stored = {k: draw.randint(0, 2) for k in range(8)}
    updates = [(draw.choice([*range(10), 3, 3, 3, None]), i, draw.choice([None, 0, 1, 2, 3, 4, 5]), draw.choice([["a"], ["a", "b"], ["b"], []]), draw.choice([None, f"a{i}"]), f"b{i}") for i in range(300)]
    versions, rows, outcomes = dict(stored), {k: ["old", "old"] for k in stored}, {}
    for key, at, expected, fields, a, b in updates:
        if key is None or key not in versions:
            outcomes[at] = ("not_found", None)
        elif expected in (None, versions[key]):
            versions[key] += 1
            rows[key] = [a if "a" in fields else rows[key][0], b if "b" in fields else rows[key][1]]
            outcomes[at] = ("updated", versions[key])
        else:
            outcomes[at] = ("conflict", versions[key])
    existing = spark.createDataFrame([(k, v, "old", "old") for k, v in stored.items()], "k long, version long, a string, b string")
    decided = update_sequence(existing, spark.createDataFrame(updates, "k long, at long, expected_version long, fields_set array<string>, a string, b string"), "k", "at")
    assert {r["at"]: (r.outcome, r.version) for r in decided.collect()} == outcomes
    got = {r.k: (r.version, [r.a, r.b]) for r in updated_rows(existing, decided, "k", ["a", "b"], "at").collect()}
    assert got == {k: (versions[k], rows[k]) for k in stored}


def test_deletes_follow_the_graph(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = [ForeignKey("post", "owner", "person", "id"), ForeignKey("post", "parent", "post", "id"), ForeignKey("post", "pinned", "post", "id", SET_NULL), ForeignKey("note", "post", "post", "id", SET_NULL), ForeignKey("note", "author", "person", "id")]
    assert order_of(["note", "post", "person"], edges) == ["person", "post", "note"]
    person = spark.createDataFrame([(i,) for i in range(4)], "id long")
    # A chain of 30 replies under post 0, which goes with its owner; post 100 stands apart.
    posts = [(i, 0 if i == 0 else 1, i - 1 if 0 < i < 30 else None, None) for i in range(30)] + [(100, 2, None, 5), (101, 2, 100, 100), (102, None, 999, None)]
    post = spark.createDataFrame(posts, "id long, owner long, parent long, pinned long")
    note = spark.createDataFrame([(1, 29, 1), (2, 100, 1), (3, 100, 0), (4, None, None)], "n long, post long, author long")
    left = deleted({"note": note, "post": post, "person": person}, edges, {"person": F.col("id") == 0, "note": F.col("n") > F.lit(None).cast("long")})
    assert sorted(r.id for r in left["person"].collect()) == [1, 2, 3]
    assert sorted((r.id, r.pinned) for r in left["post"].collect()) == [(100, None), (101, 100), (102, None)]
    assert sorted(((r.n, r.post) for r in left["note"].collect()), key=str) == [(1, None), (2, 100), (4, None)]


def test_cycles_of_several_tables_are_refused():
    with pytest.raises(ValueError):
        order_of(["a", "b"], [ForeignKey("a", "x", "b", "id"), ForeignKey("b", "y", "a", "id")])


def test_nested_export_is_json_in_order(spark, tmp_path):
    import json

    from tessera.operators.export import nested_json, written_nested

    parents = spark.createDataFrame([(1, 'a "quoted" one'), (2, None), (3, "]}"), (None, "x")], "k long, name string")
    posts = spark.createDataFrame([(1, i, f"p{i}") for i in range(30, 0, -1)] + [(9, 1, "orphan"), (None, 2, "none"), (3, 1, "]}")], "k long, n int, text string")
    notes = spark.createDataFrame([(2, 5), (2, 4)], "k long, n int")
    fragments = nested_json(parents, "k", ["k", "name"], {"posts": (posts, ["n", "text"], ["n"]), "notes": (notes, ["n"], ["n"])})
    texts = {}
    for r in sorted(fragments.collect(), key=lambda r: (r.k, r.section, r.place)):
        texts[r.k] = texts.get(r.k, "") + r.fragment
    want = {1: {"k": 1, "name": 'a "quoted" one', "posts": [{"n": i, "text": f"p{i}"} for i in range(1, 31)], "notes": []}, 2: {"k": 2, "name": None, "posts": [], "notes": [{"n": 4}, {"n": 5}]}, 3: {"k": 3, "name": "]}", "posts": [{"n": 1, "text": "]}"}], "notes": []}}
    assert {k: json.loads(t) for k, t in texts.items()} == want
    written_nested(fragments, "k", str(tmp_path / "out"))
    lines = [x for f in (tmp_path / "out").glob("part-*") for x in f.read_text().split("\n") if x.strip()]
    assert {json.loads(x)["k"]: json.loads(x) for x in lines} == want


def test_parts_of_large_tables_hold_a_bounded_number_of_rows(spark, monkeypatch):
    from tessera.operators import relational
    from tessera.plans import QUERIES

    monkeypatch.setattr(relational, "PART_ROWS", 500)  # sf0.001 has about 6,000 lines
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    for name in ("cascade_graph", "dashboard_lists"):
        text = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert f", {-(-lines // 500)}" in text and "RepartitionByExpression" in text, name
