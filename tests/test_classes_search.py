"""Matching by classes against every pair evaluated by itself, and substring search against a scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import classes, matching, search, services

def now():
    return F.lit("2026-03-01 12:00:00").cast("timestamp_ntz")


KINDS = ["nationality", "cgpa", "field", "work_experience_months", "english_test_status", "application_window", "study_mode"]
WORDS = ["land 1", "land 2", "any", "not_required", "taken", "full_time", "3", "2.5", "2.50", "4", "many", "x"]


def drawn(spark, seed, n_profiles=60, n_opportunities=40):
    draw = random.Random(seed)
    some = lambda options, most: [draw.choice(options) for _ in range(draw.randint(0, most))]
    profiles = []
    for user in range(n_profiles):
        values = {k: v for k in KINDS if k != "application_window" and draw.random() < 0.8 and (v := some(WORDS + [str(draw.randint(0, 50) / 10)], 2)) is not None}
        profiles.append((user, draw.choice([None, "ma", "phd"]), values, draw.choice([None, 4, 5]), draw.choice([None, [], [" Land  1"], ["land 2", "LAND 1"]]), draw.choice([None, " ", "yes"])))
    rule = lambda: (draw.choice(KINDS), draw.choice(["in", "not_in", "equals", "gte", "lte"]), some(WORDS, 2) or ["3"], draw.random() < 0.5, draw.choice([None, 4, 5]))
    sets = [None, *[[rule() for _ in range(draw.randint(1, 3))] for _ in range(6)]]
    opportunities = []
    for o in range(n_opportunities):
        days = draw.choice([None, -1, 10, 200])
        deadline = None if days is None else f"2026-{3 + (days > 100) * 6:02d}-{11 if days > 0 else 1:02d} 12:00:00" if days != -1 else "2026-02-20 00:00:00"
        opportunities.append((o, draw.choice(["ma", "phd"]), draw.choice(sets), draw.choice(["open", "closed", "archived", "deadline_unknown"]), deadline, draw.choice(["Land 1", "land  2", "Land 3"]), draw.choice(["fully_funded", "partial", "unknown"])))
    p = spark.createDataFrame(profiles, "user_id long, target_degree string, profile_values map<string,array<string>>, scale int, preferred array<string>, need string")
    o = spark.createDataFrame(opportunities, "opportunity_id long, degree_level string, rules array<struct<rule_type:string,operator:string,required_values:array<string>,required:boolean,grading_scale:int>>, window_state string, deadline string, country string, funding string")
    return p, o.withColumn("deadline", F.col("deadline").cast("timestamp_ntz"))


def every_pair(p, o):
    pairs = p.join(o, F.col("target_degree").isNull() | (F.col("target_degree") == F.col("degree_level")))
    structured = F.col("rules").isNotNull()
    own = matching.structured_results(F.col("rules"), F.col("profile_values"), F.col("scale"), F.col("window_state"), normalized=True)
    rest = F.array(matching.deadline_result(F.col("deadline"), now()), matching.location_result(F.col("preferred"), F.col("country")), matching.funding_result(F.col("need"), F.col("funding")))
    eligible = F.when(structured, own).otherwise(matching.fallback_results(F.col("target_degree"), F.col("degree_level")))
    out = pairs.withColumn("results", F.concat(eligible, rest)).withColumn("failures", matching.hard_failures(F.col("window_state"), F.col("target_degree"), F.col("degree_level"), F.col("results")))
    return out.withColumn("s", matching.score_of(F.col("results"), structured, F.size("failures") > 0))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_score_as_every_pair_does(spark, seed):
    p, o = drawn(spark, seed)
    p_members, p_classes = classes.profile_classes(p, o)
    o_members, o_classes = classes.opportunity_classes(o, now())
    assert p_members.count() == 60 and o_members.count() == 40 and p_classes.count() <= 60
    pairs = classes.evaluated_classes(p_classes, o_classes, splits=3)
    spread = p_members.join(pairs, "profile_class").join(o_members, "opportunity_class")
    got = {(r.user_id, r.opportunity_id): (r.s, list(r.failures)) for r in spread.select("user_id", "opportunity_id", "s", "failures").collect()}
    want = {(r.user_id, r.opportunity_id): (r.s, list(r.failures)) for r in every_pair(p, o).select("user_id", "opportunity_id", "s", "failures").collect()}
    assert got == want and pairs.agg(F.sum(F.col("profiles") * F.col("opportunities"))).first()[0] == len(want)


def test_ranking_and_texts_go_back_to_profiles(spark):
    p, o = drawn(spark, 3)
    p_members, p_classes = classes.profile_classes(p, o)
    o_members, o_classes = classes.opportunity_classes(o, now())
    pairs = classes.evaluated_classes(p_classes, o_classes)
    ranked = classes.with_deadlines(classes.ranked_by_classes(pairs, p_members, o_members, 4, ["results"]), o, now())
    got = {(r.user_id, r["rank"]): (r.opportunity_id, [tuple(x) for x in r.results]) for r in ranked.collect()}
    scores = every_pair(p, o).select("user_id", "opportunity_id", "results", "s.*")
    want = {(r.user_id, r["rank"]): (r.opportunity_id, [tuple(x) for x in r.results]) for r in matching.ranked(scores, "user_id", F.col("opportunity_id")).filter("rank <= 4").collect()}
    assert got == want
    stored = classes.stored_outcomes(ranked, ["user_id", "opportunity_id"])
    assert stored.count() == sum(len(x[1]) for x in want.values())
    one = stored.filter("rule_name = 'location' AND outcome = 'satisfied'").first()
    assert (one.reason_code, one.profile_fields, one.weight, one.awarded_score) == ("match.location.satisfied", "preferred_destination_countries", 10, 10)


def test_values_that_no_rule_tells_apart_are_one_class(spark):
    _, o = drawn(spark, 1)
    rules = [("cgpa", "gte", ["2.5"], True, 4), ("cgpa", "lte", ["3"], True, 4), ("nationality", "in", ["land 1"], False, None)]
    o = o.limit(1).withColumn("rules", F.lit(None).cast(o.schema["rules"].dataType))
    o = o.unionByName(o.withColumn("opportunity_id", F.lit(99).cast("long")).withColumn("rules", F.array(*[F.struct(F.lit(k).alias("rule_type"), F.lit(op).alias("operator"), F.array(*map(F.lit, v)).alias("required_values"), F.lit(r).alias("required"), F.lit(g).cast("int").alias("grading_scale")) for k, op, v, r, g in rules])))
    values = [{"cgpa": ["2.6"]}, {"cgpa": ["2.75"]}, {"cgpa": ["2.5"]}, {"cgpa": ["3.0"]}, {"cgpa": ["9"]}, {"cgpa": ["8"]}, {"nationality": ["land 7"]}, {"nationality": ["land 8"]}, {"nationality": ["land 1"]}, {"gre_status": ["x"]}, {}]
    p = spark.createDataFrame([(i, None, v, 4, None, None) for i, v in enumerate(values)], "user_id long, target_degree string, profile_values map<string,array<string>>, scale int, preferred array<string>, need string")
    members = {r.user_id: r.profile_class for r in classes.profile_classes(p, o)[0].collect()}
    same = lambda *users: len({members[u] for u in users}) == 1
    assert same(0, 1) and same(4, 5) and same(6, 7) and same(9, 10) and len(set(members.values())) == 7


def like(text, pattern):
    return re.search("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), text, re.S) is not None


def test_like_matches_a_scan(spark):
    draw = random.Random(5)
    texts = [(i, "".join(draw.choices("abc %_", k=draw.randint(0, 12)))) for i in range(80)] + [(100, None), (101, ""), (102, "x" * 3000 + "abcab" + "y" * 3000)]
    patterns = ["abc", "a", "ab", "a_c", "ab%ca", "abcab", "zzz", "a%b", "_a_", "bca", "cab c", " ", "abca%zz"]
    df = spark.createDataFrame(texts, "key long, text string")
    asked = spark.createDataFrame([(x,) for x in [*patterns, None, "%", "_%", "abc"]], "pattern string")
    got = sorted(tuple(r) for r in search.like_matches(asked, df).collect())
    assert got == sorted((p, k) for p in patterns for k, text in texts if text is not None and like(text, p))


def test_first_matches_are_cut_by_id(spark):
    rows = [(i, "the same text" if i % 2 else f"text {i}", "accepted") for i in range(100)]
    records = spark.createDataFrame(rows, "id long, text string, evidence string")
    asked = spark.createDataFrame([("text",), ("same",), ("text 98",)], "pattern string")
    got = {r.pattern: [x.id for x in r.held] for r in search.first_matches(asked, records, 5).collect()}
    assert got == {"text": [0, 1, 2, 3, 4], "same": [1, 3, 5, 7, 9], "text 98": [98]}
    questions = spark.createDataFrame([(1, ["same", "text 98"]), (2, []), (3, ["none"])], "q long, tokens array<string>")
    held = {r.q: [x.id for x in r.held] for r in services.candidates(questions, records, ["q"], 4).collect()}
    assert held == {1: [1, 3, 5, 7], 2: [0, 1, 2, 3], 3: []}


def test_like_names_are_found_through_few_characters(spark):
    """Every pair of a block that reaches the similarity, as comparing all pairs finds it, from far fewer candidates."""
    from difflib import SequenceMatcher

    from tessera.operators import dedup

    draw = random.Random(9)
    words = ["small", "ring", "bolt", "large", "steel", "cog", "valve", "pipe", "brass"]
    names = {" ".join(draw.choices(words, k=draw.randint(1, 3))) for _ in range(120)} | {"", "a", "aa", "aab", "é ring", "e ring"}
    names |= {n.replace("l", "1", 1) for n in sorted(names)[:40]}
    rows = [(i, n, draw.choice("uv")) for i, n in enumerate(sorted(names))]
    df = spark.createDataFrame(rows, "id long, name string, block string")
    for least in (0.8, 0.6):
        candidates = {(r.block, r.x, r.y) for r in dedup.like_candidates(df.select("block", "name").distinct(), least).collect()}
        ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
        pairs = [(b, *sorted((x, y))) for i, x, b in rows for j, y, c in rows if b == c and x < y]
        reaching = {p for p in pairs if max(ratio(p[1], p[2]), ratio(p[2], p[1])) >= least}
        assert reaching <= candidates and len(candidates) < len(pairs) / 2
        got = {(r.id, r.other) for r in dedup.class_suggestions(df, least).collect()}
        place = {(b, n): i for i, n, b in rows}
        assert got == {(max(i, j), min(i, j)) for i, x, b in rows for j, y, c in rows if b == c and i > j and ratio(x, y) >= least} and place


def test_words_find_what_texts_hold(spark):
    """Tokens looked up in words give what the search in whole texts gives, in words over LONG_WORD characters too."""
    long = "x" * 30 + "token7" + "y" * 30
    rows = [(i, ["a token of", long, "Tokens;tok", "xtoken7x", "to ken", None, ""][i % 7], "accepted") for i in range(60)] + [(3, "token again", "stale")]
    records = spark.createDataFrame(rows, "id long, text string, evidence string")
    asked = spark.createDataFrame([("token",), ("token7",), ("tok",), ("xxx",), ("ken",), ("none",), ("y" * 31,), ("x" * 25 + "x",)], "pattern string")
    of = lambda f: {r.pattern: [(x.id, x.evidence) for x in r.held] for r in f(asked, records, 5).collect()}
    assert of(search.first_holding) == of(search.first_matches)
    assert [x for x, _ in of(search.first_holding)["token7"]] == [1, 3, 8, 10, 15]


SMALL = "/root/testdata/sf0.001"


def test_searches_at_once_give_each_search_rows_and_read_sources_once(spark):
    from tessera.operators import catalogue
    from tessera.plans import QUERIES
    from tessera.plans import search as plan
    from tessera.plans.registry import ORDER_CLOCK, Tables, clock

    o, s, r = plan.tables(Tables(spark, SMALL))
    found = catalogue.searched(o, s, r, clock(ORDER_CLOCK), [f for f, _ in plan.SEARCHES]).select("search", "opportunity_id").collect()
    for i in (1, 4, 5, 7, 9):
        alone = catalogue.public(o, s, r, clock(ORDER_CLOCK), plan.SEARCHES[i][0]).select("opportunity_id").collect()
        assert sorted(x.opportunity_id for x in found if x.search == i) == sorted(x.opportunity_id for x in alone), i
    text = QUERIES["public_search"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("l_partkey") and text.count("Relation [l_orderkey") == 1


def test_profile_values_meet_the_kinds_of_rules_in_many_tasks(spark):
    from tessera.plans import rules
    from tessera.plans.registry import Tables

    text = rules.classed(Tables(spark, SMALL))[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [user_id" in text and "rightHint=(strategy=broadcast)" in text
