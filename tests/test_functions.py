from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar, temporal

NOW = datetime(2026, 8, 11, 12)


def value(spark, column, **fields):
    names = {k: "string" if isinstance(v, str) or v is None else None for k, v in fields.items()}
    schema = ", ".join(f"{k} {t or ('timestamp' if isinstance(v, datetime) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'bigint')}" for (k, t), v in zip(names.items(), fields.values(), strict=True))
    return spark.createDataFrame([tuple(fields.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("  Hello, World! ", "hello-world"), ("---", ""), ("a" * 200, "a" * 120), ("Ünïcode x", "n-code-x"), (None, None), ("-a" * 100, ("a-" * 100)[:120])],
)
def test_slug_strips_before_it_cuts(spark, text, expected):
    assert value(spark, scalar.slug(F.col("t")), t=text) == expected


def test_slug_default(spark):
    assert value(spark, scalar.slug(F.col("t"), default="catalogue-record"), t="!!") == "catalogue-record"


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTPS://Example.COM/A/b/?z=1&a=2&a=1#frag", "https://example.com/A/b?a=1&a=2&z=1"),
        ("http://x.org", "http://x.org/"),
        (" http://x.org/?q= ", "http://x.org/?q="),
        ("http://x.org/a?q=a b", "http://x.org/a?q=a+b"),
        (None, None),
    ],
)
def test_canonical_url(spark, url, expected):
    assert value(spark, scalar.canonical_url(F.col("t")), t=url) == expected


def test_evidence_ignores_scripts_and_clocks(spark):
    pages = ["<html><script>var a=1;</script><p>Apply by May</p> 12:30 deadbeefdeadbeef01</html>", "<html><SCRIPT type=x>var b=2;</script><p>Apply by May</p> 09:15:59 </html>"]
    hashes = {value(spark, scalar.content_hash(scalar.evidence_text(F.col("t"))), t=p) for p in pages}
    assert len(hashes) == 1


def test_evidence_section(spark):
    section = lambda t: value(spark, scalar.evidence_section(F.col("t")), t=t)
    assert section("too short") is None
    assert section("nothing of note in this text").label == scalar.GENERAL_EVIDENCE
    found = section("x" * 300 + " funding is given, the deadline is near " + "y" * 600)
    assert found.label == "Funding" and len(found.excerpt) == 500 and found.excerpt.startswith("x" * 119)


def test_similarity_depends_on_order(spark):
    assert value(spark, scalar.similarity(F.col("a"), F.col("b")), a="tide", b="diet") == SequenceMatcher(None, "tide", "diet").ratio() == 0.25
    assert value(spark, scalar.similarity(F.col("b"), F.col("a")), a="tide", b="diet") == 0.5


@pytest.mark.parametrize(
    ("text", "score", "verdict"),
    [
        ("write to me@x.org", 10, "contact"),
        ("my password is", 5, "contact"),
        ("mail me [at] home [dot] com", 5, "contact"),
        ("see https://x.org", 2, "ok"),
        ("we guarantee admission", 0, "prohibited"),
        ("call +49 170 1234567", 5, "contact"),
        ("a plain question", 0, "ok"),
    ],
)
def test_policy(spark, text, score, verdict):
    assert value(spark, scalar.policy_score(F.col("t")), t=text) == score
    assert value(spark, scalar.policy_verdict(F.col("t")), t=text) == verdict


def test_small_functions(spark):
    v = lambda c, t: value(spark, c, t=t)
    t = F.col("t")
    assert v(scalar.csv_cell(t), "=1+1") == "'=1+1" and v(scalar.csv_cell(t), "1") == "1"
    assert v(scalar.csv_list(t), " a; ;b ") == ["a", "b"]
    assert v(scalar.query_tokens(t, 3), "What are THE deadlines for a scholarship in 2026 at MIT, please?") == ["deadlines", "2026", "mit"]
    assert v(scalar.intent(t), "When do funding and deadline close?") == "deadline/status explanation"
    assert v(scalar.has_any(t, scalar.BLOCKED), "Please WRITE MY SOP") is True
    assert v(scalar.mapped(t, scalar.COUNTRIES), " Pakistani ") == "PK" and v(scalar.mapped(t, scalar.COUNTRIES), "Mars") is None
    assert v(scalar.display_name_ok(t), "Zoë R.") is True and v(scalar.display_name_ok(t), "a!") is False
    assert v(scalar.squeezed(t), " A  B\n") == "a b"
    assert v(scalar.text_lines(t), " a \n\n b") == "a\nb"
    assert v(scalar.is_sha256(t), " " + "A" * 64) is True and v(scalar.is_sha256(t), "zz") is False
    assert v(scalar.humanized(t), "weak_match") == "Weak Match" and v(scalar.reason_code(t, F.lit("failed")), "English-language") == "match.english_language.failed"
    assert v(scalar.starter_category(t), "Ask a Referee") == "recommendation"


@pytest.mark.parametrize(("hours", "left", "label"), [(-1, -1, "0 days left"), (0, 0, "0 days left"), (23, 0, "1 days left"), (25, 1, "2 days left"), (-25, -2, "closed"), (31 * 24, 31, "open")])
def test_days_left_floor_and_label_ceil(spark, hours, left, label):
    at = NOW + timedelta(hours=hours)
    assert value(spark, scalar.days_left(F.col("d"), F.lit(NOW)), d=at) == left
    assert value(spark, scalar.deadline_label(F.col("d"), F.lit(NOW)), d=at) == label


@pytest.mark.parametrize(
    ("opening", "deadline", "rolling", "archived", "expected"),
    [
        (None, timedelta(seconds=-1), False, False, "closed"),
        (None, timedelta(seconds=1), False, False, "open"),
        (timedelta(seconds=1), timedelta(days=1), False, False, "upcoming"),
        (timedelta(seconds=-1), timedelta(days=1), False, False, "open"),
        (None, None, False, False, "deadline_unknown"),
        (None, None, True, False, "rolling"),
        (None, timedelta(days=1), False, True, "archived"),
    ],
)
def test_window_state(spark, opening, deadline, rolling, archived, expected):
    at = lambda d: F.lit(None if d is None else NOW + d).cast("timestamp")
    state = temporal.window_state(F.lit(NOW), at(opening), at(deadline), F.lit(rolling), F.lit(archived))
    assert value(spark, state, x=1) == expected


def test_freshness_limits(spark):
    fresh = lambda days: value(spark, temporal.is_fresh(F.col("v"), F.lit(NOW)), v=NOW - timedelta(days=days))
    assert fresh(90) and not fresh(91)
    name = lambda days: value(spark, temporal.verification_freshness(F.col("v"), F.lit(NOW)), v=NOW - timedelta(days=days))
    assert [name(d) for d in (90, 91, 180, 181)] == ["recent", "recheck_recommended", "recheck_recommended", "historical"]


@pytest.mark.parametrize(
    ("days", "changed", "uncertain", "expected"), [(1, False, True, "uncertain"), (1, True, False, "changed"), (-1, False, False, "overdue"), (14, False, False, "due_soon"), (15, False, False, "upcoming")]
)
def test_urgency(spark, days, changed, uncertain, expected):
    assert value(spark, temporal.urgency(F.col("d"), F.lit(changed), F.lit(uncertain), F.lit(NOW)), d=NOW + timedelta(days=days)) == expected


def test_percent_rounds_half_to_even(spark):
    assert value(spark, temporal.half_even_percent(F.lit(1), F.lit(8)), x=1) == 12
    assert value(spark, temporal.half_even_percent(F.lit(3), F.lit(8)), x=1) == 38
    assert value(spark, temporal.half_even_percent(F.lit(1), F.lit(0)), x=1) == 0


def test_funding_class(spark):
    parts = lambda *s: F.array(*[F.lit(x) for x in s])
    classify = lambda policy, p, kind: value(spark, temporal.funding_class(F.lit(policy).cast("string"), p, F.lit(kind)), x=1)
    assert classify("policy", parts("confirmed", "confirmed"), "full") == "fully_funded"
    assert classify(None, parts("confirmed", "confirmed"), "full") == "partial"
    assert classify(None, parts("unknown", "unknown"), "tuition_only") == "partial"
    assert classify(None, parts("unknown", "unknown"), "full") == "unknown"
