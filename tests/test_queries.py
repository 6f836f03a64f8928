"""Every registered query against its SQL in DuckDB, and the shape of some plans."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import scalar
from tessera.plans import catalogue, matching, texts

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def clean(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_its_sql(spark, oracle, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(clean(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    found = oracle.sql(plans.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted((tuple(clean(r[i]) for i in at) for r in found.fetchall()), key=repr)


def plan(spark, name):
    return plans.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()


def test_plans(spark):
    search = plan(spark, "catalogue_search")
    assert "LeftSemi" in search and "LeftAnti" in search and "CartesianProduct" not in search and "PushedFilters: [IsNotNull(l_linestatus)" in search
    assert "LocalRelation <empty>" in plan(spark, "unknown_alias_filter") or "LocalTableScan <empty>" in plan(spark, "unknown_alias_filter")
    assert "WindowGroupLimit" in plan(spark, "best_source_per_order")
    assert plan(spark, "quality_issues").split("== Physical Plan ==")[-1].count("FileScan parquet") <= 4


def test_entry_points():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.ORACLE_SQL) <= set(entry.oracle_sql())


def test_explanations_and_progress_are_whole(spark, oracle):
    count = lambda sql: oracle.sql(sql).fetchall()[0][0]
    lists = plans.QUERIES["match_explanations"](spark, DATA)
    scored = plans.QUERIES["match_scores"](spark, DATA).select("c_custkey", "p_partkey")
    assert lists.count() == scored.count() == count("SELECT count(*) FROM customer JOIN part ON c_custkey % 50 = p_size")
    assert lists.select("c_custkey", "p_partkey").exceptAll(scored).isEmpty()
    assert all(len([x for c in ("satisfied", "missing", "uncertain") for x in r[c].split("; ") if x]) == 6 for r in lists.collect())
    progress = plans.QUERIES["private_progress_all"](spark, DATA)
    assert progress.count() == count("SELECT count(*) FROM orders") and progress.filter("o_custkey > 50").count() > 0


def test_entry_survives_a_missing_package(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__ as entry

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "tessera.llm" or (name == "tessera.llm" and args):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    importlib.reload(entry)
    assert set(entry.queries()) == set(plans.QUERIES)


def brute_retrieval(questions, documents):
    out = set()
    for conv, turn, role, text in questions:
        if role == "user":
            tokens = [x for x in re.findall("[a-z0-9]{3,}", (text or "").lower()) if x not in scalar.STOP_WORDS][:6]
            held = {d for d, body in documents if not tokens or (body is not None and any(x in body.lower() for x in tokens))}
            out |= {(conv, turn, d) for d in sorted(held)[:32]}
    return out


def test_retrieval_takes_every_question_and_matches_in_words(spark):
    tables = type("Tables", (), {})()
    questions = [(1, 0, "user", "Is the ART of how funding"), (1, 2, "user", "Which deadline?"), (1, 1, "assistant", "zebra"), (2, 0, "system", "zebra"), (2, 1, "user", "to me, is a"), (3, 0, "user", None), (4, 0, "user", "one two three four five six zebra"), (5, 0, "user", "abcdef")]
    documents = [(1, "A party of many"), (2, "zebra"), (3, None), (4, "Fundings"), (5, "x" * 50 + "abcdefg" + "y" * 500), (6, "ab cdef"), (7, "\u00e9deadlines!"), (8, "The art"), (8, "The art"), (9, "")]
    tables.conversations = spark.createDataFrame(questions, "conv_id long, turn long, role string, text string")
    tables.documents = spark.createDataFrame(documents, "doc_id long, text string")
    got = [tuple(r) for r in texts.retrieval(tables).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_retrieval(questions, documents)
    assert {(1, 0, 1), (1, 2, 7), (5, 0, 5), (2, 1, 2)} <= set(got) and (4, 0, 2) not in got


def test_whole_text_queries_match_brute_force(spark, oracle):
    documents = oracle.sql("SELECT doc_id, text FROM documents").fetchall()
    questions = oracle.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = [tuple(r) for r in plans.QUERIES["retrieval"](spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_retrieval(questions, documents)
    clean = [(r.doc_id, r.clean) for r in plans.QUERIES["normalized_text"](spark, DATA).collect()]
    assert sorted(clean) == sorted((d, re.sub(r"\s+", " ", x).strip(" ").lower()) for d, x in documents)
    contact, link = (re.compile(p.replace("(?iU)", "(?i)")) for p in (scalar.CONTACT, scalar.LINK))
    scores = [(r.doc_id, r.score) for r in plans.QUERIES["policy_score"](spark, DATA).collect()]
    assert sorted(scores) == sorted((d, 5 * bool(contact.search(x)) + 2 * bool(link.search(x))) for d, x in documents)


def as_tables(spark, **rows):
    """Tables of a few rows each, (schema, rows), for Spark and for DuckDB."""
    tables, con = type("Tables", (), {"spark": spark})(), duckdb.connect()
    for name, (schema, data) in rows.items():
        setattr(tables, name, spark.createDataFrame(data, schema))
        con.execute(f"CREATE TABLE {name} ({schema.replace('string', 'VARCHAR').replace('long', 'BIGINT')})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' for _ in data[0])})", data)
    return tables, con


def agrees(got, con, name):
    columns = sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({plans.ORACLE_SQL[name]}) q").fetchall(), key=repr)
    assert rows == want
    return rows


ODD_TEXTS = [
    "mail \u00e9a@x.org", "a@x.org\u00e9", "\u00e9password", "password\u00e9", "pa\u017fsword", "wor\u212a dm\u00e9", "\u00fcdm", "line: \u00e9", "line: x", "a\u00a0at\u00a0b\u00a0dot\u00a0c", "a\x0bat\x0bb\x0bdot\x0bc",
    "a at b dot c", "a at \u00e9 dot c", "call \u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669", "\u00e912345678901", "12345678901\u00e9", "\u0130nsta: x", "\u0131nsta: x", "http\u017f://x", "vi\u017fa advice", "whatsapp\u0308", "\u00e4telegram", "telegram.", "", None,
]


def test_policy_patterns_read_odd_texts_as_their_sql(spark):
    tables, con = as_tables(spark, documents=("doc_id long, text string", list(enumerate(ODD_TEXTS))))
    rows = agrees(texts.policy_verdicts(tables), con, "policy_verdicts")
    agrees(texts.policy_score(tables), con, "policy_score")
    assert {r[2] for r in rows} == {"contact", "prohibited", "ok"}


def test_every_pair_of_an_identity_conflicts(spark):
    data = [(1, "a", "x", 1), (2, "a", "x", 1), (3, "a", "x", 1), (4, "a", "x", None), (5, "a", "x", None), (6, None, "x", 1), (7, None, "x", 1)]
    tables, con = as_tables(spark, part=("p_partkey long, p_brand string, p_type string, p_size int", data))
    rows = agrees(catalogue.canonical_identity_conflicts(tables), con, "canonical_identity_conflicts")
    assert {tuple(sorted(r)) for r in rows} == {(1, 2), (1, 3), (2, 3), (4, 5)}


def test_matches_by_classes_agree_with_all_pairs(spark):
    """Nulls, equal balances and prices, prices over 1200, and more alike parts than a ranking shows; no query but the two lists joins pairs."""
    balance, price = [None, -5.0, 900.0, 1000.0, 1300.0, 5000.0], [None, 900.0, 1000.0, 1250.0, 1300.0]
    customer = [(k, None if k % 9 == 4 else k % 25, balance[k % 6], "") for k in range(60)] + [(None, 1, 7.0, "")]
    part = [(k, [None, "ECONOMY BRASS", "PROMO TIN"][k % 3], (k * 7) % 6 if k % 10 else None, price[k % 5]) for k in range(240)] + [(None, "PROMO TIN", 3, 900.0)]
    tables, con = as_tables(spark, customer=("c_custkey long, c_nationkey int, c_acctbal double, c_name string", customer), part=("p_partkey long, p_type string, p_size int, p_retailprice double", part))
    for name in ("match_rules", "match_labels", "match_confidence", "match_scores", "match_explanations"):
        assert agrees(getattr(matching, name)(tables), con, name)
    con.execute("DELETE FROM part WHERE p_partkey IS NULL")
    tables.part = tables.part.filter("p_partkey IS NOT NULL")
    assert agrees(matching.match_rank(tables), con, "match_rank")
    counted = matching.pair_classes(tables)
    assert counted.agg({"n": "sum"}).first()[0] == con.execute("SELECT count(*) FROM customer JOIN part ON c_custkey % 50 = p_size").fetchall()[0][0]
    # The fewer pairs of classes do not grow with the members: twice the customers and parts are as many rows.
    twice = type("Tables", (), {"customer": tables.customer.union(tables.customer), "part": tables.part.union(tables.part)})()
    assert matching.pair_classes(twice).count() == counted.count()


def test_listed_pairs_of_one_size_are_dealt_to_many_tasks(spark, monkeypatch):
    """All customers and parts of one size: no task lists more than its share of the pairs, which agree with the SQL."""
    for name, value in (("BLOCK", 20), ("CHUNK", 16), ("TASK_PAIRS", 1_000)):
        monkeypatch.setattr(matching, name, value, raising=False)
    customer = [(50 * k + 7, k % 25, float(k % 40) * 50 - 100 if k % 11 else None) for k in range(200)]
    part = [(k, ["ECONOMY", "PROMO", None][k % 3], 7, 900.0 + 5 * k if k % 13 else None) for k in range(150)]
    tables, con = as_tables(spark, customer=("c_custkey long, c_nationkey int, c_acctbal double", customer), part=("p_partkey long, p_type string, p_size int, p_retailprice double", part))
    for name in ("match_explanations", "match_scores"):
        got = getattr(matching, name)(tables)
        assert len(agrees(got, con, name)) == 30_000
        by_task = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert len(by_task) > 20 and max(by_task) < 5_000
        empty = type("Tables", (), {"spark": spark, "customer": tables.customer, "part": tables.part.filter("p_size = 8")})()
        assert getattr(matching, name)(empty).isEmpty()
