import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import scalar
from tessera.operators import metrics
from tessera.operators.catalogue import Filters
from tessera.sources import readers

RECORD = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())])


def test_json_rows_are_numbered_and_bounded(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"name": "x", "n": 1},\n {"name": "y"}]')
    got = sorted(tuple(r) for r in readers.json_rows(spark, str(tmp_path / "a.json"), RECORD).collect())
    assert got == [(1, "x", 1), (2, "y", None)]
    for i, body in enumerate(["[]", '{"name": "x"}x', "[1]", "[" + ", ".join('{"n": 1}' for _ in range(101)) + "]"]):
        (tmp_path / f"bad{i}.json").write_text(body)
        with pytest.raises(Exception, match="an import is a list|Malformed|malformed|MALFORMED"):
            readers.json_rows(spark, str(tmp_path / f"bad{i}.json"), RECORD).collect()


def test_csv_cells_lose_all_white_space_at_their_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Name,Country\n"\tx \r",  \n\t,\t\n"y","DE\t"\n')
    rows = readers.import_rows(readers.csv_rows(spark, str(tmp_path / "a.csv"))).collect()
    assert [(r.name, r.country) for r in rows] == [("x", None), ("y", "DE")]


def test_filters_that_exclude_each_other_are_refused():
    with pytest.raises(ValueError, match="cannot be combined"):
        Filters(open_now=True, application_window_state="open")
    with pytest.raises(ValueError, match="not valid"):
        Filters(application_window_state="ajar")
    assert Filters(application_window_state="open").open_now is False and Filters(open_now=True)


def test_small_functions(spark):
    import uuid

    df = spark.createDataFrame([("u1", "  eur", "EUR", 1.0, "x" * 19), ("u2", "usd", "EUR", 1.0, "y" * 600), (None, "EURO", "EURO", 1.0, None), ("ü", "EUR", "EUR", 0.0, "z" * 20)], "u string, a string, b string, n double, t string")
    rows = df.select("u", scalar.pseudonym(F.col("u")).alias("p"), scalar.currency_ok(F.col("a"), F.col("b"), F.col("n")).alias("ok"), scalar.excerpt(F.col("t")).alias("e"), scalar.sealed(F.col("t"), "m", F.col("u")).alias("s"), "t").collect()
    assert [r.p for r in rows] == [None if r.u is None else str(uuid.uuid5(uuid.NAMESPACE_URL, f"community:{r.u}")) for r in rows]
    assert [r.ok for r in rows] == [True, False, False, False] and [r.e and len(r.e) for r in rows] == [None, 500, None, 20]
    assert len({bytes(r.s.wrapped) for r in rows if r.s}) == 3 and rows[2].s is None
    again = df.withColumn("s", scalar.sealed(F.col("t"), "m", F.col("u")))
    opened = again.select("t", scalar.opened(F.col("s"), "m", F.col("u")).alias("right"), scalar.opened(F.col("s"), "m", F.lit("other")).alias("name"), scalar.opened(F.col("s"), "n", F.col("u")).alias("master")).collect()
    assert all(r.right == r.t and r.name is None and r.master is None for r in opened)


def test_jobs_and_buckets(spark):
    runs = spark.createDataFrame([("a", 0, 5, 3, None), ("a", 10, 12, 9, "Timeout"), ("b", 0, 1, 1, "Timeout"), ("b", 5, 4, 2, None), ("b", 6, 8, -4, None)], "job string, s int, c int, processed int, error string")
    at = lambda c: F.timestamp_seconds(F.col(c)).cast("timestamp")
    got = {r.job: tuple(r)[1:] for r in metrics.job_totals(runs.withColumns({"started_at": at("s"), "completed_at": at("c")})).collect()}
    assert got == {"a": (3, 1, "Timeout", 7000, 5000), "b": (2, 1, None, 3000, 2000)}
    values = spark.createDataFrame([(10.0,), (None,), (9000.0,)], "v double")
    assert [r[0] for r in values.select(metrics.bucket(F.col("v"))).collect()] == ["le_50", None, "gt_5000"]
