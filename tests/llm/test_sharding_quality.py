import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.quality_rules import CHI2_MEDIAN, FLOORS, quality_verdicts
from tessera.llm.sharding import op3_sharding, shuffle_into_shards

from .data import awkward, awkward_rows, none, prose


def test_shards_hold_every_row_once_with_equal_counts(spark):
    df = awkward(spark)
    for bucket in (1 << 20, 3000):
        rows = shuffle_into_shards(df, 7, bucket_bytes=bucket).collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in awkward_rows())
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) == set(range(7))


def test_shards_repeat_and_change_with_the_seed(spark):
    df = awkward(spark)
    place = lambda seed: {(r.doc_id, r.text, r["shard"], r["slot"]) for r in shuffle_into_shards(df, 4, seed=seed, bucket_bytes=4000).collect()}
    assert place(1) == place(1) != place(2)


def test_layout_does_not_depend_on_the_number_of_partitions(spark):
    def layout(partitions, df):
        before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", partitions == 13)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1 if partitions == 13 else 10 << 20)
        try:
            return Counter((r.doc_id, r.text, r["shard"], r["slot"]) for r in shuffle_into_shards(df, 5, bucket_bytes=2000).collect())
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)

    assert layout(8, awkward(spark)) == layout(13, awkward(spark).repartition(11)) == layout(3, awkward(spark).coalesce(1))


def test_every_bucket_has_its_own_permutation(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sorted(shuffle_into_shards(df, 1, bucket_bytes=1000).collect(), key=lambda r: r["slot"])
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    first, second = shuffle_into_shards(df, 1, seed=1, bucket_bytes=10**9).collect(), shuffle_into_shards(df, 1, seed=2, bucket_bytes=10**9).collect()
    assert {(r.doc_id, r["slot"]) for r in first} != {(r.doc_id, r["slot"]) for r in second}


def test_shards_of_nothing(spark):
    assert shuffle_into_shards(none(spark)).count() == 0


def test_more_shards_than_rows(spark):
    rows = shuffle_into_shards(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), 5).collect()
    assert len({r["shard"] for r in rows}) == 2 and all(r["slot"] == 0 for r in rows)


def test_shuffle_is_uniform_enough(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = shuffle_into_shards(df, 4, bucket_bytes=500).collect()
    means = [np.mean([r.doc_id for r in rows if r["shard"] == s]) for s in range(4)]
    assert all(abs(m - 2000) < 200 for m in means)
    firsts = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert abs(np.corrcoef([r.doc_id for r in firsts], range(4000))[0, 1]) < 0.06


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(covered)


def test_base_statistics_match_brute_force(spark):
    texts = [t for _, t, *_ in awkward_rows()] + ["a b c d e a b c d e a b c d e", "x x x x x x x", "#a $b %% |\n#a $b %% |\n \n "]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in quality_verdicts(df).collect():
        expected = statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, texts[r.doc_id]
        assert r.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (r.base_failed and r.kept)


def test_outliers_are_rejected_and_clean_rows_kept(spark):
    rows = [(i, prose(i, 40 + i % 60), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(i, 60).split()), "en", "s") for i in range(20)]
    rows += [(2000 + i, prose(i, 60).upper(), "en", "s") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_verdicts(df).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in kept if i >= 1000)


def test_estimates_match_a_direct_computation(spark):
    """The distances of one group against concentration steps in numpy with exact quantiles."""
    rows = [(i, prose(i, 40 + i % 60), "en", "s") for i in range(200)] + [(900 + i, "AB# CD$ " * 3 + prose(i, 30), "en", "s") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_verdicts(df).collect()}
    ids = [i for i in got if not got[i].base_failed]
    s = np.array([[got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].n_capitals] for i in ids], dtype=float)
    base, chars = s[:, 0] + 20, s[:, 1] + 100
    x = np.stack([np.log(chars / base), np.sqrt(s[:, 2] / base), np.sqrt(s[:, 3] / base), np.sqrt(s[:, 4] / base), np.sqrt(s[:, 5] / chars)], axis=1)
    centre = np.quantile(x, 0.5, axis=0, method="inverted_cdf")
    scale = np.maximum(FLOORS, 1.4826 * np.quantile(np.abs(x - centre), 0.5, axis=0, method="inverted_cdf"))
    z = (x - centre) / scale
    d = (z**2).sum(axis=1)
    for _ in range(4):
        held = z[d <= np.quantile(d, 0.75, method="inverted_cdf")]
        mean, cov = held.mean(axis=0), np.cov(held.T, bias=True) + 0.5 * np.eye(5)
        d = np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean)
    d /= max(np.quantile(d, 0.5, method="inverted_cdf") / CHI2_MEDIAN[5], 1.0)
    assert np.allclose(d, [got[i].distance for i in ids], rtol=1e-3, atol=1e-6)


def test_quality_of_awkward_rows(spark):
    out = quality_verdicts(awkward(spark))
    assert out.columns.count("kept") == 1 and "extra" in out.columns
    rows = out.collect()
    assert len(rows) == len(awkward_rows()) and all(r.kept is not None for r in rows)
    assert all(r.base_failed for r in rows if not (r.text or "").strip())
    assert quality_verdicts(none(spark)).count() == 0


def test_query_columns(spark):
    out = op3_sharding(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
