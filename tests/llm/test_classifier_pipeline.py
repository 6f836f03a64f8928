import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.quality_classifier import TextStatistics, classify_quality, fit_logistic

from .data import awkward, awkward_rows, none

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    train, test = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    out = classify_quality(docs, train, carry=["doc_id"]).join(test, "doc_id")
    good, bad = out.filter("quality = 1"), out.filter("quality = 0")
    assert good.filter("kept").count() >= 0.97 * good.count() and bad.filter("NOT kept").count() >= 0.9 * bad.count()


def test_sparse_sites_shrink_to_the_prior(spark):
    rows = [(i, "good words in a row " * 5, "en", "big") for i in range(60)] + [(100 + i, "BAD!! ### $$$ " * 9, "en", "bad") for i in range(60)]
    rows += [(300, "BAD!! ### $$$ " * 9, "en", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows[:-1]], "doc_id long, quality int, toxic int")
    site = {r.source: r.site_quality for r in classify_quality(docs, labels).collect()}
    assert site["bad"] < site["tiny"] < site["big"]


def test_classifier_of_awkward_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (11, 0, 0), (100, 1, 0), (None, 0, 0), (101, None, 0)], "doc_id long, quality int, toxic int")
    out = classify_quality(awkward(spark), labels)
    rows = out.collect()
    assert len(rows) == len(awkward_rows()) and all(r.kept is not None for r in rows) and out.columns.count("kept") == 1
    assert classify_quality(none(spark), labels).count() == 0
    assert all(r.kept for r in classify_quality(awkward(spark), labels.limit(0)).collect())


def test_text_statistics_match_brute_force():
    for text in [r[1] or "" for r in awkward_rows()] + ["a b c d e a b c d e a b c d e", "x x x x x x x", "#a $b %% |\n#a $b %% |\n \n "]:
        tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4))
        covered = {i + k for i in range(len(tokens) - 4) if windows[tuple(tokens[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, chars = len(tokens) + 10, sum(map(len, tokens)) + 50
        share = lambda letters: math.sqrt(sum(c in letters for c in text) / chars)
        expected = [math.log(chars / n), share("#*$%&|<>"), math.sqrt((len(lines) - len(set(lines))) / n), math.sqrt(len(covered) / n), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("!?.,;:|*&%$#"), share("0123456789"), math.log(n) / 5]
        found, slots = TextStatistics()(text)
        assert np.allclose(found, expected) and len(slots) == len(tokens)


def test_logistic_fit_separates():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, 3))
    y = (x[:, 0] > 0).astype(float)
    mean, scale, w = fit_logistic(x, y)
    assert (((x - mean) / scale @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.95


def test_pipeline_stages_on_awkward_documents(spark, tmp_path):
    docs = awkward(spark)
    labels = spark.createDataFrame([(100, 1, 0), (101, 1, 0), (11, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, none(spark)):
        df = start
        for name, stage in corpus_pipeline.STAGES:
            out = f"{tmp_path}/{name}-{start is docs}"
            stage(spark, df, str(tmp_path)).write.parquet(out)
            df = spark.read.parquet(out)
            if name != "pack":
                assert df.columns == corpus_pipeline.COLUMNS
        assert (df.count() > 0) == (start is docs)


def test_run_keeps_clean_documents_and_one_of_each_group(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA)
    total = out.agg(F.sum("length")).first()[0]
    used = out.select("sequence_id").distinct().count()
    assert total / (used * 4096) > 0.95 and out.select("doc_id").distinct().count() > 0.4 * docs.count()


def test_stages_hand_texts_to_python_in_batches_of_bounded_bytes(spark, tmp_path):
    from tessera.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = spark.range(600, numPartitions=1).select(F.repeat(F.lit("kana "), 10_000).alias("text"))
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(common.ARROW_BATCH)
        stage(spark, none(spark), str(tmp_path))
        found = texts.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r.rows for r in found) == 600 and max(r.bytes for r in found) < 2 * common.ARROW_BYTES
    spark.conf.set(common.ARROW_BATCH, "1000000")  # a bound of the session's own stays
    common.bound_batches(spark)
    assert spark.conf.get(common.ARROW_BATCH) == "1000000"
    spark.conf.unset(common.ARROW_BATCH)


def brute_classes(rows, labels, sample):
    """Site qualities and decisions from the operator's own evidence, by sums over plain lists."""
    known = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            known[i] = min(known.get(i, 1), int(q > 0))
    site, host = {}, {}
    for i, _, path, source in rows:
        if i in known:
            for of, key in ((site, (source, path)), (host, source)):
                n, g = of.get(key, (0, 0))
                of[key] = (n + 1, g + known[i])
    total = sum(n for n, _ in host.values())
    prior = sum(g for _, g in host.values()) / total

    def strength(cells):
        cells = [(n, g / n, p) for n, g, p in cells if n]
        if len(cells) < 2:
            return 1000.0
        all_n = sum(n for n, _, _ in cells)
        within = sum(n * p * (1 - p) for n, _, p in cells)
        spread, noise = sum(n * (m - p) ** 2 for n, m, p in cells), sum(p * (1 - p) for _, _, p in cells)
        between = (spread - noise) / max(all_n - sum(n * n for n, _, _ in cells) / all_n, 1e-9)
        return min(max(within / all_n / between - 1, 1.0), 1e4) if between > 0 else 1e4

    m0 = strength([(n, g, prior) for n, g in host.values()])
    mean = {k: (g + m0 * prior) / (n + m0) for k, (n, g) in host.items()}
    m1 = strength([(n, g, mean[k[0]]) for k, (n, g) in site.items()])
    out = {}
    for i, _, path, source in rows:
        own, one = known.get(i, 0), int(i in known)
        hn, hg = host.get(source, (0, 0))
        n, g = site.get((source, path), (0, 0))
        h = (hg - own + m0 * prior) / (hn - one + m0)
        out[i] = (g - own + m1 * h) / (n - one + m1)
    odds = lambda p: np.log(p / (1 - p))
    return {i: (q, 1 / (1 + np.exp(-(odds(sample[i]) - odds(prior) + odds(q))))) for i, q in out.items()}


def test_site_posteriors_match_brute_force_without_the_own_label(spark):
    draw = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(600):
        source, path = [None, "a", "b", "c"][i % 4], ["en", None, "de"][i % 3]
        good = draw.random() < {"a": 0.9, "b": 0.2, None: 0.6, "c": 0.5}[source]
        rows.append((i, "good plain words in order " * 6 if draw.random() < (0.8 if good else 0.3) else "BAD!! ### $$$ 123 " * 9, path, source))
        if i % 2 == 0 or i < 50:
            labels.append((i, int(good), 0))
    labels += [(0, 0, 0), (None, 1, 0), (3, None, 0)]
    out = classify_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    expected = brute_classes(rows, labels, {r.doc_id: r.evidence for r in out})
    for r in out:
        assert np.allclose((r.site_quality, r.p_quality), expected[r.doc_id], atol=1e-9) and r.kept == (r.p_quality >= 0.5)
    assert {r.doc_id for r in out} == set(range(600)) and len({round(r.evidence, 6) for r in out}) == 2


def test_the_sample_is_cut_before_it_is_gathered(spark):
    from tessera.llm.common import sampled

    df = spark.range(100_000)
    cut = sampled(df, F.xxhash64("id"), 2000, 100_000)
    assert 1000 < cut.count() <= 2000 and sampled(df, F.xxhash64("id"), 10**6, 100_000).count() == 100_000
