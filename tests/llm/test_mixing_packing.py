import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.mixing import mix_sources, source_targets
from tessera.llm.packing import WordTokenizer, cuts, karmarkar_karp, pack_documents, pack_windows
from tessera.llm.tokens import tokenizer_path

from .data import awkward, awkward_rows, none, prose


def water_filled(sizes, weights, limit=3):
    """Targets by sharing the excess again until none is above."""
    total, capped = sum(sizes.values()), set()
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    while True:
        rest = total - sum(limit * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        above = {s for s in free if share[s] > limit * sizes[s]}
        if not above:
            return {s: share.get(s, float(limit * sizes[s])) for s in order}
        capped |= above


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 5000, "c": 40, None: 7}, {"a": 0, "b": 3}, {"é": 5, "z": 500, "Z": 1}, {"only": 9}])
def test_targets_match_sharing_by_hand(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    expected = water_filled(sizes, (5, 2, 1))
    assert got.keys() == expected.keys() and all(abs(got[s] - expected[s]) < 1e-6 for s in got)


def test_mix_meets_targets(spark):
    rows = [(i, prose(i, 5 + (i * 37) % 200), f"s{i % 4 if i % 3 else 0}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix_sources(df).cache()
    assert mixed.filter("copies < 0 OR copies > 3").count() == 0
    for r in mixed.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.min("size").alias("least")).collect():
        assert abs(r.taken - r.target) <= max(5, 0.01 * r.target)
    again = {(r.doc_id, r.copies) for r in mix_sources(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in mixed.collect()}


def test_rates_solve_the_dual(spark):
    """Within a source the logit of a document's rate is linear in its bounded size with one slope."""
    rows = [(i, " ".join(["w"] * (1 + i % 50)), f"s{i % 3}") for i in range(300)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in out.groupby("source"):
        x = 2 * g["size"] / (g["size"] + g["size"].mean())
        slope = np.log(2 * g["rate"] / (3 - g["rate"])) / x
        assert slope.max() - slope.min() < 1e-6
        assert abs((g["rate"] * g["size"]).sum() / g["target"].iloc[0] - 1) < 1e-6


def test_mix_of_awkward_and_empty_tables(spark):
    out = mix_sources(awkward(spark))
    rows = out.collect()
    assert len(rows) == len(awkward_rows()) and "extra" in out.columns
    assert all(r["copies"] == 0 for r in rows if not (r.text or "").split())
    assert mix_sources(none(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r.copies for r in mix_sources(blank).collect()] == [0, 0]


def test_karmarkar_karp_is_near_equal():
    draw = np.random.default_rng(3)
    sizes = draw.integers(1, 1000, 400).tolist()
    parts = karmarkar_karp(sizes, 40)
    assert sorted(i for p in parts for i in p) == list(range(400))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) < 60
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in karmarkar_karp([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_windows_rise_until_they_fit():
    parts = pack_windows([3000, 3000, 3000, 4096, 10], 4096)
    assert sorted(i for p in parts for i in p) == [0, 1, 2, 3, 4]
    assert all(sum([3000, 3000, 3000, 4096, 10][i] for i in p) <= 4096 for p in parts) and len(parts) == 4
    assert pack_windows([], 4096) == [] and pack_windows([4096], 4096) == [[0]]


def test_cuts_cover_a_document():
    for n in (1, 1023, 1024, 1025, 4096, 4097, 20000):
        pieces = cuts(n, 4096, 1024)
        assert [s for s, _ in pieces] == [sum(length for _, length in pieces[:i]) for i in range(len(pieces))] and sum(length for _, length in pieces) == n


def test_word_cache_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    with open(path, "rb") as file:
        plain, cached = Tokenizer.from_file(path), WordTokenizer(file.read())
    texts = [r[1] or "" for r in awkward_rows()] + ["it's we'll 3.5% *** áb  x  y", "ﬁne Ǆ ΑΣ, ΑΣ", "a\x1cb", "<|startoftext|>hi.<|endoftext|>."]
    for _ in range(2):
        for text, ids in zip(texts, cached.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = pack_documents(awkward(spark), "word_bpe_49k.json", end_id=2, batch_bytes=20_000).collect()
    expected = Counter()
    for r in awkward_rows():
        expected[(r[0], zlib.crc32(np.array(plain.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()))] += 1
    found, parts = Counter(), {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        parts.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    total = sum(p.length for p in pieces)
    assert total == sum(len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in awkward_rows())
    for (doc, tokens), ps in parts.items():
        if sum(p.length for p in ps) == tokens:
            found[(doc, zlib.crc32(b"".join(bytes(p.ids) for p in sorted(ps, key=lambda p: p.start))))] += 1
    assert sum(found.values()) > 90 and not found - expected
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack_documents(none(spark), "word_bpe_49k.json", end_id=2).count() == 0
