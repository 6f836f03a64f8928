import itertools
import random
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.components import connected_components
from tessera.llm.line_dedup import common_blocks, dedup_lines, patience
from tessera.llm.minhash import SLOTS, Shingler, _possible, drop_near_duplicates, near_duplicates

from .data import awkward, awkward_rows, none, prose


def brute_components(rows, width, percent=80):
    """Union-find over all pairs of whole shingle sets."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = min(width, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def check(spark, rows, width):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, width=width).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_match_brute_force_on_awkward_rows(spark):
    check(spark, [(r[0], r[1]) for r in awkward_rows()], 2)


def test_a_crowded_group_of_variants_around_the_threshold(spark):
    """Hundreds of copies with few or many edits: pivots link most, the prefix filter must find the rest."""
    draw, base, rows = random.Random(5), prose(77, 120).split(), []
    for i in range(260):
        words = list(base)
        for _ in range(draw.randint(0, 14)):
            words[draw.randrange(len(words))] = f"edit{draw.randint(0, 10**9)}"
        rows.append((i, " ".join(words)))
    check(spark, rows, 2)


def test_five_words_and_drop(spark):
    rows = [(1, prose(1, 100)), (2, prose(1, 100)), (3, prose(2, 100)), (3, prose(2, 100)), (4, None), (5, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    kept = drop_near_duplicates(df).collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 3, 4, 5, None])


def test_awkward_and_empty_tables(spark):
    rows = near_duplicates(awkward(spark)).collect()
    assert len(rows) == len(awkward_rows())
    assert near_duplicates(none(spark)).count() == 0
    assert drop_near_duplicates(awkward(spark)).columns == awkward(spark).columns


def test_shingles_lower_ascii_only():
    s = Shingler(2)
    assert np.array_equal(s("Ab cD"), s("aB Cd")) and not np.array_equal(s("É x"), s("é x"))
    assert len(s("one")) == 1 and len(s("")) == 0 and len(s("a b a b")) == 2


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert all(roots[i] == 0 for i in range(61)) and roots[101] == 100


def test_patience_aligns_around_changes():
    a, b = list("abcdefgh"), list("abXcdfgYh")
    pairs = patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and [a[i] for i, _ in pairs] == list("abcdfgh")
    assert pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)


def test_blocks_need_words_and_survive_moves_and_repeats():
    assert common_blocks([1, 2, 9, 3], [1, 2, 3], [10, 10, 10, 10], 20) == {0, 1}
    assert common_blocks([5, 6, 1, 2], [1, 2, 5, 6], [10] * 4, 20) == {0, 1, 2, 3}
    assert common_blocks([1, 2, 7, 1, 2], [1, 2, 1, 2], [10] * 5, 20) == {0, 1, 3, 4}
    assert common_blocks([1, 8], [1, 2], [10, 10], 20) == set()


def brute_lines(rows, min_words):
    """Lines of runs that an earlier document holds, by direct comparison."""
    out = {}
    outlines = [[(i, x.strip(), len(x.split())) for i, x in enumerate((t or "").split("\n")) if x.split()] for _, t in rows]
    for d, lines in enumerate(outlines):
        gone = set()
        for e, owner in enumerate(outlines):
            if rows[e][0] < rows[d][0]:
                for s in range(len(lines)):
                    for o in range(len(owner)):
                        n = 0
                        while s + n < len(lines) and o + n < len(owner) and lines[s + n][1] == owner[o + n][1]:
                            n += 1
                        if sum(x[2] for x in lines[s : s + n]) >= min_words:
                            gone |= {x[0] for x in lines[s : s + n]}
        out[rows[d][0]] = gone
    return out


def test_line_dedup_matches_brute_force(spark):
    passage = "\n".join(prose(50 + k, 18) for k in range(3))
    rows = [(i, prose(i, 60)) for i in range(8)]
    rows += [(10 + i, f"{prose(200 + i, 40)}\n{passage}\n{prose(300 + i, 40)}") for i in range(6)]
    rows += [(30, prose(3, 60)), (31, passage + "\n\n" + passage), (32, "short line\nother"), (33, "short line\nother")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_lines(rows, 20)
    for r in dedup_lines(df).collect():
        lines = dict(rows)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for i, x in enumerate(lines) if i not in expected[r.doc_id]), r.doc_id
        assert (r.n_lines, r.removed_lines) == (len(lines), len(expected[r.doc_id]))


def test_short_lines_in_crossing_order_hide_no_block():
    assert common_blocks([1, 2], [2, 1], [60, 3], 20) == {0}
    assert common_blocks([2, 3, 1], [1, 2, 9, 3], [3, 3, 60], 20) == {2}
    assert common_blocks([1, 2, 3], [1, 2, 9, 2, 3], [10] * 3, 20) == {0, 1, 2}
    assert common_blocks([1, 2, 3], [2, 9, 1, 3], [10, 20, 10], 20) == {1}, "lines on both sides of a deleted block are no block"
    draw = random.Random(8)
    for _ in range(3000):
        length = [draw.randint(1, 14) for _ in range(7)]
        later, owner = ([draw.randrange(7) for _ in range(draw.randint(0, 9))] for _ in range(2))
        expected = set()
        for s in range(len(later)):
            for o in range(len(owner)):
                n = 0
                while s + n < len(later) and o + n < len(owner) and later[s + n] == owner[o + n]:
                    n += 1
                if sum(length[x] for x in later[s : s + n]) >= 20:
                    expected |= set(range(s, s + n))
        assert common_blocks(later, owner, [length[x] for x in later], 20) == expected


def test_line_dedup_with_short_lines_matches_brute_force(spark):
    passage, licence, notice = prose(90, 60), "all rights reserved here", "see the licence file"
    rows = [(1, f"{licence}\n{passage}"), (2, f"{passage}\n{licence}"), (3, f"{passage}\n{licence}\nown words of three\n{notice}"), (4, f"{licence}\n{notice}\n{passage}")]
    nineteen, one = " ".join(["w"] * 19), "x"
    # The run of the first two lines has another owner than the three lines.
    rows += [(10, f"{nineteen}\n{one}\nfirst end"), (11, f"{nineteen}\n{one}\nsecond end of it"), (12, f"{nineteen}\n{one}\nsecond end of it")]
    draw = random.Random(3)
    pieces = [*[prose(400 + k, n) for k, n in enumerate((12, 12, 24, 50))], licence, notice, "a", "b c"]
    rows += [(20 + i, "\n".join(draw.choice(pieces) for _ in range(draw.randint(1, 9)))) for i in range(60)]
    expected = brute_lines(rows, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(dedup_lines(df, rare=1).collect()) == sorted(dedup_lines(df, rare=3).collect()) == sorted(dedup_lines(df, rare=10**9).collect())
    for r in dedup_lines(df).collect():
        lines = dict(rows)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for i, x in enumerate(lines) if i not in expected[r.doc_id]), r.doc_id
        assert r.removed_lines == len(expected[r.doc_id])


def test_line_dedup_of_awkward_and_empty_tables(spark):
    out = dedup_lines(awkward(spark))
    assert set(awkward(spark).columns) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == len(awkward_rows())
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].text is None and by_id[4].removed_lines == 0 and by_id[5].text == "" and by_id[2].text == ""
    assert [r.removed_lines for r in rows if r.doc_id == 9] == [0, 0, 0]
    assert dedup_lines(none(spark)).count() == 0


def test_spread_join_broadcasts_hot_keys_only(spark, monkeypatch):
    many = spark.createDataFrame([(k % 7, k) for k in range(60)] + [(9, 100 + k) for k in range(40)] + [(50, 1)], "k long, v long")
    one = many.filter("k <> 50").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("k") * 10)
    by_key = {r.k: (r.n, r.w) for r in one.collect()}
    expected = sorted((k, v, *by_key[k]) for k, v in ((r.k, r.v) for r in many.collect()) if k in by_key)
    for least, broadcasts in ((1, True), (20, True), (1024, False)):
        monkeypatch.setattr(common, "HOT_LEAST", least)
        joined = common.spread_join(many, common.written(one, "one"), "k", "n", 101)
        assert sorted(map(tuple, joined.collect())) == expected
        final = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert ("cast(null as bigint) AS _hot" in final) != broadcasts, final


def test_counters_of_every_slot_reach_the_driver_without_a_row_each(spark):
    """Two linked sets that fill all counters: the pair is found, and the driver's Python holds arrays, not rows."""
    h = np.sort(np.arange(SLOTS, dtype=np.uint64) * np.uint64(SLOTS + 1) + np.uint64(7))
    rows = [(b"a", b"a", bytearray(h.tobytes())), (b"b", b"b", bytearray(h[1:].tobytes()))]
    open_ = common.written(spark.createDataFrame(rows, "node binary, root binary, set binary"), "open")
    _possible(open_.limit(0), 80)  # what the first call loads does not count
    tracemalloc.start()
    try:
        pairs = _possible(open_, 80)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [(bytes(r.a), bytes(r.b)) for r in pairs.collect()] == [(b"a", b"b")]
    assert most < 24e6, most


def test_components_that_are_stars_take_no_round(spark):
    """A round is some eight shuffles, which the driver plans and schedules even where it would change nothing."""
    stars = spark.createDataFrame([(1, 5), (7, 1), (1, 7), (2, 3), (4, 4), (None, 1)], "a long, b long")
    assert sorted((r.node, r.root) for r in connected_components(stars, rounds=0).collect()) == [(1, 1), (2, 2), (3, 2), (5, 1), (7, 1)]
    for edges in ([(3, 2), (2, 1)], [(3, 1), (3, 2)]):  # a node with a smaller and a larger neighbour; with two smaller ones
        roots = connected_components(spark.createDataFrame(edges, "a long, b long"), rounds=3).collect()
        assert sorted((r.node, r.root) for r in roots) == [(1, 1), (2, 1), (3, 1)]
    assert connected_components(spark.createDataFrame([], "a long, b long"), rounds=0).count() == 0
