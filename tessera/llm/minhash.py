"""Near duplicates by min-max hashing.

Each permutation of the shingle hashes keeps its minimum and its maximum, so a signature of 2k values costs k
hash evaluations. Bands of two permutations (four values) name buckets; documents that share a bucket are
candidates, and candidates are linked if their whole shingle sets agree. Documents with equal sets are one node
from the start. A bucket of many nodes is first compared with a few pivots; components found that way leave few
pairs across components, and those are then compared by an exact prefix filter, so no pair that shares a bucket
stays untested unless it is connected already or cannot be linked. Band choice: at similarity 0.8 a pair misses all
24 buckets with probability (1 - 0.8**4)**24 = 3e-6. Hot nodes, buckets and shingles are joined apart or split, so
that no task gets a crowd.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, split_keys, spread_join, table, written
from .components import connected_components

WORD_CACHE = 150_000
#: Counters of hash frequency that go to the driver and to each worker: 2 MB at any size.
SLOTS = 1 << 18
#: Nodes of one shingle that a task compares with the others of that shingle.
SHINGLE_BLOCK = 512
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[1]
    h = (h ^ (h >> np.uint64(29))) * MIX[2]
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z lower-cased; fewer words are one shingle."""

    def __init__(self, width: int):
        self.width, self.cache = width, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        cache = self.cache
        if len(cache) > WORD_CACHE:
            cache.clear()
        for w in set(words) - cache.keys() if len(cache) < len(words) else [w for w in set(words) if w not in cache]:
            cache[w] = xxhash.xxh64_intdigest(w)
        h = np.array([cache[w] for w in words], dtype=np.uint64)
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = mixed(out * MIX[0] + h[k : len(h) - width + 1 + k])
        return np.unique(out)


def signer(permutations: int, per_band: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """The band hashes of a set: `per_band` permutations, each with its minimum and maximum, make a band."""
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 2**63, permutations, dtype=np.uint64)

    def bands(shingles: np.ndarray) -> np.ndarray:
        low = np.full(permutations, np.iinfo(np.uint64).max, dtype=np.uint64)
        high = np.zeros(permutations, dtype=np.uint64)
        for at in range(0, len(shingles), 2048):
            h = a[:, None] * shingles[None, at : at + 2048] + b[:, None]
            low, high = np.minimum(low, h.min(axis=1)), np.maximum(high, h.max(axis=1))
        values = np.stack([low, high], axis=1).reshape(permutations // per_band, 2 * per_band)
        out = np.arange(len(values), dtype=np.uint64)
        for k in range(values.shape[1]):
            out = mixed(out * MIX[0] + values[:, k])
        return out.astype(np.int64)

    return bands


def _signatures(df: DataFrame, id_col: str, text_col: str, width: int, permutations: int, per_band: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, node (digest of the whole set, null if empty), bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, bands = Shingler(width), signer(permutations, per_band, seed)
        for batch in stream:
            ids, counts, nodes, keys = batch[0].to_pylist(), [], [], []
            for text in batch[1].to_pylist():
                s = shingle(text)
                counts.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(bands(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, schema.field("bands").type)], schema=schema)

    texts = df.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    return texts.mapInArrow(sign, "doc_id long, n_shingles long, node binary, bands array<long>")


def _sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, set) of the wanted (node, doc_id): the whole sorted sets, made anew from the texts."""
    schema = pa.schema([("node", pa.binary()), ("set", pa.binary())])

    def sets(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in stream:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [(n, s.tobytes()) for n, t in zip(part["node"].to_pylist(), part["text"].to_pylist(), strict=True) if xxhash.xxh3_128_digest((s := shingle(t)).tobytes()) == n]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], schema=schema)

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = texts.join(wanted, F.expr("doc_id <=> wanted_id")).select("node", "text")
    return joined.mapInArrow(sets, "node binary, set binary").dropDuplicates(["node"])


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * |both| >= percent * |either|."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def confirm(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            keep = []
            for i, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(keep, pa.int64())), batch["b"].take(pa.array(keep, pa.int64()))], schema=schema)

    first = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    # A pivot is in as many pairs as its bucket has nodes.
    pairs, firsts = split_keys(pairs, "a", "b", "part_a")
    pairs, seconds = split_keys(written(pairs, "pairs"), "b", "a", "part_b")
    joined = pairs.join(first.join(firsts, "a"), ["a", "part_a"]).join(second.join(seconds, "b"), ["b", "part_b"])
    return joined.select("a", "b", "x", "y").mapInArrow(confirm, "a binary, b binary")


def _possible(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different roots that may be linked, from (node, root, set): no link is left out.

    Two linked sets share one of the first n - ceil(percent * n / 100) + 1 hashes of either under any common order.
    The order puts rare hashes first, by a table of SLOTS counters, so that what many documents share names no pair.
    Sets of n and m hashes that are linked have at least o = percent * (n + m) / (100 + percent) in common, so the
    first common hash is followed by o - 1 more in either: its places are at most n - o and m - o.
    """

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(SLOTS, dtype=np.int64)
        for batch in stream:
            for s in batch["set"]:
                np.add.at(counters, (np.frombuffer(s.as_py(), dtype=np.uint64) % np.uint64(SLOTS)).astype(np.int64), 1)
        found = np.flatnonzero(counters)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(found, pa.int64()), "n": pa.array(counters[found], pa.int64())})

    # As Arrow: a row object for each of up to SLOTS counters would take the driver many times their 4 MB.
    counted = open_.select("set").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(SLOTS, dtype=np.int64)
    frequency[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    shared = open_.sparkSession.sparkContext.broadcast(frequency)
    schema = pa.schema([("shingle", pa.int64()), ("node", pa.binary()), ("root", pa.binary()), ("size", pa.int64()), ("at", pa.int64())])

    def prefixes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for node, root, s in zip(batch["node"].to_pylist(), batch["root"].to_pylist(), batch["set"], strict=True):
                h = np.frombuffer(s.as_py(), dtype=np.uint64)
                n = len(h) + (-percent * len(h) // 100) + 1
                first = h[np.lexsort((h, shared.value[(h % np.uint64(SLOTS)).astype(np.int64)]))[:n]]
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array([node] * n, pa.binary()), pa.array([root] * n, pa.binary()), pa.array([len(h)] * n, pa.int64()), pa.array(np.arange(n))], schema=schema)

    named = open_.select("node", "root", "set").mapInArrow(prefixes, "shingle long, node binary, root binary, size long, at long")
    named = written(named, "prefixes")
    busy = named.groupBy("shingle").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n")).filter("r0 <> r1").select("shingle", "n")
    # A shingle of many nodes is split: each part of its nodes meets all of them in a task of its own.
    held = spread_join(named, busy, "shingle", "n", named.count()).withColumn("parts", F.ceil(F.col("n") / SHINGLE_BLOCK).cast("int"))
    x = held.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("x")
    y = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    common = f"({percent} * (x.size + y.size) + {99 + percent}) div {100 + percent}"
    on = f"x.shingle = y.shingle AND x.part = y.part AND x.root <> y.root AND x.node < y.node AND x.at + {common} <= x.size AND y.at + {common} <= y.size"
    return x.join(y, F.expr(on)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_duplicates(
    df: DataFrame, width: int = 5, percent: int = 80, permutations: int = 48, per_band: int = 2, pivots: int = 3, seed: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept, for every row of df.

    Null and text without words have an empty set and link with nothing. Equal sets are linked. A null doc_id is
    never a component's id unless all its documents lack one; kept is doc_id = component_id, null-safe. Repeated
    rows give a row each. An empty table gives no rows; df's other columns are not used.
    """
    signed = written(_signatures(df, id_col, text_col, width, permutations, per_band, seed), "signatures")
    whole = signed.filter("node IS NOT NULL")
    nodes = whole.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "nodes")
    banded = nodes.select(F.explode("bands").alias("bucket"), "node", "size")
    n_nodes, n_docs = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    n_banded = n_nodes * (permutations // per_band)
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = written(spread_join(banded, shared, "bucket", "n", n_banded), "crowded")
    n_crowded = crowded.count()
    # A node that meets many others is near the middle of its group, so it comes first as a pivot.
    degree = crowded.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = crowded.join(degree, "node")
    spread = [F.max(F.struct("degree", "node")).alias("p0"), *[F.min(F.struct(F.xxhash64("node", F.lit(k)), "node")).alias(f"p{k}") for k in range(1, pivots)]]
    chosen = ranked.groupBy("bucket").agg(*spread, F.first("n").alias("n"))
    chosen = chosen.select("bucket", "n", F.array_distinct(F.array(*[F.col(f"p{k}.node") for k in range(pivots)])).alias("pivot"))
    members = written(spread_join(crowded.drop("n"), chosen, "bucket", "n", n_crowded), "members", instead_of=crowded)
    paired = members.select("node", F.explode("pivot").alias("other")).filter("node <> other")
    pairs = written(paired.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "pairs")
    touched = members.select("node").distinct().join(nodes.select("node", F.col("least").alias("wanted_id")), "node")
    sets = written(_sets(df, touched, id_col, text_col, width), "sets")
    links = written(_links(pairs, sets, percent), "links")
    roots = connected_components(links)
    # Buckets of several components: their documents are compared across components, as far as a link is possible.
    placed = written(members.select("bucket", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed", instead_of=members)
    split = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.first("n").alias("of")).filter("r0 <> r1").select("bucket", "of")
    open_ = spread_join(placed, split, "bucket", "of", n_crowded).select("node", "root").distinct()
    rest = _possible(written(open_.join(sets, "node"), "open"), percent).join(pairs, ["a", "b"], "left_anti")
    more = written(_links(written(rest, "pairs"), sets, percent), "links")
    if not more.isEmpty():
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
    # A root's members grow with its component; a root of many is joined apart.
    named = written(roots.join(nodes.select("node", "least"), "node"), "roots")
    lowest = named.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("of"))
    component = spread_join(named, lowest, "root", "of", n_nodes).select("node", "component")
    every = nodes.select("node", "least", "copies").join(component, "node", "left").select("node", "copies", F.coalesce("component", "least").alias("component"))
    every = written(every, "classes")
    all_ = signed.select("doc_id", "n_shingles", "node")
    blank = all_.filter("node IS NULL").select("*", F.lit(0).cast("long").alias("copies"), F.lit(None).cast("long").alias("component"))
    joined = spread_join(all_.filter("node IS NOT NULL"), every, "node", "copies", n_docs).unionByName(blank)
    out = joined.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of df that near_duplicates() keeps, one of each group; a repeated row stays once."""
    kept = near_duplicates(df, id_col=id_col, text_col=text_col, **settings).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    held = packed(df).withColumn("id", F.col("record").getField(id_col).cast("long")).withColumn("h", F.xxhash64(F.col("record").getField(text_col)))
    return held.join(kept, F.expr("id <=> kept_id"), "left_semi").dropDuplicates(["id", "h"]).select("record.*")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


QUERIES = {"op5_minhash": op5_minhash}
ORACLE_SQL: dict[str, str] = {}
