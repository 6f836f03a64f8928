"""Approximate nearest neighbours by shifted space-filling curves.

Each of several curves projects the vectors at random, shifts them and orders them by Hilbert key; the key space is
cut into ranges of equal share, and Spark deals the vectors out by (curve, range). A query joins the ranges around
its own on every curve; each range returns its best by exact inner product, and the results merge. For the largest
inner product, vectors get one more coordinate that lifts them to equal length, and queries are scaled to that
length, so the nearest by angle is the largest by product. The hundredth part of the vectors that is longest is set
apart, so that no outlier flattens the rest, and meets every query. Equal vectors are one node with its smallest ids.
A window holds a share of the table, and a number of vectors at least: in a table of few vectors, most or all of them.
A query whose windows hold fewer than k others is compared with every vector, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import sampled, table, written

#: At most this many vectors, by a hash of the node, fit the scales of the projections and the range bounds.
SAMPLE_ROWS = 20_000
#: Vectors and queries of one block.
BLOCK_ROWS = 4096
#: Vectors of a window on each curve, at least.
LEAST_MET = 512
#: The share of vectors that the lifting covers; longer ones are compared with every query.
COVERED = 0.99


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of non-negative integer points (n, d) below 2**bits; d * bits is 63 at most."""
    x = cells.T.astype(np.uint64).copy()
    one, zero = np.uint64(1), np.uint64(0)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(len(x)):
            inside = (x[i] & bit) != 0
            swap = np.where(inside, zero, (x[0] ^ x[i]) & below)
            x[0] = np.where(inside, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        flips = np.where((x[-1] & np.uint64(1 << level)) != 0, flips ^ np.uint64((1 << level) - 1), flips)
    x ^= flips
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key


class Curves:
    """Projections, shifts, scales and range bounds; made on the driver from a sample, sent to the workers."""

    def __init__(self, dims: int, curves: int, projected: int, bits: int, ranges: int, longest: float, seed: int):
        draw = np.random.default_rng(seed)
        self.bits, self.ranges, self.longest = bits, ranges, longest
        projected = min(projected, dims + 1)
        self.planes = [np.linalg.qr(draw.normal(size=(dims + 1, projected)))[0] for _ in range(curves)]
        self.shifts = [draw.uniform(-0.17, 0.17, projected) for _ in range(curves)]
        self.low = self.span = self.bounds = None

    def lifted(self, v: np.ndarray, as_query: bool) -> np.ndarray:
        # By the largest component first: squares of very large or small ones would leave the range of doubles.
        peak = np.abs(v).max(axis=1, keepdims=True)
        unit = v / peak
        norms = np.linalg.norm(unit, axis=1, keepdims=True)
        if as_query:
            return np.hstack([unit / norms, np.zeros((len(v), 1))])
        length = np.minimum(norms * np.minimum(peak / self.longest, 1e9), 1)  # longer ones stand where the longest do
        return np.hstack([unit / norms * length, np.sqrt(1 - length**2)])

    def fit(self, v: np.ndarray) -> None:
        lifted = self.lifted(v, False)
        points = [lifted @ p for p in self.planes]
        self.low = [np.quantile(p, 0.01, axis=0) for p in points]
        self.span = [np.maximum(np.quantile(p, 0.99, axis=0) - low, 1e-12) for p, low in zip(points, self.low, strict=True)]
        shares = np.arange(1, self.ranges) / self.ranges
        self.bounds = [np.sort(self._keys(p, c))[(shares * len(v)).astype(int)] for c, p in enumerate(points)]

    def _keys(self, points: np.ndarray, c: int) -> np.ndarray:
        unit = (points - self.low[c]) / self.span[c] * 0.66 + 0.17 + self.shifts[c]
        return hilbert_keys((np.clip(unit, 0, 1 - 1e-9) * (1 << self.bits)).astype(np.int64), self.bits)

    def ranges_of(self, v: np.ndarray, as_query: bool) -> np.ndarray:
        """(curves, n) range numbers."""
        lifted = self.lifted(v, as_query)
        return np.stack([np.searchsorted(b, self._keys(lifted @ p, c), side="right") for c, (p, b) in enumerate(zip(self.planes, self.bounds, strict=True))])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1) if rows else np.empty((0, 1))


def _best(queries: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int) -> list[list[tuple[float, int]]]:
    """The k best (score, id) for each query, ties to the smaller id; scores are left-to-right sums of products.

    The matrix product rounds otherwise, so every vector within a rounding margin of the k-th best is scored exactly:
    none that could be among the k best, or tie with them, is lost.
    """
    out = []
    with np.errstate(over="ignore", invalid="ignore"):  # products beyond the range of doubles are infinite, or no number and last
        lengths = np.linalg.norm(vectors, axis=1).max(initial=0.0)
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = part @ vectors.T
            last = len(vectors) - min(k, len(vectors))
            least = np.partition(scores, last, axis=1)[:, last] - 1e-12 * vectors.shape[1] * lengths * np.linalg.norm(part, axis=1)
        for query, row, bound in zip(part, scores, least, strict=True):
            near = np.flatnonzero(row >= bound) if np.isfinite(bound) and np.isfinite(row).all() else np.arange(len(row))
            with np.errstate(over="ignore", invalid="ignore"):
                exact = np.cumsum(query * vectors[near], axis=1)[:, -1]
            exact = np.where(np.isnan(exact), -np.inf, exact)
            out.append(sorted(((float(s), i) for n, s in zip(near, exact, strict=True) for i in ids[n]), key=lambda x: (-x[0], x[1]))[:k])
    return out


def nearest_neighbours(
    df: DataFrame, is_query, k: int = 20, curves: int = 24, projected: int = 6, bits: int = 5, ranges: int = 128, around: int = 2, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product found for each row of is_query.

    Every row but the query's own is a candidate. Vectors that are null, zero, of another length than most, or
    hold nulls or non-finite values take no part, nor do null ids. Ties go to the smaller id; rows that agree in id
    and vector are one row. Fewer than k other rows give as many as there are. An empty table gives no rows. A query
    is scored on each curve against (2 around + 1) / ranges of the table or LEAST_MET vectors, whichever are more, and
    against the vectors longer than COVERED of all. Products beyond the range of doubles are infinite, or last where
    they are no number.
    """
    vector = F.col(vector_col).cast("array<double>")
    valid = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"), is_query.alias("asks")).filter("vec_id IS NOT NULL AND size(v) > 0")
    valid = valid.filter(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0))
    valid = valid.withColumn("node", F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v")))).dropDuplicates(["vec_id", "node"])
    common = valid.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    result = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return df.sparkSession.createDataFrame([], result)
    valid = written(valid.filter(F.size("v") == common["dims"]), "vectors")
    first = Window.partitionBy("node").orderBy("vec_id")
    lowest = valid.select("node", "vec_id").withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1)
    ids = lowest.groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = valid.groupBy("node").agg(F.first("v").alias("v"), F.max("asks").alias("asks")).join(ids, "node")
    nodes = written(nodes, "nodes")
    peak = F.array_max(F.transform("v", F.abs))
    norm = peak * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / peak) * (x / peak)))
    nodes = nodes.withColumn("norm", norm)
    longest, distinct = nodes.agg(F.percentile_approx("norm", COVERED, 10_000), F.count(F.lit(1))).first()
    index = Curves(common["dims"], curves, projected, bits, ranges, longest, seed)
    sample = sampled(nodes, F.xxhash64(F.lit(seed), "node"), SAMPLE_ROWS, distinct).select("v").toPandas()["v"].tolist()
    index.fit(np.array(sample, dtype=np.float64))
    width = min(max(2 * around + 1, math.ceil(LEAST_MET * ranges / distinct)), ranges)

    def place(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors as bytes, their range on each curve, and the first range of the window of those that ask."""
        for batch in stream:
            m = np.array(batch["v"].to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
            if not len(m):
                continue
            # A window is shifted inwards at the ends, so that each has as many ranges.
            held, sought = index.ranges_of(m, False), np.clip(index.ranges_of(m, True) - width // 2, 0, ranges - width)
            raw = pa.array([r.tobytes() for r in m], pa.binary())
            lists = [pa.array(x.T.astype(np.int32).tolist(), pa.list_(pa.int32())) for x in (held, sought)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("node", "asks", "ids", "long")], raw, *lists], names=["node", "asks", "ids", "long", "raw", "held", "sought"])

    long = (F.col("norm") > F.lit(longest)).alias("long")
    placed = nodes.select("node", "asks", "ids", long, "v").mapInArrow(place, "node string, asks boolean, ids array<long>, long boolean, raw binary, held array<int>, sought array<int>")
    placed = written(placed, "placed")
    vectors = placed.select(F.posexplode("held").alias("curve", "part"), "node", "raw", "ids")
    every = [F.lit(-1).alias("curve"), F.lit(0).alias("part"), "node", "raw"]
    vectors = vectors.unionByName(placed.filter("long").select(*every, "ids"))
    queries = placed.filter("asks").select(F.posexplode("sought").alias("curve", "first"), "node", "raw")
    queries = queries.select("curve", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + width, F.lit(ranges)) - 1)).alias("part"), "node", "raw").unionByName(placed.filter("asks").select(*every))
    found = written(_searched(vectors, queries, k), "found")
    # Few vectors in the windows: the query meets all, as a curve of one range.
    enough = found.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k).select("node")
    one = lambda df, *more: df.select(F.lit(0).alias("curve"), F.lit(0).alias("part"), "node", "raw", *more)
    short = written(one(placed.filter("asks").join(enough, "node", "left_anti")), "short")
    if not short.isEmpty():
        found = found.join(short.select("node"), "node", "left_anti").unionByName(_searched(one(placed, "ids"), short, k))
    asking = valid.filter("asks").select(F.col("vec_id").alias("query_id"), "node")
    answers = asking.join(found, "node").filter("query_id <> vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(node, vec_id, score): the k + 1 best of each query among the vectors of its (curve, part) cells.

    A cell with many vectors or queries is split into blocks; every pair of blocks of a cell meets.
    """
    counted = [df.groupBy("curve", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name)) for df, name in ((vectors, "blocks"), (queries, "teams"))]
    # One row a cell: curves times ranges at most, whatever the table.
    split = F.broadcast(counted[0].join(counted[1], ["curve", "part"]).coalesce(1))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    vectors = vectors.join(split, ["curve", "part"]).select("curve", "part", "node", "raw", "ids", own("blocks").alias("block"), spread("teams").alias("team"))
    # Renamed, since both tables may come from one and cogroup() tells their columns apart by origin.
    queries = queries.join(split, ["curve", "part"]).select("curve", "part", F.col("node").alias("node"), F.col("raw").alias("raw"), own("teams").alias("team"), spread("blocks").alias("block"))

    def search(asks: pa.Table, held: pa.Table) -> pa.Table:
        found = _best(_matrix(asks["raw"]), _matrix(held["raw"]), held["ids"].to_pylist(), k + 1) if len(held) and len(asks) else []
        names = asks["node"].to_pylist() if found else []
        flat = [(n, s, i) for n, best in zip(names, found, strict=True) for s, i in best]
        columns = list(zip(*flat, strict=True)) if flat else [[], [], []]
        return pa.table({"node": pa.array(columns[0], pa.string()), "score": pa.array(columns[1], pa.float64()), "vec_id": pa.array(columns[2], pa.int64())})

    keys = ["curve", "part", "block", "team"]
    found = queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(search, "node string, score double, vec_id long")
    found = found.groupBy("node", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1).select("node", "vec_id", "score")


def op7_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op7_hilbert_ann": op7_hilbert_ann}
ORACLE_SQL: dict[str, str] = {}
