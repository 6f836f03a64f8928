"""Quality classifier with hierarchical empirical Bayes.

A document's evidence is a logistic model of whole-text statistics and of its words, whose log likelihood ratios under
good and bad labels are counted in hashed slots. Both are fitted on a bounded sample of labelled rows; the ratios that
the logistic model is fitted on come from the other half of the sample, so no document scores itself.

The labels of all rows give each site's quality: counts of good labels are summed by host (the source) and by path
(language within the source); a host shrinks towards the global share and a path towards its host by pseudo-counts
estimated by moments from the spread between sites (empirical Bayes), so sparse sites stay near their parents. A
labelled document is left out of its own sites. A document's posterior odds are its evidence's odds times its path's
odds over the global ones. All sums are grouped aggregates over all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, sampled, spread_join, table, unpacked, written

#: At most this many labelled rows train the model, the first by a seeded hash of the id.
SAMPLE_ROWS = 20_000
#: Estimates of up to this many sites are broadcast (under 10 MB); more are joined by shuffling.
BROADCAST_SITES = 50_000
#: Labels of up to this many documents are broadcast (under 4 MB); more are joined by shuffling.
BROADCAST_LABELS = 200_000
#: Slots of hashed words: two tables of this size are all that the words' ratios take, whatever the vocabulary.
WORD_SLOTS = 4096
#: Bytes that are counted: white space, symbols, capitals, punctuation, digits; a row of 0 and 1 over all bytes for each.
CLASSES = np.array([np.isin(np.arange(256), list(c)) for c in (b" \t\n\x0b\f\r", b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?.,;:|*&%$#", b"0123456789")], dtype=np.int64)
#: Word hashes that a worker remembers.
WORD_CACHE = 150_000
#: Words in a repeated window.
SPAN = 5


class TextStatistics:
    """Eight statistics of a whole text on bounded scales, and the slots of its words."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: str) -> tuple[list[float], np.ndarray]:
        body = text.encode("utf-8", "surrogatepass")
        tokens = body.split()
        cache = self.cache
        if len(cache) > WORD_CACHE:
            cache.clear()
        for w in set(tokens).difference(cache):
            cache[w] = xxhash.xxh64_intdigest(w)
        hashes = np.fromiter(map(cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        counts = np.bincount(np.frombuffer(body, dtype=np.uint8), minlength=256)
        white, symbols, capitals, punctuation, digits = (CLASSES @ counts).tolist()
        word_chars = float(len(text)) - white
        lines = [x for x in body.split(b"\n") if x.strip()]
        n, chars = len(tokens) + 10.0, word_chars + 50.0
        found = [
            math.log(chars / n),
            math.sqrt(symbols / chars),
            math.sqrt((len(lines) - len(set(lines))) / n),
            math.sqrt(repeated_words(hashes) / n),
            math.sqrt(capitals / chars),
            math.sqrt(punctuation / chars),
            math.sqrt(digits / chars),
            math.log(n) / 5,
        ]
        return found, (hashes % np.uint64(WORD_SLOTS)).astype(np.int64)


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows of SPAN words that occur twice or more, the first time included."""
    places = len(hashes) - SPAN + 1
    if places < 2:
        return 0
    windows = np.zeros(places, dtype=np.uint64)
    for k in range(SPAN):
        windows = (windows ^ hashes[k : k + places]) * np.uint64(0x9E3779B97F4A7C15)
        windows ^= windows >> np.uint64(29)
    ordered = np.sort(windows)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    starts = np.flatnonzero(times[which] > 1)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + SPAN, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def vectors_of(texts: list[str], ratios: list[np.ndarray], stats: TextStatistics) -> list[list[float]]:
    """The statistics of each text and the mean ratio of its words, by each text's own table."""
    out = []
    for text, table_ in zip(texts, ratios, strict=True):
        found, slots = stats(text)
        out.append([*found, float(table_[slots].sum()) / (len(slots) + 10)])
    return out


def word_ratios(counts: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of each slot, good against bad, from counts (2, slots) of bad and good words."""
    smoothed = counts + 1.0
    shares = smoothed / smoothed.sum(axis=1, keepdims=True)
    return np.log(shares[1]) - np.log(shares[0])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (bias last) of a ridge-penalised logistic regression, by Newton steps."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = ridge * len(x) * np.eye(len(w)) / 10
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _clamped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))


def _strength(sites: DataFrame, parent: str) -> float:
    """Pseudo-counts of the prior, by moments: how much site means spread beyond what their counts explain.

    sites has n, mean and the parent's mean; the more sites agree with their parent, the larger the strength.
    """
    p = F.col(parent)
    noise, spread = F.sum(p * (1 - p)), F.sum(F.col("n") * (F.col("mean") - p) ** 2)
    total, squares, count = F.sum("n"), F.sum(F.col("n") * F.col("n")), F.count(F.lit(1))
    a = sites.agg(noise.alias("noise"), spread.alias("spread"), total.alias("n"), squares.alias("n2"), count.alias("k"), F.sum(F.col("n") * p * (1 - p)).alias("within")).first()
    if not a["k"] or a["k"] < 2 or not a["within"]:
        return 1000.0
    base = a["within"] / a["n"]
    between = (a["spread"] - a["noise"]) / max(a["n"] - a["n2"] / a["n"], 1e-9)
    return float(min(max(base / between - 1, 1.0), 1e4)) if between > 0 else 1e4


def _keyed(value: Column) -> Column:
    """A key that is never null, so that a null joins as a value of its own."""
    return F.to_json(F.struct(value.cast("string").alias("k")))


def _evidence(rows: DataFrame, labelled: int, sample_rows: int) -> Column:
    """The evidence of rows (id, label, body) as an expression of `body`."""
    sample = sampled(rows.filter("label IS NOT NULL"), F.xxhash64(F.lit(10), "id"), sample_rows, labelled)
    half = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(2)).cast("int")
    sample = written(sample.select("label", F.coalesce("body", F.lit("")).alias("body"), half.alias("half")), "classifier-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, counts = TextStatistics(), np.zeros((2, 2, WORD_SLOTS), dtype=np.int64)
        for batch in batches:
            for text, label, half in zip(*[batch[c].to_pylist() for c in ("body", "label", "half")], strict=True):
                counts[half, label] += np.bincount(stats(text)[1], minlength=WORD_SLOTS)
        at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in at], pa.array(counts[at])], names=["half", "label", "slot", "n"])

    found = sample.mapInArrow(count, "half long, label long, slot long, n long").groupBy("half", "label", "slot").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, 2, WORD_SLOTS))
    for r in found.collect():  # 4 * WORD_SLOTS rows at most
        counts[r["half"], r["label"], r["slot"]] = r["n"]
    n_good, n = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < n_good < n:
        return F.lit(n_good / n if n else 1.0)
    other = [word_ratios(counts[1]), word_ratios(counts[0])]
    whole = word_ratios(counts.sum(axis=0))

    @F.arrow_udf("array<double>")
    def crossed(texts: pa.Array, halves: pa.Array) -> pa.Array:
        return pa.array(vectors_of(texts.to_pylist(), [other[h] for h in halves.to_pylist()], TextStatistics()), pa.list_(pa.float64()))

    held = sample.select("label", crossed("body", "half").alias("x")).toPandas()
    mean, scale, w = fit_logistic(np.array(held["x"].tolist(), dtype=float), held["label"].to_numpy(dtype=float))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        stats = TextStatistics()
        for texts in batches:
            parts = []
            for at in range(0, len(texts), 512):
                part = texts.slice(at, 512).to_pylist()
                z = (np.array(vectors_of(part, [whole] * len(part), stats)) - mean) / scale
                parts.append(1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -40, 40))))
            yield pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return scored(F.coalesce("body", F.lit("")))


def _sites(rows: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(site, labels and good ones of path and host, rows) of every path, the global prior, and the strengths of prior and host.

    rows has site (host, path) and label (null, 0 or 1).
    """
    paths = written(rows.groupBy("site").agg(F.count(F.lit(1)).alias("rows"), F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("good")), "sites")
    n, good = paths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    prior = min(max(good / n if n else 1.0, 1e-6), 1 - 1e-6)
    hosts = written(paths.groupBy(F.col("site.host").alias("host")).agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"), F.count(F.lit(1)).alias("paths")), "hosts")
    known = hosts.filter("host_n > 0").select(F.col("host_n").alias("n"), (F.col("host_good") / F.col("host_n")).alias("mean"), F.lit(prior).alias("global"))
    m0 = _strength(known, "global")
    placed = written(spread_join(paths.withColumn("host", F.col("site.host")), hosts, "host", "paths", paths.count()), "placed")
    host_mean = (F.col("host_good") + F.lit(m0 * prior)) / (F.col("host_n") + F.lit(m0))
    m1 = _strength(placed.filter("n > 0").select("n", (F.col("good") / F.col("n")).alias("mean"), host_mean.alias("host_mean")), "host_mean")
    return placed.select("site", "rows", "n", "good", "host_n", "host_good"), prior, m0, m1


def classify_quality(
    df: DataFrame, labels: DataFrame, carry: list[str] | None = None, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang"
) -> DataFrame:
    """The columns `carry` of df (all by default) with evidence, site_quality, p_quality and kept.

    `evidence` is the model's own probability, `site_quality` the path's posterior mean without the document's own
    label, `p_quality` their combination; kept if it reaches `threshold`. Null and empty texts are judged by their
    statistics like others; null hosts and paths are sites of their own. A labelled id with several rows counts with
    each; rows with null labels or ids have no label, and of unlike labels of an id the worse counts. Without labels of
    both kinds the evidence is the share of good labels (1 without any). An empty table gives no rows. Input columns
    named like an added one are replaced.
    """
    added = ["evidence", "site_quality", "p_quality", "kept"]
    of = F.col("record").getField
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg((F.min("quality") > 0).cast("int").alias("label"))
    known = written(known, "labels")
    few_labels = known.count() <= BROADCAST_LABELS
    rows = packed(df).join(F.broadcast(known) if few_labels else known, of(id_col) == F.col("label_id"), "left")
    rows = rows.select(
        of(id_col).alias("id"), "label", of(text_col).alias("body"), F.struct(_keyed(of(host_col)).alias("host"), _keyed(of(path_col)).alias("path")).alias("site"),
        F.struct(*[of(c).alias(c) for c in (carry if carry is not None else df.columns)]).alias("record"),
    )
    sites, prior, m0, m1 = _sites(rows.select("site", "label"))
    labelled, total, n_sites = sites.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    evidence = _evidence(rows.select("id", "label", "body"), labelled, sample_rows)
    scored = rows.select("record", "label", "site", _clamped(evidence).alias("evidence"))
    joined = _with_sites(scored, sites, n_sites, total)
    own, one = F.coalesce("label", F.lit(0)), F.col("label").isNotNull().cast("int")
    host = (F.col("host_good") - own + F.lit(m0 * prior)) / (F.col("host_n") - one + F.lit(m0))
    path = (F.col("good") - own + F.lit(m1) * host) / (F.col("n") - one + F.lit(m1))
    out = joined.withColumn("site_quality", path)
    odds = _logit(F.col("evidence")) - F.lit(float(np.log(prior / (1 - prior)))) + _logit(_clamped(F.col("site_quality")))
    out = out.withColumn("p_quality", 1 / (1 + F.exp(-odds)))
    return unpacked(out.withColumn("kept", F.col("p_quality") >= F.lit(threshold)), added)


def _with_sites(scored: DataFrame, sites: DataFrame, n_sites: int, total: int) -> DataFrame:
    """scored joined to its site's counts: broadcast where the sites are few, else with hot sites apart."""
    key = F.to_json("site")
    scored, sites = scored.withColumn("of", key), sites.withColumn("of", key).drop("site")
    return scored.join(F.broadcast(sites), "of") if n_sites <= BROADCAST_SITES else spread_join(scored, sites, "of", "rows", total)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
