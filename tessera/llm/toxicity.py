"""Toxicity by a weighted lexicon: texts are folded, matched by one Aho-Corasick automaton and judged by weight for their length."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import packed, sampled, table, unpacked, written

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = str.maketrans("авекмнорстухіјѕԁһԛԝғαβενικορτυχγωıɑɡ", "abekmhopctyxijsdhqwfabevikoptuxywiag")
INVISIBLE = dict.fromkeys([0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF])
SIGNS = str.maketrans("0134578@$!|", "oieastbasil")
#: Insults that the lexicon starts from; labels raise or lower their weights.
SEEDS = tuple("clown creep disgusting dumb filth fool freak garbage idiot imbecile jerk loser moron pathetic scum stupid trash ugly vermin worthless".split())
#: Phrases in which such a word insults nobody.
EXCEPTIONS = tuple("class clown|clown fish|compost garbage|garbage bag|garbage can|garbage collection|garbage collector|jerk chicken|pond scum|soap scum|trash bag|trash bin|trash can|white trash bag".split("|"))
#: Labelled rows that the lexicon and its calibration are learned from, at most, and terms that it holds, at most.
SAMPLE_ROWS, LEXICON_TERMS = 20_000, 2_000
#: Log odds of a seed before labels, and the occurrences that this counts for.
SEED_WEIGHT, SEED_COUNT = 3.0, 20
#: Evidence (twice a log likelihood ratio) and rows that a term must have, and the letters of stems.
LEAST_EVIDENCE, LEAST_ROWS, STEMS = 18.0, 4, range(3, 10)
#: Occurrences of a term in a row that count.
CLIP = 5

_SUSPECT = re.compile("[­ıɑɡͰ-ϿЀ-ԯ​-‏‪-‮⁠-⁤﻿]")
_SIGN = re.compile(r"(?<=[^\W\d_])[0134578]+(?![0-9])|(?<![0-9])[0134578]+(?=[^\W\d_])|(?<![^\W_])[@$!](?=[^\W\d_])|(?<=[^\W\d_])[@$!|]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> tuple[str, int]:
    """(words in small Latin letters, each after a space and the last before one; their number).

    Compatibility forms, look-alike letters, invisible characters, and digits and signs within or at words are
    folded; accents stay, since they tell words of many languages apart.
    """
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii() and _SUSPECT.search(text):
        text = text.translate(INVISIBLE).translate(HOMOGLYPHS)
    words = _WORD.findall(_SIGN.sub(lambda m: m[0].translate(SIGNS), text))
    return (f" {' '.join(words)} " if words else " "), len(words)


def sketch(folded: str) -> int:
    """The least checksum of its five-word windows: near copies mostly share it."""
    words = folded.split()
    return min((zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(len(words) - 4, 1))), default=0)


def candidate_terms(words: Iterable[str]) -> Counter:
    """Clipped occurrences of whole words (` word `) and stems (` stem`)."""
    out: Counter = Counter()
    for word, n in Counter(words).items():
        if 2 < len(word) <= 40:
            out[f" {word} "] += n
            for k in STEMS:
                if k > len(word):
                    break
                out[f" {word[:k]}"] += n
    return out


class Lexicon:
    """Weighted terms and exception phrases in one automaton over folded texts.

    Terms start with a space; those that end with one are whole words, the others stems. A word counts once, with its
    heaviest term, unless it starts within an exception phrase.
    """

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {term: [len(term), w, False] for term, w in weights.items()}
        for phrase in exceptions:
            folded = fold(phrase)[0]
            if folded != " ":
                entries.setdefault(folded, [len(folded), 0.0, False])[2] = True
        for term, entry in entries.items():
            self.automaton.add_word(term, tuple(entry))
        self.empty = not entries
        if entries:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Weights by the place of each matched word."""
        found: dict[int, float] = {}
        benign: list[tuple[int, int]] = []
        for end, (length, weight, excepted) in () if self.empty else self.automaton.iter(folded):
            start = end - length + 1
            if excepted:
                benign.append((start, end))
            if weight > found.get(start, 0.0):
                found[start] = weight
        if not benign or not found:
            return found
        # Phrases come in order of their ends; a word lies within one if some phrase that starts before it ends after it.
        benign.sort()
        starts = np.array([s for s, _ in benign])
        reach = np.maximum.accumulate([e for _, e in benign])
        at = {w: int(np.searchsorted(starts, w, side="right")) - 1 for w in found}
        return {w: x for w, x in found.items() if at[w] < 0 or reach[at[w]] <= w}

    def features(self, text: str | None) -> tuple[float, float]:
        folded, n = fold(text)
        return evidence(math.fsum(self.hits(folded).values()), n)


def evidence(weight: float, n_words: int) -> tuple[float, float]:
    """Total weight and weight for 100 words (of 20 more than there are), on a log scale."""
    return math.log1p(weight), math.log1p(100 * weight / (n_words + 20))


#: Bias and weights of the two features that calibration starts from.
PRIOR = np.array([-3.0, 0.5, 1.0])


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 50) -> np.ndarray:
    """Logistic regression of labels on the features, drawn to PRIOR as if by a few rows; PRIOR without rows."""
    z, w = np.hstack([np.ones((len(x), 1)), x]), PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(3), z.T @ (y - p) - ridge * (w - PRIOR))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _training_rows(df: DataFrame, labels: DataFrame, learn_from: Column, sample_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(toxic, folded, n_words) of a bounded sample of labelled rows, one of each group of near copies and label."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn_from)
    known = known.groupBy(F.col("doc_id").alias("label_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = written(known, "toxicity-labels")
    sample = sampled(known, F.xxhash64(F.lit(11), "label_id"), sample_rows, known.count())
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("label_id")).select("toxic", "text")

    def folded(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [fold(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["toxic"], pa.array([t for t, _ in texts], pa.string()), pa.array([n for _, n in texts], pa.int64()), pa.array([sketch(t) for t, _ in texts], pa.int64())], names=["toxic", "folded", "n_words", "sketch"])

    rows = written(rows.mapInArrow(folded, "toxic int, folded string, n_words long, sketch long"), "toxicity-sample")
    one = F.row_number().over(Window.partitionBy("sketch", "toxic").orderBy(F.xxhash64("folded"), "folded"))
    return written(rows.withColumn("one", one).filter("one = 1").drop("one", "sketch"), "toxicity-rows", instead_of=rows)


def _term_counts(rows: DataFrame) -> DataFrame:
    """term, and by label rows that hold it, rows that hold it twice at least, and clipped occurrences."""
    names = ["docs_0", "docs_1", "twice_0", "twice_1", "n_0", "n_1"]

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(held), 50_000):
                terms = list(held)[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([held[t][k] for t in terms], pa.int64()) for k in range(6)]], names=["term", *names])
            held.clear()

        for batch in stream:
            for toxic, folded in zip(batch["toxic"].to_pylist(), batch["folded"].to_pylist(), strict=True):
                for term, n in candidate_terms(folded.split()).items():
                    row = held.get(term)
                    if row is None:
                        row = held[term] = [0] * 6
                    row[toxic] += 1
                    row[2 + toxic] += n > 1
                    row[4 + toxic] += min(n, CLIP)
                if len(held) > 500_000:
                    yield from out()
        yield from out()

    found = rows.mapInArrow(count, "term string, " + ", ".join(f"{c} long" for c in names))
    return found.groupBy("term").agg(*[F.sum(c).alias(c) for c in names])


def _likelihood_ratio(event: str, d0: int, d1: int) -> Column:
    """Twice the log likelihood ratio of the event's shares in d0 and d1 rows of the labels against one common share."""
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))
    n = F.col(f"{event}_0") + F.col(f"{event}_1")
    both = lambda k, d: part(F.col(f"{event}_{k}"), n * F.lit(d / (d0 + d1))) + part(F.lit(d) - F.col(f"{event}_{k}"), (F.lit(d0 + d1) - n) * F.lit(d / (d0 + d1)))
    return 2 * (both(0, d0) + both(1, d1))


def choose_terms(candidates: list[tuple[str, float, float]], most: int) -> dict[str, float]:
    """Weights of the terms (term, evidence, weight) by falling evidence, without stems and extensions of chosen ones."""
    chosen: dict[str, float] = {}
    stems_of_chosen: set[str] = set()
    for term, _, weight in sorted(candidates, key=lambda c: (-round(c[1], 6), -len(c[0].strip()), c[0].endswith(" "), c[0])):
        stem = term.rstrip(" ")
        if stem in stems_of_chosen or any(stem[:k] in chosen or f"{stem[:k]} " in chosen for k in range(4, len(stem) + 1)):
            continue
        chosen[term] = weight
        stems_of_chosen.update(stem[:k] for k in range(4, len(stem) + 1))
        if len(chosen) == most:
            break
    return chosen


def learn_lexicon(rows: DataFrame, seeds: Iterable[str] = SEEDS, most: int = LEXICON_TERMS) -> dict[str, float]:
    """Log odds of occurrences by label, of seeds and of terms that rows labelled toxic hold far more often than others."""
    totals = rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("n")).collect()
    docs, words = ({r["toxic"]: max(r[c], 1) for r in totals} for c in ("docs", "n"))
    seed_terms = [f" {s} " for s in seeds]
    if not totals:
        return dict.fromkeys(seed_terms, SEED_WEIGHT)
    d0, d1, w0, w1 = docs.get(0, 1), docs.get(1, 1), words.get(0, 1), words.get(1, 1)
    counted = _term_counts(rows).withColumn("weight", F.log((F.col("n_1") + 0.5) / F.lit(w1 + 1.0)) - F.log((F.col("n_0") + 0.5) / F.lit(w0 + 1.0)))
    counted = counted.withColumn("evidence", F.greatest(_likelihood_ratio("docs", d0, d1), _likelihood_ratio("twice", d0, d1)))
    strong = (F.col("evidence") >= LEAST_EVIDENCE) & (F.col("docs_1") >= LEAST_ROWS) & (F.col("weight") >= math.log(3))
    counted = written(counted.filter(strong | F.col("term").isin(seed_terms)), "toxicity-terms")
    found = counted.filter(strong).orderBy(F.desc("evidence"), "term").limit(20 * most).collect()
    chosen = choose_terms([(r["term"], r["evidence"], r["weight"]) for r in found], most)
    known = {r["term"]: r for r in counted.filter(F.col("term").isin(seed_terms)).collect()}
    for term in seed_terms:
        seen = known[term]["n_0"] + known[term]["n_1"] if term in known else 0
        own = (SEED_COUNT * SEED_WEIGHT + (seen * known[term]["weight"] if seen else 0)) / (SEED_COUNT + seen)
        if own > 0:
            chosen[term] = max(own, chosen.get(term, 0.0))
    return chosen


def score_toxicity(
    df: DataFrame, labels: DataFrame, learn_from: Column | None = None, threshold: float = 0.3, carry: list[str] | None = None, exceptions: Iterable[str] = EXCEPTIONS,
    seeds: Iterable[str] = SEEDS, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The columns `carry` of df (all by default) with score (0 to 1) and predicted (1 from `threshold` on, else 0).

    labels has doc_id and toxic; `learn_from` says of its rows which may be learned from (all by default). At most
    `sample_rows` of them are, by hash of the id, and of near copies with one label one. A score depends on the text
    alone. Null and empty texts have no hits; equal texts have equal scores, whatever their length, and each row is
    scored once. Labels with a null id or value do not count, and of unlike ones of an id the toxic one does; without
    any, the lexicon is `seeds` and the calibration PRIOR. An empty table gives no rows. Input columns named score or
    predicted are replaced.
    """
    rows = _training_rows(df, labels, F.lit(True) if learn_from is None else learn_from, sample_rows, id_col, text_col)
    weights, phrases = learn_lexicon(rows, seeds), tuple(exceptions)

    @F.arrow_udf("struct<weight double, n long>")
    def weighed(texts: pa.Array, counts: pa.Array) -> pa.Array:
        lexicon = Lexicon(weights, phrases)
        found = [math.fsum(lexicon.hits(t).values()) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(found, pa.float64()), counts.cast(pa.int64())], names=["weight", "n"])

    held = rows.select("toxic", weighed("folded", "n_words").alias("w")).select("toxic", "w.*").toPandas()  # sample_rows at most
    x = np.array([evidence(w, n) for w, n in zip(held["weight"], held["n"], strict=True)], dtype=float).reshape(-1, 2)
    bias = calibrate(x, held["toxic"].to_numpy(dtype=float))

    @F.arrow_udf("double")
    def scored(stream: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = Lexicon(weights, phrases)
        for texts in stream:
            out = []
            for at in range(0, len(texts), 512):
                out += [float(bias[0] + bias[1] * a + bias[2] * b) for a, b in map(lexicon.features, texts.slice(at, 512).to_pylist())]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(out), -40, 40))), pa.float64())

    carried = df.select(*[F.col(f"`{c}`") for c in (carry if carry is not None else df.columns)], F.col(f"`{text_col}`").alias("_text_to_score"))
    body = F.col("record").getField("_text_to_score")
    out = packed(carried).withColumn("score", scored(F.coalesce(body, F.lit("")))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return unpacked(out, ["score", "predicted"]).drop("_text_to_score")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=~held_out(F.col("doc_id")), carry=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op11_toxicity": op11_toxicity}
ORACLE_SQL: dict[str, str] = {}
