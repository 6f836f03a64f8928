"""Quality rules: base rules on whole texts, then robust multivariate outliers per language and source.

The location and scatter of each group's statistic vectors are minimum-covariance-determinant estimates: from a
robust start (medians and absolute deviations), concentration steps refit mean and covariance to the `support`
share of rows of least Mahalanobis distance. Rows beyond `cut` under the final estimate are rejected. A pass
aggregates per group with map-side partial sums and mergeable quantile sketches, so a hot group costs no more
than its rows. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written
from .textstats import statistics

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals"]
#: Medians of the chi-squared distribution with 1 to 6 degrees of freedom.
CHI2_MEDIAN = {1: 0.4549, 2: 1.3863, 3: 2.3660, 4: 3.3567, 5: 4.3515, 6: 5.3481}
#: A share is shrunk towards its typical value as if this many typical words were added.
PRIOR_WORDS = 20
#: Up to this many groups, their estimates are broadcast (under 20 MB); above it they are joined by shuffling.
BROADCAST_GROUPS = 50_000


def transformed() -> dict[str, Column]:
    """Statistic vectors: shares of words or lines, shrunk for short texts, on scales that make them symmetric."""
    base = F.col("n_words") + F.lit(PRIOR_WORDS)
    return {
        "x0": F.log((F.col("word_chars") + F.lit(5 * PRIOR_WORDS)) / base),
        "x1": F.sqrt(F.col("n_symbols") / base),
        "x2": F.sqrt(F.col("n_dup_lines") / base),
        "x3": F.sqrt(F.col("n_repeat_words") / base),
        "x4": F.sqrt(F.col("n_capitals") / (F.col("word_chars") + F.lit(5 * PRIOR_WORDS))),
    }


#: Scales below these count as these: a group whose rows all agree must not reject the least departure. For shares
#: under a base rule or like one, the base limit of 20 % (0.45 on the root scale) is three units.
FLOORS = [0.05, 0.15, 0.15, 0.15, 0.1]
P = len(FLOORS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_GROUPS else df


def _distance() -> Column:
    """Squared Mahalanobis distance of z0.. to the means m0.. under the inverse Cholesky factor l00.."""
    total = F.lit(0.0)
    for i in range(P):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"l{i}{j}") * (F.col(f"z{j}") - F.col(f"m{j}"))
        total = total + part * part
    return total


def _inverse_factor(moments: DataFrame) -> DataFrame:
    """From mean m_i and covariance c_ij to the rows of the inverse of its Cholesky factor, one column each.

    The ridge keeps the factor regular where a statistic is constant; z is in units of its own robust scale.
    """
    out = moments
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"g{i}{k}") * F.col(f"g{j}{k}")
            out = out.withColumn(f"g{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"g{j}{j}"))
    for j in range(P):
        out = out.withColumn(f"l{j}{j}", 1 / F.col(f"g{j}{j}"))
        for i in range(j + 1, P):
            rest = F.lit(0.0)
            for k in range(j, i):
                rest = rest + F.col(f"g{i}{k}") * F.col(f"l{k}{j}")
            out = out.withColumn(f"l{i}{j}", -rest / F.col(f"g{i}{i}"))
    return out.select("pool", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS])


def _moments(rows: DataFrame, ridge: float = 0.5) -> DataFrame:
    z = [F.col(f"z{i}") for i in range(P)]
    sums = rows.groupBy("pool").agg(
        *[F.avg(z[i]).alias(f"m{i}") for i in range(P)], *[F.avg(z[i] * z[j]).alias(f"s{i}{j}") for i, j in PAIRS]
    )
    return sums.withColumns({f"c{i}{j}": F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + F.lit(ridge if i == j else 0.0) for i, j in PAIRS})


def _pools(points: DataFrame, min_rows: int) -> DataFrame:
    """cell -> pool: the cell itself, else the rest of its language, else the rest of all, whatever the size of that."""
    cells = points.groupBy("cell", "language").agg(F.count(F.lit(1)).alias("rows"))
    small = F.col("rows") < min_rows
    of_language = F.sum(F.when(small, F.col("rows"))).over(Window.partitionBy("language"))
    staged = cells.withColumn("rest", of_language)
    pool = F.when(~small, F.concat(F.lit("c"), F.col("cell"))).when(F.col("rest") >= min_rows, F.concat(F.lit("l"), F.col("language"))).otherwise("r")
    return staged.select("cell", pool.alias("pool"))


def robust_outliers(points: DataFrame, min_rows: int = 60, support: float = 0.75, steps: int = 4) -> DataFrame:
    """Estimates per cell (columns cell, centre c*, scale s*, m*, l*, spread) from points (cell, language, x0..).

    Every row takes part and every cell has an estimate: cells with fewer than `min_rows` rows are pooled by language,
    then overall. `spread` scales squared distances down where their median exceeds that of chi-squared.
    """
    cells = written(_pools(points, min_rows), "mcd-pools")
    n_cells = cells.count()
    pooled = points.join(_sized(cells, n_cells), "cell")
    centres = pooled.groupBy("pool").agg(*[F.percentile_approx(f"x{i}", 0.5, 10_000).alias(f"c{i}") for i in range(P)])
    centres = written(centres, "mcd-centres")
    near = pooled.join(_sized(centres, n_cells), "pool")
    scales = near.groupBy("pool").agg(
        *[F.first(f"c{i}").alias(f"c{i}") for i in range(P)],
        *[F.greatest(F.lit(FLOORS[i]), 1.4826 * F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"c{i}")), 0.5, 10_000)).alias(f"s{i}") for i in range(P)],
    )
    scales = written(scales, "mcd-scales")
    z = pooled.join(_sized(scales, n_cells), "pool").select("pool", *[((F.col(f"x{i}") - F.col(f"c{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in range(P)])
    z = written(z, "mcd-points")
    start = scales.select("pool", *[F.lit(0.0).alias(f"m{i}") for i in range(P)], *[F.lit(float(i == j)).alias(f"l{i}{j}") for i, j in PAIRS])
    fit = start
    for _ in range(steps):
        measured = z.join(_sized(fit, n_cells), "pool").withColumn("d", _distance()).select("pool", "d", *[f"z{i}" for i in range(P)])
        limits = measured.groupBy("pool").agg(F.percentile_approx("d", support, 10_000).alias("limit"))
        held = measured.join(_sized(limits, n_cells), "pool").filter("d <= limit")
        fit = written(_inverse_factor(_moments(held)), "mcd-fit")
    measured = z.join(_sized(fit, n_cells), "pool").withColumn("d", _distance())
    spread = measured.groupBy("pool").agg(F.greatest(F.percentile_approx("d", 0.5, 10_000) / CHI2_MEDIAN[P], F.lit(1.0)).alias("spread"))
    return written(cells.join(scales, "pool").join(fit, "pool").join(spread, "pool").drop("pool"), "mcd-estimates")


def quality_verdicts(
    df: DataFrame, carry: list[str] | None = None, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cut: float = 25.7, min_rows: int = 60
) -> DataFrame:
    """The columns `carry` of df (all by default) with the six statistics, base_failed, distance and kept.

    A null or empty text has no words and fails the base rules; null languages and sources form groups of their
    own. Ties and repeated rows count each. Groups under `min_rows` rows are judged by the estimate of what is left of
    their language or of all; only rows that the base rules fail have a null distance. Input columns named like an added one are replaced. `cut`
    bounds the squared distance; the default is the chi-squared quantile of 0.9999 for five statistics.
    """
    added = [*STATISTICS, "base_failed", "distance", "kept"]
    carried = [c for c in (carry if carry is not None else df.columns) if c.lower() not in added]
    cell = F.to_json(F.struct(F.col(lang_col).cast("string").alias("l"), F.col(source_col).cast("string").alias("s")))
    language = F.to_json(F.struct(F.col(lang_col).cast("string").alias("l")))
    counted = df.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in carried], cell.alias("cell"), language.alias("language"), statistics(F.col(text_col)).alias("s"))
    flat = counted.select(*[f"`in_{c}`" for c in carried], "cell", "language", "s.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = written(flat.withColumn("base_failed", failed).withColumns(transformed()), "quality-stats")
    estimates = robust_outliers(stats.filter("NOT base_failed").select("cell", "language", *[f"x{i}" for i in range(P)]), min_rows)
    n_cells = estimates.count()
    scaled = stats.join(_sized(estimates, n_cells), "cell", "left").withColumns({f"z{i}": (F.col(f"x{i}") - F.col(f"c{i}")) / F.col(f"s{i}") for i in range(P)})
    judged = scaled.withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.col("spread")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
    return judged.withColumn("kept", kept).select(*[F.col(f"`in_{c}`").alias(c) for c in carried], *added)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLE_SQL: dict[str, str] = {}
