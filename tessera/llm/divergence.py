"""Source divergence audit: which sources of a language use which terms unlike the others.

Term counts become dense matrices of groups by terms, one tile a block of terms; a tile compares all its pairs of
groups at once, partial pair matrices are added up and the best terms of each tile are merged per group.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread_join, table, written

#: Bytes that end a term, as spaces, and capitals as small letters; every other byte stands for itself.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SCALE = 1_000_000_000
#: Distinct (group, term) counts that a task holds before it passes them on.
HELD_COUNTS = 400_000
#: Terms and groups of a tile, on average; a tile's matrices have two blocks of groups at most.
TILE_TERMS, TILE_GROUPS = 8192, 256


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total), exactly, for 64-bit integers with count + 1 <= total."""
    rest = counts + 1
    if rest.size and int(rest.max()) < 9_000_000_000:
        return 1 + SCALE * rest // totals
    out = np.zeros_like(rest)
    for _ in range(3):  # three digits of the quotient at a time: no product exceeds 1000 * total
        out, rest = out * 1000 + rest * 1000 // totals, rest * 1000 % totals
    return 1 + out


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares stay below 2^31, so squares fit."""
    d = p - q
    return d * d // q


def term_counts(df: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs) added up within each task; a group and term may come from several tasks."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                size, terms = len(n), pa.array(list(n), pa.binary()).cast(pa.string())
                columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                whole = pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
                yield from (whole.slice(at, 50_000) for at in range(0, size, 50_000))
            held.clear()

        seen = 0
        for batch in stream:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                terms = text.encode().translate(FOLD).split()
                n, docs = held[lang, source]
                before = len(n)
                n.update(terms)
                docs.update(set(terms))
                seen += len(n) - before
                if seen > HELD_COUNTS:
                    yield from out()
                    seen = 0
        yield from out()

    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _tile(terms_kept: int):
    """What one tile says: a row for each ordered pair of its groups and one for each of a group's best terms."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string())] + [(c, pa.int64()) for c in ("value", "seen", "absent", "terms")])

    def compare(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        lang, _, low, high = (k.as_py() for k in key)
        names, block = groups["source"].to_pylist(), groups["block"].to_numpy()
        terms_of_lang, lang_total = (groups[c][0].as_py() for c in ("terms", "lang_n"))
        totals = groups["n"].to_numpy()[:, None] + terms_of_lang
        row = {s: i for i, s in enumerate(names)}
        coded = counts["term"].combine_chunks().dictionary_encode() if counts.num_rows else None
        words = coded.dictionary.to_pylist() if coded is not None else []
        order = sorted(range(len(words)), key=lambda i: words[i].encode())
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        n, of_lang = np.zeros((len(names), len(words)), np.int64), np.zeros(len(words), np.int64)
        if words:
            at = place[coded.indices.to_numpy()]
            n[[row[s] for s in counts["source"].to_pylist()], at] = counts["n"].to_numpy()
            of_lang[at] = counts["lang_n"].to_numpy()
        found: list[tuple] = []
        if terms_of_lang:
            p, absent = shares(n, totals), shares(np.zeros_like(totals), totals)
        for a, source in enumerate(names):
            # Pairs within a block, or across the tile's two blocks.
            others = np.flatnonzero((block != block[a]) if low != high else np.arange(len(names)) != a)
            value = none = np.zeros(len(others), np.int64)
            if terms_of_lang and len(others):
                value, none = divergences(p[a], p[others]).sum(axis=1), divergences(absent[a], absent[others])[:, 0]
            found += [(lang, source, "pair", names[b], int(v), len(words), int(z), terms_of_lang) for b, v, z in zip(others, value, none, strict=True)]
        if low == high and words:
            q = shares(of_lang, np.int64(lang_total + terms_of_lang))
            ranked = [words[i] for i in order]
            for a, source in enumerate(names):
                own = np.flatnonzero((n[a] > 0) & (p[a] > q))
                value = divergences(p[a, own], q[own])
                best = np.lexsort((own, -value))[:terms_kept]
                found += [(lang, source, "term", ranked[own[i]], int(value[i]), 0, 0, 0) for i in best]
        columns = zip(*found, strict=True) if found else [[] for _ in schema]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return compare, ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in schema)


def audit_sources(df: DataFrame, min_docs: int = 3, best_terms: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language (`pair`), and terms above it (`term`).

    Null texts, languages and sources count as empty strings. A language keeps the terms that at least `min_docs` of
    its rows hold; repeated rows count each. A group without terms, or a language that keeps none, still has its
    pairs, with value 0 where nothing is kept. Ties in value go by the item's UTF-8 bytes. Columns of df other than
    the three named are not used, so none can clash. An empty table gives no rows.
    """
    # One shuffle by language and term serves the counts a group and those a language.
    dealt = term_counts(df, lang_col, source_col, text_col).repartition("lang", "term")
    counts = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = counts.select(
        "lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"),
        (F.row_number().over(term.orderBy("source")) == 1).cast("int").alias("first"),
    )
    kept = written(kept.filter(F.col("docs") >= min_docs).drop("docs"), "divergence-terms")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    groups = df.select(blank(lang_col).alias("lang"), blank(source_col).alias("source")).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("terms"), F.count(F.lit(1)).alias("rows"))
    groups = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["n", "terms", "rows"])
    groups = written(groups, "divergence-groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("terms").alias("terms"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("groups"))
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("int")
    langs = written(langs.withColumns({"term_blocks": blocks("terms", TILE_TERMS), "blocks": blocks("groups", TILE_GROUPS)}), "divergence-langs")
    rows, n_groups = langs.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("groups"), F.lit(0))).first()

    def tiled(placed: DataFrame, columns: list) -> DataFrame:
        """A row for each tile whose groups include the row's own: its block with every block of the language."""
        placed = placed.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
        placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return placed.select("lang", "tile", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), *columns)

    sized = langs.select("lang", "rows", "term_blocks", "blocks")
    cells = spread_join(kept, sized, "lang", "rows", rows).withColumn("tile", F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int"))
    members = spread_join(groups.drop("terms", "rows"), langs.drop("rows"), "lang", "groups", n_groups)
    members = members.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)))
    keys = ["lang", "tile", "low", "high"]
    compare, schema = _tile(best_terms)
    left = tiled(cells, ["source", "term", "n", "lang_n"]).groupBy(*keys)
    right = tiled(members, ["source", "block", "n", "terms", "lang_n"]).groupBy(*keys)
    tiles = written(left.cogroup(right).applyInArrow(compare, schema), "divergence-tiles")
    # Terms that no group of a tile's pair holds lie in no tile of theirs; each adds the same to the pair.
    pairs = tiles.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(
        (F.sum("value") + (F.max("terms") - F.sum("seen")) * F.max("absent")).alias("value")
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = tiles.filter("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= best_terms)
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(best)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLE_SQL = {
    "op13_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM found GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n)::BIGINT AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept k ON f.lang = k.lang AND f.term = k.term GROUP BY f.lang, f.source, f.term),
totals AS (SELECT lang, source, sum(n)::BIGINT AS total FROM counts GROUP BY lang, source),
groups AS (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(s.v, 0) AS v, coalesce(s.lang_total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source LEFT JOIN sizes s ON g.lang = s.lang),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p,
         1 + 1000000000 * (k.lang_n + 1) // (g.lang_total + g.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
}
