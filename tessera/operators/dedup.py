"""Duplicate detection among catalogue records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import similarity


def exact_groups(df: DataFrame, key: str, digest: Column) -> DataFrame:
    """key, first_id (least key of equal content) and copies, by one aggregation and a join back on the digest."""
    hashed = df.select(key, digest.alias("_digest"))
    groups = hashed.groupBy("_digest").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(groups, "_digest").select(key, "first_id", "copies")


def _may_reach(least: float) -> Column:
    """Whether x and y are near enough in length: a ratio of 2M / T cannot reach `least` if they differ too much."""
    short, total = F.least(F.length("x"), F.length("y")), F.length("x") + F.length("y")
    return 2 * short >= F.lit(least) * total


def _occurrences(name: Column) -> Column:
    """A name's characters as a set, the k-th of its kind as character and k: intersections are those of multisets."""
    ordered = F.array_sort(F.filter(F.split(name, ""), lambda c: c != ""))
    return F.transform(F.array(ordered), lambda cs: F.transform(cs, lambda c, i: F.concat(c, (i + 2 - F.array_position(cs, c)).cast("string"))))[0]


def like_candidates(names: DataFrame, least: float) -> DataFrame:
    """(block, x, y) of unlike names of one block whose similarity may reach `least`, x before y, from distinct (block, name).

    The matching characters of two names are at most the intersection of their multisets, so a similarity of `least`
    needs that much of it. If their sizes allow it at all, each holds at least s / (2 - s) of the other's characters,
    and two sets with such an overlap share one of the rarest characters of either: of each name only so many are
    listed, names meet in a block and a listed character, and the bound is checked on whole sets before any name is
    compared. Names without characters are like none.
    """
    share = least / (2 - least)
    sets = names.filter("name <> ''").select("block", "name", _occurrences(F.col("name")).alias("chars"))
    listed = sets.select("block", "name", F.size("chars").alias("n"), F.explode("chars").alias("char"))
    rarity = listed.groupBy("char").agg(F.count(F.lit(1)).alias("names"))
    placed = listed.join(rarity, "char").withColumn("at", F.row_number().over(Window.partitionBy("block", "name").orderBy("names", "char")))
    # Half a character less than asked for keeps rounding from losing a name.
    prefix = placed.filter(F.col("at") <= F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1).select("block", "char", "name", "n")
    met = prefix.alias("a").join(prefix.alias("b"), F.expr("a.block = b.block AND a.char = b.char AND a.name < b.name")).select("a.block", F.col("a.name").alias("x"), F.col("b.name").alias("y"), F.col("a.n").alias("nx"), F.col("b.n").alias("ny"))
    near = met.filter(2 * F.least("nx", "ny") >= F.lit(least - 1e-9) * (F.col("nx") + F.col("ny"))).distinct()
    common = F.size(F.array_intersect(_occurrences(F.col("x")), _occurrences(F.col("y"))))
    return near.filter(2 * common >= F.lit(least - 1e-9) * (F.col("nx") + F.col("ny"))).select("block", "x", "y")


def suggestions(rows: DataFrame, least: float = 0.8, shared_url: float = 0.95, known: DataFrame | None = None) -> DataFrame:
    """Pairs (id, other, score) of rows (id, name, block, url) that may be the same record.

    Candidates share a block (as provider and country) and enough characters, or a canonical URL, by equi-joins. The
    score is the name's similarity, at least `shared_url` for a common URL; equal names need no comparison. Pairs in
    `known` (id, other) are skipped. The newer record is the first argument of the similarity.
    """
    a, b = rows.alias("a"), rows.alias("b")
    pick = [F.col("a.id").alias("id"), F.col("b.id").alias("other"), F.col("a.name").alias("x"), F.col("b.name").alias("y")]
    names = rows.select("block", "name").distinct()
    alike = like_candidates(names, least)
    both = alike.select("block", "x", "y").unionByName(alike.select("block", F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(names.filter("name IS NOT NULL").select("block", F.col("name").alias("x"), F.col("name").alias("y")))
    newer = both.join(rows.select("block", F.col("name").alias("x"), "id"), ["block", "x"])
    blocked = newer.join(rows.select("block", F.col("name").alias("y"), F.col("id").alias("other")), ["block", "y"]).filter("id > other").select("id", "other", "x", "y", F.lit(False).alias("same_url"))
    linked = a.join(b, F.expr("a.url = b.url AND a.id > b.id")).select(*pick, F.lit(True).alias("same_url"))
    pairs = blocked.unionByName(linked).groupBy("id", "other", "x", "y").agg(F.bool_or("same_url").alias("same_url"))
    if known is not None:
        pairs = pairs.join(known, ["id", "other"], "left_anti")
    possible = pairs.filter(F.col("same_url") | _may_reach(least))
    name_score = F.when(F.col("x") == F.col("y"), F.lit(1.0)).otherwise(similarity(F.col("x"), F.col("y")))
    score = F.round(F.greatest(name_score, F.when(F.col("same_url"), F.lit(shared_url)).otherwise(F.lit(0.0))), 4)
    return possible.select("id", "other", score.alias("score")).filter(F.col("score") >= least)


def class_suggestions(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """Rows (id, other, score, copies) from rows (id, name, block): equal names in any blocks, like names in one block.

    Equal names form a class. Each member but the first gets one row, with the class's least id as `other`, the score
    1 and the number of its members as `copies`, so the rows grow with the members and not with their square. Within
    a block each name is represented by its least id there, and two names that are alike give one row of their
    representatives, without copies, for each order in which their records occur: the name of `id` is that of the
    newer record (the larger id) and the first argument of the similarity. Null names match nothing.
    """
    named = rows.filter("name IS NOT NULL")
    classes = named.groupBy("name").agg(F.min("id").alias("other"), F.count(F.lit(1)).alias("copies"))
    members = named.join(classes, "name").filter("id <> other").select("id", "other", F.lit(1.0).alias("score"), "copies")
    held = named.groupBy("block", "name").agg(F.min("id").alias("id"), F.max("id").alias("newest"))
    near = like_candidates(held.select("block", "name"), least)
    both = near.unionByName(near.select("block", F.col("y").alias("x"), F.col("x").alias("y")))
    newer = both.join(held.select("block", F.col("name").alias("x"), "id", "newest"), ["block", "x"])
    pairs = newer.join(held.select("block", F.col("name").alias("y"), F.col("id").alias("other")), ["block", "y"]).filter("newest > other")
    alike = pairs.select("id", "other", similarity(F.col("x"), F.col("y")).alias("score")).filter(F.col("score") >= least)
    return members.unionByName(alike.select("id", "other", F.round("score", 4).alias("score"), F.lit(None).cast("long").alias("copies")))
