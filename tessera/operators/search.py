"""Substring search by an inverted index of character trigrams: the rarest list of a pattern first, then verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.catalogue import shared_folder


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is a value, so the optimizer cannot copy it."""
    return F.transform(F.array(value), body)[0]


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    three = lambda c: F.transform(F.slice(c, 1, F.greatest(F.size(c) - 2, F.lit(0))), lambda x, i: F.concat(x, F.get(c, i + 1), F.get(c, i + 2)))
    return F.array_distinct(_let(F.split(text, ""), three))


def characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def pattern_grams(pattern: Column) -> Column:
    """Grams that every text must hold which is LIKE %pattern%: trigrams of its literal runs, else their characters."""
    runs = F.split(pattern, "[%_]+")
    long = F.array_distinct(F.flatten(F.transform(runs, trigrams)))
    return F.when(F.size(long) > 0, long).otherwise(F.array_distinct(F.flatten(F.transform(runs, characters))))


def like_matches(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, key) of each text that is LIKE %pattern%; case matters, fold both before where it should not.

    patterns has pattern, texts has key (unique) and text. `%` and `_` in a pattern are wildcards. Null patterns and
    texts match nothing, and patterns without a literal character are left out: they hold of every text, which the
    caller can say without a row for each. Only grams that some pattern asks for are listed, and of each pattern only
    the rarest is joined; a gram that no text holds ends its pattern at once. No list is ever gathered in a row.
    """
    asked = patterns.filter("pattern IS NOT NULL").select("pattern").distinct()
    grams = asked.select("pattern", F.explode(pattern_grams(F.col("pattern"))).alias("gram"))
    held = texts.select("key", F.explode(F.array_union(trigrams(F.col("text")), characters(F.col("text")))).alias("gram"))
    listed = held.join(grams.select("gram").distinct(), "gram", "left_semi")
    counted = grams.join(listed.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left")
    first = Window.partitionBy("pattern").orderBy(F.coalesce("n", F.lit(0)), "gram")
    rarest = counted.withColumn("_at", F.row_number().over(first)).filter("_at = 1 AND n IS NOT NULL").select("pattern", "gram")
    candidates = listed.join(rarest, "gram").select("pattern", "key")
    whole = candidates.join(texts.select("key", "text"), "key")
    return whole.filter(F.like("text", F.concat(F.lit("%"), F.col("pattern"), F.lit("%")))).select("pattern", "key")


def first_matches(patterns: DataFrame, records: DataFrame, most: int) -> DataFrame:
    """(pattern, held): the first `most` records by id, as structs (id, evidence), whose text is LIKE %pattern%.

    records has id, text and evidence. Equal texts are searched once, by their first id, and lists are cut to `most`
    by rank before they are gathered. Rows that repeat an id count as one; an id with several texts is found by each.
    """
    by_id = Window.partitionBy("text").orderBy("id")
    placed = records.filter("text IS NOT NULL").select("id", "text", "evidence", F.dense_rank().over(by_id).alias("_at"), F.row_number().over(by_id).alias("_row"), F.concat_ws("-", F.first("id").over(by_id), F.hex(F.xxhash64("text"))).alias("key")).filter(F.col("_at") <= most)
    found = like_matches(patterns, placed.filter("_row = 1").select("key", "text"))
    ranked = found.join(placed.select("key", "id", "evidence"), "key").withColumn("_at", F.dense_rank().over(Window.partitionBy("pattern").orderBy("id"))).filter(F.col("_at") <= most)
    return ranked.groupBy("pattern").agg(F.sort_array(F.collect_set(F.struct("id", "evidence"))).alias("held"))


#: A token of a question, which lies within one run of the same characters wherever a text holds it.
TOKEN_RUN = "([a-z0-9]{3,})"
#: Words of up to this many characters are looked up by all their parts, longer ones through trigrams.
LONG_WORD = 24


def first_holding(tokens: DataFrame, records: DataFrame, most: int) -> DataFrame:
    """first_matches() for patterns that are runs of a-z and 0-9, three or more: looked up in the words of the texts.

    A word keeps its first `most` records only, which are all that a token in it can need; tokens are then searched in
    the distinct words, which grow far slower than the texts. Needs a checkpoint folder, else makes one.
    """
    context = records.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(records.sparkSession))
    held = records.filter("text IS NOT NULL").select("id", "evidence", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN_RUN), 1))).alias("word"))
    placed = held.withColumn("_at", F.dense_rank().over(Window.partitionBy("word").orderBy("id"))).filter(F.col("_at") <= most).drop("_at")
    listed = placed.groupBy("word").agg(F.collect_set(F.struct("id", "evidence")).alias("held")).checkpoint()
    asked = tokens.filter("pattern IS NOT NULL").select("pattern").distinct()
    part = F.expr("explode(flatten(transform(sequence(1, length(word) - 2), i -> transform(sequence(3, length(word) - i + 1), n -> substr(word, i, n)))))")
    short = listed.filter(F.length("word") <= LONG_WORD).select(F.col("word").alias("key"), part.alias("pattern")).join(asked, "pattern", "left_semi").select("pattern", "key").distinct()
    long = like_matches(asked, listed.filter(F.length("word") > LONG_WORD).select(F.col("word").alias("key"), F.col("word").alias("text")))
    found = short.unionByName(long)
    ranked = found.join(listed.withColumnRenamed("word", "key"), "key").select("pattern", F.explode("held").alias("h")).distinct()
    first = ranked.withColumn("_at", F.dense_rank().over(Window.partitionBy("pattern").orderBy("h.id"))).filter(F.col("_at") <= most)
    return first.groupBy("pattern").agg(F.sort_array(F.collect_set("h")).alias("held"))
