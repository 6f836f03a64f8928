"""Nested JSON of parents with their children, as a stream of ordered fragments: no parent is ever one row in memory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nested_json(parents: DataFrame, key: str, fields: list[str], sections: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """key, section, place, fragment: joined in the order of section and place, a key's fragments are its JSON document.

    The document has the parent's `fields` and a list for each section, in the order given: sections maps a name to
    (children with the key, their fields, the columns of a total order). A parent without children has empty lists;
    children without a parent, and null keys, are left out. Children are ordered by a sort within their key, which
    spills, and numbered as they stream by; the largest row is one child.
    """
    of = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    own = parents.filter(F.col(key).isNotNull())
    names = list(sections)
    head = F.concat(F.regexp_replace(of(fields), r"\}$", ""), F.lit(f',"{names[0]}":['))
    parts = [own.select(key, F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"), head.alias("fragment"))]
    for n, (name, (children, columns, order)) in enumerate(sections.items()):
        number = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
        listed = children.join(own.select(key), key, "left_semi").withColumn("_at", number)
        parts.append(listed.select(key, F.lit(2 * n + 1).alias("section"), F.col("_at").alias("place"), F.concat(F.when(F.col("_at") > 1, ",").otherwise(""), of(columns)).alias("fragment")))
        close = f'],"{names[n + 1]}":[' if n + 1 < len(names) else "]}"
        parts.append(own.select(key, F.lit(2 * n + 2).alias("section"), F.lit(0).cast("long").alias("place"), F.lit(close).alias("fragment")))
    return reduce(DataFrame.unionByName, parts)


def written_nested(fragments: DataFrame, key: str, path: str) -> None:
    """Writes one JSON document a line: a key lies in one file, its fragments stream into it in order."""
    ordered = fragments.repartition(key).sortWithinPartitions(key, "section", "place")
    closed = F.when(F.col("fragment") == "]}", F.lit("]}\n")).otherwise(F.col("fragment"))
    # Text files end each row with a separator; a blank between fragments is white space between JSON tokens.
    ordered.select(closed.alias("fragment")).write.option("lineSep", " ").text(path)
