"""Whole-text statistics as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words in a repeated window.
SPAN = 5


def without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def repeated_words(tokens: Column, span: int = SPAN) -> Column:
    """Words that lie in a window of `span` words found at least twice in the list, the first time included.

    Windows are hashed. Only where two hashes are equal are they sorted with their places; a window is then
    repeated if its hash equals a neighbour's.
    """

    def covered(places: Column) -> Column:
        zero = F.struct(F.lit(-span).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(span), p - a.last)).alias("n"))
        return F.aggregate(places, zero, step, lambda a: a.n.cast("long"))

    def repeated(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(x.h == F.get(ordered, i - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(ordered, i + 1).h, F.lit(False))
        return covered(F.sort_array(F.transform(F.filter(ordered, same), lambda x: x.at)))

    def counted(windows: Column) -> Column:
        placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        unique = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(unique, F.lit(0).cast("long")).otherwise(let(F.sort_array(placed), repeated))

    def windowed(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - span)
        return let(F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(span)])), counted)

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) < span, F.lit(0).cast("long")).otherwise(let(hashes, windowed))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def statistics(text: Column) -> Column:
    """A struct of counts over the whole text; a null text has none of anything."""
    body = F.coalesce(text, F.lit(""))

    def of(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.aggregate(tokens, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
            (F.length(body) - F.length(without(body, SYMBOLS))).cast("long").alias("n_symbols"),
            duplicate_lines(body).alias("n_dup_lines"),
            repeated_words(tokens).alias("n_repeat_words"),
            (F.length(body) - F.length(without(body, CAPITALS))).cast("long").alias("n_capitals"),
        )

    return let(words(text), of)
