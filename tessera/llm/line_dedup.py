"""Line dedup by pairwise alignment.

A run is the shortest stretch of consecutive lines, from a given line on or up to a given line, that has `min_words`
words: the least that may be deleted. Runs are hashed, and the first document that holds a run is its owner. A rare run
(up to `rare` times in all documents) pairs each later document that holds it with its owner; the pair is aligned by
patience diff, and the aligned common blocks of `min_words` words or more are deleted from the later document, with the
runs of the pair that no rising alignment holds. A common run names no pairs: it is deleted from every document but its
owner, which is what its alignments would do, so no passage makes pairs beyond `rare`. An owner keeps its run: a block
that an earlier document shares has that document as its owner.

Every common block of a pair consists of their shared runs, so of the owner only these runs go to the alignment, in the
later document's own lines, and no document's outline is copied to another.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, spread_join, table, unpacked, written

Line = int
#: Stands for the owner's lines outside the shared runs; no line hash is negative.
GAP = -1


def anchors(a: list[Line], b: list[Line]) -> list[tuple[int, int]]:
    """Rising pairs of places of equal lines: unique in both if there are such, else first occurrences."""
    once_a, once_b = Counter(a), Counter(b)
    first_a: dict[Line, int] = {}
    first_b: dict[Line, int] = {}
    for i, x in enumerate(a):
        first_a.setdefault(x, i)
    for j, x in enumerate(b):
        first_b.setdefault(x, j)
    shared = [(i, first_b[x], once_a[x] == 1 and once_b[x] == 1) for x, i in first_a.items() if x in first_b]
    matched = [(i, j) for i, j, unique in shared if unique] or [(i, j) for i, j, _ in shared]
    matched.sort()
    # The longest rising subsequence of the places in b.
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(matched):
        k = bisect_left(tails, j)
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(j)
            at.append(n)
        else:
            tails[k], at[k] = j, n
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(matched[n])
        n = back[n]
    return out[::-1]


def patience(a: list[Line], b: list[Line]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal lines of a and b, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        found = anchors(a[a0:a1], b[b0:b1])
        last_i, last_j = a0, b0
        for i, j in found:
            out.append((a0 + i, b0 + j))
            todo.append((last_i, a0 + i, last_j, b0 + j))
            last_i, last_j = a0 + i + 1, b0 + j + 1
        if found:
            todo.append((last_i, a1, last_j, b1))
    return sorted(out)


def runs_of(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """Half-open places of the shortest stretches with `min_words` words, from each line on and up to each line.

    Every line of a stretch with `min_words` words lies in one of these that lies in the stretch.
    """
    ends = [0, *accumulate(words)]
    out = set()
    for i in range(len(words)):
        end = bisect_left(ends, ends[i] + min_words)
        if end < len(ends):
            out.add((i, end))
        start = bisect_right(ends, ends[i + 1] - min_words) - 1
        if start >= 0:
            out.add((start, i + 1))
    return sorted(out)


def aligned_blocks(later: list[Line], owner: list[Line], words: list[int], min_words: int) -> set[int]:
    """Places in `later` of lines in blocks with `min_words` words of one alignment."""
    found: set[int] = set()
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(later, owner), (-9, -9)]:
        if (i - 1, j - 1) != before:
            if sum(words[k] for k in block) >= min_words:
                found |= set(block)
            block = []
        block.append(i)
        before = (i, j)
    return found


def common_blocks(later: list[Line], owner: list[Line], words: list[int], min_words: int) -> set[int]:
    """Places in `later` of the lines in all stretches of `min_words` words that `owner` holds too.

    An alignment is rising, so a short line in crossing order may hide a block from it; moved, doubled and overlapping
    blocks do not fit into one either. Those left over are found by their runs.
    """
    removed = aligned_blocks(later, owner, words, min_words)
    left = [(start, end) for start, end in runs_of(words, min_words) if not removed.issuperset(range(start, end))]
    if left:
        # Equal lines have equal words; a run over a line that `later` lacks equals none of its runs.
        known = dict(zip(later, words, strict=True))
        held = {tuple(owner[start:end]) for start, end in runs_of([known.get(x, 1) for x in owner], min_words)}
        for start, end in left:
            if tuple(later[start:end]) in held:
                removed.update(range(start, end))
    return removed


def owner_of_runs(later: list[Line], shared: list[tuple[int, int, int]]) -> list[Line]:
    """The owner's lines in its runs (start, end, owner's start) shared with `later`, with a gap wherever it has others."""
    held: dict[int, Line] = {}
    for start, end, at in shared:
        for k in range(end - start):
            held[at + k] = later[start + k]
    out: list[Line] = []
    before = None
    for at in sorted(held):
        if before is not None and at != before + 1:
            out.append(GAP)
        out.append(held[at])
        before = at
    return out


def _outline(texts: DataFrame, min_words: int) -> DataFrame:
    """id, h and of the lines with words: places, hashes, words (binary), and the runs (hash, first line, end)."""
    run = pa.struct([("run", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
    fields = [("id", pa.int64()), ("h", pa.int64()), ("places", pa.binary()), ("lines", pa.binary()), ("words", pa.binary()), ("runs", pa.list_(run))]
    schema = pa.schema(fields)

    def outline(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            columns: list[list] = [[], [], [], []]
            for text in batch["text"].to_pylist():
                places, lines, words = [], [], []
                for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                    if n := len(line.split()):
                        places.append(i)
                        lines.append(xxhash.xxh64_intdigest(line.strip()) >> 1)
                        words.append(n)
                hashed = np.array(lines, dtype=np.int64)
                runs = [{"run": xxhash.xxh64_intdigest(hashed[start:end].tobytes()) - 2**63, "start": start, "end": end} for start, end in runs_of(words, min_words)]
                for column, value in zip(columns, (np.array(places, dtype=np.int32).tobytes(), hashed.tobytes(), np.array(words, dtype=np.int32).tobytes(), runs), strict=True):
                    column.append(value)
            kept = [batch["id"], batch["h"], *[pa.array(c, f[1]) for c, f in zip(columns, fields[2:], strict=True)]]
            yield pa.RecordBatch.from_arrays(kept, schema=schema)

    return texts.mapInArrow(outline, "id long, h long, places binary, lines binary, words binary, runs array<struct<run:long,start:int,end:int>>")


def _aligned(outlines: DataFrame, min_words: int) -> DataFrame:
    """(id, h, removed places and their words) from outlines with `shared`: (owner, start, end, owner's start), owner -1 for a common run."""
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("removed", pa.list_(pa.int32())), ("removed_words", pa.list_(pa.int32()))])

    def align(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            removed, counted = [], []
            for places, lines, words, shared in zip(*[batch[c].to_pylist() for c in ("places", "lines", "words", "shared")], strict=True):
                places_, later, words_ = np.frombuffer(places, np.int32), np.frombuffer(lines, np.int64).tolist(), np.frombuffer(words, np.int32).tolist()
                gone: set[int] = set()
                pairs: dict[int, list[tuple[int, int, int]]] = {}
                for x in shared:
                    if x["owner"] is None:
                        gone.update(range(x["start"], x["end"]))
                    else:
                        pairs.setdefault((x["owner"]["id"], x["owner"]["h"]), []).append((x["start"], x["end"], x["at"]))
                for runs in pairs.values():
                    gone |= common_blocks(later, owner_of_runs(later, runs), words_, min_words)
                kept = sorted(gone)
                removed.append(places_[kept].tolist())
                counted.append([words_[i] for i in kept])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["h"], pa.array(removed, schema.field(2).type), pa.array(counted, schema.field(3).type)], schema=schema)

    return outlines.select("id", "h", "places", "lines", "words", "shared").mapInArrow(align, "id long, h long, removed array<int>, removed_words array<int>")


def dedup_lines(df: DataFrame, min_words: int = 20, rare: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of df with the text rid of its repeated blocks, and n_lines, removed_lines, removed_words.

    Earlier means a smaller id, null ids last, then by a hash of the text. Rows that agree in id and text are one
    document and keep or lose the same lines. Lines agree if they are equal but for white space at their ends; lines
    without words match nothing and stay. A null text stays null and counts no lines; a text that loses every line
    with words becomes what is left of it, at least the empty text. `rare` decides by which of two exact ways a run
    is deleted and never what is. Input columns named like an added one are replaced. An empty table gives no rows.
    """
    rows = packed(df).withColumns({"id": F.coalesce(F.col("record").getField(id_col).cast("long"), F.lit(2**63 - 1)), "text": F.col("record").getField(text_col)}).withColumn("h", F.xxhash64("text"))
    outlines = written(_outline(rows.filter("text IS NOT NULL").select("id", "h", "text"), min_words).dropDuplicates(["id", "h"]), "outlines")
    runs = outlines.select("id", "h", F.explode("runs").alias("r")).select(F.col("r.run").alias("run"), F.struct("id", "h").alias("doc"), F.col("r.start").alias("start"), F.col("r.end").alias("end"))
    first = F.min(F.struct("doc", "start"))
    owners = runs.groupBy("run").agg(first.alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).filter("first.doc <> last")
    owners = written(owners.select("run", F.col("first.doc").alias("owner"), F.col("first.start").alias("at"), "n"), "run-owners")
    total = runs.count()
    later = spread_join(runs, owners, "run", "n", total).filter("doc <> owner")
    entry = F.struct(F.when(F.col("n") <= rare, F.col("owner")).alias("owner"), "start", "end", "at")
    # A document's shared runs are bounded by its own lines.
    shared = later.groupBy("doc").agg(F.collect_list(entry).alias("shared")).select("doc.*", "shared")
    aligned = _aligned(shared.join(outlines.drop("runs"), ["id", "h"]), min_words)
    gone = aligned.filter("size(removed) > 0").select(F.col("id").alias("gone_id"), F.col("h").alias("gone_h"), F.map_from_arrays("removed", "removed_words").alias("gone"))
    joined = rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.map_contains_key("gone", i)), "\n")
    added = {
        "new_text": F.when(F.col("gone").isNull(), F.col("text")).otherwise(left),
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long"),
        "removed_lines": F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(F.map_keys("gone"))).cast("long"),
        "removed_words": F.coalesce(F.aggregate(F.map_values("gone"), F.lit(0), lambda a, n: a + n), F.lit(0)).cast("long"),
    }
    out = joined.withColumns(added)
    record = F.col("record").withField(text_col, F.col("new_text"))
    return unpacked(out.withColumn("record", record), ["n_lines", "removed_lines", "removed_words"])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "removed_lines", "removed_words", "text")


QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLE_SQL: dict[str, str] = {}
