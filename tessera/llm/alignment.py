"""Cross-tokenizer alignment: a transducer over the bytes that one side has and the other has not matched yet."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written
from .tokens import Tokenizers, tokenizer_path

#: Fixed value: the pre-tokenizer's pattern that byte-level vocabularies of this kind are made with.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond these characters Unicode tables of regex engines differ, and very long blanks exhaust one: such texts go to the tokenizer's own library.
WIDE = re.compile(r"[^\u0000-ͯ]|\s{10000}")
#: Transitions that a worker remembers before it starts anew.
REMEMBERED_MOVES = 400_000
#: Segments that a worker remembers before it starts anew, the longest of them, and documents that are looked up together.
REMEMBERED_SEGMENTS, LONGEST_SEGMENT, TOGETHER = 120_000, 64, 256
#: Where a text may be cut: no token of either side spans the place before a single space between other characters.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Distinct links of its documents, and documents, that a block holds before it gets its dictionary.
BLOCK_LINKS, BLOCK_DOCS = 3_000_000, 20_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 bytes are themselves, others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Ids of a byte-level BPE without special tokens, and the bytes of each id."""

    def __init__(self, file: bytes):
        import tiktoken

        self.file, model, letter = file, json.loads(file)["model"], _byte_letters()
        ranks = {bytes(letter[c] for c in word): i for word, i in model["vocab"].items() if all(c in letter for c in word)}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            self.bytes[i] = word
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("ids of this vocabulary do not follow the order of its merges")
        self.quick = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._whole = None

    @property
    def whole(self):
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_buffer(self.file)
            self._whole.encode_special_tokens = True
        return self._whole

    def encode(self, text: str) -> list[int]:
        if WIDE.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        if WIDE.search("".join(texts)):
            return [self.encode(t) for t in texts]
        return [self.quick.encode_ordinary(t) for t in texts]


class Pieces:
    """Ids of a sentencepiece model, which puts a space ahead of the text, and the bytes of each id."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        name = self.model.id_to_piece
        self.bytes = [bytes([int(name(i)[3:5], 16)]) if self.model.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []

    @property
    def spans_words(self) -> bool:
        """Whether a piece has a space after another character."""
        return any(" " in piece.lstrip(b" ").decode(errors="ignore") for piece in self.bytes)


class Transducer:
    """Walks two token sequences over the same bytes, always feeding the side that is behind.

    A state is the residual: 0 if nothing is unmatched, else a number, positive where the first side leads and
    negative where the second does, of the leading token's bytes that the other side has not matched. A residual
    belongs to one token, so each token fed while something is unmatched overlaps just that one: a link. Moves by
    residual and next token are remembered. A group closes where the residual is empty.
    """

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.first, self.second, self.width = first, second, max(len(first), len(second))
        self._forget()

    def _forget(self) -> None:
        self.residuals: list[bytes] = [b""]
        self.numbers: dict[bytes, int] = {b"": 0}
        self.moves: dict[int, int] = {}
        self.opened: dict[int, int] = {}  # by the first link of a group

    def _number(self, residual: bytes) -> int:
        at = self.numbers.setdefault(residual, len(self.residuals))
        if at == len(self.residuals):
            self.residuals.append(residual)
        return at

    def _move(self, state: int, token: int) -> int:
        residual = self.residuals[abs(state)]
        fed = (self.second if state > 0 else self.first)[token]
        shared = min(len(residual), len(fed))
        if residual[:shared] != fed[:shared]:
            raise ValueError("the two sides have different bytes")
        left = self._number(residual[shared:] or fed[shared:])
        return left if (len(residual) > shared) == (state > 0) else -left

    def _opened(self, x: int, y: int) -> int:
        """The state after the first tokens of a group, one of each side."""
        return self._move(self._number(self.first[x]), y)

    def align(self, a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
        """Links as first id * 2^32 + second id, in order, and the ends of groups on either side."""
        if len(self.moves) + len(self.opened) > REMEMBERED_MOVES:
            self._forget()
        moves, opened, width = self.moves, self.opened, self.width
        links: list[int] = []
        ends_a: list[int] = []
        ends_b: list[int] = []
        i, j, n = 0, 0, len(a)
        while i < n:
            x, y = a[i], b[j]
            i, j = i + 1, j + 1
            link = x << 32 | y
            links.append(link)
            state = opened.get(link)
            if state is None:
                state = opened[link] = self._opened(x, y)
            while state:
                if state > 0:
                    y = b[j]
                    j += 1
                    move = state * width + y
                else:
                    x = a[i]
                    i += 1
                    move = state * width + x
                links.append(x << 32 | y)
                after = moves.get(move)
                if after is None:
                    after = moves[move] = self._move(state, y if state > 0 else x)
                state = after
            ends_a.append(i)
            ends_b.append(j)
        if j < len(b):
            raise ValueError("the two sides have different bytes")
        return links, ends_a, ends_b


def group_texts(left: list[str], right: list[str], ends_a: list[int], ends_b: list[int]) -> list[str]:
    """`a1,a2|b1` for each group, of the ids of both sides as text."""
    out, p, q = [], 0, 0
    for i, j in zip(ends_a, ends_b, strict=True):
        if i == p + 1 and j == q + 1:
            out.append(f"{left[p]}|{right[q]}")
        else:
            out.append(f"{','.join(left[p:i])}|{','.join(right[q:j])}")
        p, q = i, j
    return out


class Segments:
    """Alignments of segments, cut where no token spans and so every group closes, remembered like the moves within them."""

    def __init__(self, first: ByteLevel, second: Pieces):
        self.first, self.second = first, second
        self.transducer = Transducer(first.bytes, second.bytes)
        self.names = [str(i) for i in range(max(len(first.bytes), len(second.bytes)))]
        self.cut = (lambda text: [text]) if second.spans_words else CUT.split
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.texts: list[str] = []
        self.sizes, self.links, self.starts = array("q"), array("q"), array("q", [0])

    def _learn(self, new: list[str]) -> None:
        """Aligns new segments in one walk: every group closes at a segment's end."""
        a, b = self.first.encode_all([" " + s for s in new]), self.second.encode_all(new)
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        bytes_of = lambda side, ids: b"".join(map(side.bytes.__getitem__, ids))
        if not bytes_of(self.first, flat_a) == bytes_of(self.second, flat_b) == " ".join(["", *new]).encode():
            for k, segment in enumerate(new):
                if not bytes_of(self.first, a[k]) == bytes_of(self.second, b[k]) == (" " + segment).encode():
                    a[k], b[k] = [], []
            flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        links, ends_a, ends_b = self.transducer.align(flat_a, flat_b)
        groups = group_texts(list(map(self.names.__getitem__, flat_a)), list(map(self.names.__getitem__, flat_b)), ends_a, ends_b)
        n_a, n_b = (np.fromiter(map(len, side), dtype=np.int64, count=len(side)) for side in (a, b))
        upto = np.searchsorted(np.array(ends_a, dtype=np.int64), np.cumsum(n_a), side="right")
        n_groups = np.diff(upto, prepend=0)
        n_links = n_a + n_b - n_groups
        at = len(self.texts)
        self.places.update(zip(new, range(at, at + len(new)), strict=True))
        since = 0
        for end in upto.tolist():
            self.texts.append(groups[since] if end == since + 1 else ";".join(groups[since:end]))
            since = end
        self.sizes.frombytes(np.stack([n_a, n_b, n_groups, n_links], axis=1).tobytes())
        self.starts.frombytes((np.cumsum(n_links) + len(self.links)).tobytes())
        self.links.frombytes(np.array(links, dtype=np.int64).tobytes())

    def align(self, texts: list[str | None]) -> Iterator[tuple[list[int], str, np.ndarray]]:
        """For each text: n_a, n_b, n_groups and n_links, its groups, and its links in order."""
        if len(self.texts) > REMEMBERED_SEGMENTS:
            self._forget()
        cut = [self.cut(t) if t else [] for t in texts]
        new = {s for s in set().union(*cut) if s not in self.places}
        kept = len(self.texts) + sum(len(s) <= LONGEST_SEGMENT for s in new)
        self._learn(sorted(new, key=lambda s: len(s) > LONGEST_SEGMENT))  # long ones last: they go again below
        sizes, links, starts = np.array(self.sizes).reshape(-1, 4), np.array(self.links), np.array(self.starts)
        for segments in cut:
            at = [self.places[s] for s in segments]
            own = sizes[at]
            if not at or not own[:, 0].all():  # a segment that a side does not give back
                yield [0, 0, 0, 0], "", links[:0]
                continue
            shift = starts[at] - np.cumsum(own[:, 3]) + own[:, 3]
            total = own.sum(axis=0)
            yield total.tolist(), ";".join([self.texts[i] for i in at]), links[np.repeat(shift, own[:, 3]) + np.arange(total[3])]
        if kept < len(self.texts):
            self.places = {s: i for s, i in self.places.items() if i < kept}
            del self.texts[kept:], self.sizes[4 * kept :], self.links[self.starts[kept] :], self.starts[kept + 1 :]


def _block(docs: list[tuple], block: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a block: documents with links as places in its dictionary, and the dictionary with its counts."""
    sizes = [len(d[-2]) for d in docs]
    codes, place = np.unique(np.concatenate([d[-2] for d in docs]), return_inverse=True)
    n = np.concatenate([d[-1] for d in docs])
    total = np.bincount(place, weights=n, minlength=len(codes)).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    fields = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    for at in range(0, len(docs), 500):
        some = range(at, min(at + 500, len(docs)))
        row = {f: [docs[d][k] for d in some] for k, f in enumerate(fields)} | {"block": [block] * len(some)}
        row["links"] = [zlib.compress(np.stack([np.diff(p, prepend=0), c]).astype("<i4").tobytes(), 1) for p, c in ((place[s:e], n[s:e]) for s, e in ((starts[d], starts[d] + sizes[d]) for d in some))]
        yield pa.RecordBatch.from_arrays([pa.array(row.get(f.name, [None] * len(some)), f.type) for f in arrow], schema=arrow)
    for at in range(0, len(codes), 20_000):
        part = codes[at : at + 20_000]
        row = {"block": np.full(len(part), block), "place": np.arange(at, at + len(part), dtype=np.int32), "a": (part >> 32).astype(np.int32), "b": (part & 0xFFFFFFFF).astype(np.int32), "n": total[at : at + 20_000]}
        yield pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) if f.name in row else pa.nulls(len(part), f.type) for f in arrow], schema=arrow)


def aligned(df: DataFrame, first: str, second: str, digest: bool, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (place is null) and of dictionaries of links (block, place, a, b, n): see align_tokens()."""
    spark = df.sparkSession
    of_a, of_b = Tokenizers(spark, tokenizer_path(first), ByteLevel), Tokenizers(spark, tokenizer_path(second), Pieces)
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    names = {"block": "long", "doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string", "links": "binary", "place": "int", "a": "int", "b": "int", "n": "long"}
    arrow = pa.schema([(c, kinds[k]) for c, k in names.items()])

    def walk(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(of_a.get(), of_b.get())
        docs: list[tuple] = []
        block, held = TaskContext.get().partitionId() << 20, 0
        for batch in stream:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                for doc, (sizes, groups, links) in zip(part["doc_id"].to_pylist(), segments.align(part["text"].to_pylist()), strict=True):
                    codes, n = np.unique(links, return_counts=True)
                    docs.append((doc, *sizes, hashlib.sha256(groups.encode()).hexdigest() if digest and groups else groups, codes, n))
                    held += len(codes)
                    if held >= BLOCK_LINKS or len(docs) >= BLOCK_DOCS:
                        yield from _block(docs, block, arrow)
                        docs, held, block = [], 0, block + 1
        if docs:
            yield from _block(docs, block, arrow)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(walk, ", ".join(f"{c} {k}" for c, k in names.items()))


def _add_up(key: tuple, docs: pa.Table, values: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents from its dictionary with corpus-wide counts."""
    count, best = np.zeros(values.num_rows, np.int64), np.zeros(values.num_rows, bool)
    place = values["place"].to_numpy()
    count[place], best[place] = values["count"].to_numpy(), values["best"].to_numpy(zero_copy_only=False)
    n_best, sums = [], []
    for packed in docs["links"].to_pylist():
        step, n = np.frombuffer(zlib.decompress(packed), "<i4").astype(np.int64).reshape(2, -1)
        at = np.cumsum(step)
        n_best.append(int(n[best[at]].sum()))
        sums.append(int((n * count[at]).sum()))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def align_tokens(df: DataFrame, first: str, second: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum for each row of df.

    `first` is a byte-level vocabulary and encodes a space and the text, `second` a sentencepiece model that adds the
    space itself. `groups` lists the ids of each group, or is the hex SHA-256 of that list with `digest`. A link joins
    two tokens that share bytes; the count of an id pair is the number of links of all rows that hold it, `n_best`
    counts links whose count is the highest of their second id (ties too), `count_sum` adds counts over links. Null and
    empty texts, and texts that a side does not give back byte for byte, have no tokens: zeros and ''. Repeated rows
    count each; columns other than the two named are not used. An empty table gives no rows.

    A task cuts its documents into blocks of bounded size. Each block has a dictionary of its distinct links: only
    dictionaries are shuffled to count pairs, and counts return to the dictionary, never to single links.
    """
    rows = written(aligned(df, first, second, digest, id_col, text_col), "alignment")
    dictionary = rows.filter("place IS NOT NULL").select("block", "place", "a", "b", "n")
    pairs = dictionary.groupBy("a", "b").agg(F.sum("n").alias("count"))
    pairs = written(pairs.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b"))), "alignment-pairs")
    values = dictionary.join(pairs, ["a", "b"]).select(F.col("block").alias("of_block"), "place", "count", "best")
    docs = rows.filter("place IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    return docs.groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(_add_up, schema)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model", digest=True)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLE_SQL: dict[str, str] = {}
