"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenized and cut; the cuts of many documents gather in batches of bounded bytes, and each batch is
partitioned into windows: every cut starts as a partial partition, and the two partial partitions of largest
imbalance merge, largest sums against smallest, until one is left. Its windows are near equal. The window count
starts at the least that could hold the tokens and rises whenever a window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import Tokenizers, tokenizer_path

#: Batches that a task packs at most; it reads about as many times batch_bytes, more where texts have many tokens.
TASK_BATCHES = 8
#: Words up to this many characters are remembered with their ids, up to this many words in a worker.
REMEMBERED_CHARS, REMEMBERED_WORDS = 40, 800_000


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Item numbers of k near-equal parts. Deterministic: ties fall to the earlier partition."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap, nodes = [], []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = size
        heap.append((-size, i, sums))
        nodes.append(None)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = x + y[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        nodes.append((a, b, order))
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), len(nodes) - 1, sums - sums[-1]))
    # Back from the last partition to the items: where[node] gives the window of each of the node's parts.
    where = {len(nodes) - 1: np.arange(k)} if nodes else {}
    parts: list[list[int]] = [[] for _ in range(k)]
    for node in range(len(nodes) - 1, -1, -1):
        if node not in where:
            continue
        target = where.pop(node)
        if nodes[node] is None:
            parts[int(target[0])].append(node)
            continue
        a, b, order = nodes[node]
        first = np.empty(k, dtype=np.int64)
        first[order] = target
        where[a], where[b] = first, first[::-1]
    return [sorted(p) for p in parts]


def pack_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts of at most `capacity`, as few as differencing finds from the lower bound upwards; none is empty."""
    full = [[i] for i, size in enumerate(sizes) if size == capacity]
    rest = [i for i, size in enumerate(sizes) if size < capacity]
    if not rest:
        return full
    part_sizes = [sizes[i] for i in rest]
    k = max(1, math.ceil(sum(part_sizes) / capacity))
    while True:
        parts = karmarkar_karp(part_sizes, k) if k < len(rest) else [[i] for i in range(len(rest))]
        if all(sum(part_sizes[i] for i in p) <= capacity for p in parts):
            return full + [[rest[i] for i in p] for p in parts if p]
        k += max(1, k // 200)


#: Letters and figures below U+0180, and what the pre-tokenizer takes apart of texts of these, ASCII punctuation and plain white space.
LETTERS, FIGURES = "A-Za-zªµºÀ-ÖØ-öø-\u017f", "0-9²³¹¼½¾"
PIECE = re.compile(rf"[{LETTERS}]+|[{FIGURES}]|'(?:[stmd]|re|ve|ll)|[^\s{LETTERS}{FIGURES}]+")
#: Other characters, and the start of a special token, which is one token wherever it stands: such texts are not taken apart here.
OTHER = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u012f\u0131-\u017f]|<\\|")


#: The characters of plain texts that are ASCII.
PLAIN_ASCII = bytes([9, 10, 13, *range(32, 127)])


class WordTokenizer:
    """Ids of a text, as little-endian 32-bit bytes, for a tokenizer that lowers case, drops white space and ends words.

    A text of PIECEs is taken apart as the tokenizer's own pre-tokenizer does; a piece is encoded once and remembered.
    New pieces of letters are encoded as one text: each ends with the one token that ends a word. Other texts are
    encoded by their words between spaces and newlines, or whole.
    """

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.of_letters = Tokenizer.from_buffer(file), Tokenizer.from_buffer(file)
        # Pieces of small letters need no normalizer and no pattern to take them apart.
        self.of_letters.normalizer, self.of_letters.pre_tokenizer = None, Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _pieces(text: str) -> list[str]:
        if text.isascii():
            plain = "<|" not in text and not text.encode().translate(None, PLAIN_ASCII)
        else:
            plain = not OTHER.search(text)
        # Words of other texts keep their case; words and pieces are looked up alike, each as a text of its own.
        return PIECE.findall(text.lower()) if plain else text.replace("\n", " ").split(" ")

    def _learn(self, new: list[str]) -> None:
        letters = [p for p in new if p.isalpha() and p == p.lower()]
        joined = self.of_letters.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids if letters else []
        ids = np.asarray(joined, dtype="<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(stops) != len(letters) or (stops and stops[-1] != len(ids)):
            self.known.update(zip(new, [x.tobytes() for x in self._encoded(new)], strict=True))
            return
        whole, starts = ids.tobytes(), [0, *stops][: len(stops)]
        self.known.update(zip(letters, [whole[4 * a : 4 * b] for a, b in zip(starts, stops, strict=True)], strict=True))
        rest = [p for p in new if p not in self.known]
        self.known.update(zip(rest, [x.tobytes() for x in self._encoded(rest)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        pieces = [self._pieces(t) for t in texts]
        new = [p for p in set().union(*pieces) if p not in self.known]
        self._learn([p for p in new if PIECE.fullmatch(p)])
        others = [p for p in new if p not in self.known]
        self.known.update(zip(others, [x.tobytes() for x in self._encoded(others)], strict=True))
        known = self.known.__getitem__
        out = [b"".join(map(known, some)) for some in pieces]
        for p in new:
            if len(p) > REMEMBERED_CHARS:
                del self.known[p]
        return out


def cuts(n: int, capacity: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then near-equal pieces of at most `most` tokens."""
    full = n // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    at, rest = full * capacity, n - full * capacity
    if rest:
        parts = math.ceil(rest / most)
        for i in range(parts):
            length = rest // parts + (i < rest % parts)
            out.append((at, length))
            at += length
    return out


def pack_documents(
    df: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, most: int = 1024, batch_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces with their token ids: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    A null text counts as empty; an empty one gives the end token alone. Each row is tokenized whole and its end
    token appended; a repeated row gives pieces of its own. Text, id and nothing else of df is used. A batch holds
    about `batch_bytes` of text by hash of the id and text, so any id or source spreads; rows that agree in both
    are dealt by a part of their pieces. An empty table gives no pieces.
    """
    volume = df.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1)).first()[0] or 0
    batches = max(1, math.ceil(volume / batch_bytes))
    tokenizers = Tokenizers(df.sparkSession, tokenizer_path(tokenizer), WordTokenizer)
    cut_schema = "batch long, doc_id long, start long, length long, ids binary, doc_tokens long"

    def tokenize(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = tokenizers.get(), np.uint32(end_id).astype("<u4").tobytes()
        for batch in stream:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for doc, mix, ids in zip(part["doc_id"].to_pylist(), part["mix"].to_pylist(), words.encode(part["text"].to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start, length in cuts(n, capacity, most):
                        rows.append(((mix + start * 2654435761) % batches, doc, start, length, ids[4 * start : 4 * (start + length)], n))
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)), schema=arrow)

    names = ["batch", "doc_id", "start", "length", "ids", "doc_tokens"]
    arrow = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])
    mix = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(2**31))
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), mix.alias("mix"))
    pieces = texts.mapInArrow(tokenize, cut_schema)

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        parts = pack_windows(group["length"].to_pylist(), capacity)
        order = np.array([i for p in parts for i in p], dtype=np.int64)
        lengths = group["length"].to_numpy()
        sequence = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) + (key[0].as_py() << 32)
        offset = np.concatenate([np.cumsum(lengths[p]) - lengths[p] for p in parts])
        return group.take(pa.array(order)).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).drop(["batch"])

    tasks = max(math.ceil(batches / TASK_BATCHES), 1)
    packed = pieces.repartition(tasks, "batch").groupBy("batch").applyInArrow(pack, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return packed


def ids_crc32(df: DataFrame) -> DataFrame:
    """The packed pieces with the CRC of their little-endian ids in place of the ids."""
    return df.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=2)
    return ids_crc32(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op6_packing": op6_packing}
ORACLE_SQL: dict[str, str] = {}
