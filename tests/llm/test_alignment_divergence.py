import hashlib
import heapq
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment
from tessera.llm.alignment import ByteLevel, Pieces, Transducer, align_tokens, group_texts
from tessera.llm.divergence import audit_sources, shares
from tessera.llm.tokens import tokenizer_path

from .data import awkward, awkward_rows, none, prose

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def sides():
    read = lambda name: open(tokenizer_path(name), "rb").read()
    return ByteLevel(read(FIRST)), Pieces(read(SECOND))


def by_offsets(a: list[bytes], b: list[bytes]):
    """(links, group ends) from byte offsets alone: every overlapping pair, tried against every other."""
    spans = lambda tokens: [(sum(map(len, tokens[:i])), sum(map(len, tokens[: i + 1]))) for i in range(len(tokens))]
    sa, sb = spans(a), spans(b)
    links = [(i, j) for i, x in enumerate(sa) for j, y in enumerate(sb) if max(x[0], y[0]) < min(x[1], y[1])]
    ends = {x[1] for x in sa} & {y[1] for y in sb}
    return links, [(sum(x[1] <= e for x in sa), sum(y[1] <= e for y in sb)) for e in sorted(ends)]


def test_transducer_matches_offsets():
    draw = random.Random(3)
    vocabulary = sorted({bytes(draw.choices(b"ab", k=draw.randint(1, 5))) for _ in range(60)} | {b"a", b"b"})
    transducer = Transducer(vocabulary, vocabulary)
    of = {w: i for i, w in enumerate(vocabulary)}

    def cut(whole: bytes) -> list[bytes]:
        out = []
        while whole:
            out.append(draw.choice([w for w in vocabulary if whole.startswith(w)]))
            whole = whole[len(out[-1]) :]
        return out

    for _ in range(300):
        whole = bytes(draw.choices(b"ab", k=draw.randint(1, 40)))
        a, b = cut(whole), cut(whole)
        ids_a, ids_b = [of[w] for w in a], [of[w] for w in b]
        links, *ends = transducer.align(ids_a, ids_b)
        expected, groups = by_offsets(a, b)
        assert links == [ids_a[i] << 32 | ids_b[j] for i, j in expected] and list(zip(*ends, strict=True)) == groups


def test_transducer_refuses_unlike_bytes():
    with pytest.raises(ValueError, match="different bytes"):
        Transducer([b"ab"], [b"ac"]).align([0], [0])
    with pytest.raises(ValueError, match="different bytes"):
        Transducer([b"ab"], [b"ab"]).align([0], [0, 0])


def test_memory_of_moves_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED_MOVES", 2)
    transducer = Transducer([b"ab", b"c"], [b"a", b"bc", b"b"])
    for _ in range(3):
        assert transducer.align([0, 1], [0, 1]) == ([0, 1, 1 << 32 | 1], [2], [2])
        assert transducer.align([0], [0, 2]) == ([0, 2], [1], [2])
    assert group_texts(list("010"), list("0102"), [2, 3], [2, 4]) == ["0,1|0,1", "0|0,2"]


def test_byte_level_equals_its_library(sides):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path(FIRST))
    whole.encode_special_tokens = True
    texts = [f" a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)} \n{chr(c)}" for c in range(0x250)] + [" <|endoftext|> 's'S  x ", " 你好 мир 　x", " " * 3000 + "a", "\n\n\t x" * 50]
    assert all(sides[0].encode(t) == whole.encode(t, add_special_tokens=False).ids for t in texts)


def expected_rows(rows, sides):
    out, counts = [], Counter()
    for doc, text in rows:
        a = b = []
        if text:
            a, b = sides[0].encode(" " + text), sides[1].encode(text)
            ta, tb = [sides[0].bytes[i] for i in a], [sides[1].bytes[i] for i in b]
            if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
                a, b = [], []
        if not a:
            out.append((doc, 0, 0, [], ""))
            continue
        ea, eb = np.cumsum([len(x) for x in ta]), np.cumsum([len(x) for x in tb])
        cuts = np.union1d(ea, eb)
        links = [(a[i], b[j]) for i, j in zip(np.searchsorted(ea, cuts), np.searchsorted(eb, cuts), strict=True)]
        ends = np.intersect1d(ea, eb)
        groups, p, q = [], 0, 0
        for i, j in zip(np.searchsorted(ea, ends) + 1, np.searchsorted(eb, ends) + 1, strict=True):
            groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
            p, q = i, j
        counts.update(links)
        out.append((doc, len(a), len(b), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    final = []
    for doc, n_a, n_b, links, groups in out:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        final.append((doc, n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), digest, sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)))
    return sorted(final, key=repr)


@pytest.mark.parametrize("block", [300, 3_000_000])
def test_alignment_matches_brute_force(spark, sides, block, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", block)
    odd = [(500, "▁a b"), (501, "a\x00b"), (502, "<s>[INST] <0x0A></s>"), (503, "  two  spaces \n\n"), (504, "мир 你好 é é 😀")]
    rows = [(r[0], r[1]) for r in awkward_rows()] + odd
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in align_tokens(df, FIRST, SECOND, digest=True).collect()]
    assert sorted(got, key=repr) == expected_rows(rows, sides)
    if block > 300:
        whole = align_tokens(awkward(spark), FIRST, SECOND).filter("doc_id = 7").first()
        assert whole.n_groups == 1 and whole.groups.count("|") == 1


def test_alignment_of_no_rows(spark):
    assert align_tokens(none(spark), FIRST, SECOND).collect() == []


def audited(rows, min_docs=3, best=200):
    """The audit by plain loops over dictionaries."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        of_lang = Counter()
        for other in groups:
            if other[0] == lang:
                of_lang.update(counts[other])
        share = lambda c, t, kept=kept: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept))
        p = {t: share(counts[lang, source], t) for t in kept}
        pairs = [(sum((p[t] - (q := share(counts[o], t))) ** 2 // q for t in kept), o[1]) for o in groups if o[0] == lang and o[1] != source]
        terms = [((p[t] - q) ** 2 // q, t) for t in kept if counts[lang, source][t] and p[t] > (q := share(of_lang, t))]
        for part, found in (("pair", sorted(pairs, key=lambda x: (-x[0], x[1].encode()))), ("term", heapq.nsmallest(best, terms, key=lambda x: (-x[0], x[1].encode())))):
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("terms,groups", [(8192, 256), (16, 2)])
def test_audit_matches_brute_force(spark, terms, groups, monkeypatch):
    from tessera.llm import divergence

    monkeypatch.setattr(divergence, "TILE_TERMS", terms)
    monkeypatch.setattr(divergence, "TILE_GROUPS", groups)
    monkeypatch.setattr(divergence, "HELD_COUNTS", 40)
    rows = [r[1:4] for r in awkward_rows()]
    rows += [(prose(i, 25).replace("ka", "Éß你"), "fr", f"s{i % 5}") for i in range(20)]
    rows += [("lone term", "xx", "only"), (None, "xx", None), ("", "yy", "a"), ("Same SAME same", "zz", "a"), ("same", "zz", "b"), ("same x", "zz", "b"), (None, "zz", "blank")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)).repartition(4)
    got = sorted(tuple(r) for r in audit_sources(df, best_terms=7).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == audited(rows, best=7)


def test_audit_of_no_rows(spark):
    assert audit_sources(none(spark)).collect() == []


def test_shares_are_exact_for_huge_counts():
    counts = np.array([0, 5, 8_999_999_999, 4 * 10**15, 9 * 10**14 + 7], dtype=np.int64)
    total = np.int64(4 * 10**15 + 1)
    assert shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(total) for c in counts]
    assert json.dumps(shares(counts[:2], np.int64(6)).tolist()) == json.dumps([1 + 10**9 // 6, 1 + 10**9])
