"""Awkward documents: nulls, blanks, copies, repeated rows, long texts, control characters, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string, size string, record string, h string, extra map<string,int>"
VOCABULARY = [f"{a}{b}" for a in "ka lo mi tu re so ne".split() for b in "na ri do be xu".split()]


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    out = []
    for i in range(words):
        out.append(draw.choice(VOCABULARY) + ("." if i % 9 == 8 else ""))
    return "\n".join(" ".join(out[i : i + 12]) for i in range(0, len(out), 12))


def awkward_rows() -> list[tuple]:
    base = prose(1, 80)
    texts = [
        (1, base), (2, base), (3, base.replace("kana", "zzz", 1)), (4, None), (5, ""), (6, "   \n\t "), (7, "word"), (8, "word"), (None, prose(2, 40)), (None, prose(3, 40)),
        (9, prose(4, 60)), (9, prose(4, 60)), (9, prose(5, 60)), (10, prose(6, 9000)), (11, "\n".join(["same line of text again"] * 40)), (12, "ÀÉ naïve ß İstanbul Σας 你好 \x1c\x0b <|endoftext|> \\ don't"),
        (13, prose(7, 70) + "\n" + base), (14, "x" * 30000),
    ]
    rows = []
    for i, (doc, text) in enumerate(texts):
        rows.append((doc, text, [None, "en", "de"][i % 3], ["a", None, "b"][i % 3], None, "s", "k", "z", "r", "h", {"a": 1}))
    for i in range(100, 180):
        rows.append((i, prose(i, 30 + i % 50), "en", "a", None, None, None, None, None, None, None))
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
