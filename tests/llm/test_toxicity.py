import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.toxicity import PRIOR, SEEDS, Lexicon, calibrate, choose_terms, evidence, fold, held_out, score_toxicity

from .data import awkward, awkward_rows, none, prose


@pytest.mark.parametrize(
    "text,words",
    [
        ("Idiot!", "idiot"), ("ID1OT", "idiot"), ("1d10t l0s3r", "idiot loser"), ("m0r0n.", "moron"), ("$tupid tr@sh", "stupid trash"), ("stupid$$$ the&&& $$$", "stupid the"), ("іdіоt сlоwn", "idiot clown"), ("ｓｃｕｍ 𝐬𝐜𝐮𝐦", "scum scum"),
        ("id​i­ot", "idiot"), ("réeux ÉTÉ", "réeux été"), ("in 2024 at 10:30", "in at"), ("src12 v2", "src v"), ("", ""), (None, ""), ("123 !!!", ""),
    ],
)
def test_folding(text, words):
    folded, n = fold(text)
    assert folded.split() == words.split() and n == len(words.split()) and folded[0] == folded[-1] == " "


def brute_hits(folded, weights, exceptions):
    """Heaviest term of each word outside exception phrases, word by word."""
    words = folded.split()
    within = set()
    for phrase in exceptions:
        parts = fold(phrase)[0].split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                within |= set(range(i, i + len(parts)))
    found = []
    for i, word in enumerate(words):
        own = [w for term, w in weights.items() if (f" {word} ".startswith(term) if not term.endswith(" ") else f" {word} " == term)]
        if own and i not in within and max(own) > 0:
            found.append(max(own))
    return sorted(found)


def test_matches_are_those_of_a_word_by_word_search():
    draw = random.Random(4)
    weights = {" idiot ": 2.0, " idio": 1.5, " trash ": 3.0, " tra": 0.5, " scum": 4.0, " a ": 1.0}
    exceptions = ["Trash can", "pond scum", "a trash can lid", "idiot proof"]
    lexicon = Lexicon(weights, exceptions)
    pieces = ["idiot", "idiots", "trash", "can", "trashy", "scum", "scummy", "pond", "a", "lid", "proof", "other", "traffic"]
    for _ in range(2000):
        folded = fold(" ".join(draw.choices(pieces, k=draw.randint(0, 12))))[0]
        assert sorted(lexicon.hits(folded).values()) == brute_hits(folded, weights, exceptions), folded
    assert Lexicon({}, []).hits(" idiot ") == {} and Lexicon({}, ["trash can"]).hits(" trash can ") == {}


def test_weight_counts_by_length():
    assert evidence(0.0, 0) == (0.0, 0.0)
    short, long = evidence(6.0, 50), evidence(6.0, 5000)
    assert short[0] == long[0] and short[1] > long[1] + 2


def test_terms_are_chosen_without_their_stems_and_extensions():
    found = choose_terms([(" idi", 50.0, 2.0), (" idiot", 50.0, 2.0), (" idiot ", 50.0, 2.0), (" idiots ", 20.0, 3.0), (" scum ", 40.0, 1.0), (" scu", 10.0, 1.0)], 10)
    assert found == {" idiot": 2.0, " scum ": 1.0}
    assert list(choose_terms([(" aaa ", 5.0, 1.0), (" bbb ", 6.0, 1.0)], 1)) == [" bbb "]


def test_calibration_is_the_prior_without_rows_and_moves_with_them():
    assert np.allclose(calibrate(np.empty((0, 2)), np.empty(0)), PRIOR)
    x = np.array([[0.0, 0.0]] * 90 + [[2.0, 3.0]] * 10)
    w = calibrate(x, np.array([0.0] * 90 + [1.0] * 10))
    odds = lambda row: 1 / (1 + math.exp(-(w[0] + w[1:] @ np.array(row))))
    assert odds([0, 0]) < 0.1 and odds([2, 3]) > 0.8


def labelled(n=1500, seed=1):
    """Documents of invented prose; toxic ones hold insults, some disguised, or words of one invented stem."""
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words, toxic = prose(1000 + i, draw.randint(30, 200)).split(), i % 9 == 0
        if toxic:
            insults = ["idiot", "1diot", "m0ron", "scum", "trash", "lоser"] if i % 2 else [f"zorgal{x}" for x in ("", "en", "ox", "ti")]
            for _ in range(draw.randint(3, 6)):
                words.insert(draw.randrange(len(words)), draw.choice(insults))
        elif i % 9 == 1:
            words.insert(5, draw.choice(["trash can", "pond scum", "zorg"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_labels_are_told_right(spark):
    rows, labels = labelled()
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(df, known, learn_from=~held_out(F.col("doc_id"))).collect()}
    apart = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    truth = dict(labels)
    assert len(got) == len(rows) and len(apart) > 300
    right = sum(got[i].predicted == truth[i] for i in apart) / len(apart)
    caught = sum(got[i].predicted for i in apart if truth[i]) / sum(truth[i] for i in apart)
    assert right > 0.98 and caught > 0.9 and all((r.score >= 0.3) == r.predicted and 0 <= r.score <= 1 for r in got.values())


def test_labels_held_out_decide_nothing(spark):
    rows, labels = labelled(400)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    scores = [{r.doc_id: r.score for r in score_toxicity(df, spark.createDataFrame(x, "doc_id long, toxic int"), learn_from=~held_out(F.col("doc_id")), carry=["doc_id"]).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_copies_teach_once(spark):
    """A toxic text in two hundred copies, some with a word changed, makes no lexicon of its clean words."""
    rows, labels = labelled(600, seed=3)
    copied = prose(77, 80).split() + ["scum", "idiot", "trash", "moron"]
    for i in range(200):
        words = list(copied)
        words[i % 7] = f"word{i % 3}"
        rows.append((10_000 + i, " ".join(words)))
        labels.append((10_000 + i, 1))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    trained = toxicity._training_rows(df, known, F.lit(True), 20_000, "doc_id", "text")
    assert trained.count() < 640
    weights = toxicity.learn_lexicon(trained)
    assert any(t.startswith(" zorg") for t in weights) and not {t for t in weights if t.strip() in set(copied[:-4])}


def test_without_labels_the_seeds_decide(spark):
    df = spark.createDataFrame([(1, "You idiot, you moron, worthless scum"), (2, "A calm text about the weather and a trash can"), (3, None), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(df, labels).collect()}
    assert got[1].predicted == 1 and got[2].score == got[3].score == got[4].score < 0.3 and SEEDS
    assert got[3].text is None


def test_awkward_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 0), (12345, 1)], "doc_id long, toxic int")
    rows = score_toxicity(awkward(spark).withColumn("score", F.lit("old")), labels).collect()
    assert len(rows) == len(awkward_rows()) and all(isinstance(r.score, float) for r in rows) and rows[0].extra is None or rows[0].extra == {"a": 1}
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert score_toxicity(none(spark), labels).count() == 0
