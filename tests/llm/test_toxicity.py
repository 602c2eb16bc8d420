import math
import random

import numpy as np
import pytest

from fieldlab.llm import op8_toxicity as op

from .common_cases import docs, odd, saved


def corpus(n=400):
    rng = random.Random(1)
    word = lambda: rng.choice("river stone market window garden letter morning yellow story table".split())
    texts, labels = [], []
    for i in range(n):
        t = [word() for _ in range(rng.randrange(5, 80))]
        bad = i % 5 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            t[rng.randrange(len(t))] = rng.choice(["idiot", "moron", "1d10t", "mоron", "Idiot!"])
        texts.append(" ".join(t))
        labels.append((i, int(bad)))
    return texts, labels


def test_folding():
    assert op.fold("1D10T") == "idiot" and op.fold("mоrоn") == "moron" and op.fold("ｉｄｉｏｔ") == "idiot" and op.fold("l0$er!!") == "loser!!"
    assert op.fold("room 101 at 4711 b2b") and op.fold("abc$$$") == "abc$$$" and op.fold("Äpfel é") == "äpfel é"
    assert "24be64439e3e49cf" in op.fold("24be64439e3e49cf46b2d7c90f3602a3d0b907ff")


def test_exceptions_silence_what_they_hold():
    lexicon = op.Lexicon({"clown": 5.0, "trash": 4.0})
    assert lexicon.features("a clown fish in a trash can")[0] == 0 < lexicon.features("you clown")[0]
    assert lexicon.features("a declowned word")[0] == 0
    assert op.Lexicon({}).features("") == [0.0, 0.0, 0.0, 0.0]


def test_held_out_accuracy(spark, tmp_path):
    texts, labels = corpus()
    saved(docs(spark, texts), tmp_path, "documents")
    saved(spark.createDataFrame(labels, "doc_id long, toxic int"), tmp_path, "labels")
    got = {r.doc_id: r for r in op.query(spark, str(tmp_path)).collect()}
    tests = [(got[i], y) for i, y in labels if got[i].held_out]
    assert len(got) == 400 and len(tests) > 50 and sum((r.score >= 0.5) == bool(y) == bool(r.predicted) for r, y in tests) >= 0.97 * len(tests)


def test_real_tables(spark):
    got = op.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.predicted for r in got) > 0.9 and hit / sum(r.toxic for r in got) > 0.6


def test_odd_rows(spark):
    labels = spark.createDataFrame([(None, 1), (1, None), (5, 1), (5, 0), (99, 1)], "doc_id long, toxic int")
    lexicon = op.learn(odd(spark), labels)
    got = op.score_toxicity(odd(spark, score="mine"), lexicon).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert op.score_toxicity(docs(spark, ["a"]).limit(0), lexicon).count() == 0
    assert op.learn(docs(spark, ["a"]).limit(0), labels.limit(0)).weights.keys() == op.Lexicon({}).weights.keys()


@pytest.mark.parametrize("rows", [50])
def test_sample_is_bounded(spark, rows):
    texts, labels = corpus()
    assert op.learn(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"), rows=rows).weights


def plain_features(lexicon, text):
    """The same with a plain search: at each place the longest entry, and on behind it."""
    text, at, total, own = op.fold(text), 0, 0.0, set()
    while at < len(text):
        found = max((t for t in lexicon.weights if text.startswith(t, at)), key=len, default=None)
        if found and lexicon.weights[found] and (at == 0 or not text[at - 1].isalnum()):
            total += lexicon.weights[found]
            own.add(found)
        at += len(found) if found else 1
    n = text.count(" ") + text.count("\n") + 1
    return [math.log1p(total), total / n**0.5, math.log1p(len(own)), math.log(n)]


def test_features_equal_a_plain_search():
    rng = random.Random(2)
    for _ in range(200):
        entries = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.choice([0.0, 1.0, 2.5]) for _ in range(6)}
        lexicon = op.Lexicon(entries, exceptions=("ca b", "abca"))
        text = "".join(rng.choice("abcA \n") for _ in range(rng.randint(0, 60)))
        assert np.allclose(lexicon.features(text), plain_features(lexicon, text))
    lexicon = op.Lexicon({"clown": 3.0, "scum": 2.0})
    assert lexicon.features("a clown fish and pond scum")[0] == 0 < lexicon.features("a clown and scum")[0]


def test_learning_equals_plain_counts(spark):
    """Entries, weights and exceptions of a small corpus, counted without Spark; words of any length, no bound on entries."""
    texts, labels = corpus(300)
    long = "unbelievable" + "x" * 40
    texts = [t + (f" {long}s idiot" if y else f" {long} garden") + (" idiot river" if i % 3 == 1 and not y else "") for i, (t, (_, y)) in enumerate(zip(texts, labels, strict=True))]
    got = op.learn(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    y = [b for _, b in labels]

    def counted(of):
        held = [of(t) for t in texts]
        each = {t: (sum(t in h for h, b in zip(held, y, strict=True) if b), sum(t in h for h, b in zip(held, y, strict=True) if not b)) for t in set().union(*held)}
        return each, {t: math.log((a + 0.5) / (sum(y) + 1)) - math.log((b + 0.5) / (len(y) - sum(y) + 1)) for t, (a, b) in each.items()}

    n, w = counted(op.terms)
    good = {t for t in n if n[t][0] >= op.LEAST_DOCS and w[t] >= op.LEAST_WEIGHT}
    want = {t: w[t] for t in good if not any(n[u] == n[t] and len(u) > len(t) and (u[:-1] == t or len(u) > op.LONGEST and u[: op.LONGEST] == t) for u in good)}
    assert long + "s" in want
    n, w = counted(op.Lexicon(want).phrases)
    silent = {t for t in n if n[t][1] >= op.LEAST_DOCS and w[t] <= -op.LEAST_WEIGHT}
    assert {t for t, x in got.weights.items() if x == 0} == silent | {op.fold(x) for x in op.EXCEPTIONS}
    assert {t for t, x in got.weights.items() if x} == want.keys() and all(abs(got.weights[t] - x) < 1e-9 for t, x in want.items())


def test_phrases_of_clean_documents_are_exceptions(spark):
    texts = ["you moron go away", "what a moron you are"] * 40 + ["the velvet moron grows in the garden"] * 20 + ["nothing of the kind"] * 200
    labels = [(i, int(i < 80)) for i in range(len(texts))]
    lexicon = op.learn(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert lexicon.weights["velvet moron"] == lexicon.weights["moron grows"] == 0 and "a moron" not in lexicon.weights
    assert lexicon.features("a velvet moron")[0] == 0 < lexicon.features("a moron")[0]


def test_masked_words_of_any_length():
    assert op.fold("1d10t" + "y" * 40 + "1d10t") == "idiot" + "y" * 40 + "idiot" and op.fold("m0r0n99") == "moron99"
    assert op.fold("a2f4c9") == "a2f4c9"
