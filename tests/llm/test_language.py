"""Language models: probabilities that sum to one, held-out accuracy, rejection, edge rows."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from oligoweave.llm import language


def corpus(rng, syllables, n):
    words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(200)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    sets = {"aa": ["the", "tion", "ing", "er", "an"], "bb": ["sch", "ung", "keit", "er", "ein"], "cc": ["ção", "mente", "qu", "os", "an"]}
    rows = [(lang, text) for lang, s in sets.items() for text in corpus(rng, s, 250)]
    rows = [(i, text, lang, "s") for i, (lang, text) in enumerate(rows)]
    rows += [(9000, None, "aa", "s"), (9001, "123 !", "bb", "s"), (9002, "", None, "s"), (None, rows[0][1], "aa", "s"), (9003, "zzz漢字xx qqq ððð 語語" * 9, None, "s")]
    rows += [(9004, "the ing", None, "s")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string").repartition(4)


def test_probabilities_sum_to_one():
    rng = random.Random(6)
    counts = []
    for lang, s in (("x", "abca"), ("y", "bcdd")):
        grams = Counter()
        for _ in range(300):
            padded = language.START + "".join(rng.choice(s) for _ in range(rng.randrange(1, 7))) + language.END
            for end in range(2, len(padded) + 1):
                for start in range(max(0, end - language.ORDER), end):
                    grams[padded[start:end]] += 1
        counts += [(lang, g, n) for g, n in grams.items()]
    models = language.build(pd.DataFrame(counts, columns=["lang", "gram", "n"]))
    alphabet = ["a", "b", "c", "d"]
    for head in ["", "a", "ab", "dcb", "zzab", "abcda"]:
        total = np.zeros(2)
        whole = models.word_scores([head])[0]
        for c in [*alphabet, "é"]:  # one unseen character has the share of all unseen ones
            ahead = models.word_scores([head + c])[0] - _end(models, head + c)
            total += np.exp(ahead - (whole - _end(models, head)))
        total += np.exp(_end(models, head))
        assert np.allclose(total, 1, atol=1e-6), (head, total)


def _end(models, word):
    """Log probability of the end mark after a word: found by taking the rest away."""
    padded = language.START + word + language.END
    codes = np.frombuffer(padded.encode("utf-32-le"), np.uint32)
    hashes = language.window_hashes(codes)
    at, total = len(codes) - 1, np.zeros(len(models.languages))
    for k in range(min(language.ORDER, len(codes)), 0, -1):
        i = np.searchsorted(models.grams[k], hashes[k][at])
        if i < len(models.grams[k]) and models.grams[k][i] == hashes[k][at]:
            return total + models.log_p[k][i]
        if k > 1:
            i = np.searchsorted(models.histories[k], hashes[k - 1][at - 1])
            if i < len(models.histories[k]) and models.histories[k][i] == hashes[k - 1][at - 1]:
                total = total + models.back_off[k][i]
    return total + models.log_floor


def test_held_out_accuracy_and_rejection(spark, labelled):
    models = language.train(labelled)
    assert models.languages == ["aa", "bb", "cc"]
    got = language.predict(labelled, models).collect()
    assert len(got) == labelled.count()
    truth = {r.doc_id: r.lang for r in labelled.collect()}
    tested = [r for r in got if r.held_out and r.doc_id < 9000]
    assert len(tested) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in tested) / len(tested) > 0.98
    by = {r.doc_id: r for r in got}
    for odd in (9000, 9001, 9002):
        assert (by[odd].lang_pred, by[odd].score, by[odd].rejected) == ("und", 0.0, True)
    assert by[9003].rejected and by[9004].lang_pred == "aa" and not by[9004].rejected
    assert all(0 <= r.score <= 1 and (r.cross_entropy is None or math.isfinite(r.cross_entropy)) for r in got)
    assert sum(r.rejected for r in got if r.doc_id is not None and r.doc_id < 9000) <= 2
    kept = language.accepted(labelled, models)
    assert kept.columns == labelled.columns and kept.count() == sum(not r.rejected for r in got)


def test_no_labels_and_no_rows(spark, labelled):
    unlabelled = labelled.withColumn("lang", labelled["lang"].substr(9, 0)).where("lang is null")
    assert language.train(unlabelled) is None
    assert {r.lang_pred for r in language.predict(unlabelled, None).collect()} == {"und"}
    assert language.accepted(unlabelled, None).count() == 0
    assert language.predict(labelled.limit(0), None).count() == 0
