"""Problem 10: held-out accuracy on made-up texts, calibration, and edge cases."""

from __future__ import annotations

import random

import numpy as np

from wordloom.llm import readability as r

EASY = ["The man left the map.", "She saw the small boat.", "It was cold and dark.", "We sold the milk at noon."]
HARD = "Notwithstanding the comprehensive characterisation of proportionality adopted by the administrative tribunal in its supplementary determination, the representative of the constitutional complainant could not persuasively substantiate the contractual allocation of environmental responsibility, whose evidentiary significance was considerably diminished by inconsistent testimony of the intervening municipality."
LONG = "The man left the map and she saw the small boat, so we sold the milk at noon and he took the car home, but the bank kept the key and the nurse hid the lamp."
WORDY = ["The bank repudiated the indemnification.", "She invoked statutory limitation.", "He alleged fraudulent misrepresentation.", "We saw the man."]


def document(rng, grade):
    kind = {1: [EASY], 2: [[LONG], WORDY], 3: [[HARD]]}[grade]
    pool = rng.choice(kind)
    body, words = [], 0
    while words < 130:
        body.append(rng.choice(pool))
        words += len(body[-1].split())
    head = "" if rng.random() < 0.5 else "Headnote: " + HARD + "\n\n"
    return head + " ".join(body) + " (see X v Y [1999] LTB 3 at [4])."


def test_grades_of_held_out_documents(spark):
    rng = random.Random(8)
    grades = [rng.randint(1, 3) for _ in range(240)]
    docs = [(i, document(rng, g), "clash", "clash") for i, g in enumerate(grades)]
    docs += [(1000, None, "", ""), (1001, "", "", ""), (1002, "Too short.", "", ""), (1003, "word " * 120, "", ""), (1004, EASY[0] * 20_000, "", "")]
    labels = [(i, grades[i] if rng.random() > 0.05 else rng.randint(1, 3)) for i in range(80)] + [(0, None), (1, grades[1]), (5000, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, words string, language string")
    got = {x.doc_id: x.grade for x in r.grade_documents(df, spark.createDataFrame(labels, "doc_id long, grade int")).collect()}
    assert set(got) == {*range(240), 1003, 1004}
    assert np.mean([got[i] == grades[i] for i in range(80, 240)]) > 0.97


def test_without_grades(spark):
    df = spark.createDataFrame([(1, "word " * 120)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert [(x.doc_id, x.grade) for x in r.grade_documents(df, none).collect()] == [(1, None)]
    assert r.grade_documents(df.limit(0), none).count() == 0


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        score, grade = rng.permutation(12).astype(float), rng.integers(1, 4, 12).astype(float)
        xs, ys = r.isotonic(score, grade)
        fit = np.interp(np.sort(score), xs, ys)
        sorted_grade = grade[np.argsort(score)]
        # The regression is the greatest of the least means over stretches that hold the place.
        best = [max(min(np.mean(sorted_grade[a : z + 1]) for z in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(fit, best)


def test_language_and_words():
    words, language, _ = r.measure(["The man and the dog of the house.", "Der Mann und die Frau sind nicht da.", "Le chien et la dame dans la rue.", None, "xyz"])
    assert [r.LANGUAGES[k] if k >= 0 else None for k in language] == ["en", "de", "fr", None, None]
    assert words.tolist() == [8, 8, 8, 0, 1]
