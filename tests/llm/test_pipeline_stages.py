"""Stages of the pipeline on tables that the given ones don't resemble."""

import random
from collections import Counter

import pytest


def prose(rnd, n, least=3):
    return " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(least, 9))) for _ in range(n))


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rnd = random.Random(11)
    a, b, c, d, e = (prose(rnd, 80) for _ in range(5))
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (None, c), (7, c), (5, c), (9, d), (9, e), (None, d + " end"), (None, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _row string").repartition(3)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(1, a), (None, b), (5, c), (9, d), (9, e), (None, "")])


def test_repeats_are_measured_in_words(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rnd = random.Random(12)
    one = lambda n: " ".join(rnd.choice("abcdefghij") for _ in range(n))
    long_words = prose(rnd, 39, least=8)
    least, short, enough = one(51), one(50), prose(rnd, 51)
    han = "".join(chr(rnd.randint(0x4E00, 0x9FA5)) for _ in range(60))
    assert len(least) == 101 and len(long_words) > 300
    rows = []
    for i, passage in enumerate([least, short, enough, long_words, han]):
        # Two words that differ stand around each, so nothing more repeats.
        rows += [(10 * i + k, f"{prose(rnd, 60)} {k}x {passage} x{k} {prose(rnd, 60)}") for k in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in corpus_pipeline.remove_repeats(spark, docs, "").collect()}
    for i, (passage, gone) in enumerate([(least, True), (short, False), (enough, True), (long_words, False), (han, True)]):
        assert [passage in left[10 * i + k] for k in (1, 2)] == [not gone] * 2
    assert left[11] == rows[2][1] and left[31] == rows[6][1]
    assert all(len(left[k]) <= len(text) - 99 for k, text in rows[:2])
