"""Toxicity: held-out quality, labels that must not matter, defined cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fcverify.llm import toxicity
from tests.llm import fixtures as fx

INSULTS = ["grobian", "grobianen", "lumpus", "schuft"]


def corpus(n=900):
    """Documents, a third of them one text, and labels of most; toxic ones have insults."""
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < .15
        words = fx.words_text(i, rng.choice([8, 40, 300]), 3000).split()
        for _ in range(rng.choice([2, 4, 8]) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", "!", "###", ","]))
        docs.append((i, " ".join(words), None, None, 0))
        if rng.random() < .6:
            labels.append((i, 1, int(toxic)))
    docs += [(n + i, "one text in a third of all rows", None, None, 0) for i in range(n // 2)]
    return docs, labels, {d[0]: int(any(x in d[1] for x in INSULTS)) for d in docs}


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels, truth = corpus()
    made = toxicity.classify(fx.frame(spark, docs).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return docs, labels, truth, {r.doc_id: r for r in made}


def test_held_out_rows_are_told_apart(scored):
    docs, _, truth, made = scored
    assert len(made) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in made.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in made.items())
    held = [(truth[i], r.predicted) for i, r in made.items() if r.held_out]
    hits = sum(t and p for t, p in held)
    assert hits >= .9 * sum(t for t, _ in held) and sum(p for _, p in held) <= hits + 3


def test_held_out_labels_are_never_read(spark, scored):
    docs, labels, _, made = scored
    other = [(i, q, 1 - t if made[i].held_out else t) for i, q, t in labels]
    again = toxicity.classify(fx.frame(spark, docs).repartition(4), spark.createDataFrame(other, "doc_id long, quality int, toxic int")).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({i: r.score for i, r in made.items()})


def test_defined_cases(spark):
    schema = "doc_id long, toxic int"
    docs = fx.frame(spark, fx.rows())
    none = toxicity.classify(docs, spark.createDataFrame([], schema)).collect()
    assert len(none) == len(fx.rows()) and {r.predicted for r in none} == {0} and all(r.score < .5 for r in none)
    only = toxicity.classify(docs, spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], schema)).collect()
    assert all(r.score > .5 for r in only if r.doc_id is not None)
    assert toxicity.classify(fx.frame(spark, []), spark.createDataFrame([(1, 1), (2, 0)], schema)).count() == 0
    nulls = [r for r in none if r.doc_id is None]
    assert len(nulls) == 2 and not any(r.held_out for r in nulls)


def test_features_and_rows():
    column = pa.array(["Idiot idiot schöne###Ende 12", None, "", "idi"])
    bounds, buckets, counts = toxicity.text_buckets(column)
    assert np.diff(bounds).tolist() == [9, 0, 0, 1] and counts.max() == 2
    chosen = np.array(sorted(buckets[:3]))
    rows = toxicity.features_of(column, chosen)
    assert np.diff(rows.bounds).tolist() == [3, 0, 0, 0] and np.linalg.norm(rows.values) <= 1 + 1e-9
    assert rows.take(np.array([0, 2, 0])).times(np.ones(3)).tolist() == pytest.approx([rows.values.sum(), 0, rows.values.sum()])


def test_negative_risk_steps_back():
    """Positives that the unlabelled lack: the plain estimator would run away, this one stays finite."""
    one = toxicity.Rows(np.arange(9), np.zeros(8, np.int64), np.ones(8))
    other = toxicity.Rows(np.arange(33), np.ones(32, np.int64), np.ones(32))
    made = toxicity.fit(one, other, 2, 0.3, steps=400)
    assert np.isfinite(made.weights).all() and made.score(one)[0] > made.score(other)[0]
