import math
import re

import numpy as np
import pyarrow as pa
from rosterlane.llm.common import read_table
from rosterlane.llm.toxicity import Model, fit, grade, keep_clean, op8_toxicity
from rosterlane.llm.words import ALNUM, words_of
from tests.llm import cases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = read_table(spark, DIR, "documents"), read_table(spark, DIR, "labels")
    model = fit(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in grade(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()}
    clean = [r for r in got.values() if not r.toxic]
    toxic = [r for r in got.values() if r.toxic]
    assert sum(r.rejected for r in clean) <= 0.002 * len(clean)
    # Rows labelled toxic whose text has none of the words that mark the others are beyond any text model.
    assert sum(r.rejected for r in toxic) >= 0.5 * len(toxic)
    strong = sorted(zip(model.weights.tolist(), model.hashes.tolist(), strict=True), reverse=True)[:10]
    assert strong[-1][0] > 0.5
    assert all(0 <= r.severity <= 3 and abs(sum(r.p_grades) - 1) < 1e-9 for r in got.values())
    grades = np.array([r.severity for r in toxic if r.rejected])
    assert grades.max() > grades.min() + 0.5


def test_query_scores_every_row_like_a_plain_scorer(spark, sf_dir):
    rows = {r.doc_id: r for r in op8_toxicity(spark, sf_dir).collect()}
    docs = cases.corpus(spark, sf_dir)
    assert sorted(rows) == sorted(i for i, _ in docs)
    model = fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    split = lambda t: set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD)))
    vocabulary = sorted(set().union(*(split(t) for _, t in docs)))
    hashes = words_of(pa.array(vocabulary), ALNUM, True).hashes().tolist()
    weight_of = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    weights = {w: weight_of[h] for w, h in zip(vocabulary, hashes, strict=True) if h in weight_of}
    assert len(weights) == len(model.hashes) > 0
    for i, t in docs:
        score = sum(weights.get(w, 0.0) for w in split(t))
        over = [1 / (1 + math.exp(b - score)) for b in model.thresholds]
        assert abs(rows[i].severity - sum(over)) < 1e-9 and abs(rows[i].p_toxic - over[0]) < 1e-9
        assert rows[i].rejected == (over[0] > 0.5)


def test_shared_weights_and_thresholds_order_grades():
    m = Model(np.zeros(0, np.uint64), np.zeros(0), np.array([0.0, 1.0, 2.0]))
    p = m.probabilities(np.array([-5.0, 0.5, 5.0]))
    assert (np.abs(p.sum(axis=1) - 1) < 1e-12).all() and (np.diff(p @ np.arange(4)) > 0).all()


def test_awkward_rows(spark):
    docs = [(i, "plain words here number " + str(i)) for i in range(60)] + [(100 + i, "you vile vile toad " + str(i)) for i in range(30)]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in docs] + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = fit(frame, labels)
    awkward = cases.frame(spark, ["severity", "p_toxic"])
    assert grade(awkward, model).count() == len(cases.rows())
    assert {r.doc_id for r in grade(frame, model).where("rejected").collect()} == {100 + i for i in range(30)}
    kept = keep_clean(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == len(cases.rows())
    assert grade(cases.empty(spark), model).count() == 0
    nothing = fit(frame, labels.where("toxic = 0"))
    assert grade(frame, nothing).where("rejected").count() == 0
    for few in (labels.limit(0), spark.createDataFrame([], "doc_id long, toxic int")):
        assert grade(frame, fit(frame, few)).where("severity > 0.001").count() == 0
    twice = fit(frame, labels.unionByName(labels), max_rows=50)  # ties at the bound: the same rows each time
    again = fit(frame, labels.unionByName(labels).repartition(7), max_rows=50)
    assert (twice.hashes == again.hashes).all() and np.allclose(twice.weights, again.weights)
