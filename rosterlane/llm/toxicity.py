r"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Method. A proportional-odds model: P(grade > k) = sigmoid(w . x - b_k) with one weight vector shared by the ordered
thresholds b_0 < b_1 < b_2. Features are the distinct words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (A-Z lower-cased) of the
whole text that stand in toxic training rows clearly more often than in others. The output is the probability of each grade, the
expected severity (sum of k * P(grade = k)) and a verdict: rejected if toxic (grade 1 or more) is likelier than not.

Training. Labels are 0/1; grades of toxic rows come from the text: with s the number of words whose log odds between
toxic and other rows exceed 2 (and that stand in at least 5 toxic rows), grade 1 is s below 4, grade 2 below 8 and
grade 3 from 8 on. Rows labelled toxic without a single informative word carry no evidence a text model could use;
they stay in training as grade 1. Word counts and the rows' features are computed by Spark over at most `max_rows` labelled
rows (those with the least hash of their id, ties by id and label: a stable, documented bound); the fit is full-batch gradient
descent on the driver over the distinct (grade, features) of that sample.

Scale. Scoring is one pass over whole texts without a shuffle; what is broadcast is the model, a hash and a weight for each word
of the sample that marks toxic rows. Training joins labels with documents by id and reads only the bounded sample, so what the
driver holds is bounded by max_rows.

Cases. Null or wordless text has no feature: the model's intercepts grade it, which is grade 0. Labels of absent documents are
ignored; a document with several labels counts each. Without both classes among the labels (an empty table, too) nothing is
rejected (severity 0). Extra columns are kept by keep_clean() and ignored by grade().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches
from .words import ALNUM, words_of

MAX_ROWS = 20_000
GRADES = 4
_STRONG = 2.0
_LEAST_ROWS = 5


@dataclass
class Model:
    hashes: np.ndarray  # of the words, sorted
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, GRADES - 1

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score."""
        over = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        edges = np.hstack([np.ones((len(score), 1)), over, np.zeros((len(score), 1))])
        return edges[:, :-1] - edges[:, 1:]


def row_features(column: pa.Array, known: np.ndarray) -> list[np.ndarray]:
    """For each row, the numbers in known (sorted hashes) of its distinct words."""
    w = words_of(column, ALNUM, True)
    hashes = w.hashes()
    at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
    hit = np.flatnonzero(known[at] == hashes) if len(known) else np.zeros(0, np.int64)
    rows = np.searchsorted(w.first, hit, "right") - 1
    cuts = np.searchsorted(rows, np.arange(len(column) + 1))
    return [np.unique(at[hit[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _distinct_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    w = words_of(batch.column("text"), ALNUM, True)
    hashes = w.hashes()
    sets = [np.unique(hashes[a:b]) for a, b in zip(w.first, w.first[1:], strict=False)]
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))], ["toxic", "words"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, steps: int = 120) -> Model:
    """The model of at most max_rows labelled rows."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("toxic")).where("__id is not null and toxic is not null")
    bounded = known.orderBy(F.xxhash64("__id"), "__id", "toxic").limit(max_rows)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(F.broadcast(bounded), "__id").select("toxic", "text")  # at most max_rows rows of two numbers
    sample = cut(map_batches(rows, _distinct_words, "toxic int, words array<long>"))
    n, n_toxic = sample.agg(F.count("*"), F.count_if(F.col("toxic") > 0)).first()
    if not n_toxic or n_toxic == n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.array([10.0, 11.0, 12.0]))
    seen = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("toxic") <= 0).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (n - n_toxic - F.col("c") + 0.5))
    # How far the two shares differ for their sampling error: what is left of rare words by chance stays below 5.
    share = (F.col("t") + F.col("c")) / n
    z = F.abs(F.col("t") / n_toxic - F.col("c") / (n - n_toxic)) / F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / (n - n_toxic)) + 1e-12)
    picked = seen.where(F.col("t") + F.col("c") >= _LEAST_ROWS).select("word", odds.alias("odds"), z.alias("z"), "t").where("z > 5 and odds > 0")
    words = picked.orderBy("word").toPandas()
    hashes = words["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    strong = ((words["odds"] > _STRONG) & (words["t"] >= _LEAST_ROWS)).to_numpy()[order]
    return _descend(sample, hashes[order], strong, n, steps)


def _descend(sample: DataFrame, hashes: np.ndarray, strong: np.ndarray, n: int, steps: int) -> Model:
    """Nesterov gradient descent on the ordinal log-likelihood with a small ridge.

    Rows with the same features and grade are one row with a count, summed by Spark, so the iterations run over the distinct feature sets
    of the bounded sample.
    """
    known = hashes

    def feature_rows(batches):
        for batch in batches:
            out, grades = [], []
            for toxic, x in zip(batch.column("toxic").to_pylist(), batch.column("words"), strict=True):
                values = x.values.to_numpy().view(np.uint64)
                at = np.flatnonzero(np.isin(known, values, assume_unique=True))
                s = int(strong[at].sum())
                grades.append(0 if toxic <= 0 else 1 if s < 4 else 2 if s < 8 else 3)
                out.append(at.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(grades, pa.int32()), pa.array(out, pa.list_(pa.int32()))], ["grade", "at"])

    rows = sample.mapInArrow(feature_rows, "grade int, at array<int>").groupBy("grade", "at").agg(F.count("*").alias("k")).toPandas()
    grade, count = rows["grade"].to_numpy(), rows["k"].to_numpy(float)
    lengths = rows["at"].map(len).to_numpy()
    row = np.repeat(np.arange(len(rows)), lengths)
    col = np.concatenate([np.asarray(a, np.int64) for a in rows["at"]]) if lengths.sum() else np.zeros(0, np.int64)
    m, cuts = len(hashes), GRADES - 1
    weights, base = np.zeros(m), np.array([2.0, 3.0, 4.0])
    speed_w, speed_b = np.zeros(m), np.zeros(cuts)
    norm = np.zeros(m) + 1.0
    np.add.at(norm, col, count[row] / 1.0)
    for _ in range(steps):
        w, b = weights + 0.9 * speed_w, base + 0.9 * speed_b
        score = np.bincount(row, w[col], len(rows)) if len(col) else np.zeros(len(rows))
        over = 1 / (1 + np.exp(np.clip(b[None, :] - score[:, None], -40, 40)))
        edges = np.hstack([np.ones((len(rows), 1)), over, np.zeros((len(rows), 1))])
        slope = np.hstack([np.zeros((len(rows), 1)), over * (1 - over), np.zeros((len(rows), 1))])
        r = np.arange(len(rows))
        p = np.maximum(edges[r, grade] - edges[r, grade + 1], 1e-9)
        by_score = count * (slope[r, grade] - slope[r, grade + 1]) / p
        grad_w = np.bincount(col, by_score[row], m) - 0.05 * w if len(col) else -0.05 * w
        grad_b = np.zeros(cuts)
        for k in range(cuts):
            upper, lower = grade == k + 1, grade == k  # b_k is the lower edge of grade k + 1 and the upper edge of grade k
            grad_b[k] = (-(count * slope[:, k + 1] / p)[upper].sum()) + (count * slope[:, k + 1] / p)[lower].sum()
        speed_w = 0.9 * speed_w + 0.5 * np.clip(grad_w / norm, -1, 1)
        speed_b = 0.9 * speed_b + 0.5 * np.clip(grad_b / n * 4, -1, 1)
        weights, base = weights + speed_w, np.maximum.accumulate(base + speed_b + 1e-3 * np.arange(cuts))
    return Model(hashes, weights, base)


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, p_toxic, p_grades, rejected) for each row of docs."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *_graded(batch.column("text"), sent.value)], ["doc_id", "severity", "p_toxic", "p_grades", "rejected"])

    return map_batches(base, run, "doc_id long, severity double, p_toxic double, p_grades array<double>, rejected boolean")


def _graded(column: pa.Array, model: Model) -> list[pa.Array]:
    score = np.array([model.weights[x].sum() for x in row_features(column, model.hashes)])
    p = model.probabilities(score)
    return [pa.array(p @ np.arange(GRADES)), pa.array(1 - p[:, 0]), pa.array(list(p), pa.list_(pa.float64())), pa.array(p[:, 0] < 0.5)]


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rejected = _graded(batch.column(text_col), sent.value)[3]
        return batch.filter(pa.array(~np.asarray(rejected.to_numpy(zero_copy_only=False), bool)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, run, schema, text_col)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents")
    return grade(docs, fit(docs, read_table(spark, sf_dir, "labels")))
