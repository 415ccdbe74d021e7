r"""Hard negatives of anchor rows, from a secondary-sort shuffle of scored pairs.

Method. Components become whole numbers floor(256 * x); a row's score is its inner product with the anchor, exact. An anchor's
positives are its first rows of the same label by (score descending, id); each positive with score p opens the window
of negatives (rows of another label) whose score lies in [0.5 p, 0.95 p]. Scored pairs are packed into byte keys
(anchor, descending score, kind, id) that sort as they should, and repartitionAndSortWithinPartitions deals them by anchor
and sorts them in the shuffle: a streaming iterator meets an anchor's positives, opens their windows, and
emits the first negatives of each as they come. It holds one anchor's open windows and no rows. Positives stand
before negatives of the same score, since the window of a positive with score 0 holds score 0 alone.

Scale. All rows are scored against blocks of at most `anchors_together` anchors (the stated query set; a block is
collected and broadcast, the next one after it), by numpy in slices of rows. A task keeps, of the rows it has read, only
those that can be among an anchor's first positives, and then, the positives being known, among a window's first negatives;
so the shuffle moves at most positives * (1 + negatives) pairs per anchor and task, not all pairs.

Cases. Rows with a null id, label or vector, or with a component that is null or not finite (also when multiplied by
256) take no part. Repeated rows are rows of their own: one may be the other's positive; ties of score and id go by their order in
the table. Missing components of a shorter vector count as 0. Scores beyond a long are held at its ends. Fewer rows than asked for
give what there is; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # percent of the positive's score
TOGETHER = 8192
_CELLS = 1 << 21  # scores computed at once
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_KEY = np.dtype([("anchor", ">u8"), ("own", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8"), ("row", ">u8")])
_PAIR = "key binary"


@dataclass
class Anchors:
    """A block of anchors; with positives known, the range of scores that each one's windows allow."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


class First:
    """The first k candidates of each of n groups, by (score descending, id, row), of all that add() is given."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, _LEAST, np.int64)  # the score of a group's k-th
        self.held = [np.zeros(0, np.int64) for _ in range(4)]  # group, score, id, row

    def add(self, *found: np.ndarray) -> None:
        group, score, ids, rows = (np.concatenate(x) for x in zip(self.held, found, strict=True))
        order = np.lexsort((rows, ids, ~score, group))  # ~ turns the order of whole numbers around
        group = group[order]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        kept = place < self.k
        order = order[kept]
        self.held = [group[kept], score[order], ids[order], rows[order]]
        full = place[kept] == self.k - 1
        self.floor[self.held[0][full]] = self.held[1][full]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, held at the ends of a long."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(d, 1) < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a).astype(object) @ whole(b).astype(object).T, _LEAST, _MOST).astype(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors as rows of a matrix of whole numbers (as doubles), shorter ones with zeros at their ends."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(256 * flat)
    return out


def _packed(anchors: Anchors, kind: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Keys that sort as (anchor, descending score, kind, id, row)."""
    out = np.zeros(len(group), _KEY)
    unsigned = lambda x: x.view(np.uint64) ^ np.uint64(1 << 63)  # noqa: E731  keeps the order
    out["anchor"], out["own"], out["score"], out["kind"] = unsigned(anchors.ids[group]), anchors.rows[group], unsigned(~score), kind
    out["id"], out["row"] = unsigned(ids), rows
    at = np.arange(len(group) + 1, dtype=np.int32) * _KEY.itemsize
    return pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), len(group), [None, pa.py_buffer(at), pa.py_buffer(out.tobytes())])], ["key"])


def pairs(rows: DataFrame, anchors: Anchors, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Packed keys of what the tasks can't rule out: first positives, or where windows are known their first negatives."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        windows = 0 if a.low is None else a.low.shape[1]
        first = First(len(a.rows) * max(windows, 1), negatives if windows else positives)
        for batch in batches:
            step = max(16, _CELLS // max(len(a.rows), 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                row, ids, labels = (part.column(c).to_numpy() for c in ("row", "id", "label"))
                score = inner(a.vectors, matrix(part.column("vector")))
                same = a.labels[:, None] == labels
                if not windows:
                    i, j = np.nonzero(same & (a.rows[:, None] != row) & (score >= first.floor[:, None]))
                    first.add(i, score[i, j], ids[j], row[j])
                for w in range(windows):
                    own = np.arange(len(a.rows)) * windows + w
                    least = np.maximum(a.low[:, w], first.floor[own])
                    i, j = np.nonzero(~same & (score >= least[:, None]) & (score <= a.high[:, w, None]))
                    if len(i):
                        first.add(own[i], score[i, j], ids[j], row[j])
        group, score, ids, found = first.held
        if windows:  # a row may stand in several windows of its anchor: its pair is one
            every = np.unique(np.stack((group // windows, score, ids, found), axis=1), axis=0)
            group, score, ids, found = every.T.copy()
        for at in range(0, len(group), 1 << 16):
            yield _packed(a, int(windows > 0), *(x[at : at + (1 << 16)] for x in (group, score, ids, found)))

    return rows.mapInArrow(run, _PAIR)


def unpacked(key: bytes) -> tuple[int, int, int, int, int, int]:
    """(anchor's id, anchor's row, score, kind, id, row)."""
    anchor, own, score, kind, i, row = np.frombuffer(key, _KEY)[0].tolist()
    return anchor - (1 << 63), own, ~(score - (1 << 63)), kind, i - (1 << 63), row


def sorted_pairs(keys: DataFrame):
    """The pairs dealt by anchor and sorted by key, as an RDD whose partitions are streams."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.rdd.map(lambda r: (bytes(r.key), None)).repartitionAndSortWithinPartitions(n, lambda key: zlib.crc32(key[:16]) % n).map(lambda x: unpacked(x[0]))


def first_positives(stream: Iterator[tuple], k: int) -> Iterator[tuple]:
    """(anchor's row, score, id, row) of each anchor's first k pairs."""
    own, n = None, 0
    for _, at, score, _, i, row in stream:
        own, n = (own, n + 1) if at == own else (at, 1)
        if n <= k:
            yield at, score, i, row


def bounds(score: int) -> tuple[int, int]:
    """The whole numbers s with LOW * score <= 100 * s <= HIGH * score."""
    return -((-LOW * score) // 100), HIGH * score // 100


def open_windows(stream: Iterator[tuple], k: int) -> Iterator[tuple]:
    """Reads pairs in their order; each positive opens a window, each negative goes to the windows that it fits and that are not full."""
    own, windows = None, []
    for anchor, at, score, kind, i, _ in stream:
        if at != own:
            own, windows = at, []
        if not kind:
            windows.append([i, score, *bounds(score), 0])
            continue
        for w in windows:
            if w[4] < k and w[2] <= score <= w[3]:
                w[4] += 1
                yield anchor, w[0], w[4], i, w[1], score


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _block(rows: DataFrame, chosen: DataFrame, positives: int, negatives: int) -> DataFrame:
    spark = rows.sparkSession
    told = chosen.select("row", "id", "label", "vector").orderBy("row").toArrow().combine_chunks()  # at most anchors_together rows
    column = lambda c: told.column(c).combine_chunks().to_numpy() if told.num_rows else np.zeros(0, np.int64)
    vectors = matrix(told.column("vector").combine_chunks()) if told.num_rows else np.zeros((0, 0))
    anchors = Anchors(column("row"), column("id"), column("label"), vectors)
    first = sorted_pairs(pairs(rows, anchors, positives)).mapPartitions(lambda s: first_positives(s, positives)).collect()
    place = {r: k for k, r in enumerate(anchors.rows.tolist())}
    low, high = np.full((len(place), positives), 1), np.zeros((len(place), positives), np.int64)
    filled = [0] * len(place)
    found = [(place[own], score, i, row) for own, score, i, row in first]
    for k, score, _, _ in found:
        low[k, filled[k]], high[k, filled[k]] = bounds(score)
        filled[k] += 1
    windowed = Anchors(anchors.rows, anchors.ids, anchors.labels, anchors.vectors, low, high)
    of = np.array(found, np.int64).reshape(-1, 4).T.copy()
    opened = _packed(anchors, 0, *of).column("key").to_pylist()
    every = pairs(rows, windowed, positives, negatives).unionByName(spark.createDataFrame([(bytearray(x),) for x in opened], _PAIR))
    mined = sorted_pairs(every).mapPartitions(lambda s: open_windows(s, negatives))
    return spark.createDataFrame(mined, _RESULT, verifySchema=False)


def mine_negatives(
    table: DataFrame,
    is_anchor: str,
    label: str = "label",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    anchors_together: int = TOGETHER,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); is_anchor and label are SQL over the table's columns."""
    spark = table.sparkSession
    usable = F.expr(f"not exists({vector_col}, x -> x is null or isnan(x) or abs(256 * cast(x as double)) = double('Infinity'))")
    named = table.select(F.col(id_col).cast("long").alias("id"), F.expr(label).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.expr(is_anchor).alias("is_anchor"), usable.alias("usable"))
    rows = cut(named.where("id is not null and label is not null and vector is not null and usable").drop("usable").withColumn("row", F.monotonically_increasing_id()))
    chosen = rows.where("is_anchor")
    n = chosen.count()
    if n <= anchors_together:
        return _block(rows, chosen, positives, negatives)
    blocks = -(-n // anchors_together) * 5 // 4 + 1  # dealt by hash, a block holds fewer than the bound
    dealt = chosen.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return reduce(DataFrame.unionByName, [cut(_block(rows, dealt.where(F.col("block") == b), positives, negatives)) for b in range(blocks)])


#: The contract's relabelling and anchors.
LABEL = "if(vec_id % 7 = 0, (label + 1) % 10, label)"
ANCHOR = "vec_id % 50 = 0"


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_negatives(read_table(spark, sf_dir, "embeddings"), ANCHOR, LABEL)


ORACLE_SQL = """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.id % 50 = 0 AND a.id <> b.id
), positives AS (
  SELECT anchor_id, id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""
