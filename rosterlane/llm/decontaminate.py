r"""Benchmark decontamination: find the n-grams of test items in training text and take out spans or documents.

Method. Items and documents are lower-cased (A-Z) and cut into words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`. The
benchmark's 13-word windows (the whole item where it is shorter) are hashed into a set that is broadcast; each
executor hashes the windows of its documents, looks them up and verifies every hit on the words themselves.

Scale. One pass over the documents without a shuffle. The broadcast is bounded: a benchmark whose text exceeds
`block_bytes` or whose words exceed `block_windows` is cut into blocks of about half those bounds, by a hash of its items,
the documents are scanned once per block, the partial hits are written, and all meet by document. A block is its text and arrays of
24 bytes a window; the driver and the executors hold one at a time. Memory per task is a slice of 1 MB of text.

Cases. Null or wordless text has no words, no hits and stays. Items that are null, wordless or have no id are
ignored; repeated items and repeated ids count once. Rows of documents are judged one by one, so repeated rows
and repeated ids each get their own result. Result columns of decontaminate() replace columns of the same name; uncontaminated()
returns its input's columns as they are.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .words import ALNUM, words_of

WINDOW = 13
BLOCK_BYTES = 64 << 20
BLOCK_WINDOWS = 4 << 20
_SLICE = 1 << 20


class _Index:
    """Windows of one block of the benchmark: by length, sorted hashes with their items and places in the block's words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.names)}
        raw, starts, ends, n_raw, n_words = [], [], [], 0, 0
        by_length: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        for part in _sliced(items):
            w = words_of(pa.array([text for _, text in part], pa.string()), ALNUM, True)
            hashes, counts = w.hashes(), np.minimum(np.diff(w.first), window)
            of = np.array([number[item] for item, _ in part], np.int32)
            for n in np.unique(counts[counts > 0]).tolist():
                at, h = w.windows(hashes, n)
                row = np.searchsorted(w.first, at, "right") - 1
                own = counts[row] == n
                by_length[n].append((h[own], of[row[own]], _narrow(at[own] + n_words)))
            raw.append(w.raw)
            starts.append(_narrow(w.starts + n_raw))
            ends.append(_narrow(w.ends + n_raw))
            n_raw, n_words = n_raw + len(w.raw), n_words + len(w.starts)
        self.raw, self.starts, self.ends = (np.concatenate(x) if x else np.zeros(0, np.uint8) for x in (raw, starts, ends))
        self.hashes, self.of, self.places, self.coarse = {}, {}, {}, {}
        for n, found in by_length.items():
            h, of, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((of, h))
            h, of, at = h[order], of[order], at[order]
            alike = np.flatnonzero((h[1:] == h[:-1]) & (of[1:] == of[:-1])) + 1  # an item's phrase once
            keep = np.ones(len(h), dtype=bool)
            keep[[k for k in alike.tolist() if _phrase(self, at[k], n) == _phrase(self, at[k - 1], n)]] = False
            self.hashes[n], self.of[n], self.places[n] = h[keep], of[keep], at[keep]
            self.coarse[n] = np.zeros(1 << 22, dtype=bool)  # a bit table that turns nearly all windows away
            self.coarse[n][(self.hashes[n] >> np.uint64(42)).astype(np.int64)] = True

    def items(self, phrase: bytes, h: np.uint64, n: int) -> set[str]:
        """The items that hold the n words of phrase, whose hash is h."""
        low, high = np.searchsorted(self.hashes[n], h, "left"), np.searchsorted(self.hashes[n], h, "right")
        return {self.names[self.of[n][k]] for k in range(low, high) if _phrase(self, self.places[n][k], n) == phrase}


def _sliced(items: list[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    """items in runs of about _SLICE characters, so that hashing one needs little memory."""
    part, size = [], 0
    for item in items:
        part.append(item)
        size += len(item[1])
        if size >= _SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if not len(x) or x[-1] < 1 << 31 else x


def _phrase(w, i: int, n: int) -> bytes:
    return b" ".join(w.raw[s:e].tobytes() for s, e in zip(w.starts[i : i + n], w.ends[i : i + n], strict=True))


def _find(column: pa.Array, index: _Index) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """For each row: its number of words, the verified hits as [first word, last word), and the items."""
    w = words_of(column, ALNUM, True)
    hashes = w.hashes()
    hits: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
    items: list[set[str]] = [set() for _ in range(len(column))]
    met: dict[bytes, set[str]] = {}  # a phrase in many of these texts is looked up once
    for n, known in index.hashes.items():
        at, h = w.windows(hashes, n)
        near = index.coarse[n][(h >> np.uint64(42)).astype(np.int64)]
        at, h = at[near], h[near]
        hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        at, h = at[hit], h[hit]
        for i, row, value in zip(at.tolist(), (np.searchsorted(w.first, at, "right") - 1).tolist(), h, strict=True):
            phrase = _phrase(w, i, n)
            if (of := met.get(phrase)) is None:
                of = met[phrase] = index.items(phrase, value, n)
            if of:
                first = int(w.first[row])
                hits[row].append((i - first, i - first + n))
                items[row] |= of
    return np.diff(w.first).tolist(), hits, items


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_COLUMNS = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "clean_text": pa.string()}
_DDL = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, clean_text string"
_PARTS = "array<struct<s: int, e: int>>"


def _verdict(column: pa.Array, counts, hits, items, share: int, clean: bool) -> list[pa.Array]:
    out: dict[str, list] = {k: [] for k in _COLUMNS}
    w = words_of(column, ALNUM, True) if clean and any(hits) else None
    for row, (n, spans, of) in enumerate(zip(counts, map(_union, hits), items, strict=True)):
        n_hit = sum(e - s for s, e in spans)
        out["n_words"].append(n)
        out["n_hit"].append(n_hit)
        out["n_items"].append(len(of))
        out["items_sha256"].append(hashlib.sha256(",".join(sorted(of)).encode()).hexdigest())
        out["contaminated"].append(n_hit > 0 and share * n_hit >= n)
        text = column[row].as_py() if clean else None
        if spans and clean:
            raw, first, low = text.encode(), int(w.first[row]), int(w.docs[row])
            kept, at = [], 0
            for s, e in spans:
                kept.append(raw[at : int(w.starts[first + s]) - low])
                at = int(w.ends[first + e - 1]) - low
            text = b"".join([*kept, raw[at:]]).decode()
        out["clean_text"].append(text)
    return [pa.array(v, _COLUMNS[k]) for k, v in out.items()]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, block_windows: int = BLOCK_WINDOWS) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """The number of the benchmark's blocks, and the blocks, each collected when it is asked for."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    words = F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = rows.select(F.sum(F.octet_length("t")), F.sum(words)).first()
    n = max(-(-(total[0] or 0) // block_bytes), -(-(total[1] or 0) // block_windows), 1)
    if n == 1:
        return 1, ([(r.i, r.t) for r in rows.collect()] for _ in range(1))
    spread = rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(2 * n)))
    return 2 * n, ([(r.i, r.t) for r in spread.where(F.col("b") == k).collect()] for k in range(2 * n))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: int = 20,
    block_bytes: int = BLOCK_BYTES,
    clean: bool = True,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and (if clean) clean_text, the text without the hit spans.

    A document is contaminated if it has a hit and share * n_hit >= n_words.
    """
    spark = docs.sparkSession
    n_blocks, blocks = benchmark_blocks(benchmark, item_id, item_text, block_bytes, block_windows)
    names = set(_COLUMNS) - (set() if clean else {"clean_text"})
    keep = [c for c in docs.columns if c.lower() not in names]
    base = docs.select(*[F.col(f"`{c}`") for c in keep]) if text_col in keep else docs
    ddl = _DDL if clean else _DDL.rpartition(",")[0]
    schema = f"{_ddl_of(base)}, {ddl}"
    if n_blocks == 1:
        index = spark.sparkContext.broadcast(_Index(next(blocks), window))

        def run(batches):
            for batch in batches:
                for part in slices(batch, text_col, 1 << 20):
                    column = part.column(text_col)
                    extra = _verdict(column, *_find(column, index.value), share, clean)
                    extra = extra if clean else extra[:-1]
                    yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*part.schema.names, *list(_COLUMNS)[: len(extra)]])

        return base.mapInArrow(run, schema)

    # Larger: one scan per block; the partial hits of a text meet again by its digest.
    keyed = base.withColumn("__k", F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))
    parts = None
    for block in blocks:
        index = spark.sparkContext.broadcast(_Index(block, window))

        def find(batches, index=index):
            for batch in batches:
                for part in slices(batch, "t", 1 << 20):
                    _, hits, items = _find(part.column("t"), index.value)
                    at = [i for i, h in enumerate(hits) if h]
                    if at:
                        spans = pa.array([[{"s": s, "e": e} for s, e in _union(hits[i])] for i in at], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
                        yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(at)), spans, pa.array([sorted(items[i]) for i in at], pa.list_(pa.string()))], ["k", "spans", "items"])

        found = keyed.select(F.col("__k").alias("k"), F.col(f"`{text_col}`").alias("t")).mapInArrow(find, f"k string, spans {_PARTS}, items array<string>")
        found = cut(found)  # now: the next block takes this one's place
        index.destroy()
        parts = found if parts is None else parts.unionByName(found)
    met = parts.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("__spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("__items"))
    joined = keyed.join(met.withColumnRenamed("k", "__k"), "__k", "left").drop("__k")

    columns = base.columns

    def judge(batches):
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                column = part.column(text_col)
                counts = np.diff(words_of(column, ALNUM, True).first).tolist()
                hits = [[(x["s"], x["e"]) for x in v or ()] for v in part.column("__spans").to_pylist()]
                items = [set(v or ()) for v in part.column("__items").to_pylist()]
                extra = _verdict(column, counts, hits, items, share, clean)
                extra = extra if clean else extra[:-1]
                own = part.select(columns)
                yield pa.RecordBatch.from_arrays([*own.columns, *extra], [*columns, *list(_COLUMNS)[: len(extra)]])

    return joined.mapInArrow(judge, schema)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs whatever their names."""
    own = [f"__own{i}" for i in range(len(docs.columns))]
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own, strict=True)])
    found = decontaminate(renamed, benchmark, text_col=own[docs.columns.index(text_col)], clean=False, **options)
    return found.where(~F.col("contaminated")).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, own, strict=True)])


def _ddl_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, read_table(spark, sf_dir, "benchmark"), clean=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
