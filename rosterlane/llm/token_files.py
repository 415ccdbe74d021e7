r"""Token-ID output as wavelet matrices: one compressed file per range of documents, readable token by token.

Method. Documents are range-partitioned by their order and encoded; each task cuts its tokens into shards and
writes, for each, a wavelet matrix: one bit-plane per bit of the largest id, from the highest, each stably partitioning
the tokens by that bit, with the count of ones before every 512 bits. Access, counting of an id in a range
(rank) and lookup of its k-th occurrence (select) read only those planes. A shard also holds its documents' ids
and lengths. The files are Parquet (zstd) in a folder all executors share, written by Spark's own writer.

Scale. One shuffle of the texts, by range; a shard holds about 2 million tokens (a longer document makes its own
larger shard), built and read within one task. A document's start is its place in the shard plus the tokens of the
shards before, a running sum over two levels (per partition of 1,000 shards, then over those sums).

Cases. Null and empty texts have only the end id. Null ids come first; rows that share an id follow each other, in the
order of their texts. A token folder of no documents reads as no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, slices
from .tokens import encoder, laid_out, tokenizer_file

SHARD_TOKENS = 2 << 20
BLOCK = 512
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_DDL = "shard long, n long, doc_ids array<long>, lengths array<long>, zeros array<long>, planes array<binary>, ranks array<binary>"


class WaveletMatrix:
    """Bit-planes with rank and select over the ids of one shard."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = 16) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"an id needs more than {bits} bit-planes")
        zeros, planes, ranks, at = [], [], [], ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for b in range(bits - 1, -1, -1):
            ones = (at & at.dtype.type(1 << b)) != 0
            packed = np.packbits(ones, bitorder="little")
            per = np.add.reduceat(_POP[packed], np.arange(0, len(packed), BLOCK // 8), dtype=np.uint32) if len(packed) else np.zeros(0, np.uint32)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate((np.zeros(1, np.uint32), np.cumsum(per, dtype=np.uint32))).tobytes())
            low = np.compress(~ones, at)
            zeros.append(len(low))
            at = np.concatenate((low, np.compress(ones, at)))
        return cls(len(ids), zeros, planes, ranks)

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        block = i // BLOCK
        ones = int(self.ranks[level][block]) + int(_POP[self.planes[level][block * BLOCK // 8 : i >> 3]].sum())
        return ones + (int(_POP[self.planes[level][i >> 3] & ((1 << (i & 7)) - 1)]) if i & 7 else 0)

    def access(self, i: int) -> int:
        out = 0
        for level, zeros in enumerate(self.zeros):
            one = self.bit(level, i)
            ones = self.rank1(level, i)
            i = zeros + ones if one else i - ones
            out = out << 1 | one
        return out

    def count(self, token: int, start: int, end: int) -> int:
        """Occurrences of token in [start, end)."""
        return self._range(token, start, end)[1] - self._range(token, start, end)[0]

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> len(self.zeros):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self.rank1(level, start), self.rank1(level, end)
            start, end = (zeros + a, zeros + b) if token >> (len(self.zeros) - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of token, or -1."""
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            return -1
        at = low + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = token >> (len(self.zeros) - 1 - level) & 1
            at = self._select(level, at - self.zeros[level] if one else at, one)
        return at

    def _select(self, level: int, k: int, one: int) -> int:
        """The place of the k-th bit of a level that equals one."""
        ranks = self.ranks[level].astype(np.int64)
        seen = ranks if one else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(seen, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(seen[block])])

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: each level's order is undone by its bits."""
        ids = np.zeros(self.n, dtype=np.uint32 if len(self.zeros) > 16 else np.uint16)
        for level in range(len(self.zeros) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(ids)
            above[np.flatnonzero(~ones)] = ids[: self.zeros[level]]
            above[np.flatnonzero(ones)] = ids[self.zeros[level] :] | ids.dtype.type(1 << (len(self.zeros) - 1 - level))
            ids = above
        return ids


def encode_rows(data: str, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of the texts, each with the end id."""
    e = encoder(data)
    rows, distinct, which, first = e.pretokens(texts)
    flat, low, length = e.ids_of(distinct.to_numpy(zero_copy_only=False).tolist())
    others = sorted(set(range(len(texts))) - set(rows))
    whole = dict(zip(others, e.encode([texts[i] for i in others]), strict=True))
    return laid_out(flat, low[which], length[which], first, rows, whole, len(texts), end_id)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, order: list[Column], id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the token files of docs, in the given order, to path."""
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        data = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(data)
    bits = max(end_id, *Tokenizer.from_str(data).get_vocab(with_added_tokens=True).values()).bit_length()

    def run(batches):
        number, ids, lengths, names = TaskContext.get().partitionId() << 32, [], [], []

        def shard():
            w = WaveletMatrix.build(np.concatenate(ids), bits)
            of = pa.array([names], pa.list_(pa.int64()))
            binaries = lambda x: pa.array([[v.tobytes() for v in x]], pa.list_(pa.binary()))
            longs = lambda x: pa.array([x], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([w.n], pa.int64()), of, longs(np.concatenate(lengths)), longs(w.zeros), binaries(w.planes), binaries(w.ranks)],
                ["shard", "n", "doc_ids", "lengths", "zeros", "planes", "ranks"],
            )

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                new, sizes = encode_rows(sent.value, ["" if t is None else t for t in part.column("text").to_pylist()], end_id)
                ids.append(new)
                lengths.append(sizes)
                names += part.column("doc_id").to_pylist()
                if sum(map(len, ids)) >= shard_tokens:
                    yield shard()
                    number, ids, lengths, names = number + 1, [], [], []
        if names:
            yield shard()

    keys = [f"__k{i}" for i in range(len(order))]
    placed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[o.alias(k) for o, k in zip(order, keys, strict=True)])
    ranged = placed.repartitionByRange(*keys, F.substring("text", 1, 64)).sortWithinPartitions(*keys, "text")  # rows that share a key part by how they begin
    ranged.select("doc_id", "text").mapInArrow(run, _DDL).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files at path."""
    shards = spark.read.schema(_DDL).parquet(path)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids = _matrix(one).decode().astype("<u4")
                names, lengths = one.column("doc_ids")[0].values, one.column("lengths")[0].values.to_numpy(zero_copy_only=False)
                at = np.concatenate(([0], np.cumsum(lengths))).tolist()
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([names, pa.array([one.column("shard")[0].as_py()] * len(names), pa.int64()), pa.array(at[:-1], pa.int64()), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "shard", "local", "n_tokens", "ids_crc32"])

    read = shards.mapInArrow(run, "doc_id long, shard long, local long, n_tokens long, ids_crc32 long")
    return read.join(shard_starts(shards), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(shard, base): the tokens before each shard, summed by group of partitions first so that no task sees all shards."""
    sizes = shards.select("shard", "n", F.expr("shard >> 42").alias("grp"))
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("grp").agg(F.sum("n").alias("total")).select("grp", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("left"))
    inside = Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(groups, "grp").select("shard", (F.col("left") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("base"))


def _matrix(one: pa.RecordBatch) -> WaveletMatrix:
    return WaveletMatrix(one.column("n")[0].as_py(), one.column("zeros")[0].as_py(), one.column("planes")[0].as_py(), one.column("ranks")[0].as_py())


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(shard, count) of an id, by rank on the bit-planes alone."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                w = _matrix(batch.slice(row, 1))
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(row, 1), pa.array([w.count(token, 0, w.n)], pa.int64())], ["shard", "count"])

    return spark.read.schema(_DDL).parquet(path).select("shard", "n", "zeros", "planes", "ranks").mapInArrow(run, "shard long, count long")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, place): where an id stands in its documents, by select on the bit-planes."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                w = _matrix(one)
                at = np.array([w.select(token, k) for k in range(w.count(token, 0, w.n))], dtype=np.int64)
                first = np.concatenate(([0], np.cumsum(one.column("lengths")[0].values.to_numpy(zero_copy_only=False))))
                of = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([one.column("doc_ids")[0].values.take(pa.array(of)), pa.array(at - first[of])], ["doc_id", "place"])

    return spark.read.schema(_DDL).parquet(path).mapInArrow(run, "doc_id long, place long")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    path = scratch(spark)
    write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), [F.col("doc_id")])
    return read_tokens(spark, path)
