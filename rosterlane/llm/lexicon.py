r"""BPE encoding and decoding with a lexicon of frequent words: a minimal acyclic transducer from words to token ids.

Method. The corpus's pre-tokens are counted, and the most frequent ones compiled, with the ids the library gives them,
into a minimal acyclic automaton: words that end alike share their last states. Its arcs carry outputs that add up
along a word's path to the word's number, under which its ids are filed. The compiled file lies in the shared folder;
Spark brings it to each executor once, and all workers of a machine map the same pages. A batch's distinct
pre-tokens walk the automaton together, byte by byte; those it does not hold are merged exactly by the library, each once per
worker while it is remembered. Texts whose pre-tokens cannot be told for sure (see tokens.py) go to the library whole.
Decoding joins the bytes of the ids and reads them as UTF-8, with U+FFFD for what is not.

Scale. One pass counts pre-tokens (a row for each distinct one of a slice, summed by the shuffle), one pass encodes.
The lexicon holds at most `size` words of at most `_LONGEST` bytes, chosen by a histogram of counts, so what the driver
compiles and the executors map is bounded whatever the corpus holds; it decides speed only, never results.

Cases. A null text counts as the empty one: no ids, "" decoded. Ids outside the vocabulary decode to nothing, as in the library; null ids
too. Repeated rows are encoded row by row; an empty table gives no rows; extra columns are ignored; a very long text is a
batch of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_batches, read_table, scratch
from .tokens import Encoder, byte_letters, encoder, laid_out, tokenizer_file

SIZE = 60_000
_LONGEST = 64
_STEPS = 8  # buckets of counts to a doubling


def automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], list[int]]:
    """(arcs, final, order) of the minimal acyclic automaton of sorted distinct words; state 0 is the first, order lists states after those they lead to.

    Words come in order, so what lies below the part that the next word shares can't change: it is merged with an equal state or kept.
    """
    arcs, final, kept, order, path, last = [{}], [False], {}, [], [0], b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            same = kept.setdefault((final[state], tuple(arcs[state].items())), state)
            arcs[path[-1]][last[len(path) - 1]] = same
            if same == state:
                order.append(state)

    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        close(shared)
        for byte in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    close(0)
    return arcs, final, [*order, 0]


def compiled(words: dict[bytes, list[int]]) -> bytes:
    """The lexicon's file: a line that tells its arrays, then the arrays."""
    listed = sorted(words)
    arcs, final, order = automaton(listed)
    number = {s: i for i, s in enumerate(reversed(order))}  # the first state is 0
    below: dict[int, int] = {}  # words that can be finished from a state
    keys, targets, outputs = [], [], []
    for state in order:
        passed = int(final[state])
        for byte, target in arcs[state].items():
            keys.append(number[state] << 8 | byte)
            targets.append(number[target])
            outputs.append(passed)
            passed += below[target]
        below[state] = passed
    by_key = np.argsort(np.array(keys, np.int64), kind="stable")
    ends = np.zeros(len(order), np.uint8)
    ends[[number[s] for s in order if final[s]]] = 1
    arrays = {
        "keys": np.array(keys, np.int64)[by_key],
        "targets": np.array(targets, np.int32)[by_key],
        "outputs": np.array(outputs, np.int32)[by_key],
        "final": ends,
        "low": np.cumsum([0, *(len(words[w]) for w in listed)], dtype=np.int64),
        "ids": np.array([i for w in listed for i in words[w]], np.uint32),
    }
    head = json.dumps([[k, str(a.dtype), len(a)] for k, a in arrays.items()]).encode()
    return _aligned(head + b" " * (-(len(head) + 1) % 8) + b"\n") + b"".join(_aligned(a.tobytes()) for a in arrays.values())


def _aligned(x: bytes) -> bytes:
    return x + bytes(-len(x) % 8)


class Lexicon:
    """The compiled file, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.readline()
        data, at = np.memmap(path, np.uint8, "r"), len(head)
        for name, kind, n in json.loads(head):
            size = np.dtype(kind).itemsize * n
            setattr(self, name, np.frombuffer(data[at : at + size], kind))
            at += size + -size % 8

    def find(self, strings: pa.LargeStringArray) -> np.ndarray:
        """The number of each string, -1 where the lexicon does not hold it."""
        _, offsets, data = strings.buffers()
        at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        out = np.full(len(strings), -1, np.int64)
        live, here, ends = np.arange(len(strings)), at[:-1], at[1:]
        state, total = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)
        while len(live):
            over = here == ends
            done = over & (self.final[state] != 0)
            out[live[done]] = total[done]
            live, here, ends, state, total = (x[~over] for x in (live, here, ends, state, total))
            if not len(self.keys):
                break
            key = state << 8 | raw[here]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = self.keys[arc] == key
            arc = arc[goes]
            live, here, ends, state, total = live[goes], here[goes] + 1, ends[goes], self.targets[arc].astype(np.int64), total[goes] + self.outputs[arc]
        return out


@lru_cache(maxsize=1)
def _mapped(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def shared_file(spark: SparkSession, data: bytes) -> str:
    """Writes data to a file in the shared folder, which Spark brings to each executor once (also to later ones); its name, for SparkFiles.get()."""
    path = scratch(spark)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def word_counts(docs: DataFrame, data: str, text_col: str = "text") -> DataFrame:
    """(word, n): the pre-tokens of all texts, and how often each occurs."""
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, distinct, which, _ = encoder(sent.value).pretokens(["" if t is None else t for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([distinct.cast(pa.string()), pa.array(np.bincount(which, minlength=len(distinct)))], ["word", "n"])

    texts = docs.select(F.col(f"`{text_col}`").alias("text")).where("text is not null")
    return map_batches(texts, run, "word string, n long", most_bytes=2 << 20).groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, size: int) -> list[str]:
    """The words of the highest counts: as many whole buckets of counts as hold at most `size` words."""
    bucket = F.floor(F.log2("n") * _STEPS).cast("int")
    fit = cut(counts.where(F.octet_length("word").between(1, _LONGEST)).withColumn("bucket", bucket))
    room, least = size, None
    for r in fit.groupBy("bucket").count().orderBy(F.desc("bucket")).collect():  # some hundred rows at most
        if r["count"] > room:
            break
        room, least = room - r["count"], r["bucket"]
    return [] if least is None else [r.word for r in fit.where(F.col("bucket") >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, tokenizer_path: str, text_col: str = "text", size: int = SIZE) -> str:
    """Compiles the frequent words of docs for a tokenizer; the name of the file that encode() takes."""
    with open(tokenizer_path, encoding="utf-8") as f:
        data = f.read()
    words = frequent_words(word_counts(docs, data, text_col), size)
    ids, lengths = Encoder(data).merge(words) if words else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    parts = np.split(ids, np.cumsum(lengths)[:-1]) if words else []
    return shared_file(docs.sparkSession, compiled({w.encode(): p.tolist() for w, p in zip(words, parts, strict=True)}))


def encode_texts(e: Encoder, lexicon: Lexicon, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of the texts."""
    rows, distinct, which, first = e.pretokens(texts)
    number = lexicon.find(distinct)
    unseen = np.flatnonzero(number < 0)
    flat, low, length = e.ids_of(distinct.take(pa.array(unseen)).to_numpy(zero_copy_only=False).tolist())
    every = np.concatenate((lexicon.ids, flat))
    held = number >= 0
    begin, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    begin[held], size[held] = lexicon.low[number[held]], np.diff(lexicon.low)[number[held]]
    begin[unseen], size[unseen] = low + len(lexicon.ids), length
    others = sorted(set(range(len(texts))) - set(rows))
    whole = dict(zip(others, e.encode([texts[i] for i in others]), strict=True))
    return laid_out(every, begin[which], size[which], first, rows, whole, len(texts))


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values.view(np.int32)))


def encode(docs: DataFrame, tokenizer_path: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row of docs, as the library encodes without special tokens added."""
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, lengths = encode_texts(encoder(sent.value), _mapped(lexicon), ["" if t is None else t for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids, lengths)], ["doc_id", "ids"])

    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_batches(base, run, "doc_id long, ids array<int>")


def token_bytes(data: str) -> tuple[np.ndarray, np.ndarray]:
    """(raw, low): id i stands for raw[low[i]:low[i + 1]]."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_str(data).get_vocab(with_added_tokens=True)
    back = {c: b for b, c in byte_letters().items()}
    told = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        told[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return np.frombuffer(b"".join(told), np.uint8), np.cumsum([0, *map(len, told)])


def decode_ids(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The text of each run of ids."""
    raw, low = table
    ids = np.where((ids >= 0) & (ids < len(low) - 1), ids, -1)
    size = np.where(ids < 0, 0, low[ids + 1] - low[np.maximum(ids, 0)])
    total = np.concatenate(([0], np.cumsum(size)))
    joined = raw[np.repeat(low[np.maximum(ids, 0)] - total[:-1], size) + np.arange(total[-1])]
    at = total[np.concatenate(([0], np.cumsum(lengths)))]
    told = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(joined)])
    try:
        return told.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in told.to_pylist()], pa.string())


def decode(rows: DataFrame, tokenizer_path: str, together: int = 1 << 19) -> DataFrame:
    """rows (doc_id, ids) with their texts."""
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = rows.sparkSession.sparkContext.broadcast(token_bytes(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("ids").fill_null([]).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + together, "right")))
                part = batch.slice(first, last - first)
                ids = part.column("ids").fill_null([])
                sizes = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                told = decode_ids(sent.value, ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), told], ["doc_id", "ids", "text"])
                first = last

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op12_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")
    told = decode(encode(docs, path, build_lexicon(docs, path)), path)
    return told.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
