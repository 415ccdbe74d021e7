r"""Token counts with the whole-token shortcut, and the vectorised pre-tokeniser it shares with the token writer.

Method. The vocabulary's strings that encode alone as exactly themselves are proven once on the driver, by encoding
each. Texts are cut into pre-tokens for many texts at once over their code points; a pre-token among the proven
strings counts as one token without merging, and only the rest goes through the library's merges, each distinct
pre-token once per worker while it is remembered (a bounded memory that is emptied when full).

A text takes this way only where it is proven to agree with the library: all its code points have had one class
(letter, number, mark or sign) since an old Unicode version, it holds no special string, and its normal form is
plain lower case. Any other text is given to the library whole. Both ways cover whole texts.

Scale. One pass without a shuffle; what is broadcast is the tokenizer file (2 MB) and the proven strings of its vocabulary.

Cases. Null counts as the empty text: 0 bytes, 0 tokens. Repeated rows and ids are counted row by row; an empty table gives no
rows, extra columns are ignored, a very long text is a batch of its own.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches
from .words import text_bytes

LIMIT = 2048
_REMEMBERED = 1_000_000  # about 170 bytes each
_TOGETHER = 64
_OTHER, _LETTER, _NUMBER, _SPACE, _UNSURE = range(5)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point; unsure where Unicode versions or white-space rules may differ."""
    old, out = unicodedata.ucd_3_2_0, np.full(0x110000, _UNSURE, dtype=np.uint8)
    kind = lambda c: _LETTER if c[0] == "L" else _NUMBER if c[0] == "N" else _OTHER if c[0] in "MPS" else _UNSURE
    for cp in range(0x80, 0x30000):
        a = kind(unicodedata.category(chr(cp)))
        if a == kind(old.category(chr(cp))):
            out[cp] = a
    for cp in range(0x80):
        a = kind(unicodedata.category(chr(cp)))
        out[cp] = _OTHER if a == _UNSURE else a
    out[[0x20, *range(0x09, 0x0E)]] = _SPACE
    out[0x1C:0x20] = _UNSURE
    out[[0x130, 0x3A3]] = _UNSURE  # letters whose lower case has two characters or depends on their place
    return out


def boundaries(cps: np.ndarray, cls: np.ndarray, docs: np.ndarray, words_only: bool) -> np.ndarray:
    """Starts of the pre-tokens of texts cps[docs[i]:docs[i + 1]], whose code points are of these classes; they tile the texts.

    words_only: the rules of the word vocabulary (numbers stand alone, white space is its own token and to be
    dropped); else those of the byte vocabulary (a space joins what follows it).
    """
    n = len(cps)
    start = np.zeros(n + 1, dtype=bool)
    start[0] = start[docs] = True
    edge = start.copy()
    start[1:n] |= cls[1:] != cls[:-1]
    if words_only:
        start[:n] |= cls == _NUMBER
    runs = np.flatnonzero(start[:n])
    ends = np.append(runs[1:], n)
    kinds = cls[runs]
    inner = ~edge[ends]  # another run of the same text follows
    if not words_only:
        space = (kinds == _SPACE) & inner
        last = ends[space] - 1
        start[last] = True
        joined = ends[space][cps[last] == 0x20]
        start[joined] = False
    quote = np.flatnonzero((kinds == _OTHER) & (ends - runs == 1) & (cps[runs] == 0x27) & inner)
    quote = quote[start[runs[quote]]]  # not one that a space has joined
    quote = quote[kinds[np.minimum(quote + 1, len(kinds) - 1)] == _LETTER]
    if len(quote):
        at = runs[quote] + 1
        one, length = cps[at], ends[quote + 1] - at
        two = cps[np.minimum(at + 1, n - 1)]
        take = np.where(np.isin(one, [0x73, 0x74, 0x6D, 0x64]), 1, 0)
        pair = (length >= 2) & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C))
        take = np.where(pair, 2, take)
        at, take, length = at[take > 0], take[take > 0], length[take > 0]
        start[at] = False
        start[(at + take)[take < length]] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """One per worker process: the library's tokenizer, the proven strings, and what has been merged so far."""

    def __init__(self, data: str, whole: dict[str, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data)
        told = json.loads(data)
        self.words_only = told["normalizer"] is not None
        self.special = [t["content"] for t in told["added_tokens"]]
        self.whole = whole or {}
        self.forget()

    def encode(self, texts: list[str]) -> list[tuple[int, ...]]:
        return [tuple(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def merge(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the pre-tokens. Plain words are handed over many to a text, which the library parts again as it would each alone."""
        lead, gap = ("", " ") if self.words_only else (" ", "")
        words = [i for i, p in enumerate(pretokens) if p.startswith(lead) and p[len(lead) :].isalpha()]
        told = self.library.encode_batch([gap.join([pretokens[i] for i in words[k : k + _TOGETHER]]) for k in range(0, len(words), _TOGETHER)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in told), np.uint32)
        of = np.fromiter(chain.from_iterable(e.word_ids for e in told), np.int64)
        new = np.ones(len(of), bool)
        new[1:] = of[1:] != of[:-1]
        new[np.cumsum([len(e) for e in told])[:-1].astype(np.int64)] = True
        starts = np.append(np.flatnonzero(new), len(of))
        if len(starts) != len(words) + 1:  # never seen; then each alone
            words, ids, starts = [], ids[:0], np.zeros(1, np.int64)
        lengths = np.zeros(len(pretokens), np.int64)
        lengths[words] = np.diff(starts)
        alone = sorted(set(range(len(pretokens))) - set(words))
        others = self.encode([pretokens[i] for i in alone])
        lengths[alone] = [len(x) for x in others]
        out, mine = np.zeros(int(lengths.sum()), np.uint32), np.zeros(len(pretokens), bool)
        mine[words] = True
        body = np.repeat(mine, lengths)
        out[body] = ids
        out[~body] = np.fromiter(chain.from_iterable(others), np.uint32)
        return out, lengths

    def plain(self, texts: list[str]) -> tuple[list[int], str, np.ndarray, np.ndarray, np.ndarray]:
        """The rows that may take the fast way, their joined text, its code points and their classes, and the rows' offsets."""
        rows = [i for i, t in enumerate(texts) if not any(s in t for s in self.special) and (not self.words_only or t.isascii() or unicodedata.is_normalized("NFC", t))]
        while True:
            text = "".join([texts[i] for i in rows])
            cps = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            docs = np.concatenate(([0], np.cumsum([len(texts[i]) for i in rows], dtype=np.int64))).astype(np.int64)
            cls = classes()[cps]
            unsure = np.flatnonzero(cls == _UNSURE)
            if not len(unsure):
                break
            bad = set((np.searchsorted(docs, unsure, "right") - 1).tolist())
            rows = [r for k, r in enumerate(rows) if k not in bad]
        if self.words_only:
            text = text.lower()
            cps = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            cls = classes()[cps]
        return rows, text, cps, cls, docs

    def pretokens(self, texts: list[str]) -> tuple[list[int], pa.Array, np.ndarray, np.ndarray]:
        """(rows, distinct, which, first): rows[k] has pre-tokens first[k]:first[k + 1], and pre-token i is distinct[which[i]].

        Pre-tokens are told apart by their bytes, so two never count as one.
        """
        rows, text, cps, cls, docs = self.plain(texts)
        starts = boundaries(cps, cls, docs, self.words_only) if len(cps) else np.zeros(0, np.int64)
        raw = text.encode()
        at = np.append(starts, len(cps))
        if len(raw) != len(cps):
            at = np.concatenate(([0], np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000))))[at]
        tiles = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
        which, distinct = tiles.indices.to_numpy(), tiles.dictionary
        if self.words_only and len(starts):
            seen = cls[starts] != _SPACE
            starts, which = starts[seen], which[seen]
        return rows, distinct, which, np.searchsorted(starts, docs)

    def ids_of(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, low, length): pre-token k of these distinct ones has the ids flat[low[k]:low[k] + length[k]]."""
        if len(self.slot) + len(strings) > _REMEMBERED:
            self.forget()
        known = self.slot.get
        slot = np.array([known(s, -1) for s in strings], dtype=np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            missing = [strings[k] for k in new.tolist()]
            ids, lengths = self.merge(missing)
            slot[new] = len(self.low) - 1 + np.arange(len(new))
            self.slot.update(zip(missing, slot[new].tolist(), strict=True))
            self.low = np.append(self.low, self.low[-1] + np.cumsum(lengths))
            self.flat = np.append(self.flat, ids)
        return self.flat, self.low[slot], self.low[slot + 1] - self.low[slot]

    def forget(self) -> None:
        """The memory: a slot for each string, and per slot the place of its ids. The proven strings stay."""
        self.slot = dict(zip(self.whole, range(len(self.whole)), strict=True))
        self.low, self.flat = np.arange(len(self.whole) + 1), np.fromiter(self.whole.values(), np.uint32, len(self.whole))

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        rows, distinct, which, first = self.pretokens(texts)
        _, _, length = self.ids_of(distinct.to_numpy(zero_copy_only=False).tolist())
        each = length[which]
        total = np.concatenate(([0], np.cumsum(each)))
        out[rows] = total[first[1:]] - total[first[:-1]]
        others = sorted(set(range(len(texts))) - set(rows))
        for i, ids in zip(others, self.encode([texts[i] for i in others]), strict=True):
            out[i] = len(ids)
        return out


def laid_out(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray, rows: list[int], whole: dict[int, tuple[int, ...]], n: int, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of n texts. Text rows[k] has pre-tokens first[k]:first[k + 1], of which i stands for flat[begin[i]:begin[i] + size[i]]; the others are given whole. end follows each text.

    Between the pre-tokens each text gets a segment of its own, for its end and for what it is given whole, so one gather lays out all.
    """
    tail = int(end is not None)
    own = np.full(n, tail)
    for i, x in whole.items():
        own[i] += len(x)
    fast = np.zeros(n, np.int64)
    fast[rows] = 1
    after = first[np.cumsum(fast)]
    size, begin = np.insert(size, after, own), np.insert(begin, after, 0)
    ends = np.cumsum(size)
    every = np.repeat((begin - ends + size).astype(np.int32), size) + np.arange(ends[-1] if n else 0, dtype=np.int32)
    out = (flat if len(flat) else np.zeros(1, np.uint32)).take(every, mode="clip")
    closes = ends[after + np.arange(n)]
    if tail:
        out[closes - 1] = end
    for i, x in whole.items():
        out[closes[i] - tail - len(x) : closes[i] - tail] = x
    return out, np.diff(closes, prepend=0)


def whole_tokens(data: str) -> dict[str, int]:
    """The vocabulary's strings that, alone, are one pre-token and encode as one token, and that token: proven by encoding each."""
    from tokenizers import Tokenizer

    t, suffix = Tokenizer.from_str(data), json.loads(data)["model"]["end_of_word_suffix"] or ""
    back = {c: b for b, c in byte_letters().items()}
    strings = []
    for token, i in t.get_vocab(with_added_tokens=False).items():
        if token.endswith(suffix) and all(c in back for c in token.removesuffix(suffix)):
            try:
                strings.append((bytes(back[c] for c in token.removesuffix(suffix)).decode(), i))
            except UnicodeDecodeError:
                continue  # part of a character
    encoded = t.encode_batch_fast([s for s, _ in strings], add_special_tokens=False)
    return {s: i for (s, i), e in zip(strings, encoded, strict=True) if e.ids == [i]}


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_ENCODERS: dict[str, Encoder] = {}


def encoder(data: str, whole: dict[str, int] | None = None) -> Encoder:
    """This process's encoder for a tokenizer file's content."""
    if data not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[data] = Encoder(data, whole)
    return _ENCODERS[data]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs."""
    spark: SparkSession = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        data = f.read()
    sent = spark.sparkContext.broadcast((data, whole_tokens(data)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, at = text_bytes(batch.column("text"))
        n = encoder(*sent.value).counts(["" if t is None else t for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_batches(base, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
