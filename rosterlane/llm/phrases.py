r"""Collocations by dynamic itemset counting over cyclic shards of the corpus.

Method. The rows are dealt into shards, which are scanned in turn, again and again. Words count from the first step on. A longer phrase
is activated as soon as both of its subphrases (without its last and without its first word) have reached the threshold, is then
counted for one full cycle, so once in each shard, and leaves. Lengths interleave: while words are still counted in later shards, pairs
of words frequent so far are counted already, and triples of those. The scans end when nothing is left to count.

What a scan must know of a phrase is the step from which it counts. A table of cells holds, at two places that the hash of a
subphrase gives, the step by which it had reached the threshold; the later of the two is an estimate that is never too
late, and a phrase begins at the later estimate of its subphrases. Cells are set once and never changed, so all scans agree on
that step, and a phrase that a collision lets in early is counted for one cycle like any other: counts are exact whatever the
table's size, which bounds what is broadcast. Within a slice of texts, words and phrases are told apart by their bytes and places, not by
hashes; between slices by 128 bits of hash under a key drawn for the run (two multilinear hashes of a word's bytes, each chained over the words), so no text
can be made to collide. A last scan tells the words of the phrases that have passed.

Candidates (`support` or more) get the lowest score of their cuts, those that a longer candidate explains are dropped, and the rest is ranked per language.

Scale. The words are told apart once: each slice of texts is written, by shard, as its distinct words and the places' numbers, and scans read those. A scan
sends a row per counted phrase and slice, and one shuffle adds these to the counts of its shard, which are written once and not carried from step to step. A phrase of
`support` occurrences in a cycle has at least support / shards of them in one shard; only such phrases' counts of the other shards are added up at the end of
their cycle, found by a bitmap of cells. Until then the counts of such shards alone can make a phrase frequent earlier. Newly frequent phrases come to the driver as
bitmaps of cells (one bit each); a step's counts go when their cycle is over. Names are looked for in one shard, then for what is left in the next.
Ranks are found in two levels, so a hot language is not one task's.

Cases. A null text has no words; a null language is `und` (and one with the rows that say so). Repeated rows count repeatedly. An
empty table gives no rows; extra columns are ignored; a very long text is a slice of its own. Scores are exact: products are decimals of 38 digits.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, read_table, scratch, shuffles_removed, slices
from .words import Words, mix, spans_hashed, words_of

SUPPORT = 30
LONGEST = 4
SHARDS = 4
CELLS = 1 << 24
TOP = 2000
EXPLAINED = 80  # percent
SCALE = 2_000_000
_NEVER = 255
_BITMAP = 8 * 4096
_BYTES = np.arange(256)
_BREAK = np.isin(_BYTES, [*map(ord, ".,;:!?"), *range(0x0A, 0x0E)])
_WORD = ~(_BREAK | np.isin(_BYTES, [0x20, 0x09]))


def adjacent(w: Words) -> np.ndarray:
    """For each word, whether the next one follows in the same piece of the same row."""
    if not len(w.starts):
        return np.zeros(0, bool)
    breaks = np.concatenate(([0], np.cumsum(_BREAK[w.raw])))[w.starts] + w.row_of()
    return np.append(breaks[1:] == breaks[:-1], False)


def steps_of(h: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The step from which phrases of these hashes count as frequent."""
    last = np.uint64(len(cells) - 1)
    return np.maximum(cells[h & last], cells[(h >> np.uint64(32)) & last]).astype(np.int64)


@dataclass
class Slice:
    """Texts as numbers: 0 is a break between pieces or rows, i is word i - 1 of those given by their bytes and language; the last number is 0."""

    codes: np.ndarray
    raw: np.ndarray
    at: np.ndarray  # word i has bytes at[i]:at[i + 1]
    lang: np.ndarray  # of each word, as a number of names
    names: list[str]

    def words(self) -> Words:
        """The numbers as words; a break is an empty one."""
        starts, ends = (np.concatenate(([0], x)) for x in (self.at[:-1], self.at[1:]))
        return Words(self.raw, np.zeros(1, np.int64), starts[self.codes], ends[self.codes], np.zeros(1, np.int64))


def slice_of(w: Words, lang: np.ndarray, names: list[str]) -> Slice:
    """lang numbers the rows' names. Words are told apart by their bytes."""
    which, distinct = w.coded()
    word = which * len(names) + lang[w.row_of()]  # a word of a language
    there = np.zeros(len(distinct) * len(names), bool)
    there[word] = True
    told = np.flatnonzero(there)
    ended = np.cumsum(~adjacent(w))
    codes = np.zeros(len(word) + int(ended[-1]) if len(word) else 0, np.int64)
    codes[np.arange(len(word)) + np.concatenate(([0], ended))[: len(word)]] = np.cumsum(there)[word]
    strings = distinct.take(pa.array(told // max(len(names), 1)))
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if len(told) else np.zeros(0, np.uint8)
    return Slice(codes, raw, at - at[0], told % max(len(names), 1), names)


@dataclass
class Found:
    """Distinct phrases of k words of a slice: the first word's place, two hashes, language, the step from which they count, and how often they occur."""

    k: int
    place: np.ndarray
    a: np.ndarray
    b: np.ndarray
    lang: np.ndarray
    start: np.ndarray
    n: np.ndarray


def scan(s: Slice, cells: np.ndarray, key: int, step: int, shards: int, longest: int = LONGEST, wanted: np.ndarray | None = None) -> list[Found]:
    """What a slice holds, by length: the phrases that count in this step, or those that wanted has."""
    if not len(s.codes):
        return []
    tagged = [f".{n}".encode() for n in s.names]
    sizes = np.array([len(n) for n in tagged], np.int64)
    ends = np.cumsum(sizes)
    tags = np.frombuffer(b"".join(tagged), np.uint8), ends - sizes, ends
    single, lang_hash = [], []
    for i in (0, 1):
        lang_hash.append(mix(spans_hashed(*tags, key + i + 2)))
        single.append(np.concatenate(([np.uint64(0)], mix(mix(spans_hashed(s.raw, s.at[:-1], s.at[1:], key + i)) ^ lang_hash[i][s.lang]))))
    of = np.concatenate(([0], s.lang))
    n = np.bincount(s.codes, minlength=len(of))
    n[0] = 0
    zeros = lambda like: np.zeros(len(like), np.int64)
    out = []
    if wanted is not None or step < shards:  # a row for all words of each language
        every = np.arange(len(s.names))
        out.append(Found(0, zeros(every), *lang_hash, every, zeros(every), np.bincount(of, n, len(every)).astype(np.int64)))
    # by distinct phrase: a place, two hashes, the step from which it counts, how often; by place: the number of its phrase
    one, (a, b), begin = zeros(of), single, zeros(of)
    one[s.codes] = np.arange(len(s.codes))
    places, rank = np.arange(len(s.codes)), s.codes
    for k in range(1, longest + 1):
        if k > 1:
            frequent = np.maximum(steps_of(a, cells), begin)  # not before its own start
            if k == 2:
                frequent[0] = _NEVER  # a break
            reached = np.full(len(s.codes), _NEVER, np.int64)
            reached[places] = frequent[rank]
            both = np.maximum(reached[:-1], reached[1:])
            fits = np.flatnonzero(both <= step)
            if not len(fits):
                break
            number = np.zeros(len(s.codes), np.int64)
            number[places] = rank
            before, places, last = number[fits], fits, s.codes[fits + k - 1]
            told = pa.array(before * len(of) + last).dictionary_encode()  # before < the slice's words
            rank = told.indices.to_numpy()
            one = np.zeros(len(told.dictionary), np.int64)
            one[rank] = np.arange(len(rank))
            shorter, ending = before[one], last[one]
            a, b = (mix(h[shorter] * np.uint64(0xD1342543DE82EF95) + w[ending]) for h, w in zip((a, b), single, strict=True))
            one = places[one]
            begin, n = both[one], np.bincount(rank)
        counted = np.flatnonzero((begin + shards > step if wanted is None else steps_of(a, wanted) < _NEVER) & (n > 0))
        if len(counted):
            at = one[counted]
            out.append(Found(k, at, a[counted], b[counted], of[s.codes[at]], begin[counted], n[counted]))
    return out


def phrase_strings(w: Words, first: np.ndarray, k: int) -> pa.Array:
    """The phrases of k words from these places on, joined by spaces."""
    word = (first[:, None] + np.arange(k)).reshape(-1)
    sizes = w.ends[word] - w.starts[word]
    spaced = sizes + (np.arange(len(word)) % k < k - 1)
    before = np.concatenate(([0], np.cumsum(spaced)))
    raw = np.full(int(before[-1]), 0x20, np.uint8)
    inner = np.arange(len(raw)) - np.repeat(before[:-1], spaced)
    inside = inner < np.repeat(sizes, spaced)
    raw[inside] = w.raw[(inner + np.repeat(w.starts[word], spaced))[inside]]
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(before[::k].astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


@lru_cache(maxsize=2)
def _opened(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


_SLICES = "shard int, names array<string>, codes binary, sizes binary, lang binary, words binary"
_COUNTED = "a long, b long, tag int, n long"
_NAMED = "a long, b long, lang string, phrase string"
_PARTS = "a long, b long, k int, n long"


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers below 2**31 by their bytes' places, so that the high ones pack well."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _whole(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1).astype(np.int64)


def _coded(texts: DataFrame) -> DataFrame:
    """Slices of at most 2 MB (a longer text is a slice of its own) of a partition's rows (shard, lang, text), each of one shard."""

    def row(shard: int, part: pa.RecordBatch) -> pa.RecordBatch:
        langs = part.column("lang").dictionary_encode()
        s = slice_of(words_of(part.column("text"), _WORD, True), langs.indices.to_numpy().astype(np.int64), langs.dictionary.to_pylist())
        columns = [pa.array([shard], pa.int32()), pa.array([s.names], pa.list_(pa.string()))]
        told = [_planes(s.codes), _planes(np.diff(s.at)), _planes(s.lang), s.raw.tobytes()]
        return pa.RecordBatch.from_arrays(columns + [pa.array([x], pa.binary()) for x in told], ["shard", "names", "codes", "sizes", "lang", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, pa.RecordBatch] = {}
        for batch in batches:
            for shard in batch.column("shard").unique().to_pylist():
                own = batch.filter(pc.equal(batch.column("shard"), shard))
                *full, waiting[shard] = slices(pa.concat_batches([waiting.pop(shard), own]) if shard in waiting else own, "text", 2 << 20)
                for part in full:
                    yield row(shard, part)
        for shard, part in waiting.items():
            yield row(shard, part)

    return texts.mapInArrow(run, _SLICES)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        for names, *told in zip(*(batch.column(c) for c in ("names", "codes", "sizes", "lang", "words")), strict=True):
            codes, sizes, lang, words = (x.as_buffer() for x in told)
            yield Slice(_whole(codes), np.frombuffer(words, np.uint8), np.concatenate(([0], np.cumsum(_whole(sizes)))), _whole(lang), names.as_py())


def _counted(shard: DataFrame, sent: Broadcast, key: int, step: int, shards: int, longest: int) -> DataFrame:
    """(a, b, tag, n): what the slices of a shard count in a step; tag is 256 * k + start, sent holds the packed cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _told(batches):
            for f in scan(s, _opened(sent.value), key, step, shards, longest):
                columns = [f.a.view(np.int64), f.b.view(np.int64), (f.k * 256 + f.start).astype(np.int32), f.n]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "tag", "n"])

    return shard.drop("shard").mapInArrow(run, _COUNTED)


def _named(texts: DataFrame, sent: Broadcast, wanted: Broadcast, key: int, longest: int) -> DataFrame:
    """(a, b, lang, phrase) of the phrases whose cells wanted holds; those of no words are the languages.

    A task remembers the last phrase of each of 2**20 cells and does not tell it again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros((2, 1 << 20), np.uint64)
        for s in _told(batches):
            w = s.words()
            for f in scan(s, _opened(sent.value), key, _NEVER - 1, 0, longest, _opened(wanted.value)):
                cell = f.a & np.uint64(told.shape[1] - 1)
                new = np.flatnonzero((told[0, cell] != f.a) | (told[1, cell] != f.b))
                told[0, cell[new]], told[1, cell[new]] = f.a[new], f.b[new]
                if len(new):
                    strings = phrase_strings(w, f.place[new], f.k) if f.k else pa.array([""] * len(new), pa.string())
                    langs = pa.array(s.names, pa.string()).take(pa.array(f.lang[new]))
                    yield pa.RecordBatch.from_arrays([pa.array(f.a[new].view(np.int64)), pa.array(f.b[new].view(np.int64)), langs, strings], ["a", "b", "lang", "phrase"])

    return texts.drop("shard").mapInArrow(run, _NAMED)


def _among(counts: DataFrame, sent: Broadcast) -> DataFrame:
    """The counts whose cells sent holds, and those of no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = steps_of(batch.column("a").to_numpy().view(np.uint64), _opened(sent.value)) < _NEVER
            kept = batch.filter(pa.array(held | (batch.column("k").to_numpy() == 0)))
            if kept.num_rows:
                yield kept

    return counts.select("a", "b", "k", "n").mapInArrow(run, _PARTS)


def cells_of(frequent: DataFrame, n_cells: int) -> np.ndarray:
    """The cells of phrases (a), brought to the driver as bitmaps."""
    cell = F.explode(F.array(F.col("a").bitwiseAND(n_cells - 1), F.shiftrightunsigned("a", 32).bitwiseAND(n_cells - 1))).alias("cell")
    one = F.col("cell") + 1  # Spark's bitmaps count from 1
    maps = frequent.select(cell).groupBy(F.bitmap_bucket_number(one).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits")).collect()
    found = [(r.b - 1) * _BITMAP + np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")) for r in maps]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def count_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS, n_cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, n) of all phrases with `support` or more occurrences, (lang, n) of all words)."""
    spark = docs.sparkSession
    path = scratch(spark)
    row = F.monotonically_increasing_id()  # in the order of a partition's rows: neighbours go to different shards
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang")
    texts = docs.select(lang, F.col(f"`{text_col}`").alias("text")).where("text is not null").withColumn("shard", F.pmod(row, F.lit(shards)).cast("int"))
    with shuffles_removed(spark):
        _coded(texts).write.partitionBy("shard").parquet(path)
    every = spark.read.schema(_SLICES).parquet(path)

    packed = lambda x: spark.sparkContext.broadcast(zlib.compress(x.tobytes(), 1))
    union = lambda x: reduce(DataFrame.unionByName, x)

    def holding(found: np.ndarray) -> Broadcast:
        held = np.full(n_cells, _NEVER, np.uint8)
        held[found] = 0
        return packed(held)

    key = secrets.randbits(64)
    cells = np.full(n_cells, _NEVER, np.uint8)
    share = -(-support // shards)  # a phrase of `support` occurrences has as many in one shard
    step, latest, tables, high, done = 0, 0, [], [], []
    while step < latest + shards:
        sent = packed(cells)
        new = _counted(every.where(F.col("shard") == step % shards), sent, key, step, shards, longest).groupBy("a", "b").agg(F.max("tag").alias("tag"), F.sum("n").alias("n"))
        tables.append(cut(new.select("a", "b", F.shiftright("tag", 8).alias("k"), F.col("tag").bitwiseAND(255).alias("start"), "n")))
        sent.destroy()  # the counts are written
        first = step + 1 - shards
        high.append(cut(tables[-1].where((F.col("n") >= share) & (F.col("k") > 0)).select("a", "b", "k", F.col("start").alias("since"), "n")))
        many = union(high)
        reached = many.where((F.col("since") > first) & (F.col("k") < longest)).groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
        found = cells_of(reached, n_cells)
        if first >= 0:
            among = cells_of(many.where(F.col("since") == first), n_cells)
            if first == 0 or len(among):
                sent = holding(among)
                over = _among(union(tables).where(F.col("start") == first), sent).groupBy("a", "b").agg(F.max("k").alias("k"), F.sum("n").alias("n"))
                done.append(cut(over.where((F.col("n") >= support) | (F.col("k") == 0))))
                sent.destroy()
                found = np.concatenate((found, cells_of(done[-1].where(F.col("k").between(1, longest - 1)), n_cells)))
            discard(tables.pop(0))
            discard(high.pop(0))
        found = found[cells[found] == _NEVER]
        if len(found):
            latest = step + 1
            cells[found] = latest
        step += 1
    for table in [*tables, *high]:
        discard(table)
    whole = cut(union(done))
    sent, missing, names = packed(cells), whole, []
    for shard in range(shards):
        asked = holding(cells_of(missing, n_cells))
        named = _named(every.where(F.col("shard") == shard), sent, asked, key, longest).groupBy("a", "b").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))
        names.append(cut(missing.join(named, ["a", "b"])))
        asked.destroy()
        missing = cut(missing.join(names[-1], ["a", "b"], "left_anti"))
        if missing.isEmpty():
            break
    sent.destroy()
    told = union(names)
    return told.where("k > 0").select("lang", "phrase", "k", "n"), told.where("k = 0").select("lang", "n")


def _part(first: str, last: str) -> str:
    return f"array_join(slice(words, {first}, {last}), ' ')"


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, k, a, cut, l, r, score) of the phrases of two words or more: their lowest-scoring cut."""
    long = counts.where("k > 1").withColumnRenamed("n", "a").withColumn("words", F.split("phrase", " ", -1))
    cuts = long.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": F.expr(_part("1", "cut")), "right": F.expr(_part("cut + 1", "k - cut"))})
    part = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "k", "words")).alias("best"))
    return best.select("lang", "phrase", "best.*")


def unexplained(candidates: DataFrame, percent: int = EXPLAINED) -> DataFrame:
    """candidates without those that lie in a longer one which has at least that share of their occurrences."""
    inner = F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), i -> array_join(slice(words, i, s), ' '))))")
    longer = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda x: F.col(x).cast("decimal(20,0)")
    explained = F.lit(100) * wide("longer") >= F.lit(percent) * wide("a")
    return candidates.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(explained, F.lit(False))).drop("longer")


def collocations(docs: DataFrame, top: int = TOP, lang_col: str = "lang", text_col: str = "text", **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` of each language by score, a, phrase."""
    counts, totals = count_phrases(docs, lang_col, text_col, **options)
    kept = unexplained(cut(scored(counts)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    few = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", rank("lang", "part")).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
  FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
), cuts AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words, unnest(range(1, k)) AS c FROM counts WHERE k > 1 AND f >= 30
), scores AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, cuts.words, a, x.f AS l, y.f AS r,
    CAST(CAST(2000000 AS HUGEINT) * a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score, c
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.words[1:c], ' ')
  JOIN counts y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.words[c + 1:cuts.k], ' ')
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inner_parts AS (
  SELECT lang, a, unnest(list_transform(range(1, k - s + 2), lambda i: array_to_string(words[i:i + s - 1], ' '))) AS phrase
  FROM best, (SELECT unnest([2, 3]) AS s) WHERE s < k
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM inner_parts GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase
  WHERE coalesce(100 * CAST(longer.a AS HUGEINT) < 80 * CAST(best.a AS HUGEINT), true)
)
SELECT kept.lang, row_number() OVER w AS rank, kept.phrase, kept.a, kept.l, kept.r, totals.n, kept.score
FROM kept JOIN totals ON totals.lang = kept.lang
WINDOW w AS (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER w <= 2000
"""
