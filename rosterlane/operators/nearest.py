"""The most alike reference text of each text, by address_similarity(), without comparing all pairs.

Candidates come from an inverted index. Its keys are the words of a text and each two that follow one another (a house number and its street, a city and its state);
keys that more than `most` reference texts hold (or a `share` of them, if that is more) tell nothing apart and are left out, so no key leads to more. A text without
a zip, or with a wrong one, so has the candidates that its street or city gives it. Where no key is left out, whoever shares a word is a candidate; a pair
that shares none scores at most 0.6.

Of the candidates only those are scored exactly that can win: a bound (the exact cosine of words; lengths and leading letters for Jaro-Winkler;
the lengths for Levenshtein) orders them, the one of the highest bound is scored, and of the rest those whose bound reaches that score. Letters in
common make the bound closer, but cost more than the scores that they save. Texts have numbers while they are paired, and their words are told apart once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlane.functions.similarity import address_similarity, token_cosine, tokens
from rosterlane.sources.shared import scratch

MOST = 200
SHARE = 1e-6
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _once(value: Column, body) -> Column:
    """body(value), where a value that is used often is computed once."""
    return F.transform(F.array(value), body)[0]


def keys_of(c: Column) -> Column:
    """The words of a text and each two that follow one another, each once."""

    def keys(words: Column) -> Column:
        pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w))
        return F.array_distinct(F.concat(words, pairs))

    return _once(tokens(c), keys)


def letters_of(c: Column) -> Column:
    """How often each letter and digit stands in a text, and how many other signs."""
    low = F.lower(c)
    counts = [F.length(low) - F.length(F.replace(low, F.lit(x), F.lit(""))) for x in _LETTERS]
    other = F.length(low) - sum(counts[1:], counts[0])
    return F.array(*counts, other)


def words_of(c: Column) -> Column:
    """struct(once, twice, most, norm): hashes of a text's words, of those found at least twice, the highest count, and the length of the vector of counts."""
    counted = lambda x: F.transform(F.array_distinct(x), lambda w: F.struct(F.xxhash64(w).alias("h"), F.size(F.filter(x, lambda v: v == w)).cast("double").alias("n")))
    told = lambda e: F.struct(
        F.transform(e, lambda w: w["h"]).alias("once"), F.transform(F.filter(e, lambda w: w["n"] > 1), lambda w: w["h"]).alias("twice"),
        F.coalesce(F.array_max(F.transform(e, lambda w: w["n"])), F.lit(0.0)).alias("most"), F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, w: s + w["n"] * w["n"])).alias("norm"),
    )
    return _once(tokens(c), lambda x: _once(counted(x), told))


def cosine(a: Column, b: Column, x: Column, y: Column) -> Column:
    """token_cosine() of two texts with their words_of(); equal hashes of unequal words can make it larger, never less."""
    same = lambda p, q: F.size(F.array_intersect(x[p], y[q]))
    dot = same("once", "once") + same("twice", "once") + same("once", "twice") + same("twice", "twice")
    plain = F.when((x["norm"] > 0) & (y["norm"] > 0), dot / (x["norm"] * y["norm"])).otherwise(0.0)
    return F.when((x["most"] <= 2) & (y["most"] <= 2), plain).otherwise(token_cosine(a, b))


def bound(a: Column, b: Column, letters_a: Column | None = None, letters_b: Column | None = None, alike: Column | None = None) -> Column:
    """No less than address_similarity() of two texts that are not empty. alike: their cosine, if it is known; without letters, all of the shorter text's count as shared."""
    low_a, low_b = F.lower(a), F.lower(b)
    n, m = F.length(low_a).cast("double"), F.length(low_b).cast("double")
    shared = F.least(n, m) if letters_a is None else F.aggregate(F.zip_with(letters_a, letters_b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    jaro = (shared / n + shared / m + 1) / 3
    leading = F.lit(0)
    for k in range(4, 0, -1):
        leading = F.when((F.least(n, m) >= k) & (F.substring(low_a, 1, k) == F.substring(low_b, 1, k)) & (leading == 0), k).otherwise(leading)
    winkler = F.least(F.lit(1.0), jaro + 0.1 * leading * F.greatest(F.lit(0.0), 1 - jaro))
    return 0.40 * (token_cosine(a, b) if alike is None else alike) + 0.45 * winkler + 0.15 * (1 - F.abs(n - m) / F.greatest(n, m))


def _kept(df: DataFrame) -> DataFrame:
    """df, written once and read back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def candidates(asked: DataFrame, known: DataFrame, most: int = MOST, share: float = SHARE) -> DataFrame:
    """(a, b, ref, cosine, bound): distinct texts a of asked with those b of known that share a key; ref is the least of b's."""
    refs = _kept(known.where("length(b) > 0").groupBy("b").agg(F.min("ref").alias("ref")).select(F.monotonically_increasing_id().alias("bid"), "b", "ref", words_of(F.col("b")).alias("y")))
    texts = _kept(asked.where("length(a) > 0").select("a").distinct().select(F.monotonically_increasing_id().alias("aid"), "a", words_of(F.col("a")).alias("x")))
    index = refs.select("bid", F.explode(keys_of(F.col("b"))).alias("key"))
    limit = max(most, int(share * refs.count()))
    held = index.groupBy("key").agg(F.count("*").alias("df")).where(F.col("df") <= limit).select("key")
    met = texts.select("aid", F.explode(keys_of(F.col("a"))).alias("key")).join(index.join(held, "key"), "key").select("aid", "bid")
    pairs = met.repartition("bid").distinct().join(refs, "bid").join(texts, "aid")
    told = pairs.select("a", "b", "ref", cosine(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("cosine"))
    return told.select("*", bound(F.col("a"), F.col("b"), alike=F.col("cosine")).alias("bound"))


def nearest(asked: DataFrame, known: DataFrame, most: int = MOST, share: float = SHARE) -> DataFrame:
    """(id, ref, score) of asked (id, a): the candidate of known (ref, b) with the highest score, rounded to 9 places, the least ref on ties; ids without a candidate are left out."""
    found = _kept(candidates(asked, known, most, share))
    scored = lambda pairs: address_similarity(_kept(pairs), "a", "b", "score").withColumn("score", F.round("score", 9))
    first = scored(found.groupBy("a").agg(F.max_by(F.struct("b", "ref"), F.struct("bound", "ref")).alias("m")).select("a", "m.*")).select("a", F.col("score").alias("reached"))
    rest = scored(found.join(first, "a").where("bound >= reached - 1e-9").select("a", "b", "ref"))
    best = rest.groupBy("a").agg(F.min_by(F.struct("ref", "score"), F.struct(-F.col("score"), "ref")).alias("m")).select("a", "m.*")
    return asked.join(best, "a").select("id", "ref", "score")
