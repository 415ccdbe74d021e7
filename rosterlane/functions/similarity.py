"""Similarities of names and addresses over a table of pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import WS, extract_state, extract_zip, normalize_address, normalize_text


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"\w+"), F.lit(0))


def token_cosine(a: Column, b: Column) -> Column:
    """Cosine of raw word counts; blank is 0."""
    count = lambda words, w: F.size(F.filter(words, lambda v: v == w)).cast("double")
    norm = lambda words: F.sqrt(F.aggregate(F.array_distinct(words), F.lit(0.0), lambda s, w: s + count(words, w) * count(words, w)))

    def of(x: Column, y: Column) -> Column:
        dot = F.aggregate(F.array_intersect(x, y), F.lit(0.0), lambda s, w: s + count(x, w) * count(y, w))
        return F.when((F.size(x) > 0) & (F.size(y) > 0), dot / (norm(x) * norm(y))).otherwise(0.0)

    both = F.array(F.struct(tokens(a).alias("x"), tokens(b).alias("y")))  # else the words would be told apart for each word anew
    return F.transform(both, lambda p: of(p["x"], p["y"]))[0]


_CELLS = 4 << 20


def _letters(texts: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(x.ljust(width, "\0") for x in texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width)


def jaro_winkler_of(a: list[str], b: list[str]) -> np.ndarray:
    """Scores of pairs of non-empty lower-cased texts, all pairs of a slice at once.

    Matches in a window, half transpositions (also odd ones), and a bonus for up to 4 leading letters at any score.
    """
    n, m = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    out, order = np.zeros(len(a)), np.argsort(np.maximum(n, m), kind="stable")
    first = 0
    while first < len(order):
        widths = np.maximum.accumulate(np.maximum(n, m)[order[first:]])
        last = first + max(1, int(np.searchsorted(widths * np.arange(1, len(widths) + 1), _CELLS, "right")))
        rows = order[first:last]
        out[rows] = _scores([a[i] for i in rows], [b[i] for i in rows], n[rows], m[rows])
        first = last
    return out


def _scores(a: list[str], b: list[str], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    s, t = _letters(a, int(n.max())), _letters(b, int(m.max()))
    reach, every = np.maximum(0, np.maximum(n, m) // 2 - 1), np.arange(len(a))
    free, mine = np.arange(t.shape[1]) < m[:, None], np.zeros(s.shape, bool)
    for i in range(s.shape[1]):
        near = free & (t == s[:, i : i + 1]) & (np.abs(np.arange(t.shape[1]) - i) <= reach[:, None]) & (i < n)[:, None]
        mine[:, i] = near.any(axis=1)
        free[every[mine[:, i]], near.argmax(axis=1)[mine[:, i]]] = False
    theirs = ~free & (np.arange(t.shape[1]) < m[:, None])
    k = mine.sum(axis=1)
    differ = s[mine] != t[theirs]  # both row by row, in order of place
    moved = np.bincount(np.repeat(every, k), differ, len(a)) / 2
    some = np.maximum(k, 1)
    jaro = np.where(k > 0, (k / n + k / m + (k - moved) / some) / 3, 0.0)
    lead = min(4, s.shape[1], t.shape[1])
    same = ((s[:, :lead] == t[:, :lead]) & (np.arange(lead) < np.minimum(n, m)[:, None])).cumprod(axis=1).sum(axis=1)
    return np.where(k > 0, np.minimum(1.0, jaro + same * 0.1 * (1 - jaro)), 0.0)


def _udf():
    @F.pandas_udf(DoubleType())
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        both = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        out[both] = jaro_winkler_of(x[both].str.lower().tolist(), y[both].str.lower().tolist())
        return pd.Series(out)

    return score


def jaro_winkler(a: Column, b: Column, needed: Column | None = None) -> Column:
    """For columns of one row; equal, blank and unneeded pairs are decided before Python (an unneeded one is 0)."""
    equal, both = F.lower(a) == F.lower(b), F.coalesce((F.length(a) > 0) & (F.length(b) > 0), F.lit(False))
    hard = both & ~equal if needed is None else both & ~equal & F.coalesce(needed, F.lit(False))
    score = F.coalesce(F.nanvl(_udf()(F.when(hard, a), F.when(hard, b)), F.lit(0.0)), F.lit(0.0))
    return F.when(~both, 0.0).when(equal, 1.0).otherwise(score)


def with_jaro_winkler(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """pairs with a Jaro-Winkler column. Equal and blank pairs never reach Python; it gets each distinct other pair once."""
    equal = F.lower(a) == F.lower(b)
    hard = pairs.where(~equal & (F.length(a) > 0) & (F.length(b) > 0)).select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct()
    scored = hard.withColumn("__s", _udf()("__a", "__b"))
    joined = pairs.join(scored, (pairs[a] == scored["__a"]) & (pairs[b] == scored["__b"]), "left")
    easy = F.when(equal & (F.length(a) > 0), 1.0).otherwise(0.0)
    return joined.withColumn(out, F.coalesce("__s", easy)).drop("__a", "__b", "__s")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when((F.length(x) > 0) & (F.length(y) > 0), 1 - F.levenshtein(x, y) / longest).otherwise(0.0)


def address_similarity(pairs: DataFrame, a: str = "a", b: str = "b", out: str = "address_similarity") -> DataFrame:
    """0.40 cosine + 0.45 Jaro-Winkler + 0.15 Levenshtein."""
    scored = with_jaro_winkler(pairs, a, b, "__jw")
    mixed = 0.40 * token_cosine(F.col(a), F.col(b)) + 0.45 * F.col("__jw") + 0.15 * levenshtein_similarity(F.col(a), F.col(b))
    both = (F.length(a) > 0) & (F.length(b) > 0)
    return scored.withColumn(out, F.when(both, mixed).otherwise(0.0)).drop("__jw")


def addresses_match(a: Column, b: Column) -> Column:
    """Equal but for writing: same zip and state, the same words, and the same other numbers in order."""
    x, y, zip_a, zip_b, state_a, state_b = normalize_address(a), normalize_address(b), extract_zip(a), extract_zip(b), extract_state(a), extract_state(b)
    words = lambda c: F.filter(F.split(c, f"{WS}+"), lambda w: ~w.rlike(r"^\d{5}"))
    u, v = words(x), words(y)
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    others = lambda c: F.filter(numbers(c), lambda n: (n != zip_a) & (n != zip_b))
    same_words = (F.size(F.array_except(u, v)) == 0) & (F.size(F.array_except(v, u)) == 0)
    same_numbers = (F.size(numbers(x)) == F.size(numbers(y))) & (others(x) == others(y))
    close = (F.size(u) > 0) & (F.size(v) > 0) & ((F.array_join(u, " ") == F.array_join(v, " ")) | (same_words & same_numbers))
    return (
        F.when((F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0), False)
        .when((a == b) | (x == y), True)
        .when(zip_a.isNotNull() & zip_b.isNotNull() & (zip_a != zip_b), False)
        .when(state_a.isNotNull() & state_b.isNotNull() & (state_a != state_b), False)
        .when(zip_a.isNotNull() & (zip_a == zip_b), close)
        .otherwise(False)
    )


def component_match(one: dict[str, Column], other: dict[str, Column]) -> Column:
    """struct(zip, state, city, street, score, is_match) over the parts that stand on either side."""
    norm = {"zip": lambda c: F.coalesce(c, F.lit("")), "state": lambda c: F.upper(F.coalesce(c, F.lit(""))), "city": normalize_text, "street": normalize_address}
    here = {k: (F.coalesce(F.length(one[k]), F.lit(0)) > 0) | (F.coalesce(F.length(other[k]), F.lit(0)) > 0) for k in norm}
    same = {k: F.when(here[k], f(one[k]) == f(other[k])) for k, f in norm.items()}
    total = sum((here[k].cast("int") for k in norm), F.lit(0))
    matched = sum((F.coalesce(same[k], F.lit(False)).cast("int") for k in norm), F.lit(0))
    score = F.when(total > 0, matched / total).otherwise(0.0)
    return F.struct(*[same[k].alias(k) for k in norm], score.alias("score"), (score >= 0.75).alias("is_match"))


def should_suggest(own: Column, other: Column, similarity: Column) -> Column:
    return F.when(F.coalesce(F.length(own), F.lit(0)) == 0, True).when(own == other, False).otherwise(similarity < 0.99)
