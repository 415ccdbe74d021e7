r"""Licence scans: ordered signature rules behind a keyword filter, with interval-containment suppression.

Method. Each text is lower-cased (A-Z) and its words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` are joined by single spaces.
The rules (license_rules.py: three templates for each of 94 names, and 32 texts) are gated twice: a text without any anchor string is done,
and of the others only rules whose keyword stands in the text run. All matches of all rules become intervals; in
order of start, longest first and by priority, an interval that lies inside an earlier one of equal or better
priority is suppressed (one running maximum of ends per priority). Running sums and maxima go over chunks of matches, whose
totals are summed first, so that growing a list never copies more than a chunk or one value per chunk. Base labels, places where the four base phrases stand, always stay.

Scale. One pass, no shuffle, only built-in functions. The rules are a literal of fixed size in the plan; nothing
else is broadcast. Work beyond the word count is done for texts with an anchor only.

Cases. Null counts as the empty text: no words, no labels, null first_word and last_word, score 0. Rows are judged one
by one, so repeated rows and ids each get a result. Extra columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .license_rules import ANCHORS, rules

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PRIORITIES = 4
_CHUNK = 512


def _places(words: Column) -> Column:
    """(start, label) of each place where a base phrase stands."""

    def at(phrase: str, label: str) -> Column:
        parts = phrase.split()
        starts = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
        rest = F.lit(" ".join(parts[1:]))
        starts = F.filter(starts, lambda i: F.array_join(F.slice(words, i + 2, F.lit(len(parts) - 1)), " ") == rest)
        return F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*[at(p, label) for p, label in PHRASES.items()])


def _rule_table() -> Column:
    kinds = ("priority", "label", "keyword", "pattern", "score")
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(kinds, rule, strict=True)]) for rule in rules()])


def _matches(norm: Column, rule: Column) -> Column:
    """The intervals [start, end) of a rule's matches in norm, from the lengths of what lies between and of the matches."""
    found, between = F.regexp_extract_all(norm, rule["pattern"], F.lit(0)), F.split(norm, rule["pattern"])
    steps = F.filter(F.zip_with(found, between, lambda m, b: F.struct(F.length(b).alias("gap"), F.length(m).alias("len"))), lambda x: x["len"].isNotNull())
    add = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["len"]).alias("at"), F.concat(acc["all"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["len"]).alias("end")))).alias("all"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("all"))

    def placed(parts: Column) -> Column:
        before = _before(parts, F.lit(0), lambda at, part: at + part["at"])
        return F.flatten(F.zip_with(parts, before, lambda part, at: F.transform(part["all"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end")))))

    spans = _let(F.transform(_chunks(steps), lambda chunk: F.aggregate(chunk, none, add)), placed)
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["score"].alias("score")),
    )


def _survivors(found: Column) -> Column:
    """Detections in order, without those inside an earlier one of equal or better priority.

    A suppressed detection reaches no further than what suppresses it, so the furthest ends of all earlier ones decide.
    """
    kind = "struct<start: int, end: int, priority: int, label: string, score: double>"
    further = lambda reach, x: F.transform(reach, lambda r, p: F.when(p == x["priority"], F.greatest(r, -x["minus_end"])).otherwise(r))
    nowhere = F.array(*[F.lit(-1)] * _PRIORITIES)

    def step(acc: Column, x: Column) -> Column:
        inside = F.array_max(F.slice(acc["reach"], 1, x["priority"] + 1)) >= -x["minus_end"]
        one = F.struct(x["start"].alias("start"), (-x["minus_end"]).alias("end"), x["priority"].alias("priority"), x["label"].alias("label"), x["score"].alias("score"))
        return F.struct(further(acc["reach"], x).alias("reach"), F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(one))).alias("kept"))

    def kept(chunks: Column) -> Column:
        before = _before(chunks, nowhere, lambda reach, chunk: F.aggregate(chunk, reach, further))
        start = lambda reach: F.struct(reach.alias("reach"), F.array().cast(f"array<{kind}>").alias("kept"))
        return F.flatten(F.zip_with(chunks, before, lambda chunk, reach: F.aggregate(chunk, start(reach), step, lambda acc: acc["kept"])))

    return _let(_chunks(F.array_sort(found)), kept)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _chunks(items: Column) -> Column:
    return _let(items, lambda all_: F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(_CHUNK)), lambda i: F.slice(all_, i, F.lit(_CHUNK))))


def _before(parts: Column, zero: Column, add) -> Column:
    """For each part, what add has made of the parts before it."""
    start = F.struct(zero.alias("now"), F.slice(F.array(zero), 1, 0).alias("all"))
    return F.aggregate(parts, start, lambda acc, x: F.struct(add(acc["now"], x).alias("now"), F.concat(acc["all"], F.array(acc["now"])).alias("all")), lambda acc: acc["all"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for each row of docs.

    detections: (start, end, priority, label, score) of the surviving matches, in characters of the normalised text.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("t"))
    # lower() may turn other letters into ASCII ones but never a word into none: word counts hold, and the gate sees a superset.
    cut = base.select("doc_id", "t", F.filter(F.split(F.lower("t"), _BREAK), lambda w: w != "").alias("low"))
    joined = cut.select("doc_id", "t", F.size("low").cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join("low", " ")).alias("line"))
    gate = reduce(or_, [F.col("line").contains(a) for a in ANCHORS])
    none = F.array().cast("array<string>")
    words = F.filter(F.split(ascii_lower(F.col("t")), _BREAK), lambda w: w != "")
    worded = joined.select("doc_id", "n_words", F.when(gate, words).otherwise(none).alias("words"))
    norm = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    hit = F.flatten(F.transform(F.filter(_rule_table(), lambda r: F.col("norm").contains(r["keyword"])), lambda r: _matches(F.col("norm"), r)))
    found = worded.withColumn("norm", norm).select(
        "doc_id", "n_words",
        F.when(F.size("words") > 0, _places(F.col("words"))).alias("places"),
        F.when(F.size("words") > 0, _survivors(hit)).alias("detections"),
    )
    empty = F.array().cast("array<struct<start: int, end: int, priority: int, label: string, score: double>>")
    labels = F.coalesce(F.transform("places", lambda p: p["label"]), none)
    return found.select(
        "doc_id", "n_words",
        F.size(labels).cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, F.transform(F.coalesce("detections", empty), lambda d: d["label"])))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)), F.when(F.size(labels) > 0, 0.9).otherwise(0.0)).alias("score"),
        F.coalesce("detections", empty).alias("detections"),
    )


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("detections")
