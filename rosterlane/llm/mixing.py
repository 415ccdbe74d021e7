"""Mixing sources to target weights: proportionate-fair (Pfair) interleaving of source blocks.

Method. Each source's documents, by id, form blocks of about `block_bytes`. With target weight w, a source's block i
is released at slot floor(i / w) and due by ceil((i + 1) / w); earliest deadline first among released blocks keeps
every source within less than one block of its share w * t at every slot t. The weights as whole numbers in lowest
terms (exact fractions of what is given; a float counts as the decimal number it prints as) are the slots of a period
that is their sum, so nothing is rounded and the schedule repeats: one period is laid out on the driver, or the phase
where that is shorter, and block i of a source with n slots a period stands at slot (i div n) * period + place[i mod n].
When a source runs out, the others' weights are rescaled and a new phase begins, so no row is dropped: there are at
most as many phases as sources, computed from one row per source. A caller can ask for a period of his own; the
weights are then rounded to whole slots of it, and the shares drift from the given ones by that rounding.

Scale. Documents are measured (octets), not moved: one range partitioning of (source, id, size) and a running sum
inside each partition; the partitions' totals, one row per source and partition, are summed in turn. A hot source
spreads over many partitions. The join with the phases' patterns is on (phase, source, place): a row per slot laid out,
which is never more than the blocks there are.

Cases. Null source is a source of its own. Null ids come first in their source. Null text has size 0. A document starts in the
block in which its first byte falls; a document longer than a block takes the following block numbers with it.
Sources without a weight get the least given weight; weights of absent sources are ignored. Repeated rows keep
their own places, in an order by their size.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK_BYTES = 64 << 10
_MOST = (1 << 62) - 1  # a deadline beyond this many slots counts as this


def exact_weight(w) -> Fraction:
    """The weight as a fraction; a float is the decimal number that it prints as."""
    return Fraction(repr(float(w))) if isinstance(w, float) else Fraction(w)


def exact_slots(weights: dict[str, Fraction]) -> dict[str, int]:
    """The weights as whole numbers in lowest terms."""
    exact = {s: exact_weight(w) for s, w in weights.items()}
    common = math.lcm(*[w.denominator for w in exact.values()])
    whole = {s: int(w * common) for s, w in exact.items()}
    least = math.gcd(*whole.values())
    return {s: n // least for s, n in whole.items()}


def in_slots(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots per period by largest remainder, at least one each."""
    total = sum(weights.values())
    exact = {s: Fraction(w) / Fraction(total) * period for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    rest = sorted(weights, key=lambda s: (slots[s] - exact[s], s))
    k = 0
    while sum(slots.values()) != period:
        s = rest[k % len(rest)] if sum(slots.values()) < period else rest[-1 - k % len(rest)]
        k += 1
        if sum(slots.values()) < period:
            slots[s] += 1
        elif slots[s] > 1:
            slots[s] -= 1
    return slots


def one_period(slots: dict[str, int], left: dict[str, int] | None = None) -> dict[str, list[int]]:
    """The places of each source's blocks in one period, or until a source has none left: earliest deadline first among released blocks."""
    period = sum(slots.values())
    waiting = [(0, -(-period // n), s, 0) for s, n in slots.items()]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    places: dict[str, list[int]] = {s: [] for s in slots}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, due, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, i))
        _, s, i = heapq.heappop(ready)
        places[s].append(t)
        if left is not None and i + 1 == left[s]:
            break
        if i + 1 < slots[s]:
            heapq.heappush(waiting, ((i + 1) * period // slots[s], -(-(i + 2) * period // slots[s]), s, i + 1))
    return places


def phases(blocks: dict[str, int], weights: dict[str, Fraction], period: int | None = None) -> list[dict]:
    """For each phase: its first slot, each source's slots a period, places, blocks used before it, and its length.

    period None: the weights' own, so that every share is exact.
    """
    used, out, begin = dict.fromkeys(blocks, 0), [], 0
    while active := {s: weights[s] for s in blocks if used[s] < blocks[s]}:
        slots = exact_slots(active) if period is None else in_slots(active, max(period, len(active)))
        size = sum(slots.values())
        left = {s: blocks[s] - used[s] for s in active}
        places = one_period(slots, left)
        laid = sum(len(p) for p in places.values())
        if laid < size or any(left[s] == len(places[s]) for s in active):
            length = laid  # a source runs out in the first period
        else:
            length = min((left[s] - 1) // slots[s] * size + places[s][(left[s] - 1) % slots[s]] for s in active) + 1
        out.append({"begin": begin, "slots": slots, "places": places, "used": {s: used[s] for s in active}, "size": size, "length": length})
        for s in active:
            used[s] += (length // size) * slots[s] + sum(p < length % size for p in places[s])
        begin += length
    return out


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_bytes: int = BLOCK_BYTES,
    period: int | None = None,
) -> DataFrame:
    """(doc_id, source, size, block, slot, release, deadline, place), a row per row of docs.

    slot is the block's turn in the whole mixture, release and deadline its window, place the document's order within the block.
    weights None: every source the same. period None: the weights' own, see above.
    """
    spark = docs.sparkSession
    sizes = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("size"))
    ranged = sizes.withColumn("src", F.coalesce("source", F.lit("\0"))).repartitionByRange("src", "doc_id", "size").withColumn("part", F.spark_partition_id())
    ranged = cut(ranged)
    inside = Window.partitionBy("part", "src").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("src", "part").agg(F.sum("size").alias("bytes"))
    left = F.coalesce(F.sum("bytes").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = totals.select("src", "part", left.alias("left"))
    local = ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = local.join(before, ["src", "part"]).withColumn("offset", F.col("left") + F.col("inside"))
    placed = cut(at.select("doc_id", "source", "src", "size", "offset", F.floor(F.col("offset") / block_bytes).cast("long").alias("block")))

    ends = placed.groupBy("src").agg((F.max("block") + 1).alias("n")).collect()  # a row per source
    blocks = {r.src: r.n for r in ends}
    given = {k if k is not None else "\0": exact_weight(v) for k, v in (weights or {}).items() if v > 0}
    wanted = {s: given.get(s, min(given.values(), default=Fraction(1))) for s in blocks}
    plan = phases(blocks, wanted, period)
    spans, places = [], []
    for k, p in enumerate(plan):
        for s, n in p["slots"].items():
            later = [q["used"][s] for q in plan[k + 1 :] if s in q["used"]]
            until, size = later[0] if later else blocks[s], p["size"]
            again = p["length"] > size  # else no block stands in a second period, and n and size may be beyond a long
            spans.append((k, s, p["used"][s], until, n if again else max(until - p["used"][s], 1), p["begin"], size if again else 0))
            places += [(k, s, i, t, i * size // n, min(-(-(i + 1) * size // n), _MOST)) for i, t in enumerate(p["places"][s])]
    spanned = spark.createDataFrame(spans, "phase int, src string, used long, until long, n long, begin long, period long")
    pattern = spark.createDataFrame(places, "phase int, src string, turn long, t long, first long, due long")
    found = placed.join(F.broadcast(spanned) if len(spans) <= 100_000 else spanned, "src").where("block >= used and block < until")
    i = F.col("block") - F.col("used")
    turned = found.withColumn("turn", i % F.col("n")).join(F.broadcast(pattern) if len(places) <= 1_000_000 else pattern, ["phase", "src", "turn"])
    start = F.col("begin") + F.expr("(block - used) div n") * F.col("period")
    return turned.select(
        "doc_id", "source", "size", "block",
        (start + F.col("t")).alias("slot"),
        (start + F.col("first")).alias("release"),
        (start + F.col("due")).alias("deadline"),
        (F.col("offset") - F.col("block") * block_bytes).alias("place"),
    )


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, globally sorted by their turn in the mixture; rows that share an id stand at its first place."""
    order = mix(docs, weights, id_col, **options).groupBy("doc_id").agg(F.min(F.struct("slot", "place")).alias("__at")).withColumnRenamed("doc_id", "__id")
    columns = [docs[c] for c in docs.columns]
    return docs.join(order, docs[id_col].cast("long").eqNullSafe(F.col("__id")), "left").orderBy("__at.slot", "__at.place", "__id").select(*columns)


#: Production parameters of the registered query: the sources that matter more, the others the same.
WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 2.0, "src3": 2.0, "src4": 1.0}


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return mix(read_table(spark, sf_dir, "documents"), WEIGHTS).drop("size")
