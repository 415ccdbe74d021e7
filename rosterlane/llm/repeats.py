r"""Exact-substring deduplication: every byte inside a 200-byte string that also starts elsewhere, by a sparse suffix array.

Method. Anchors are the places whose 32-byte hash is least in some window of 169 places: each 200-byte string holds at
least one, at the same place in each of its copies. Anchors whose hash stands more than once are the suffixes; each has
its context, up to 200 bytes behind it and 168 before it. Contexts are range-partitioned by their leading bytes (then by
the bytes before, read backwards, then by a hash of their place) with sampled splitters. Each bucket sorts its suffixes,
and their reversed prefixes, by multikey quicksort over 8-byte keys, takes neighbours' common lengths, and for every
offset o of the anchor in a 200-byte string compares classes of (o bytes before, 200 - o bytes behind).

Across boundaries. Splitters stand before a group of suffixes with equal first 32 bytes; only a group that is larger than a
bucket is parted, by longer splitters. Suffixes i < s <= j on both sides of a splitter s have min(common(i, s), common(s, j))
leading bytes in common. So the suffixes of parted groups are dealt and sorted once more, by the bytes before them: what
lies in one bucket by either order is compared there, and two suffixes that splitters s and t part in both orders match at
offset o if each has 200 - o bytes in common with s behind and o bytes with t before. That is a count per (s, t, o), which
Spark sums without moving text. The splitters form a balanced tree, and two buckets are compared at the one that parts them
highest up, so a suffix meets at most 2 log2(buckets) splitters of an order.

What repeats around an anchor is one interval; a text's intervals are united and cut out of it.

Scale. Copies of a text become one text by a map-side aggregation, so texts are shuffled once, into a table that is
bucketed by their digest: all later joins leave them in place. Anchors, one per about 85 bytes, move as (hash, digest,
place), and their frequent hashes pre-aggregate; contexts move once, for repeated anchors only, and once more in parted
groups. A bucket has about `bucket` contexts of 368 bytes, whatever they hold, until there are _MOST_BUCKETS; the splitters,
376 bytes each, are what is broadcast, and the driver sorts a sample of eight times as many.

Cases. Null and empty texts have 0 bytes and nothing to remove, as have texts of fewer than 200 bytes. Repeated rows
are copies like others, whatever their ids, so they remove each other. Extra columns are ignored by cut_repeats(), which
also returns each row's remaining text; a character that a cut splits is dropped from that text, while
the digest columns are of the exact remaining bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_bucketed, discard, map_batches
from .words import mix, text_bytes

LENGTH = 200
GRAM = 32
BEFORE = LENGTH - GRAM
BUCKET = 1 << 15
_MOST_BUCKETS = 1 << 17
_OVERSAMPLE = 8
_CHUNK = 1 << 14
_SEED = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each place, by doubling."""
    h, step, base = _SEED[raw], 1, 0x9E3779B97F4A7C15
    while step < GRAM:
        h = h[:-step] * np.uint64(base) + h[step:] if len(h) > step else h[:0]
        base, step = base * base % (1 << 64), step * 2
    return mix(h)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i:i + width] for each i, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(raw: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) over texts raw[docs[i]:docs[i + 1]]: least hashes of the windows of BEFORE + 1 places inside a text."""
    width = BEFORE + 1
    if len(raw) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(raw)
    least = _sliding(h, width, np.minimum)
    ends = np.repeat(docs[1:], np.diff(docs))
    least[np.arange(len(least)) + LENGTH > ends[: len(least)]] = 0  # a window over two texts picks nothing
    pad = np.zeros(width - 1, np.uint64)
    reach = _sliding(np.concatenate((pad, least, pad)), width, np.maximum)  # the greatest of the minima over windows that hold a place
    at = np.flatnonzero(reach == h)
    return at, h[at]


def _anchor_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, docs = text_bytes(batch.column("text"))
    at, hashes = anchors(raw, docs)
    row = np.searchsorted(docs, at, "right") - 1
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column("key").take(pa.array(row)), pa.array((at - docs[row]).astype(np.int32))], ["gram", "key", "place"])


def _fixed(rows: np.ndarray) -> pa.Array:
    """An Arrow binary array of byte rows of one width."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The byte rows of a binary column of one width."""
    parts = [np.frombuffer(c.buffers()[2], np.uint8)[: (c.offset + len(c)) * width][c.offset * width :].reshape(-1, width) for c in column.chunks if len(c)]
    return np.concatenate(parts) if parts else np.zeros((0, width), np.uint8)


def _around(raw: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Each anchor's LENGTH bytes behind and BEFORE bytes before it, backwards; zero where its text raw[low:high] ends."""
    places = at[:, None] + np.concatenate((np.arange(LENGTH), -1 - np.arange(BEFORE)))
    inside = (places >= low[:, None]) & (places < high[:, None])
    return np.where(inside, raw[np.where(inside, places, 0)], np.uint8(0))


def _sort_keys(heads: np.ndarray, keys: list[bytes], places: np.ndarray) -> np.ndarray:
    """What contexts are ordered by: their bytes, then a hash of their place, so that equal contexts can be parted too."""
    text = np.frombuffer(b"".join(k[:8] for k in keys), np.uint64)
    salt = mix(text + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(np.hstack([heads, salt])).view(f"S{heads.shape[1] + 8}").reshape(-1)


_BEHIND, _BEFORE = slice(0, LENGTH + BEFORE), np.r_[0:GRAM, LENGTH : LENGTH + BEFORE]  # the parts of a context that its two orders compare


class Splitters:
    """Ascending sort keys; splitter c parts bucket c from c + 1. A whole one stands before all suffixes with its first GRAM bytes."""

    def __init__(self, sample: np.ndarray, buckets: int, width: int):
        keys, whole, last = [], [], b""
        sample = np.sort(sample)
        for k in range(1, buckets if len(sample) else 0):
            key = bytes(sample[k * len(sample) // buckets]).ljust(width, b"\0")
            start = key[:GRAM].ljust(width, b"\0")
            if start > last:
                keys.append(start)
                whole.append(True)
            elif key > last:
                keys.append(key)
                whole.append(False)
            last = keys[-1]
        self.keys, self.whole = np.array(keys, f"S{width}"), np.array(whole, bool)
        self.heads = np.frombuffer(self.keys.tobytes(), np.uint8).reshape(-1, width)

    def buckets(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, keys, "right").astype(np.int32)

    def common(self, bucket: int, heads: np.ndarray):
        """(splitter, what it and each row of the bucket have in common), for those that part suffixes with the same first GRAM bytes."""
        width, n = heads.shape[1], len(self.keys)
        for c in parting_splitters(bucket, n):
            side = self.heads[bucket if c >= bucket else bucket - 1]
            if self.whole[c] or (side[:GRAM] != self.heads[c, :GRAM]).any():
                continue
            differ = heads != self.heads[c, :width]
            yield c, np.where(differ.any(axis=1), differ.argmax(axis=1), width)


def contexts(texts: DataFrame, splitters: Splitters | None) -> DataFrame:
    """(bucket, key, place, n_left, n_right, context) for each place of texts (key, text, places)."""
    sent = texts.sparkSession.sparkContext.broadcast(splitters)

    def rows(batches):
        for batch in batches:
            raw, docs = text_bytes(batch.column("text"))
            lists = batch.column("places")
            places = lists.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            for a in range(0, len(places), _CHUNK):
                p, r = places[a : a + _CHUNK], row[a : a + _CHUNK]
                around = _around(raw, docs[r] + p, docs[r], docs[r + 1])
                key = batch.column("key").take(pa.array(r))
                bucket = sent.value.buckets(_sort_keys(around[:, _BEHIND], key.to_pylist(), p)) if sent.value else np.zeros(len(p), np.int32)
                left, right = np.minimum(p, BEFORE), np.minimum(docs[r + 1] - docs[r] - p, LENGTH)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), key, pa.array(p.astype(np.int32)), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16)), _fixed(around)],
                    ["bucket", "key", "place", "n_left", "n_right", "context"],
                )

    return texts.select("key", "text", "places").mapInArrow(rows, "bucket int, key binary, place int, n_left short, n_right short, context binary")


def _drawn(n: int, bucket: int):
    """(number of buckets, condition on key and place that draws _OVERSAMPLE of n contexts for each)."""
    buckets = min(-(-n // bucket), _MOST_BUCKETS)
    return buckets, F.pmod(F.xxhash64("key", "place"), F.lit(1 << 40)) < int(min(1.0, _OVERSAMPLE * buckets / max(1, n)) * (1 << 40))


def _splitters(sample: DataFrame, buckets: int, part) -> Splitters:
    """Splitters from a sample of contexts, ordered by the given part of their bytes."""
    rows = sample.select("key", "place", "context").toArrow()
    heads = _bytes(rows.column("context"), LENGTH + BEFORE)[:, part]
    return Splitters(_sort_keys(heads, rows.column("key").to_pylist(), rows.column("place").to_numpy()), buckets, heads.shape[1] + 8)


def sort_multikey(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): a multikey quicksort of byte rows, 8 bytes at a time, refining only ties; and neighbours' common lengths."""
    n, width = rows.shape
    keys = np.ascontiguousarray(rows).view(">u8").astype(np.uint64).reshape(n, width // 8)
    order, common = np.arange(n), np.full(n, width)
    common[:1] = 0
    tied = np.zeros(n, np.int64)  # the group of each place in order; ungrouped places are -1
    live = np.arange(n)
    for k in range(width // 8):
        if not len(live):
            break
        local = order[live]
        again = np.lexsort((keys[local, k], tied[live]))
        order[live] = local[again]
        now, group = keys[order[live], k], tied[live]
        same = (now[1:] == now[:-1]) & (group[1:] == group[:-1])
        split = np.flatnonzero((now[1:] != now[:-1]) & (group[1:] == group[:-1]))
        a, b = rows[order[live[split]], 8 * k : 8 * k + 8], rows[order[live[split + 1]], 8 * k : 8 * k + 8]
        common[live[split + 1]] = 8 * k + (a != b).argmax(axis=1) if len(split) else common[live[split + 1]]
        keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
        group = np.cumsum(np.concatenate(([True], ~same)))
        tied[live] = group
        live = live[keep]
    return order, common


def repeated_around(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context: the bytes before and behind its anchor that belong to a LENGTH-byte string another context has too; (-1, -1) if none."""
    n = len(left)
    most_left, most_right = np.full(n, -1), np.full(n, -1)
    by_right, same_right = sort_multikey(right)
    by_left, same_left = sort_multikey(left)
    rank = np.empty(n, np.int64)
    for o in range(BEFORE + 1):
        fits = (n_left >= o) & (n_right >= LENGTH - o)
        if fits.sum() < 2:
            continue
        rank[by_right] = np.cumsum(same_right < LENGTH - o)
        pair = rank.copy()
        if o:
            rank[by_left] = np.cumsum(same_left < o)
            pair = pair * (n + 1) + rank
        at = np.flatnonzero(fits)
        _, which, count = np.unique(pair[at], return_inverse=True, return_counts=True)
        hit = at[count[which] > 1]
        most_left[hit] = o
        most_right[hit] = np.maximum(most_right[hit], LENGTH - o)
    return most_left, most_right


def parting_splitters(bucket: int, n: int) -> list[int]:
    """The splitters of 0..n-1 (splitter c parts bucket c from c + 1) at which a bucket is compared with others.

    Between two buckets exactly one splitter is highest in the tree (its number plus one has the most trailing zeros); it is in both lists.
    """
    height = lambda c: ((c + 1) & -(c + 1)).bit_length()
    out = []
    for side in (range(bucket, n), range(bucket - 1, -1, -1)):
        best = 0
        for c in side:
            if height(c) > best:
                best = height(c)
                out.append(c)
    return out


_JUDGED = "key binary, place int, low int, high int, n_left short, n_right short, context binary, parted array<struct<at: int, common: int>>, before array<struct<at: int, common: int>>"


def _judge(splitters: Splitters, bucket: int, table: pa.Table, part, column: str) -> pa.Table:
    """The rows of a bucket that repeat (low, high) or that splitters part from others of their kind (column: which, and what they have in common)."""
    around = _bytes(table.column("context"), LENGTH + BEFORE)
    n_left, n_right = (table.column(c).to_numpy().astype(np.int64) for c in ("n_left", "n_right"))
    place = table.column("place").to_numpy()
    most_left, most_right = repeated_around(around[:, LENGTH:], n_left, around[:, :LENGTH], n_right)
    row, at, reach = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for c, common in splitters.common(bucket, around[:, part]):
        row.append(np.flatnonzero(common >= GRAM))
        at.append(np.full(len(row[-1]), c, np.int32))
        reach.append(common[row[-1]].astype(np.int32))
    row, at, reach = (np.concatenate(x) for x in (row, at, reach))
    order = np.argsort(row, kind="stable")
    counts = np.bincount(row, minlength=len(place))
    hit, is_open = most_right >= 0, counts > 0
    out = np.flatnonzero(hit | is_open)
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts[out]))), pa.int32())
    found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(at[order]), pa.array(reach[order])], ["at", "common"]))
    take = pa.array(out)
    values = {
        "low": pa.array((place - most_left)[out].astype(np.int32), mask=~hit[out]),
        "high": pa.array((place + most_right)[out].astype(np.int32), mask=~hit[out]),
        "context": table.column("context").take(pa.array(np.where(is_open, np.arange(len(place)), -1)[out], mask=~is_open[out])),
        "parted": table.column("parted").take(take) if column == "before" else found,
        "before": found if column == "before" else pa.nulls(len(out), found.type),
    }
    names = ["key", "place", "low", "high", "n_left", "n_right", "context", "parted", "before"]
    return pa.table([values[c] if c in values else table.column(c).take(take) for c in names], names)


def _judged(placed: DataFrame, splitters: Splitters, part, column: str) -> DataFrame:
    sent = placed.sparkSession.sparkContext.broadcast(splitters)
    return cut(placed.groupBy("bucket").applyInArrow(lambda of, table: _judge(sent.value, of[0].as_py(), table, part, column), _JUDGED))


def _by_bytes_before(rows: DataFrame, splitters: Splitters) -> DataFrame:
    """rows with the bucket of what stands before them."""
    sent = rows.sparkSession.sparkContext.broadcast(splitters)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                heads = _bytes(pa.chunked_array([batch.column("context")]), LENGTH + BEFORE)[:, _BEFORE]
                bucket = sent.value.buckets(_sort_keys(heads, batch.column("key").to_pylist(), batch.column("place").to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], ["bucket", *batch.schema.names])

    lists = "array<struct<at: int, common: int>>"
    return rows.select("key", "place", "n_left", "n_right", "context", "parted").mapInArrow(place, f"bucket int, key binary, place int, n_left short, n_right short, context binary, parted {lists}")


def _parted_twice(rows: DataFrame) -> DataFrame:
    """(key, low, high) of what matches over a splitter of either order: offsets that two or more suffixes reach at both."""
    at = rows.select("key", "place", "n_left", "n_right", F.explode("parted").alias("s"), "before").select("*", F.explode("before").alias("t"))
    first, last = LENGTH - F.least(F.col("s.common"), F.col("n_right")), F.least(F.col("t.common") - GRAM, F.col("n_left"))
    reach = at.select("key", "place", F.col("s.at").alias("s"), F.col("t.at").alias("t"), first.alias("first"), last.alias("last")).where("first <= last")
    kinds = cut(reach.groupBy("s", "t", "first", "last").agg(F.count("*").alias("n")))
    often = kinds.select("s", "t", "n", F.explode(F.sequence("first", "last")).alias("o")).groupBy("s", "t", "o").agg(F.sum("n").alias("n")).where("n > 1")
    ends = kinds.drop("n").join(often.select("s", "t", "o"), ["s", "t"]).where("o between first and last").groupBy("s", "t", "first", "last").agg(F.min("o").alias("low"), F.max("o").alias("high"))
    met = reach.join(cut(ends), ["s", "t", "first", "last"]).groupBy("key", "place").agg(F.max("high").alias("most"), F.min("low").alias("least"))
    return met.select("key", (F.col("place") - F.col("most")).alias("low"), (F.col("place") + LENGTH - F.col("least")).alias("high"))


def spans_of(texts: DataFrame, wanted: DataFrame, bucket: int) -> DataFrame:
    """(key, found): for each text, the intervals [low, high) around its anchors that repeat."""
    spans = lambda rows: rows.where("low is not null").select("key", "low", "high")
    buckets, drawn = _drawn(wanted.agg(F.sum(F.size("places"))).first()[0] or 0, bucket)
    some = wanted.select("key", F.explode("places").alias("place")).where(drawn & F.lit(buckets > 1)).groupBy("key").agg(F.collect_list("place").alias("places"))
    behind = _splitters(contexts(texts.join(some, "key"), None), buckets, _BEHIND)
    judged = _judged(contexts(texts.join(wanted, "key"), behind), behind, _BEHIND, "parted")
    found = spans(judged)
    parted = judged.where("context is not null")
    n = parted.count()
    if n:
        buckets, drawn = _drawn(n, bucket)
        before = _splitters(parted.where(drawn & F.lit(buckets > 1)), buckets, _BEFORE)
        again = _judged(_by_bytes_before(parted, before), before, _BEFORE, "before")
        found = found.unionByName(spans(again)).unionByName(_parted_twice(again.where("context is not null")))
    return cut(found.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("found")))


def _cut_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, docs = text_bytes(batch.column("text"))
    data = raw.tobytes()
    out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans")}
    copies = batch.column("copies").to_pylist()
    for row, found in enumerate(batch.column("found").to_pylist()):
        low, n = int(docs[row]), int(docs[row + 1] - docs[row])
        ranges = [(0, n)] if copies[row] > 1 and n >= LENGTH else sorted((x["low"], x["high"]) for x in found or ())
        spans: list[list[int]] = []
        for s, e in ranges:
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([s, e])
        kept, at = [], 0
        for s, e in spans:
            kept.append(data[low + at : low + s])
            at = e
        rest = b"".join([*kept, data[low + at : low + n]])
        for k, v in (("n_bytes", n), ("n_removed", n - len(rest)), ("n_spans", len(spans)), ("kept_sha256", hashlib.sha256(rest).hexdigest()), ("kept_text", rest.decode(errors="ignore")), ("spans", [{"low": s, "high": e} for s, e in spans])):
            out[k].append(v)
    span = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), span]
    return pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], ["key", *out])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, spans), a row per row of docs."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("key"), "doc_id", "text")
    texts = cut_bucketed(rows.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "key")

    found = cut(map_batches(texts.where(F.octet_length("text") >= LENGTH).select("key", "text"), _anchor_rows, "gram long, key binary, place int"))
    again = cut(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    wanted = cut(found.join(again, "gram", "left_semi").groupBy("key").agg(F.collect_list("place").alias("places")))
    discard(found)

    spans = spans_of(texts, wanted, bucket)
    result = map_batches(texts.join(spans, "key", "left"), _cut_rows, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, spans array<struct<low: int, high: int>>")
    return rows.select("doc_id", "key").join(result, "key").drop("key")


def op5_repeats(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return cut_repeats(read_table(spark, sf_dir, "documents")).drop("kept_text", "spans")
