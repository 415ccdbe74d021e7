r"""MinHash near-duplicates through a multi-index Hamming join that loses no pair under the signature distance.

Method. A document's set is its distinct 5-word shingles (words `[^\x20\x09-\x0D]+`, A-Z lower-cased; a shorter
text is one shingle). Equal sets form one class. Each class has a signature of 64 MinHash symbols of 16 bits.
Two signatures within distance 26 agree, by the pigeonhole principle over 20 chunks (26 = 20 * 1 + 6), in one of
the first 7 chunks but for at most one symbol, or in one of the other 13 chunks exactly. So each signature is
filed under every one-symbol deletion of the first 7 chunks (the allowed error, enumerated) and under the other
13 chunks: 40 keys. At the least linked similarity, 0.85, a pair is beyond distance 26 with probability 1.6e-7. Shingles are 64-bit hashes under a key
drawn for the run (multilinear in a word's bytes, a chain over words), so no text can be made to collide.
Pairs that share a key are confirmed on the full shingle sets; links form connected components.

Scale. Two scans of the text. No key's members are expanded into all pairs at first: they are compared with one
leader, the links contract components, and only keys whose members still lie in different components go on,
with another leader each round while that finds links; the documents that remain then are joined by an exact prefix
filter on how they differ from what their cluster shares, between different components, so no link between different
texts is lost. Candidate keys, sets and
links are tables in the shared folder; nothing is collected. Copies never meet: they are one class from the start.

Cases. Null or wordless text has an empty set: linked with nothing, its own component. Rows without an id are not
linked: component_id is null and kept is true. Rows that share an id are one document, also with different texts: what is
linked with one of them is in its component, and they stay or go together. Extra columns of the input
are ignored by near_duplicates(); deduplicate() returns the input's columns.
"""

from __future__ import annotations

import secrets
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches
from .words import SPACED, chained, mix, words_of

SHINGLE = 5
SYMBOLS = 64
DISTANCE = 26
CHUNKS = 20
PERCENT = 85
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, (2, SYMBOLS), dtype=np.uint64)


def chunk_keys(symbols: int, chunks: int, distance: int) -> list[tuple[int, ...]]:
    """The symbol positions of each key: for the first distance % chunks + 1 chunks all but `errors` symbols, for the others all but errors - 1."""
    from itertools import combinations

    errors, more = divmod(distance, chunks)
    wide = more + 1
    weights = [errors + 3] * wide + [errors + 2] * (chunks - wide)  # the chunks that allow more errors are longer
    cuts = np.round(np.cumsum([0, *weights]) * symbols / sum(weights)).astype(int)
    keys = []
    for c in range(chunks):
        at, drop = range(cuts[c], cuts[c + 1]), errors if c < wide else errors - 1
        keys += list(combinations(at, max(1, len(at) - max(0, drop))))
    return keys


_KEYS = chunk_keys(SYMBOLS, CHUNKS, DISTANCE)


def shingle_sets(column: pa.Array, key: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    w = words_of(column, SPACED, True)
    hashes, counts = w.hashes(key), np.diff(w.first)
    at, full = w.chains(hashes, SHINGLE)
    cuts = np.searchsorted(at, w.first)
    out = []
    for row, n in enumerate(counts.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(full[cuts[row] : cuts[row + 1]]))
        elif n:
            out.append(chained(hashes, w.first[row : row + 1], n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(batch: pa.RecordBatch, key: int = 0) -> pa.RecordBatch:
    sets = shingle_sets(batch.column("text"), key)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    full = np.flatnonzero(sizes)
    hi, lo = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    keys = np.zeros((len(full), len(_KEYS)), np.uint64)
    if len(full):
        every = np.concatenate([sets[i] for i in full])
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        hi[full] = np.add.reduceat(mix(every ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts)
        lo[full] = np.add.reduceat(mix(every + np.uint64(0x123456789ABCDEF1)), starts)
        signature = np.empty((SYMBOLS, len(full)), np.uint64)
        for k in range(SYMBOLS):
            signature[k] = np.minimum.reduceat(every * (_SEEDS[0, k] | np.uint64(1)) + _SEEDS[1, k], starts)
        signature = mix(signature) & np.uint64(0xFFFF)
        for j, at in enumerate(_KEYS):
            h = np.full(len(full), j + 1, np.uint64)
            for k in at:
                h = mix(h ^ (signature[k] << np.uint64(20)))
            keys[:, j] = h
    offsets = np.zeros(len(sets) + 1, np.int32)
    offsets[1:] = np.cumsum(np.where(sizes > 0, len(_KEYS), 0))
    as_long = lambda x: pa.array(x.view(np.int64))
    return pa.RecordBatch.from_arrays(
        [batch.column("id"), pa.array(sizes), as_long(hi), as_long(lo), pa.ListArray.from_arrays(pa.array(offsets), as_long(keys.reshape(-1)))],
        ["id", "n", "hi", "lo", "keys"],
    )


def _set_rows(batch: pa.RecordBatch, key: int = 0) -> pa.RecordBatch:
    sets = shingle_sets(batch.column("text"), key)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat.view(np.int64)))
    return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), lists], ["node", "n", "shingles"])


def _confirmed(batches):
    for batch in batches:
        good = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            a, b = (v.values.to_numpy() for v in (x, y))
            both = len(np.intersect1d(a, b, assume_unique=True))
            good.append(100 * both >= PERCENT * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "linked"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked) for pairs (a, b), by their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirmed, "a long, b long, linked boolean")


def contract(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Merge the components (node, root) that links (a, b) connect; a component's root is its least node.

    Each root points to its least neighbour, pointers are followed to their ends by doubling, and the links between
    what remains are mapped to the new roots, until none is left.
    """
    while True:
        ends = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = cut(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if edges.isEmpty():
            return roots
        point = cut(edges.groupBy(F.col("b").alias("r")).agg(F.min("a").alias("to")))  # only towards smaller roots: no cycles
        while True:
            ahead = point.select(F.col("r").alias("to"), F.col("to").alias("next"))
            jumped = cut(point.join(ahead, "to", "left").select("r", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            point = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        roots = cut(roots.join(point.withColumnRenamed("r", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    key = secrets.randbits(64)
    signed = cut(map_batches(base, partial(_signed, key=key), "id long, n long, hi long, lo long, keys array<long>"))
    named = signed.where("id is not null and n > 0")
    classes = cut(named.groupBy("hi", "lo").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys")))

    filed = classes.select("node", "n", F.explode("keys").alias("key"))
    shared = filed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    members = cut(filed.join(shared, "key", "left_semi"))
    nodes = members.select("node").distinct()
    texts = base.join(nodes.withColumnRenamed("node", "id"), "id", "left_semi")
    sets = cut(map_batches(texts, partial(_set_rows, key=key), "node long, n long, shingles array<long>").where("n > 0"))
    roots = components(members, sets, cut(nodes.select("node", F.col("node").alias("root"))))
    roots = join_shared_ids(named.select("id", "hi", "lo"), classes.select("hi", "lo", "node"), roots)

    named_root = classes.select("hi", "lo", "node").join(roots, "node", "left").select("hi", "lo", F.coalesce("root", "node").alias("root"))
    by_id = named.select("id", "hi", "lo").join(named_root, ["hi", "lo"]).groupBy("id").agg(F.min("root").alias("root"))
    linked = signed.select("id", "n").join(by_id, "id", "left")
    component = F.coalesce("root", "id")
    return linked.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def join_shared_ids(named: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """roots with the components of the different texts of one id made one; usually there are none."""
    sets = F.struct("hi", "lo")
    several = named.groupBy("id").agg(F.min(sets).alias("a"), F.max(sets).alias("b")).where("a <> b").select("id")
    held = cut(named.join(several, "id", "left_semi").join(classes, ["hi", "lo"]).select("id", "node"))
    least = held.groupBy("id").agg(F.min("node").alias("a"))
    links = cut(held.join(least, "id").where("a <> node").select("a", F.col("node").alias("b")).distinct())
    if links.isEmpty():
        return roots
    more = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti")
    return contract(cut(roots.unionByName(more.select("node", F.col("node").alias("root")))), links)


def components(members: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) after all links between members that share a key."""
    tried, turn, last = None, 0, False
    while True:
        placed = members.join(roots, "node")
        open_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "root", "n")).alias("lead")).where("lo < hi").select("key", "lead")
        if last:
            left = cut(placed.join(open_keys.select("key"), "key", "left_semi").select("key", "node", "root"))
            pairs = prefix_pairs(left.select("node", "root").distinct().join(sets.dropDuplicates(["node", "shingles"]), "node"), left.select("key", "node"))
        else:
            led = placed.join(open_keys, "key").where((F.col("root") != F.col("lead.root")) & _sizes("n", "lead.n"))
            pairs = led.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        judged = cut(confirm(pairs, sets))
        n, n_linked = judged.agg(F.count("*"), F.count_if("linked")).first()
        if n_linked:
            roots = contract(roots, judged.where("linked").select("a", "b"))
        if last:
            return roots
        tried = judged.select("a", "b") if tried is None else tried.unionByName(judged.select("a", "b"))
        turn += 1
        last = 4 * n_linked < n or not n  # leaders no longer find much: join what is left


def prefix_pairs(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): all pairs of rows (node, root, n, shingles) of different roots that share a key of members and may be linked.

    Rows that keys connect are a cluster; P is what a fifth of a cluster's rows share. Sets differ by as much as their differences A', B'
    from P do, and linked sets differ by at most t = |A| + |B| - 2 ceil(0.85 (|A| + |B|) / 1.85). So |A'| + |B'| <= t, or A' and B' share
    at least half of what is beyond. In a common order (least frequent first) the places of the first shared element bound that share:
    near copies that each differ from the rest in their own way propose no pair.
    """
    by_key = members.groupBy("key").agg(F.min("node").alias("a"))
    linked = members.join(by_key, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    clusters = contract(cut(rows.select("node", F.col("node").alias("root"))), cut(linked)).withColumnRenamed("root", "cluster")
    every = cut(rows.join(clusters, "node").select("cluster", "node", F.xxhash64("shingles").alias("u"), "root", "n", "shingles"))  # u: rows may share an id
    each = every.select("cluster", "node", "u", "root", "n", F.explode("shingles").alias("g"))
    sizes = every.groupBy("cluster").agg(F.count("*").alias("of"))
    often = cut(each.groupBy("cluster", "g").agg(F.count("*").alias("df")).join(sizes, "cluster").withColumn("common", (F.col("of") > 2) & (5 * F.col("df") > F.col("of"))))
    common = often.where("common").select("cluster", "g", (F.col("of") - F.col("df")).alias("f"))
    extra = each.join(often.where("not common").select("cluster", "g", F.col("df").alias("f")), ["cluster", "g"])
    lacking = every.drop("shingles").join(common, "cluster").join(each.select("cluster", "node", "u", "g"), ["cluster", "node", "u", "g"], "left_anti")
    columns = ["cluster", "node", "u", "root", "n", "g", "f"]
    primed = cut(extra.select(*columns, F.lit(False).alias("lack")).unionByName(lacking.select(*columns, F.lit(True).alias("lack"))))
    by_node = Window.partitionBy("cluster", "node", "u")
    placed = primed.withColumn("size", F.count("*").over(by_node)).withColumn("at", F.row_number().over(by_node.orderBy("f", "g", "lack")))
    least = (F.col("size") + 1 - 0.1765 * F.col("n")) / 2
    first = cut(placed.where((F.col("f") > 1) & (1 + F.col("size") - F.col("at") >= least)))
    x, y = first.alias("x"), first.alias("y")
    both = F.col("x.n") + F.col("y.n")
    apart = both - 2 * F.ceil(PERCENT * both / (100 + PERCENT))
    other = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _sizes("x.n", "y.n")
    beyond = F.col("x.size") + F.col("y.size") - apart
    rest = 1 + F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    same = (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.lack") == F.col("y.lack"))
    shared = x.join(y, same & other & (2 * rest >= beyond)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    sized = primed.groupBy("cluster", "node", "u").agg(F.count("*").alias("size"))
    near = cut(every.drop("shingles").join(sized, ["cluster", "node", "u"], "left").fillna(0, ["size"]).where(F.col("size") <= 0.1765 * F.col("n")))
    mixed = near.groupBy("cluster").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cluster")
    return shared.unionByName(close_links(cut(near.join(mixed, "cluster", "left_semi"))))


def close_links(rows: DataFrame) -> DataFrame:
    """(a, b): links that connect all rows (cluster, node, root, n, size) whose sizes together are within what linked sets may differ by.

    Such rows are linked whatever they hold. slack(x) + slack(y) <= 0 is necessary for it, and sufficient but for rounding. So all that
    is linked with anything is linked with the row of least slack, but for rows where rounding decides; these are compared with
    one row of each pair (n, size), and rows of the same pair follow the first of them.
    """
    linked, unlinked = 100 + PERCENT, 100 - PERCENT
    slack = linked * F.col("size") - unlinked * F.col("n")
    both = F.col("x.n") + F.col("y.n")
    is_close = F.col("x.size") + F.col("y.size") <= both - 2 * F.ceil(PERCENT * both / linked)
    rows = rows.withColumn("slack", slack)
    hub = rows.groupBy("cluster").agg(F.min_by(F.struct("node", "root", "n", "size", "slack"), F.struct("slack", "node")).alias("y"))
    met = cut(rows.withColumn("x", F.struct("node", "root", "n", "size", "slack")).select("cluster", "x").join(hub, "cluster").where("x.node <> y.node and x.slack + y.slack <= 0").withColumn("close", is_close))
    direct = met.where("close")
    rest = met.where("not close").select("cluster", "x.*")
    one = F.min(F.struct("node", "root")).alias("one")
    kinds = rows.groupBy("cluster", "n", "size", "slack").agg(one, F.count("*").alias("k")).select("cluster", "n", "size", "slack", "one.*", "k")
    odd = kinds.join(rest.select("cluster", "n", "size").distinct(), ["cluster", "n", "size"], "left_semi")
    x, y = odd.alias("x"), kinds.alias("y")
    itself = (F.col("x.n") == F.col("y.n")) & (F.col("x.size") == F.col("y.size"))
    pairs = cut(x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.slack") + F.col("y.slack") <= 0) & is_close & (~itself | (F.col("y.k") > 1))).select(F.col("x.cluster").alias("cluster"), F.col("x.n").alias("n"), F.col("x.size").alias("size"), F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    follow = rest.join(pairs.groupBy("cluster", "n", "size").agg(F.min("b").alias("b")), ["cluster", "n", "size"]).select(F.col("node").alias("a"), "b")
    every = direct.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).unionByName(pairs.select("a", "b")).unionByName(follow)
    return every.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _sizes(a: str, b: str):
    return 100 * F.least(F.col(a), F.col(b)) >= PERCENT * F.greatest(F.col(a), F.col(b))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates: the one with the least id."""
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return near_duplicates(read_table(spark, sf_dir, "documents"))
