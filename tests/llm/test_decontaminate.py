import hashlib
import pickle
import re

from rosterlane.llm.decontaminate import _Index, benchmark_blocks, decontaminate, op2_decontaminate, uncontaminated
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(text, items):
    w = words(text)
    hit, of = set(), set()
    for item, it in items:
        b = words(it)
        n = min(13, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                of.add(str(item))
    return len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def check(rows, expect):
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=repr)
    assert got == sorted(((i, *e) for i, e in expect), key=repr)


def test_query_against_brute_force(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = op2_decontaminate(spark, sf_dir).collect()
    check(rows, [(i, brute(t, items)) for i, t in cases.corpus(spark, sf_dir)])
    assert any(r.contaminated for r in rows) and not all(r.contaminated for r in rows)


def test_awkward_rows_short_items_and_blocks(spark):
    items = [(1, "Fox jumps"), (1, "fox jumps"), (2, "the lazy dog near the old river bank while seven grey geese fly south the quick"), (3, ""), (4, None), (10, "WORD")]
    bench = spark.createDataFrame([*items, (None, "one")], "item_id long, text string")
    docs = cases.frame(spark, ["n_words", "other"])
    one = decontaminate(docs, bench)
    assert set(one.columns) == {"doc_id", "text", "lang", "source", "n_chars", "other", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text"}
    expect = [(r[0], brute(r[1], [x for x in items if x[1]])) for r in cases.rows()]
    check(one.collect(), expect)
    many = decontaminate(docs, bench, block_bytes=40)
    check(many.collect(), expect)
    by = {r.doc_id: r.clean_text for r in one.collect() if r.doc_id is not None}
    assert by[0] is None and by[1] == "" and by[3] == "one" and "fox" not in by[5] and not by[4].strip()
    assert decontaminate(cases.empty(spark), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_blocks_come_one_at_a_time_bounded_by_windows_and_small(spark, monkeypatch):
    items = [(k, " ".join(f"w{(k * 7 + j * j) % 50}" for j in range(40))) for k in range(60)] + [(99, "again and again " * 30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    n, blocks = benchmark_blocks(bench, "item_id", "text", 1 << 30, 600)
    assert n == 10 and iter(blocks) is blocks
    sizes = [sum(len(words(t)) for _, t in b) for b in blocks]
    assert len(sizes) == n and sum(sizes) == 60 * 40 + 90
    index = _Index([(str(i), " ".join(f"word{i}x{j}" for j in range(1000))) for i in range(100)], 13)
    index.coarse = None  # of a fixed size
    assert len(pickle.dumps(index)) < 45 * 100_000
    docs = [(k, t) for k, (_, t) in enumerate(items)] + [(200, "x " * 20 + items[3][1]), (201, "again and again " * 9), (202, "none of it")]
    for options in ({}, {"block_windows": 600}):
        got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench, **options).collect()
        check(got, [(i, brute(t, items)) for i, t in docs])
    monkeypatch.setattr("rosterlane.llm.decontaminate._SLICE", 100)
    cut_up = _Index([(str(i), t) for i, t in items], 13)
    assert sum(len(h) for h in cut_up.hashes.values()) == len({(i, tuple(words(t)[k : k + 13])) for i, t in items for k in range(len(words(t)) - 12)})


def test_uncontaminated_rows_keep_their_columns(spark):
    items = [(k, f"the phrase number {k} that nobody else would ever write in this very long order") for k in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = cases.frame(spark, ["n_words", "contaminated", "__k"])
    bad = docs.limit(0).unionByName(spark.createDataFrame([(77, items[3][1], "en", "s", 1, "mine", "mine", "mine")], docs.schema))
    for options in ({}, {"block_bytes": 300}):
        rows = uncontaminated(docs.unionByName(bad), bench, **options)
        assert rows.columns == docs.columns
        assert sorted(map(repr, rows.collect())) == sorted(map(repr, docs.collect()))
