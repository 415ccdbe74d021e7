from collections import Counter, defaultdict
from fractions import Fraction

from rosterlane.llm.mixing import WEIGHTS, in_mixed_order, in_slots, mix, one_period, op9_mixing, phases
from tests.llm import cases


def test_one_period_is_fair_to_less_than_a_block():
    for weights in ({"a": 1}, {"a": 5, "b": 3, "c": 1}, {f"s{i}": i + 1 for i in range(20)}, {"x": 0.999, "y": 0.001}):
        slots = in_slots(weights, 1024)
        assert sum(slots.values()) == 1024 and min(slots.values()) >= 1
        places = one_period(slots)
        assert sorted(t for p in places.values() for t in p) == list(range(1024))
        for s, n in slots.items():
            w = Fraction(n, 1024)
            assert all(i / w <= t + 1 and int(i / w) <= t < -(-(i + 1) // w) for i, t in enumerate(places[s]))
            for t in range(1025):
                assert abs(sum(p < t for p in places[s]) - w * t) < 1


def test_phases_use_every_block_once():
    blocks = {"a": 7, "b": 3000, "c": 40, "d": 1}
    plan = phases(blocks, {"a": 1.0, "b": 2.0, "c": 5.0, "d": 1.0}, 64)
    seen = Counter()
    for p in plan:
        for t in range(p["length"]):
            for s, places in p["places"].items():
                seen[s] += t % p["size"] in places
    assert seen == blocks and plan[-1]["begin"] + plan[-1]["length"] == sum(blocks.values())


def brute(docs, weights, block_bytes, period):
    """Earliest deadline first, slot by slot, over blocks counted one document at a time."""
    by = defaultdict(list)
    for i, t, s in docs:
        by[s].append((i, len((t or "").encode())))
    block_of, blocks = {}, {}
    for s, rows in by.items():
        at = 0
        for i, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
            block_of[i] = (s, at // block_bytes)
            blocks[s] = at // block_bytes + 1
            at += size
    wanted = {s: weights.get(s, min(weights.values())) for s in blocks}
    done, slot_of, t = dict.fromkeys(blocks, 0), {}, 0
    while True:
        active = {s: wanted[s] for s in blocks if done[s] < blocks[s]}
        if not active:
            break
        slots, start, begun = in_slots(active, max(period, len(active))), t, dict(done)
        size = sum(slots.values())
        while all(done[s] < blocks[s] for s in active):
            now = t - start
            ready = [(-(-(done[s] - begun[s] + 1) * size // slots[s]), s) for s in active if (done[s] - begun[s]) * size // slots[s] <= now]
            _, s = min(ready)
            slot_of[s, done[s]] = t
            done[s] += 1
            t += 1
    return {i: (s, b, slot_of[s, b]) for i, (s, b) in block_of.items()}


def test_query_against_slot_by_slot_schedule(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expect = brute(docs, WEIGHTS, 64 << 10, 1024)
    rows = op9_mixing(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.source, r.block, r.slot) for r in rows} == expect
    small = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS, block_bytes=3000, period=37).collect()
    assert {r.doc_id: (r.source, r.block, r.slot) for r in small} == brute(docs, WEIGHTS, 3000, 37)
    assert all(r.release <= r.slot < r.deadline for r in small)


def test_awkward_rows_and_order(spark):
    docs = cases.frame(spark, ["slot", "src"])
    got = mix(docs, block_bytes=100).collect()
    assert len(got) == len(cases.rows()) and {r.source for r in got} == {"s0", "s1", None}
    ordered = in_mixed_order(docs, block_bytes=100)
    assert ordered.columns == docs.columns and ordered.count() == len(cases.rows())
    first = {r.doc_id: (r.slot, r.place) for r in sorted(got, key=lambda r: (r.slot, r.place), reverse=True)}
    places = [first[r.doc_id] for r in ordered.collect()]
    assert places == sorted(places)
    assert mix(cases.empty(spark)).count() == 0 and in_mixed_order(cases.empty(spark)).count() == 0


def test_shares_follow_the_given_weights_not_rounded_ones(spark):
    weights = WEIGHTS | {f"src{i}": 1.0 for i in range(5, 20)}  # the sources of the test tables: a sum of 27
    rows = spark.range(30_000).selectExpr("id AS doc_id", "repeat('x', 10) AS text", "concat('src', CASE WHEN id % 27 < 4 THEN 0 WHEN id % 27 < 7 THEN 1 WHEN id % 27 < 9 THEN 2 WHEN id % 27 < 11 THEN 3 ELSE id % 27 - 7 END) AS source")
    got = mix(rows, WEIGHTS, block_bytes=10).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(30_000)) and all(r.release <= r.slot < r.deadline for r in got)
    done = Counter()
    for t, r in enumerate(got[:29_900], 1):
        done[r.source] += 1
        assert all(abs(done[s] - Fraction(w) * t / 27) < 1 for s, w in weights.items())


def test_small_and_long_weights_keep_their_shares():
    for weights in ({"a": 1.0, "b": 0.0001}, {"a": 0.1, "b": 0.2, "c": 0.7}, {"a": 1 / 3, "b": 1e-30, "c": 0.1234567890123}):
        exact = {s: Fraction(repr(w)) for s, w in weights.items()}
        total = sum(exact.values())
        plan = phases(dict.fromkeys(weights, 20_000), exact)[0]
        assert plan["size"] < 20_000 or sum(len(p) for p in plan["places"].values()) == plan["length"]
        at = {t: s for s, p in plan["places"].items() for t in p}
        done = Counter()
        for t in range(min(plan["length"], 25_000)):
            done[at[t % plan["size"]]] += 1
            assert all(abs(done[s] - w * (t + 1) / total) < 1 for s, w in exact.items())


def test_a_third_of_the_weight_among_two_thousand_sources():
    weights = {"hot": Fraction(1000)} | {f"s{i}": Fraction(1) for i in range(1999)}
    plan = phases({"hot": 400_000} | {f"s{i}": 400 for i in range(1999)}, weights)
    first = plan[0]
    at = {t: s for s, places in first["places"].items() for t in places}
    done, seen = Counter(), 0
    for t in range(first["length"] - first["length"] % first["size"]):
        s = at[t % first["size"]]
        done[s] += 1
        seen += s == "hot"
        assert abs(seen - Fraction(1000 * (t + 1), 2999)) < 1
        assert abs(done[s] - Fraction(int(weights[s]) * (t + 1), 2999)) < 1
    assert t > 1_000_000 and sum(p["length"] for p in plan) == 400_000 + 400 * 1999


def test_no_source_drifts_from_its_target_in_a_million_slots():
    weights = {s: Fraction(repr(w)) for s, w in WEIGHTS.items()} | {f"src{i}": Fraction(1) for i in range(5, 20)}
    first = phases(dict.fromkeys(weights, 10**6), weights)[0]
    at = [s for _, s in sorted((t, s) for s, places in first["places"].items() for t in places)]
    done, total = Counter(), sum(weights.values())
    for t in range(1_000_000):
        s = at[t % first["size"]]
        done[s] += 1
        assert abs(done[s] - weights[s] * (t + 1) / total) < 1
    assert all(abs(done[s] - w * 1_000_000 / total) < 1 for s, w in weights.items())
