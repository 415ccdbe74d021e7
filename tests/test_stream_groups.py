"""Decisions whose issues share rows of state, against a row per issue."""

import random

from rosterlane.streaming import streams as st

from .test_streams import batches, decision, issue


def test_groups_of_issues_decide_like_single_ones(spark):
    rng = random.Random(7)
    big = 2**60 + 1  # more digits than a double holds
    parts = []
    for n in range(4):  # 90 minutes apart: what the second batch decides goes before the fourth
        rows = [issue(rng.choice([i, big + i]), rng.choice(["OPEN", "OPEN", "ACCEPTED"]), rng.choice(["phone", "availability_status"]), rng.choice(["v", None])) for i in range(30)] if n < 1 else []
        rows += [decision(rng.choice([i, big + i]), rng.choice(["accept", "reject"]), 90 * n + rng.randint(1, 59), rng.choice(["c", None])) for i in range(40) for _ in range(rng.randint(0, 2))]
        parts.append([(r[0], *r[1:3], big + 5, *r[4:]) if r[1] == "issue" else r for r in rows])
    single = batches(spark, parts, lambda s: st.decisions_stream(s, "60 minutes"), st.EVENT)
    few = batches(spark, parts, lambda s: st.decisions_stream(s, "60 minutes", groups=3), st.EVENT)
    assert [r for r, _ in few] == [r for r, _ in single]
    assert all(n <= 3 for _, n in few) and single[0][1] > 20
    told = [r for rows, _ in few for r in rows]
    assert len({r[5] for r in told}) == 6 and {r[1] for r in told} == {None, big + 5}
