"""Trailing windows against a plain count, and the frames that they use."""

import random
import re

from lectern.operators import machines

SCHEMA = "event_id long, model string, us long, tokens long"


def test_like_a_plain_count(spark):
    rng = random.Random(4)
    rows = [(n, f"m{n % 2}", rng.choice((0, 1, 5_000_000, 9_999_999, 10_000_000, rng.randint(-30_000_000, 60_000_000))), rng.choice((None, 1, 7))) for n in range(300)]
    got = machines.trailing(spark.createDataFrame(rows, SCHEMA), "model", "us", "event_id", 10, "tokens")
    want = set()
    for n, model, us, tokens in rows:
        near = [t for _, m, u, t in rows if m == model and us - 10_000_000 <= u <= us]
        want.add((n, len(near) - 1, None if tokens is None else sum(t or 0 for t in near) - tokens))
    assert {tuple(r) for r in got.select("event_id", "calls_before", "amount_before").collect()} == want


def test_frames_only_grow(spark):
    """A frame that slides is summed anew for each row: as many steps as the slot's rows squared."""
    rows = machines.trailing(spark.createDataFrame([(1, "m", 5, 1)], SCHEMA), "model", "us", "event_id", 10, "tokens")
    frames = re.findall(r"specifiedwindowframe\(\w+, ([^,]+),", rows._jdf.queryExecution().optimizedPlan().toString())
    assert frames and {f.strip() for f in frames} == {"unboundedpreceding$()"}
