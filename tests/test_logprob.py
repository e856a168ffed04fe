"""Restricted log probabilities against plain sums, and what their plan may not contain."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators.catalog import legal_layout, restricted_logprob
from workload import all_queries

CATALOG = "item_id string, domain string, codes array<int>"
LOGITS = "record_id bigint, domain string, item_id string, depth int, code int, logit double"


def test_restricted_logprob_of_wide_masked_and_missing_logits(spark):
    """Logits far apart, masked by minus infinity, null, illegal, repeated and infinite."""
    rng = np.random.default_rng(5)
    codes = {f"i{n}": [int(rng.integers(3)), int(rng.integers(4)), n] for n in range(60)}
    allowed = {(i, d): {c[d] for c in codes.values() if c[:d] == codes[i][:d]} for i in codes for d in range(3)}
    rows, want = [], {}
    for record in range(300):
        item = f"i{rng.integers(60)}"
        scale, steps = [1.0, 70.0, 900.0, 1e5][record % 4], []
        for depth in range(3):
            legal = sorted(allowed[item, depth])
            logit = dict(zip(legal, (rng.normal(size=len(legal)) * scale).tolist()))
            own = codes[item][depth]
            if record % 5 == 1:
                logit |= {c: -math.inf for c in legal if c != own and rng.random() < 0.5}
            if record % 7 == 1:
                logit |= {c: None for c in legal if c != own and rng.random() < 0.3}
            if record == 12:
                logit = dict.fromkeys(legal, -math.inf)
            if record == 13 and depth == 1:
                logit[own] = math.inf
            rows += [(record, "d", item, depth, c, x) for c, x in logit.items()] + [(record, "d", item, depth, 500, 1e6), (record, "d", item, depth, None, 1e7)]
            z = np.array([x for x in logit.values() if x is not None])
            steps.append(math.nan if z.max() in (math.inf, -math.inf) else logit[own] - z.max() - math.log(np.exp(z - z.max()).sum()))
        want[record] = (sum(steps), -sum(steps) / 3)
    layout = legal_layout(spark.createDataFrame([(i, "d", c) for i, c in codes.items()], CATALOG))
    got = restricted_logprob(spark.createDataFrame(rows, LOGITS), layout, ["record_id"]).collect()
    assert len(got) == 300 and all((r["logprob"], r["loss"]) == pytest.approx(want[r["record_id"]], rel=1e-9, abs=1e-9, nan_ok=True) for r in got)


def test_logits_are_neither_sorted_nor_dealt(spark):
    """The long table meets the layout where it lies and is summed there."""
    out = all_queries()["grf_restricted_logprob"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    long = plan[plan.index("ShuffledHashJoin"):]
    assert "Sort " not in long and long.count("Exchange") == 2 and long.index("Generate") < long.index("Exchange")
    assert out.select(F.count("*")).first()[0] == out.select("item_id").distinct().count()
