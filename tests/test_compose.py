"""The composed pipeline refuses foreign rows, and its coded alignment is that of decoded vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators.codes import as_codes
from winnow.operators.compose import coded_alignment, require_train


def test_alignment_of_codes_equals_that_of_decoded_vectors(spark):
    rng = np.random.default_rng(0)
    d, c = rng.normal(size=(5, 7)), rng.normal(size=(30, 5)) * (rng.random((30, 5)) < 0.4)
    codes = as_codes(c)
    pairs = [list(zip(a.tolist(), w.tolist())) for a, w in zip(codes["atom"], codes["w"])]
    df = spark.createDataFrame(list(enumerate(pairs)), "id int, code array<struct<atom:int,w:double>>")
    center = (c[:10] @ d).sum(0)
    want = c @ d @ (center / np.linalg.norm(center))
    got = [r["s"] for r in df.withColumn("s", coded_alignment(df, "code", df.filter("id < 10"), d)).orderBy("id").collect()]
    assert got == pytest.approx(want)
    with pytest.raises(ValueError, match="vanishes"):
        coded_alignment(df, "code", df.filter("id < 0"), d)


def test_rows_of_other_splits_are_refused(spark):
    rows = spark.createDataFrame([("a", "train"), ("b", "tune")], "record_id string, split string")
    require_train(rows.filter(F.col("split") == "train"), "x")
    with pytest.raises(ValueError, match="not a training row"):
        require_train(rows, "x")


def test_selection_refill_and_plan_of_a_composed_run(spark):
    """Each step of a small composed run against the plain version of its rule, on what the step before handed on."""
    from test_selection import Table, check_swaps, plain_greedy

    from winnow.operators.compose import compose
    from winnow.operators.selection import SelectConfig

    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):
        cost = int(rng.integers(1, 5))
        labels = [-100] + [7] * cost
        rows.append((f"r{i}", f"c{i % 30}", "chat", "opening" if i % 3 == 0 else "followup", "s", "train", [1] + [7 + i] * cost, labels, "recipe", f"u{i % 7}", "observed",
                     rng.normal(size=6).tolist(), [1.0, float(np.log1p(cost))]))
    from winnow import schemas
    from winnow.operators.contracts import record_keys

    records = record_keys(spark.createDataFrame(rows, schemas.SFT + ", v array<double>, z array<double>"))
    config = SelectConfig(budget=60, keep_all_when_fits=False, provenance_cap=2, block=4)
    out = compose(records, "v", "z", F.col("domain") == "opening", 6, 2, 20, config, 100, atoms=4, swaps=6)
    pool = sorted(out.pool.collect(), key=lambda r: r["id"])
    assert len({r["root_id"] for r in pool}) == 20
    place = {r["id"]: i for i, r in enumerate(pool)}
    table = Table(np.array([r["coordinates"] for r in pool]), [r["cost"] for r in pool], [r["cell"] for r in pool], [r["provenance_group"] for r in pool], [0.0] * len(pool))
    chosen = [place[r["id"]] for r in out.selected.orderBy("rank").collect()]
    assert chosen == plain_greedy(table, config)
    d = out.bank.dictionary
    dense = np.zeros((len(pool), len(d)))
    for i, r in enumerate(pool):
        for c in r["code"]:
            dense[i, c["atom"]] = c["w"]
    center = (dense[[i for i, r in enumerate(pool) if r["domain"] == "opening"]] @ d).sum(0)
    score = np.round(dense @ d @ (center / np.linalg.norm(center)), 12)
    sides = [(r["id"], float(score[i]), r["cost"], r["cell"], r["provenance_group"], i in set(chosen)) for i, r in enumerate(pool)]
    swaps = [(r["id_in"], r["id_out"]) for r in sorted(out.swaps.collect(), key=lambda r: (-r["score_in"], r["id_in"]))]
    check_swaps(sides, swaps, 6, True, 2)
    kept = {pool[i]["id"] for i in chosen} - {j for _, j in swaps} | {i for i, _ in swaps}
    planned = out.plan.collect()
    assert {r["id"] for r in planned} <= kept and sum(r["response_tokens"] for r in planned) <= 100
    total = sum(pool[place[i]]["cost"] for i in kept)
    assert all(sum(r["id"] == i for r in planned) >= 100 // total for i in kept) and out.audit.count() == 0
