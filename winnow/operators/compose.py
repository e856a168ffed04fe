"""The steps from records to an audited exposure plan, run in a row over one pool."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.keys import hash48
from winnow.operators.codes import AtomBank, fit_atom_bank, gram_coordinates
from winnow.operators.contracts import plan_audit, require_clean, require_same_pool
from winnow.operators.exposure import exposure_schedule
from winnow.operators.refill import apply_swaps, refill
from winnow.operators.sampling import root_reservoir
from winnow.operators.selection import SelectConfig, budgeted_select
from winnow.plans.cut import cut


def require_train(rows: DataFrame, step: str) -> None:
    """Selection and plans take training rows only."""
    require_clean(rows.filter(F.coalesce(F.col("split") != "train", F.lit(True))).select("record_id", "split"), f"{step}: not a training row")


def coded_alignment(pool: DataFrame, code: str, task: DataFrame, d: np.ndarray) -> Column:
    """The product of a decoded code with the unit centroid of the task's decoded codes, as a column over pool.

    The dictionary moves into one weight per atom, so no row is ever decoded.
    """
    terms = task.select(F.explode(code).alias("c")).groupBy("c.atom").agg(F.sum("c.w").alias("s")).collect()  # one row per atom
    use = np.zeros(len(d))
    for r in terms:
        use[r["atom"]] = r["s"]
    center = use @ d
    size = float(np.linalg.norm(center))
    if not terms or size < 1e-12:
        raise ValueError("the task's centroid vanishes")
    per_atom = F.array(*[F.lit(float(x)) for x in d @ (center / size)])
    return F.aggregate(code, F.lit(0.0), lambda total, c: total + c["w"] * F.element_at(per_atom, c["atom"] + 1))


@dataclass
class Composed:
    bank: AtomBank
    pool: DataFrame
    selected: DataFrame
    swaps: DataFrame
    plan: DataFrame
    audit: DataFrame


def compose(
    records: DataFrame, v: str, z: str, task: Column, width: int, q: int, roots: int, config: SelectConfig, exposure: int,
    atoms: int = 8, sparsity: int = 2, swaps: int = 20, seed: int = 42,
) -> Composed:
    """Reservoir, atom bank, Gram coordinates, selection, alignment to a task, refill, exposure plan and its audit.

    records: keyed records (record_keys) with a vector v and nuisance z; `task` marks the rows whose centroid the refill leans to.
    Every step gets the pool of the step before, and a step over another pool is refused, as is a row that is not a training row.
    """
    drawn = cut(root_reservoir(records, "root_id", roots, seed))
    require_train(drawn, "reservoir")
    named = drawn.withColumn("id", hash48("record_id"))
    bank = fit_atom_bank(named, "id", v, z, width, q, atoms, sparsity, 4, seed)
    coded = cut(gram_coordinates(bank.transform(named, v, z, "code"), "code", bank.dictionary, "coordinates"))
    require_same_pool(drawn, coded)
    pool = coded.select(
        "id", F.col("coordinates").alias("z"), "cost", "cell", F.col("provenance_group").alias("grp"), F.lit(0.0).alias("utility"))
    chosen, _ = budgeted_select(pool, replace(config, seed=seed))
    chosen = cut(chosen)
    score = coded_alignment(coded, "code", coded.filter(task), bank.dictionary)
    sides = cut(coded.join(chosen.select("id", F.lit(True).alias("selected")), "id", "left").select(
        "id", F.round(score, 12).alias("score"), "cost", "cell", F.col("provenance_group").alias("grp"), F.coalesce("selected", F.lit(False)).alias("selected")))
    moved = cut(refill(sides, swaps, cap=config.provenance_cap))
    kept = apply_swaps(sides, moved).filter("selected").select("id")
    final = cut(coded.join(kept, "id", "left_semi").select(
        "id", "record_id", "cost", F.size("input_ids").alias("input_tokens"), "cell", "content_id", "split"))
    require_train(final, "plan")
    plan = cut(exposure_schedule(final.drop("split"), exposure, seed=seed).withColumnRenamed("cost", "response_tokens"))
    return Composed(bank, coded, chosen, moved, plan, plan_audit(plan, drawn))
