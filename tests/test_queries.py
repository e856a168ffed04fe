"""Registered queries: one per family against its SQL, and what no registered plan may contain."""

import math

import duckdb
import pytest

from workload import all_queries, all_sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["src_partition_leaks", "hist_strict_history", "met_ranking_summary", "obs_group_advantages", "acq_rank_acquisition",
           "grf_legal_layout", "vec_signed_units", "sel_refill", "fro_proposal_menu", "smp_root_reservoir", "sel_quota_utility", "src_lines_pushed",
           "src_encode_table", "vec_farthest_first"]
PLANNED = ["hist_next_item_task", "met_ranking_per_query", "smp_weighted_draws", "obs_corrected_estimate", "grf_restricted_logprob",
           "sel_concentration", "fro_executable_distribution", "vec_nominate_rows"]


def plain(v):
    return ("",) if v is None or (isinstance(v, float) and math.isnan(v)) else (str(type(v).__name__), v if isinstance(v, (int, float, bool)) else str(v))


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = all_queries()[name](spark, SF)
    got = con.execute(all_sql()[name])
    names = [d[0] for d in got.description]
    order = sorted(df.columns)
    assert order == sorted(names)
    left = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    right = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall())
    assert left == right and left


@pytest.mark.parametrize("name", PLANNED)
def test_no_pairs_of_all_rows(spark, name):
    plan = all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())
