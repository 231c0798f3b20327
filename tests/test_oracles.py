"""Registered queries against their SQL on the smallest tables (all of them: check.py)."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, table

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "a04_monthly_change_stats a05_group_medians a10_merge_rate_by_month a15_describe_per_group a18_messages_per_pr "
    "c01_feature_table c05_second_order_leaves c07_exact_neighbours c07_nearest_neighbours c09_roc_auc c13_cutoff_tables c13_two_way_trees c14_definition_lifetimes c15_cohort_survival c16_next_modification "
    "c17_pr_text_pairs d02_added_code d06_change_record d10_symbol_changes d11_definitions j11_scores_joined_back "
    "k3_upsert_existing_wins l8_stratified_fraction m08_inputs_fully_patched r2_list_difference t1_mann_whitney t3_dunn_pairs t5_shapiro_wilk"
).split()
ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("ALL_ORACLES") else SAMPLE


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cur = db.execute(ORACLES[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
