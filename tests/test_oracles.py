"""Registered queries against their DuckDB SQL.

By default one query of every kind at sf0.001; SPANDOC_ALL=1 runs all of them (verify.py does
the same on any scale).
"""

import os

import pytest

import __spark_entry__ as entry
import verify

SF = "/root/testdata/sf0.001"
QUICK = [
    "profile_nulls", "join_validation", "span_text_match", "structure_stats", "group_inventory", "partition_status",
    "order_heuristic", "structure_features", "boundary_geometry", "label_positions", "surface_features",
    "transitions_window", "transitions_array", "metrics_rollup", "kappa_present_labels", "seed_aggregation",
    "bootstrap_pair", "comparison_rows", "gate_claim", "shuffle_labels", "random_boundary_shuffled", "control_checks",
    "structure_by_entity", "exemplars", "condition_pos_trans", "protocol_checks", "stratified_split", "kfold", "tfidf_weights", "head_tail_overfull", "residualized", "ridge_fixed", "exemplar_details",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("SPANDOC_ALL") else QUICK
ORDERED = ["event_spans", "chat"]


@pytest.fixture(scope="module")
def duck():
    return verify.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    msg = verify.compare(name, entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name])
    assert msg.startswith("ok") and "TYPES" not in msg, msg


@pytest.mark.parametrize("name", [
    "transitions_window", "structure_features", "boundary_geometry", "partition_status", "overlap_pairs", "order_vs_ordinal",
    "shuffle_labels", "rank_slots", "stratified_split", "kfold"])
def test_hot_entities_give_the_same_result(spark, duck, hot, name):
    msg = verify.compare(name, entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name])
    assert msg.startswith("ok"), msg


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
