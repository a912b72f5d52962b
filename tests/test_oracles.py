"""Queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from graphloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = """kg_metrics canonical_edges live_degree bridge_communities grounded_view context_items_budget context_hypotheses_budget agenda_detectors incident_labels
gen_bridge gen_seed gen_regroup gen_periphery gen_ensemble edge_dispositions merge_nodes merge_into_existing three_way_merge reconcile_forged krippendorff_alpha
ideation_scores precision_scoring idf_terms span_verification scrub_redact variety_erosion similarity_limits knn_novelty niche_elites ask_pairs preference_recall
audit_tail_stream context_whole json_tokens section_coverage sections_of_talks grounded_mix rekeyed_archive preference_summary materialized_pins pin_fates
payload_shapes kg_write propose_refusals receipts_replayed index_tables audit_ledger legacy_import topology_digest knn_join similarity_join kg_write_committed ledger_folded projection_after_edit persistent_flags merge_migrations merge_refusals
op_collapse operations kg_operate node_flood three_way_edges three_way_notes kg_context construction_ensemble""".split()


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "~" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con(request):
    from conftest import SF

    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, sf, con, name):
    got, want = plans.QUERIES[name](spark, sf).toPandas(), con.execute(plans.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(plans.ORACLE) <= set(plans.QUERIES)
