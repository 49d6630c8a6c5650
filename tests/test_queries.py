"""Registered queries against their SQL, on the smallest tables."""

from pathlib import Path

import pytest

from groundspan import queries as q

FOLDER = Path("/root/testdata/sf0.001")
NAMES = ("a1_text_view", "c1_regex_native", "c3_slices", "c15_merge", "p6_boolean", "d10_merged_contexts", "d12_packed", "v1_cardinality_negatives", "g7_assign", "g10_compose", "q6_collect_contract", "e1_score_candidates", "e9_funnel", "e13_diff_instances", "sf1_decimals", "extract_objects", "e4_matches_contains", "e6_attributions", "e7_aggregates", "v4_layer1", "g5_cooccurrence", "r3_flat_negatives", "q1_request_id", "q2_render_submission", "q7_collect", "q7_problems", "d3_category", "d7_observations", "d26_collect_shards", "p7_drops", "p12_structural", "v11_repair_once", "v12_object_feedback", "c12_candidate_ids", "extract_instance_objects")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not FOLDER.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')" if path.is_dir() else f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    got = q.QUERIES[name](spark, str(FOLDER))
    columns = sorted(got.columns)
    want = duck.execute(q.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = [tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()]
    assert sorted(map(repr, (tuple(plain(r[c]) for c in columns) for r in got.collect()))) == sorted(map(repr, rows))
