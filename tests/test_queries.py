"""Registered queries against their SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from courtside.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = ["orders", "supplier"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    return v.isoformat()[:10] if isinstance(v, (datetime.date, datetime.datetime)) else v


CHECKED = ["s1_csv_scan", "s4_ensure_folder", "s8_output_frame", "s9_profile_report", "p10_text_columns", "p11_schema", "f19_two_decimals", "f23_required", "g18_window_sums", "o2_index_reset_split", "m3_scaler_parameters", "m6_metrics", "e1_pair_features_point_in_time", "s5_season_scan", "s6_union_files", "p2_side_swap", "p15_segment_routing", "j1_full_outer_counts", "j9_upsert_players", "g2_surface_map", "g6_histories", "g12_preferred_surface", "g19_metrics", "w4_running_totals", "o3_splits", "o6_holdout", "m2_median_imputer", "m9_serving_features", "x_state_snapshot", "x_pair_features_snapshot", "x_filled_features", "e1_before_match", "e2_streaming_state", "s5_mixed_headers", "j2_as_of_form", "j3_as_of_head_to_head", "j4_as_of_surface_form", "w1_running_last_n", "m4_first_splits", "m7_permuted_accuracy", "p13_point_lookup_kept", "j11_serving_pair_kept", "x_state_kept"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=repr)
    r = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert got == want and got


def test_every_oracle_has_a_query():
    assert oracles.oracle_sql().keys() <= queries.queries().keys()


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and e.oracle_sql().keys() <= e.queries().keys()
