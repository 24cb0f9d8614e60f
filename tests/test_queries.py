"""Queries against their SQL, and the entry module's contract."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402
from trailmark import plans  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = """a3_triples_to_entities c1_purge c9_delete_keep_refs h9_census_derived c2_upsert a20_dedupe_first_by_key b6_facet_energy_range b7_facet_weekday b9_faceted_query b11_path_join b14_rdfs_closure b18_missing_fields
b21_find_saved_route c3_merge_patch c5_patch_diff c7_assign_lists c10_remap_iris c13_split_by_class c21_three_way_verdict c22_upsert_routes d2_rule_values d11_validate
e1_asof_tour e4_trip_candidates e5_best_trip e8_resolve_handles e9_near_duplicate_handles e10_hamming_dedup f2_route_stats f3_downsample_stride f4_resample_n f9_stops f10_visits
f15_integrate_power h1_folder_rollup h12_series_numbers h14_feed h17_tour_summary n1_leg_energy r1_fuse_dem r2_smooth_gaussian r6_box_smooth r9_grid_edges g15_half_edges
l1_validate_fix s1_text_keys s7_parse_folder_name s8_durations s12_dates s22_files s25_xml_and_paragraphs
a1_read_triples a7_census_rows a9_gpx_points a10_gpx_pois a11_track_points a11b_track_places a12_trip_points a14_decode_polyline a15_saved_route_geometry a15b_saved_route_places g5_filter_relations
g7_crossings g10_emit_edges g11_deck_flatten n6_swept_passes n9_repulsion_cost s15_sheet_and_exif s18_minute_round_local s24_archive_names d7_pattern_and_datatypes l7_peer_cap l8_snapshot_view g13_node_elevation
l8_stream_snapshot l9_batch_equivalent sql_faceted_query sql_path_join sql_class_counts sql_distances sql_half_edges sql_max_edge_cost sql_text_keys
a2_read_manifest_union a5_read_routes a6_read_saved_routes a8_read_sheet_csv a13_file_inventory a16_read_dem_cells a17_read_network_lines a18_write_routes a19_write_report d17_generate_fixtures f8_equirect_m g12_deck_chains g16b_baked_edges l4_last_points d15_shapes""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return "None" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted([plain(r[c]) for c in names] for r in df.collect())
    rel = con.sql(plans.SQL[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == sorted([plain(r[k]) for k in at] for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
