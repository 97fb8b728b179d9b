"""The driver's contract, and a few queries beside DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["dependency_slice_edges", "impact_slice_nodes", "self_dependencies", "http_link_unique", "package_link", "slugify_names", "detection_actionable", "overlay_last_wins", "snapshot_state_diff", "mermaid_edges", "controller_resolution", "migration_foreign_keys", "edge_metadata_left_join", "focused_endpoint_links", "relink_http_delta", "text_index_markers", "analyzer_of_units", "json_manifest_declared"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 70


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_against_duckdb(spark):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in SOME:
        df = entry.queries()[name](spark, SF)
        cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
        got = sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))
        want = sorted(map(repr, con.execute(f"SELECT {cols} FROM ({entry.oracle_sql()[name]})").fetchall()))
        assert got == want, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
