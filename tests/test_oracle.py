"""Spark vs DuckDB on sf0.001 for a sample of catalogue queries (the full set runs in scripts/oracle_check.py)."""

import duckdb
import pytest

from scripts.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
SAMPLE = ["prefix_summary", "prefixes", "case_labels", "dedup_events", "filter_rare_variants", "recent_pct",
          "lifecycle_collapse_occurrence", "split_random", "bucket_adaptive", "last_state_long", "target_encoding",
          "aggregated_to_events", "column_profile", "f1_macro_micro", "mae_medae", "ablation_row_counts",
          "running_case_prefix_long", "xes_source"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, con, name):
    import __spark_entry__ as E
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]
