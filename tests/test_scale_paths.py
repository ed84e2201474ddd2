"""The scale paths (many range buckets, chunked fixture files)
give the same answers as DuckDB on real tables; small data would otherwise always take
the single-bucket paths."""

import pytest

from oracle_check import digest, duck

SF = "/root/testdata/sf0.001"
NAMES = ["w1_fill_forward_rates", "w2_fill_backward_rates", "w1w2_fill_both_rates",
         "w4_pct_change_first_zero", "a8_quantiles_items", "a8_quantiles_by_category",
         "a9_iqr_outliers_items", "a14_box_by_category", "a15_histogram_items",
         "a13_categories_first_seen", "m21_merged_all", "a7_describe_mm_panel"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_forced_scale_paths(spark, con, monkeypatch, name):
    import __spark_entry__ as E
    from tidemark.operators import align
    monkeypatch.setattr(align, "ROWS_PER_BUCKET", 40)
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert digest(df.columns, rows) == digest(cols, cur.fetchall())
