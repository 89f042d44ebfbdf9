import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
SOME = ("time6_fixed10_dekads", "src7_multiband_mosaic", "opt4_median_composite", "sos1_with_prior", "gate2_index_mode",
        "wb3_staged_short_rains", "exc2_aeration_stress", "cpi1_performance_index", "zone1_rasterize", "fuse7_gap_free_series",
        "zst7_levels", "val3_metrics", "plan_season_product")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_keeps_seasons_without_onset(spark):
    rows = entry.entry(spark).collect()
    assert rows and sum(r.n_seasons for r in rows) == 70


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cols, got = check.rows_of(df.columns, df.collect())
    cur = check.database(SF).execute(entry.oracle_sql()[name])
    ocols, want = check.rows_of([c[0] for c in cur.description], cur.fetchall())
    assert cols == ocols and len(got) == len(want)
    assert all(check.close(a, b) for a, b in zip(got, want))
