"""What the plans of all queries must and must not have."""

import re

import pytest

from cuelattice.queries import QUERIES

FITTED = {"q16_svd_embedding", "q16_svd_identities", "q19_dimension_sweep", "q19_plane_sweep", "q20_ridge_cv_scores", "q20_plane_ridge_cv", "q20_self_scores", "q20_paired_scores", "q20_gram_matrix", "q32_label_masks"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"q16_svd_embedding"}))
def test_no_slow_path(name, spark, data):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    if name not in FITTED:
        assert not re.search("Python|Pandas|Arrow", text)


def test_scans_read_what_is_used(spark, data):
    read = lambda name: set(re.findall(r"ReadSchema: (struct<[^>]*>+)", plan(QUERIES[name](spark, data))))
    assert read("q07_shards") == {"struct<l_orderkey:bigint>"}
    assert read("q24_leaderboards") == {"struct<o_custkey:bigint,o_totalprice:double,o_orderstatus:string,o_orderpriority:string>", "struct<c_custkey:bigint,c_mktsegment:string>"} or all("o_orderdate" not in s and "c_name" not in s for s in read("q24_leaderboards"))
    assert all("n_chars" not in s and "lang" not in s for s in read("q01_assoc_unpivot"))


def test_filters_reach_the_scan(spark, data):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,P\)", plan(QUERIES["q31_upsert_keep_last"](spark, data)))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(o_totalprice,450000", plan(QUERIES["q17_strict_overlap"](spark, data)))


def test_samples_are_cut_before_the_shuffle(spark, data):
    assert "WindowGroupLimit" in plan(QUERIES["q07_group_sample"](spark, data)) and "WindowGroupLimit" in plan(QUERIES["q30_shard_merge_dedupe"](spark, data))
