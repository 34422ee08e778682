"""Plan-shape checks: the physical plans have the exchanges we designed, no more."""

from cohortkit.operators import generate as G
from cohortkit.sources.tables import load

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_shuffle_only_keys(spark):
    items = G.statistical_items(spark, load(spark, SF_SMALL, "customer", "c_custkey"))
    plan = _plan(items)
    # one exchange, of the customer keys, below the week and line explodes
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("Generate explode")


def test_receipts_one_exchange_before_fanout(spark):
    rec = G.statistical_receipts(spark, load(spark, SF_SMALL, "customer", "c_custkey"))
    plan = _plan(rec)
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(cust_key" in plan


def test_ks_windows_by_part(spark):
    from cohortkit.operators.fidelity import ks_statistic
    from cohortkit.sources.fixtures import receipts_fx
    plan = _plan(ks_statistic(spark, receipts_fx(spark, SF_SMALL)))
    # running sums of values are windows by (feature, part); the only window by a feature alone runs over the
    # totals of the parts
    assert "_part#" in plan and "SinglePartition" not in plan
    by_value = [x for x in plan.splitlines() if "Window [" in x and "ORDER BY" not in x and "value#" in x]
    assert by_value and all("_part#" in x for x in by_value)


def test_quantiles_and_histograms_keep_no_group_in_a_buffer(spark):
    from cohortkit.operators.fidelity import density_histogram, unpivot_features, weekly_spend_long
    from cohortkit.operators.utility import avg_weekly_spend_summary, spend_summary
    from cohortkit.sources.fixtures import receipts_fx
    r = receipts_fx(spark, SF_SMALL)
    for df in (density_histogram(unpivot_features(r)), density_histogram(weekly_spend_long(r)),
               spend_summary(spark, r), avg_weekly_spend_summary(r)):
        assert "percentile" not in _plan(df)


def test_top_n_reads_the_lines_once(spark):
    from cohortkit.operators.utility import top_n, value_counts
    from cohortkit.sources.fixtures import items_fx
    plan = _plan(top_n(value_counts(items_fx(spark, SF_SMALL), "item_name"), "item_name", 10))
    assert plan.count("ReadSchema: struct<l_orderkey") == 1 and "WindowGroupLimit" in plan


def test_scan_prunes_columns(spark):
    from cohortkit.sources.fixtures import receipts_fx
    plan = _plan(receipts_fx(spark, SF_SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan


def test_growing_tables_are_not_broadcast(spark):
    from cohortkit.operators.utility import value_counts
    from cohortkit.sources.fixtures import items_fx, receipts_fx, responses_fx
    for column in ("item_name", "category"):
        plan = _plan(value_counts(items_fx(spark, SF_SMALL), column))
        assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2
    for df in (receipts_fx(spark, SF_SMALL), responses_fx(spark, SF_SMALL)):
        plan = _plan(df)
        assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 3  # nation and region alone


def test_generated_receipts_are_hashed_not_sorted(spark):
    plan = _plan(G.statistical_receipts(spark, load(spark, SF_SMALL, "customer", "c_custkey"), keep_key=True))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_responses_are_parsed_and_their_lines_sorted_once(spark):
    from cohortkit.operators.validate import accepted_receipts, parse_responses
    from cohortkit.sources.fixtures import responses_fx
    raw = spark.createDataFrame([(1, "{}")], "attempt long, raw string")
    assert _plan(accepted_receipts(parse_responses(raw))).count("parseJson") == 1
    assert "ObjectHashAggregate" not in _plan(responses_fx(spark, SF_SMALL))
