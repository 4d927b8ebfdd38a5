"""Physical-plan shape checks: the operators compile to the intended strategies."""

from catalytics.plans import listing_queries as LQ
from catalytics.plans import retrieval_queries as RQ
from catalytics.plans import variant_queries as VQ
from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(LQ.q_topk_score(spark, SF_SMALL))


def test_most_expensive_uses_window_group_limit(spark):
    p = VQ.q_most_expensive(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in p


def test_retrieval_top_n_uses_window_group_limit(spark):
    p = RQ.q_retrieve_topn(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in p


def test_no_python_in_cleaning_and_aggregates(spark):
    for q in (LQ.q_topk_score, LQ.q_clean_dialect_b, LQ.q_listing_kpis_c, VQ.q_variant_kpis,
              VQ.q_products_by_vendor, RQ.q_retrieve_topn):
        p = plan(q(spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, q.__name__


def test_no_cartesian_products(spark):
    for q in (LQ.q_topk_score, LQ.q_price_band, VQ.q_variant_kpis, RQ.q_retrieve_topn, RQ.q_prompts):
        p = plan(q(spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, q.__name__


def test_scan_prunes_columns(spark):
    from catalytics.session import read_table
    from pyspark.sql import functions as F
    df = read_table(spark, SF_SMALL, "lineitem").where(F.col("l_quantity") > 10).select("l_partkey")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in p


def test_transcripts_do_not_gather_groups(spark):
    from catalytics.plans import retrieval_queries as RQ2
    p = plan(RQ2.q_transcripts(spark, SF_SMALL))
    assert "collect_list" not in p


def test_window_group_limit_is_partial_before_shuffle(spark):
    df = VQ.q_most_expensive(spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p and "Partial" in p


def test_landed_store_facet_prunes_partitions(spark):
    df = VQ.q_landed_store_facet(spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(store_domain" in p and VQ.PROBE_STORE in p


def test_topk_is_prefix_of_full_sort(spark):
    from pyspark.sql import functions as F
    top = [r.row_seq for r in LQ.q_topk_score(spark, SF_SMALL).orderBy(F.desc("score"), "row_seq").collect()]
    full = [r.row_seq for r in LQ.filtered_a(spark, SF_SMALL).orderBy(F.desc("score"), "row_seq").collect()]
    assert top == full[:10]


def test_variant_kpis_add_up(spark):
    k = VQ.q_variant_kpis(spark, SF_SMALL).collect()[0]
    assert k.available_variants + k.unavailable_variants == k.variants


def test_exact_quantiles_gather_no_value_maps(spark):
    from catalytics.plans import ml_queries as MQ

    for q in (VQ.q_variant_kpis, LQ.q_describe, MQ.q_ml_labels):
        assert "ObjectHashAggregate" not in plan(q(spark, SF_SMALL)), q.__name__


def test_display_plans_have_no_python(spark):
    for q in (LQ.q_display_fields, LQ.q_display_no_discount, LQ.q_display_grid, LQ.q_kpi_display, VQ.q_variant_kpi_display):
        assert "Python" not in plan(q(spark, SF_SMALL)), q.__name__


def test_orders_is_read_for_its_dates_only(spark):
    assert "orders.parquet" not in plan(VQ.q_availability(spark, SF_SMALL))
    assert "orders.parquet" in plan(VQ.q_variant_clean(spark, SF_SMALL))


def test_landing_shuffles_rows_without_made_texts(spark, monkeypatch):
    """The shuffle before the partitioned write carries the joined columns; texts are made of them behind it."""
    seen = []
    monkeypatch.setattr(VQ.files, "write_table", lambda df, path, partition_by: seen.append(df._jdf.queryExecution().optimizedPlan().toString()))
    VQ.land_variants(spark, SF_SMALL, "unused")
    above, below = seen[0].split("RepartitionByExpression", 1)
    assert "<p>" in above and "<p>" not in below and "cdn.example.com" not in below


def test_long_csv_is_written_without_the_joins_above_it(spark, monkeypatch):
    """One writing task for several parts must not hold the joins of all of them."""
    from catalytics.plans import io_queries as IQ
    seen = []
    monkeypatch.setattr(IQ.files, "write_csv", lambda df, path: seen.append(df._jdf.queryExecution().executedPlan().toString()))
    monkeypatch.setattr(IQ.quoted_csv, "read", lambda spark, path, schema: spark.createDataFrame([], schema))
    IQ.q_csv_multiline(spark, SF_SMALL)
    assert "Coalesce" in seen[0] and "Join" not in seen[0]


def test_a_json_page_is_parsed_once(spark):
    """No filter on the parsed array repeats the parsing; pages without products give no row, a null product gives one."""
    from catalytics.sources import documents
    pages = [("s", '{"products": [{"id": 1, "variants": [{"id": 11}, {"id": 12}]}, null, {"id": 2}]}'), ("s", '{"products": []}'), ("s", "{}"), ("s", None)]
    flat = documents.flatten(documents.parse_pages(spark.createDataFrame(pages, "store_domain string, value string")))
    assert plan(flat).count("from_json") == 1
    assert sorted((r.product_id or 0, r.variant_id or 0) for r in flat.collect()) == [(0, 0), (1, 11), (1, 12), (2, 0)]
