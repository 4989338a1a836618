"""Invariants between queries, and the shape of physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from shelfscope.plans import dashboard, facts, packs, reports
from shelfscope.plans.facts import Levels
from shelfscope.plans.loading import flat_table
from shelfscope.registry import SPECS, SLICES
from shelfscope.schema import PRODUCTS
from shelfscope.sources.derived import products as derive

c = F.col


def one(df):
    (row,) = df.collect()
    return row.asDict()


@pytest.fixture(scope="module")
def levels(products):
    return facts.build_levels(products).persist()


@pytest.fixture(scope="module")
def documents(products):
    return {r.pack_id: r for r in packs.insight_packs(products, SPECS).collect()}


@pytest.fixture(scope="module")
def table(spark, products, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("catalogue") / "t")
    products.write.parquet(path)
    return spark.read.parquet(path)


def test_bands_and_brands_add_up(products):
    rows = one(reports.report("row_counts", products))["products"]
    for name in ("discount_bands", "price_bucket_distribution", "rating_distribution", "image_count_vs_rating"):
        assert sum(r["items"] for r in reports.report(name, products).collect()) == rows, name
    brands = products.groupBy("brand").count().count()
    shares = reports.brand_concentration(facts.Rows(products), brands)
    assert sum(r["items"] for r in shares.collect()) == rows
    rated = one(reports.report("ratings_coverage", products))
    assert rated["rated_items"] + rated["unrated_items"] == rows
    by_band = {r.band: r["items"] for r in reports.report("rating_by_discount_band", products).collect()}
    assert by_band == {r.band: r["items"] for r in reports.report("discount_bands", products).collect()}


def test_markdown_agrees_with_averages(products):
    priced = products.filter("price IS NOT NULL")
    kpis = one(reports.report("core_kpis", priced))
    expected = priced.count() * (kpis["avg_mrp"] - kpis["avg_price"])
    assert one(reports.report("total_markdown_value", priced))["total_markdown_value"] == pytest.approx(expected, rel=1e-5)


def test_levels_hold_a_row_per_brand_and_per_bands(products, levels):
    brands = products.select("brand").distinct().count()
    kinds = {r.level: r["count"] for r in levels.groupBy("level").count().collect()}
    assert kinds["brand"] == brands and 0 < kinds["bands"] <= 600


def test_levels_of_parts_add_up(products, levels):
    parts = [facts.build_levels(products.filter(F.col("style_id") % 3 == k)) for k in range(3)]
    merged = facts.merge_levels(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    plain = [c for c, kind in merged.dtypes if kind != "double"]
    assert sorted(merged.select(plain).collect(), key=str) == sorted(levels.select(plain).collect(), key=str)


def test_zero_band_is_not_the_no_discount_count(spark):
    values = {"product_id": 1, "price": 999.99, "mrp": 1000.0, "discount_percent": 0.0}
    shelf = spark.createDataFrame([tuple(values.get(n) for n in PRODUCTS.names)], PRODUCTS)
    assert one(reports.report("core_kpis", shelf))["no_discount_items"] == 0
    assert one(reports.report("discount_bands", shelf)) == {"band": "0%", "items": 1}


def test_empty_table(spark):
    empty = spark.createDataFrame([], PRODUCTS)
    kpis = {"avg_price": None, "avg_mrp": None, "avg_discount_pct": None, "no_discount_items": None}
    levels = facts.build_levels(empty)
    for found in (reports.report("core_kpis", empty), reports.core_kpis(Levels(levels))):
        assert one(found) == kpis
    for found in (reports.report("row_counts", empty), reports.row_counts(Levels(levels))):
        assert one(found) == {"products": 0, "brands": 0}
    assert reports.report("brand_concentration_top20", empty).collect() == []
    assert one(packs.pack_core_kpis(empty, SPECS["everything"])) == {k: 0 for k in packs.KPIS}


@pytest.mark.parametrize("name", reports.AGGREGATES)
def test_levels_give_the_same_report(products, levels, name):
    assert reports.AGGREGATES[name](Levels(levels)).collect() == reports.report(name, products).collect()


@pytest.mark.parametrize("name", dashboard.AGGREGATES)
def test_levels_give_the_same_panel(products, levels, name):
    expected = dashboard.panel(name, products).collect()
    assert sorted(dashboard.AGGREGATES[name](Levels(levels)).collect(), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("name", SPECS)
def test_pack_document_equals_its_questions(products, documents, name):
    spec, pack = SPECS[name], documents[name]
    assert pack.kpis.asDict() == one(packs.pack_core_kpis(products, spec))
    assert pack.tables.brand_concentration == packs.pack_brand_concentration(products, spec).collect()
    assert pack.tables.discount_bands == packs.pack_discount_bands(products, spec).collect()
    assert pack.tables.top_discounted_rated == packs.pack_top_discounted_rated(products, spec).collect()


def test_pack_details(products, documents):
    assert documents["nothing"].bullets == ["No items match the current filters."]
    assert documents["nothing"].kpis.asDict() == {k: 0 for k in packs.KPIS}
    assert len(documents["rich_media"].tables.top_discounted_rated) == 1
    everything = documents["everything"]
    assert {k: everything.kpis[k] for k in packs.KPIS[:4]} == one(reports.report("core_kpis", products))
    plain, rated = documents["one_brand_discounted"], documents["one_brand_well_rated"]
    assert plain.kpis == rated.kpis and plain.tables.discount_bands == rated.tables.discount_bands
    assert plain.tables.top_discounted_rated != rated.tables.top_discounted_rated
    assert len(documents) == len(SLICES)


def test_rating_clauses_can_apply_to_everything(products):
    spec = SPECS["one_brand_well_rated"]
    row = one(packs.insight_pack(products, spec, include_rating=True))
    assert row["kpis"].asDict() == one(packs.pack_core_kpis(products, spec, include_rating=True))


def test_missing_brand_reads_none(spark):
    values = {"product_id": 1, "price": 1234.5, "mrp": 2000.0, "discount_percent": 38.275}
    shelf = spark.createDataFrame([tuple(values.get(n) for n in PRODUCTS.names)], PRODUCTS)
    assert [r.bullet for r in packs.pack_bullets(shelf, SPECS["everything"]).collect()] == [
        "Avg price ₹1,234.50, avg MRP ₹2,000.00, avg discount 38.28% across 1 items.",
        "0 items are at MRP (0% discount).",
        "Top brand: None with 1 items (~100.00%).",
        "Largest discount band: 20-40% at 1 items (~100.0%).",
    ]


def test_hot_keys_give_whole_results(spark, products):
    """One brand, title and price hold most of the rows."""
    hot = products.withColumn("brand", F.lit("hot")).withColumn("title", F.lit("copy")).withColumn("price", F.lit(5.0))
    both = products.unionByName(hot).unionByName(hot).repartition(12)
    n = products.count()
    top = reports.report("brand_concentration_top20", both).first()
    assert (top.brand, top["items"], top.share_pct) == ("hot", 2 * n, 66.67)
    assert tuple(reports.report("duplicate_titles_top50", both).first()) == ("copy", 2 * n)
    documents = packs.insight_packs(both, {"everything": SPECS["everything"], "well_rated": SPECS["discounted_well_rated"]})
    assert documents.filter("pack_id = 'everything'").first().kpis.products == 3 * n
    rated = flat_table(documents, "top_discounted_rated").filter("pack_id = 'well_rated'").drop("pack_id", "position")
    assert rated.collect() == packs.pack_top_discounted_rated(both, SPECS["discounted_well_rated"]).collect()


# --- physical plans -----------------------------------------------------------------


def plan(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_and_no_cross_join_anywhere(spark):
    frames = [reports.report(n, derive(spark, DATA)) for n in reports.NAMES]
    frames += [dashboard.panel(n, derive(spark, DATA)) for n in dashboard.PANELS]
    frames.append(packs.insight_packs(derive(spark, DATA), SPECS))
    for df in frames:
        text = plan(df)
        for word in ("Python", "Pandas", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in text


def test_filters_and_columns_reach_the_scan(spark, table):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    text = plan(packs.pack_core_kpis(table, SPECS["mid_discount"]))
    assert "GreaterThanOrEqual(discount_percent,20.0)" in text and "Not(EqualTo(brand,Brand#2))" in text
    assert "ReadSchema: struct<brand:string,price:double,mrp:double,discount_percent:double>" in text
    assert "ReadSchema: struct<discount_percent:double>" in plan(reports.report("discount_bands", table))


def test_short_lists_use_bounded_heaps(table):
    for name in ("top_rated_by_volume", "highest_discounts_rated"):
        text = plan(reports.report(name, table))
        assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert plan(reports.report("sample_price_vs_mrp", table)).count("WindowGroupLimit") == 2


def test_share_reuses_the_counts(table):
    df = reports.report("brand_concentration_top20", table)
    df.collect()
    text = df._jdf.queryExecution().toString()
    assert "ReusedExchange" in text and "rangepartitioning" not in text


def test_scans_do_not_grow_with_the_number_of_packs(table, capsys):
    def scans(df):
        df.explain("formatted")
        return len(re.findall(r"^\(\d+\) Scan parquet", capsys.readouterr().out, re.M))

    assert scans(packs.pack_cube(table, SPECS)) == 1
    assert scans(packs.insight_packs(table, SPECS)) == 3
    assert scans(packs.insight_packs(table, {"one": SPECS["everything"]})) == 3
