"""Filters, top lists, shares, sinks and the ad-hoc surface."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import sinks, toplist
from shelfscope.operators.filters import ANALYST_KEYS, FilterSpec, predicate
from shelfscope.operators.shares import with_share
from shelfscope.plans import runner
from shelfscope.schema import PRODUCTS
from shelfscope.sources import adhoc


def product(i, **values):
    base = dict.fromkeys(PRODUCTS.names) | {"product_id": i} | values
    return tuple(base[n] for n in PRODUCTS.names)


@pytest.fixture(scope="module")
def shelf(spark):
    rows = [
        product(1, brand="4711", price=100.0, mrp=100.0, discount_percent=0.0, rating=4.0, rating_total=25, title="50% off"),
        product(2, brand="B", price=50.0, mrp=100.0, discount_percent=50.0, rating=3.0, rating_total=0, title="Sun Glasses"),
        product(3, brand=None, price=90.0, mrp=100.0, discount_percent=12.0, rating=5.0, rating_total=7, title="sunglasses x"),
        product(4, brand="C", price=999.99, mrp=1000.0, discount_percent=0.0, rating=0.0, rating_total=None, img_count=5),
        product(5, brand="B", price=None, mrp=10.0, title="a 50%"),
    ]
    return spark.createDataFrame(rows, PRODUCTS)


def ids(df):
    return sorted(r.product_id for r in df.collect())


@pytest.mark.parametrize(
    "values,rating,expected",
    [
        ({}, True, [1, 2, 3, 4, 5]),
        ({"brands": ["B", 4711]}, False, [1, 2, 5]),
        ({"brands": []}, False, [1, 2, 3, 4, 5]),
        ({"exclude_brands": ["B"]}, False, [1, 4]),
        ({"min_discount": 12.7}, False, [2, 3]),
        ({"max_discount": 12.7}, False, [1, 3, 4]),
        ({"min_discount": 0}, False, [1, 2, 3, 4]),
        ({"price_between": [50, 90]}, False, [2, 3]),
        ({"price_between": [50]}, False, [1, 2, 3, 4, 5]),
        ({"price_between": "ab"}, False, [1, 2, 3, 4, 5]),
        ({"mrp_between": (10, 100)}, False, [1, 2, 3, 5]),
        ({"img_count_between": [5.9, 99]}, False, [4]),
        ({"title_ilike": "SUNGL"}, False, [3]),
        ({"title_ilike": "sun_glasses"}, False, [2]),
        ({"title_ilike": "50%"}, False, [1]),
        ({"only_no_discount": True, "only_discounted": True}, False, [1]),
        ({"only_discounted": True}, False, [2, 3, 4]),
        ({"min_rating": 4, "max_rating": 4.5, "min_reviews": 25}, True, [1]),
        ({"min_rating": 4, "max_rating": 4.5, "min_reviews": 25}, False, [1, 2, 3, 4, 5]),
        ({"brands": ["B"], "max_discount": "", "title_ilike": None, "unknown": 3}, False, [2, 5]),
    ],
)
def test_filters(shelf, values, rating, expected):
    assert ids(shelf.filter(predicate(FilterSpec.from_dict(values), rating))) == expected


def test_filter_spec_details():
    assert FilterSpec.from_json("") == FilterSpec.from_json("{}") == FilterSpec()
    assert [FilterSpec(top_limit=n).rows for n in (0, 7, 5000)] == [1, 7, 1000]
    assert FilterSpec().rows == 10
    narrow = FilterSpec.from_dict({"brands": ["x"], "min_rating": 2, "max_rating": 3}, only=ANALYST_KEYS)
    assert narrow == FilterSpec(brands=("x",), min_rating=2.0)
    with pytest.raises(ValueError):
        FilterSpec(min_discount="many")


def test_top_rows_with_ties_nulls_and_one_hot_group(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 5)}", rng.choice([None, *range(40)]), i) for i in range(4000)]
    rows = spark.createDataFrame(data, "g string, x int, i int").repartition(16)
    order = toplist.by([toplist.desc("x")], ["i"])
    ranked = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
    for k in (5, 100, 300, 5000):
        assert [tuple(r) for r in toplist.top_rows(rows, order, k).collect()] == ranked[:k]
    bucket = F.when(F.col("x").isNull(), 1).otherwise(-F.floor(F.col("x") / 10)).cast("int")
    for k in (300, 5000):
        assert [tuple(r) for r in toplist.top_rows(rows, order, k, bucket).collect()] == ranked[:k]
    assert toplist.top_rows(rows.filter("x > 99"), order, 300, bucket).collect() == []
    for extra in ({}, {"lanes": False}, {"bucket": bucket}):
        got = toplist.top_rows_per_group(rows, "g", order, 50, **extra).collect()
        for g in {r[0] for r in data}:
            best = [r for r in ranked if r[0] == g][:50]
            assert sorted((r.position, r.g, r.x, r.i) for r in got if r.g == g) == [(n, *r) for n, r in enumerate(best, 1)]


def test_sample_is_repeatable_and_whole(spark):
    rows = spark.range(5000).withColumn("v", F.col("id") * 2)
    first = toplist.sample_rows(rows.repartition(3), 200, key=["id"]).collect()
    assert first == toplist.sample_rows(rows.repartition(11), 200, key=["id"]).collect()
    assert len({r.id for r in first}) == 200
    assert len({r.id for r in toplist.sample_rows(rows, 200, seed=1).collect()}) == 200
    assert toplist.sample_rows(rows, 9000, key=["id"]).count() == 5000


def test_shares(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("b", 0)], "brand string, items long")
    assert {r.brand: r.share_pct for r in with_share(rows).collect()} == {"a": 33.33, None: 66.67, "b": 0.0}
    assert [r.share_pct for r in with_share(rows.filter("items = 0")).collect()] == [0.0]


def test_append_counts_and_adds_up(shelf, tmp_path):
    table = str(tmp_path / "t")
    assert [sinks.append_products(shelf, table) for _ in range(2)] == [5, 5]
    back = shelf.sparkSession.read.parquet(table)
    assert back.count() == 10
    assert sum(r.rows_inserted for r in sinks.rows_per_partition(back).collect()) == 10


def test_report_files(shelf, tmp_path):
    path = str(tmp_path / "r")
    assert not sinks.write_report(shelf.filter("product_id > 99"), path)
    assert not glob.glob(path)
    assert sinks.write_report(shelf.select("product_id", "title").orderBy("product_id"), path, limit=2)
    (file,) = glob.glob(f"{path}/*.csv")
    assert open(file).read() == "product_id,title\n1,50% off\n2,Sun Glasses\n"


def test_batch_writes_every_report_and_survives_failures(shelf, tmp_path, monkeypatch):
    def broken(products):
        return products.select("no_such_column")

    monkeypatch.setitem(runner.reports.LISTS, "top_rated_by_volume", broken)
    late = lambda products: products.select(F.raise_error(F.lit("late")))
    monkeypatch.setitem(runner.reports.LISTS, "sample_price_vs_mrp", late)
    status = runner.write_all(shelf, str(tmp_path))
    assert status["top_rated_by_volume"].startswith("error")
    assert status["sample_price_vs_mrp"].startswith("error")
    assert status["duplicate_titles_top50"] == "no rows"
    assert status["core_kpis"] == "saved" and len(status) == 16
    assert {g.split("/")[-2] for g in glob.glob(f"{tmp_path}/*/*.csv")} == {n for n, s in status.items() if s == "saved"}


@pytest.mark.parametrize("sql", ["SELECT 1 AS x;", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "SELECT 1 AS x -- one", "VALUES (1) ; "])
def test_adhoc_accepts_queries(spark, sql):
    assert [tuple(r) for r in adhoc.select(spark, sql).collect()] == [(1,)]


@pytest.mark.parametrize(
    "sql",
    ["DROP VIEW shelf_view", "INSERT INTO shelf_view VALUES (1)", "CREATE VIEW v AS SELECT 1", "SHOW TABLES", "SELECT 1) x; DROP VIEW shelf_view; --", "SELECT nothing FROM shelf_view"],
)
def test_adhoc_refuses_anything_else(spark, shelf, sql):
    adhoc.publish(shelf, "shelf_view")
    (row,) = adhoc.select_json(spark, sql).collect()
    assert row.row_json.startswith('{"error":')
    assert spark.catalog.tableExists("shelf_view")


def test_adhoc_json_keeps_nulls(spark, shelf):
    adhoc.publish(shelf, "shelf_view")
    rows = adhoc.select_json(spark, "SELECT product_id, brand FROM shelf_view WHERE product_id = 3").collect()
    assert [r.row_json for r in rows] == ['{"product_id":3,"brand":null}']
