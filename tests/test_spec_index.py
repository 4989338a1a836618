"""The index of many filter specs against one predicate per spec."""

import math

import pytest

from shelfscope.operators.filters import FilterSpec, predicate
from shelfscope.operators.spec_index import MOST_SPECS, SpecIndex, in_runs
from shelfscope.plans import packs
from shelfscope.registry import generated
from shelfscope.schema import PRODUCTS


@pytest.fixture(scope="module")
def shelf(spark):
    values = [None, float("nan"), -math.inf, math.inf, -1.0, 0.0, 19.999, 20.0, 20.001, 41.5, 42.0, 1e15, 1e15 + 1]
    wholes = [None, -(2**63), 2**63 - 1, 0, 1, 3, 2**53, 2**53 + 1]
    brands = [None, "", "Brand#2", "b2", "other"]
    titles = [None, "", "Ring", "a_b%c", "RED ring", "öRING"]
    rows = []
    for i in range(400):
        v, w = values[i % 13], values[(i // 3) % 13]
        rows.append((i, i, titles[i % 6], brands[i % 5], v, w, values[(i // 7) % 13], values[(i // 5) % 13], wholes[i % 8], "img", wholes[(i // 2) % 8]))
    return spark.createDataFrame(rows, PRODUCTS).persist()


ODD = {
    "all": FilterSpec(),
    "edges": FilterSpec(price_between=(20, 42), mrp_between=(-1, 1e15), min_discount=20, max_discount=42),
    "one value": FilterSpec(price_between=(20, 20)),
    "empty": FilterSpec(price_between=(42, 20)),
    "infinite": FilterSpec(price_between=(-math.inf, math.inf)),
    "crowded": FilterSpec(mrp_between=(20.001, 41.5)),
    "wholes": FilterSpec(img_count_between=(-(2**63), 2**53), min_reviews=2**53 + 1),
    "brands": FilterSpec(brands=["", "Brand#2"], exclude_brands=["Brand#2"]),
    "excluded": FilterSpec(exclude_brands=["b2"]),
    "pattern": FilterSpec(title_ilike="%A\\_b\\%c"),
    "text": FilterSpec(title_ilike="ring", only_discounted=True),
    "same": FilterSpec(only_no_discount=True, only_discounted=True),
    "ratings": FilterSpec(min_rating=0, max_rating=20),
    **{f"near{i}": FilterSpec(price_between=(20 + i * 1e-9, 42 + i)) for i in range(60)},
}


@pytest.mark.parametrize("specs", [ODD, {"all": FilterSpec()}, generated(150), {"one": FilterSpec(brands=["b2"], min_rating=1)}])
@pytest.mark.parametrize("include_rating", [False, True])
def test_matches_are_those_of_the_predicates(spark, shelf, specs, include_rating):
    index = SpecIndex(spark, specs, include_rating)
    got = index.named(index.spread(index.tagged(shelf).select("product_id", *index.names)))
    found = {(r.pack_id, r.product_id) for r in got.collect()}
    for name, spec in specs.items():
        wanted = {r.product_id for r in shelf.filter(predicate(spec, include_rating)).select("product_id").collect()}
        assert {i for n, i in found if n == name} == wanted, name


def test_more_specs_than_one_index_holds(products):
    specs = generated(MOST_SPECS + 30)
    assert [len(run) for run in in_runs(specs)] == [MOST_SPECS, 30]
    cube = packs.pack_cube(products, specs)
    assert cube.filter("pack_id >= 'spec1024'").exceptAll(packs.pack_cube(products, dict(list(specs.items())[MOST_SPECS:]))).count() == 0


def test_plan_grows_with_words_not_with_specs(products):
    def size(n):
        cube = packs.pack_cube(products, generated(n))
        plan = cube._jdf.queryExecution().executedPlan().toString()
        return plan.count("Scan"), plan.count("Join")

    assert size(64) == size(512)
