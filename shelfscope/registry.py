"""Every named query over a data folder, and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from shelfscope import oracles
from shelfscope.operators.filters import FilterSpec
from shelfscope.plans import dashboard, loading, packs, reports
from shelfscope.sources.derived import products

Query = Callable[[SparkSession, str], DataFrame]


def _over(build: Callable[..., DataFrame], *args: object) -> Query:
    return lambda spark, sf_dir: build(products(spark, sf_dir), *args)


# Filter clauses one by one: spec, the same clause in SQL.
FILTERS: dict[str, tuple[FilterSpec, str]] = {
    "filter_brands": (FilterSpec(brands=["Brand#2", "Brand#13"]), "brand IN ('Brand#2', 'Brand#13')"),
    "filter_exclude_brands": (FilterSpec(exclude_brands=["Brand#2", ""]), "brand NOT IN ('Brand#2', '')"),
    "filter_min_discount": (FilterSpec(min_discount=28.9), "discount_percent >= 28"),
    "filter_max_discount": (FilterSpec(max_discount=42.9), "discount_percent <= 42"),
    "filter_price_between": (FilterSpec(price_between=[800, 2000]), "price BETWEEN 800.0 AND 2000.0"),
    "filter_mrp_between": (FilterSpec(mrp_between=[999.5, 5000]), "mrp BETWEEN 999.5 AND 5000.0"),
    "filter_img_count_between": (FilterSpec(img_count_between=[5, 99]), "img_count BETWEEN 5 AND 99"),
    "filter_title_ilike": (FilterSpec(title_ilike="RING"), "title ILIKE '%RING%'"),
    "filter_only_no_discount": (FilterSpec(only_no_discount=True, only_discounted=True), "price = mrp"),
    "filter_only_discounted": (FilterSpec(only_discounted=True), "price < mrp"),
    "filter_min_rating": (FilterSpec(min_rating=3.5), "rating >= 3.5"),
    "filter_max_rating": (FilterSpec(max_rating=2.5), "rating <= 2.5"),
    "filter_min_reviews": (FilterSpec(min_reviews=25), "rating_total >= 25"),
    "filter_empty_values": (
        FilterSpec.from_dict(
            {"brands": [], "exclude_brands": None, "min_discount": 0, "max_rating": "", "title_ilike": "", "price_between": (), "colour": "red"}
        ),
        "discount_percent >= 0",
    ),
    "filter_conjunction": (
        FilterSpec(exclude_brands=["Brand#2"], max_discount=42, title_ilike="red%", min_rating=1, min_reviews=3),
        "brand NOT IN ('Brand#2') AND discount_percent <= 42 AND title ILIKE 'red%' AND rating >= 1 AND rating_total >= 3",
    ),
    "filter_analyst_slice": (
        FilterSpec.from_dict(
            {"brands": ["Brand#2"], "min_discount": 20, "min_rating": 2.5, "max_discount": 1},
            only=("brands", "min_discount", "min_rating"),
        ),
        "brand IN ('Brand#2') AND discount_percent >= 20 AND rating >= 2.5",
    ),
}

# Slices for the packs: spec, SQL without and with the rating clauses.
SLICES: dict[str, tuple[FilterSpec, str, str]] = {
    "everything": (FilterSpec(), "true", "true"),
    "one_brand_discounted": (
        FilterSpec(brands=["Brand#2"], min_discount=20),
        "brand IN ('Brand#2') AND discount_percent >= 20",
        "brand IN ('Brand#2') AND discount_percent >= 20",
    ),
    "one_brand_well_rated": (
        FilterSpec(brands=["Brand#2"], min_discount=20, min_rating=3.5, min_reviews=25, top_limit=30),
        "brand IN ('Brand#2') AND discount_percent >= 20",
        "brand IN ('Brand#2') AND discount_percent >= 20 AND rating >= 3.5 AND rating_total >= 25",
    ),
    "mid_discount": (
        FilterSpec(exclude_brands=["Brand#2"], min_discount=20, max_discount=42),
        "brand NOT IN ('Brand#2') AND discount_percent >= 20 AND discount_percent <= 42",
        "brand NOT IN ('Brand#2') AND discount_percent >= 20 AND discount_percent <= 42",
    ),
    "discounted_well_rated": (
        FilterSpec(only_discounted=True, min_rating=4, min_reviews=25),
        "price < mrp",
        "price < mrp AND rating >= 4 AND rating_total >= 25",
    ),
    "rich_media": (
        FilterSpec(img_count_between=[5, 99], top_limit=0),
        "img_count BETWEEN 5 AND 99",
        "img_count BETWEEN 5 AND 99",
    ),
    "title_midprice": (
        FilterSpec(title_ilike="%RING%", price_between=[800, 2000]),
        "title ILIKE '%RING%' AND price BETWEEN 800.0 AND 2000.0",
        "title ILIKE '%RING%' AND price BETWEEN 800.0 AND 2000.0",
    ),
    "nothing": (FilterSpec(brands=["none"]), "brand IN ('none')", "brand IN ('none')"),
}
SPECS = {name: spec for name, (spec, _, _) in SLICES.items()}
ONE = "discounted_well_rated"


def generated(n: int) -> dict[str, FilterSpec]:
    """Filter specs by rule, every clause in many combinations and with many bounds."""

    def spec(i: int) -> FilterSpec:
        brands = [f"Brand#{1 + (i + k * k) % 26}" for k in range(1 + i % 4)]
        return FilterSpec(
            brands=brands if i % 3 == 0 else (),
            exclude_brands=[*brands, ""] if i % 3 == 1 else (),
            min_discount=7 * (i % 4) if i % 2 else None,
            max_discount=28 + 7 * (i % 5) + i % 3 if i % 5 else None,
            price_between=(100.0 * (i % 9), 1200.0 + 37.5 * (i % 17)) if i % 4 == 1 else None,
            mrp_between=(900.25 + i, 900.25 + 3 * i) if i % 7 == 2 else None,
            img_count_between=(i % 3, 4 + i % 3) if i % 6 == 2 else None,
            title_ilike=("ring", "RED%", "%w_l%", "light", "%een%tin%")[i % 5] if i % 7 == 3 else None,
            only_no_discount=i % 13 == 5,
            only_discounted=i % 11 == 7,
            min_rating=i % 8 / 2 if i % 4 == 3 else None,
            max_rating=5 - i % 5 / 2 if i % 6 == 1 else None,
            min_reviews=3 * i % 90 if i % 5 == 2 else None,
            top_limit=i % 13,
        )

    return {f"spec{i:04}": spec(i) for i in range(n)}


MANY = generated(130)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {n: _over(partial(reports.report, n)) for n in reports.NAMES}
    found |= {n: _over(partial(dashboard.panel, n)) for n in dashboard.PANELS}
    for name, (spec, _) in FILTERS.items():
        found[name] = _over(packs.pack_core_kpis, spec, True)
    one = SPECS[ONE]
    found["pack_core_kpis"] = _over(packs.pack_core_kpis, one)
    found["pack_brand_concentration"] = _over(packs.pack_brand_concentration, one)
    found["pack_discount_bands"] = _over(packs.pack_discount_bands, one)
    found["pack_top_discounted_rated"] = _over(packs.pack_top_discounted_rated, one)
    found["pack_bullets"] = _over(packs.pack_bullets, one)
    found["insight_pack"] = _over(lambda p: loading.flat_document(packs.insight_pack(p, one)))
    found["insight_packs_multi"] = _over(lambda p: loading.flat_kpis(packs.insight_packs(p, SPECS)))
    for table in oracles.PACK_TABLES:
        found[f"packs_{table}"] = _over(lambda p, t=table: loading.flat_table(packs.insight_packs(p, SPECS), t))
    found["packs_bullets"] = _over(lambda p: loading.flat_bullets(packs.insight_packs(p, SPECS)))
    found["packs_generated"] = _over(lambda p: loading.flat_kpis(packs.insight_packs(p, MANY)))
    found["packs_generated_rated"] = _over(lambda p: packs.pack_top(p, MANY))
    found["pack_documents"] = _over(loading.pack_documents, SPECS)
    found |= {name: _over(build) for name, build in loading.LOADING.items()}
    found["stream_refresh_packs"] = _over(loading.stream_refresh_packs, SPECS)
    found["stream_refresh_reports"] = _over(loading.stream_refresh_reports, SPECS)
    return found


def oracle_sql() -> dict[str, str]:
    found = {**oracles.REPORTS, **oracles.DASHBOARD}
    for name, (_, where) in FILTERS.items():
        found[name] = oracles.pack_kpis(where)
    spec, shelf, rated = SLICES[ONE]
    found["pack_core_kpis"] = oracles.pack_kpis(shelf)
    found["pack_brand_concentration"] = oracles.shares(shelf, 10)
    found["pack_discount_bands"] = oracles.pack_bands(shelf)
    found["pack_top_discounted_rated"] = oracles.pack_rated(rated, spec.rows)
    found["pack_bullets"] = oracles.pack_bullets(shelf)
    found["insight_pack"] = oracles.document(shelf, rated, spec.rows)
    found["insight_packs_multi"] = oracles.per_pack(
        {
            name: f"SELECT *, CAST(CASE WHEN products > 0 THEN 4 ELSE 1 END AS BIGINT) AS sentences"
            f" FROM ({oracles.pack_kpis(shelf)})"
            for name, (_, shelf, _) in SLICES.items()
        }
    )
    found["packs_brand_concentration"] = oracles.per_pack(
        {
            name: oracles.numbered(oracles.shares(shelf, 10), oracles.ordered("items DESC", "brand ASC"))
            for name, (_, shelf, _) in SLICES.items()
        }
    )
    found["packs_discount_bands"] = oracles.per_pack(
        {
            name: oracles.numbered(oracles.pack_bands(shelf), oracles.ordered("items DESC", "band ASC"))
            for name, (_, shelf, _) in SLICES.items()
        }
    )
    found["packs_top_discounted_rated"] = oracles.per_pack(
        {
            name: oracles.numbered(oracles.pack_rated(rated, spec.rows), oracles.BY_DISCOUNT)
            for name, (spec, _, rated) in SLICES.items()
        }
    )
    found["packs_bullets"] = oracles.per_pack(
        {name: oracles.pack_bullets(shelf) for name, (_, shelf, _) in SLICES.items()}
    )
    found["packs_generated"] = oracles.many_kpis(MANY)
    found["packs_generated_rated"] = oracles.many_rated(MANY)
    found["pack_documents"] = found["packs_brand_concentration"]
    found |= oracles.LOADING
    found["stream_refresh_packs"] = found["insight_packs_multi"]
    found["stream_refresh_reports"] = oracles.REPORTS["price_bucket_distribution"]
    reloaded = {"stream_refresh_packs", "stream_refresh_reports"}
    return {name: oracles.over_products(sql, name in reloaded) for name, sql in found.items()}
