"""Insight packs: KPIs, tables and text findings for filtered slices.

One pack answers four questions about the rows that match a ``FilterSpec``.
KPIs, brands and bands ignore the rating clauses; only the rated list obeys
them. Many packs share three scans: an index of the specs gives every row the
set of packs it matches, rows are counted per set, and only these counts, and
the rows near the top of some list, are spread over their packs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfscope.functions import exact
from shelfscope.functions.sentences import bullets
from shelfscope.operators.filters import FilterSpec, predicate
from shelfscope.operators.spec_index import WORD, SpecIndex, Specs, in_runs
from shelfscope.operators.toplist import asc, by, desc, top_rows_per_group
from shelfscope.plans.facts import Cube, Facts, Rows
from shelfscope.plans.reports import (
    DISCOUNT_LIST,
    brand_concentration,
    deepest_discounts,
    discount_bands,
    kpi_columns,
)
from shelfscope.sources.local_rows import local_rows

c = F.col
BRANDS = 10
KPIS = ["avg_price", "avg_mrp", "avg_discount_pct", "no_discount_items", "products"]
MEASURES = ("price", "mrp", "discount_percent")

# Which columns a grouping-sets row leaves out, as bits (pack_id, brand, discount_band).
_PER_BRAND, _PER_BAND, _PER_PACK = 0b001, 0b010, 0b011


def _deepest_discount_first() -> list[Column]:
    return by([desc("discount_percent"), asc("price")], DISCOUNT_LIST)


# --- one pack, question by question -------------------------------------------------


def _slice(products: DataFrame, spec: FilterSpec, include_rating: bool = False) -> Rows:
    return Rows(products.filter(predicate(spec, include_rating)))


def pack_core_kpis(products: DataFrame, spec: FilterSpec, include_rating: bool = False) -> DataFrame:
    """Five KPIs of the slice, 0 where there is nothing to average."""
    facts = _slice(products, spec, include_rating)
    row = facts.frame.agg(*kpi_columns(facts), facts.items().alias("products"))
    return row.select(*(F.coalesce(c(k), F.lit(0).cast(row.schema[k].dataType)).alias(k) for k in KPIS))


def pack_brand_concentration(products: DataFrame, spec: FilterSpec, include_rating: bool = False) -> DataFrame:
    return brand_concentration(_slice(products, spec, include_rating), BRANDS)


def pack_discount_bands(products: DataFrame, spec: FilterSpec, include_rating: bool = False) -> DataFrame:
    return discount_bands(_slice(products, spec, include_rating))


def pack_top_discounted_rated(products: DataFrame, spec: FilterSpec) -> DataFrame:
    rows = _slice(products, spec, include_rating=True).frame
    return deepest_discounts(rows.filter(c("rating_total") > 0), spec.rows)


def pack_bullets(products: DataFrame, spec: FilterSpec) -> DataFrame:
    """One row per sentence, numbered from 1."""
    specs = {"pack": spec}
    found = figures(pack_cube(products, specs), specs)
    return found.select(F.posexplode("bullets").alias("n", "bullet")).select(
        (c("n") + 1).cast("bigint").alias("bullet_no"), "bullet"
    )


# --- many packs ---------------------------------------------------------------------


def pack_cube(products: DataFrame, specs: Specs, include_rating: bool = False) -> DataFrame:
    """Counts and moments per (pack, brand, band); cubes of disjoint inputs may be unioned."""

    def cube(run: Specs) -> DataFrame:
        index = SpecIndex(products.sparkSession, run, include_rating)
        per_set = _grouped(Rows(index.tagged(products)), index.names)
        return index.named(_grouped(Cube(index.spread(per_set)), ["pack_no"]))

    return reduce(DataFrame.unionByName, map(cube, in_runs(specs)))


def merge_pack_cubes(cubes: DataFrame) -> DataFrame:
    """One cube from the union of several."""
    return _grouped(Cube(cubes), ["pack_id"])


def _grouped(facts: Facts, packs: list[str]) -> DataFrame:
    return facts.frame.groupBy(*packs, "brand", facts.key("discount_band").alias("discount_band")).agg(
        facts.items().alias("items"),
        facts.flagged("no_discount_items").alias("no_discount_items"),
        *(column for m in MEASURES for column in facts.moments(m).named(m)),
    )


def _discount_bucket() -> Column:
    """Whole percents from the deepest discount down; beyond 0-100, and unknown, at the ends."""
    percent = F.greatest(F.least(c("discount_percent"), F.lit(101.0)), F.lit(-1.0))
    return F.when(c("discount_percent").isNull(), 2).otherwise(-F.floor(percent)).cast("int")


def pack_top(products: DataFrame, specs: Specs) -> DataFrame:
    """The rated list of every pack, ranked from 1."""

    def top(run: Specs) -> DataFrame:
        index = SpecIndex(products.sparkSession, run, include_rating=True)
        rated = index.tagged(products.filter(c("rating_total") > 0)).withColumn("bucket", _discount_bucket())
        near = _near_the_top(rated.select(*DISCOUNT_LIST, "bucket", *index.names), index)
        listed = index.named(index.spread(near)).select("pack_id", *DISCOUNT_LIST)
        return _to_length(_ranked(listed, run), run)

    return reduce(DataFrame.unionByName, map(top, in_runs(specs)))


def _near_the_top(rows: DataFrame, index: SpecIndex) -> DataFrame:
    """Rows that may be among the first of a pack, with only the packs for which that holds.

    Counting rows per set of packs and bucket needs no sort. A pack needs the
    buckets up to the one that completes its list, however many rows are in it.
    """
    spark = rows.sparkSession
    sizes = index.spread(rows.groupBy("bucket", *index.names).agg(F.count("*").alias("n")))
    sizes = sizes.groupBy("pack_no", "bucket").agg(F.sum("n").alias("n"))
    lengths = [(n, s.rows) for n, s in enumerate(index.specs)]
    sizes = sizes.join(F.broadcast(local_rows(spark, lengths, "pack_no int, length int")), "pack_no")
    before = Window.partitionBy("pack_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    needed = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(c("before") < c("length"))

    def word(i: int) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), c("pack_no") % WORD)
        return F.bit_or(F.when(F.floor(c("pack_no") / WORD) == i, bit).otherwise(F.lit(0).cast("bigint")))

    wanted = needed.groupBy("bucket").agg(*(word(i).alias(f"__wanted{i}") for i in range(index.width)))
    # A row per bucket: whole percents.
    both = rows.join(F.broadcast(wanted), "bucket")
    kept = [c(n).bitwiseAND(c(f"__wanted{i}")).alias(n) for i, n in enumerate(index.names)]
    return both.select(*DISCOUNT_LIST, *kept).filter(index.any(index.names))


def merge_pack_tops(tops: DataFrame, specs: Specs) -> DataFrame:
    """One rated list per pack from the union of several; these are short already."""
    return _to_length(_ranked(tops.drop("position"), specs, lanes=False), specs)


def _ranked(rows: DataFrame, specs: Specs, lanes: bool = True) -> DataFrame:
    most = max(s.rows for s in specs.values())
    return top_rows_per_group(rows, "pack_id", _deepest_discount_first(), most, lanes=lanes)


def _to_length(ranked: DataFrame, specs: Specs) -> DataFrame:
    """Each pack's own number of rows."""
    lengths = [(name, s.rows) for name, s in specs.items()]
    table = local_rows(ranked.sparkSession, lengths, "pack_id string, length int")
    return ranked.join(F.broadcast(table), "pack_id").filter(c("position") <= c("length")).drop("length")


def _summary(cube: DataFrame) -> DataFrame:
    """Per pack: KPI struct, its ten biggest brands and its bands.

    All three come from one pass over the cube; the ranking keeps at most ten
    rows per kind before they are collected into arrays.
    """
    facts = Cube(cube)
    pack, brand, band = c("pack_id"), c("brand"), c("discount_band")
    levels = cube.groupingSets([[pack], [pack, brand], [pack, band]], pack, brand, band).agg(
        F.grouping_id("pack_id", "brand", "discount_band").alias("kind"),
        facts.items().alias("items"),
        F.struct(*kpi_columns(facts), facts.items().alias("products")).alias("kpis"),
    )
    order = by([desc("items")], ["brand", "discount_band"])
    ranked = top_rows_per_group(levels, ["pack_id", "kind"], order, BRANDS, lanes=False)

    def listed(kind: int, name: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(c("kind") == kind, F.struct("position", name, "items"))))

    return ranked.groupBy("pack_id").agg(
        F.max(F.when(c("kind") == _PER_PACK, c("kpis"))).alias("kpis"),
        listed(_PER_BRAND, brand).alias("brands"),
        listed(_PER_BAND, band.alias("band")).alias("bands"),
    )


def figures(cube: DataFrame, specs: Specs) -> DataFrame:
    """KPIs, brands, bands and findings of every pack, also of packs that match nothing."""
    names = local_rows(cube.sparkSession, [(n,) for n in specs], "pack_id string")
    found = names.join(_summary(cube), "pack_id", "left")
    none = F.lit(0).cast("bigint")
    zeros = {"no_discount_items": none, "products": none}
    kpis = F.struct(*(F.coalesce(c("kpis")[k], zeros.get(k, F.lit(0.0))).alias(k) for k in KPIS))

    def share(x: Column) -> Column:
        return exact.percent(x["items"], c("kpis")["products"]).alias("share_pct")

    return found.select(
        "pack_id",
        kpis.alias("kpis"),
        _rows("brands", ["brand", "items"], share).alias("brand_concentration"),
        _rows("bands", ["band", "items"]).alias("discount_bands"),
    ).withColumn("bullets", bullets(c("kpis"), c("brand_concentration"), c("discount_bands")))


def _rows(name: str, columns: list[str], *more: Callable[[Column], Column]) -> Column:
    """The array without its ranks; an empty one for a pack without rows."""

    def row(x: Column) -> Column:
        return F.struct(*(x[n].alias(n) for n in columns), *(build(x) for build in more))

    return F.coalesce(F.transform(c(name), row), F.array())


def assemble(cube: DataFrame, top: DataFrame, specs: Specs) -> DataFrame:
    """One nested document per pack."""
    ranked = F.sort_array(F.collect_list(F.struct("position", *DISCOUNT_LIST)))
    rated = top.groupBy("pack_id").agg(ranked.alias("rated"))
    tables = F.struct(
        "brand_concentration", "discount_bands", _rows("rated", DISCOUNT_LIST).alias("top_discounted_rated")
    )
    packs = figures(cube, specs).join(rated, "pack_id", "left")
    return packs.select("pack_id", "kpis", tables.alias("tables"), "bullets")


def insight_packs(products: DataFrame, specs: Specs, include_rating: bool = False) -> DataFrame:
    """Nested documents ``(pack_id, kpis, tables, bullets)`` for many specs.

    ``include_rating`` applies the rating clauses to everything, as the simpler
    analyst slice does.
    """
    return assemble(pack_cube(products, specs, include_rating), pack_top(products, specs), specs)


def insight_pack(products: DataFrame, spec: FilterSpec, include_rating: bool = False) -> DataFrame:
    """The nested document ``(kpis, tables, bullets)`` of one spec: filter and aggregate, filter and keep the top."""
    name = F.lit("pack").alias("pack_id")
    cube = _grouped(_slice(products, spec, include_rating), [name])
    top = pack_top_discounted_rated(products, spec).select(name, "*")
    return assemble(cube, _ranked(top, {"pack": spec}, lanes=False), {"pack": spec}).drop("pack_id")
