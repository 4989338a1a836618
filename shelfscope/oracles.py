"""The same questions in plain SQL for an independent engine.

Money is compared in whole thousandths (the test values have at most three
decimals), and two-digit roundings are integer divisions, half up.
"""

from __future__ import annotations

from shelfscope.operators.filters import FilterSpec

PRODUCTS = """
WITH priced AS (
  SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_brand, p_size, l_quantity, l_tax, l_returnflag,
         CAST(floor(round(l_extendedprice * 100) / l_quantity) AS BIGINT) AS mrp_c,
         CAST(round(l_discount * 100) AS BIGINT) * 7 AS disc
  FROM lineitem JOIN part ON l_partkey = p_partkey),
listed AS (
  SELECT l_orderkey * 10 + l_linenumber AS product_id,
         l_partkey AS style_id,
         CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN ''
              ELSE concat(p_name, ' - Style ', CAST(l_partkey AS VARCHAR)) END AS title,
         CASE p_brand WHEN 'Brand#25' THEN NULL WHEN 'Brand#24' THEN '' ELSE p_brand END AS brand,
         CASE WHEN l_partkey % 101 = 0 THEN NULL
              ELSE CAST(floor(mrp_c * (100 - disc) / 100.0) AS DOUBLE) / 100 END AS price,
         CAST(mrp_c AS DOUBLE) / 100 AS mrp,
         CASE WHEN l_partkey % 101 = 0 THEN NULL ELSE CAST(disc AS DOUBLE) END AS discount_percent,
         round(l_tax * 100) * 5 / 8 AS rating,
         CASE WHEN l_returnflag = 'N' THEN CAST(0 AS BIGINT) ELSE CAST(l_quantity AS BIGINT) * 3 END AS rating_total,
         concat('img/', CAST(l_partkey AS VARCHAR), '.jpg') AS img_primary,
         CAST(nullif(p_size % 8, 7) AS BIGINT) AS img_count
  FROM priced)
"""

COLUMNS = (
    "product_id, style_id, title, brand, price, mrp, discount_percent, rating, rating_total, img_primary, img_count"
)
RATED_LIST = "product_id, title, brand, rating, rating_total, price, mrp, discount_percent"
DISCOUNT_LIST = "product_id, title, brand, price, mrp, discount_percent, rating, rating_total"

DISCOUNT_BAND = """CASE WHEN discount_percent = 0 THEN '0%' WHEN discount_percent < 20 THEN '0-20%'
  WHEN discount_percent < 40 THEN '20-40%' WHEN discount_percent < 60 THEN '40-60%' ELSE '60%+' END"""
RATING_BAND = """CASE WHEN rating = 0 THEN '0 (unrated)' WHEN rating < 2 THEN '1.0-1.9'
  WHEN rating < 3 THEN '2.0-2.9' WHEN rating < 4 THEN '3.0-3.9' WHEN rating < 4.5 THEN '4.0-4.49'
  ELSE '4.5-5.0' END"""
PRICE_BUCKET = """CASE WHEN price < 500 THEN '<500' WHEN price < 1000 THEN '500-999'
  WHEN price < 2000 THEN '1000-1999' WHEN price < 5000 THEN '2000-4999' ELSE '5000+' END"""
IMAGE_BUCKET = """CASE WHEN img_count IS NULL OR img_count = 0 THEN '0' WHEN img_count <= 2 THEN '1-2'
  WHEN img_count <= 4 THEN '3-4' ELSE '5+' END"""


def milli(x: str) -> str:
    return f"CAST(round({x} * 1000) AS BIGINT)"


def avg2(x: str) -> str:
    return f"CAST((2 * SUM({milli(x)}) + 10 * COUNT({x})) // (20 * COUNT({x})) AS DOUBLE) / 100"


def avg_raw(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,3))) AS DOUBLE) / COUNT({x})"


def share2(part: str, whole: str) -> str:
    return f"CAST((20000 * {part} + {whole}) // (2 * {whole}) AS DOUBLE) / 100"


def n_where(condition: str) -> str:
    return f"CAST(SUM(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


def ordered(*keys: str) -> str:
    return ", ".join(f"{k} NULLS LAST" for k in keys)


def ties(columns: str) -> str:
    return ordered(*(f"{c.strip()} ASC" for c in columns.split(",")))


KPIS = f"""{avg2('price')} AS avg_price, {avg2('mrp')} AS avg_mrp,
  {avg2('discount_percent')} AS avg_discount_pct, {n_where('price = mrp')} AS no_discount_items"""
BY_DISCOUNT = f"{ordered('discount_percent DESC', 'price ASC')}, {ties(DISCOUNT_LIST)}"


def shares(where: str, limit: int) -> str:
    return f"""SELECT brand, items, CASE WHEN s > 0 THEN {share2('items', 's')} ELSE 0 END AS share_pct
      FROM (SELECT brand, COUNT(*) AS items FROM products WHERE {where} GROUP BY brand) g
      CROSS JOIN (SELECT COUNT(*) AS s FROM products WHERE {where}) t
      ORDER BY {ordered('items DESC', 'brand ASC')} LIMIT {limit}"""


REPORTS = {
    "row_counts": "SELECT COUNT(*) AS products, COUNT(DISTINCT brand) AS brands FROM products",
    "core_kpis": f"SELECT {KPIS} FROM products",
    "discount_bands": f"SELECT {DISCOUNT_BAND} AS band, COUNT(*) AS items FROM products GROUP BY 1",
    "brand_avg_discount_top20": f"""SELECT brand, COUNT(*) AS items, {avg2('discount_percent')} AS avg_discount_pct
      FROM products GROUP BY brand HAVING COUNT(*) >= 5
      ORDER BY {ordered('avg_discount_pct DESC', 'brand ASC')} LIMIT 20""",
    "brand_concentration_top20": shares("true", 20),
    "ratings_coverage": f"""SELECT {n_where('rating_total > 0')} AS rated_items,
      {n_where('rating_total = 0')} AS unrated_items, {avg2('nullif(rating, 0)')} AS avg_rating_nonzero
      FROM products""",
    "rating_distribution": f"SELECT {RATING_BAND} AS rating_band, COUNT(*) AS items FROM products GROUP BY 1",
    "top_rated_by_volume": f"""SELECT {RATED_LIST} FROM products WHERE rating_total >= 100 AND rating >= 4
      ORDER BY {ordered('rating DESC', 'rating_total DESC')}, {ties(RATED_LIST)} LIMIT 50""",
    "highest_discounts_rated": f"""SELECT {DISCOUNT_LIST} FROM products WHERE rating_total > 0
      ORDER BY {BY_DISCOUNT} LIMIT 50""",
    "rating_by_discount_band": f"""SELECT {DISCOUNT_BAND} AS band, {avg2('nullif(rating, 0)')} AS avg_rating_nonzero,
      CAST(SUM(rating_total) AS BIGINT) AS total_ratings, COUNT(*) AS items FROM products GROUP BY 1""",
    "price_bucket_distribution": f"""SELECT {PRICE_BUCKET} AS price_bucket, COUNT(*) AS items,
      {avg2('discount_percent')} AS avg_discount_pct FROM products GROUP BY 1""",
    "image_count_vs_rating": f"""SELECT {IMAGE_BUCKET} AS img_bucket, COUNT(*) AS items,
      {avg2('nullif(rating, 0)')} AS avg_rating_nonzero FROM products GROUP BY 1""",
    "total_markdown_value": """SELECT CAST(SUM(GREATEST(
      CAST(mrp AS DECIMAL(18,2)) - CAST(price AS DECIMAL(18,2)), 0)) AS DOUBLE) AS total_markdown_value FROM products""",
    "duplicate_titles_top50": f"""SELECT title, COUNT(*) AS dupes FROM products GROUP BY title HAVING COUNT(*) > 1
      ORDER BY {ordered('dupes DESC', 'title ASC')} LIMIT 50""",
    "data_quality_nulls": f"""SELECT {n_where("brand IS NULL OR brand = ''")} AS null_brands,
      {n_where("title IS NULL OR title = ''")} AS null_titles,
      {n_where('price IS NULL OR price <= 0')} AS bad_price FROM products""",
    "sample_price_vs_mrp": f"""SELECT product_id, brand, price, mrp, discount_percent FROM products
      WHERE price IS NOT NULL AND mrp IS NOT NULL
      ORDER BY md5(concat(CAST(product_id AS VARCHAR), '|', CAST(style_id AS VARCHAR))),
        {ties('product_id, brand, price, mrp, discount_percent, style_id')} LIMIT 1000""",
}

DASHBOARD = {
    "dash_brand_list": "SELECT DISTINCT brand FROM products WHERE brand IS NOT NULL",
    "dash_kpis": f"SELECT COUNT(*) AS products, {KPIS} FROM products",
    "dash_top_discounted": f"SELECT {DISCOUNT_LIST} FROM products ORDER BY {BY_DISCOUNT} LIMIT 50",
    "dash_top_brands": f"""SELECT brand, COUNT(*) AS product_count, {avg_raw('mrp')} AS mrp FROM products
      GROUP BY brand ORDER BY {ordered('product_count DESC', 'brand ASC')} LIMIT 5""",
    "dash_brand_price_discount": f"""SELECT brand, {avg_raw('price')} AS avg_price,
      {avg_raw('discount_percent')} AS avg_discount_percent FROM products
      WHERE brand IS NOT NULL AND price IS NOT NULL AND discount_percent IS NOT NULL GROUP BY brand""",
    "chart_top10_brand_means": f"""SELECT brand, {avg_raw('price')} AS avg_price,
      {avg_raw('discount_percent')} AS avg_discount, COUNT(price) AS "count" FROM products
      WHERE brand IS NOT NULL GROUP BY brand ORDER BY {ordered('"count" DESC', 'brand ASC')} LIMIT 10""",
}


def pack_kpis(where: str) -> str:
    return f"""SELECT coalesce({avg2('price')}, 0) AS avg_price, coalesce({avg2('mrp')}, 0) AS avg_mrp,
      coalesce({avg2('discount_percent')}, 0) AS avg_discount_pct,
      coalesce({n_where('price = mrp')}, 0) AS no_discount_items, COUNT(*) AS products
      FROM products WHERE {where}"""


def pack_bands(where: str) -> str:
    return f"SELECT {DISCOUNT_BAND} AS band, COUNT(*) AS items FROM products WHERE {where} GROUP BY 1"


def pack_rated(where: str, limit: int) -> str:
    return f"""SELECT {DISCOUNT_LIST} FROM products WHERE {where} AND rating_total > 0
      ORDER BY {BY_DISCOUNT} LIMIT {limit}"""


def pack_bullets(where: str) -> str:
    return f"""SELECT CAST(n AS BIGINT) AS bullet_no, bullet FROM (
      WITH k AS ({pack_kpis(where)}), b AS ({shares(where, 1)}),
      d AS (SELECT band, items, SUM(items) OVER () AS s FROM ({pack_bands(where)})
            ORDER BY items DESC, band LIMIT 1)
      SELECT 1 AS n, CASE WHEN products > 0 THEN concat('Avg price ₹', format('{{:,.2f}}', avg_price), ', avg MRP ₹',
        format('{{:,.2f}}', avg_mrp), ', avg discount ', format('{{:.2f}}', avg_discount_pct), '% across ',
        format('{{:,}}', products), ' items.') ELSE 'No items match the current filters.' END AS bullet FROM k
      UNION ALL SELECT 2, concat(format('{{:,}}', no_discount_items), ' items are at MRP (0% discount).')
        FROM k WHERE products > 0
      UNION ALL SELECT 3, concat('Top brand: ', coalesce(brand, 'None'), ' with ', format('{{:,}}', items),
        ' items (~', format('{{:.2f}}', share_pct), '%).') FROM b
      UNION ALL SELECT 4, concat('Largest discount band: ', band, ' at ', format('{{:,}}', items),
        ' items (~', format('{{:.1f}}', 100.0 * items / CAST(s AS DOUBLE)), '%).') FROM d)"""


PACK_TABLES = ("brand_concentration", "discount_bands", "top_discounted_rated")


def numbered(rows: str, order: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) AS position, * FROM ({rows})"


def per_pack(sql: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS pack_id, * FROM ({rows})" for name, rows in sql.items())


def spec_rows(specs: dict[str, FilterSpec]) -> str:
    """Filter specs as a table; a clause that is not given is NULL or an empty list."""

    def value(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, (tuple, list)):
            return f"[{', '.join(map(value, x))}]::VARCHAR[]"
        return f"'{x}'" if isinstance(x, str) else str(x)

    def row(name: str, s: FilterSpec) -> str:
        ranges = [b for r in (s.price_between, s.mrp_between, s.img_count_between) for b in r or (None, None)]
        relation = "=" if s.only_no_discount else "<" if s.only_discounted else None
        title = s.title_pattern if s.title_ilike else None
        bounds = [s.min_discount, s.max_discount, *ranges, s.min_rating, s.max_rating, s.min_reviews, s.rows]
        return f"({', '.join(map(value, [name, s.brands, s.exclude_brands, title, relation, *bounds]))})"

    columns = (
        "pack_id, only_brands, no_brands, pattern, relation, d0, d1, p0, p1, m0, m1, i0, i1, r0, r1, reviews, length"
    )
    return f"(VALUES {', '.join(row(*x) for x in specs.items())}) AS s({columns})"


def _within(x: str, low: str, high: str) -> str:
    return f"({low} IS NULL OR {x} >= {low}) AND ({high} IS NULL OR {x} <= {high})"


SHELF_CLAUSES = f"""(len(only_brands) = 0 OR list_contains(only_brands, brand))
  AND (len(no_brands) = 0 OR NOT list_contains(no_brands, brand))
  AND (pattern IS NULL OR title ILIKE pattern)
  AND (relation IS NULL OR relation = '=' AND price = mrp OR relation = '<' AND price < mrp)
  AND {_within('discount_percent', 'd0', 'd1')} AND {_within('price', 'p0', 'p1')}
  AND {_within('mrp', 'm0', 'm1')} AND {_within('img_count', 'i0', 'i1')}"""
RATING_CLAUSES = f"{_within('rating', 'r0', 'r1')} AND (reviews IS NULL OR rating_total >= reviews)"


def many_kpis(specs: dict[str, FilterSpec]) -> str:
    return f"""SELECT pack_id, coalesce({avg2('price')}, 0) AS avg_price, coalesce({avg2('mrp')}, 0) AS avg_mrp,
      coalesce({avg2('discount_percent')}, 0) AS avg_discount_pct,
      coalesce({n_where('price = mrp')}, 0) AS no_discount_items, COUNT(product_id) AS products,
      CAST(CASE WHEN COUNT(product_id) > 0 THEN 4 ELSE 1 END AS BIGINT) AS sentences
      FROM {spec_rows(specs)} LEFT JOIN products ON {SHELF_CLAUSES} GROUP BY pack_id"""


def many_rated(specs: dict[str, FilterSpec]) -> str:
    return f"""SELECT pack_id, {DISCOUNT_LIST}, CAST(position AS INTEGER) AS position FROM (
      SELECT s.pack_id, length, products.*, row_number() OVER (PARTITION BY pack_id ORDER BY {BY_DISCOUNT}) AS position
      FROM {spec_rows(specs)} JOIN products ON {SHELF_CLAUSES} AND {RATING_CLAUSES} AND rating_total > 0)
      WHERE position <= length"""


def document(shelf: str, rated: str, limit: int) -> str:
    """Every value of a pack, section by section."""
    text = {"brand", "band", "title", "bullet"}
    sections = {
        "kpis": (f"SELECT 1 AS position, * FROM ({pack_kpis(shelf)})", "avg_price avg_mrp avg_discount_pct no_discount_items products"),
        "brand_concentration": (numbered(shares(shelf, 10), ordered("items DESC", "brand ASC")), "brand items share_pct"),
        "discount_bands": (numbered(pack_bands(shelf), ordered("items DESC", "band ASC")), "band items"),
        "top_discounted_rated": (numbered(pack_rated(rated, limit), BY_DISCOUNT), DISCOUNT_LIST.replace(",", " ")),
        "bullets": (f"SELECT bullet_no AS position, bullet FROM ({pack_bullets(shelf)})", "bullet"),
    }

    def cell(f: str) -> str:
        words, number = (f, "NULL") if f in text else ("NULL", f)
        return f"{{'field': '{f}', 'text': CAST({words} AS VARCHAR), 'number': CAST({number} AS DOUBLE)}}"

    def rows(section: str, sql: str, fields: str) -> str:
        cells = ", ".join(map(cell, fields.split()))
        return f"""SELECT '{section}' AS section, CAST(position AS BIGINT) AS position, v.field AS field, v.text AS "text", v.number AS "number"
          FROM (SELECT position, unnest([{cells}]) AS v FROM ({sql}))"""

    return " UNION ALL ".join(rows(name, sql, fields) for name, (sql, fields) in sections.items())


# A CSV file cannot tell an empty text from a missing one.
EMPTY_IS_NULL = "* REPLACE (nullif(title, '') AS title, nullif(brand, '') AS brand)"
RELOADED = f"SELECT {COLUMNS} FROM (SELECT {EMPTY_IS_NULL} FROM products)"

LOADING = {
    "ingest_csv": RELOADED,
    "ingest_missing_columns": """SELECT product_id,
      CASE WHEN style_id % 2 = 0 THEN style_id END AS style_id,
      CASE WHEN style_id % 2 = 1 THEN nullif(title, '') END AS title,
      CASE WHEN style_id % 2 = 1 THEN nullif(brand, '') END AS brand,
      CASE WHEN style_id % 2 = 1 THEN price END AS price,
      CAST(NULL AS DOUBLE) AS mrp, CAST(NULL AS DOUBLE) AS discount_percent, CAST(NULL AS DOUBLE) AS rating,
      CAST(NULL AS BIGINT) AS rating_total, CAST(NULL AS VARCHAR) AS img_primary,
      CASE WHEN style_id % 2 = 0 THEN img_count END AS img_count FROM products""",
    "ingest_coercion": """SELECT
      CASE product_id % 7 WHEN 0 THEN product_id WHEN 1 THEN product_id WHEN 6 THEN product_id
        WHEN 4 THEN CAST(concat('1', CAST(product_id AS VARCHAR)) AS BIGINT) END AS product_id,
      style_id,
      CASE style_id % 9 WHEN 7 THEN 'Nantes' WHEN 8 THEN img_primary END AS title,
      CASE style_id % 8 WHEN 0 THEN mrp WHEN 2 THEN CAST(100 AS DOUBLE) WHEN 5 THEN CAST(12.5 AS DOUBLE)
        WHEN 7 THEN CAST(10.5 AS DOUBLE) END AS price FROM products""",
    "ingest_ragged_rows": """SELECT product_id, style_id,
      CASE style_id % 8 WHEN 0 THEN 'A' WHEN 1 THEN 'short' WHEN 4 THEN 'q,uoted' END AS title,
      CASE style_id % 8 WHEN 0 THEN '4711' WHEN 4 THEN 'B' END AS brand
      FROM products WHERE style_id % 8 IN (0, 1, 4, 5)""",
    "ingest_quoted_lines": f"""SELECT {COLUMNS} FROM (SELECT * REPLACE (
      CASE WHEN style_id % 3 = 0 THEN title || chr(10) || 'second "line", and' || chr(10) || chr(10) || brand || chr(10)
        ELSE nullif(title, '') END AS title, nullif(brand, '') AS brand) FROM products)""",
    "ingest_append": """SELECT nullif(brand, '') AS brand, 2 * COUNT(*) AS items,
      CAST(2 * SUM(product_id) AS BIGINT) AS id_sum, 2 * COUNT(nullif(title, '')) AS titled
      FROM products GROUP BY 1""",
    "ingest_row_count": "SELECT 2 * COUNT(*) AS rows_inserted FROM products",
    "report_csv": f"""SELECT {EMPTY_IS_NULL} FROM (SELECT {DISCOUNT_LIST} FROM products WHERE rating_total > 0
      ORDER BY {BY_DISCOUNT} LIMIT 20)""",
    "adhoc_select": "SELECT brand, COUNT(*) AS items, MAX(mrp) AS max_mrp FROM products GROUP BY brand",
    "adhoc_select_json": """SELECT concat('{"brand":', CASE WHEN brand IS NULL THEN 'null'
      ELSE concat('"', brand, '"') END, ',"items":', CAST(COUNT(*) AS VARCHAR), '}') AS row_json
      FROM products GROUP BY brand""",
    "stream_ingest": RELOADED,
    "stream_ingest_by_name": RELOADED,
    "stream_ingest_unique": "SELECT DISTINCT product_id, CAST(1 AS BIGINT) AS n_rows FROM products",
    "stream_brand_counts": f"""SELECT nullif(brand, '') AS brand, {DISCOUNT_BAND} AS band, COUNT(*) AS items
      FROM products GROUP BY 1, 2""",
}


def over_products(sql: str, reloaded: bool = False) -> str:
    """The query over the derived products, as they are or as a CSV load gives them back."""
    return f"{PRODUCTS}, products AS (SELECT {EMPTY_IS_NULL if reloaded else '*'} FROM listed)\n{sql}"
