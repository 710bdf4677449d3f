"""The same results in DuckDB SQL, over the same fixture."""

from __future__ import annotations

from checks.fixture import RAW_SQL, rectangles
from listingmart.functions.bins import BINS
from listingmart.functions.coercion import FALSE_WORDS, TRUE_WORDS
from listingmart.operators.filters import (
    MAX_ONLY_COLUMNS,
    MIN_ONLY_COLUMNS,
    SLIDER_COLUMNS,
    WHOLE_NUMBER_COLUMNS,
)
from listingmart.operators.yields import YIELD_CATEGORIES
from listingmart.plans.reports import BOX_CATEGORIES, CLIPPED, HISTOGRAM_BINS
from listingmart.schema import AMENITY_COLUMNS, FLOAT_COLUMNS, INTEGER_COLUMNS, VALUE_LABELS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def one_of(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def boolean(c: str) -> str:
    word = f"lower(trim({c}))"
    return f"CASE WHEN {word} IN {one_of(TRUE_WORDS)} THEN true WHEN {word} IN {one_of(FALSE_WORDS)} THEN false END"


def whole(c: str) -> str:
    return f"CAST(round_even({c}, 0) AS BIGINT)"


def number_key(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), '-999999.0')"


KEY_PARTS = [
    "CAST(round_even(lat * 10000, 0) / 10000 AS VARCHAR)",
    "CAST(round_even(lon * 10000, 0) / 10000 AS VARCHAR)",
    "CAST(round_even(area_m2 / 1.0, 0) * 1.0 AS VARCHAR)",
    "market",
    "city",
    "listing_type",
    *(number_key(c) for c in ("build_year", "floors_total", "floor")),
    *(
        f"CASE WHEN {c} THEN '1' ELSE '0' END"
        for c in ("has_elevator", "has_balcony", "has_parking_space", "has_security", "has_storage_room")
    ),
]

TYPED = ", ".join(
    [
        "listing_id, market, listing_type, month, ownership, building_material, condition",
        r"regexp_replace(trim(lower(city)), '\s+', ' ', 'g') AS city",
        *(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in ("price", "area_m2", *FLOAT_COLUMNS)),
        *(f"nullif(TRY_CAST({c} AS DOUBLE), -999999.0) AS {c}" for c in INTEGER_COLUMNS),
        *(f"{boolean(c)} AS {c}" for c in AMENITY_COLUMNS),
    ]
)

BOXES = ", ".join(
    f"({text(name)}, {x0!r}, {y0!r}, {x1!r}, {y1!r})" for name, x0, y0, x1, y1 in rectangles()
)

SLUG = r"regexp_replace(trim(lower(d.name)), '\s+', '_', 'g')"

REST = ", ".join(
    ["listing_id, market, month, city, listing_type, district, ownership, building_material, condition",
     "area_m2, price, property_fingerprint", *FLOAT_COLUMNS, *AMENITY_COLUMNS]
)


def bin_case(column: str) -> str:
    edges, labels = BINS[column]
    whens = " ".join(f"WHEN {column} <= {e} THEN {text(lab)}" for e, lab in zip(edges, labels))
    return f"CASE {whens} WHEN {column} > {edges[-1]} THEN {text(labels[-1])} END AS {column}_bin"


PREFIX = f"""
WITH raw AS ({RAW_SQL}),
typed AS (SELECT {TYPED} FROM raw),
boxes(name, x0, y0, x1, y1) AS (VALUES {BOXES}),
valid AS (
  SELECT * FROM typed
  WHERE month IS NOT NULL AND city IS NOT NULL AND listing_type IS NOT NULL AND market IS NOT NULL
    AND price > 0 AND area_m2 > 0 AND city = 'warszawa' AND lat IS NOT NULL AND lon IS NOT NULL),
keyed AS (
  SELECT v.*, {SLUG} AS district, concat_ws('|', {", ".join(KEY_PARTS)}) AS property_fingerprint
  FROM valid v LEFT JOIN boxes d ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1),
long AS (
  SELECT {REST}, {", ".join(f"{whole(c)} AS {c}" for c in INTEGER_COLUMNS)}, price / area_m2 AS price_per_m2
  FROM keyed
  QUALIFY row_number() OVER (PARTITION BY property_fingerprint, month ORDER BY price DESC, listing_id) = 1),
static AS (
  SELECT * FROM long
  QUALIFY row_number() OVER (PARTITION BY property_fingerprint ORDER BY month DESC, price DESC, listing_id) = 1),
binned AS (SELECT *, {", ".join(bin_case(c) for c in BINS)} FROM static),
sale AS (SELECT * FROM binned WHERE market = 'sale'),
rent AS (SELECT * FROM binned WHERE market = 'rent')
"""


def r6(expression: str, name: str) -> str:
    return f"round_even(({expression}) * 1000000, 0) / 1000000 AS {name}"


def listing(source: str, where: str = "true") -> str:
    return f"""SELECT listing_id, market, month, city, listing_type, district, {r6("area_m2", "area_m2")},
      {r6("price", "price")}, {r6("price_per_m2", "price_per_m2")} FROM {source} WHERE {where}"""


def q(c: str, p: float) -> str:
    return f"quantile_cont({c}, {p})"


def label(column: str, source: str = "") -> str:
    raw = f"CAST({source or column} AS VARCHAR)"
    labels = VALUE_LABELS.get(column)
    if not labels:
        return raw
    whens = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in labels.items())
    return f"CASE {raw} {whens} ELSE {raw} END"


def mart(source: str, name: str) -> str:
    return f"""{name} AS (SELECT month, city, count(*) AS n_listings, {q("price_per_m2", 0.5)} AS median_ppm2,
      {q("price_per_m2", 0.25)} AS p25_ppm2, {q("price_per_m2", 0.75)} AS p75_ppm2, avg(price_per_m2) AS avg_ppm2
      FROM long WHERE market = '{source}' GROUP BY month, city)"""


MARTS = f", {mart('sale', 'mart_sale')}, {mart('rent', 'mart_rent')}"
PROXY = """, proxy AS (SELECT s.month, s.city, s.n_listings AS n_sale, r.n_listings AS n_rent,
  s.median_ppm2 AS sale_median_ppm2, r.median_ppm2 AS rent_median_ppm2,
  r.median_ppm2 * 12.0 / nullif(s.median_ppm2, 0) AS gross_yield_proxy
  FROM mart_sale s JOIN mart_rent r ON s.month = r.month AND s.city = r.city)"""


def mart_rows(source: str) -> str:
    return f"""{MARTS} SELECT month, city, n_listings, {r6("median_ppm2", "median_ppm2")}, {r6("p25_ppm2", "p25_ppm2")},
      {r6("p75_ppm2", "p75_ppm2")}, {r6("avg_ppm2", "avg_ppm2")} FROM mart_{source}"""


def bounds_cte(source: str, p_low: float = 0.01, p_high: float = 0.99, where: str = "true") -> str:
    parts = ", ".join(f"{q(c, p_low)} AS {c}_lo, {q(c, p_high)} AS {c}_hi" for c in CLIPPED)
    return f", b AS (SELECT {parts} FROM {source} WHERE {where})"


def clip(c: str) -> str:
    return f"greatest({c}_lo, least({c}_hi, {c}))"


CLIPPED_SALE = (
    bounds_cte("sale") + f", c AS (SELECT sale.*, {clip('price_per_m2')} AS v FROM sale, b WHERE price_per_m2 IS NOT NULL)"
)

RANGE_WHERE = "area_m2 >= 30 AND area_m2 <= 60 AND price <= 60000 AND build_year >= 1950"
ENUM_WHERE = "listing_type IN ('tenement', 'blockOfFlats') AND condition = 'premium'"
COMBINED_WHERE = """district IN ('wola', 'mokotów', 'ursus', 'bemowo', 'ochota', 'praga_północ')
  AND floor >= 0 AND floor <= 15 AND has_elevator"""


def default_bounds(source: str) -> str:
    rows = []
    for c in SLIDER_COLUMNS:
        lo, hi = q(c, 0.01), q(c, 0.99)
        rows.append(f"SELECT '{c}' AS \"column\", {lo} AS lo, CASE WHEN {hi} > {lo} THEN {hi} ELSE {lo} + 1 END AS hi FROM {source}")
    for c in WHOLE_NUMBER_COLUMNS:
        lo = f"greatest(trunc(min({c})), trunc({q(c, 0.01)}))"
        hi = f"least(trunc(max({c})), trunc({q(c, 0.99)}))"
        rows.append(f"SELECT '{c}', least({lo}, {hi}), greatest({lo}, {hi}) FROM {source}")
    for c in MAX_ONLY_COLUMNS:
        lo, hi = q(c, 0.01), q(c, 0.99)
        rows.append(f"SELECT '{c}', NULL, CASE WHEN {hi} > {lo} THEN {hi} ELSE {lo} + 1 END FROM {source}")
    for c in MIN_ONLY_COLUMNS:
        rows.append(f"SELECT '{c}', trunc(greatest(0, {q(c, 0.01)})), NULL FROM {source}")
    return " UNION ALL ".join(rows)


def default_where() -> str:
    parts = [f"{c} >= {c}_lo AND {c} <= {c}_hi" for c in (*SLIDER_COLUMNS, *WHOLE_NUMBER_COLUMNS)]
    parts += [f"{c} <= {c}_hi" for c in MAX_ONLY_COLUMNS] + [f"{c} >= {c}_lo" for c in MIN_ONLY_COLUMNS]
    return " AND ".join(parts)


def default_wide(source: str) -> str:
    columns = (*SLIDER_COLUMNS, *WHOLE_NUMBER_COLUMNS, *MAX_ONLY_COLUMNS, *MIN_ONLY_COLUMNS)
    parts = ", ".join(
        f"max(lo) FILTER (\"column\" = '{c}') AS {c}_lo, max(hi) FILTER (\"column\" = '{c}') AS {c}_hi" for c in columns
    )
    # One unit in the twelfth digit keeps a bound that equals a value on the value's side.
    return f""", bounds AS ({default_bounds(source)}),
      nudged AS (SELECT "column", lo - abs(lo) * 1e-12 AS lo, hi + abs(hi) * 1e-12 AS hi FROM bounds),
      wide AS (SELECT {parts} FROM nudged)"""


def boxes(keys: str, source: str, min_n: int, names: str) -> str:
    """Box statistics of ``v`` in ``source`` per ``keys``."""
    return f""", s AS (SELECT {keys} AS k, count(v) AS n, avg(v) AS mean, min(v) AS min, {q("v", 0.25)} AS p25,
      {q("v", 0.5)} AS median, {q("v", 0.75)} AS p75, max(v) AS max FROM {source} WHERE {keys} IS NOT NULL GROUP BY 1),
    f AS (SELECT k, v, v >= p25 - (p75 - p25) * 1.5 AND v <= p75 + (p75 - p25) * 1.5 AS inside
      FROM {source} JOIN s ON {keys} = k),
    w AS (SELECT k, min(v) FILTER (inside) AS whisker_low, max(v) FILTER (inside) AS whisker_high,
      CAST(count(*) FILTER (NOT inside) AS BIGINT) AS n_outliers FROM f GROUP BY k)
    SELECT {names}, n, {", ".join(r6(c, c) for c in ("mean", "min", "p25", "median", "p75", "max", "whisker_low", "whisker_high"))},
      n_outliers FROM s JOIN w USING (k) WHERE n >= {min_n}"""


def box_by(category: str) -> str:
    return CLIPPED_SALE + boxes(
        category, "c", 30, f"CAST(k AS VARCHAR) AS {category}, {label(category, 'k')} AS label"
    )


def bench(category: str) -> str:
    return f""", bench AS (SELECT {category} AS k, {q("price_per_m2", 0.5)} AS sale_ppm2_benchmark
      FROM sale WHERE {category} IS NOT NULL GROUP BY 1)"""


def yield_rows(category: str, where: str = "true") -> str:
    return bench(category) + f""", y AS (SELECT rent.*, sale_ppm2_benchmark,
      price_per_m2 * 12 / nullif(sale_ppm2_benchmark, 0) * 100 AS gross_yield_pct
      FROM rent JOIN bench ON {category} = k WHERE {where})"""


def summary(category: str, where: str = "true") -> str:
    return yield_rows(category, where) + f""", summary AS (SELECT {category}, count(gross_yield_pct) AS n,
      {q("gross_yield_pct", 0.5)} AS median, {q("gross_yield_pct", 0.25)} AS p25, {q("gross_yield_pct", 0.75)} AS p75,
      avg(gross_yield_pct) AS mean FROM y GROUP BY {category} HAVING count(gross_yield_pct) >= 10)"""


def yield_by(category: str, where: str = "true") -> str:
    return summary(category, where) + f""" SELECT {category}, n, {r6("median", "median")}, {r6("p25", "p25")},
      {r6("p75", "p75")}, {r6("mean", "mean")}, {label(category)} AS label FROM summary"""


def latest(source: str, column: str) -> str:
    return f""", ranked AS (SELECT city, month, {column} AS value, row_number() OVER (PARTITION BY city ORDER BY month DESC) AS nth,
      FROM {source}), last AS (SELECT city, max(month) AS latest_month, count(DISTINCT month) AS n_months,
      max(value) FILTER (nth = 1) AS latest, max(value) FILTER (nth = 2) AS previous FROM ranked GROUP BY city),
    changed AS (SELECT *, (latest - previous) / nullif(previous, 0) * 100 AS change_pct FROM last)
    SELECT city, latest_month, n_months, {r6("latest", "latest")}, {r6("previous", "previous")}, {r6("change_pct", "change_pct")},
      CASE WHEN change_pct > 0 THEN 'up' WHEN change_pct < 0 THEN 'down' WHEN change_pct = 0 THEN 'flat' END AS direction
    FROM changed"""


def trend_rows() -> str:
    metrics = {
        "listings": "count(*)",
        "median_price_per_m2": q("price_per_m2", 0.5),
        "median_price": q("price", 0.5),
        "avg_area_m2": "avg(area_m2)",
    }
    return """, months AS (SELECT DISTINCT month FROM sale ORDER BY month DESC LIMIT 2)""" + " UNION ALL ".join(
        f"""{"," if i == 0 else ""} {f"m AS (" if i == 0 else ""}SELECT '{name}' AS metric, month, CAST({e} AS DOUBLE) AS value
        FROM sale WHERE month IN (SELECT month FROM months) GROUP BY month"""
        for i, (name, e) in enumerate(metrics.items())
    ) + f"""), p AS (SELECT metric, max(value) FILTER (month = (SELECT max(month) FROM months)) AS latest,
      max(value) FILTER (month = (SELECT min(month) FROM months)) AS previous FROM m GROUP BY metric),
    d AS (SELECT *, (latest - previous) / nullif(previous, 0) * 100 AS change_pct FROM p)
    SELECT metric, {r6("latest", "latest")}, {r6("previous", "previous")}, {r6("change_pct", "change_pct")},
      CASE WHEN change_pct > 0 THEN 'up' WHEN change_pct < 0 THEN 'down' WHEN change_pct = 0 THEN 'flat' END AS direction FROM d"""


def repeat_groups(source: str, key: str = "property_fingerprint") -> str:
    return f""", g AS (SELECT {key} AS property_fingerprint, count(*) AS n_records, count(DISTINCT month) AS n_months,
      min(month) AS min_month, max(month) AS max_month FROM {source} GROUP BY 1)"""


REPEAT_STATS = """ SELECT CAST(sum(n_records) AS BIGINT) AS total_records, count(*) AS total_fingerprints,
  count(*) FILTER (n_records > 1) AS repeating_fingerprints,
  CAST(coalesce(sum(n_records) FILTER (n_records > 1), 0) AS BIGINT) AS repeating_records,
  round_even(coalesce(sum(n_records) FILTER (n_records > 1), 0) / sum(n_records) * 1000000, 0) / 1000000 AS repeating_records_share,
  count(*) FILTER (n_months > 1) AS multi_month_fingerprints,
  CAST(coalesce(sum(n_records) FILTER (n_months > 1), 0) AS BIGINT) AS multi_month_records,
  round_even(coalesce(sum(n_records) FILTER (n_months > 1), 0) / sum(n_records) * 1000000, 0) / 1000000 AS multi_month_records_share FROM g"""

COMPLETE = "month IS NOT NULL AND price IS NOT NULL AND area_m2 IS NOT NULL AND city IS NOT NULL AND listing_type IS NOT NULL AND market IS NOT NULL"
POSITIVE = f"{COMPLETE} AND price > 0 AND area_m2 > 0"
IN_CITY = f"{POSITIVE} AND city = 'warszawa'"

COARSE_KEY = (
    "concat_ws('|', CAST(round_even(lat * 100, 0) / 100 AS VARCHAR), CAST(round_even(lon * 100, 0) / 100 AS VARCHAR), "
    "CAST(round_even(area_m2 / 5.0, 0) * 5.0 AS VARCHAR), market, coalesce(CAST(CAST(floor AS DOUBLE) AS VARCHAR), '-999999.0'), "
    "CASE WHEN has_balcony THEN '1' ELSE '0' END)"
)
PREVALENCE_KEY = "concat_ws('|', " + ", ".join(
    [
        "CAST(round_even(lat * 1000, 0) / 1000 AS VARCHAR)",
        "CAST(round_even(lon * 1000, 0) / 1000 AS VARCHAR)",
        "CAST(round_even(area_m2 / 10.0, 0) * 10.0 AS VARCHAR)",
        *(p.replace("build_year", "CAST(build_year AS DOUBLE)").replace("floors_total", "CAST(floors_total AS DOUBLE)")
          if "999999" in p else p for p in KEY_PARTS[3:]),
    ]
) + ")"


def statements() -> dict[str, str]:
    labels = ("district", "listing_type", "condition", "building_material")
    long_columns = ", ".join(
        [
            "listing_id, city, listing_type, ownership, building_material, condition, district, property_fingerprint, market, month",
            *AMENITY_COLUMNS,
            *INTEGER_COLUMNS,
            *(r6(c, c) for c in ("area_m2", "price", "price_per_m2", *FLOAT_COLUMNS)),
        ]
    )
    out = {
        "clean_counts": f""" SELECT count(*) AS n_raw, count(*) FILTER ({COMPLETE}) AS n_complete, count(*) FILTER ({POSITIVE}) AS n_valid,
          count(*) FILTER ({IN_CITY}) AS n_city, count(*) FILTER ({IN_CITY} AND lat IS NOT NULL AND lon IS NOT NULL) AS n_placed FROM typed""",
        "coerced": f""" SELECT listing_id, market, month, city, {", ".join(r6(c, c) for c in ("price", "area_m2", "lat", "lon", "poi_count", "pharmacy_distance"))},
          {", ".join(f"{whole(c)} AS {c}" for c in ("rooms", "floor", "build_year"))}, {", ".join(AMENITY_COLUMNS)} FROM typed""",
        "long_rows": f" SELECT {long_columns} FROM long",
        "fingerprints": " SELECT listing_id, month, property_fingerprint FROM keyed",
        "fingerprint_coarse": f" SELECT {COARSE_KEY} AS coarse_fingerprint, count(*) AS n FROM long GROUP BY 1",
        "dedup_within_month": f" SELECT property_fingerprint, month, listing_id, {r6('price', 'price')} FROM long",
        "dedup_removed": """ SELECT (SELECT count(*) FROM keyed) AS rows_before, (SELECT count(*) FROM long) AS rows_after,
          (SELECT count(*) FROM keyed) - (SELECT count(*) FROM long) AS rows_removed""",
        "district_assignment": f""" SELECT listing_id, {SLUG} AS district FROM typed
          LEFT JOIN boxes d ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 WHERE lat IS NOT NULL AND lon IS NOT NULL""",
        "district_counts": f""" SELECT {SLUG} AS district, count(*) AS n FROM typed
          JOIN boxes d ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 GROUP BY 1""",
        "mart_sale": mart_rows("sale"),
        "mart_rent": mart_rows("rent"),
        "mart_yield_proxy": f"""{MARTS}{PROXY} SELECT month, city, n_sale, n_rent, {r6("sale_median_ppm2", "sale_median_ppm2")},
          {r6("rent_median_ppm2", "rent_median_ppm2")}, {r6("gross_yield_proxy", "gross_yield_proxy")} FROM proxy""",
        "mart_projection_ordered": f"{MARTS} SELECT month, city, n_listings, {r6('median_ppm2', 'median_ppm2')} FROM mart_sale ORDER BY month, city",
        "static_sale": " " + listing("static", "market = 'sale'"),
        "static_rent": " " + listing("static", "market = 'rent'"),
        "listings_all_qa": """ SELECT market, count(*) AS n, count(*) FILTER (price <= 0) AS bad_price,
          count(*) FILTER (area_m2 <= 0) AS bad_area, count(*) FILTER (price_per_m2 IS NULL) AS null_ppm2 FROM long GROUP BY market""",
        "static_all": " " + listing("static"),
        "filter_enum": " " + listing("static", ENUM_WHERE),
        "filter_range": " " + listing("static", RANGE_WHERE),
        "filter_bool": " " + listing("static", "has_elevator AND has_balcony"),
        "filter_combined": " " + listing("static", COMBINED_WHERE),
        "default_filter_bounds": f""", bounds AS ({default_bounds("sale")})
          SELECT "column", {r6("lo", "lo")}, {r6("hi", "hi")} FROM bounds""",
        "filter_options": ", o AS (" + " UNION ".join(
            f"SELECT '{c}' AS \"column\", {c} AS raw, {label(c)} AS display FROM sale WHERE {c} IS NOT NULL" for c in VALUE_LABELS
        ) + ") SELECT * FROM o",
        "clip_bounds": bounds_cte("sale") + " " + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {r6(f'{c}_lo', 'lo')}, {r6(f'{c}_hi', 'hi')} FROM b" for c in CLIPPED
        ),
        "winsorized": bounds_cte("sale") + f" SELECT listing_id, {r6(clip('price_per_m2'), 'clipped_ppm2')} FROM sale, b",
        "view": bounds_cte("sale", 0.05, 0.95, RANGE_WHERE) + f""" SELECT listing_id, {", ".join(r6(clip(c), c) for c in CLIPPED)}
          FROM sale, b WHERE {RANGE_WHERE}""",
        "default_view": default_wide("rent") + " " + listing("rent, wide", default_where()),
        "kpi": f""" SELECT count(*) AS n_listings, {r6(q("price_per_m2", 0.5), "median_price_per_m2")},
          {r6(q("price", 0.5), "median_price")}, {r6("avg(area_m2)", "avg_area_m2")} FROM sale""",
        "kpi_trend": trend_rows(),
        "histogram": CLIPPED_SALE + f""", span AS (SELECT min(v) AS lo, (max(v) - min(v)) / {HISTOGRAM_BINS}.0 AS w FROM c),
          h AS (SELECT least({HISTOGRAM_BINS - 1}, floor((v - lo) / w)) AS bin, any_value(lo) AS lo, any_value(w) AS w, count(*) AS n
            FROM c, span GROUP BY 1)
          SELECT CAST(bin AS BIGINT) AS bin, {r6("lo + bin * w", "bin_lo")}, {r6("lo + (bin + 1) * w", "bin_hi")}, n FROM h""",
        "histogram_median": CLIPPED_SALE + f" SELECT count(*) AS n, {r6(q('v', 0.5), 'median')} FROM c",
        "box_overall": CLIPPED_SALE + boxes("'price_per_m2'", "c", 0, 'k AS "column"'),
        "box_outliers": f""", l AS (SELECT {q("price", 0.25)} AS p25, {q("price", 0.75)} AS p75 FROM rent)
          SELECT {r6("price", "value")} FROM rent, l WHERE price < p25 - (p75 - p25) * 1.5 OR price > p75 + (p75 - p25) * 1.5""",
        "ols_trendline": CLIPPED_SALE + f""" SELECT CAST(regr_count(v, centre_distance) AS BIGINT) AS n, {r6("regr_slope(v, centre_distance)", "slope")},
          {r6("regr_intercept(v, centre_distance)", "intercept")}, {r6("regr_r2(v, centre_distance)", "r2")} FROM c""",
        "scatter_points": CLIPPED_SALE + f" SELECT CAST(build_year AS DOUBLE) AS x, {r6('v', 'y')} FROM c WHERE build_year IS NOT NULL",
        "bins": " SELECT listing_id, floor_bin, floors_total_bin, build_year_bin FROM binned",
        "sale_benchmark": bench("district") + f" SELECT k AS district, {r6('sale_ppm2_benchmark', 'sale_ppm2_benchmark')} FROM bench",
        "yield_rows": yield_rows("district") + f""" SELECT listing_id, district, {r6("sale_ppm2_benchmark", "sale_ppm2_benchmark")},
          {r6("gross_yield_pct", "gross_yield_pct")} FROM y""",
        "yield_median_of_medians": summary("district") + f" SELECT count(*) AS n_groups, {r6(q('median', 0.5), 'yield_median')} FROM summary",
        "yield_filtered": yield_by("district", ENUM_WHERE),
        "mom_change": f"""{MARTS} SELECT month, city, {r6("median_ppm2", "median_ppm2")},
          {r6("(median_ppm2 / lag(median_ppm2) OVER (PARTITION BY city ORDER BY month) - 1) * 100", "median_ppm2_mom")} FROM mart_sale""",
        "mom_latest": MARTS + latest("mart_rent", "median_ppm2"),
        "yield_latest": MARTS + PROXY + latest("proxy", "gross_yield_proxy * 100"),
        "repeat_groups": repeat_groups("long") + " SELECT * FROM g",
        "repeat_stats": repeat_groups("keyed") + REPEAT_STATS,
        "top_repeats": repeat_groups("long") + " SELECT * FROM g ORDER BY n_months DESC, n_records DESC, property_fingerprint LIMIT 20",
        "repeat_prevalence": ", r AS (SELECT * FROM long WHERE market = 'rent')" + repeat_groups("r", PREVALENCE_KEY) + REPEAT_STATS,
        "labels": f" SELECT listing_id, {', '.join(f'{label(c)} AS {c}_label' for c in labels)} FROM static",
        "value_counts": " SELECT month, count(*) AS n FROM raw GROUP BY month",
        "value_counts_amenity": " SELECT has_elevator, count(*) AS n FROM sale WHERE has_elevator IS NOT NULL GROUP BY 1 ORDER BY n DESC LIMIT 5",
        "load_profile": " SELECT market, min(month) AS min_month, max(month) AS max_month, count(*) AS n_rows, '' AS missing_columns FROM raw GROUP BY market",
        "newest_listings": f""" SELECT month, city, district, listing_type, {r6("area_m2", "area_m2")}, {r6("price", "price")}, {r6("price_per_m2", "price_per_m2")}
          FROM long WHERE market = 'sale' ORDER BY month DESC, listing_id LIMIT 10""",
        "preview": " " + listing("sale", COMBINED_WHERE) + " ORDER BY month DESC, listing_id LIMIT 200",
        "csv_round_trip": " " + listing("static", "market = 'sale'"),
        "csv_to_long": f" SELECT * REPLACE (CASE WHEN month(month) % 3 <> 2 THEN condition END AS condition) FROM (SELECT {long_columns} FROM long)",
        "sql_mart_sale": mart_rows("sale"),
        "sql_static_rent": " " + listing("static", "market = 'rent'"),
        "mart_after_refresh": mart_rows("sale"),
        "static_after_refresh": " " + listing("static", "market = 'sale'"),
        "state_quantiles": " " + " UNION ALL ".join(
            f"""SELECT city, '{c}' AS metric, count({c}) AS n, {r6(q(c, 0.01), "p01")}, {r6(q(c, 0.5), "median")}, {r6(q(c, 0.99), "p99")}
              FROM long WHERE market = 'sale' GROUP BY city""" for c in ("price_per_m2", "price", "area_m2")
        ),
    }
    out |= {f"box_by_{c}": box_by(c) for c in BOX_CATEGORIES}
    out |= {f"yield_by_{c}": yield_by(c) for c in YIELD_CATEGORIES}
    return {name: (PREFIX + sql).strip() for name, sql in out.items()}
