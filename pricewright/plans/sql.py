"""SQL fragments shared by the checks.  They are written for DuckDB."""

from __future__ import annotations

from ..functions.numbers import HASH_RANGE, HASH_ROUNDS
from .registry import cte


def rnd(x: str, digits: int = 6) -> str:
    return f"CASE WHEN abs({x}) * 1e{digits} < 9007199254740992e0 THEN floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits} ELSE {x} END"


def clip(x: str, low: str, high: str) -> str:
    return f"greatest({low}, least({high}, {x}))"


def mixed_hash(k: str, episode: str, step: str, seed: int = 0) -> str:
    parts = []
    for p, (a, b, c, d) in HASH_ROUNDS:

        def part(x: str) -> str:
            return f"((CAST({x} AS BIGINT) % {p} + {p}) % {p})"

        x = f"(({part(k)} * {a} + {part(episode)} * {b} + {part(step)} * {c} + {(seed + 1) * d % p}) % {p})"
        parts.append(f"(({x} * {x}) % {p} * {x}) % {p}")
    return f"({parts[0]} * {1 << 31} + {parts[1]})"


def unit(k: str, episode: str, step: str, seed: int = 0) -> str:
    return f"least({mixed_hash(k, episode, step, seed)} / {float(HASH_RANGE)!r}::DOUBLE, 1e0 - pow(2e0, -53))"


def whole(x: str) -> str:
    return f"CAST(trunc({x}) AS BIGINT)"


def code_order(code: str) -> str:
    number = f"TRY_CAST({code} AS BIGINT)"
    return f"({number} IS NULL), {number}, {code}"


def level_price(level: str, low: str = "price_min", high: str = "price_max", levels: int = 11) -> str:
    return f"({low} + {level} * ({high} - {low}) / {float(levels - 1)}e0)"


def grid(low: str = "price_min", high: str = "price_max", levels: int = 11) -> str:
    return f"list_transform(range({levels}), lambda i: {level_price('i', low, high, levels)})"


def nearest(price: str, low: str = "price_min", high: str = "price_max", levels: int = 11) -> str:
    gaps = f"list_transform({grid(low, high, levels)}, lambda g: abs(g - ({price})))"
    return f"CAST(list_position({gaps}, list_min({gaps})) - 1 AS INTEGER)"


def optimal_price(base: str = "base_price", elasticity: str = "elasticity") -> str:
    e = f"abs({elasticity})"
    return f"(CASE WHEN {e} > 1 THEN {base} * {e} / ({e} - 1e0) ELSE {base} * 1.5e0 END)"


TWO_PI = "(2 * pi())"


def fit_ctes(grain: str) -> None:
    """Daily table, fit and fitted catalogue of the cleaned lines named ``clean_<grain>``."""
    cte(
        f"daily_{grain}",
        f"""
        SELECT "StockCode", "Date", avg("Price") AS avg_price, sum("Quantity") AS total_qty
        FROM clean_{grain} GROUP BY "StockCode", "Date" """,
    )
    cte(
        f"dense_{grain}",
        f"""
        SELECT * FROM daily_{grain} QUALIFY count(*) OVER (PARTITION BY "StockCode") >= 30""",
    )
    cte(
        f"points_{grain}",
        f"""
        SELECT *, abs(lp - avg(lp) OVER w) < 3 * stddev_pop(lp) OVER w
              AND abs(lq - avg(lq) OVER w) < 3 * stddev_pop(lq) OVER w
              AND min(lp) OVER w < max(lp) OVER w AND min(lq) OVER w < max(lq) OVER w AS inside
        FROM (SELECT *, ln(avg_price) AS lp, ln(total_qty) AS lq FROM dense_{grain}
              WHERE avg_price > 0 AND total_qty > 0)
        WINDOW w AS (PARTITION BY "StockCode")""",
    )
    cte(
        f"fits_{grain}",
        f"""
        SELECT "StockCode", base_price, base_demand, n_points, flat,
               CASE WHEN n_points < 10 THEN -1.5e0 ELSE greatest(-5e0, least(-0.1e0, flat)) END AS elasticity
        FROM (SELECT "StockCode", avg(avg_price) AS base_price, avg(total_qty) AS base_demand,
                     count(*) AS n_points,
                     CASE WHEN isnan(regr_slope(lq, lp) FILTER (WHERE inside)) THEN 0e0
                          ELSE coalesce(regr_slope(lq, lp) FILTER (WHERE inside), 0e0) END AS flat
              FROM points_{grain} GROUP BY "StockCode")""",
    )
    cte(
        f"fitted_{grain}",
        f"""
        SELECT "StockCode" AS product_id, {rnd('base_price', 2)} AS base_price,
               {rnd('elasticity', 3)} AS elasticity, {rnd('base_demand', 1)} AS base_demand,
               {rnd('base_price * 0.5e0', 2)} AS price_min, {rnd('base_price * 2e0', 2)} AS price_max
        FROM fits_{grain}""",
    )


for _grain, _key in (("supplier", "l_suppkey"), ("part", "l_partkey")):
    cte(
        f"lines_{_grain}",
        f"""
        SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS "Invoice",
               CAST({_key} AS VARCHAR) AS "StockCode", l_quantity AS "Quantity",
               l_extendedprice / l_quantity AS "Price", l_shipdate AS "InvoiceDate"
        FROM lineitem""",
    )
    cte(
        f"clean_{_grain}",
        f"""
        SELECT *, CAST("InvoiceDate" AS DATE) AS "Date" FROM lines_{_grain}
        WHERE NOT starts_with("Invoice", 'C') AND "Quantity" > 0 AND "Price" > 0
          AND NOT isnan("Quantity") AND NOT isnan("Price")
          AND "StockCode" IS NOT NULL AND "InvoiceDate" IS NOT NULL""",
    )
    fit_ctes(_grain)

cte(
    "described",
    """
    SELECT f.*, s_name AS name, 0.05e0 + (s_suppkey % 16) / 100e0 AS noise_std,
           ['Physical Good', 'Subscription Box', 'Home & Garden Service', 'Digital', 'Perishable',
            'Toys & Games'][CAST(s_suppkey % 6 + 1 AS INTEGER)] AS category
    FROM fitted_supplier f JOIN supplier ON CAST(s_suppkey AS VARCHAR) = f.product_id""",
)
cte(
    "series",
    f"""
    SELECT "StockCode" AS product_id, "Date" AS date, CAST(isodow("Date") - 1 AS INTEGER) AS day_of_week,
           CAST(dayofyear("Date") AS INTEGER) AS day_of_year, avg_price AS price, total_qty AS demand,
           avg_price * total_qty AS revenue,
           1e0 + 0.15e0 * sin({TWO_PI} * dayofyear("Date") / 365) AS seasonal
    FROM daily_supplier""",
)
cte(
    "indexed",
    """
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date) - 1 AS row_index,
           count(*) OVER (PARTITION BY product_id) AS n_rows
    FROM series""",
)


def template_sql() -> str:
    return """
    SELECT printf('P%03d', p_partkey) AS product_id, p_name AS name,
           CASE p_type WHEN 'ECONOMY' THEN 'Physical Good' WHEN 'SMALL' THEN 'Subscription Box'
                       WHEN 'STANDARD' THEN 'Home & Garden Service' WHEN 'MEDIUM' THEN 'Digital'
                       WHEN 'LARGE' THEN 'Perishable' WHEN 'PROMO' THEN 'Toys & Games' ELSE 'Other' END AS category,
           p_retailprice AS base_price, -0.5e0 - (p_partkey % 21) / 10e0 AS elasticity,
           20e0 + p_partkey % 181 AS base_demand, p_retailprice * 0.5e0 AS price_min,
           p_retailprice * 2e0 AS price_max, 0.05e0 + (p_partkey % 16) / 100e0 AS noise_std,
           p_partkey AS template_no
    FROM part"""


cte("templates", template_sql())
