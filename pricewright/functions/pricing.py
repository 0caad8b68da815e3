"""Scalar formulas of the pricing process as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clip, half_up

TWO_PI = 2 * math.pi

# The known product categories, in index order.
CATEGORY_NAMES = ("physical_good", "subscription", "service", "digital", "perishable")

# Price bounds as multiples of the base price.
PRICE_FLOOR_FACTOR = 0.5
PRICE_CEILING_FACTOR = 2.0


# --- calendar ---------------------------------------------------------------


def day_of_week(date: Column) -> Column:
    """Monday is 0."""
    return F.weekday(date)


def day_of_year(date: Column) -> Column:
    """1 to 366."""
    return F.dayofyear(date)


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def week_sin(dow: Column) -> Column:
    return F.sin(F.lit(TWO_PI) * dow / F.lit(7))


def week_cos(dow: Column) -> Column:
    return F.cos(F.lit(TWO_PI) * dow / F.lit(7))


def year_sin(doy: Column) -> Column:
    """Day 366 goes past a full turn on purpose: the divisor stays 365."""
    return F.sin(F.lit(TWO_PI) * doy / F.lit(365))


def seasonal_factor(t: Column, weekly: Column, annual: Column, peak: Column, trend: Column) -> Column:
    """Weekly wave, annual wave with its own phase, and a linear trend over day ``t``."""
    return (
        F.lit(1.0)
        + weekly * F.sin(F.lit(TWO_PI) * t / F.lit(7))
        + annual * F.sin(F.lit(TWO_PI) * (t - peak) / F.lit(365))
        + trend * t
    )


def simple_seasonal(doy: Column, amplitude: float = 0.15) -> Column:
    return F.lit(1.0) + F.lit(amplitude) * year_sin(doy)


# --- demand, stock and reward -----------------------------------------------


def unclamped_demand(base_demand: Column, seasonal: Column, price: Column, base_price: Column, elasticity: Column) -> Column:
    return base_demand * seasonal * F.pow(price / base_price, elasticity)


def demand_curve(base_demand: Column, seasonal: Column, price: Column, base_price: Column, elasticity: Column) -> Column:
    return F.greatest(F.lit(0.0), unclamped_demand(base_demand, seasonal, price, base_price, elasticity))


def noisy_demand(raw: Column, z: Column, noise_std: Column) -> Column:
    return F.greatest(F.lit(0.0), raw + z * noise_std * raw)


def whole_units(demand: Column) -> Column:
    """Truncate towards zero."""
    return demand.cast("bigint")


def units_sold(demand: Column, inventory: Column) -> Column:
    return F.least(whole_units(demand), inventory)


def lost_units(demand: Column, inventory: Column) -> Column:
    return F.greatest(F.lit(0), whole_units(demand) - inventory)


def next_inventory(inventory: Column, sold: Column, restock: int, max_inventory: int) -> Column:
    return F.least(F.lit(max_inventory), F.greatest(F.lit(0), inventory - sold) + F.lit(restock))


def reward_scale(base_demand: Column, base_price: Column) -> Column:
    return F.greatest(F.lit(1.0), base_demand * base_price)


def step_reward(
    sold: Column,
    price: Column,
    lost: Column,
    inventory_before: Column,
    stockout_penalty: float = 2.0,
    overstock_penalty: float = 0.001,
) -> Column:
    """Revenue less both penalties; stock is the stock before the sale."""
    return sold * price - F.lit(stockout_penalty) * lost - F.lit(overstock_penalty) * inventory_before


# --- price levels -----------------------------------------------------------


def price_bounds(base_price: Column, digits: int | None = 2) -> tuple[Column, Column]:
    low = base_price * F.lit(PRICE_FLOOR_FACTOR)
    high = base_price * F.lit(PRICE_CEILING_FACTOR)
    if digits is None:
        return low, high
    return half_up(low, digits), half_up(high, digits)


def level_price(level: Column, low: Column, high: Column, levels: int) -> Column:
    return low + level * (high - low) / F.lit(levels - 1)


def price_grid(low: Column, high: Column, levels: int = 11) -> Column:
    steps = F.sequence(F.lit(0), F.lit(levels - 1))
    return F.transform(steps, lambda i: level_price(i, low, high, levels))


def nearest_level(grid: Column, price: Column) -> Column:
    """Index of the closest grid price; the lower index wins a tie."""
    gaps = F.transform(grid, lambda g: F.abs(g - price))
    return (F.array_position(gaps, F.array_min(gaps)) - F.lit(1)).cast("int")


def revenue_maximising_price(base_price: Column, elasticity: Column) -> Column:
    size = F.abs(elasticity)
    return F.when(size > 1, base_price * size / (size - F.lit(1.0))).otherwise(base_price * F.lit(1.5))


# --- observation parts ------------------------------------------------------


def category_index(category: Column) -> Column:
    text = F.replace(F.replace(F.lower(category), F.lit(" & "), F.lit("_")), F.lit(" "), F.lit("_"))
    found = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(CATEGORY_NAMES))):
        found = F.when(text.contains(name), F.lit(i)).otherwise(found)
    return F.coalesce(found, F.lit(0))


def category_signal(category: Column) -> Column:
    return category_index(category) / F.lit(float(len(CATEGORY_NAMES) - 1)) * F.lit(2.0) - F.lit(1.0)


def price_ratio(price: Column, base_price: Column) -> Column:
    return clip((price / base_price - F.lit(1.0)) / F.lit(0.5), -2.0, 2.0)


def inventory_ratio(inventory: Column, max_inventory: int) -> Column:
    return inventory / F.lit(float(max_inventory)) * F.lit(2.0) - F.lit(1.0)


def stockout_risk(inventory: Column, max_inventory: int) -> Column:
    return F.lit(1.0) - inventory / F.lit(float(max_inventory))


def elasticity_signal(elasticity: Column) -> Column:
    return clip(elasticity / F.lit(3.0), -2.0, 2.0)


def demand_trend(mean_units: Column, base_demand: Column) -> Column:
    return clip(mean_units / (base_demand + F.lit(1e-8)) - F.lit(1.0), -2.0, 2.0)


def price_momentum(newest: Column, oldest: Column, base_price: Column) -> Column:
    return clip((newest - oldest) / (base_price + F.lit(1e-8)), -1.0, 1.0)


# --- learning formulas ------------------------------------------------------


def geometric_epsilon(n: Column, start: float = 1.0, end: float = 0.05, decay: float = 0.995) -> Column:
    return F.greatest(F.lit(end), F.lit(start) * F.pow(F.lit(decay), n))


def linear_epsilon(step: Column, slope: float = 0.05, start: float = 0.3, end: float = 0.05) -> Column:
    return F.greatest(F.lit(end), F.lit(start) - F.lit(slope) * step)


def huber(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 1, F.lit(0.5) * d * d).otherwise(size - F.lit(0.5))


def td_target(reward: Column, next_value: Column, done: Column, gamma: float = 0.99, clamp: float = 50.0) -> Column:
    carry = F.when(done, F.lit(0.0)).otherwise(F.lit(1.0))
    return clip(reward + F.lit(gamma) * next_value * carry, -clamp, clamp)


def product_code(i: Column) -> Column:
    """``P000``, ``P001``, ..."""
    return F.format_string("P%03d", i)
