"""Aggregate spellings used by the marts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def uniq_exact(value: Column) -> Column:
    return F.count_distinct(value)


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def uniq_exact_if(value: Column, condition: Column) -> Column:
    return F.count_distinct(F.when(condition, value))


def sum_if(value: Column, condition: Column) -> Column:
    """Sum where the condition holds; a group without such rows gives 0, not NULL."""
    return sum_or_zero(F.when(condition, value))


def sum_money(price: Column, condition: Column | None = None) -> Column:
    """Exact sum of prices as money, where the condition holds; 0 without rows.

    Prices of any number type are first rounded to ``decimal(12,2)``, as staging would.
    Whole cents are then added as long values: a sum of decimal(12,2) needs more than 18
    digits, which makes each addition a slower big-number one.
    """
    cents = (price.cast("decimal(12,2)") * 100).cast("bigint")
    total = F.coalesce(F.sum(cents if condition is None else F.when(condition, cents)), F.lit(0))
    return (total.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")


def is_purchase() -> Column:
    return F.col("event_name") == "purchase"


def purchase_metrics(suffix: str = "") -> list[Column]:
    """Revenue, purchase count and exact buyers of the purchase rows of a group."""
    return [
        sum_if(F.col("price"), is_purchase()).cast("decimal(18,2)").alias(f"revenue{suffix}"),
        count_if(is_purchase()).alias(f"purchases{suffix}"),
        uniq_exact_if(F.col("user_id"), is_purchase()).alias(f"buyers{suffix}"),
    ]
