"""Order books and fills as arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def notional(levels: Column, depth: int) -> Column:
    """Sum of price times quantity over the first ``depth`` levels."""
    top = F.slice(levels, 1, depth)
    return F.aggregate(top, F.lit(0.0), lambda acc, x: acc + x["price"] * x["qty"])


def imbalance(bids: Column, asks: Column, depth: int = 20) -> Column:
    """Bid notional over ask notional; 0 without an ask side."""
    ask = notional(asks, depth)
    return F.coalesce(F.when(ask > 0, notional(bids, depth) / ask), F.lit(0.0))


def best_ask(asks: Column) -> Column:
    return F.try_element_at(asks, F.lit(1))["price"]


def fill_price(average: Column, fills: Column, fallback: Column) -> Column:
    """Average of an order, else the amount-weighted price of its fills, else the fallback.

    A zero average counts as missing.
    """
    amount = F.aggregate(fills, F.lit(0.0), lambda acc, x: acc + x["amount"])
    money = F.aggregate(fills, F.lit(0.0), lambda acc, x: acc + x["price"] * x["amount"])
    weighted = F.when(amount > 0, money / amount)
    return F.coalesce(F.nullif(average, F.lit(0.0)), F.nullif(weighted, F.lit(0.0)), fallback)


def fill_prices(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """The same for long tables: ``fills(order_id, price, amount)`` and
    ``orders(order_id, average, fallback)``. Fills combine before the shuffle."""
    sums = fills.groupBy("order_id").agg(
        F.sum("amount").alias("_amount"), F.sum(F.col("price") * F.col("amount")).alias("_money"))
    weighted = F.when(F.col("_amount") > 0, F.col("_money") / F.col("_amount"))
    return orders.join(sums, "order_id", "left").select(
        "order_id",
        F.coalesce(F.nullif("average", F.lit(0.0)), F.nullif(weighted, F.lit(0.0)),
                   F.col("fallback")).alias("fill_price"),
    )
