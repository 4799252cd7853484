"""Money expressions. Fees count on both sides of a trade."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barflow.config import Rules


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def net_ratio(entry, exit_, fee: float = Rules.fee) -> Column:
    """Net return of a round trip against what the purchase cost, fee included."""
    paid = _col(entry) * (1 + fee)
    return (_col(exit_) * (1 - fee) - paid) / paid


def net_pnl(entry, exit_, cost, fee: float = Rules.fee) -> Column:
    """Net profit of ``cost`` spent at ``entry`` and sold at ``exit_``."""
    return _col(cost) / _col(entry) * (_col(exit_) * (1 - fee) - _col(entry) * (1 + fee))


def lot_floor(quantity, step) -> Column:
    """Quantity cut down to whole lot steps; without a step the quantity itself."""
    q, s = _col(quantity), _col(step)
    return F.when(s > 0, F.floor(q / s) * s).otherwise(q)


def sellable(quantity, price, minimum: float = Rules.min_notional) -> Column:
    return _col(quantity) * _col(price) > minimum


def stop_width(atr_pct, is_whale, rules: Rules = Rules()) -> Column:
    """Stop distance as a ratio: fixed for whales, else a multiple of volatility within bounds."""
    scaled = _col(atr_pct) * rules.stop_atr_mult / 100
    bounded = F.greatest(F.lit(rules.stop_floor), F.least(F.lit(rules.stop_cap), scaled))
    return F.when(_col(is_whale), F.lit(rules.whale_stop)).otherwise(bounded)


def first_tier(atr_pct, rules: Rules = Rules()) -> Column:
    scaled = _col(atr_pct) * rules.tier_atr_mult / 100
    return F.greatest(F.lit(rules.tier_floor), F.least(F.lit(rules.tier_cap), scaled))
