"""Coercion, defaults and small string rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barflow.config import SIGNAL_CODES, Rules

def to_number(text: str) -> Column:
    """Double, or null where the text is no number. The cast alone would also take the type suffixes
    of Java literals ("1d") and hexadecimal floats."""
    literal = r"[xX]|[0-9.][dDfF]\s*$"
    return F.when(~F.col(text).rlike(literal), F.col(text).try_cast("double"))


def to_time(text: str) -> Column:
    """Timestamp, or null where the text is none."""
    return F.col(text).try_cast("timestamp")


def to_epoch_ms(text: str) -> Column:
    """Whole milliseconds; a fraction is cut off, anything else that is no number gives null."""
    return to_number(text).try_cast("bigint")


def or_default(value: Column, default) -> Column:
    """Value, with null and zero both counting as missing."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def signal_code(signal: str) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in SIGNAL_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.coalesce(F.col(signal), F.lit(""))), F.lit(0))


def is_loss(net: str, rules: Rules = Rules()) -> Column:
    return (F.col(net) < rules.loss_below).cast("int")


def is_profit(net: str, rules: Rules = Rules()) -> Column:
    return (F.col(net) > rules.profit_above).cast("int")


def base_coin(symbol: str) -> Column:
    return F.split_part(F.col(symbol), F.lit("/"), F.lit(1))


def pair_symbol(coin: str, quote: str = "USDT") -> Column:
    return F.concat(F.col(coin), F.lit("/" + quote))


def stored_exit_label(code: str, stop_ratio: str) -> Column:
    """Exit label as it stands in stored files; a stop names its width."""
    from barflow.config import EXIT_LABELS

    names = F.create_map(*[F.lit(x) for pair in EXIT_LABELS.items() for x in pair])
    name = F.try_element_at(names, F.col(code))
    width = F.format_string(" (%%-%.1f)", F.col(stop_ratio) * 100)
    return F.when(F.col(code) == "STOP", F.concat(name, width)).otherwise(name)


def entry_features(json_text: str, default_atr: float = Rules.default_atr_pct) -> Column:
    """Features kept with a position as JSON; unreadable text counts as empty."""
    schema = ("signal string, rsi double, vol_ratio double, atr_pct double, is_whale boolean")
    parsed = F.from_json(F.coalesce(F.col(json_text), F.lit("{}")), schema)
    return F.struct(
        parsed["signal"].alias("signal"), parsed["rsi"].alias("rsi"),
        parsed["vol_ratio"].alias("vol_ratio"),
        F.coalesce(parsed["atr_pct"], F.lit(default_atr)).alias("atr_pct"),
        F.coalesce(parsed["is_whale"], F.lit(False)).alias("is_whale"),
    )
