"""Column layouts of stored files, and the names they have inside the library."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the trade log, in file order.
TRADE_COLUMNS = [
    "Islem_Zamani", "Sembol", "Sinyal", "Kasa_Tipi", "Giris_RSI", "Giris_Vol_Oran",
    "Giris_ATR_Pct", "Giris_Fiyat", "Cikis_Fiyat", "Kar_Orani", "Net_Kar_USDT", "Cikis_Tipi",
    "Sure_Saat",
]

# Library name to file column of the signal features, in file order.
FEATURE_COLUMNS = {
    "pump_3h": "Pump_3s", "pump_6h": "Pump_6s", "high_distance": "Zirve_Uzaklik",
    "ema_1h_distance": "EMA1h_Uzaklik", "ema_15m_distance": "EMA15m_Uzaklik",
    "btc_1h_change": "BTC_1h_Degisim", "btc_ema_distance": "BTC_EMA_Uzaklik",
    "hour": "Saat", "weekday": "Gun", "stop_count": "Stop_Sayisi",
    "sym_adx": "Sym_ADX", "btc_adx": "BTC_ADX",
    "closed_confirm": "Kapali_Mum_Onay", "book_ratio": "OB_Oran",
    "ai_score": "AI_Skor", "risk_score": "Filtre_Skor",
}

# Library name to file column of a trade.
TRADE_NAMES = dict(zip(
    ["ts", "symbol", "signal", "wallet", "rsi", "vol_ratio", "atr_pct", "entry_price",
     "exit_price", "net_pct", "net", "exit_label", "age_h"], TRADE_COLUMNS))

# Library name to file column of a signal that was not taken.
SHADOW_NAMES = {
    "ts_ms": "Ts", "signal_time": "Sinyal_Zamani", "symbol": "Sembol", "reason": "Sebep",
    "signal": "Sinyal", "price": "Fiyat", "rsi": "Giris_RSI", "vol_ratio": "Giris_Vol_Oran",
    "atr_pct": "Giris_ATR_Pct", **FEATURE_COLUMNS,
}

# Library name to file column of a label.
LABEL_NAMES = {"result_pct": "Sanal_Sonuc_Pct", "max_pct": "Max_Kar_Pct", "min_pct": "Min_Kar_Pct"}

TRADE_V2_COLUMNS = TRADE_COLUMNS + list(FEATURE_COLUMNS.values())
SHADOW_COLUMNS = list(SHADOW_NAMES.values())
LABELED_COLUMNS = SHADOW_COLUMNS + list(LABEL_NAMES.values())

# Older layouts of the same files by field count; newer columns were put before the score columns.
_ADX = ["Sym_ADX", "BTC_ADX"]
_NEW = _ADX + ["Kapali_Mum_Onay", "OB_Oran"]


def _without(columns: list[str], dropped: list[str]) -> list[str]:
    return [c for c in columns if c not in dropped]


def layouts_of(columns: list[str]) -> dict[int, list[str]]:
    """Known layouts of a file: today's, and those before the last two extensions."""
    known = [columns, _without(columns, _NEW[2:]), _without(columns, _NEW)]
    return {len(layout): layout for layout in known}


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


BARS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("tf", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    *[T.StructField(c, T.DoubleType()) for c in "ohlcv"],
])

_LEVELS = T.ArrayType(T.StructType([
    T.StructField("price", T.DoubleType()), T.StructField("qty", T.DoubleType())]))

ORDER_BOOKS = T.StructType([
    T.StructField("snapshot_ts", T.TimestampType()), T.StructField("symbol", T.StringType()),
    T.StructField("bids", _LEVELS), T.StructField("asks", _LEVELS),
])

TICKERS = T.StructType([
    T.StructField("snapshot_ts", T.TimestampType()), T.StructField("symbol", T.StringType()),
    T.StructField("last", T.DoubleType()), T.StructField("pct", T.DoubleType()),
    T.StructField("quote_volume", T.DoubleType()),
])

BALANCES = T.StructType([
    T.StructField("snapshot_ts", T.TimestampType()),
    T.StructField("total", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("free", T.MapType(T.StringType(), T.DoubleType())),
])
