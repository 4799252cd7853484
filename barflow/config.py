"""Thresholds of every rule, in one frozen dataclass, and the fixed word lists."""

from __future__ import annotations

from dataclasses import dataclass

# Substrings that keep a symbol out of the universe.
BANNED = (
    "WLD", "SPK", "币安", "币安人生", "XUSD", "XAUT", "FDUSD", "USDC", "PAXG", "TUSD",
    "EUR", "GBP", "DAI", "TRY", "TRX", "BUSD", "USDP", "RLUSD",
)

# Coins of the wallet that are never adopted as positions.
RESERVED_COINS = ("USDT", "BNB")

# Rejection reasons as they stand in stored shadow files.
REASON_MODEL = "AI_RED"
REASON_REGIME = "REJIM_YATAY"
REASON_ONE_PICK = "TEK_ALIM_KURALI"
REASON_BALANCE = "BAKIYE_YETERSIZ"

# Regime names.
REGIME_TREND = "TREND"
REGIME_FLAT = "YATAY"

# Signal names and their ordinal codes.
SIGNAL_CODES = {"MSB": 1, "Engulf": 2}

# Wallet types.
WALLET_WHALE = "BALİNA"
WALLET_NORMAL = "NORMAL"


@dataclass(frozen=True)
class Rules:
    """All constants; a query passes its own instance to move a threshold."""

    # sizes and money
    normal_cash: float = 20.0
    whale_cash: float = 40.0
    cash_margin: float = 1.01
    fee: float = 0.001
    min_notional: float = 5.1
    min_quote_volume: float = 12_000_000.0
    dust_value: float = 1.0
    large_cost: float = 30.0
    orphan_value: float = 10.0
    top_n: int = 10

    # signal rules
    min_bars: int = 30
    min_rsi: float = 55.0
    min_vol_ratio: float = 2.5
    max_atr_ratio: float = 0.03
    whale_vol_ratio: float = 3.5
    whale_max_rsi: float = 65.0

    # model gate
    min_profit_score: float = 0.65
    max_risk_score: float = 0.45
    observe_only: bool = False

    # market context
    adx_trend: float = 20.0
    hysteresis: float = 0.004
    flash_drop: float = 0.015

    # exits (ratios of net return unless the name says otherwise)
    default_atr_pct: float = 2.5
    whale_stop: float = 0.020
    stop_atr_mult: float = 1.5
    stop_floor: float = 0.025
    stop_cap: float = 0.055
    tier_atr_mult: float = 2.0
    tier_floor: float = 0.03
    tier_cap: float = 0.06
    lock_from: float = 0.025
    lock_at: float = 0.010
    half_floor: float = 0.005
    # (running maximum from, give-back before a half sale, give-back before a full exit);
    # the last tier starts at the volatility-scaled first threshold of the position
    tiers: tuple = ((0.20, 0.05, 0.10), (0.10, 0.02, 0.05), (None, 0.015, 0.03))
    overheated_ratio: float = 0.05
    overheated_rsi: float = 83.0
    overheated_every_s: float = 60.0
    max_age_h: float = 4.0
    min_expectation: float = 0.005
    stale_age_h: float = 1.5
    stale_band: float = 0.01
    stale_every_s: float = 600.0

    # after an exit
    cooldown_s: int = 3600
    blacklist_s: int = 86_400
    blacklist_stops: int = 2

    # shadow signals and labels
    throttle_s: int = 900
    label_wait_h: float = 5.0
    label_give_up_h: float = 48.0
    label_bars: int = 16
    take_profit: float = 0.04
    stop_loss: float = -0.03

    # training
    loss_below: float = -0.1
    profit_above: float = 0.1
    test_share: float = 0.2
    min_positions: int = 100
    min_auc: float = 0.55


# Stored exit labels by code. STOP carries the stop width in the stored text.
EXIT_LABELS = {
    "OVERHEATED": "🚀 MOON BAG (%50 VURKAÇ)",
    "PARTIAL": "DİNAMİK KISMİ KÂR",
    "TREND": "📈 TREND TAKİPLİ ÇIKIŞ",
    "SAFE": "🛡️ GÜVENLİ ÇIKIŞ",
    "LOCK": "🔒 KÂR KİLİDİ (+%1)",
    "STOP": "🛑 STOP LOSS",
    "TIMEOUT": "⏳ ZAMAN AŞIMI",
    "STALE": "💤 MOMENTUM ÖLDÜ (YATAY REJİM)",
    "BREAK_EVEN": "🛡️ BAŞA BAŞ KORUMASI",
}
