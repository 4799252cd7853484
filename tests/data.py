"""Small inputs shared by tests."""

from __future__ import annotations

import datetime as dt
import random

T0 = dt.datetime(2026, 1, 5)

# Invented trade rows in the stored layout: two legs of one position, stops, a lock, a trend exit.
TRADE_HEAD = ("Islem_Zamani,Sembol,Sinyal,Kasa_Tipi,Giris_RSI,Giris_Vol_Oran,Giris_ATR_Pct,Giris_Fiyat,"
              "Cikis_Fiyat,Kar_Orani,Net_Kar_USDT,Cikis_Tipi,Sure_Saat")


def trade_line(minute, symbol, cash, entry, exit_price, cost, label, age):
    net = (exit_price * 0.999 - entry * 1.001) / (entry * 1.001) * 100
    at = dt.datetime(2026, 9, 21, 0, 30) + dt.timedelta(minutes=minute)
    return (f"{at.isoformat(sep=' ')}.250000,{symbol},MSB,{cash},61.5,2.75,1.25,{entry!r},{exit_price!r},"
            f"{net!r},{cost * net / 100!r},{label},{age}")


TRADE_LINES = "\n".join([
    TRADE_HEAD,
    trade_line(5, "AAA/USDT", "NORMAL", 2.0, 2.06, 10.0, "DİNAMİK KISMİ KÂR", 0.5),
    trade_line(10, "BBB/USDT", "BALİNA", 0.5, 0.48, 40.0, "🛑 STOP LOSS (%-2.0)", 0.25),
    trade_line(20, "AAA/USDT", "NORMAL", 2.0, 2.05, 10.0, "📈 TREND TAKİPLİ ÇIKIŞ", 0.75),
    trade_line(50, "CCC/USDT", "NORMAL", 0.08, 0.077, 20.0, "🛑 STOP LOSS (%-2.5)", 0.1),
    trade_line(80, "DDD/USDT", "NORMAL", 5.0, 5.1, 10.0, "📈 TREND TAKİPLİ ÇIKIŞ", 7.5),
    trade_line(500, "EEE/USDT", "NORMAL", 0.25, 0.2525, 20.0, "🔒 KÂR KİLİDİ (+%1)", 1.5),
    "broken line,with,too,few", ""])

# Invented extended rows: 25 fields as the header says, and 27 after two columns were inserted.
V2_LINES = [
    "2026-09-10 10:00:00.500000,AAA/USDT,MSB,NORMAL,70.5,4.5,1.5,100.0,101.0,0.8,0.08,"
    "🛡️ BAŞA BAŞ KORUMASI,0.25,3.5,4.5,0.5,6.5,2.5,0.75,0.25,10,2,1,0.625,0.375",
    "2026-09-11 11:00:00.500000,BBB/USDT,MSB,NORMAL,80.5,2.5,2.5,0.5,0.52,3.8,0.38,DİNAMİK KISMİ KÂR,"
    "0.75,12.5,13.5,0.25,9.5,7.5,0.5,0.75,11,4,0,35.5,22.5,0.125,0.875",
    "2026-09-11 11:05:00.500000,BBB/USDT",
]

# Invented label row whose overflowing score fields ended up as a list inside one cell.
OVERFLOW_LINE = (
    "1789000000500,2026-09-10 00:26:40.500000,CCC/USDT,REJIM_YATAY,MSB,0.25,58.5,3.5,1.5,"
    "-0.5,0.75,1.25,2.25,0.5,0.25,0.5,12,3,0,18.5,16.5,\"['0.125', '0.375']\",2.5,2.75,-1.5")


def random_bars(symbols=("A", "B"), n=260, seed=7, gaps=True):
    rnd, rows = random.Random(seed), []
    for s in symbols:
        price, at = 100.0, T0
        for _ in range(n):
            at += dt.timedelta(minutes=15 * (rnd.choice([1, 1, 1, 2, 9]) if gaps else 1))
            o = price
            c = o * (1 + rnd.gauss(0, 0.01))
            h, low = max(o, c) * (1 + rnd.random() / 200), min(o, c) * (1 - rnd.random() / 200)
            rows.append((s, at, o, h, low, c, float(rnd.randint(0, 90))))
            price = c
    return rows


def bars_frame(spark, rows):
    return spark.createDataFrame(
        rows, "symbol string, ts timestamp, o double, h double, l double, c double, v double")
