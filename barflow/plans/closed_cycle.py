"""The closed loop: cycles that remember what they bought, and exits that give symbol and cash back.

What a candidate's position would come to depends on its symbol and entry only, not on anything else that
was bought. So every candidate that could be bought is followed to its exit first, all at once: in rounds of one time block,
where the positions open in a symbol's block meet the block's polls in one task, and those still open
go on to the symbol's next block.

What was bought depends on cash, and cash on everything before, so the decisions are one pass over the
cycles in order. It reads at most ``top_n`` rows a cycle, each with its ready legs, and holds cash, open legs and
expiries. Accounts run beside each other; an account's cycles run in chunks of time, each a task of its own that
starts from the state the one before has written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.config import REASON_BALANCE, REASON_MODEL, REASON_ONE_PICK, REASON_REGIME, REGIME_FLAT, Rules
from barflow.functions.money import first_tier, lot_floor, sellable, stop_width
from barflow.operators import decide, exits
from barflow.session import stored

CANDIDATE = ["account", "cycle_ts", "rank", "symbol", "cash", "ask", "lot_step", "btc_ok", "regime", "ai_score",
             "risk_score"]
LEGS = "legs array<struct<t:double,exit_code:string,cost:double,net:double,is_final:boolean>>"
OPEN = f"position_id string, symbol string, block bigint, {exits.HELD_SCHEMA}"


def text_columns(schema: str) -> list[str]:
    return [c.split()[0].strip("`") for c in schema.split(", ") if c.split()[1] == "string"]


def with_text(pdf: pd.DataFrame, schema: str) -> pd.DataFrame:
    """Text columns as Python objects, also where all values are missing, which pandas makes numbers of."""
    return pdf.assign(**{c: pdf[c].astype(object).where(pdf[c].notna(), None) for c in text_columns(schema)})


# --- what each position would come to ----------------------------------------------------------------


def entry_states(entries: DataFrame, block_s: int, rules: Rules = Rules()) -> DataFrame:
    """Positions (position_id, symbol, entry_ts, entry_price, cost, qty, lot_step, atr_pct, is_whale) as OPEN rows."""
    t = F.unix_micros("entry_ts") / 1e6
    ready = {
        "entry_price": F.col("entry_price"), "cost": F.col("cost"), "qty": F.col("qty"),
        "lot_step": F.coalesce("lot_step", F.lit(0.0)), "stop_ratio": stop_width("atr_pct", "is_whale", rules),
        "first_tier": first_tier("atr_pct", rules), "entry_t": t, "clock_t": t, "top": F.lit(0.0),
        "half": F.lit(False), "rsi_checked_t": F.lit(exits.NEVER), "stale_checked_t": F.lit(exits.NEVER),
        "closed": F.lit(False)}
    return entries.select(
        F.col("position_id").cast("string").alias("position_id"), "symbol", F.floor(t / block_s).alias("block"),
        *[v.cast("boolean" if k in ("half", "closed") else "double").alias(k) for k, v in ready.items()])


def followed(entries: DataFrame, polls: DataFrame, block_s: int = 604_800, rules: Rules = Rules()) -> DataFrame:
    """Legs (see ``exits.LEG_SCHEMA``) of every position in ``entries``, however many a symbol has at a time.

    ``polls``: symbol and ``exits.POLL_COLUMNS``. A task holds one block's polls of a symbol, at most one for each polling
    interval, and the positions open in it.
    """
    polls = stored(polls.withColumn("block", F.floor(F.col("t") / block_s)), "polls")
    blocks = stored(polls.select("symbol", "block").distinct(), "blocks")

    def move(key, opened: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        seen = seen.sort_values("t", ignore_index=True)
        times, legs, left = seen["t"].to_numpy(float), [], []
        for row in opened.itertuples(index=False):
            pid, symbol, block, *values = row
            held = exits.Held(*values)
            sold = exits.advance(held, seen.iloc[times.searchsorted(held.entry_t, side="right"):], rules)
            if sold:
                legs.append(exits.legs_frame(sold, pid, symbol))
            if not held.closed:
                left.append((pid, symbol, block, *held.as_row()))
        out = pd.concat(legs, ignore_index=True) if legs else pd.DataFrame(columns=exits.LEG_COLUMNS)
        names = [c.split()[0] for c in OPEN.split(", ")]
        rest = pd.DataFrame(left, columns=names).add_prefix("o_")
        return with_text(pd.concat([out, rest], ignore_index=True).reindex(columns=columns), moved)

    moved = ", ".join([exits.LEG_SCHEMA, *[f"o_{c}" for c in OPEN.split(", ")]])
    columns = [c.split()[0] for c in moved.split(", ")]
    opened, parts = entry_states(entries, block_s, rules), []
    while True:
        # each goes to the first block of its symbol that has polls, from its own on
        placed = opened.withColumnRenamed("block", "_from").join(blocks, "symbol").where("block >= _from").groupBy(
            "position_id").agg(F.min("block").alias("block"))
        opened = stored(opened.drop("block").join(placed, "position_id").select(
            *[c.split()[0] for c in OPEN.split(", ")]), "open")
        if opened.isEmpty():
            break
        wanted = polls.join(opened.select("symbol", "block").distinct(), ["symbol", "block"], "left_semi")
        done = stored(opened.groupBy("symbol", "block").cogroup(wanted.groupBy("symbol", "block")).applyInPandas(
            move, moved), "moved")
        parts.append(done.where("position_id IS NOT NULL").select(*exits.LEG_COLUMNS))
        names = [c.split()[0] for c in OPEN.split(", ")]
        opened = done.where("o_position_id IS NOT NULL").select(*[
            (F.col("o_block") + 1 if c == "block" else F.col(f"o_{c}")).alias(c) for c in names])
    if not parts:
        return entries.sparkSession.createDataFrame([], exits.LEG_SCHEMA)
    legs = parts[0]
    for part in parts[1:]:
        legs = legs.unionByName(part)
    return legs


# --- the pass over the cycles --------------------------------------------------------------------------


@dataclass
class Account:
    """What one cycle leaves to the next. ``legs``: sales to come, as (time, symbol, code, money, final)."""

    cash: float
    legs: list[tuple] = field(default_factory=list)
    held: set[str] = field(default_factory=set)
    cooling: dict[str, float] = field(default_factory=dict)
    listed: dict[str, float] = field(default_factory=dict)
    stops: dict[str, int] = field(default_factory=dict)

    def settle(self, now: float, rules: Rules) -> None:
        """Take in the sales up to ``now``."""
        due = sorted(leg for leg in self.legs if leg[0] <= now)
        self.legs = [leg for leg in self.legs if leg[0] > now]
        for t, symbol, code, money, final in due:
            self.cash += money
            if final:
                self.held.discard(symbol)
                self.cooling[symbol] = t + rules.cooldown_s
                if code == "STOP":
                    self.stops[symbol] = self.stops.get(symbol, 0) + 1
                    if self.stops[symbol] >= rules.blacklist_stops:
                        self.stops[symbol], self.listed[symbol] = 0, t + rules.blacklist_s
                elif code == "TREND":
                    self.stops[symbol] = 0
        self.cooling = {s: t for s, t in self.cooling.items() if t > now}
        self.listed = {s: t for s, t in self.listed.items() if t > now}
        self.stops = {s: n for s, n in self.stops.items() if n}

    def barred(self, symbol: str) -> str | None:
        return ("HELD" if symbol in self.held else "COOLING" if symbol in self.cooling
                else "BLACKLISTED" if symbol in self.listed else None)

    def buy(self, symbol: str, paid: float, legs, fee: float) -> None:
        self.cash -= paid
        self.held.add(symbol)
        self.legs += [(leg["t"], symbol, leg["exit_code"], leg["cost"] * (1 + fee) + leg["net"], bool(leg["is_final"]))
                      for leg in legs]


def decide_cycle(account: Account, rows: list, rules: Rules) -> list[tuple]:
    """(decision, reason) of a cycle's candidates in rank order; a bought one enters the account."""
    bought, out = None, []
    free = account.cash
    for row in rows:
        bar = account.barred(row.symbol) if row is not bought else None
        if not row.btc_ok:
            out.append(("CLOSED", None))
        elif bar:
            out.append((bar, None))
        elif row.red:
            out.append(("SHADOW", REASON_MODEL))
        elif row.flat:
            out.append(("SHADOW", REASON_REGIME))
        elif bought is not None:
            out.append(("SHADOW", REASON_ONE_PICK))
        elif free < row.cash * rules.cash_margin:
            out.append(("SHADOW", REASON_BALANCE))
        elif not row.fills:
            out.append(("NO_FILL", None))
        else:
            bought = row
            out.append(("BUY", None))
    if bought is not None:
        paid = bought.quantity * bought.ask * (1 + rules.fee)
        # a position that is never sold has no legs: null, which pandas gives as NaN
        sold = bought.legs if isinstance(bought.legs, (list, np.ndarray)) else []
        account.buy(bought.symbol, paid, sold, rules.fee)
    return out


def gated(candidates: DataFrame, rules: Rules = Rules(), has_model: bool = True) -> DataFrame:
    """Candidates (CANDIDATE and more) with what does not depend on the account: red, flat, quantity, fills."""
    df = candidates.withColumns({
        "btc_ok": F.coalesce("btc_ok", F.lit(False)), "red": decide.model_rejects(rules, has_model),
        "flat": F.coalesce(F.col("regime") == REGIME_FLAT, F.lit(False)),
        "quantity": lot_floor(F.col("cash") / F.col("ask"), F.col("lot_step"))})
    return df.withColumn("fills", F.coalesce(sellable("quantity", "ask", rules.min_notional), F.lit(False)))


def positions_to_follow(gated_rows: DataFrame) -> DataFrame:
    """A position for each candidate that some account could buy; accounts with equal orders share one."""
    buyable = gated_rows.where("btc_ok AND NOT red AND NOT flat AND fills")
    return buyable.select(
        position_key().alias("position_id"), "symbol", F.col("cycle_ts").alias("entry_ts"), F.col("ask").alias("entry_price"),
        (F.col("quantity") * F.col("ask")).alias("cost"), F.col("quantity").alias("qty"), "lot_step", "atr_pct",
        "is_whale").dropDuplicates(["position_id"])


def position_key():
    return F.concat_ws("@", "symbol", F.unix_micros("cycle_ts").cast("string"), F.col("quantity").cast("string"))


def run(candidates: DataFrame, polls: DataFrame, accounts: DataFrame, rules: Rules = Rules(), has_model: bool = True,
        chunk: str = "month", block_s: int = 604_800) -> DataFrame:
    """One row per candidate with its decision under the account's own past.

    ``candidates``: CANDIDATE with atr_pct and is_whale; ``polls``: symbol and ``exits.POLL_COLUMNS``; ``accounts``: account,
    cash. Adds decision, reason, free_cash, n_held and stop_count as the cycle found them.
    """
    rows = stored(gated(candidates, rules, has_model), "gated")
    legs = followed(positions_to_follow(rows), polls, block_s, rules)
    sold = legs.groupBy("position_id").agg(F.array_sort(F.collect_list(F.struct(
        (F.unix_micros("ts") / 1e6).alias("t"), "exit_code", "cost", "net", "is_final"))).alias("legs"))
    ready = stored(rows.withColumn("position_id", position_key()).join(sold, "position_id", "left").drop("position_id")
                   .withColumn("chunk", F.date_trunc(chunk, "cycle_ts")), "ready", ["chunk"])
    columns = [f for f in ready.schema if f.name not in ("chunk", "legs")]
    names = [f.name for f in columns]
    added = ["decision", "reason", "free_cash", "n_held", "stop_count"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in columns]) + (
        ", decision string, reason string, free_cash double, n_held int, stop_count int, _state string")

    def fold(key, found: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if before.empty:  # no such account
            return pd.DataFrame(columns=[*names, *added, "_state"])
        account = Account(float(before["cash"].iloc[0])) if before["_state"].isna().all() else restored(
            before["_state"].iloc[0])
        found = found.sort_values(["cycle_ts", "rank", "symbol"], ignore_index=True)
        out = []
        for at, cycle in found.groupby("cycle_ts", sort=True):
            account.settle(at.value / 1e9, rules)
            free, held, stops = account.cash, len(account.held), dict(account.stops)
            group = list(cycle.itertuples(index=False))
            out += [(*d, free, held, stops.get(row.symbol, 0))
                    for row, d in zip(group, decide_cycle(account, group, rules), strict=True)]
        done = found[names].assign(**dict(zip(added, zip(*out), strict=True))) if out else found.reindex(columns=[*names, *added])
        last = pd.DataFrame({"account": [key[0]], "_state": [saved(account)]})
        return with_text(pd.concat([done.assign(_state=None), last], ignore_index=True).reindex(
            columns=[*names, *added, "_state"]), schema)

    state = accounts.select("account", "cash", F.lit(None).cast("string").alias("_state"))
    parts = []
    for r in ready.select("chunk").distinct().orderBy("chunk").collect():  # one for each chunk of the calendar
        now = ready.where(F.col("chunk") == F.lit(r["chunk"])).drop("chunk")
        done = stored(now.groupBy("account").cogroup(state.groupBy("account")).applyInPandas(fold, schema), "decided")
        parts.append(done.where("_state IS NULL").drop("_state"))
        moved = done.where("_state IS NOT NULL").select("account", F.col("_state").alias("_new"))
        # accounts without a candidate in the chunk stay as they were
        state = stored(state.join(moved, "account", "left").select(
            "account", "cash", F.coalesce("_new", "_state").alias("_state")), "accounts")
    if not parts:
        return ready.drop("chunk", "legs").selectExpr(
            "*", "CAST(NULL AS STRING) AS decision", "CAST(NULL AS STRING) AS reason", "CAST(NULL AS DOUBLE) AS free_cash",
            "0 AS n_held", "0 AS stop_count")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def saved(account: Account) -> str:
    import json

    return json.dumps([account.cash, account.legs, sorted(account.held), account.cooling, account.listed, account.stops])


def restored(text: str) -> Account:
    import json

    cash, legs, held, cooling, listed, stops = json.loads(text)
    return Account(cash, [tuple(leg) for leg in legs], set(held), cooling, listed, stops)
