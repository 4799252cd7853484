"""Series over keys that may be hot: row numbers, halo chunks, two-level running values, as-of.

A window partitioned by the key alone puts a hot key into one task. Every operator here splits the
series of a key into chunks, works per (key, chunk), and carries what crosses a chunk border through
a summary that holds one row per (key, chunk).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY, TS = "symbol", "ts"


def time_chunk(ts: str = TS, width: str = "day") -> Column:
    return F.date_trunc(width, F.col(ts))


def _over(parts: list[str], order: str, frame: str = "") -> str:
    return f"OVER (PARTITION BY {', '.join(parts) or '0'} ORDER BY {order} {frame})"


UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def with_row_index(df: DataFrame, key: str = KEY, ts: str = TS, width: str = "month",
                   out: str = "idx") -> DataFrame:
    """Dense 0-based row number per key in time order, numbered per (key, month) plus offsets.

    A table that already carries the number keeps it.
    """
    if out in df.columns:
        return df
    piece = df.selectExpr("*", f"date_trunc('{width}', {ts}) AS _piece")
    offsets = piece.groupBy(key, "_piece").agg(F.expr("count(1) AS _n")).selectExpr(
        key, "_piece", f"coalesce(sum(_n) {_over([key], '_piece', EARLIER)}, 0) AS _offset")
    numbered = piece.selectExpr("*", f"row_number() {_over([key, '_piece'], ts)} AS _rn")
    return numbered.join(offsets, [key, "_piece"]).selectExpr(
        *df.columns, f"_offset + _rn - 1 AS {out}")


def halo_chunks(df: DataFrame, rows: int, halo: int, idx: str = "idx") -> DataFrame:
    """Cut each series into chunks of ``rows`` rows and repeat the last ``halo`` rows of a chunk at
    the head of the next one, so that any frame of at most ``halo`` preceding rows is whole.

    Adds ``chunk``, ``pos`` (position counted from the first halo row) and ``is_halo``.
    """
    if halo > rows:
        raise ValueError("the halo may not be longer than a chunk")
    own = f"{idx} div {rows}"
    chunks = (f"explode(CASE WHEN {idx} % {rows} >= {rows - halo} THEN array({own}, {own} + 1) "
              f"ELSE array({own}) END) AS chunk")
    return df.selectExpr("*", chunks).selectExpr(
        "*", f"chunk <> {own} AS is_halo", f"{idx} - chunk * {rows} + {halo} AS pos")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("NOT is_halo").drop("is_halo", "pos")


# kind of running value: (chunk total, carry of earlier chunks, value inside the chunk, combination)
_KINDS = {
    "sum": ("sum({c})", "sum({s})", "sum({c})", "coalesce({w}, 0) + coalesce({k}, 0)"),
    "max": ("max({c})", "max({s})", "max({c})", "greatest({w}, {k})"),
    "last": ("max_by({c}, {o}) FILTER (WHERE {c} IS NOT NULL)", "last({s}, true)",
             "last({c}, true)", "coalesce({w}, {k})"),
    "first": ("min_by({c}, {o}) FILTER (WHERE {c} IS NOT NULL)", "first({s}, true)",
              "first({c}, true)", "coalesce({k}, {w})"),
}


def running(df: DataFrame, specs: dict[str, tuple[str, str]], key: str | list[str], chunk: str,
            order: list[str]) -> DataFrame:
    """Running values over a whole series: ``specs`` maps output name to (kind, column), kind being
    ``sum``, ``max``, ``last`` (last non-null) or ``first`` (first non-null).

    Per-chunk running value combined with the carry of all earlier chunks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    by = f"struct({', '.join(order)})"
    totals, carried, local, combined = [], [], [], []
    for out, (kind, col) in specs.items():
        total, carry, inside, both = _KINDS[kind]
        totals.append(F.expr(total.format(c=col, o=by) + f" AS _s_{out}"))
        carried.append(carry.format(s=f"_s_{out}") + f" {_over(keys, chunk, EARLIER)} AS _k_{out}")
        local.append(inside.format(c=col)
                     + f" {_over([*keys, chunk], ', '.join(order), UPTO)} AS _w_{out}")
        combined.append(both.format(w=f"_w_{out}", k=f"_k_{out}") + f" AS {out}")
    carries = df.groupBy(*keys, chunk).agg(*totals).selectExpr(*keys, chunk, *carried)
    return (
        df.selectExpr("*", *local).join(carries, [*keys, chunk], "left")
        .selectExpr(*df.columns, *combined)
    )


@dataclass(frozen=True)
class Right:
    """One right side of an as-of join: its rows, wanted columns and time column. ``strict`` leaves
    out rows at exactly the left row's time."""

    df: DataFrame
    columns: list[str]
    ts: str = TS
    strict: bool = False


def asof_many(left: DataFrame, rights: list[Right], key: str | None = KEY, left_ts: str = TS,
              width: str = "day", until: str | None = None) -> DataFrame:
    """Backward as-of join against several tables at once: each left row gets the columns of the
    last row of each right table with its key and ``right_ts <= left_ts`` (``<`` when strict), or
    nulls.

    All sides are stacked and read with one running frame per (key, time chunk). The last right
    rows before a chunk enter it as one extra row, so a hot key splits by time. Which chunks need
    such a row is read from the left table; ``until`` (a time no left row exceeds) saves that pass
    over it by giving every chunk up to then one. The right tables are read twice: store them.
    """
    keys = [key] if key else []
    names = [f"_r{i}" for i in range(len(rights))]
    chunked = f"date_trunc('{width}', _ts) AS _chunk"
    stacked = None
    for name, right in zip(names, rights):
        rows = right.df.selectExpr(*keys, f"{right.ts} AS _ts", f"{2 * right.strict} AS _side",
                                   f"struct({', '.join(right.columns)}) AS {name}")
        stacked = rows if stacked is None else stacked.unionByName(rows, allowMissingColumns=True)
    right_rows = stacked.selectExpr("*", chunked)
    left_rows = left.selectExpr(*keys, f"{left_ts} AS _ts", "1 AS _side", "struct(*) AS _left",
                                f"date_trunc('{width}', {left_ts}) AS _chunk")
    stacked = right_rows.unionByName(left_rows, allowMissingColumns=True)
    lasts = [F.expr(f"max_by({r}, _ts) FILTER (WHERE {r} IS NOT NULL) AS {r}") for r in names]
    if until is None:
        summary = stacked.groupBy(*keys, "_chunk").agg(
            F.expr("bool_or(_left IS NOT NULL) AS _need"), *lasts)
        carries = summary.selectExpr(
            *keys, "_chunk", "_need",
            *[f"last({r}, true) {_over(keys, '_chunk', EARLIER)} AS {r}" for r in names]
        ).where("_need").drop("_need")
    else:
        step = f"INTERVAL 1 {width}"
        end = f"timestamp_micros({until})" if isinstance(until, int) else f"TIMESTAMP '{until}'"
        stop = f"least(_last_left, coalesce(_next, date_trunc('{width}', {end})))"
        # a key needs carries up to its last left row only
        needed = stacked.where("_left IS NOT NULL").groupBy(*keys).agg(
            F.max("_chunk").alias("_last_left")) if keys else None
        carries = right_rows.groupBy(*keys, "_chunk").agg(*lasts).selectExpr(
            *keys, f"_chunk + {step} AS _from", f"lead(_chunk) {_over(keys, '_chunk')} AS _next",
            *[f"last({r}, true) {_over(keys, '_chunk', UPTO)} AS {r}" for r in names]
        )
        if keys:
            carries = carries.join(needed, keys)
        else:  # one row
            last = stacked.where("_left IS NOT NULL").agg(F.max("_chunk").alias("at")).first()["at"]
            carries = carries.withColumn("_last_left", F.lit(last).cast("timestamp"))
        carries = carries.where(f"_from <= {stop}").selectExpr(
            *keys, f"explode(sequence(_from, {stop}, {step})) AS _chunk", *names)
    carries = carries.selectExpr("*", "_chunk AS _ts", "-1 AS _side")
    frame = _over([*keys, "_chunk"], "_ts, _side", UPTO)
    return (
        stacked.unionByName(carries, allowMissingColumns=True)
        .selectExpr("_left", *[f"last({r}, true) {frame} AS {r}" for r in names])
        .where("_left IS NOT NULL").select("_left.*", *[f"{r}.*" for r in names])
    )


def asof(left: DataFrame, right: DataFrame, columns: list[str], key: str | None = KEY,
         left_ts: str = TS, right_ts: str = TS, width: str = "day",
         until: str | None = None) -> DataFrame:
    """Backward as-of join against one table, see ``asof_many``."""
    return asof_many(left, [Right(right, columns, right_ts)], key, left_ts, width, until)


def asof_grid(left: DataFrame, right: DataFrame, columns: list[str], left_ts: str = TS,
              step_s: int = 900) -> DataFrame:
    """Backward as-of join against one keyless series on a time grid, as an equi-join.

    The series is filled to one row per grid slot (its size is the calendar's, not the data's), so
    the left table is read once and keeps its partitioning if the filled series is small enough to
    be broadcast at run time. Left rows past the series' end take its last slot. Series rows between two
    slots count from the next slot on; of several rows in a slot the last counts.
    """
    micros = step_s * 1_000_000
    slots = right.selectExpr(f"(unix_micros(ts) + {micros - 1}) div {micros} AS _slot",
                             f"struct({', '.join(columns)}) AS _v", "ts") \
        .groupBy("_slot").agg(F.max_by("_v", "ts").alias("_v"))
    ends = slots.agg(F.min("_slot").alias("lo"), F.max("_slot").alias("hi")).first()
    if ends.hi is None:
        return left.selectExpr("*", *[f"CAST(NULL AS {right.schema[c].dataType.simpleString()}) "
                                      f"AS {c}" for c in columns])
    every = left.sparkSession.range(ends.lo, ends.hi + 1).withColumnRenamed("id", "_slot")
    part = "_slot div 2880"
    filled = every.join(slots, "_slot", "left").selectExpr("*", f"{part} AS _part")
    filled = running(filled, {"_at": ("last", "_v")}, [], "_part", ["_slot"]).select(
        "_slot", "_at.*")
    slot = f"least(unix_seconds({left_ts}) div {step_s}, {ends.hi})"
    return left.selectExpr("*", f"{slot} AS _slot").join(filled, "_slot", "left").select(
        *left.columns, *columns)
