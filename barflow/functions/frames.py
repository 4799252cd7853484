"""Helpers for pandas batches of partitions sorted by (symbol, chunk)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Re-cut batches sorted by (symbol, chunk) so that no group is split between two frames."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        symbol, chunk = batch["symbol"].iloc[-1], batch["chunk"].iloc[-1]
        same = ((batch["symbol"] == symbol) & (batch["chunk"] == chunk)).to_numpy()
        cut = len(batch) - int(np.argmin(same[::-1])) if not same.all() else 0
        last = held[0] if held else batch
        continues = last["symbol"].iloc[-1] == symbol and last["chunk"].iloc[-1] == chunk
        if cut or not continues:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def group_starts(pdf: pd.DataFrame) -> np.ndarray:
    symbol, chunk = pdf["symbol"].to_numpy(), pdf["chunk"].to_numpy()
    new = np.ones(len(pdf), bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (chunk[1:] != chunk[:-1])
    return np.flatnonzero(new)
