"""Affine scan: linear recurrences over ordered rows, in chunks.

state_t = keep_t * A @ state_(t-1) + v_t with constant A and keep_t 0 or 1. Chunks of a series are reduced on their own to what
they add to a state and whether they pass one on; the chunks of a series, few and small, give each its state to start from;
then each chunk runs once more. So a long series is the work of many tasks, none of which holds more than a chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 20_000


def _run(a: np.ndarray, keep: np.ndarray, v: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States of all rows: rows in blocks of about the root of their number, all blocks advanced together from zero, then what
    each block starts from is passed on and added."""
    n, k = v.shape
    size = max(1, int(np.ceil(np.sqrt(n))))
    blocks = -(-n // size)
    x, on = np.zeros((blocks * size, k)), np.ones(blocks * size, bool)
    x[:n], on[:n] = v, keep
    x, on = x.reshape(blocks, size, k), on.reshape(blocks, size)
    for t in range(1, size):
        x[:, t] += np.where(on[:, t, None], x[:, t - 1] @ a.T, 0)
    whole = np.logical_and.accumulate(on, axis=1)  # no row so far starts anew
    powers = np.empty((size, k, k))
    powers[0] = a
    for t in range(1, size):
        powers[t] = powers[t - 1] @ a
    starts = np.empty((blocks, k))
    for b in range(blocks):
        starts[b] = state
        state = x[b, -1] + (powers[-1] @ state if whole[b, -1] else 0)
    x += np.where(whole[:, :, None], np.einsum("tij,bj->bti", powers, starts), 0)
    return x.reshape(-1, k)[:n]


def affine_scan(df: DataFrame, keys: Sequence[str], idx: str, a: np.ndarray, keep: Column, inputs: Sequence[Column], names: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """df with the columns names: the states at each row, by idx, the row's number in its series from 1."""
    k = len(names)
    work = df.withColumn("_chunk", F.floor((F.col(idx) - 1) / chunk).cast("int")).withColumn("_keep", keep.cast("boolean")).withColumns({f"_v{i}": c.cast("double") for i, c in enumerate(inputs)})
    slim = [*keys, "_chunk", idx, "_keep", *(f"_v{i}" for i in range(k))]
    key_schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def unpack(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        g.sort_values(idx, inplace=True)
        return g["_keep"].to_numpy(), g[[f"_v{i}" for i in range(k)]].to_numpy()

    def reduced(g: pd.DataFrame) -> pd.DataFrame:
        kept, v = unpack(g)
        passes = bool(kept.all())
        matrix = np.linalg.matrix_power(a, len(v)) if passes else np.zeros((k, k))
        end = _run(a, kept, v, np.zeros(k))[-1]
        return pd.DataFrame({**{c: [g[c].iloc[0]] for c in keys}, "_chunk": [g["_chunk"].iloc[0]], "_m": [matrix.ravel().tolist()], "_b": [end.tolist()]})

    def carried(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_chunk")
        state, out = np.zeros(k), []
        for m, b in zip(g["_m"], g["_b"], strict=True):
            out.append(state.tolist())
            state = np.asarray(m).reshape(k, k) @ state + np.asarray(b)
        return pd.DataFrame({**{c: g[c] for c in keys}, "_chunk": g["_chunk"], "_in": out})

    def run(g: pd.DataFrame) -> pd.DataFrame:
        start = np.asarray(g["_in"].iloc[0])
        kept, v = unpack(g)
        out = _run(a, kept, v, start)
        return pd.DataFrame({**{c: g[c] for c in keys}, idx: g[idx], **{n: out[:, i] for i, n in enumerate(names)}})

    per_chunk = work.select(*slim).groupBy(*keys, "_chunk").applyInPandas(reduced, f"{key_schema}, _chunk int, _m array<double>, _b array<double>")
    starts = per_chunk.groupBy(*keys).applyInPandas(carried, f"{key_schema}, _chunk int, _in array<double>")
    states = work.select(*slim).join(starts, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(run, f"{key_schema}, `{idx}` long, " + ", ".join(f"`{n}` double" for n in names))
    return df.join(states, [*keys, idx])
