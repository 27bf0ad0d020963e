"""Finite transducers run by composing transition functions.

A chunk of input symbols is a function from the state before it to the state
after it. Chunks are folded side by side, the chunk functions are composed by
a parallel prefix scan, and a second side-by-side pass with the known entry
states gives the state after every symbol. No chunk waits for another, so one
long document costs what many short ones do.
"""

from __future__ import annotations

import numpy as np


def prefix_compose(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of ``functions[k]``, an array of state maps.

    Hillis-Steele scan: after step d entry k holds the composition of the last
    2**d functions up to k.
    """
    out, step = functions.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def states_after(symbols: np.ndarray, table: np.ndarray, chunk: int = 64, start: int = 0) -> np.ndarray:
    """State after each symbol; ``table[symbol, state]`` is the next state."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.uint8)
    table = table.astype(np.uint8)
    idle = len(table)
    table = np.vstack([table, np.arange(table.shape[1], dtype=np.uint8)])
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, idle, np.intp)
    grid[:n] = symbols
    grid = grid.reshape(rows, chunk)
    maps = np.tile(np.arange(table.shape[1], dtype=np.uint8), (rows, 1))
    for k in range(chunk):
        maps = table[grid[:, k, None], maps]
    entry = np.full(rows, start, np.uint8)
    entry[1:] = prefix_compose(maps)[:-1, start]
    out = np.empty((rows, chunk), np.uint8)
    for k in range(chunk):
        entry = table[grid[:, k], entry]
        out[:, k] = entry
    return out.reshape(-1)[:n]
