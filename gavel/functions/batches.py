"""Arrow batches of judgments: each distinct combination of arguments is read, checked and encoded once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from gavel.functions.values import Request, invalid, state_reader


def codes(column: pa.Array) -> np.ndarray:
    """A number for each row, the same for equal values; nulls equal each other, floats are compared by their bits."""
    kind, n = column.type, len(column)
    if pa.types.is_struct(kind):
        return combined([column.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), *map(codes, column.flatten())], n)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        known: dict = {}
        width = len(column.flatten()) // n if n else 0
        if not column.null_count and all(x == width for x in column.value_lengths().to_pylist()):
            inner = codes(column.flatten())
            return combined([inner[i::width] for i in range(width)], n)
        return np.array([known.setdefault(None if x is None else tuple(x), len(known)) for x in column.to_pylist()], np.int64)
    if pa.types.is_float32(kind) or pa.types.is_float64(kind):
        column = column.view(pa.int32() if pa.types.is_float32(kind) else pa.int64())
    try:
        return column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    except pa.ArrowNotImplementedError:
        return np.arange(n)


def combined(parts: list[np.ndarray], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for p in parts:
        if n and p.any():
            out = np.unique(out * (int(p.max()) + 1) + p, return_inverse=True)[1].ravel()
    return out


def distinct(*columns: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of one row of each distinct combination, and for each row the number of its combination."""
    _, first, back = np.unique(combined([codes(c) for c in columns], len(columns[0])), return_index=True, return_inverse=True)
    return first, back.ravel()


def slices(columns: list[pa.Array], most: int) -> list[list[pa.Array]]:
    """The rows in order, halved until a slice has ``most`` bytes or one row."""
    n = len(columns[0])
    if n < 2 or sum(c.nbytes for c in columns) <= most:
        return [columns]
    return slices([c.slice(0, n // 2) for c in columns], most) + slices([c.slice(n // 2) for c in columns], most)


def spread(values: list, back: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind).take(pa.array(back))


def read(kind: str, rows, state: pa.Array, text: pa.Array, choices: pa.Array | None) -> list[Request | None]:
    """The checked requests of some rows; None where an argument is NULL."""
    reader, out = None, []
    if choices is not None and not (pa.types.is_list(choices.type) or pa.types.is_large_list(choices.type) or pa.types.is_null(choices.type)):
        raise invalid("choices must be a list")
    for i in rows:
        i = int(i)
        if not state[i].is_valid or not text[i].is_valid or choices is not None and not choices[i].is_valid:
            out.append(None)
            continue
        reader = reader or state_reader(state.type)
        out.append(Request(kind, reader(state[i]), text[i].as_py(), tuple(choices[i].as_py()) if choices is not None else ()).check())
    return out
