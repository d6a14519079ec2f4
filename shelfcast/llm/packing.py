"""Numpy arrays as compressed binary values, so that one row carries many entries through a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(a: np.ndarray) -> bytes:
    data = np.ascontiguousarray(a).tobytes()
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def unpack(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", kind)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts in a sorted array, and its length at the end."""
    if not len(key):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def bundles(key: np.ndarray, columns: dict[str, np.ndarray], name: str = "key", most: int = 1 << 20) -> pa.RecordBatch:
    """One row for each key with its entries packed; very many entries of one key make several rows."""
    order = np.argsort(key, kind="stable")
    key, ends, rows = key[order], runs(key[order]), {name: [], **{c: [] for c in columns}}
    for a, b in zip(ends[:-1], ends[1:]):
        for lo in range(a, b, most):
            at = order[lo : min(b, lo + most)]
            rows[name].append(int(key[lo]))
            for c, v in columns.items():
                rows[c].append(pack(v[at]))
    return pa.RecordBatch.from_arrays([pa.array(rows[name], pa.int32()), *[pa.array(rows[c], pa.binary()) for c in columns]], list(rows))


def unbundle(table: pa.Table | pa.RecordBatch, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([unpack(x.as_py(), kind) for x in table.column(c)] or [np.zeros(0, kind)]) for c, kind in kinds.items()}


def least_in_runs(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each entry of a sorted array the smallest of ``values`` in its run; ``new`` marks where runs start."""
    starts = np.flatnonzero(new)
    return np.minimum.reduceat(values, starts)[np.cumsum(new) - 1] if len(starts) else values[:0]


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys starts."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new
