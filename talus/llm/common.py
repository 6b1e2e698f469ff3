"""Shared helpers of the training-data operators: byte buffers, words, hashes, tables cut from lineage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut  # noqa: F401  the operators' C.cut

U64 = np.uint64
#: Bytes of text that numpy works on at once; a longer document is one slice of its own.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: ASCII letters, digits and every byte of a longer UTF-8 sequence.
WORDY = LETTER.copy()
WORDY[48:58] = WORDY[128:] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: str, mod: int, rest: int):
    """Whether crc32 of the id as text leaves this remainder."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest


def buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and their offsets (n + 1, from 0); null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    at = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(at: np.ndarray, limit: int = SLICE_BYTES):
    """Runs of rows (lo, hi) with about limit bytes each; one row at least."""
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1))
        yield lo, hi
        lo = hi


def parts(batches, column: str = "text", limit: int = SLICE_BYTES):
    """(record batch slice, bytes, offsets) for slices of each Arrow batch."""
    for batch in batches:
        data, at = buffer(batch.column(column))
        for lo, hi in slices(at, limit):
            yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]


_BASE, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POW = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["up"]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for k, base in (("up", _BASE), ("down", _INV)):
            x = np.full(size, base, U64)
            x[0] = 1
            _POW[k] = np.multiply.accumulate(x)
    return _POW["up"], _POW["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[s:e], from one running sum; equal bytes give equal hashes wherever they stand."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of inside, cut at row ends: starts, ends, and the first run of each row (n + 1)."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    first = np.empty(len(inside), bool)
    first[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=first[1:])
    last = np.empty(len(inside), bool)
    last[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=last[:-1])
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, at)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: starts, ends, first word of each row (n + 1)."""
    return spans(~SPACE[data], at)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i, 0 where empty."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class HashIndex:
    """Open addressing over 64-bit keys; find() gives each key's place in keys, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, U64)
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(self.keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            again = self.slots[slot] != left
            left, slot = left[again], (slot[again] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        out = self.slots[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            out[todo] = self.slots[slot[todo]]
            got = out[todo]
            todo = todo[(got >= 0) & (self.keys[got] != keys[todo])]
        return out


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def i64(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def fetch(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table whose size has a stated bound, on the driver."""
    table = df.toArrow()
    return {n: table.column(n).to_numpy(zero_copy_only=False) for n in table.column_names}
