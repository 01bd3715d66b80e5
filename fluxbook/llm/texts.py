"""Vectorised work on Arrow batches of texts: words, hashes, windows.

A batch is cut into slices of bounded bytes (a longer text is a slice of its own), so memory
follows the longest text and not the batch. Words are the runs between the bytes 0x20 and
0x09-0x0D, on UTF-8 bytes the same as on characters. Words and windows stand for each other by
64-bit hashes: two different ones share a hash with a chance of 5e-20.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 1 << 20
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
AS_IS = np.arange(256, dtype=np.uint8)
LOWERED = AS_IS.copy()
LOWERED[65:91] += 32

_POWERS: dict[U64, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``; kept for slices of the usual size."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, U64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 2 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def lowered(data: np.ndarray) -> np.ndarray:
    """Small letters for ASCII and the two-byte Latin-1 capitals."""
    out = LOWERED[data]
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[capital] += 0x20
    return out


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices ``(first row, end row, bytes, offsets of the rows in the bytes)``; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(max(np.searchsorted(offsets, offsets[row] + limit, "right") - 1, row + 1))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true bytes that do not cross rows: their starts, ends and rows."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = inside[edges]
    before = edges[edges > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans_of(~IS_SPACE[data], offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = AS_IS) -> np.ndarray:
    """Hash of the bytes of each span, mapped by ``table``. Ends must not descend; spans may overlap."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        at = int(starts[i:i + 1][0])
        j = int(max(np.searchsorted(ends, at + SLICE_BYTES, "right"), i + 1))
        at = int(starts[i:j].min())
        codes = table[data[at:int(ends[j - 1])]].astype(U64) + U64(1)
        total = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * _powers(BASE, len(codes)), out=total[1:])
        a, b = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((total[b] - total[a]) * _powers(BASE_INVERSE, len(codes) + 1)[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words within a row, and the place of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(n, U64)
    for k in range(width):
        out = out * BASE + hashes[k:k + n]
    at = np.flatnonzero(rows[:n] == rows[width - 1:])
    return mix(out[at] + U64(width)), at


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of true bytes in each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def map_texts(
    docs: DataFrame, text_col: str, kept: list[str], added: T.StructType,
    start: Callable[[], Callable[[pa.RecordBatch, int, int, np.ndarray, np.ndarray], dict]],
) -> DataFrame:
    """One row per row of ``docs``: the columns ``kept`` and those that a kernel adds.

    ``start`` is called once in a task and gives the kernel, which gets the batch of kept
    columns, first and end row of a slice, its bytes and offsets, and returns an array for each
    added column.
    """
    chosen = docs.select(*kept, docs[text_col].alias("_text"))
    schema = T.StructType([f for f in chosen.schema.fields if f.name != "_text"] + added.fields)
    arrow, n_kept = to_arrow_schema(schema), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = start()
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(n_kept)):
                made = kernel(batch, first, end, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(first, end - first).cast(arrow.field(i).type) for i in range(n_kept)]
                    + [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], arrow.field(n_kept + k).type) for k, f in enumerate(added.fields)],
                    schema=arrow,
                )

    return chosen.mapInArrow(run, schema)
