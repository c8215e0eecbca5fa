"""What several operators share: column selection, text buffers, word bounds and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from chainsieve.session import cut_lineage  # noqa: F401  (re-exported: reliable checkpoint)

#: A word, as a Java and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one numpy step works on.
STEP = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """Only the columns that an operator reads, so other columns can't clash with its own."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *extra)


def nullable(kind: DataType) -> DataType:
    """The type with every field, element and value nullable, as rows come back from a worker."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(nullable(kind.elementType))
    return MapType(nullable(kind.keyType), nullable(kind.valueType)) if isinstance(kind, MapType) else kind


def arrow_nullable(kind: pa.DataType) -> pa.DataType:
    """The same of an Arrow type."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, arrow_nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, arrow_nullable(kind.value_type)))
    return pa.map_(arrow_nullable(kind.key_type), arrow_nullable(kind.item_type)) if pa.types.is_map(kind) else kind


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finalizer over an unsigned array."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # pyarrow keeps no chunk for no row
            column = pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def steps(offsets: np.ndarray, size: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows with about ``size`` bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    upper = (raw >= 65) & (raw <= 90)
    return raw + upper.astype(np.uint8) * np.uint8(32)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each row (one entry more than rows)."""
    inside = ~_SEPARATOR[raw]
    first = np.zeros(len(raw) + 1, bool)
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else np.zeros(0, bool)
    before[cuts] = False
    first[:-1] = inside & ~before
    after = np.concatenate([inside[1:], [False]]) if len(raw) else np.zeros(0, bool)
    after[cuts - 1] = False
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, finalized with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = mix(np.arange(256, dtype=np.uint64), 77 + seed)
    base = np.uint64(int(_ODD) ^ (seed * 0x5851F42D4C957F2C)) | np.uint64(1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[raw] * _powers(base, len(raw)), out=total[1:])
        back = _powers(inverse, len(raw))[starts]
        return mix((total[ends] - total[starts]) * back + (ends - starts).astype(np.uint64) * _ODD, seed)


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k neighbours, at its first word; the last k-1 entries are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64((0xD6E8FEB86659FD93 + 2 * seed * 0x9E3779B1) & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for i in range(1, k):
            out *= base
            out += words[i : i + n]
    return mix(out, 1000 + seed)


def whole_grams(counts: np.ndarray, k: int) -> np.ndarray:
    """Which of the runs of ``gram_hashes`` over all rows' words stay inside one row; counts: words before each row."""
    n = int(counts[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.zeros(int(counts[-1]) + 1, np.int32)
    a, b = counts[:-1], np.maximum(counts[1:] - k + 1, counts[:-1])
    np.add.at(ok, a, 1)
    np.add.at(ok, b, -1)
    return np.cumsum(ok)[:n] > 0
