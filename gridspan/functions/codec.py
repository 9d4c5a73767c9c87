"""Codecs of the text and binary forms: run-length bit planes, big-endian records, segment names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _varint(n: int) -> bytes:
    """Seven bits a byte, high part first; the last byte has its high bit set."""
    out = [0x80 | n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F)
    return bytes(reversed(out))


def encode_planes(masks: list[int]) -> str:
    """K 32-bit masks as runs over the bit planes, top plane first, beginning with a run of ones."""
    bits = np.unpackbits(np.array(masks, ">u4").view(np.uint8).reshape(len(masks), 4), axis=1).T.ravel()
    edges = np.flatnonzero(np.diff(bits)) + 1
    runs = np.diff(np.concatenate(([0], edges, [len(bits)]))).tolist() if len(bits) else []
    if len(bits) and not bits[0]:
        runs = [0, *runs]
    return b"".join(map(_varint, runs)).hex()


def decode_planes(text: str, k: int) -> list[int]:
    runs, now = [], 0
    for byte in bytes.fromhex(text):
        now = now << 7 | byte & 0x7F
        if byte & 0x80:
            runs.append(now)
            now = 0
    bits = np.repeat(np.arange(len(runs)) % 2 == 0, runs).astype(np.uint8)
    bits = np.concatenate((bits, np.zeros(32 * k - len(bits), np.uint8))).reshape(32, k).T
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u4").ravel().tolist()


def _text(data: np.ndarray, sizes: np.ndarray, missing: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A string or binary array from all its bytes, one value after another; missing values have size 0."""
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    valid = pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    return pa.Array.from_buffers(kind, len(sizes), [valid, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())], int(missing.sum()))


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All items of a list array, the size of each list, and which are null."""
    missing = np.asarray(column.is_null())
    return column.flatten(), np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64), missing


def encode_runs(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bits -> all their runs as variable-length integers, in bytes, and how many bytes each row has. Runs of ones come first, an
    empty one where a row begins with a zero."""
    n, width = bits.shape
    if not width:
        return np.empty(0, np.uint8), np.zeros(n, np.int64)
    change = bits != np.concatenate((np.ones((n, 1), np.uint8), bits[:, :-1]), axis=1)
    row, col = np.nonzero(change)
    each = change.sum(axis=1) + 1
    first = np.cumsum(each) - each
    starts, ends = np.zeros(each.sum(), np.int64), np.full(each.sum(), width, np.int64)
    at = np.arange(len(row)) + row
    starts[at + 1], ends[at] = col, col
    runs = ends - starts
    size = 1 + sum((runs >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28))
    stop = np.cumsum(size)
    out = np.empty(stop[-1], np.uint8)
    for k in range(int(size.max())):
        has = size > k
        out[stop[has] - 1 - k] = runs[has] >> 7 * k & 0x7F | (0x80 if k == 0 else 0)
    return out, np.add.reduceat(size, first)


@F.arrow_udf(T.StringType())
def encode_masks(masks: pa.Array) -> pa.Array:
    """Arrays of 32-bit masks -> hexadecimal runs over their bit planes; lists of one length are coded together."""
    items, k, missing = _lists(masks)
    words = np.asarray(items).astype(">u4")
    at = np.concatenate(([0], np.cumsum(k)))
    parts: list = [b""] * len(k)
    for size in np.unique(k[~missing]).tolist():
        rows = np.flatnonzero((k == size) & ~missing)
        own = words[at[rows][:, None] + np.arange(size)] if size else np.empty((len(rows), 0), ">u4")
        planes = np.unpackbits(np.ascontiguousarray(own).view(np.uint8).reshape(len(rows), size, 4), axis=2) if size else np.empty((len(rows), 0, 32), np.uint8)
        data, sizes = encode_runs(planes.transpose(0, 2, 1).reshape(len(rows), 32 * size))
        text, stop = data.tobytes().hex(), 2 * np.cumsum(sizes)
        for r, a, b in zip(rows.tolist(), (stop - 2 * sizes).tolist(), stop.tolist(), strict=True):
            parts[r] = text[a:b]
    return pa.array([None if gone else p or "" for p, gone in zip(parts, missing.tolist(), strict=True)], pa.string())


def decode_runs(data: np.ndarray, row: np.ndarray, n: int, width: int) -> np.ndarray:
    """Bytes of runs, and the row of each byte -> n rows of `width` bits; rows that end early are filled with zeros."""
    last = data >= 0x80
    stop = np.flatnonzero(last)
    run = np.cumsum(last) - last
    low = 7 * (stop[np.minimum(run, len(stop) - 1)] - np.arange(len(data))) if len(stop) else np.zeros(len(data), np.int64)
    value = np.bincount(run, (data & 0x7F).astype(np.float64) * 2.0**low, minlength=len(stop)).astype(np.int64)[: len(stop)]
    owner = row[stop]
    each = np.bincount(owner, minlength=n)
    ones = (np.arange(len(stop)) - np.repeat(np.cumsum(each) - each, each)) % 2 == 0
    missing = width - np.bincount(owner, value, minlength=n).astype(np.int64)
    end = np.cumsum(each)
    value, ones = np.insert(value, end, missing), np.insert(ones, end, False)
    return np.repeat(ones, value).astype(np.uint8).reshape(n, width)


@F.arrow_udf(T.ArrayType(T.LongType()))
def decode_masks(text: pa.Array, k: pa.Array) -> pa.Array:
    """Hexadecimal runs -> arrays of k masks."""
    missing = np.asarray(text.is_null())
    sizes = np.where(missing, 0, np.asarray(pc.fill_null(k, 0)).astype(np.int64))
    raw = [bytes.fromhex(t or "") for t in text.to_pylist()]
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(at[-1], np.int64)
    for size in np.unique(sizes[~missing]).tolist():
        rows = np.flatnonzero((sizes == size) & ~missing)
        data = np.frombuffer(b"".join(raw[r] for r in rows), np.uint8)
        owner = np.repeat(np.arange(len(rows)), [len(raw[r]) for r in rows])
        bits = decode_runs(data, owner, len(rows), 32 * size).reshape(len(rows), 32, size).transpose(0, 2, 1)
        out[at[rows][:, None] + np.arange(size)] = np.ascontiguousarray(np.packbits(bits, axis=2)).view(">u4").reshape(len(rows), size)
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(out), mask=pa.array(missing))


_VECTOR, _MATRIX = np.dtype([("i", ">i4"), ("v", ">f8")]), np.dtype([("row", ">i4"), ("col", ">i4"), ("val", ">f8")])


def _packed(column: pa.Array, kind: np.dtype) -> pa.Array:
    items, sizes, missing = _lists(column)
    records = np.empty(len(items), kind)
    for name in kind.names:
        records[name] = items.field(items.type.get_field_index(name)).to_numpy(zero_copy_only=False)
    return _text(records, sizes * kind.itemsize, missing, pa.binary())


def _unpacked(column: pa.Array, kind: np.dtype) -> pa.Array:
    missing = np.asarray(column.is_null())
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64) // kind.itemsize
    records = np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), kind)
    fields = [pa.array(records[name].astype(records[name].dtype.newbyteorder("="))) for name in kind.names]
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(fields, list(kind.names)), mask=pa.array(missing))


@F.arrow_udf(T.BinaryType())
def pack_vector(items: pa.Array) -> pa.Array:
    """array of (i, v) -> 12-byte big-endian records."""
    return _packed(items, _VECTOR)


@F.arrow_udf(T.ArrayType(T.StructType().add("i", T.IntegerType()).add("v", T.DoubleType())))
def unpack_vector(data: pa.Array) -> pa.Array:
    return _unpacked(data, _VECTOR)


@F.arrow_udf(T.BinaryType())
def pack_matrix(items: pa.Array) -> pa.Array:
    """array of (row, col, val) -> 16-byte big-endian records."""
    return _packed(items, _MATRIX)


@F.arrow_udf(T.ArrayType(T.StructType().add("row", T.IntegerType()).add("col", T.IntegerType()).add("val", T.DoubleType())))
def unpack_matrix(data: pa.Array) -> pa.Array:
    return _unpacked(data, _MATRIX)


#: Fixed value: the mark between a segment's path and its byte range.
PATH_END = "#EOP#"


def format_segment(path: Column, off: Column, size: Column) -> Column:
    return F.concat(path, F.lit(PATH_END), off.cast("string"), F.lit("-"), size.cast("string"))


def parse_segment(text: Column) -> Column:
    """(path, off, len); a malformed name is an error."""
    form = rf"(?s)\A(.*){PATH_END}(\d+)-(\d+)\z"
    good = F.when(text.rlike(form), text).otherwise(F.raise_error(F.concat(F.lit("malformed segment: "), text)))
    return F.struct(F.regexp_extract(good, form, 1).alias("path"), F.regexp_extract(good, form, 2).cast("bigint").alias("off"), F.regexp_extract(good, form, 3).cast("bigint").alias("len"))
