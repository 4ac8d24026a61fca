"""Byte encodings of coordinates and values, and of whole cell keys.

Cells are stored in typed columns, so nothing in the engine needs these; they
serve readers of byte keys. All column functions stay in generated code.
"""

from __future__ import annotations

import struct
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridroll.functions.bucketers import IDENTITY

if TYPE_CHECKING:
    from gridroll.spec import CubeSpec


def long_bytes(col: Column) -> Column:
    """8 bytes, big-endian, two's complement."""
    return F.unhex(F.lpad(F.hex(col.cast("bigint")), 16, "0"))


def int_bytes(col: Column) -> Column:
    """4 bytes, big-endian."""
    return F.substring(long_bytes(col), 5, 4)


def bool_bytes(col: Column) -> Column:
    return F.when(col, F.unhex(F.lit("01"))).when(~col, F.unhex(F.lit("00")))


def string_bytes(col: Column) -> Column:
    return F.encode(col, "UTF-8")


def time_bytes(col: Column) -> Column:
    """Milliseconds since the epoch of a timestamp, the clock it shows taken as UTC, in 8 bytes."""
    return long_bytes(F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col.cast("timestamp_ntz")))


def ordinal_bytes(col: Column, width: int) -> Column:
    """The trailing ``width`` bytes of an ordinal; ordinals that need more are cut off at the left, as their readers expect."""
    wide = F.concat(*([F.unhex(F.lit("00" * (width - 8)))] if width > 8 else []), long_bytes(col))
    return F.substring(wide, -width, width) if width < 8 else wide


def trailing_bytes(value: int, width: int) -> bytes:
    """The last ``width`` bytes of a non-negative number, padded with zeros at the left."""
    return (value & ((1 << 8 * width) - 1)).to_bytes(width, "big")


def hash_byte(col: Column) -> Column:
    """Low byte of the polynomial hash (base 31, start 1, signed bytes) of a binary column, as an int 0 to 255.

    An empty value hashes to 1.
    """
    text = F.hex(col)
    at = F.sequence(F.lit(1), F.length(text) - 1, F.lit(2))
    byte = lambda i: F.conv(F.substring(text, i, F.lit(2)), 16, 10).cast("int")
    return F.when(F.length(text) == 0, 1).otherwise(F.aggregate(at, F.lit(1), lambda h, i: F.pmod(h * 31 + byte(i), F.lit(256))))


def hash_byte_of(data: bytes, start: int = 0, end: int | None = None) -> int:
    """``hash_byte`` of a slice of bytes in memory."""
    end = len(data) if end is None else end
    if start > end:
        raise ValueError("the range is reversed")
    h = 1
    for b in data[start:end]:
        h = (h * 31 + b) & 0xFF
    return h


def typed_bytes(col: Column, kind: str) -> Column:
    """The encoding of a column of the given Spark type."""
    if kind in ("bigint", "long"):
        return long_bytes(col)
    if kind == "int":
        return int_bytes(col)
    if kind == "boolean":
        return bool_bytes(col)
    if kind.startswith("timestamp"):
        return time_bytes(col)
    return string_bytes(col) if kind == "string" else col


def encode_value(value: Any, kind: str) -> bytes:
    """A measure's value as bytes: bigint 8 and int 4 big-endian, double its 8 raw bytes."""
    return struct.pack({"bigint": ">q", "int": ">i", "double": ">d"}[kind], value)


def decode_value(data: bytes, kind: str) -> Any:
    return struct.unpack({"bigint": ">q", "int": ">i", "double": ">d"}[kind], data)[0]


def value_bytes(col: Column, kind: str) -> Column:
    """``encode_value`` of a column of whole numbers."""
    if kind not in ("bigint", "int"):
        raise ValueError(f"no column encoding of {kind}")
    return long_bytes(col) if kind == "bigint" else int_bytes(col)


def value_column(col: Column, kind: str) -> Column:
    """``decode_value`` of a binary column; a value of another length than the kind's raises, null stays null."""
    width = {"bigint": 8, "int": 4, "double": 8}[kind]
    data = F.when(F.length(col) == width, col).when(col.isNotNull(), F.raise_error(F.concat(F.lit(f"a {kind} has {width} bytes, not "), F.length(col).cast("string"))).cast("binary"))
    number = F.conv(F.hex(data), 16, -10).cast("bigint")
    if kind != "double":
        return number if kind == "bigint" else F.shiftright(F.shiftleft(number, 32), 32).cast("int")
    exponent, fraction = F.shiftright(number, 52).bitwiseAND(F.lit(0x7FF)), number.bitwiseAND(F.lit((1 << 52) - 1))
    size = F.when(exponent == 0x7FF, F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-1074.0))).otherwise((fraction + F.lit(1 << 52)) * F.pow(F.lit(2.0), exponent - 1075))
    return F.when(number < 0, -size).otherwise(size)


def row_key(spec: CubeSpec, cells: DataFrame, widths: dict[str, int], ids: dict[str, Column] | None = None, prefix: bytes = b"", salted: bool = False) -> Column:
    """The byte key of a cell: for every dimension in order a flag, its bucket type's number and its value.

    A wildcard inside is a 0 flag and zeros of the same length; wildcards at
    the end are left out, so that appending a dimension keeps old keys. A value
    that has not its dimension's width of ``widths`` raises. ``ids`` gives the
    binary ids that take the place of values; ``salted`` puts the hash byte of
    the key before it, and ``prefix``, the cube's own bytes, before that.
    """
    kinds = dict(cells.dtypes)
    parts, present = [], []
    for d in spec.dimensions:
        used = [b for n, b in spec.components if n == d.name]
        types = d.bucketer.bucket_types
        type_width = 0 if types == (IDENTITY,) or len(types) == 1 else 1
        width = widths[d.name]
        blank = F.unhex(F.lit("00" * (1 + type_width + width)))
        part, some = blank, F.lit(False)
        for b in used:
            name = f"{d.name}__{b}"
            col = F.col(name)
            raw = ids[name] if ids and name in ids else typed_bytes(col, kinds[name])
            fit = F.when(F.length(raw) == width, raw).otherwise(F.raise_error(F.concat(F.lit(f"{name}: a coordinate has "), F.length(raw).cast("string"), F.lit(f" bytes, not {width}"))).cast("binary"))
            number = [F.unhex(F.lit(f"{types.index(b):02x}"))] if type_width else []
            part = F.when(col.isNotNull(), F.concat(F.unhex(F.lit("01")), *number, fit)).otherwise(part)
            some = some | col.isNotNull()
        parts.append(part)
        present.append(some)
    key = F.unhex(F.lit(""))
    for i in range(len(parts)):
        key = F.when(present[i], F.concat(*parts[: i + 1])).otherwise(key)
    if salted:
        key = F.concat(F.unhex(F.lpad(F.hex(hash_byte(key)), 2, "0")), key)
    return F.concat(F.unhex(F.lit(prefix.hex())), key) if prefix else key
