"""Little-endian fields of binary columns, read and written without leaving the JVM. Offsets count from 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bytes(content: Column, at: Column | int, n: int) -> list[Column]:
    at = F.lit(at) if isinstance(at, int) else at
    return [F.conv(F.hex(content.substr(at + (k + 1), F.lit(1))), 16, 10).cast("long") for k in range(n)]


def unsigned(content: Column, at: Column | int, n: int) -> Column:
    """The unsigned integer of ``n`` bytes at an offset; null past the end."""
    return reduce(lambda x, y: x + y, (b * (1 << 8 * k) for k, b in enumerate(_bytes(content, at, n))))


def u8(content: Column, at: Column | int) -> Column:
    return unsigned(content, at, 1).cast("int")


def u16(content: Column, at: Column | int) -> Column:
    return unsigned(content, at, 2).cast("int")


def u32(content: Column, at: Column | int) -> Column:
    return unsigned(content, at, 4)


def s16(content: Column, at: Column | int) -> Column:
    v = u16(content, at)
    return F.when(v >= 32768, v - 65536).otherwise(v)


def hex_of(value: Column, n: int) -> Column:
    """``n`` little-endian bytes of a non-negative integer, as hex."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
    return F.concat(*[F.substring(digits, 2 * (n - k) - 1, 2) for k in range(n)])


def joined(order: Column, text: Column) -> Column:
    """An aggregate: hex texts put together in an order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x.t), "")


def fixed_ascii(text: str, n: int) -> str:
    """A text cut or filled up with zeros to ``n`` bytes, as hex."""
    return text.encode("ascii", "replace")[:n].ljust(n, b"\0").hex().upper()
