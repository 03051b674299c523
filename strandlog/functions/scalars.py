"""Scalar functions of the data model as column expressions.

Null arguments give null unless a function says otherwise. Lengths of values are bytes, not characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a record header and of a padded key, and what a missing key answers.
HEADER_BYTES = 20
RECORD_OVERHEAD = 30
NO_KEY, ERR_NO_KEY, OK = "NOKEY", "ErrNoKey", "OK"
MISSING_OFFSET = -1
TERM_LOG = "TermLog"


def record_bytes(value: Column) -> Column:
    """Bytes of a stored record with a padded key; a null value takes none."""
    return F.lit(RECORD_OVERHEAD) + F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def size_label(n: Column) -> Column:
    """'512B' below 1024 bytes, else whole kibibytes, '4KB'."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).otherwise(F.concat(F.floor(n / 1024).cast("long").cast("string"), F.lit("KB")))


def to_little_endian(offset: Column) -> Column:
    """A long as 16 hex digits of its 8 bytes, the lowest first."""
    h = F.lpad(F.hex(offset.cast("long")), 16, "0")
    return F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(8)))


def from_little_endian(digits: Column) -> Column:
    """The long of 16 hex digits; null if there are not exactly 16."""
    turned = F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(8)))
    low, high = F.conv(F.substring(turned, 9, 8), 16, 10).cast("long"), F.conv(F.substring(turned, 1, 8), 16, 10).cast("long")
    return F.when(F.length(digits) == 16, F.shiftleft(high, 32).bitwiseOR(low))


def digest(seed: str, *parts: Column) -> Column:
    """A non-negative 32-bit number that depends on the parts and the seed only, alike on every engine with MD5."""
    text = F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def request_id(*parts: Column) -> Column:
    """A 62-bit id from two digests."""
    return F.shiftleft(digest("id-high", *parts).bitwiseAND(F.lit((1 << 30) - 1)), 32).bitwiseOR(digest("id-low", *parts))


def random_value(size: int, *parts: Column) -> Column:
    """``size`` lower-case letters."""
    words = [F.translate(F.md5(F.concat_ws(":", F.lit(f"value{i}"), *(p.cast("string") for p in parts))), "0123456789", "ghijklmnop") for i in range(-(-size // 32))]
    return F.substring(F.concat(*words), 1, size)


def random_key(size: int, *parts: Column) -> Column:
    """``size`` digits from 1 to 9."""
    return F.concat(*((digest(f"key{i}", *parts) % 9 + 1).cast("string") for i in range(size)))


def position_of(values: Column, value: Column) -> Column:
    """Place of a value in an array counted from 0, or -1."""
    return F.array_position(values, value).cast("long") - 1


def log_place(idx: Column, first: Column | None = None) -> Column:
    """Place of an entry in the array that holds a log from index ``first`` (1 if left out) on; null before it."""
    at = idx - (first if first is not None else F.lit(1))
    return F.when(at >= 0, at)


def clock_dominated(own: Column, other: Column) -> Column:
    """Whether clock ``other`` (a map) has every entry of ``own`` at least as high.

    An empty ``other`` dominates by definition; one with fewer entries never does. Null counts as empty.
    """
    a, b = F.coalesce(own, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))), other
    covered = F.forall(F.map_keys(a), lambda k: F.coalesce(F.element_at(b, k) >= F.element_at(a, k), F.lit(False)))
    return F.when(b.isNull() | (F.size(b) == 0), F.lit(True)).when(F.size(b) < F.size(a), F.lit(False)).otherwise(covered)


def clock_start(address: Column) -> Column:
    """The clock of a new node: its address with '1' appended, at 0."""
    return F.create_map(F.concat(address, F.lit("1")), F.lit(0).cast("long"))


def clock_load(clock: Column, node: Column) -> Column:
    """A node's entry, 0 if it has none."""
    return F.coalesce(F.element_at(clock, node), F.lit(0).cast("long"))


def clock_length(clock: Column) -> Column:
    return F.coalesce(F.size(clock), F.lit(0)).cast("long")
