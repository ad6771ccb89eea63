"""64-bit hashes as column expressions, with arithmetic that wraps; canonical JSON and its digests.

A long product is put together from digits of 16 bits, as Spark's own
multiplication is an error where it overflows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset and prime of the FNV-1a hash (the offset without its last digit, as the run files have it), and
# the multipliers of the 64-bit mixer.
FNV_OFFSET = 1469598103934665603
FNV_PRIME = 1099511628211
MIX_MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
MIX_STEP = 0x9E3779B97F4A7C15


def _signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def _long(value: int) -> Column:
    return F.lit(_signed(value)).cast("long")


def _with(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used there."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _digits(x: Column) -> list[Column]:
    """The four digits of 16 bits of a long, the lowest first."""
    return [F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]


def _carried(columns: Sequence[Column]) -> Column:
    """A long from sums per digit, what is over carried upward and lost beyond 64 bits."""
    out, carry = None, None
    for i, column in enumerate(columns):
        value = column if carry is None else column + carry
        part = F.shiftleft(value.bitwiseAND(F.lit(0xFFFF)), 16 * i)
        out, carry = part if out is None else out.bitwiseOR(part), F.shiftrightunsigned(value, 16)
    return out


def add64(a: Column, b: Column) -> Column:
    """a + b modulo 2 ** 64."""
    return _with(F.struct(a.alias("a"), b.alias("b")), lambda s: _carried([x + y for x, y in zip(_digits(s["a"]), _digits(s["b"]))]))


def multiply64(a: Column, factor: int) -> Column:
    """a times a fixed number, modulo 2 ** 64."""
    parts = [factor >> 16 * i & 0xFFFF for i in range(4)]

    def product(x: Column) -> Column:
        digits = _digits(x)
        return _carried([sum((digits[j] * parts[i - j] for j in range(i + 1)), F.lit(0).cast("long")) for i in range(4)])

    return _with(a, product)


def fnv1a(text: Column | str) -> Column:
    """FNV-1a of the UTF-8 bytes of a string, as a signed long; null for null."""
    data = (F.col(text) if isinstance(text, str) else text).cast("binary")
    count = F.octet_length(data)
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.when(data.isNotNull(), F.aggregate(places, _long(FNV_OFFSET), lambda h, i: multiply64(h.bitwiseXOR(byte(i)), FNV_PRIME)))


def mix64(x: Column | str) -> Column:
    """A long's bits mixed, so that near numbers have nothing in common; one to one."""
    x = add64(F.col(x) if isinstance(x, str) else x, _long(MIX_STEP))
    folded = lambda x, shift: _with(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, shift)))
    for shift, factor in zip((30, 27), MIX_MULTIPLIERS):
        x = multiply64(folded(x, shift), factor)
    return folded(x, 31)


def unit(x: Column) -> Column:
    """A number in [0, 1) from the upper 53 bits of a long."""
    return F.shiftrightunsigned(x, 11).cast("double") / float(1 << 53)


def canonical_json(value) -> str:
    """JSON with sorted keys and no spaces, the same for equal configurations; NaN and infinity are an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def config_digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def blake_id(text: str) -> int:
    """A positive number of 64 bits that names a text; never 0."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little") or 1


def blake_unit(text: str) -> float:
    """One of a thousand numbers in [0, 1] for a name."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "little") % 1000 / 999.0
