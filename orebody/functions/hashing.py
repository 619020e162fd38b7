"""Linear hash families over integers and strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplier, offset and prime of each hash ((a * x + b) % p) % m.
HASH_TABLE = (
    (1, 16, 193), (11, 49, 1543), (19, 100, 12289), (37, 196, 196613),
    (3, 25, 389), (13, 64, 3079), (23, 121, 24593), (41, 225, 393241),
    (5, 36, 769), (17, 81, 6151), (31, 144, 98317), (43, 256, 786433),
    (1, 25, 769), (11, 64, 6151), (19, 121, 98317), (37, 225, 786433),
    (3, 36, 193), (13, 81, 1543), (23, 144, 12289), (41, 256, 196613),
    (5, 16, 389), (17, 49, 3079), (31, 100, 24593), (43, 196, 393241),
    (1, 36, 389), (11, 81, 3079), (19, 144, 24593), (37, 256, 393241),
    (3, 16, 769), (13, 49, 6151), (23, 100, 98317), (41, 196, 786433),
    (5, 25, 193), (17, 64, 1543), (31, 121, 12289), (43, 225, 196613),
)


def linear_hash(x: Column, a: int, b: int, p: int, m: int | Column) -> Column:
    """((a x + b) mod p) mod m for x >= 0."""
    return ((x.cast("bigint") * a + b) % p) % (m if isinstance(m, Column) else F.lit(m))


def byte_values(text: Column) -> Column:
    """UTF-8 bytes of a string as an array of numbers."""
    code = F.hex(F.encode(text, "UTF-8"))
    return F.transform(
        F.when(F.length(code) > 0, F.sequence(F.lit(1), F.length(code), F.lit(2))).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("bigint"),
    )


def bytes_mod(values: Column, p: int) -> Column:
    """The bytes read as one big-endian integer, mod p: a Horner fold, so nothing overflows."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, byte: (acc * 256 + byte) % p)


def let(value: Column, use) -> Column:
    """`use(value)`, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def string_hashes(text: Column, m: int) -> Column:
    """All hashes of the table of a string's big-endian integer, as an array."""
    primes = sorted({p for _, _, p in HASH_TABLE})
    rests = let(byte_values(text), lambda v: F.array(*[bytes_mod(v, p) for p in primes]))
    return let(rests, lambda r: F.array(*[((F.get(r, F.lit(primes.index(p))) * a + b) % p) % m for a, b, p in HASH_TABLE]))


def trailing_zeros(v: Column) -> Column:
    """Zeros at the end of the binary form; 1 for 0, whose form is the single digit 0."""
    lowest = v.bitwiseAND(-v)
    return F.when(v == 0, F.lit(1)).otherwise(F.round(F.log2(F.greatest(lowest, F.lit(1)))).cast("int"))
