"""Hash families as column expressions, with fixed parameters (the same in every run)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def primes(upper: int) -> list[int]:
    """All primes up to ``upper``."""
    sieve = bytearray([1]) * (upper + 1)
    sieve[:2] = b"\0\0"
    for i in range(2, int(upper**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = bytes(len(range(i * i, upper + 1, i)))
    return [i for i, x in enumerate(sieve) if x]


def family(n: int, upper: int = 50_000) -> list[tuple[int, int, int, int]]:
    """(index, a, b, p) of n affine hashes: the largest primes below ``upper`` and multipliers made by a rule."""
    top = primes(upper)[::-1][:n]
    return [(i, 2_654_435_761 * (2 * i + 1) % 2_147_483_647, 40_503 * (i * i + 7) % 1_000_003, p) for i, p in enumerate(top)]


def affine(x: Column, a: int, b: int, p: int, m: int) -> Column:
    """((a x + b) mod p) mod m without overflow."""
    return F.pmod(F.pmod(F.lit(a % p) * F.pmod(x, F.lit(p)) + F.lit(b % p), F.lit(p)), F.lit(m))


def affine_plain(x: Column, a: int, b: int, m: int) -> Column:
    """(a x + b) mod m, without a prime."""
    return F.pmod(F.lit(a % m) * F.pmod(x, F.lit(m)) + F.lit(b % m), F.lit(m))


def text_number(text: Column, p: int) -> Column:
    """The UTF-8 bytes as one big-endian number, modulo p (p below 2**31); 0 for an empty text."""
    bytes_ = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    return F.aggregate(bytes_, F.lit(0).cast("long"), lambda acc, x: (acc * 256 + F.conv(x, 16, 10).cast("long")) % p)


def trailing_zeros(x: Column) -> Column:
    """Zeros at the end of the binary form; 1 for 0."""
    bits = F.bin(x)
    return F.length(bits) - F.length(F.regexp_replace(bits, "0+$", ""))
