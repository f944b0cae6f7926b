"""Hash families as plain arithmetic, so that any SQL engine gets the same cells.

Carter-Wegman hashes (a x + b) mod p with p = 2**31 - 1; a and b of row r come
from a rule. Strings are taken through the first eight digits of their MD5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

P = (1 << 31) - 1


def coefficients(row: int, salt: int = 0) -> tuple[int, int]:
    """a in 1..p-1 and b in 0..p-1 of one member of the family: powers of two primitive roots of p."""
    return pow(16807, 3 * row + 101 * salt + 7, P), pow(48271, 5 * row + 103 * salt + 11, P)


def integer_key(x: Column, text: bool = False) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") if text else F.pmod(x.cast("long"), F.lit(P))


def cw(x: Column, row: int, salt: int = 0) -> Column:
    """A hash below p of an integer key that is not negative.

    Two members of the family in turn, with the high bits folded into the low ones
    between them: one alone sends keys in a row to an arithmetic progression.
    """
    (a, b), (c, d) = coefficients(row, salt), coefficients(row, salt + 37)
    h = (F.lit(a).cast("long") * (x % P) + F.lit(b).cast("long")) % P
    return (F.lit(c).cast("long") * (h.bitwiseXOR(F.shiftright(h, 13)) % P) + F.lit(d).cast("long")) % P


def sign(x: Column, row: int, salt: int = 1) -> Column:
    return 1 - 2 * (F.shiftright(cw(x, row, 50 + salt), 7) % 2)


def leading(h: Column) -> Column:
    """1 + the zeros that lead a 31-bit hash, by the length of its binary form."""
    return F.when(h == 0, 32).otherwise(32 - F.length(F.bin(h)))


def level(x: Column, layers: int) -> Column:
    """The deepest of 0..layers-1 that a key is sampled to: each takes half of the one above."""
    h = cw(x, 0, 90) % (1 << (layers - 1))
    return F.when(h == 0, layers - 1).otherwise(F.length(F.bin(h.bitwiseAND(-h))) - 1)
