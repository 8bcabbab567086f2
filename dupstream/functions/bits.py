"""Bit-level Column functions on 64-bit fingerprint words (all JVM-side).

Every function returns a ``Column`` built from Spark built-ins, so the
expressions stay inside whole-stage codegen (``bit_count`` is compiled to
``Long.bitCount``).
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from dupstream.schemas import AHASH, DHASH_H, DHASH_V, WORDS

LONG_MIN = -(2 ** 63)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def xor64(a, b) -> Column:
    """FN2: bitwise xor; NULL reads as 0 (SQLite integer conversion)."""
    return F.coalesce(_c(a), F.lit(0).cast("bigint")).bitwiseXOR(
        F.coalesce(_c(b), F.lit(0).cast("bigint")))


def hamming(a, b) -> Column:
    """FN1: number of differing bits of two BIGINTs; NULL reads as 0."""
    return F.bit_count(xor64(a, b)).cast("int")


def popcount32(x) -> Column:
    """FN3: the SQL ``popcount``: keeps the low 32 bits, sign-extends them to
    64 bits, then counts (2^32 -> 0, 2^31 -> 33, -1 -> 64)."""
    low = F.coalesce(_c(x), F.lit(0).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF))
    signed = low.bitwiseXOR(F.lit(0x80000000)) - F.lit(0x80000000)
    return F.bit_count(signed).cast("int")


def popcount_sm(x) -> Column:
    """FN4: sign-magnitude popcount (bits of |x|); Long.MIN counts as 1.

    ``abs(Long.MIN)`` raises under ANSI, so that value is special-cased first.
    """
    col = _c(x)
    return (F.when(col == F.lit(LONG_MIN), F.lit(1))
            .otherwise(F.bit_count(F.abs(F.when(col == F.lit(LONG_MIN), F.lit(0)).otherwise(col))))
            .cast("int"))


def hamming_sm(a, b) -> Column:
    """FN5: sign-magnitude popcount of the xor."""
    return popcount_sm(xor64(a, b))


def group_distance(left_prefix: str, right_prefix: str, words) -> Column:
    """Sum of per-word Hamming distances between two aliased word groups."""
    return reduce(add, [hamming(F.col(f"{left_prefix}.{w}"), F.col(f"{right_prefix}.{w}"))
                        for w in words])


def fingerprint_distances(left: str, right: str) -> dict[str, Column]:
    """diff_a, diff_dh, diff_dv between two aliased image rows."""
    return {
        "diff_a": group_distance(left, right, AHASH),
        "diff_dh": group_distance(left, right, DHASH_H),
        "diff_dv": group_distance(left, right, DHASH_V),
    }


def reference_bits(words=WORDS) -> Column:
    """AGG12: sum of sign-magnitude popcounts over the 12 words."""
    return reduce(add, [popcount_sm(w) for w in words]).cast("int")


def exact_bits(words=WORDS) -> Column:
    """True number of set bits over the 12 words."""
    return reduce(add, [F.bit_count(F.col(w)) for w in words]).cast("int")


def signed_sum_is_zero(words=WORDS) -> Column:
    """FLT4 test: the signed sum of the words is 0 (summed as DECIMAL so that
    it cannot overflow under ANSI)."""
    total = reduce(add, [F.col(w).cast("decimal(38,0)") for w in words])
    return total == F.lit(0).cast("decimal(38,0)")


def signed_word(bit_string, index: int) -> Column:
    """FN10: the ``index``-th 64-character slice of a 0/1 string read as a
    signed 64-bit word, most significant bit first."""
    part = F.substring(_c(bit_string), 64 * index + 1, 64)
    return F.conv(part, 2, -10).cast("bigint")


def upper_half(x) -> Column:
    """High 32 bits of a word, as a non-negative BIGINT."""
    return F.shiftrightunsigned(_c(x), 32)


def lower_half(x) -> Column:
    """Low 32 bits of a word, as a non-negative BIGINT."""
    return _c(x).bitwiseAND(F.lit(0xFFFFFFFF))


def half_words(prefix: str | None = None) -> list[Column]:
    """The eight 32-bit halves of the aHash words, in band order.

    Band order puts the four high halves first, then the low halves, so the
    six bands used for a distance bound of 5 cover every aHash word.
    """
    def col(w):
        return F.col(f"{prefix}.{w}") if prefix else F.col(w)
    return [upper_half(col(w)) for w in AHASH] + [lower_half(col(w)) for w in AHASH]
