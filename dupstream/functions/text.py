"""String Column functions used by the report rules (FN6-FN9, FN12-FN19).

All are Spark built-ins except ``one_decimal``, a vectorised pandas UDF: Java's
``%.1f`` rounds the shortest decimal text half-up, while the reference rounds
the exact binary value (75 s is "1.2 minutes", 69 s is "1.1 minutes").
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values (must equal the reference's for identical output) ------
# Duration units, smallest first; a "year" is 356 days in the reference.
DURATION_UNITS = [
    (1.0, "seconds"),
    (60.0, "minutes"),
    (60.0 * 60.0, "hours"),
    (60.0 * 60.0 * 24.0, "days"),
    (7.0 * 60.0 * 60.0 * 24.0, "weeks"),
    (60.0 * 60.0 * 24.0 * 356, "years"),
]
# Report sentences: exact/near x last seen / first seen / first seen with count.
GALLERY_URL = "http://imgur.com/gallery/"
STR_DUPLICATE = "Image last seen %s before at http://imgur.com/gallery/%s %s"
STR_SIMILAR = "Image probably last seen %s before at http://imgur.com/gallery/%s %s"
STR_DUPLICATE_FIRST = "First seen %s before at http://imgur.com/gallery/%s %s"
STR_SIMILAR_FIRST = "Probably first seen %s before at http://imgur.com/gallery/%s %s"
STR_DUPLICATE_FIRST_TIMES = "Seen %i times since %s before at http://imgur.com/gallery/%s %s"
STR_SIMILAR_FIRST_TIMES = "Probably seen %i times since %s before at http://imgur.com/gallery/%s %s"
TITLE_INFO_PREFIX = "Title similarity: "
STAR_FULL = "★"
STAR_BLANK = "☆"
# Notification text that names a post to look up.
SUMMON_PATTERN = r"glory at http://imgur\.com/gallery/([a-zA-Z0-9]+)/comment/[0-9]+/"
SUMMON_MARKER = "mentioned you in a comment"
COMMENT_CAP = 140
# --------------------------------------------------------------------------

# Every character Python's str.strip() removes (Unicode whitespace).
PY_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
             + "".join(chr(c) for c in range(0x2000, 0x200b)) + "\u2028\u2029\u202f\u205f\u3000")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_title(x) -> Column:
    """FN12: ``title.lower().strip()`` with Unicode whitespace at both ends."""
    return F.trim(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(PY_SPACE))


def _myers(a: str, b: str) -> int:
    """Levenshtein distance (code points) with Myers' bit-parallel
    algorithm: one pass over the shorter string, the longer one held as bit
    vectors, so that few steps work on long integers, O(len(a) * len(b) / word
    size).  The distance is read off the last column's differences."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    peq: dict[str, int] = {}
    codes = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    for ch in set(a):       # bit i is set where b[i] is the character
        peq[ch] = int.from_bytes(np.packbits(codes == ord(ch), bitorder="little").tobytes(), "little")
    full = (1 << len(b)) - 1
    pv, mv = full, 0
    for i, ch in enumerate(a):
        x = peq[ch] | mv
        d = (((x & pv) + pv) ^ pv) | x
        ph = (((d | pv) ^ full | mv) << 1) | 1
        mh = (pv & d) << 1
        pv, mv = (d | ph) ^ full | mh, ph & d
        if not i & 31:      # bits beyond the string never reach lower ones; cut now and then
            pv, mv = pv & full, mv & full
    return len(a) + (pv & full).bit_count() - (mv & full).bit_count()


@F.pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """FN8: Levenshtein distance, as Spark's ``levenshtein`` (NULL in, NULL
    out) but bit-parallel: titles here are whole first lines of up to 18k
    characters, where the quadratic cell-by-cell form dominates the report
    stage."""
    out = [None if (x is None or y is None) else _myers(x, y) for x, y in zip(a, b)]
    return pd.Series(out, dtype="Int32")


def levenshtein_n(a, b, bit_parallel: bool = True) -> Column:
    """FN9: 0 when both are empty, else edit distance / longer length.

    ``bit_parallel=False`` keeps the JVM ``levenshtein``: a pandas UDF is
    evaluated for every row, so inside a condition that is usually decided
    by cheaper tests the built-in (which short-circuits) is cheaper."""
    a, b = _c(a), _c(b)
    la, lb = F.char_length(a), F.char_length(b)
    d = edit_distance(a, b) if bit_parallel else F.levenshtein(a, b)
    return (F.when(la + lb == 0, F.lit(0.0))
            .otherwise(d.cast("double") / F.greatest(la, lb).cast("double")))


def positional_mismatch(a, b) -> Column:
    """FN7: positions (up to the shorter length) where the strings differ.
    Both are cut into characters once, so a row costs its length."""
    a, b = _c(a), _c(b)
    n = F.least(F.char_length(a), F.char_length(b))
    # beyond the shorter string one side is NULL, and so is the comparison
    diff = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d)
    return F.when(n == 0, F.lit(0)).otherwise(F.size(diff)).cast("int")


# character classes of the histogram bound; together with "any other" they cover every text
HISTOGRAM = (" ", "ea", "ti", "ons", "rhl", "dcum", "fpgwyb", "0123456789")


def distance_bound(a, b) -> Column:
    """A number no edit distance of ``a`` and ``b`` is below.

    One edit changes the length by at most one; it adds at most one character to one class
    of characters and takes at most one from one, so the surplus of either side over all
    classes is a bound too (and never below the length's)."""
    a, b = _c(a), _c(b)
    over = under = F.lit(0)
    rest = F.char_length(a) - F.char_length(b)
    for chars in HISTOGRAM:
        gap = _held(a, chars) - _held(b, chars)
        rest = rest - gap
        over, under = over + F.greatest(gap, F.lit(0)), under + F.greatest(-gap, F.lit(0))
    return F.greatest(over + F.greatest(rest, F.lit(0)), under + F.greatest(-rest, F.lit(0)))


def _held(x: Column, chars: str) -> Column:
    return F.char_length(x) - F.char_length(F.translate(x, chars, ""))


def bounded_distance(a, b, most) -> Column:
    """FN8 up to ``most`` (a number or an INT column), NULL beyond it.  Pairs that the lengths or the
    histograms tell apart are never compared; others by the banded built-in, whose cost
    is the length times ``most``."""
    a, b = _c(a), _c(b)
    most = most if isinstance(most, Column) else F.lit(int(most))
    near = F.abs(F.char_length(a) - F.char_length(b)) <= most
    # -1 beyond ``most``; the one-element array keeps the distance from being computed twice
    d = F.get(F.filter(F.array(F.call_function("levenshtein", a, b, most)), lambda v: v >= 0), F.lit(0))
    return F.when(near, F.when(distance_bound(a, b) <= most, d))


def distance_below(a, b, share: float, known=None) -> Column:
    """``levenshtein_n(a, b) < share`` without computing distances that are not: the same
    result for ``0 < share <= 1``, NULL where a side is.  ``known`` is the pair's distance
    where the caller has it: a second one would cost as much."""
    a, b = _c(a), _c(b)
    longer = F.greatest(F.char_length(a), F.char_length(b))
    # any distance above this one divides to ``share`` or more
    d = _c(known) if known is not None else bounded_distance(a, b, F.floor(longer * F.lit(share)).cast("int") + 1)
    below = F.when(longer == 0, F.lit(True)).otherwise(
        F.coalesce(d.cast("double") / longer.cast("double") < F.lit(share), F.lit(False)))
    return F.when(a.isNotNull() & b.isNotNull(), below)


def python_bin(x) -> Column:
    """Python's ``bin(n)`` text for a BIGINT: ``0b101`` or ``-0b101``."""
    x = _c(x)
    neg_mag = F.when(x == F.lit(-(2 ** 63)), F.lit("1" + "0" * 63)).otherwise(
        F.bin(-F.when(x == F.lit(-(2 ** 63)), F.lit(0)).otherwise(x)))
    return F.when(x < 0, F.concat(F.lit("-0b"), neg_mag)).otherwise(F.concat(F.lit("0b"), F.bin(x)))


def bin_mismatch(a, b) -> Column:
    """FN6: positional mismatch of the ``bin()`` texts of two integers."""
    return positional_mismatch(python_bin(a), python_bin(b))


def title_tokens_hit(title, tokens=("mrw", "mfw")) -> Column:
    """FN13: the lower-cased title split on single spaces holds a token."""
    parts = F.split(F.lower(F.coalesce(_c(title), F.lit(""))), " ")
    hit = F.lit(False)
    for t in tokens:
        hit = hit | F.array_contains(parts, t)
    return hit


def title_starts_with(title, prefix="when") -> Column:
    """FN14: the lower-cased, untrimmed title starts with ``prefix``."""
    return F.lower(F.coalesce(_c(title), F.lit(""))).startswith(prefix)


def star_bar(value, length: int = 5) -> Column:
    """FN16 with one glyph: ``full = int(v*L)``, one more star when the
    remainder rounds (half away from zero) to 1, blanks for the rest."""
    v = _c(value).cast("double") * F.lit(float(length))
    full = F.floor(v).cast("int")
    extra = F.when((full < length) & ((v - full) >= 0.5), 1).otherwise(0)
    stars = full + extra
    return F.concat(F.repeat(F.lit(STAR_FULL), stars),
                    F.repeat(F.lit(STAR_BLANK), F.lit(length) - stars))


def title_similarity_text(old_title, new_title) -> Column:
    """"Title similarity: ★★★☆☆" for two raw titles."""
    d = levenshtein_n(normalize_title(old_title), normalize_title(new_title))
    return F.concat(F.lit(TITLE_INFO_PREFIX), star_bar(F.lit(1.0) - d))


@F.pandas_udf(T.StringType())
def one_decimal(x: pd.Series) -> pd.Series:
    """Python's exact ``'%.1f' % x`` (round half even on the binary value)."""
    return x.map(lambda v: None if v is None or pd.isna(v) else "%.1f" % v)


def duration_unit(value) -> tuple[Column, Column]:
    """(divisor, unit name) of FN15: the largest unit not above ``value``;
    seconds for anything below one second, negatives included."""
    v = _c(value).cast("double")
    div = F.lit(DURATION_UNITS[0][0])
    name = F.lit(DURATION_UNITS[0][1])
    for pval, pname in DURATION_UNITS[1:]:
        div = F.when(v >= F.lit(pval), F.lit(pval)).otherwise(div)
        name = F.when(v >= F.lit(pval), F.lit(pname)).otherwise(name)
    return div, name


def duration_text(value) -> Column:
    """FN15: e.g. 69 -> "1.1 minutes", 604800 -> "1.0 weeks"."""
    div, name = duration_unit(value)
    return F.concat(one_decimal(_c(value).cast("double") / div), F.lit(" "), name)


def summon_id(body, pattern: str = SUMMON_PATTERN) -> Column:
    """FN18: the post id named in a notification, '' when absent."""
    return F.regexp_extract(F.coalesce(_c(body), F.lit("")), pattern, 1)


def cap_text(x, n: int = COMMENT_CAP) -> Column:
    """FN19: keep the first ``n`` characters of a comment."""
    return F.substring(_c(x), 1, n)


def ascii_printable(x) -> Column:
    """Remove every character outside the printable ASCII range."""
    return F.regexp_replace(_c(x), "[^ -~]", "")
