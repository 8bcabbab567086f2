"""Format-preserving Feistel pseudonyms for personal data, in built-in functions.

One pattern finds candidates; each kind has its own validity test (check digit,
calendar, number ranges), and what fails it, or is part of a longer run of digits and
the format's separator, is left as it is (card numbers excepted: in a run of groups of
four every group is tried as a start).  A valid value is a
point of its format's domain, written as a pair of residues ``(l mod a, r mod b)``
with ``a * b`` the size of the domain, and goes through ``ROUNDS`` keyed Feistel
rounds, each adding a hash of one half to the other.  That is a permutation of the
domain: equal values get equal pseudonyms in every document, different ones differ,
and pseudonyms are valid in turn.

| kind | format | domain |
|-|-|-|
| card | 13-19 digits, check digit right | the digits before the check digit, which is then computed |
| phone | North American, area and office code without leading 0 | 900 x 9,000,000 |
| ssn | area 001-899 without 666, group 01-99, serial 0001-9999 | 898 x (99 * 9,999) |
| ip | four octets, first 1-223 | (223 * 256) x 65,536 |
| date | year-month-day, month/day/year, day.month.year, years 1800-2199 | 146,097 days = 189 x 773 |
| email | letters and digits before the @ | each letter or digit in its own class |

Map-side only: texts without a digit or ``@`` pass through.

Defined results: null texts stay null with no finding; every row is returned,
repeated ones too; ids may be null; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KEY = "change-me"


def _day(form: str, sep: str) -> str:
    """A date outside a longer run of digits and separators; two dates joined by the
    separator are an interval."""
    return (rf"(?<!\d)(?:(?<!\d{sep})|(?<=(?<!\d)(?<!\d{sep}){form}{sep})){form}"
            rf"(?!\d)(?:(?!{sep}\d)|(?={sep}{form}(?!\d)(?!{sep}\d)))")


# Formats.  Only a longer run of digits and the format's own separator
# hides a value, and no card number; other neighbours do not.
EMAIL = r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"(?<!\d)(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![\d])"
SSN = r"(?<!\d)(?<!\d-)\d{3}-\d{2}-\d{4}(?!\d)(?!-\d)"
IP = r"(?<!\d)(?<!\d\.)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
DATE = "|".join((_day(r"\d{4}-\d{2}-\d{2}", "-"), _day(r"\d{2}/\d{2}/\d{4}", "/"), _day(r"\d{2}\.\d{2}\.\d{4}", r"\.")))
# Card numbers without separators, in 4-6-5, and in groups of four: a run of groups is one
# candidate, in which a number may start at every group.  A run does not take in a group
# that begins a date, a 4-6-5 number or another value.
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
_NEXT = r"(?:[ -]\d{4}(?!\d|-\d{2}-\d{2}(?!\d)|[ -]\d{6}[ -]\d{5}(?!\d)))"
_LAST = r"[ -]\d{1,7}(?!\d|[-./]\d|[A-Za-z_%+@]|\.[A-Za-z])"
CARDS = rf"(?<!\d)\d{{4}}(?:{_NEXT}{{3,}}(?:{_LAST})?|[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{1,7}}(?!\d))"
FOUND = "|".join((EMAIL, DATE, IP, SSN, CARDS, CARD, PHONE))


def _hash(key: str, kind: str, turn: Column, value: Column) -> Column:
    """60 bits of a keyed hash as a long."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string"), F.lit(key)), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permuted(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """Feistel permutation of the pair (left mod a, right mod b), as a struct."""
    def turn(pair, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(pair.l + F.pmod(_hash(key, kind, i, pair.r), a), a)).otherwise(pair.l).alias("l"),
            F.when(even, pair.r).otherwise(F.pmod(pair.r + F.pmod(_hash(key, kind, i, pair.l), b), b)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
                       F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _padded(value: Column, width) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _relaid(value: Column, digits: Column) -> Column:
    """``digits`` put into the layout of ``value``, one digit for each."""
    at = F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), lambda acc, c: F.struct(
        F.concat(acc.out, F.when(c.rlike("^[0-9]$"), F.substring(digits, acc.k, F.lit(1))).otherwise(c)).alias("out"),
        (acc.k + F.when(c.rlike("^[0-9]$"), 1).otherwise(0)).alias("k")))
    return at.out


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(payload: Column) -> Column:
    """Check sum of the digits before the check digit."""
    def add(total, pair):
        doubled = pair * 2
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)
    ints = F.transform(F.split(F.reverse(payload), ""), lambda c: F.when(c == "", 0).otherwise(c.try_cast("int")))
    odd = F.filter(ints, lambda _, i: i % 2 == 0)
    even = F.filter(ints, lambda _, i: i % 2 == 1)
    return F.aggregate(odd, F.lit(0), add) + F.aggregate(even, F.lit(0), lambda t, x: t + x)


def _number(text: Column) -> Column:
    return text.try_cast("long")


def _card(value: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(value)
    n = F.length(digits) - 1
    payload = F.substring(digits, F.lit(1), n)
    def check(p): return F.pmod(F.lit(10) - _luhn_sum(p) % 10, F.lit(10)).cast("string")
    valid = n.between(12, 18) & (check(payload) == F.substring(digits, n + 1, F.lit(1))) & ~payload.rlike("^0+$")
    half = (n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k).cast("long")
    new = permuted(_number(F.substring(payload, F.lit(1), half)), _number(F.substring(payload, half + 1, n - half)),
                   size(half), size(n - half), key, "card")
    # one evaluation of the permutation, used twice
    out = F.transform(F.array(F.transform(F.array(new), lambda p: F.concat(
        _padded(p.l, half), _padded(p.r, n - half)))[0]), lambda p: F.concat(p, check(p)))[0]
    return valid, _relaid(value, out)


def _grouped(value: Column, key: str) -> tuple[Column, Column]:
    """Number of card numbers in a run of groups of four, and the run with all of them
    replaced: every group is tried as a start, from the left, outside numbers found."""
    groups, gaps = F.split(value, "[ -]"), F.regexp_extract_all(value, F.lit("([ -])"), F.lit(1))

    def turn(state, i):
        gap = F.when(i > 0, F.try_element_at(gaps, i)).otherwise(F.lit(""))
        size = F.when(i + 4 < F.size(groups), F.lit(19)).otherwise(F.length(value))
        window = F.when((state.skip == 0) & (i + 4 <= F.size(groups)), value.substr(i * 5 + 1, size)).otherwise(F.lit(""))

        def put(w):
            valid, new = _card(w, key)
            fits = F.coalesce(valid, F.lit(False))
            return F.when(state.skip > 0, F.struct(state.out.alias("out"), (state.skip - 1).alias("skip"), state.n.alias("n"))) \
                .when(fits, F.struct(F.concat(state.out, gap, new).alias("out"), F.lit(3).alias("skip"), (state.n + 1).alias("n"))) \
                .otherwise(F.struct(F.concat(state.out, gap, F.get(groups, i)).alias("out"), F.lit(0).alias("skip"), state.n.alias("n")))
        return F.transform(F.array(window), put)[0]
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("skip"), F.lit(0).alias("n"))
    done = F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, turn)
    return done.n, done.out


def _phone(value: Column, key: str) -> tuple[Column, Column]:
    digits = F.substring(_digits(value), -10, 10)
    area, rest = _number(F.substring(digits, 1, 3)), _number(F.substring(digits, 4, 7))
    valid = (area >= 100) & (rest >= 1_000_000)
    new = permuted(area - 100, rest - 1_000_000, F.lit(900), F.lit(9_000_000), key, "phone")
    whole = F.transform(F.array(new), lambda p: F.concat((p.l + 100).cast("string"), (p.r + 1_000_000).cast("string")))[0]
    lead = F.when(F.length(_digits(value)) == 11, F.lit("1")).otherwise(F.lit(""))
    return valid, _relaid(value, F.concat(lead, whole))


def _ssn(value: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(value)
    area, group, serial = (_number(F.substring(digits, a, k)) for a, k in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    new = permuted(index, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    whole = F.transform(F.array(new), lambda p: F.concat(
        _padded(F.when(p.l >= 665, p.l + 2).otherwise(p.l + 1), 3), _padded((p.r / 9999).cast("long") + 1, 2),
        _padded(p.r % 9999 + 1, 4)))[0]
    return valid, _relaid(value, whole)


def _ip(value: Column, key: str) -> tuple[Column, Column]:
    o = [_number(F.element_at(F.split(value, r"\."), i)) for i in (1, 2, 3, 4)]
    valid = o[0].between(1, 223) & (o[1] <= 255) & (o[2] <= 255) & (o[3] <= 255)
    new = permuted((o[0] - 1) * 256 + o[1], o[2] * 256 + o[3], F.lit(223 * 256), F.lit(65536), key, "ip")
    return valid, F.transform(F.array(new), lambda p: F.concat_ws(
        ".", (p.l / 256).cast("long") + 1, p.l % 256, (p.r / 256).cast("long"), p.r % 256))[0]


def _date(value: Column, key: str) -> tuple[Column, Column]:
    iso, american = value.rlike("^....-"), value.substr(3, 1) == "/"
    forms = ((iso, "yyyy-MM-dd"), (american, "MM/dd/yyyy"), (~iso & ~american, "dd.MM.yyyy"))
    day = F.coalesce(*[F.when(c, F.try_to_timestamp(value, F.lit(p)).cast("date")) for c, p in forms])
    start = F.lit("1800-01-01").cast("date")
    index = F.datediff(day, start)
    valid = F.coalesce(index.between(0, 146096), F.lit(False))
    new = permuted((index / 773).cast("long"), index % 773, F.lit(189), F.lit(773), key, "date")
    moved = F.transform(F.array(new), lambda p: F.date_add(start, (p.l * 773 + p.r).cast("int")))[0]
    return valid, F.coalesce(*[F.when(c, F.date_format(moved, p)) for c, p in forms])


def _shifted(text: Column, stream: Column) -> Column:
    """Every letter and digit moved within its class by the stream's next byte."""
    def move(c, i):
        by = F.conv(F.substring(stream, (i % 30) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        def turn(base, size): return F.char(F.pmod(code - base + by, F.lit(size)) + base)
        return (F.when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26))
                .when(c.rlike("^[0-9]$"), turn(48, 10)).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), move), "")


def _email(value: Column, key: str) -> tuple[Column, Column]:
    # signs before the first letter or digit are not part of the value
    lead = F.regexp_extract(value, "^[._%+-]*", 0)
    whole = F.substring_index(value, "@", 1)
    local = F.substring(whole, F.length(lead) + 1, F.length(whole))
    half = (F.length(local) / 2).cast("int")
    def turn(pair, i):
        even = i % 2 == 0
        def stream(x): return F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), x, F.lit(key)), 256)
        return F.struct(F.when(even, _shifted(pair.l, stream(pair.r))).otherwise(pair.l).alias("l"),
                        F.when(even, pair.r).otherwise(_shifted(pair.r, stream(pair.l))).alias("r"))
    new = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(
        F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, F.length(local) - half).alias("r")), turn)
    return F.lit(True), F.concat(lead, F.transform(F.array(new), lambda p: F.concat(p.l, p.r))[0],
                                 F.substring(value, F.length(whole) + 1, F.length(value)))


def _pseudonym(value: Column, key: str) -> Column:
    """Struct of the kinds (none where the value is not valid) and the new text."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    kinds = (("email", EMAIL, _email), ("date", DATE, _date), ("ip", IP, _ip), ("ssn", SSN, _ssn),
             ("phone", PHONE, _phone), ("card", CARD, _card))
    out = F.struct(F.array().cast("array<string>").alias("kinds"), value.alias("new"))
    run = F.transform(F.array(F.struct(*[c.alias(n) for c, n in zip(_grouped(value, key), ("n", "new"))])), lambda r: F.struct(
        F.array_repeat(F.lit("card"), r.n).alias("kinds"), r.new.alias("new")))[0]
    out = F.when(whole(CARDS), run).otherwise(out)
    for name, pattern, make in reversed(kinds):
        valid, new = make(value, key)
        out = F.when(whole(pattern) & valid, F.struct(F.array(F.lit(name)).alias("kinds"), new.alias("new"))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Per row: ``doc_id``, ``text`` with pseudonyms, ``n_found`` and the ``kinds``
    replaced, in order of place."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    maybe = F.col("text").rlike("[0-9@]")
    found = rows.withColumn("new", F.when(maybe, F.transform(
        F.regexp_extract_all("text", F.lit(FOUND), F.lit(0)), lambda v: _pseudonym(v, key))))
    woven = F.array_join(F.zip_with(F.split("text", FOUND, -1), F.col("new.new"),
                                    lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    kinds = F.flatten(F.col("new.kinds"))
    return found.select("doc_id", F.when(F.size("new") > 0, woven).otherwise(F.col("text")).alias("text"),
                        F.coalesce(F.size(kinds), F.lit(0)).cast("long").alias("n_found"),
                        F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"))
