"""Scalar rules as Column expressions: trimming, missing values, type predicates, buckets, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value, in lower case.
MISSING = ("", "na", "n/a", "null", "nan", ".", "-", "--", "missing", "none", "#n/a", "#value!", "#ref!", "#div/0!", "#num!", "#name?", "#null!")

#: Texts that stand for a truth value, in lower case.
TRUE, FALSE = ("true", "yes", "y", "1", "t"), ("false", "no", "n", "0", "f")

#: Shapes of dates, and the format each must satisfy.
DATES = (
    (r"\d{4}-\d{2}-\d{2}", ("yyyy-MM-dd",)),
    (r"\d{1,2}/\d{1,2}/\d{4}", ("M/d/yyyy",)),
    (r"\d{1,2}-\d{1,2}-\d{4}", ("d-M-yyyy",)),
    (r"\d{1,2}/\d{1,2}/\d{2}", ("M/d/yy",)),
    (r"[A-Za-z]{3,9}\s+\d{1,2},\s+\d{4}", ("MMMM d, yyyy", "MMM d, yyyy")),
    (r"\d{4}\.\d{2}\.\d{2}", ("yyyy.MM.dd",)),
)

#: Fixed value: the shape of a datetime; its parts aren't checked.
DATETIME = r"(?U)\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(Z|\.\d+)?\z"

NUMBER = r"(?i)\A[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\z"

#: Upper ends of the count ranges, and what each is called.
BUCKETS = ((0, "0"), (1, "1"), (5, "2-5"), (10, "6-10"), (20, "11-20"), (100, "21-100"), (1000, "101-1000"))
ABOVE = ">1000"

LONG_BYTES = 100


def trim(v: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.when(v.rlike(r"(?U)\A\s|\s\z"), F.regexp_replace(v, r"(?U)\A\s+|\s+\z", "")).otherwise(v)


def _begins(t: Column, others: str = "") -> Column:
    """Whether the first character is a digit (of any script) or one of others; spares long texts the patterns."""
    code = F.ascii(t)
    return code.between(48, 57) | (code > 127) | code.isin(*map(ord, others)) if others else code.between(48, 57) | (code > 127)


def is_missing(v: Column) -> Column:
    t = trim(v)
    return F.coalesce((F.octet_length(t) <= 8) & F.lower(t).isin(*MISSING), F.lit(True))


def is_boolean(t: Column) -> Column:
    """t: trimmed, as for the others."""
    return (F.octet_length(t) <= 5) & F.lower(t).isin(*TRUE, *FALSE)


def is_integer(t: Column) -> Column:
    """Of 64 bits."""
    return F.when(_begins(t, "+-") & t.rlike(r"\A[+-]?[0-9]+\z"), t.try_cast("bigint").isNotNull()).otherwise(False)


def is_numeric(t: Column) -> Column:
    return _begins(t, "+-.iInN") & t.rlike(NUMBER)


def parse_numeric(t: Column) -> Column:
    """A double, or null."""
    word = F.lower(F.regexp_replace(t, r"\A[+-]", ""))
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    return F.when(
        is_numeric(t),
        F.when(word == "nan", F.lit(float("nan"))).when(word.isin("inf", "infinity"), sign * F.lit(float("inf"))).otherwise(t.try_cast("double")),
    )


def parse_date(t: Column) -> Column:
    """The calendar date, or null."""
    tries = []
    for shape, formats in DATES:
        one = F.regexp_replace(t, r"\s+", " ") if r"\s" in shape else t
        tries.append(F.when(t.rlike(rf"\A{shape}\z"), F.coalesce(*[F.try_to_date(one, f) for f in formats])))
    return F.when(F.octet_length(t).between(6, 40), F.coalesce(*tries))


def is_date(t: Column) -> Column:
    return parse_date(t).isNotNull()


def is_datetime(t: Column) -> Column:
    return (F.octet_length(t) >= 19) & _begins(t) & t.rlike(DATETIME)


def is_long(v: Column) -> Column:
    """What makes a string column free text, if there is enough of it."""
    return (F.octet_length(v) > LONG_BYTES) | v.contains("\n")


def bucket_count(n: Column) -> Column:
    out = F.lit(ABOVE)
    for top, name in reversed(BUCKETS):
        out = F.when(n <= top, name).otherwise(out)
    return F.when(n.isNotNull(), out)


def bucket_name(n: int) -> str:
    return next((name for top, name in BUCKETS if n <= top), ABOVE)


def safe_count(n: Column, bucketed: bool) -> Column:
    return bucket_count(n) if bucketed else n.cast("string")


def short_enough(v: Column, longest: int = 32) -> Column:
    """By bytes of UTF-8."""
    return F.octet_length(v) <= longest


def index_to_label(n: Column, most_letters: int = 6) -> Column:
    """0: A, 25: Z, 26: AA and so on, with digits from 1 to 26; null beyond most_letters (321 million labels)."""
    n, out, before = n.cast("bigint"), F.lit(None).cast("string"), 0
    for letters in range(1, most_letters + 1):
        rest = n - F.lit(before)
        digits = [F.char(F.pmod(F.floor(rest / F.lit(26**k)), F.lit(26)) + 65) for k in reversed(range(letters))]
        out = F.when((rest >= 0) & (rest < 26**letters), F.concat(*digits)).otherwise(out)
        before += 26**letters
    return out


def label_name(n: int) -> str:
    out, n = "", n + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out
