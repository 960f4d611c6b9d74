"""Column functions with JavaScript string semantics, and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.functions.bind import let

# JavaScript white space and the two identifier patterns.
# ``\z`` is used, not ``$``: Java's ``$`` also matches before a final line end.
SPACE = r"[\s\p{Z}\x{FEFF}]"
SPACES = (
    "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
TAG_PATTERN = r"^[a-z0-9:._-]{1,100}\z"
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def js_trim(text: Column) -> Column:
    """Strip Unicode white space and the byte order mark from both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count twice."""
    astral = F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]+", "")
    return F.length(text) + F.length(astral)


def longer_than(text: Column, limit: int) -> Column:
    """Whether the text has more than ``limit`` UTF-16 units.

    That length lies between the number of characters and twice that number,
    so only texts near the limit are counted in full.
    """
    size = F.length(text)
    return (size > limit) | ((size * 2 > limit) & (utf16_length(text) > limit))


def js_number(value: Column) -> Column:
    """Shortest decimal text of a double, with an exponent only outside [1e-6, 1e21)."""

    def parts(shown: Column) -> Column:
        """Digits of ``1.25E-7`` in one run, and the place of the decimal point in it."""
        mantissa = F.substring_index(shown, "E", 1)
        exponent = F.when(shown.contains("E"), F.substring_index(shown, "E", -1).cast("int")).otherwise(0)
        whole = F.substring_index(mantissa, ".", 1)
        return F.struct(F.replace(mantissa, F.lit(".")).alias("run"), (F.length(whole) + exponent).alias("point"))

    def stripped(p: Column) -> Column:
        lead = F.length(p["run"]) - F.length(F.ltrim(p["run"], F.lit("0")))
        return F.struct(F.trim(p["run"], F.lit("0")).alias("digits"), (p["point"] - lead).alias("point"))

    def text(p: Column) -> Column:
        digits, point, count = p["digits"], p["point"], F.length(p["digits"])
        scientific = F.concat(
            F.substring(digits, 1, 1),
            F.when(count > 1, F.concat(F.lit("."), digits.substr(F.lit(2), count))).otherwise(""),
            F.when(point > 0, F.lit("e+")).otherwise("e-"),
            F.abs(point - 1).cast("string"),
        )
        plain = (
            F.when(count == 0, F.lit("0"))
            .when((point > 21) | (point <= -6), scientific)
            .when(point >= count, F.rpad(digits, point, F.lit("0")))
            .when(point > 0, F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, count)))
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        )
        return F.concat(F.when((value < 0) & (count > 0), "-").otherwise(""), plain)

    shown = F.abs(value).cast("string")
    return F.when(value.isNotNull(), let(shown, lambda s: let(parts(s), lambda p: let(stripped(p), text))))


def fixed3(value: Column) -> Column:
    """Three decimals, rounded on the exact binary value (halves go up).

    Scaling by a power of two is exact, so the rounding is done on whole
    numbers. Values of 4 and more take the ordinary formatter.
    """
    size = F.abs(value)
    unit, half = F.lit(str(2**60)).cast("decimal(19,0)"), F.lit(str(2**59)).cast("decimal(19,0)")
    units = (size * F.lit(float(2**60))).cast("bigint").cast("decimal(19,0)")
    total = units * F.lit(1000).cast("decimal(4,0)") + half
    # Decimal division rounds, so the remainder is taken off first.
    thousandths = ((total - total % unit) / unit).cast("bigint")
    exact = F.concat(
        F.when(value < 0, "-").otherwise(""),
        F.floor(thousandths / 1000).cast("string"),
        F.lit("."),
        F.lpad((thousandths % 1000).cast("string"), 3, "0"),
    )
    return F.when(size < 4, exact).otherwise(F.format_string("%.3f", value))
