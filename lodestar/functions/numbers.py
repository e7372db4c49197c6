"""Numbers as text, rounded and written the way a half-even binary rounding gives them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a number in a text cell. Spark's own cast also takes "1d".
NUMERIC = r"(?i)^\s*[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf(?:inity)?)\s*$"
# Spellings of a boolean cell.
TRUE_WORDS = ("True", "TRUE", "true")
FALSE_WORDS = ("False", "FALSE", "false")


def round_binary(value: Column, digits: int) -> Column:
    """Nearest decimal of the double itself; a true tie goes to the even digit.

    ``bround`` looks at the shortest decimal of the double, so it takes 0.025 for a tie although
    the double lies above it. Near a tie the side is found exactly: the double is split into two
    parts whose products with the scale are exact.
    """
    scale = 10**digits
    halves = F.lit(float(2 * scale))
    nearest = F.rint(value * halves)
    high = value.cast("float").cast("double")
    residue = (high * halves - nearest) + (value - high) * halves
    below, above = (nearest - 1) / 2, (nearest + 1) / 2
    even = F.when(F.pmod(below, F.lit(2.0)) == 0, below).otherwise(above)
    tie = F.when(residue < 0, below).when(residue > 0, above).otherwise(even)
    odd = F.pmod(nearest, F.lit(2.0)) == 1
    close = F.abs(residue) < 1e-6
    return F.when(odd & close, tie / scale).otherwise(F.bround(value, digits))


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals."""
    return F.format_string(f"%.{digits}f", round_binary(value, digits))


def float_text(value: Column) -> Column:
    """Shortest text of a double: plain from 1e-4 up to 1e16, else with an exponent."""
    text = value.cast("string")
    plain = ~F.contains(text, F.lit("E"))
    sign = F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_extract(text, r"^-?([0-9.]+)E", 1)
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    whole = F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))
    rest = F.substring(digits, exponent + 2, F.lit(20))
    large = F.concat(whole, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    scientific = F.concat(
        F.regexp_replace(mantissa, r"\.0$", ""),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")),
    )
    written = F.when(exponent.between(0, 15), large).when(exponent.between(-4, -1), small).otherwise(scientific)
    special = (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
    )
    return F.when(value.isNull(), F.lit(None)).otherwise(
        F.coalesce(special, F.when(plain, text), F.concat(sign, written))
    )
