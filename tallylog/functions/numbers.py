"""Numbers as ECMAScript prints them: shortest digits, ``1e+21``, ``1e-7``, ``0.000001``."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylog.functions.binding import let

# Executors need not have this package installed: the UDF travels with its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXACT_INTEGERS = 2**53
_SMALLEST_NORMAL = 2.2250738585072014e-308
_SURE_DIGITS = 15


def _place_point(sign: Column, digits: Column, exponent: Column) -> Column:
    """Digits d1d2…dn meaning d1.d2…dn × 10^exponent, written the ECMAScript way."""
    n = F.length(digits)
    whole = exponent + 1
    head = F.substring(digits, 1, 1)
    tail = F.substr(digits, F.lit(2), n)
    mantissa = F.when(n > 1, F.concat(head, F.lit("."), tail)).otherwise(head)
    magnitude = F.abs(exponent).cast("string")
    text = (
        F.when((exponent >= 0) & (exponent < 21) & (n <= whole), F.rpad(digits, whole, F.lit("0")))
        .when(
            (exponent >= 0) & (exponent < 21),
            F.concat(
                F.substr(digits, F.lit(1), whole), F.lit("."), F.substr(digits, whole + 1, n)
            ),
        )
        .when(
            (exponent < 0) & (exponent >= -6),
            F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits),
        )
        .when(exponent > 0, F.concat(mantissa, F.lit("e+"), magnitude))
        .otherwise(F.concat(mantissa, F.lit("e-"), magnitude))
    )
    return F.concat(sign, text)


def number_text(x: Column) -> Column:
    """Text of a double where built-in expressions are sure of it, else null.

    Integers below 2^53 are exact. Otherwise the cast to text is trusted up to 15 significant
    digits: no two such decimals share a double, so none can be shorter. More digits, and
    subnormal numbers, go to :func:`exact_number_texts`.
    """
    is_whole = (F.abs(x) < F.lit(float(EXACT_INTEGERS))) & (x == F.floor(x).cast("double"))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))

    def split(cast: Column) -> Column:
        mantissa = F.substring_index(cast, "E", 1)
        power = F.when(
            cast.contains("E"), F.substring_index(cast, "E", -1).try_cast("int")
        ).otherwise(F.lit(0))
        before = F.substring_index(mantissa, ".", 1)
        joined = F.concat(before, F.substring_index(mantissa, ".", -1))
        return F.struct(joined.alias("joined"), (power + F.length(before) - 1).alias("exponent"))

    def strip(parts: Column) -> Column:
        significant = F.ltrim(parts["joined"], F.lit("0"))
        leading = F.length(parts["joined"]) - F.length(significant)
        return F.struct(
            F.rtrim(significant, F.lit("0")).alias("digits"),
            (parts["exponent"] - leading).alias("exponent"),
        )

    def place(parts: Column) -> Column:
        sure = (F.length(parts["digits"]) <= _SURE_DIGITS) & (F.abs(x) >= F.lit(_SMALLEST_NORMAL))
        return F.when(sure, _place_point(sign, parts["digits"], parts["exponent"]))

    other = let(F.abs(x).cast("string"), lambda cast: let(split(cast), lambda p: let(strip(p), place)))
    return F.when(is_whole, x.cast("long").cast("string")).otherwise(other)


def shortest_text(x: float) -> str:
    """ECMAScript text of one finite double: Python's shortest digits, point moved."""
    if x == 0:
        return "0"
    sign = "-" if x < 0 else ""
    mantissa, _, power = repr(abs(x)).partition("e")
    before, _, after = mantissa.partition(".")
    joined = before + after
    significant = joined.lstrip("0")
    exponent = int(power or 0) + len(before) - 1 - (len(joined) - len(significant))
    digits = significant.rstrip("0")
    if 0 <= exponent < 21:
        whole = digits[: exponent + 1].ljust(exponent + 1, "0")
        rest = digits[exponent + 1 :]
        return sign + whole + ("." + rest if rest else "")
    if -7 < exponent < 0:
        return sign + "0." + "0" * (-exponent - 1) + digits
    rest = "." + digits[1:] if len(digits) > 1 else ""
    return f"{sign}{digits[0]}{rest}e{'+' if exponent > 0 else '-'}{abs(exponent)}"


@F.arrow_udf(T.ArrayType(T.StringType()))
def exact_number_texts(values: pa.Array) -> pa.Array:
    """Texts of arrays of doubles; a null stays null. Almost every array is empty and free.

    Pass empty arrays, not nulls: Arrow's writer goes over all nulls before for each next one.
    """
    kind = pa.list_(pa.string())
    if len(values.flatten()) == 0:
        return pa.nulls(len(values), kind)
    texts = lambda row: [None if x is None else shortest_text(x) for x in row]
    return pa.array([texts(row) if row else None for row in values.to_pylist()], kind)


# Keeps a filter on the result above the step that computes it, where it would otherwise be moved
# below and then hold a Python UDF it cannot run.
exact_number_texts = exact_number_texts.asNondeterministic()
