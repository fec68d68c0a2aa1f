"""Numbers as written: grammar, typed gates, unit alignment, derived values and rendering, all as Column functions.

A quantity is carried as its lexeme (the exact text), a ``DECIMAL(24,12)``
value where the lexeme fits without loss, and a unit.  What does not fit goes
to the exact lane in ``concordat.functions.exact``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number grammar and the closed sets of types, units, reductions, operations and predicates.
NUMBER = r"[+\-−]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)(?:[eE][+\-]?\d+)?"
TOKEN = rf"(?U)(?<![\w.]){NUMBER}(?!\w|\.\d)"
NATIVE_TOKEN = rf"(?<![A-Za-z0-9_.]){NUMBER}(?![A-Za-z0-9_]|\.\d)"
INTEGER = r"^[+\-]?(0|[1-9][0-9]*)$"
DECIMAL = r"^[+\-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+\-]?[0-9]+)?$"
PLAIN_DISPLAY = r"^[+\-]?[0-9]{1,12}(?:\.[0-9]{1,12})?(?:\\[,;! ])?(?:\\%)?\z"
TYPES = ("string", "integer", "decimal")
UNITS = ("scalar", "fraction", "percent", "percentage_point", "count", "ratio")
REDUCTIONS = ("unique", "mean", "sum", "count", "statistics")
OPERATIONS = ("difference", "percentage_point_difference", "ratio", "relative_change_percent")
PREDICATES = ("greater_than", "greater_equal", "less_than", "less_equal", "equal", "best_in_set")
MAX_DIGITS, MAX_EXPONENT, MAX_INTEGER = 1024, 1000, 2048

FAST = "decimal(24,12)"
GATED = "struct<value string, error string>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digits(text) -> Column:
    """How many digits the mantissa of a decimal lexeme has, leading zeros aside."""
    mantissa = F.regexp_replace(F.regexp_extract(_c(text), r"^[+\-]?([0-9.]*)", 1), r"[.]", "")
    return F.length(F.regexp_replace(mantissa, "^0+(?=.)", ""))


def exponent(text) -> Column:
    """The power of ten of the last written digit of a decimal lexeme."""
    written = F.coalesce(F.try_to_number(F.regexp_replace(F.regexp_extract(_c(text), r"[eE]\+?(-?[0-9]{1,9})$", 1), "^(-?)0+(?=[0-9])", "$1"), F.lit("S999999999")), F.lit(0))
    return written.cast("long") - F.length(F.regexp_extract(_c(text), r"\.([0-9]*)", 1))


def decimal_gate(text) -> Column:
    """P-02: (value, error) of a decimal lexeme; stricter than Python's own reading in that padding and ``_`` are refused."""
    t = _c(text)
    error = (
        F.when(t.isNull(), "INVALID_NUMBER")
        .when(t.rlike(r"(?i)^[+\-]?(nan|s?nan[0-9]*|inf|infinity)$"), "NONFINITE_NUMBER")
        .when(~t.rlike(DECIMAL), "INVALID_NUMBER")
        .when((digits(t) > MAX_DIGITS) | (F.abs(exponent(t)) > MAX_EXPONENT) | F.regexp_extract(t, r"[eE][+\-]?0*([0-9]*)$", 1).rlike("^[0-9]{5,}"), "NUMBER_LIMIT")
    )
    return F.struct(F.when(error.isNull(), t).alias("value"), error.alias("error"))


def typed_gate(text, kind) -> Column:
    """P-01: (value, error) of a cell declared as string, integer or decimal."""
    t, k = _c(text), _c(kind) if not isinstance(kind, str) or kind not in TYPES else F.lit(kind)
    whole = F.when(t.isNull() | ~t.rlike(INTEGER), "COLUMN_TYPE").when(F.length(t) > MAX_INTEGER, "NUMBER_LIMIT")
    real = F.when(t.isNull() | ~t.rlike(DECIMAL), "COLUMN_TYPE").otherwise(decimal_gate(t)["error"])
    error = F.when(k == "string", F.lit(None).cast("string")).when(k == "integer", whole).when(k == "decimal", real).otherwise("COLUMN_TYPE")
    return F.struct(F.when(error.isNull(), t).alias("value"), error.alias("error"))


def fast(text) -> Column:
    """The lexeme as DECIMAL(24,12), or null where that would lose digits."""
    t = _c(text)
    fits = t.rlike(r"^[+\-]?(?:[0-9]{1,12}(?:\.[0-9]{0,12}0*)?|\.[0-9]{1,12}0*)$")
    return F.when(fits, t.try_cast(FAST))


def canonical(text) -> Column:
    """F-23: one text for equal decimals: integer digits without trailing zeros, ``e``, the exponent; ``0`` for zero."""
    t = _c(text)
    sign = F.when(t.startswith("-"), "-").otherwise("")
    whole = F.regexp_replace(F.regexp_replace(F.regexp_extract(t, r"^[+\-]?([0-9.]*)", 1), r"[.]", ""), "^0+(?=.)", "")
    bare = F.regexp_replace(whole, "0+$", "")
    return F.when(~t.rlike(DECIMAL), None).when(bare == "", "0").otherwise(F.concat(sign, bare, F.lit("e"), (exponent(t) + F.length(whole) - F.length(bare)).cast("string")))


def fingerprint(*parts) -> Column:
    """F-23/F-24: sha256 of a canonical text of the parts; the parts' lengths keep them apart."""
    text = F.concat(*[F.coalesce(F.concat(F.length(_c(p).cast("string")).cast("string"), F.lit(":"), _c(p).cast("string")), F.lit("-")) for p in parts])
    return sha256(text)


def sha256(text) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_c(text).cast("binary"), 256))


# -- displays -------------------------------------------------------------


def parse_display(text) -> Column:
    """F-03: (lexeme, is_percent, error) of a number as displayed in a document."""
    compact = F.regexp_replace(_c(text), r"(?U)\s|\\[,;! ]|~", "")
    percent = compact.endswith("\\%")
    bare = F.when(percent, F.substring(compact, F.lit(1), F.length(compact) - 2)).otherwise(compact)
    good = bare.rlike(f"^{NUMBER}$")
    lexeme = F.replace(F.replace(bare, F.lit(",")), F.lit("−"), F.lit("-"))
    return F.struct(F.when(good, lexeme).alias("lexeme"), F.when(good, percent).alias("is_percent"), F.when(~F.coalesce(good, F.lit(False)), F.lit("UNSUPPORTED_DISPLAY")).alias("error"))


def _let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once; its code is not copied to each place of use."""
    return F.element_at(F.transform(F.array(x), f), 1)


def display_matches(actual, expected) -> Column:
    """F-04/F-21: equal value and equal percent sign; null where either can't be read.

    Short plain numbers are compared as DECIMAL(24,12); higher-order functions,
    which cost far more for each row, are left to the others.
    """
    a, b = _c(actual), _c(expected)
    value = lambda t: F.substring_index(t, "\\", 1).try_cast(FAST)
    plainly = (value(a) == value(b)) & (a.endswith("\\%") == b.endswith("\\%"))
    return F.when(a.isNull() | b.isNull(), None).when(a.rlike(PLAIN_DISPLAY) & b.rlike(PLAIN_DISPLAY), plainly).otherwise(_canonical_matches(a, b))


def _canonical_matches(actual: Column, expected: Column) -> Column:
    """``display_matches`` for displays of any form and length."""
    sides = F.transform(F.array(_c(actual), _c(expected)), lambda x: _let(parse_display(x), lambda p: F.struct(_let(p["lexeme"], canonical).alias("value"), p["is_percent"].alias("percent"))))

    def same(s: Column) -> Column:
        a, b = F.get(s, F.lit(0)), F.get(s, F.lit(1))
        return F.when(a["value"].isNotNull() & b["value"].isNotNull(), (a["value"] == b["value"]) & (a["percent"] == b["percent"]))

    return _let(sides, same)


def normalise_percent(text, fmt) -> Column:
    """F-35: the percent and plus-minus signs of formats other than LaTeX, written as LaTeX does."""
    t = _c(text)
    return F.when(_c(fmt) == "latex", t).otherwise(F.replace(F.regexp_replace(t, r"(?<!\\)%", r"\\%"), F.lit("±"), F.lit("\\pm")))


def canonical_scientific(text) -> Column:
    """F-15: ``m × 10^e``, also with superscript digits, as ``mEe``."""
    plain = F.translate(_c(text), "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺−", "0123456789-+-")
    return F.regexp_replace(plain, r"^\s*([+\-]?[0-9]+(?:\.[0-9]+)?)\s*[×x·*]\s*10\s*\^?\s*\{?([+\-]?[0-9]+)\}?\s*$", "$1E$2")


def measurement(value) -> Column:
    """F-16: (value, status) of a logged value: observed, missing or nonfinite."""
    v = _c(value)
    nonfinite = F.lower(v).rlike(r"^[+\-]?(nan|inf|infinity)$")
    status = F.when(v.isNull(), "missing").when(nonfinite, "nonfinite").otherwise("observed")
    return F.struct(F.when(status == "observed", v).alias("value"), status.alias("status"))


def render(value, unit, kind, places, rounding, percent_symbol=False, most_places: int = 12) -> Column:
    """F-10/F-11: (text, error) of a decimal column; kinds decimal, integer and percent.

    The scale of ``round`` must be a constant, so there is one branch for each
    number of places up to ``most_places``.
    """
    v, u, k, p, r = _c(value), _c(unit), _c(kind), _c(places), _c(rounding)
    sign = percent_symbol if isinstance(percent_symbol, Column) else F.lit(percent_symbol)
    error = F.when((k == "percent") & ~F.coalesce(u.isin("fraction", "percent"), F.lit(False)), "UNIT_MISMATCH").when(~k.isin("decimal", "integer", "percent"), "EXACT_LANE").when(v.isNull(), "INVALID_NUMBER")
    shown = F.when((k == "percent") & (u == "fraction"), (v.cast("decimal(34,14)") * F.lit(100).cast("decimal(3,0)")).cast("decimal(37,14)")).otherwise(v.cast("decimal(37,14)"))
    n = F.when(k == "integer", 0).otherwise(p)
    text = None
    for i in range(most_places + 1):
        exact = F.when(r == "half_even", F.bround(shown, i)).otherwise(F.round(shown, i)).cast(f"decimal(38,{i})")
        one = F.when(exact == 0, F.abs(exact)).otherwise(exact).cast("string")
        text = F.when(n == i, one) if text is None else text.when(n == i, one)
    text = F.concat(text, F.when((k == "percent") & sign, "\\%").otherwise(""))
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def plain_decimal(text) -> Column:
    """A decimal lexeme of any length in full: no exponent, no sign of zero, no zeros at the end of its fraction; null where the gate refuses it."""
    t = _c(text)
    power = exponent(t)
    whole = F.regexp_replace(F.regexp_replace(F.regexp_extract(t, r"^[+\-]?([0-9.]*)", 1), r"[.]", ""), "^0+(?=.)", "")

    def placed(x: Column) -> Column:
        shift, digits_ = x["power"], x["whole"]
        longer = F.concat(digits_, F.repeat(F.lit("0"), F.greatest(shift, F.lit(0))))
        padded = F.lpad(digits_, F.greatest(F.length(digits_), 1 - shift), F.lit("0"))
        cut = F.length(padded) + shift
        pointed = F.concat(F.substring(padded, F.lit(1), cut), F.lit("."), F.substring(padded, cut + 1, -shift))
        return F.when(shift >= 0, longer).otherwise(F.regexp_replace(F.regexp_replace(pointed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))

    shown = _let(F.struct(power.cast("int").alias("power"), whole.alias("whole")), placed)
    sign = F.when(t.startswith("-") & ~whole.rlike("^0*$"), "-").otherwise("")
    return F.when(decimal_gate(t)["value"].isNotNull(), F.when(whole.rlike("^0*$"), "0").otherwise(F.concat(sign, shown)))


def exact_json(fields: dict[str, tuple[Column, str]]) -> Column:
    """F-25: a JSON object with sorted keys; strings are quoted, integers and decimals stand as exact numbers, nulls as null; no text where a decimal is refused by the gate."""

    def value(x: Column, kind: str) -> Column:
        if kind == "string":
            text = F.to_json(F.array(x))
            return F.substring(text, F.lit(2), F.length(text) - 2)
        return plain_decimal(x) if kind == "decimal" else x.cast("string")

    parts = [F.concat(F.lit('"' + name.replace("\\", "\\\\").replace('"', '\\"') + '":'), F.when(x.isNull(), "null").otherwise(value(x, kind))) for name, (x, kind) in sorted(fields.items())]
    between = [x for part in parts for x in (F.lit(","), part)][1:]
    return F.concat(F.lit("{"), *between, F.lit("}"))


def location_label(file, fmt, line, table, row, column) -> Column:
    """F-36: where a number stands, for people: by line, by table cell, or by file alone."""
    cell = F.format_string("%s, table %s, row %s, column %s", _c(file), _c(table), _c(row), _c(column))
    return F.when(_c(table).isNotNull(), cell).when(_c(fmt).isin("latex", "markdown") & _c(line).isNotNull(), F.format_string("%s:%s", _c(file), _c(line))).otherwise(_c(file))
