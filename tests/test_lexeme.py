import random
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal, localcontext
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from concordat.functions import exact, limbs
from concordat.functions import lexeme as lx


def column(spark, values, expression, name="x"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_typed_gate(spark):
    values = ["1", "+7", "-0", "01", "1.0", " 1", "", None, "9" * 40, "9" * 2049]
    errors = column(spark, values, lx.typed_gate("x", "integer")["error"])
    assert errors == [None, None, None, "COLUMN_TYPE", "COLUMN_TYPE", "COLUMN_TYPE", "COLUMN_TYPE", "COLUMN_TYPE", None, "NUMBER_LIMIT"]
    assert column(spark, ["001", "1", ""], lx.typed_gate("x", "string")["value"]) == ["001", "1", ""]


def test_decimal_gate(spark):
    values = ["0.80000000000000000000000000001", "1e5", "1e-1001", "NaN", "Infinity", "1_000", "−1", "", ".5", "1.", "1e99999999999", "9" * 1025]
    assert column(spark, values, lx.decimal_gate("x")["error"]) == [None, None, "NUMBER_LIMIT", "NONFINITE_NUMBER", "NONFINITE_NUMBER", "INVALID_NUMBER", "INVALID_NUMBER", "INVALID_NUMBER", None, None, "NUMBER_LIMIT", "NUMBER_LIMIT"]


def test_fast_lane_refuses_what_it_would_round(spark):
    assert column(spark, ["0.8", "0.80000000000000000000000000001", "1e3", "123456789012.123456789012", "1234567890123", "-.5", "0.8000000000000000"], lx.fast("x").cast("string")) == ["0.800000000000", None, None, "123456789012.123456789012", None, "-0.500000000000", "0.800000000000"]


@pytest.mark.parametrize("group", [["1.50", "1.5", "15e-1", "0.15e1", "+1.5"], ["0", "-0.00", "0e7", "000"], ["-1200", "-1.2E3", "-12e+2"]])
def test_canonical_numbers(spark, group):
    assert len(set(column(spark, group, lx.canonical("x")))) == 1


def test_displays(spark):
    values = ["96.50\\,\\%", "1,234.5", "−3", "12 345", "12,34", "abc", ".5~"]
    got = column(spark, values, lx.parse_display("x"))
    assert [(r.lexeme, r.is_percent, r.error) for r in got] == [("96.50", True, None), ("1234.5", False, None), ("-3", False, None), ("12345", False, None), (None, None, "UNSUPPORTED_DISPLAY"), (None, None, "UNSUPPORTED_DISPLAY"), (".5", False, None)]
    df = spark.createDataFrame([("96.50\\,\\%", "96.5\\%"), ("96.5", "96.5\\%"), ("1.0", "1"), ("x", "1")], "a string, b string")
    assert [r[0] for r in df.select(lx.display_matches("a", "b")).collect()] == [True, False, True, None]


def test_scientific_and_measurements(spark):
    assert column(spark, ["1.5 × 10^-3", "2 × 10⁻³", "7"], lx.canonical_scientific("x")) == ["1.5E-3", "2E-3", "7"]
    assert [tuple(r) for r in column(spark, ["1", None, "NaN", "-Infinity"], lx.measurement("x"))] == [("1", "observed"), (None, "missing"), (None, "nonfinite"), (None, "nonfinite")]


def test_units_and_differences():
    rows = [("difference", "0.841", "fraction", "80", "percent", "0.041", "fraction", None), ("percentage_point_difference", "0.841", "fraction", "0.807", "fraction", "3.4", "percentage_point", None), ("percentage_point_difference", "84.1", "percent", "80.7", "percent", "3.4", "percentage_point", None), ("difference", "1", "count", "1", "percent", None, None, "UNIT_MISMATCH"), ("percentage_point_difference", "1", "count", "1", "count", None, None, "UNIT_MISMATCH"), ("difference", "0.1", "ratio", "0.3", "ratio", "-0.2", "ratio", None)]
    for row in rows:
        assert exact.derive(*row[:5]) == row[5:]


def test_rendering_in_both_lanes(spark):
    cases = [("95.25", "percent", "percent", 1, r, s) for r in ("half_up", "half_even") for s in (True, False)] + [("0.9525", "fraction", "percent", 1, "half_even", False), ("-0.004", "scalar", "decimal", 2, "half_up", False), ("2.5", "count", "integer", 0, "half_even", False), ("3", "scalar", "decimal", 3, "half_up", False), ("1", "count", "percent", 1, "half_up", False)]
    df = spark.createDataFrame(cases, "v string, u string, k string, p int, r string, s boolean")
    native = df.select(lx.render(F.col("v").cast("decimal(34,12)"), "u", "k", "p", "r", F.col("s")).alias("x")).select("x.*").collect()
    wide = df.select(exact.render_column(F.col("v"), F.col("u"), F.col("k"), F.col("p"), F.col("r"), F.col("s")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in native] == [tuple(r) for r in wide]
    assert [r.text for r in native] == ["95.3\\%", "95.3", "95.2\\%", "95.2", "95.2", "0.00", "2", "3.000", None]
    assert exact.render("12345.678", "scalar", "scientific", 3, "half_up", False) == ("1.235E+4", None)


def test_exact_lane():
    assert exact.derive("ratio", "1", "scalar", "3", "scalar")[0].startswith("0." + "3" * 49)
    assert exact.derive("ratio", "1", "scalar", "0", "scalar") == (None, None, "ZERO_DENOMINATOR")
    assert exact.derive("power", "1", "scalar", "1", "scalar")[2] == "UNKNOWN_OPERATION"
    assert len(exact.mean("2", 3)) >= 50


def test_student_t():
    # Closed forms for one and two degrees, and printed table values.
    assert abs(exact.t_critical(1, "0.95", 30) - Decimal("12.7062047361747")) < Decimal("1e-12")
    assert abs(exact.t_critical(2, "0.95", 30) - Decimal("4.30265272974946")) < Decimal("1e-12")
    for df, level, value in ((4, "0.95", "2.776"), (10, "0.99", "3.169"), (30, "0.9", "1.697"), (120, "0.95", "1.980")):
        assert abs(exact.t_critical(df, level) - Decimal(value)) < Decimal("0.0006")
    # Beyond any table: the normal quantile's next two terms are 1e-9 and 1e-18 here, and each value lies below the one of fewer degrees.
    z = Decimal("1.959963984540054235524594430520551")
    for df in (10**6, 10**9):
        assert abs(exact.t_critical(df, "0.95") - z - (z**3 + z) / (4 * df)) < Decimal(3) / Decimal(df) ** 2
    values = [exact.t_critical(df, "0.95") for df in (1, 2, 3, 2000, 2001, 2002, 20_000, 20_001, 20_002, 10**8)]
    assert values == sorted(values, reverse=True)
    assert all(len(v.as_tuple().digits) >= 58 for v in values)


def test_student_t_against_closed_forms():
    """For even degrees the tail is a finite sum in the sine and cosine of atan(t / sqrt(df)); the level must come back to 55 digits."""
    with localcontext() as c:
        c.prec = 90
        for df in (2, 4, 10, 100, 1000, 2000, 2002, 20_002):
            for level in ("0.5", "0.95", "0.999"):
                t = exact.t_critical(df, level)
                sin, cos2 = t / (df + t * t).sqrt(), Decimal(df) / (df + t * t)
                term = total = Decimal(1)
                for k in range(1, df // 2):
                    term *= cos2 * (2 * k - 1) / (2 * k)
                    total += term
                assert abs(sin * total - Decimal(level)) < Decimal("1e-57"), (df, level)


def moments(values, ddof, level):
    numbers = [Fraction(v) for v in values]
    return exact.moments(len(numbers), sum(numbers, Fraction(0)), sum((x * x for x in numbers), Fraction(0)), ddof, level)


def test_moments(spark):
    got, error = moments(["80", "81", "82", "83", "84"], 1, "0.95")
    assert error is None and Decimal(got["mean"]) == 82 and abs(Decimal(got["sd"]) ** 2 - Decimal("2.5")) < Decimal("1e-60")
    assert abs(Decimal(got["upper"]) - Decimal(got["mean"]) - Decimal("2.776445105") * Decimal(got["se"])) < Decimal("1e-8")
    assert moments(["1"], 1, None) == (None, "STATISTICS_COUNT")
    odd = spark.createDataFrame([("1e300", True), ("1" * 101, True), ("1.5e100", False), ("1e-201", True), ("0.000", False)], "x string, far boolean")
    assert all(r.far == r.found for r in odd.withColumn("found", limbs.beyond_limits("x")).collect())


def test_limbs_add_up(spark):
    rng = random.Random(4)
    texts = ["0", "-0.000", "1", "-1e-1000", "9" * 1024, "." + "0" * 300 + "5"] + [f"{rng.choice(['', '-'])}{rng.randint(0, 10**rng.randint(1, 70))}.{rng.randint(0, 10**9)}e{rng.randint(-90, 90)}" for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", limbs.limbs("x").alias("sum"), limbs.products("x").alias("square"))
    for r in df.collect():
        mantissa, _, power = r.x.partition("e")
        value = Fraction(mantissa) * Fraction(10) ** int(power or 0)
        assert limbs.carried(r.sum) == value and limbs.carried(r.square) == value * value
        assert all(p % limbs.WIDTH == 0 and limb for p, limb in r.sum)


def test_rounding_against_decimals():
    rng = random.Random(8)
    for _ in range(2000):
        x = Decimal(rng.randint(-10**6, 10**6)).scaleb(-rng.randint(0, 5))
        for places in (0, 1, 3):
            for rule, name in ((ROUND_HALF_UP, "half_up"), (ROUND_HALF_EVEN, "half_even")):
                wanted = x.quantize(Decimal(1).scaleb(-places), rule)
                assert exact.render(str(x), "scalar", "decimal", places, name, False)[0] == f"{abs(wanted) if wanted == 0 else wanted:.{places}f}"
                if x:
                    text = exact.render(str(x), "scalar", "scientific", places, name, False)[0]
                    wanted = x.scaleb(-x.adjusted()).quantize(Decimal(1).scaleb(-places), rule).scaleb(x.adjusted())
                    assert Decimal(text) == wanted and text == f"{wanted:.{places}E}", (x, text)
        assert Fraction(exact.text_of(Fraction(x))) == Fraction(x)


def test_plain_displays_are_compared_as_all_others(spark):
    shown = ["5", "5.0", "+5", "-0", "0.000", "5\\%", "5.0\\,\\%", "5\\;", "5\\, \\%", "5\\%\n", "5\n", "1,000", "1000", "1e3", "−5", "-5", ".5", "0.5", "123456789012", "1234567890123", "0." + "1" * 13, "x", "", "5\\%\\%", "5.", None]
    rows = spark.createDataFrame([(a, b) for a in shown for b in shown], "a string, b string")
    out = rows.select("a", "b", lx.display_matches("a", "b").alias("got"), lx._canonical_matches(F.col("a"), F.col("b")).alias("wanted")).collect()
    assert [tuple(r) for r in out if r.got != r.wanted] == []
    # These take no higher-order function.
    assert rows.where(F.col("a").rlike(lx.PLAIN_DISPLAY) & F.col("b").rlike(lx.PLAIN_DISPLAY)).count() == 12**2


def test_whole_numbers_of_two_limbs_are_cut_as_all_others(spark):
    texts = ["0", "-0", "+7", "123456789012345678", "1234567890123456789", "-" + "9" * 36, "1" + "0" * 35, "000" + "1" * 20, "0" * 40 + "5", "9" * 37]
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", t.rlike(limbs.PLAIN).alias("plain"), limbs.limbs("t").alias("got"), limbs._any(t, limbs.WIDTH).alias("wanted"), limbs._two(t).alias("two")).collect()
    for r in rows:
        assert limbs.carried([tuple(x) for x in r.got]) == limbs.carried([tuple(x) for x in r.wanted]) == int(r.t), r.t
        assert r.got == r.wanted and (not r.plain or r.got == r.two)
    assert [r.t for r in rows if not r.plain] == [texts[-2], texts[-1]]
