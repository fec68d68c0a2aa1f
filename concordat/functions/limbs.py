"""Exact sums of decimals of any length as native partial aggregations.

A number that fits DECIMAL(24,12) is summed as such.  Any other is cut into
limbs, whole numbers of at most 18 digits times a power of ten that is a
multiple of 18, so numbers of all lengths have their limbs at the same powers;
each power is summed by itself as a DECIMAL(38,0), and nothing is carried until
a group is down to its sums, of which there are as many as powers (under 240
for the 1,024 digits and exponents that a lexeme may have).  Squares are sums
of products of limbs of 9 digits, or of the two halves of a DECIMAL(24,12).

No sum here can overflow below 1e10 rows of a group times 1e9 groups.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import lexeme as lx
from concordat.operators.declared import declared

#: Digits of a limb of a sum, and of one of a product.
WIDTH, HALF = 18, 9
SUMS = ["n", "nulls", "bad", "wide", "limit", "total", "limbs", "high", "cross", "low", "squares"]


def limbs(text, width: int = WIDTH) -> Column:
    """The limbs (power, limb) of a decimal lexeme that passed the gate; those that are zero are left out."""
    t = lx._c(text)
    return F.when(t.rlike(PLAIN), _two(t)).otherwise(_any(t, width)) if width == WIDTH else _any(t, width)


#: Whole numbers of at most two limbs, without an exponent.
PLAIN = rf"^[+\-]?[0-9]{{1,{2 * WIDTH}}}\z"


def _two(t: Column) -> Column:
    """``limbs`` of whole numbers as in ``PLAIN``, without higher-order functions, which cost far more for each row."""
    full = F.lpad(F.translate(t, "+-", ""), 2 * WIDTH, F.lit("0"))
    sign = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    limb = lambda at: (F.substring(full, at, WIDTH).cast(f"decimal({WIDTH},0)") * sign).cast(f"decimal({WIDTH},0)").alias("limb")
    high, low = (F.struct(F.lit(p).alias("power"), limb(at)) for p, at in ((WIDTH, 1), (0, WIDTH + 1)))
    tall, short = high["limb"] != 0, low["limb"] != 0
    return F.when(tall & short, F.array(high, low)).when(tall, F.array(high)).when(short, F.array(low)).otherwise(F.slice(F.array(high), 1, 0))


def _any(t: Column, width: int) -> Column:
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(t, r"^[+\-]?([0-9.]*)", 1), "[.]", ""), "^0+(?=.)", "")
    last = lx.exponent(t)
    short = F.pmod(last, F.lit(width)).cast("int")
    padded = F.concat(digits, F.repeat(F.lit("0"), short))
    n = F.ceil(F.length(padded) / width).cast("int")
    full = F.lpad(padded, n * width, F.lit("0"))
    sign = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")

    def limb(i: Column) -> Column:
        return F.struct(
            (last - short + width * (n - 1 - i)).cast("int").alias("power"),
            (F.substring(full, i * width + 1, F.lit(width)).cast(f"decimal({width},0)") * sign).cast(f"decimal({width},0)").alias("limb"),
        )

    return F.filter(F.transform(F.sequence(F.lit(0), n - 1), limb), lambda x: x["limb"] != 0)


def products(text) -> Column:
    """The limbs (power, limb) of the square, one for each pair of 9-digit limbs."""
    small = limbs(text, HALF)
    return F.flatten(F.transform(small, lambda a: F.transform(small, lambda b: F.struct((a["power"] + b["power"]).alias("power"), (a["limb"] * b["limb"]).cast("decimal(18,0)").alias("limb")))))


def with_canonical(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``lexeme.canonical`` of ``lexeme``, or the lexeme itself where it is no number, to rows that ``gated`` has marked.

    Of what is below 9e6 the zeros at the end are divided away, 16, 8, 4, 2 and
    1 at a time, in whole numbers and step by step: as one expression this is
    more than the JVM compiles.
    """
    kept = rows.columns
    units = F.when(F.abs("fast") < 9_000_000, (F.col("fast") * F.lit(10**12).cast("decimal(13,0)")).cast("long"))
    out = rows.select(*kept, units.alias("_units"), F.lit(-12).alias("_power"))
    for k in (16, 8, 4, 2, 1):
        ends = F.col("_units") % 10**k == 0
        out = out.select(*kept, F.when(ends, F.expr(f"_units div {10**k}L")).otherwise(F.col("_units")).alias("_units"), F.when(ends, F.col("_power") + k).otherwise(F.col("_power")).alias("_power"))
    short = F.when(F.col("_units") == 0, "0").otherwise(F.concat(F.col("_units").cast("string"), F.lit("e"), F.col("_power").cast("string")))
    return out.select(*kept, F.when(F.col("_units").isNotNull(), short).otherwise(F.coalesce(lx._let(F.col("lexeme"), lx.canonical), F.col("lexeme"))).alias(name))


def beyond_limits(text) -> Column:
    """Whether a number is too long or too far from one for statistics."""
    power, size = lx.exponent(text), lx.digits(text)
    return (size > 100) | (F.abs(power) > 200) | (F.abs(power + size - 1) > 200)


def gated(rows: DataFrame, is_number: Column) -> DataFrame:
    """Adds ``fast``, the lexeme as DECIMAL(24,12), ``bad``, and ``wide``, a number that doesn't fit; the full gate is only run on what doesn't fit."""
    rows = rows.withColumn("fast", lx.fast("lexeme"))
    odd = F.col("fast").isNull() | (F.length("lexeme") > lx.MAX_DIGITS)
    rows = rows.withColumn("bad", F.col("lexeme").isNotNull() & is_number & odd & lx.decimal_gate("lexeme")["error"].isNotNull())
    return rows.withColumn("wide", F.col("lexeme").isNotNull() & ~F.col("bad") & F.col("fast").isNull() & is_number)


def sums(rows: DataFrame, keys: list[str], squares: Column | None = None, more: dict[str, tuple[Column, str]] | None = None, narrow: bool = False, few: bool = False) -> DataFrame:
    """One row (keys, the columns ``SUMS``, those of ``more``) for each group of ``rows``, which ``gated`` has marked.

    ``squares`` says of which rows sums of squares are wanted.  ``more`` gives
    further columns: what to aggregate for each row, and how: ``sum`` or
    ``bit_or``.

    All rows go through one aggregation of plain sums.  Only wide numbers are
    cut into limbs, summed by group and power, and joined to it.  ``narrow``
    says that there are none: nothing is joined then, and a wide number fails the
    job.  ``few`` says that the groups are as few as declarations: their plain sums
    are taken at once, and limbs are only made where these count wide numbers.
    """
    wanted = F.lit(False) if squares is None else squares
    more = more or {}
    cells = rows.select(*keys, "lexeme", "fast", "bad", "wide", *[x.alias(f"more_{k}") for k, (x, _) in more.items()], wanted.alias("wanted"))
    whole = F.col("fast").cast("long").cast("decimal(12,0)")
    rest = ((F.col("fast") - whole) * F.lit(10**12).cast("decimal(13,0)")).cast("decimal(12,0)")
    nothing = F.lit(None).cast("decimal(38,0)")

    def product(a: Column, b: Column) -> Column:
        return F.sum(F.when(F.col("wanted"), (a * b).cast("decimal(28,0)"))) if squares is not None else nothing

    combine = {"sum": F.sum, "bit_or": F.bit_or}
    main = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("lexeme").isNull()).alias("nulls"),
        F.count_if("bad").alias("bad"),
        F.count_if("wide").alias("wide"),
        (F.count_if(F.col("wanted") & F.col("wide") & beyond_limits("lexeme")) if squares is not None else F.lit(0).cast("long")).alias("limit"),
        F.sum(F.col("fast").cast("decimal(28,12)")).alias("total"),
        product(whole, whole).alias("high"), product(whole, rest).alias("cross"), product(rest, rest).alias("low"),
        *[combine[how](f"more_{k}").alias(k) for k, (_, how) in more.items()],
    )
    if few:
        taken = main.collect()
        main = declared(main.sparkSession, [tuple(r) for r in taken], main.schema.simpleString())
    if narrow or few and not any(r["wide"] for r in taken):
        fits = F.when(F.col("wide") > 0, F.raise_error(F.lit("a number declared as narrow does not fit DECIMAL(24,12)")).cast("decimal(38,12)")).otherwise(F.col("total"))
        no_limbs = F.lit(None).cast("array<struct<power:int,limb:decimal(38,0)>>")
        return main.withColumns({"total": fits, "limbs": no_limbs, "squares": no_limbs}).select(*keys, *SUMS, *more)
    none = F.lit(None).cast("decimal(18,0)")
    parts = F.transform(limbs("lexeme"), lambda x: F.struct(x["power"].alias("power"), x["limb"].alias("limb"), none.alias("product")))
    if squares is not None:
        own = F.when(F.col("wanted") & ~beyond_limits("lexeme"), products("lexeme")).otherwise(F.array().cast("array<struct<power:int,limb:decimal(18,0)>>"))
        parts = F.concat(parts, F.transform(own, lambda x: F.struct(x["power"].alias("power"), none.alias("limb"), x["limb"].alias("product"))))
    each = cells.where("wide").select(*keys, F.explode(parts).alias("part")).groupBy(*keys, F.col("part.power").alias("power")).agg(F.sum("part.limb").alias("limb"), F.sum("part.product").alias("product"))
    # As many rows of a group as powers.
    long = each.groupBy(*[F.col(k).alias(f"wide_{k}") for k in keys]).agg(
        F.collect_list(F.when(F.col("limb").isNotNull(), F.struct("power", "limb"))).alias("limbs"),
        F.collect_list(F.when(F.col("product").isNotNull(), F.struct("power", F.col("product").alias("limb")))).alias("squares"),
    )
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"wide_{k}")), keys, F.lit(True))
    return main.join(long, same, "left").select(*keys, *SUMS, *more)


def carried(parts) -> Fraction:
    """The number that summed limbs stand for; zero for none."""
    return sum((Fraction(int(limb)) * Fraction(10) ** power for power, limb in parts or ()), Fraction(0))


def total(row) -> Fraction:
    """The exact sum of a row of ``sums``."""
    return Fraction(row["total"] or 0) + carried(row["limbs"])


def square(row) -> Fraction:
    """The exact sum of squares of a row of ``sums``."""
    own = Fraction(int(row["high"] or 0)) + Fraction(2 * int(row["cross"] or 0), 10**12) + Fraction(int(row["low"] or 0), 10**24)
    return own + carried(row["squares"])
