"""Compound statistical displays: ``m ± s``, ``[lo, hi]`` and ``m [lo, hi]``, with an optional ``(n = k)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import lexeme as lx
from concordat.operators import intervals, textscan

# The components of a statistical display.
COMPONENTS = ("mean", "sd", "se", "n", "ci_lower", "ci_upper", "confidence_level", "mean_sd", "mean_se", "ci", "mean_ci")


def pattern(component: str, percent: bool = False, show_n: bool = False) -> str:
    """F-18: the grammar of one kind of display, with a group for each number."""
    if component not in COMPONENTS:
        raise ValueError(f"unknown component {component}")
    term = f"({lx.NUMBER})" + r"\s*" + (r"(?:\\%|%)" if percent else "")
    pair = rf"\[\s*{term}\s*,\s*{term}\s*\]"
    body = {"mean_sd": rf"{term}\s*(?:±|\\pm)\s*{term}", "mean_se": rf"{term}\s*(?:±|\\pm)\s*{term}", "ci": pair, "mean_ci": rf"{term}\s*{pair}"}.get(component, term)
    return body + (r"\s*\(\s*n\s*=\s*([0-9]+)\s*\)" if show_n else "")


def _groups(component: str, show_n: bool) -> int:
    return {"mean_sd": 2, "mean_se": 2, "ci": 2, "mean_ci": 3}.get(component, 1) + show_n


def parse(text: Column, component: str, percent: bool = False, show_n: bool = False) -> Column:
    """F-19: (parts, error): the display's numbers as canonical lexemes, or STATISTICAL_DISPLAY."""
    bare = F.trim(F.regexp_replace(text, r"\\[,;! ]|~", " "))
    whole = rf"^{pattern(component, percent, show_n)}$"
    good = F.coalesce(bare.rlike(whole), F.lit(False))
    numbers = F.array(*[F.regexp_extract(bare, whole, i + 1) for i in range(_groups(component, show_n))])
    # One function over the array: the canonical form written out for each number would be too long to compile.
    parts = F.transform(numbers, lambda x: lx.canonical(F.replace(F.replace(x, F.lit(",")), F.lit("−"), F.lit("-"))))
    return F.struct(F.when(good, parts).alias("parts"), F.when(~good, F.lit("STATISTICAL_DISPLAY")).alias("error"))


def matches(actual: Column, expected: Column, component: str, percent: bool = False, show_n: bool = False) -> Column:
    """F-21: equal number by number; null where a side can't be read."""
    a, b = parse(actual, component, percent, show_n), parse(expected, component, percent, show_n)
    return F.when(a["error"].isNull() & b["error"].isNull(), a["parts"] == b["parts"])


def render(statistics: Column, unit: Column, component: str, kind: str, places: int, rounding: str, percent: bool = False, spread_places: int | None = None, show_n: bool = False, level: str | None = None) -> Column:
    """F-20: the text of a display from a statistics struct (n, mean, sd, se, lower, upper as lexemes)."""
    from concordat.functions import exact

    spread = places if spread_places is None else spread_places

    def shown(value: Column, n: int, of: Column = unit) -> Column:
        return exact.render_column(value, of, F.lit(kind), F.lit(n), F.lit(rounding), F.lit(percent))["text"]

    s = statistics
    one = {"mean": lambda: shown(s["mean"], places), "sd": lambda: shown(s["sd"], places), "se": lambda: shown(s["se"], places), "n": lambda: s["n"].cast("string"), "ci_lower": lambda: shown(s["lower"], places), "ci_upper": lambda: shown(s["upper"], places), "confidence_level": lambda: shown(F.lit(level), places, F.lit("fraction"))}
    pair = F.concat(F.lit("["), shown(s["lower"], spread), F.lit(", "), shown(s["upper"], spread), F.lit("]")) if component in ("ci", "mean_ci") else None
    if component in ("mean_sd", "mean_se"):
        text = F.concat(shown(s["mean"], places), F.lit(" \\pm "), shown(s[component[5:]], spread))
    elif component == "ci":
        text = pair
    elif component == "mean_ci":
        text = F.concat(shown(s["mean"], places), F.lit(" "), pair)
    else:
        text = one[component]()
    return F.concat(text, F.lit(" (n = "), s["n"].cast("string"), F.lit(")")) if show_n else text


def spans(documents: DataFrame, component: str, percent: bool = False, show_n: bool = False) -> DataFrame:
    """X-16, X-19: (doc_id, start, end, text) of every display of the kind that is no part of a longer word or number."""
    whole = rf"(?<![A-Za-z0-9_.]){pattern(component, percent, show_n)}(?![A-Za-z0-9_]|\.\d)"
    return documents.select("doc_id", F.explode(textscan._spans(F.col("text"), F.lit(whole))).alias("s")).select("doc_id", "s.start", "s.end", F.col("s.text").alias("text"))


def spans_of_tokens(displays: DataFrame, tokens: DataFrame, chosen: DataFrame) -> DataFrame:
    """X-16: (choice, start, end, error): the one display whose numbers are exactly the chosen ones (choice, doc_id, start)."""
    held = intervals.contained_in(tokens.select("doc_id", "start", "end"), displays.select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end")))
    own = held.groupBy("doc_id", "r_start", "r_end").agg(F.array_sort(F.collect_set("start")).alias("numbers"))
    asked = chosen.groupBy("choice", "doc_id").agg(F.array_sort(F.collect_set("start")).alias("numbers"))
    met = asked.join(own, ["doc_id", "numbers"]).groupBy("choice").agg(F.count(F.lit(1)).alias("n"), F.min("r_start").alias("start"), F.min("r_end").alias("end"))
    return asked.select("choice").join(met, "choice", "left").select("choice", F.when(F.col("n") == 1, F.col("start")).alias("start"), F.when(F.col("n") == 1, F.col("end")).alias("end"), F.when(F.col("n").isNull(), "NUMERIC_SPAN").when(F.col("n") > 1, "ANCHOR_AMBIGUOUS").alias("error"))


def partial_numbers(documents: DataFrame, located: DataFrame) -> DataFrame:
    """F-22: (binding, error): spans (binding, doc_id, start, end) that cut a number in two or hold none or several."""
    tokens = textscan.number_tokens(documents, native=True).select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    met = intervals.overlap_join(located, tokens)
    n = met.groupBy("binding").agg(F.count(F.lit(1)).alias("n"), F.expr("bool_and(start <= r_start and r_end <= end)").alias("whole"))
    out = located.select("binding").join(n, "binding", "left")
    return out.select("binding", F.when(F.col("n").isNull() | (F.col("n") != 1) | ~F.col("whole"), "NUMERIC_SPAN").alias("error")).where("error is not null")
