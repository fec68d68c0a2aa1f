import random
from decimal import Decimal, localcontext
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from concordat.functions import exact
from concordat.operators import metrics as mx
from concordat.operators import profile, states
from concordat.operators.metrics import Derived, Metric
from concordat.plans.check import check

TYPES = {"dataset": "string", "model": "string", "split": "string", "seed": "integer", "accuracy": "decimal"}
ROWS = [("d", m, "test", str(s), v) for m, vs in (("Ours", ("0.840", "0.841", "0.842")), ("Baseline", ("0.806", "0.807", "0.808"))) for s, v in enumerate(vs, 1)]


def evidence(spark, rows=ROWS):
    return spark.createDataFrame(rows, "dataset string, model string, split string, seed string, accuracy string")


def mean(model, **options):
    return Metric(model, "accuracy", "mean", "fraction", {"model": model, "split": "test"}, expected_count=3, seed_column="seed", expected_seeds=["1", "2", "3"], **options)


def results(df):
    return {r.metric: r for r in df.collect()}


def test_mean_with_seeds_and_difference(spark):
    own = mx.evaluate(evidence(spark), [mean("Ours"), mean("Baseline")], TYPES)
    got = results(own)
    assert Decimal(got["Ours"].value) == Decimal("0.841") and got["Ours"].error is None
    out = results(mx.derive(own, [Derived("gain", "percentage_point_difference", "Ours", "Baseline"), Derived("twice", "difference", "gain", "gain")]))
    assert Decimal(out["gain"].value) == Decimal("3.4") and out["gain"].unit == "percentage_point" and Decimal(out["twice"].value) == 0


@pytest.mark.parametrize(
    "change, error",
    [
        (lambda r: r[:2] + r[3:], "SEED_SET"),
        (lambda r: r + [r[0]], "SEED_SET"),
        (lambda r: [(*r[0][:4], "NaN")] + r[1:], "INVALID_NUMBER"),
        (lambda r: [(*r[0][:4], None)] + r[1:], "INVALID_NUMBER"),
        (lambda r: [x for x in r if x[1] != "Ours"], "SEED_SET"),
        (lambda r: r, None),
        (lambda r: r + [("d", "Other", "test", "1", "x")], None),
        (lambda r: list(reversed(r)), None),
    ],
)
def test_every_problem_is_unknown(spark, change, error):
    got = results(mx.evaluate(evidence(spark, change(list(ROWS))), [mean("Ours")], TYPES))["Ours"]
    assert got.error == error and (got.value is None) == (error is not None)


def test_reductions_and_contracts(spark):
    where = {"model": "Ours", "split": "test"}
    wanted = [
        Metric("sum", "accuracy", "sum", "fraction", where),
        Metric("count", "accuracy", "count", "count", where),
        Metric("unique", "accuracy", "unique", "fraction", {**where, "seed": "+2"}),
        Metric("many", "accuracy", "unique", "fraction", where),
        Metric("none", "accuracy", "mean", "fraction", {"model": "Nobody"}),
        Metric("five", "accuracy", "mean", "fraction", where, expected_count=5),
        Metric("column", "loss", "mean", "fraction", where),
        Metric("text", "model", "mean", "fraction", {"split": "test"}),
        Metric("selector", "accuracy", "mean", "fraction", {"seed": "x"}),
        Metric("unit", "accuracy", "count", "fraction", where),
        Metric("stats", "accuracy", "statistics", "fraction", where, level="0.95"),
    ]
    got = results(mx.evaluate(evidence(spark), wanted, TYPES))
    assert {n: r.error for n, r in got.items()} == {"sum": None, "count": None, "unique": None, "many": "AMBIGUOUS_SELECTION", "none": "EMPTY_SELECTION", "five": "RECORD_COUNT", "column": "MISSING_COLUMN", "text": "COLUMN_TYPE", "selector": "SELECTOR_TYPE", "unit": "CONTRACT", "stats": None}
    assert Decimal(got["sum"].value) == Decimal("2.523") and got["count"].value == "3" and Decimal(got["unique"].value) == Decimal("0.841")
    assert abs(Decimal(got["stats"].statistics.sd) - Decimal("0.001")) < Decimal("1e-50")
    health = spark.createDataFrame([("evidence", "DUPLICATE_KEY")], "source string, error string")
    assert {r.error for r in mx.evaluate(evidence(spark), wanted, TYPES, health).collect()} == {"DUPLICATE_KEY"}


def test_long_decimals_go_to_the_exact_lane(spark):
    rows = [("d", "001", "test", "1", "0.80000000000000000000000000001"), ("d", "001", "test", "2", "1e-40"), ("d", "1", "test", "2", "0.9")]
    got = results(mx.evaluate(evidence(spark, rows), [Metric("a", "accuracy", "sum", where={"model": "001"}), Metric("b", "accuracy", "unique", where={"model": "1"})], TYPES))
    assert Decimal(got["a"].value) == Decimal("0.8000000000000000000000000000100000000001") and Decimal(got["b"].value) == Decimal("0.9")


def wide_number(rng):
    digits = "".join(rng.choice("0123456789") for _ in range(rng.choice([1, 5, 12, 13, 18, 19, 24, 37, 60, 400, 1024])))
    point = rng.randrange(len(digits) + 1)
    text = rng.choice(["", "-", "+"]) + digits[:point] + rng.choice([".", ""]) * (point > 0 or point < len(digits)) + digits[point:]
    text = text if text.strip("+-.") else "0"
    return text + rng.choice(["", "", "e5", "E-7", "e-900", "E+700"]) if len(digits) <= 60 else text if len(digits) < 1000 else text.replace(".", "")


def exact_fraction(text):
    mantissa, _, power = text.lower().partition("e")
    return Fraction(Decimal(mantissa)) * Fraction(10) ** int(power or 0)


def test_sums_of_numbers_of_all_lengths(spark):
    rng = random.Random(7)
    rows = [(rng.choice("abc"), wide_number(rng)) for _ in range(300)] + [("d", "1"), ("d", "10000000000000"), ("e", "99999999999.999999999999")] + [("e", "999999999999.999999999999")] * 40 + [("f", "0.000"), ("f", "-0"), ("g", "nan"), ("g", "1e40"), ("h", "1e40"), ("h", None)]
    df = spark.createDataFrame(rows, "model string, accuracy string").repartition(5)
    sums = {r.model: r for r in mx.batch_matrix(df, ["model"], ["accuracy"], how="sum").collect()}
    means = {r.model: r for r in mx.batch_matrix(df, ["model"], ["accuracy"]).collect()}
    for model in "abcdef":
        values = [exact_fraction(v) for m, v in rows if m == model]
        assert sums[model].error is None and sums[model].n == len(values)
        with localcontext() as c:
            c.prec = 6000
            assert exact_fraction(sums[model].value) == sum(values)
        got, want = exact_fraction(means[model].value), sum(values) / len(values)
        assert abs(got - want) <= abs(want) * Fraction(1, 10**78)
    assert means["d"].value == "5000000000000.5" and sums["g"].error == sums["h"].error == "INVALID_NUMBER"
    whole = results(mx.evaluate(df.withColumn("seed", F.lit("1")), [Metric(m, "accuracy", "sum", where={"model": m}) for m in "abde"], TYPES))
    assert all(whole[m].value == sums[m].value for m in "abde")


def test_statistics_of_long_numbers(spark):
    rng = random.Random(9)
    lexemes = [f"{rng.randint(-10**k, 10**k)}.{rng.randint(0, 10**k)}e{rng.randint(-20, 20)}" for k in (2, 8, 11, 20, 30) for _ in range(6)]
    df = spark.createDataFrame([(x,) for x in lexemes] + [], "accuracy string").withColumn("model", F.lit("m"))
    got = results(mx.evaluate(df, [Metric("m", "accuracy", "statistics", where={"model": "m"}, level="0.95")], TYPES))["m"].statistics
    values = [Fraction(Decimal(x)) for x in lexemes]
    middle = sum(values) / len(values)
    with localcontext() as c:
        c.prec = 90
        variance = sum((v - middle) ** 2 for v in values) / (len(values) - 1)
        sd = (Decimal(variance.numerator) / variance.denominator).sqrt()
        assert abs(Decimal(got.sd) / sd - 1) < Decimal("1e-70") and abs(Decimal(got.mean) * middle.denominator / middle.numerator - 1) < Decimal("1e-70")
        assert abs(Decimal(got.upper) - Decimal(got.mean) - exact.t_critical(29, "0.95") * Decimal(got.se)) < Decimal("1e-40")
    by_group = mx.group_statistics(df, ["model"], "accuracy", "0.95").first()
    assert tuple(by_group.statistics) == tuple(got)[:7] and by_group.error is None
    far = df.withColumn("accuracy", F.concat("accuracy", F.lit("0" * 120)))
    assert mx.group_statistics(far.where("accuracy not like '%e%'").union(spark.createDataFrame([("1" * 101, "m")], "accuracy string, model string")), ["model"], "accuracy").first().error == "STATISTICS_LIMIT"


def test_fingerprints(spark):
    rng = random.Random(1)
    wanted = [mean("Ours")]
    first = results(mx.evaluate(evidence(spark), wanted, TYPES))["Ours"].fingerprint
    rows = list(ROWS)
    rng.shuffle(rows)
    assert results(mx.evaluate(evidence(spark, rows + [("e", "X", "test", "1", "1")]), wanted, TYPES))["Ours"].fingerprint == first
    same = [(*r[:4], r[4] + "0") for r in ROWS]
    assert results(mx.evaluate(evidence(spark, same), wanted, TYPES))["Ours"].fingerprint == first
    swapped = [(*ROWS[0][:4], ROWS[1][4]), (*ROWS[1][:4], ROWS[0][4]), *ROWS[2:]]
    assert results(mx.evaluate(evidence(spark, swapped), wanted, TYPES))["Ours"].fingerprint != first


def test_batch_matrix_equals_single_metrics(spark):
    batch = {(r.model, r.split): r for r in mx.batch_matrix(evidence(spark, ROWS + [("d", None, "test", "1", "0.1")]), ["model", "split"], ["accuracy"]).collect()}
    single = results(mx.evaluate(evidence(spark), [mean("Ours"), mean("Baseline")], TYPES))
    assert all(batch[m, "test"].value == single[m].value for m in single)
    assert batch[None, "test"].error == "MISSING_IDENTITY"


def test_cycles_are_refused(spark):
    own = mx.evaluate(evidence(spark), [mean("Ours")], TYPES)
    with pytest.raises(ValueError):
        mx.derive(own, [Derived("a", "ratio", "b", "b"), Derived("b", "ratio", "a", "a")])
    out = results(mx.derive(own, [Derived("x", "ratio", "Ours", "absent")]))
    assert out["x"].error == "UNKNOWN_METRIC"


def test_check_end_to_end(spark):
    bindings = spark.createDataFrame([("b1", "Ours", "percent", 1, "half_up", True, "latex"), ("b2", "gain", "decimal", 1, "half_up", False, "markdown"), ("b3", "Baseline", "percent", 1, "half_up", True, "markdown"), ("b4", "Ours", "decimal", 3, "half_up", False, "latex")], "binding string, metric string, kind string, places int, rounding string, percent_symbol boolean, format string")
    located = spark.createDataFrame([("b1", "84.1\\%", None), ("b2", "3.5", None), ("b3", "80.7%", None), ("b4", None, "ANCHOR_AMBIGUOUS")], "binding string, actual string, error string")
    claims = spark.createDataFrame([("better", "greater_than", "Ours", "Baseline", None, None, None, None, None), ("big", "greater_equal", "gain", None, "5", "percentage_point", None, None, None), ("best", "best_in_set", "Ours", None, None, None, ["Baseline"], "maximize", False), ("tie", "best_in_set", "Ours", None, None, None, ["Ours"], "maximize", False), ("units", "less_than", "gain", "Ours", None, None, None, None, None)], "claim string, op string, left string, right string, threshold string, threshold_unit string, candidates array<string>, direction string, allow_ties boolean")
    report = check(evidence(spark), TYPES, [mean("Ours"), mean("Baseline")], [Derived("gain", "percentage_point_difference", "Ours", "Baseline")], bindings, located, claims)
    assert {r.binding: (r.status, r.error) for r in report.bindings.collect()} == {"b1": ("pass", None), "b2": ("mismatch", None), "b3": ("pass", None), "b4": ("unknown", "ANCHOR_AMBIGUOUS")}
    assert {r.claim: (r.status, r.error) for r in report.claims.collect()} == {"better": ("pass", None), "big": ("mismatch", None), "best": ("pass", None), "tie": ("mismatch", None), "units": ("unknown", "UNIT_MISMATCH")}
    assert report.exit_code.first()[0] == 2
    assert tuple(report.coverage.first()) == (9, 4, 3, 2)
    edges = spark.createDataFrame([("gain", "Ours"), ("gain", "Baseline")], "src string, dst string")
    blocked = {r.binding: r.blocked_by for r in states.blocked_by(report.bindings, report.claims, edges).collect()}
    assert blocked == {"b2": ["claim:big", "claim:tie", "claim:units"]}
    kinds = [r.kind for r in states.action_counts(states.actions(report.findings)).orderBy("ord").collect()]
    assert kinds == ["resolve_evidence", "repair_bindings", "review_claims", "update_numbers"]
    scope = spark.createDataFrame([("c", "gain", {"split": "test"}), ("d", "gain", {"split": "train"})], "claim string, metric string, scope map<string,string>")
    selectors = spark.createDataFrame([("Ours", {"split": "test"}), ("Baseline", {"split": "test"})], "metric string, where map<string,string>")
    assert [r.claim for r in states.scope_errors(scope, edges, selectors).collect()] == ["d"]


def test_profile_and_roles(spark):
    df = spark.createDataFrame([("001", "1", "0.5", None, "x"), ("1", "2", "0.7", None, "y"), ("1", "3", "", None, "x")], "code string, seed string, score string, nothing string, model_name string")
    got = {r.column: r for r in profile.column_profile(df).collect()}
    assert {c: r.reason for c, r in got.items()} == {"code": "leading_zero", "seed": "integer", "score": "missing", "nothing": "empty", "model_name": "identity_name"}
    assert got["model_name"].examples == ["x", "y"] and got["seed"].distinct == 3
    assert {r.column: r.role for r in profile.roles(profile.column_profile(df)).collect()} == {"code": "other", "seed": "repeat", "score": "other", "nothing": "other", "model_name": "group_by"}
    keys = {tuple(r.columns): r.is_key for r in profile.key_candidates(df, ["seed", "model_name"]).collect()}
    assert keys == {("seed", "model_name"): True, ("seed",): True, ("model_name",): False}


def test_moments_in_whole_numbers():
    from decimal import Decimal, localcontext
    from fractions import Fraction

    for values in ([5], [1, 1], [0, 0, 0], ["17.25", "3", "-20.000000000001"], [10**11, "-0.5", 7, 7], ["0.1"] * 9):
        x = [Fraction(Decimal(v)) for v in values]
        total, square = sum(x), sum(v * v for v in x)
        for level in (None, "0.95"):
            want, error = exact.moments(len(x), total, square, 1, level)
            with localcontext() as c:
                c.prec = 80
                got = exact.plain_moments(len(x), int(total * 10**12), int(square * 10**24), 1, level)
            assert got == ([(want or {}).get(k) for k in exact.MOMENTS], error)


def test_group_statistics_give_the_number_of_rows(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "3"), ("b", "2")], "g string, x string")
    got = {r.g: (r.n, r.error, r.statistics.mean) for r in mx.group_statistics(rows, ["g"], "x").collect()}
    assert got == {"a": (2, None, "2"), "b": (1, "STATISTICS_COUNT", None)}


def test_canonical_texts_in_steps(spark):
    """With whole numbers step by step as by patterns, on both sides of where the former end."""
    from concordat.functions import lexeme as lx
    from concordat.functions import limbs

    texts = ["0", "-0.000", "0.05", "-12.50", "+007.10", "1200000", "8999999.999999999999", "9000000", "-9000001.5", "123456789012.5", "1e-3", "12345678901234567890", ".5", "5.", "0.000000000001", "1.0000000000000000", "x", "NaN", None]
    rows = limbs.gated(spark.createDataFrame([(t,) for t in texts], "lexeme string"), F.lit(True))
    for r in limbs.with_canonical(rows, "canon").withColumn("want", F.coalesce(lx.canonical("lexeme"), "lexeme")).collect():
        assert r.canon == r.want, r
