from pyspark.sql import functions as F

from concordat.functions.lexeme import sha256
from concordat.operators import compounds, textscan
from concordat.plans import review


def test_compound_displays(spark):
    df = spark.createDataFrame([("82.0 ± 1.6", "82 \\pm 1.60"), ("[1, 2]", "[1,3]"), ("5 [4, 6] (n = 7)", "5.0 [4,6](n=7)"), ("x", "1")], "a string, b string")
    got = [df.select(compounds.matches(F.col("a"), F.col("b"), c, show_n=n)).collect() for c, n in (("mean_sd", False), ("ci", False), ("mean_ci", True))]
    assert [[r[0] for r in g] for g in got] == [[True, None, None, None], [None, False, None, None], [None, None, True, None]]
    stats = spark.range(1).select(F.struct(F.lit(5).cast("long").alias("n"), *[F.lit(v).alias(k) for k, v in (("mean", "82"), ("sd", "1.5811388"), ("se", "0.7071"), ("lower", "80.0368"), ("upper", "83.9632"))]).alias("s"))
    shown = [stats.select(compounds.render(F.col("s"), F.lit("scalar"), c, "decimal", 1, "half_up", spread_places=2, show_n=n)).first()[0] for c, n in (("mean_sd", True), ("mean_ci", False), ("n", False))]
    assert shown == ["82.0 \\pm 1.58 (n = 5)", "82.0 [80.04, 83.96]", "5"]
    docs = spark.createDataFrame([(1, "we get 82.0 ± 1.6 and 3.1 ± 0.2 there, 7")], "doc_id long, text string")
    found = compounds.spans(docs, "mean_sd")
    assert sorted(r.text for r in found.collect()) == ["3.1 ± 0.2", "82.0 ± 1.6"]
    tokens = textscan.number_tokens(docs)
    chosen = spark.createDataFrame([("a", 1, 7), ("a", 1, 14), ("b", 1, 7)], "choice string, doc_id long, start int")
    assert {r.choice: (r.start, r.error) for r in compounds.spans_of_tokens(found, tokens, chosen).collect()} == {"a": (7, None), "b": (None, "NUMERIC_SPAN")}
    located = spark.createDataFrame([("ok", 1, 7, 11), ("cut", 1, 7, 9), ("two", 1, 7, 17), ("none", 1, 0, 3)], "binding string, doc_id long, start int, end int")
    assert {r.binding for r in compounds.partial_numbers(docs, located).collect()} == {"cut", "two", "none"}


def test_acceptance_takes_what_is_needed(spark):
    additions = spark.createDataFrame([("b", "binding", "1"), ("m", "metric", "1"), ("s", "source", "1"), ("other", "metric", "1")], "name string, kind string, definition string")
    existing = spark.createDataFrame([("s", "source", "1")], "name string, kind string, definition string")
    edges = spark.createDataFrame([("b", "m"), ("m", "s"), ("x", "other")], "src string, dst string")
    new, refused = review.accept(spark.createDataFrame([("b",)], "name string"), additions, existing, edges)
    assert {r.name for r in new.collect()} == {"b", "m"} and refused.count() == 0
    _, refused = review.accept(spark.createDataFrame([("b",), ("zz",)], "name string"), additions, existing.withColumn("definition", F.lit("2")), edges)
    assert {(r.name, r.error) for r in refused.collect()} == {("s", "NAME_CONFLICT"), ("zz", "NOT_AVAILABLE")}


def test_repairs_move_anchors_only(spark):
    docs = spark.createDataFrame([(1, "Intro text.\n\nThe mean is 85.0 here.")], "doc_id long, text string")
    old = spark.createDataFrame([(1, "The mean is 84.1 here.")], "doc_id long, text string")
    identity = textscan.blocks(old).first().identity
    anchors = spark.createDataFrame([("b", 1, "84.1"), ("fine", 1, "85.0")], "binding string, doc_id long, exact string")
    previous = spark.createDataFrame([("b", 1, identity, 12, 12, 16)], "binding string, doc_id long, identity string, offset int, start int, end int")
    got = review.repairs(anchors, docs, previous).collect()
    assert [(r.binding, r.error, r.was_start, r.new_start, r.new_end) for r in got] == [("b", "ANCHOR_MISSING", 12, 25, 29)]


def test_patches_reviews_and_fragments(spark):
    docs = spark.createDataFrame([(1, "a 1"), (2, "b 1")], "doc_id long, text string")
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", sha256("text").alias("h")).collect()}
    bindings = spark.createDataFrame([("x", 1, 2, 3, "1", "2", "mismatch", "latex", "f", hashes[1]), ("y", 2, 2, 3, "1", "2", "mismatch", "latex", "f", "old"), ("z", 1, 2, 3, "1", "2", "mismatch", "pdf", "f", hashes[1]), ("w", 1, 2, 3, "1", "2", "mismatch", "latex", "f", hashes[1])], "binding string, doc_id long, start int, end int, actual string, expected string, status string, format string, file string, document_hash string")
    blocked = spark.createDataFrame([("w", ["claim:c"])], "binding string, blocked_by array<string>")
    assert {r.binding: r.error for r in review.patches(bindings, blocked, docs).collect()} == {"x": None, "y": "PATCH_STALE"}
    journal = spark.createDataFrame([("t", 1, "q", hashes[1]), ("t", 2, hashes[2], "q"), ("u", 1, "q", "q")], "transaction string, doc_id long, before_hash string, after_hash string")
    assert {(r.transaction, r.doc_id): r.state for r in review.recoverable(journal, docs).collect()} == {("t", 1): "applied", ("t", 2): "rolled_back", ("u", 1): "foreign"}
    claims = spark.createDataFrame([("c", "1")], "claim string, fingerprint string")
    good, bad = review.attestations(spark.createDataFrame([("c", "me", "1"), ("c", "you", "0"), ("d", "me", "1")], "claim string, reviewer string, fingerprint string"), claims)
    assert good.count() == 1 and {(r.claim, r.error) for r in bad.collect()} == {("c", "REVIEW_STALE"), ("d", "UNKNOWN_CLAIM")}
    one = "fragment string, path string, sha256 string"
    got = review.fragment_targets(spark.createDataFrame([("f", p) for p in "abcde"], "fragment string, path string"), spark.createDataFrame([("a",)], "path string"), spark.createDataFrame([("g", "b", "1"), ("f", "c", "1"), ("f", "d", "1")], one), spark.createDataFrame([("c", "2"), ("d", "1"), ("e", "9")], "path string, sha256 string"))
    assert {r.path: r.error for r in got.collect()} == {"a": "FRAGMENT_INPUT", "b": "FRAGMENT_OWNED", "c": "FRAGMENT_EDITED", "d": None, "e": "FRAGMENT_EDITED"}
