"""Secret scanning with a random forest over candidates (operator 4), in DataFrame functions only.

Candidates are runs of 16 or more key characters with a digit, issued keys of
known form, and values of 8 or more signs assigned to a name like password,
secret or token.  Each is described by its length, the shares and changes of
character classes, common letter pairs, the share covered by dictionary words,
path marks, and the words and signs around it.  A random forest, trained from
labelled findings, tells secrets from the hashes, identifiers, numbers, paths
and plain words that look alike.

The labelled findings are made from a bounded sample of the corpus: real
neighbouring words of ``sample_docs`` documents, with tokens of known kind put
in (see ``POSITIVE`` and ``NEGATIVE``).  The dictionary is counted over the
whole texts of all documents.

Scale: one scan cuts the texts with candidates into pieces, and only candidates
are joined.  Verdicts are tied to texts by hash, so copies are judged once and
rows without doc_id like all others.  A token repeated in a third of all rows
sits in a join whose skewed side Spark splits.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free

_T, _L = "[A-Za-z0-9+/_-]", "[A-Za-z+/_-]"
# Issued keys in full; by chance such a key has no digit (3.6 % of AKIA keys).
ISSUED = f"(?:AKIA|ASIA)[A-Z2-7]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|npm_[A-Za-z0-9]{{36}}|[sr]k_live_[A-Za-z0-9]{{24,}}|glpat-[A-Za-z0-9_-]{{20}}|AIza[A-Za-z0-9_-]{{35}}"
# What a value is assigned behind: a secret name, a quote that ends it, = or :, an opening quote.
ASSIGNED = "(?=[PpSsTtAa])(?i:pass(?:word|wd|phrase)|pwd|secret|token|api_?key|access_key|private_key)[\"']?[ \t]{0,2}[=:][ \t]{0,2}[\"'`]?"
_SIGN = "\\s\"'`<>,;"
CANDIDATE = rf"({ASSIGNED})([^{_SIGN}]{{7,}}[^{_SIGN}.:)!?])|(?<!{_T})((?={_L}*+[0-9]){_T}{{16,}}+={{0,2}}|(?:{ISSUED})(?!{_T}))"
#: Put around tokens to cut texts at them; no text holds it, as this noncharacter is read as a space.
_CUT = "\uffff"

# Words around a key that speak for and against a secret, beginnings of issued keys, common letter pairs.
SECRET_WORDS = "pass|pwd|secret|token|key|auth|cred|bearer|private|access"
HARMLESS_WORDS = "commit|sha|md5|digest|checksum|hash|uuid|guid|version|revision|integrity|base64,|image|order|invoice|page|isbn"
PREFIXES = "AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|eyJ|glpat-|npm_|SG"
PAIRS = "th|he|in|er|an|re|nd|on|en|at|ou|ed|ha|to|or|it|is|hi|es|ng|ch|ei|ie|de|le|nt|qu|ue|ar|os|io|st|te|se|me|ve"
PLACEHOLDER_WORDS = ["your", "example", "sample", "test", "placeholder", "insert", "change", "dummy", "here", "this", "secret", "token", "password", "access", "value", "replace", "none", "null", "default", "demo"]

FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_signs", "f_changes", "f_pairs", "f_distinct", "f_hex", "f_words", "f_slashes", "f_path", "f_secret", "f_harmless", "f_assigned", "f_quoted", "f_prefix"]

# Findings put into real text: (what stands before, the token, what stands after).  H and B are 64 hex and 43 base64 characters that differ from row to row.
POSITIVE = [
    (" token = \"", "substring(H, 1, 40)", "\" "),
    (" api_key: ", "B", " "),
    (" password=\"", "translate(substring(B, 1, 20), '+/', 'x7')", "\" "),
    (" AWS_SECRET_ACCESS_KEY=", "substring(B, 1, 40)", "\n"),
    (" ", "concat('AKIA', upper(substring(translate(B, '+/', 'QZ'), 1, 16)))", " "),
    (" ", "concat('ghp_', substring(translate(B, '+/', 'a9'), 1, 36))", " "),
    (" Authorization: Bearer ", "concat(B, '=')", "\n"),
    (" secret = '", "substring(H, 1, 32)", "' "),
    (" client_secret\": \"", "substring(B, 3, 32)", "\","),
    (" auth token: ", "substring(H, 1, 48)", " "),
    (" private_key=", "H", " "),
    (" password = \"", "concat(upper(substring(B, 1, 1)), substring(H, 2, 4), '!', substring(B, 7, 5), '$')", "\" "),
    (" passwd: ", "concat(substring(B, 1, 6), '@', substring(N, 1, 3), '%')", "\n"),
    (" secret: ", "translate(substring(B, 1, 24), '0123456789+/', 'ghijklmnopqr')", " "),
    (" pwd=", "translate(substring(B, 9, 10), '+/', '#&')", " "),
]
NEGATIVE = [
    (" commit ", "substring(H, 1, 40)", " "),
    (" sha256:", "H", " "),
    (" md5 ", "substring(H, 1, 32)", " "),
    (" ", "substring(H, 1, 40)", " "),
    (" id=", "concat_ws('-', substring(H, 1, 8), substring(H, 9, 4), substring(H, 13, 4), substring(H, 17, 4), substring(H, 21, 12))", " "),
    (" see ", "concat('/usr/lib/', w1, '/', w2, '-', substring(N, 1, 2))", " "),
    (" ", "substring(N, 1, 16)", " "),
    (" ", "concat(w1, w2, w3, substring(N, 1, 4))", ". "),
    (" version ", "concat('2024-', substring(N, 1, 2), '-', substring(N, 3, 14))", " "),
    (" https://", "concat('www/', w1, '/', w2, '-', w3, '-', substring(N, 1, 6))", " "),
    (" data:image/png;base64,", "concat(B, B, B)", "\""),
    (" integrity=\"", "concat('sha512-', B)", "\" "),
    (" api_key = \"", "concat('your_', w1, '_api_key_here_', substring(N, 1, 3))", "\" "),
    (" password = ", "concat('example_password_', substring(N, 1, 4))", " "),
    (" order number ", "substring(N, 1, 18)", " "),
    (" ", "concat(w1, '_', w2, '_', w3, '_', substring(N, 1, 2))", " "),
    (" password: ", "w1", " "),
    (" token = ", "concat(w1, '_', w2, '_', w3)", " "),
    (" secret: ", "concat(w1, w2)", ". "),
    (" password = ", "concat('get_', w1, '_', w2, '()')", "\n"),
    (" token: ", "concat('${', upper(w1), '_', upper(w2), '}')", " "),
    (" password=", "substring('********************', 1, 8 + cast(substring(N, 1, 1) as int))", " "),
]


def _body(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _CUT, " ")


def _pieces(body: Column) -> Column:
    """The text cut at its candidates: those are the pieces of odd places, counted from 0."""
    return F.split(F.regexp_replace(body, CANDIDATE, f"$1{_CUT}$2$3{_CUT}"), _CUT, -1)


def _key(body: Column) -> list[Column]:
    return [F.xxhash64(body).alias("key_a"), F.hash(F.lit(1), body).alias("key_b")]


def candidates(docs: DataFrame) -> DataFrame:
    """(key_a, key_b, place, token, before, after) of every candidate of every different text.

    key_a and key_b stand for the text; place counts the pieces it is cut into.
    """
    body = docs.select(_body().alias("body")).where(F.col("body").rlike(CANDIDATE))
    cut = body.select(*_key(F.col("body")), _pieces(F.col("body")).alias("p"))
    p = F.col("p")

    def end(piece):
        return F.coalesce(F.right(piece, F.lit(48)), F.lit(""))

    def found(i):
        # Seven pieces hold 48 characters: each token has 8 or more, each gap but the first one or more.
        behind = F.right(F.concat(*[end(F.get(p, i - k)) for k in range(7, 0, -1)]), F.lit(48))
        return F.struct(i.alias("place"), F.get(p, i).alias("token"), behind.alias("before"), F.left(F.concat(*[F.coalesce(F.left(F.get(p, i + k), F.lit(16)), F.lit("")) for k in (1, 2, 3)]), F.lit(16)).alias("after"))

    each = cut.select("key_a", "key_b", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 2, F.lit(2)), found)).alias("c"))
    return each.select("key_a", "key_b", "c.*").distinct()


def _places(docs: DataFrame) -> DataFrame:
    """(key_a, key_b, place, start) of the candidates: start counts characters from 1, by a running sum of the pieces' lengths."""
    body = docs.select(_body().alias("body")).where(F.col("body").rlike(CANDIDATE))
    # The hashes are taken before the pieces become rows, once for each text.
    cut = body.select(*_key(F.col("body")), F.transform(_pieces(F.col("body")), F.length).alias("sizes"))
    sizes = cut.select("key_a", "key_b", F.posexplode("sizes").alias("place", "n")).distinct()
    before = Window.partitionBy("key_a", "key_b").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", (F.sum("n").over(before) + 1).cast("int")).where("place % 2 = 1").drop("n")


def dictionary(docs: DataFrame, tokens: DataFrame, least: int = 3) -> DataFrame:
    """(word): runs of four or more letters of ``tokens`` (token) that stand as words of their own in ``least`` documents, and placeholder words."""
    # Saved, so that Spark knows its size and broadcasts it where it is small, instead of shuffling all words for this join.
    runs = Scratch(docs.sparkSession, "dictionary").save(tokens.select(F.explode(_runs()).alias("word")).distinct(), "runs")
    free_standing = F.regexp_extract_all(F.lower("text"), F.lit("(?<![^\\s(\"'])[a-z]{4,}+(?![^\\s.,;:!?)\"'])"), F.lit(0))
    said = docs.where("text is not null").select(F.explode(F.array_distinct(free_standing)).alias("word")).join(runs, "word", "left_semi")
    own = said.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word")
    fixed = docs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in PLACEHOLDER_WORDS])).alias("word"))
    return own.union(fixed).distinct()


def _runs() -> Column:
    return F.regexp_extract_all(F.lower("token"), F.lit("[a-z]{4,}"), F.lit(0))


def _share(pattern: str) -> Column:
    return F.regexp_count("token", F.lit(pattern)) / F.length("token")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the columns ``FEATURES``; ``words`` (word) is the dictionary."""
    runs = found.select("token").distinct().select("token", F.explode(_runs()).alias("word"))
    covered = runs.join(words, "word").groupBy("token").agg(F.sum(F.length("word")).alias("covered"))
    near = F.lower("before")
    return found.join(covered, "token", "left").withColumns(
        {
            "f_length": F.length("token").cast("double"),
            "f_digits": _share("[0-9]"),
            "f_upper": _share("[A-Z]"),
            "f_lower": _share("[a-z]"),
            "f_signs": _share("[^A-Za-z0-9]"),
            "f_changes": _share("(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])"),
            "f_pairs": _share(f"(?i){PAIRS}"),
            "f_distinct": F.size(F.array_distinct(F.split("token", ""))) / F.length("token"),
            "f_hex": F.col("token").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
            "f_words": F.coalesce(F.col("covered") / F.length("token"), F.lit(0.0)),
            "f_slashes": F.regexp_count("token", F.lit("/")).cast("double"),
            "f_path": (F.col("before").rlike(r"[/\\.]$|://\S*$") | F.col("token").rlike("^/|^[a-z]+/[a-z]+/")).cast("double"),
            "f_secret": F.substring(near, -32, 32).rlike(SECRET_WORDS).cast("double"),
            "f_harmless": F.substring(near, -24, 24).rlike(HARMLESS_WORDS).cast("double"),
            "f_assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
            "f_quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
            "f_prefix": F.col("token").rlike(f"^(?:{PREFIXES})").cast("double"),
        }
    ).drop("covered")


def labelled_findings(docs: DataFrame, sample_docs: int) -> DataFrame:
    """(token, before, after, label): tokens of known kind in the words of ``sample_docs`` documents, those with the least hashes of their doc_id."""
    scratch = Scratch(docs.sparkSession, "findings")
    usable = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    ids = scratch.save(usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs), "ids")
    # The ids are a bounded number; a doc_id that occurs again counts by its least text.
    chosen = usable.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    words = F.expr("filter(split(text, '[^\\\\p{L}]+'), w -> length(w) > 2)")
    sample = scratch.save(chosen.select("doc_id", words.alias("w")).where("size(w) > 8"), "sample")
    seed = "cast(doc_id as string)"
    base = sample.selectExpr("doc_id", "w", f"sha2({seed}, 256) as H", f"substring(base64(unhex(sha2(concat({seed}, 'b'), 256))), 1, 43) as B", f"translate(sha2(concat({seed}, 'n'), 256), 'abcdef', '183746') as N")
    kinds = [(*x, 1.0) for x in POSITIVE] + [(*x, 0.0) for x in NEGATIVE]
    made = []
    for k, (lead, token, tail, label) in enumerate(kinds):
        place = f"pmod(xxhash64(doc_id, {k}), size(w) - 6)"
        here = base.selectExpr("*", f"cast({place} as int) as p").selectExpr("*", "lower(w[p + 3]) as w1", "lower(w[p + 4]) as w2", "lower(w[p + 5]) as w3")
        before = F.substring(F.concat(F.concat_ws(" ", F.slice("w", F.col("p") + 1, 3)), F.lit(lead)), -48, 48)
        made.append(here.select(F.expr(token).alias("token"), before.alias("before"), F.substring(F.concat(F.lit(tail), F.col("w1")), 1, 16).alias("after"), F.lit(label).alias("label")))
    findings = made[0]
    for more in made[1:]:
        findings = findings.union(more)
    return scratch.save(findings.where("length(token) >= 8"), "findings")


def train(findings: DataFrame, words: DataFrame, trees: int = 24, depth: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings (token, before, after, label); the findings are a bounded set."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(findings, words))
    # The bootstrap draws by partition: a fixed number of sorted ones makes the model the same on every cluster.
    dealt = rows.select("features", "label", F.xxhash64(*FEATURES).alias("h")).repartition(8, "h").sortWithinPartitions("h", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17).fit(dealt.select("features", "label"))


def _judged(docs: DataFrame, least: float, sample_docs: int, findings: DataFrame | None, words: DataFrame | None) -> DataFrame:
    """The candidates of all different texts with score, kind and is_secret."""
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.save(candidates(docs), "candidates")
    if findings is None:
        findings = labelled_findings(docs, sample_docs)
    if words is None:
        words = scratch.save(dictionary(docs, found.select("token").union(findings.select("token"))), "words")
    described = features(found, words)
    if findings.select("label").distinct().count() < 2:
        scored = described.withColumn("score", F.col("f_prefix"))
    else:
        model = train(findings, words)
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    kind = (
        F.when(F.col("f_prefix") == 1, "issued key")
        .when(F.col("f_hex") == 1, "hex")
        .when(F.col("token").rlike("[A-Z]") & F.col("token").rlike("[a-z]"), "base64")
        .otherwise("other")
    )
    return scored.select("key_a", "key_b", "place", "token", kind.alias("kind"), "score", (F.col("score") >= least).alias("is_secret"))


def scan(docs: DataFrame, least: float = 0.5, sample_docs: int = 1500, findings: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, token, kind, score, is_secret) of every candidate in ``docs`` (doc_id, text).

    ``findings`` (token, before, after, label) train the forest; without them
    they are made from ``sample_docs`` documents.  ``words`` (word) is the
    dictionary; without it, it is counted over all documents.  ``start`` counts
    characters from 1.  Null and empty texts have no candidates; null doc_ids
    are passed through and repeated rows give repeated findings; other columns
    are not looked at.  A corpus with nothing to learn from gives no scores:
    every candidate of an issued kind is then a secret and no other is.
    """
    keys = ["key_a", "key_b"]
    judged = _judged(docs, least, sample_docs, findings, words).join(_places(docs), [*keys, "place"])
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _body().alias("body")).where(F.col("body").rlike(CANDIDATE)).select("doc_id", *_key(F.col("body")))
    return held.join(judged, keys).select("doc_id", "start", "token", "kind", "score", "is_secret")


def redact(docs: DataFrame, mark: str = "[SECRET]", least: float = 0.5, sample_docs: int = 1500, findings: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """``docs`` with every found secret replaced by ``mark``; ``n_chars``, if there, is counted again.

    No row is dropped, and rows with null or repeated doc_ids are treated like
    all others.  Only rows with candidates are joined with findings; the others
    pass untouched.
    """
    body, a, b, flags = free(docs.columns, "body", "key_a", "key_b", "flags")
    has = F.coalesce(_body().rlike(CANDIDATE), F.lit(False))
    judged = _judged(docs, least, sample_docs, findings, words)
    # One flag for each candidate of a text, in order.
    in_order = F.array_sort(F.collect_list(F.struct("place", "is_secret")))
    by_text = judged.groupBy("key_a", "key_b").agg(in_order.alias("f"), F.bool_or("is_secret").alias("any")).where("any").select(F.col("key_a").alias(a), F.col("key_b").alias(b), F.col("f.is_secret").alias(flags))
    held = docs.where(has).withColumn(body, _body())
    held = held.withColumns(dict(zip((a, b), _key(F.col(body)), strict=True))).join(by_text, [a, b], "left")
    cut = F.array_join(F.transform(_pieces(F.col(body)), lambda p, i: F.when((i % 2 == 1) & F.get(flags, ((i - 1) / 2).cast("int")), mark).otherwise(p)), "")
    held = held.withColumn("text", F.when(F.col(flags).isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        held = held.withColumn("n_chars", F.when(F.col(flags).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return docs.where(~has).select(*docs.columns).unionByName(held.select(*docs.columns))
