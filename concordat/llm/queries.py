"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the folder is CONCORDAT_TOKENIZERS or that of the installed files."""
    folder = os.environ.get("CONCORDAT_TOKENIZERS")
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrapper import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_and_decode

    coded = encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_source_bytes"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("token").cast("long").alias("n_chars"), F.sha2(F.col("token").cast("binary"), 256).alias("token_sha256"), "kind", "score", "is_secret")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .unigram import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import classify, train

    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_turns, read_back

    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for k, r in enumerate(("user", "assistant"))])))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return read_back(format_turns(turns))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, train
    from .quality_model import held_out

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(1, 3).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxscore import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codebooks import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_main_text, op3_sentencepiece, op4_secrets, op5_decontamination,
        op6_quality_rules, op7_token_counts, op8_quality_model, op9_chat_format, op10_language,
        op11_top_k, op12_vector_codes, op13_source_divergence,
    )
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP6_SQL = rf"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as body, coalesce(source, chr(1)) as host, {_WORDS.format("coalesce(text, '')")} as words from documents),
  win as (select rid, unnest(range(1, len(words) - 3)) as i, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) as five from d where len(words) >= 5),
  again as (select rid, i, count(*) over (partition by rid, five) as times from win),
  placed as (select rid, coalesce(least(lead(i) over (partition by rid order by i) - i, 5), 5) as step from again where times > 1),
  repeats as (select rid, sum(step) as n_repeat_words from placed group by 1),
  line as (select rid, host, body, unnest(string_split(body, chr(10))) as line from d),
  held as (select rid, host, body, line, lower(array_to_string({_WORDS.format("line")}, ' ')) as even, len({_WORDS.format("line")}) as n from line where len({_WORDS.format("line")}) > 0),
  dups as (select rid, count(*) - count(distinct line) as n_dup_lines from held group by 1),
  texts as (select host, count(distinct body) as of from d group by 1),
  common as (select host, even from held join texts using (host) group by 1, 2, of having count(distinct body) > 10 and 100 * count(distinct body) > 5 * of),
  gone as (select rid, sum(n) as n_removed_words from held semi join common using (host, even) group by 1),
  counted as (select rid, doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    (length(body) - length(translate(body, '#*$%&|<>', '')))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    coalesce(n_removed_words, 0)::bigint as n_removed_words from d left join repeats using (rid) left join dups using (rid) left join gone using (rid)),
  judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, 100 * n_removed_words > 50 * n_words as depleted from counted)
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, depleted, not base_failed and not depleted as kept from judged"""

_OP1_SQL = rf"""with recursive d as (select row_number() over () as rid, doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
  sets as (select rid, doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as sh from d),
  each as (select rid, doc_id, len(sh) as n, hash(x) as x from (select rid, doc_id, sh, unnest(sh) as x from sets)),
  near as (select a.doc_id as a, b.doc_id as b from each a join each b on a.x = b.x and a.rid <> b.rid group by a.rid, b.rid, a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  links as (select distinct a, b from near),
  reach(id, node) as (select distinct doc_id, doc_id from sets union select r.id, l.b from reach r join links l on r.node = l.a),
  least as (select id, min(node) as component_id from reach group by 1)
  select doc_id, len(sh)::bigint as n_shingles, component_id, doc_id = component_id as kept from sets join least on id = doc_id"""


def _escaped_sql(text: str) -> str:
    from .chat import CONTROL

    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_OP9_SQL = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
  s as (select *, '<|turn|>' || replace({_escaped_sql("role")}, chr(10), '\\' || chr(10)) || chr(10) || {_escaped_sql("text")} || '<|end|>' || chr(10) as segment from t)
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, segment)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, segment) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(length(segment))::bigint as formatted_chars, 0::bigint as attachment_tokens from s group by conv_id"""

_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

_OP11_SQL = f"""with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as w from embeddings where {_FINITE}),
  scored as (select q.rid, q.vec_id as query_id, c.vec_id, list_inner_product(q.w, c.w)::bigint as score from v q join v c on q.rid <> c.rid where q.vec_id % 20 = 0),
  ranked as (select *, row_number() over (partition by rid order by score desc, vec_id) as rank from scored)
  select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20"""


def _op12_sql(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """The rounds one after the other; part p of a vector w is w[p * len / 8 + 1 : (p + 1) * len / 8]."""
    ctes = [
        f"v as (select row_number() over (order by vec_id) as rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as w from embeddings where {_FINITE})",
        f"cut as (select rid, p, w[p * len(w) // {parts} + 1:(p + 1) * len(w) // {parts}] as x from v, range({parts}) as r(p))",
        f"book0 as (select p, rid - 1 as e, x as y from cut where rid <= {entries})",
    ]
    for k in range(rounds + 1):
        ctes.append(
            f"""near{k} as (select rid, p, x, arg_min(e, d * {entries} + e) as e, min(d) as d from (select rid, cut.p as p, x, e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
            from cut join book{k} b on cut.p = b.p) group by rid, p, x)"""
        )
        if k < rounds:
            ctes.append(
                f"""mean{k} as (select p, e, list(m order by i) as y from (select p, e, i, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) as m
                from (select p, e, unnest(x) as c, unnest(range(len(x))) as i from near{k}) group by p, e, i) group by p, e)"""
            )
            ctes.append(f"book{k + 1} as (select b.p, b.e, coalesce(list_transform(m.y, lambda c: c::bigint), b.y) as y from book{k} b left join mean{k} m on b.p = m.p and b.e = m.e)")
    ctes.append(f"sha as (select sha256(string_agg(array_to_string(y, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds})")
    ctes.append(f"coded as (select rid, string_agg(lpad(lower(hex(e)), 2, '0'), '' order by p) as code, sum(d)::bigint as error from (select rid, p, e::utinyint as e, d from near{rounds}) group by rid)")
    return "with " + ",\n  ".join(ctes) + "\n  select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from coded join v using (rid), sha"


_OP13_SQL = r"""with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents),
  t as (select rid, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
  vocab as (select lang, term, count(*) as total from t group by 1, 2 having count(distinct rid) >= 10),
  groups as (select distinct lang, source from d),
  langs as (select lang, count(*) as v, sum(total) as n_lang from vocab group by 1),
  used as (select lang, source, term, count(*) as n from t semi join vocab using (lang, term) group by all),
  sizes as (select g.lang, g.source, coalesce(s.n, 0) as n_source, coalesce(v, 0) as v, coalesce(n_lang, 0) as n_lang from groups g left join (select lang, source, sum(n) as n from used group by 1, 2) s using (lang, source) left join langs using (lang)),
  dense as (select s.lang, s.source, term, coalesce(u.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(u.n, 0) + 2)) // (n_source + 2 * v) as p, 1 + (1000000000::hugeint * (total + 2)) // (n_lang + 2 * v) as q
    from sizes s join vocab using (lang) left join used u using (lang, source, term)),
  far as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
  pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source),
  special as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from dense where n > 0 and p > q),
  ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pair union all select * from special))
  select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10"""

ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": _OP1_SQL, "op6_quality_rules": _OP6_SQL, "op9_chat_format": _OP9_SQL, "op11_top_k": _OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_source_divergence": _OP13_SQL,
}
