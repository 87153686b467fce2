"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import (
    bpe, decision_list, decontaminate, hard_negatives, langid, order_minhash, pii, quality_fm, secret_index, substring_dedup, url_trie, warc, whitening,
)
from tideline.llm.common import cut, held_out, learnable, spans_digest, spans_text, staging_path, table, text_of
from tideline.session import configure

#: (verdict, host, path)
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document: the smallest doc_id among its near-duplicates."""
    return order_minhash.class_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data, plain and disguised, in every document."""
    found = table(spark, sf_dir, "documents").select("doc_id", pii.spans(F.col("text")).alias("found"))
    found = found.select("doc_id", "found", F.filter("found", lambda s: s["base"]).alias("plain"))
    return found.select(
        "doc_id", *[_count(F.col("plain"), k) for k in pii.KINDS], spans_digest(F.col("plain")).alias("base_sha256"), spans_text(F.col("found")).alias("spans")
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by rules that a trigram index picks the texts for."""
    found = secret_index.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "found")
    found = found.select("doc_id", "found", F.filter("found", lambda s: s["base"]).alias("plain"))
    kinds = [r.kind for r in secret_index.RULES if r.base]
    return found.select(
        "doc_id", *[_count(F.col("plain"), k) for k in kinds], spans_digest(F.col("plain")).alias("base_sha256"), spans_text(F.col("found")).alias("spans")
    )


def _op3_sql() -> str:
    def matches(order: int, rule: secret_index.Rule) -> str:
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        holds = f"length(regexp_extract(m, {pattern}, 2)) >= 6" if rule.kind == "assign" else "true"
        return f"""
  select doc_id, '{rule.kind}' as kind, {order} as ord, {str(rule.base).lower()} as base, start, start + length(m) as stop
  from (select doc_id, ms[i] as m, cast(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as bigint) as start
        from (select doc_id, regexp_extract_all(t, {pattern}, 0) as ms, string_split_regex(t, {pattern}) as gaps,
                unnest(range(1, len(regexp_extract_all(t, {pattern}, 0)) + 1)) as i from d))
  where {holds}"""

    spans = "\n  union all".join(matches(i, r) for i, r in enumerate(secret_index.RULES))
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents), spans as ({spans}),
summed as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) filter (base) as plain,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) as spans
  from spans group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(plain, '')) as base_sha256, coalesce(spans, '') as spans
from d left join summed using (doc_id)
"""


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learnt from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    samples = langid.fit(docs.where(learnable()))
    found = docs.select("doc_id", held_out().alias("held_out"), langid.predict(spark, F.col("text"), samples).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.confident").alias("confident"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back; length and digest are those of the bytes read."""
    path = staging_path(spark, "warc")
    warc.write(warc.page_records(table(spark, sf_dir, "pages")), path)
    back = warc.measured(spark, path)
    return back.select(
        warc.page_number(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type",
        warc.page_number(F.col("refers_to")).alias("refers_to"),
    )


OP5_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
coded as (
  select page_id, payload_bytes, hex,
    list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, cast(5 * g + 1 as bigint), 5))::int >> cast(15 - 5 * k as int)) & 31), 1)),
      'string_agg', '')), 'string_agg', '') as payload_digest,
    min(page_id) over (partition by hex) as first_id
  from p)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from coded
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that occurs in a document, with its place there. Documents without any have no row."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = docs.select("doc_id", decontaminate.hits(F.col("text"), benchmark).alias("hits"))
    return found.select("doc_id", F.inline("hits"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and the verdict for every page's url."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", url_trie.judge(spark, F.col("url"), URL_RULES).alias("v")).select("page_id", "v.*")


OP7_SQL = """
with parts as (
  select page_id,
    case when position('://' in url) > 0 then translate(regexp_extract(url, '://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when position('://' in url) > 0 then regexp_extract(url, '://[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
rules(verdict, rule_host, rule_path) as (
  values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits as (
  select p.page_id, p.host, p.path, max_by(struct_pack(rule := rule_host || rule_path, verdict := verdict), length(rule_host || rule_path)) as best
  from parts p left join rules on (p.host = rule_host or ends_with(p.host, '.' || rule_host)) and starts_with(p.path, rule_path)
  group by p.page_id, p.host, p.path)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from fits
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the fixed limits on them, and the verdict of the learnt list."""
    stats = cut(decision_list.statistics(table(spark, sf_dir, "documents")))
    rules = decision_list.fit(stats, table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~decision_list.rejects(rules)).alias("kept"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    ids = table(spark, sf_dir, "documents").select("doc_id", bpe.encode(F.col("text"), path, pattern).alias("ids"))
    both = ids.select("doc_id", "ids", bpe.decode(F.col("ids"), path, pattern).alias("bytes"))
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; labels are learnt only from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_fm.score(spark, F.col("text"), model).alias("score"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh are moved on first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.prepared(table(spark, sf_dir, "embeddings"), label=label)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda c: floor(256 * c::double)) as x
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.x, b.x) as bigint) as score
  from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id,
  cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as int) as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
  and 100 * s.score between 30 * p.positive_score and 90 * p.positive_score
qualify rank <= 10
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages that a document of smaller id has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = cut(substring_dedup.spans(docs))
    some = substring_dedup.kept_texts(docs, found).select("doc_id", "seq", F.sha2(F.col("kept"), 256).alias("digest"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    whole = F.when(removed == 0, F.lower(F.hex("seq"))).otherwise(F.sha2(F.lit(""), 256))
    return found.join(some, ["doc_id", "seq"], "left").select("doc_id", "n_words", removed.alias("n_removed"), F.coalesce("digest", whole).alias("kept_sha256"))


OP12_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select r, doc_id, w, unnest(range(1, len(w) - 48)) as s from d),
windows as (select r, doc_id, s, sha256(array_to_string(w[s : s + 49], ' ')) as h from starts),
again as (select r, s from (select r, s, doc_id, min(doc_id) over (partition by h) as least from windows) where least < doc_id),
gone as (select r, list(distinct i) as places from (select r, unnest(range(s, s + 50)) as i from again) group by r),
words as (select r, i, w[i] as word from (select r, w, unnest(range(1, len(w) + 1)) as i from d)),
left_ as (
  select x.r, string_agg(x.word, ' ' order by x.i) as kept, count(*) as n
  from words x left join (select r, unnest(places) as i from gone) g on g.r = x.r and g.i = x.i where g.i is null group by x.r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(l.n, 0) as bigint) as n_removed,
  sha256(coalesce(l.kept, '')) as kept_sha256
from d left join left_ l using (r)
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four whitened components of the distinct ones."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whitening.levels("embedding").alias("x")).where("x is not null")
    rows = cut(rows)
    rows = rows.where(F.size("x") == F.lit(whitening.common_length(rows)))
    model = whitening.fit(rows)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], out)
    error, shares = whitening.identity_error(rows, model), F.array(*[F.lit(e).cast("double") for e in model.explained()])
    each = rows.select("vec_id", whitening.project(F.col("x"), model).alias("p")).select("vec_id", "p.deviation", F.posexplode("p.whitened").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation as long)").alias("deviation"),
        "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_pii, op3_secrets, op4_language, op5_warc, op6_decontamination, op7_url_filter, op8_quality_rules, op9_bpe, op10_quality,
        op11_hard_negatives, op12_substring_dedup, op13_whitening,
    )
}
SQL = {"op3_secrets": _op3_sql(), "op5_warc": OP5_SQL, "op7_url_filter": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op12_substring_dedup": OP12_SQL}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(configure(spark), sf_dir)) for name, f in QUERIES.items()}
