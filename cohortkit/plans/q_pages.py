"""Page sample and dataset-preparation queries over the pages table (S4, S7–S9, G5–G7, P2, J3,
X1–X3, C2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.operators import pages as PG
from cohortkit.operators import textprep as TP
from cohortkit.plans.q_generate import md5_sql, slot_sql
from cohortkit.plans.registry import register
from cohortkit.plans.sqlviews import view, with_views
from cohortkit.session import checkpoint_dir
from cohortkit.sources import datasets as DS
from cohortkit.sources import tuple_files as TF
from cohortkit.sources.fixtures import page_responses_fx
from cohortkit.sources.tables import load

TYPES_SQL = "[" + ", ".join(f"'{t}'" for t in K.PAGE_TYPES) + "]"
TITLE_SQL = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
PAGE_TYPE_SQL = f"{TYPES_SQL}[1 + {slot_sql(md5_sql('page_id', chr(39) + 'page_type' + chr(39)), 0)} % 4]"

view("page_outcome", f"""
SELECT page_id AS sample_id, {PAGE_TYPE_SQL} AS page_type,
       CASE WHEN page_id % 7 = 0 THEN 'incomplete' WHEN bad THEN 'generation_failed' END AS reason,
       CASE WHEN bad THEN NULL ELSE html END AS html,
       CASE WHEN bad OR page_id % 7 = 0 THEN NULL ELSE {TITLE_SQL} END AS summary
FROM (SELECT *, page_id % 7 IN (1, 2) OR (page_id % 7 >= 3 AND (page_id // 7) % 10 = 0) AS bad FROM pages) p
""")

view("page_samples_v", """
SELECT sample_id, html, page_type, summary,
       cast(list_position(""" + TYPES_SQL + """, page_type) - 1 AS INTEGER) AS label
FROM page_outcome WHERE reason IS NULL
""", ["page_outcome"])

view("combined_v", """
SELECT sample_id, html || chr(10) || chr(10) || 'Summary: ' || summary AS combined, label FROM page_samples_v
""", ["page_samples_v"])

view("tokens_v", """
SELECT sample_id, label, toks FROM (
  SELECT sample_id, label, list_filter(regexp_split_to_array(lower(combined), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS toks
  FROM combined_v) t
""", ["combined_v"])

VOCAB_SIZE = 30000
view("vocab_v", f"""
SELECT token, cnt, cast(row_number() OVER (ORDER BY cnt DESC, token ASC) + 3 AS INTEGER) AS token_id
FROM (SELECT token, count(*) AS cnt FROM (SELECT unnest(toks) AS token FROM tokens_v) u
      GROUP BY token ORDER BY cnt DESC, token ASC LIMIT {VOCAB_SIZE}) c
""", ["tokens_v"])


def _validated(spark, sf_dir):
    return PG.validate_page_responses(page_responses_fx(spark, sf_dir))


def _samples(spark, sf_dir):
    return PG.label_encode(PG.page_samples(_validated(spark, sf_dir))).drop("reason")


def _texts(spark, sf_dir):
    return TP.combined(TP.training_rows(_samples(spark, sf_dir)))


@register("html_prompt_build", f"""
SELECT page_id AS sample_id, {PAGE_TYPE_SQL} AS page_type,
       replace({"'" + K.PAGE_PROMPT.replace("'", "''") + "'"}, '<PAGE_TYPE>', {PAGE_TYPE_SQL}) AS prompt
FROM pages""")
def q_html_prompt_build(spark, sf_dir):
    pages = load(spark, sf_dir, "pages", "page_id")
    from cohortkit.sources.fixtures import page_type_draw
    return PG.page_prompts(pages.select(F.col("page_id").alias("sample_id"),
                                        page_type_draw(F.col("page_id")).alias("page_type")))


@register("html_sample_validate", with_views("SELECT * FROM page_outcome", "page_outcome"))
def q_html_sample_validate(spark, sf_dir):
    return _validated(spark, sf_dir)


@register("label_encode", with_views("""
SELECT sample_id, page_type, label, CASE WHEN label IS NULL THEN 'unknown_page_type' END AS reason
FROM page_samples_v""", "page_samples_v"))
def q_label_encode(spark, sf_dir):
    return PG.label_encode(PG.page_samples(_validated(spark, sf_dir))).select("sample_id", "page_type", "label", "reason")


@register("training_rows", with_views("SELECT sample_id, html AS text, summary, label FROM page_samples_v",
                                      "page_samples_v"))
def q_training_rows(spark, sf_dir):
    return TP.training_rows(_samples(spark, sf_dir))


@register("combine_text", with_views("SELECT * FROM combined_v", "combined_v"))
def q_combine_text(spark, sf_dir):
    return _texts(spark, sf_dir)


@register("tuple_unpack", with_views("SELECT sample_id, html, page_type, summary FROM page_samples_v",
                                     "page_samples_v"))
def q_tuple_unpack(spark, sf_dir):
    return TP.unpack_tuples(TP.sample_tuples(PG.page_samples(_validated(spark, sf_dir))))


@register("tuple_file_read", with_views("SELECT html, page_type, summary FROM page_samples_v", "page_samples_v"))
def q_tuple_file_read(spark, sf_dir):
    """The samples written as files of the original form and read back from them."""
    from cohortkit.session import scratch_path
    path = scratch_path(spark, "tuple-files")
    TF.write_tuple_files(PG.page_samples(_validated(spark, sf_dir)), path)
    return TF.read_tuple_files(spark, path).select("html", "page_type", "summary")


@register("json_roundtrip", with_views("SELECT sample_id, html, page_type, summary FROM page_samples_v",
                                       "page_samples_v"))
def q_json_roundtrip(spark, sf_dir):
    """Write the samples as a timestamped JSON Lines dataset and read it back."""
    from cohortkit.session import scratch_path
    base = scratch_path(spark, "datasets")
    path = DS.write_dataset(PG.page_samples(_validated(spark, sf_dir)), base, dt.datetime.now().strftime("%Y%m%d_%H%M%S"))
    return spark.read.schema("sample_id long, html string, page_type string, summary string").json(path)


@register("latest_dataset", with_views("SELECT sample_id, html, page_type, summary FROM page_samples_v",
                                       "page_samples_v"))
def q_latest_dataset(spark, sf_dir):
    """Two timestamped datasets; the newest is read back."""
    from cohortkit.session import scratch_path
    base = scratch_path(spark, "datasets")
    samples = PG.page_samples(_validated(spark, sf_dir))
    DS.write_dataset(samples.filter(F.col("page_type") == "informational"), base, "20250101_000000")
    DS.write_dataset(samples, base, "20250102_000000")
    return DS.latest_dataset(spark, base, "sample_id long, html string, page_type string, summary string")


@register("gen_pages", f"""
SELECT page_id AS sample_id, page_type,
       '<!DOCTYPE html><html><head><title>' || s || '</title></head><body>' ||
       CASE page_type
         WHEN 'informational' THEN '<h1>What is ' || s || '?</h1><p>' || s || ' is explained here.</p>'
         WHEN 'navigational' THEN '<nav><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li><li><a href="/contact">Contact</a></li></ul></nav><p>' || s || '</p>'
         WHEN 'commercial' THEN '<div class="product"><h2>' || s || '</h2><p class="price">Price: $19.99</p><button>Buy now</button></div>'
         ELSE '<form action="/submit" method="post"><label>' || s || '</label><input type="email" name="email"><button type="submit">Submit</button></form>'
       END || '</body></html>' AS html,
       upper(substr(page_type, 1, 1)) || substr(page_type, 2) || ' page about ' || s AS summary
FROM (SELECT page_id, {PAGE_TYPE_SQL} AS page_type, {TITLE_SQL} AS s FROM pages) t
""")
def q_gen_pages(spark, sf_dir):
    return PG.generate_pages(load(spark, sf_dir, "pages", "page_id", "html"))


def _contract_sql(html: str, t: str) -> str:
    conds = [f"CASE page_type"]
    for typ, pats in PG.CONTRACT.items():
        c = " AND ".join(f"regexp_matches({html}, '{p}')" for p in pats)
        conds.append(f"WHEN '{typ}' THEN ({c})")
    conds.append("ELSE false END")
    return " ".join(conds)


@register("page_contract_audit", with_views(f"""
SELECT page_type, count(*) AS n_pages, count(*) FILTER (WHERE {_contract_sql('html', 'page_type')}) AS n_pass,
       round(count(*) FILTER (WHERE {_contract_sql('html', 'page_type')}) / count(*), 6) AS pass_rate
FROM page_samples_v GROUP BY page_type""", "page_samples_v"))
def q_page_contract_audit(spark, sf_dir):
    return PG.contract_audit(PG.page_samples(_validated(spark, sf_dir)))


@register("vocab_topk", with_views("SELECT * FROM vocab_v", "vocab_v"))
def q_vocab_topk(spark, sf_dir):
    return TP.vocabulary(_texts(spark, sf_dir), VOCAB_SIZE)


@register("encode_tokens", with_views(f"""
SELECT t.sample_id, t.label,
       list_resize(list_concat([2], coalesce(e.ids, []), [3]), {K.MAX_TOKENS}, 0) AS input_ids,
       list_resize(list_transform(list_concat([2], coalesce(e.ids, []), [3]), lambda x: 1), {K.MAX_TOKENS}, 0)
         AS attention_mask
FROM tokens_v t LEFT JOIN (
  SELECT sample_id, list(coalesce(v.token_id, 1) ORDER BY pos) AS ids
  FROM (SELECT sample_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM tokens_v) p
  LEFT JOIN vocab_v v ON v.token = p.token
  WHERE pos < {K.MAX_TOKENS - 2} GROUP BY sample_id) e ON e.sample_id = t.sample_id
""", "tokens_v", "vocab_v"))
def q_encode_tokens(spark, sf_dir):
    tokens = TP.tokenize(_texts(spark, sf_dir))   # one tokenization for both jobs
    return TP.encode_tokens(tokens, TP.vocabulary_from_tokens(tokens, VOCAB_SIZE), K.MAX_TOKENS)


SPLIT_H = slot_sql(md5_sql("sample_id", "'split'"), 0)


@register("split_hash", with_views(f"""
SELECT sample_id, html AS text, summary, label, {SPLIT_H} < {0.2 * 4294967296.0!r} AS is_test FROM page_samples_v
""", "page_samples_v"))
def q_split_hash(spark, sf_dir):
    return TP.split_hash(TP.training_rows(_samples(spark, sf_dir)))


@register("split_exact", with_views(f"""
SELECT sample_id, text, summary, label,
       row_number() OVER (ORDER BY h, sample_id) <= (count(*) OVER () + 4) // 5 AS is_test
FROM (SELECT sample_id, html AS text, summary, label, {SPLIT_H} AS h FROM page_samples_v) t
""", "page_samples_v"))
def q_split_exact(spark, sf_dir):
    return TP.split_exact(TP.training_rows(_samples(spark, sf_dir)))
