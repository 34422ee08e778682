"""Sub-word queries over the page texts (X2, X7). The vocabulary is a public file, whose place is ``VOCABULARY``."""

from __future__ import annotations

import public_tokenizers

from cohortkit import constants as K
from cohortkit.operators import subword as SW
from cohortkit.plans.q_pages import _texts
from cohortkit.plans.registry import register
from cohortkit.plans.sqlviews import with_views

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_BYTES = "[" + ", ".join(map(_literal, SW.byte_characters())) + "]"
# one row per distinct word and its pieces; every round takes the longest piece of each rest
PIECES_SQL = f"""
voc AS (
  SELECT unnest(map_keys(v)) AS piece, unnest(map_values(v)) AS id
  FROM (SELECT CAST(json_extract(content, '$.model.vocab') AS MAP(VARCHAR, INTEGER)) AS v FROM read_text({_literal(VOCABULARY)})) f),
docs AS (SELECT sample_id, label, regexp_extract_all(lower(combined), '{SW.WORD}') AS words FROM combined_v),
spelled AS (
  SELECT word, array_to_string(list_transform(range(0, CAST(len(hex(encode(word))) // 2 AS BIGINT)),
    lambda k: {_BYTES}[1 + CAST('0x' || substr(hex(encode(word)), 2 * k + 1, 2) AS INTEGER)]), '') AS s
  FROM (SELECT DISTINCT unnest(words) AS word FROM docs) w),
cut AS (
  SELECT word, s AS rest, CAST([] AS INTEGER[]) AS ids FROM spelled
  UNION ALL
  SELECT word, substr(max(rest), CAST(max(n) + 1 AS BIGINT)) AS rest, list_append(any_value(ids), arg_max(id, n)) AS ids
  FROM (SELECT c.word, c.rest, c.ids, c.n, v.id
        FROM (SELECT word, rest, ids, unnest(range(1, len(rest) + 1)) AS n FROM cut WHERE rest <> '') c
        JOIN voc v ON v.piece = substr(c.rest, 1, c.n) || CASE WHEN c.n = len(c.rest) THEN '{SW.END_MARK}' ELSE '' END) x
  GROUP BY word),
cut_words AS (SELECT word, ids FROM cut WHERE rest = '')"""


def _with(body: str) -> str:
    """``body`` over the pieces and the page views."""
    return with_views(f"SELECT * FROM (WITH RECURSIVE {PIECES_SQL}\n{body}) pieces", "combined_v")


@register("subword_vocab", _with("""
SELECT v.id AS piece_id, v.piece, count(*) AS cnt
FROM (SELECT unnest(c.ids) AS id FROM (SELECT unnest(words) AS word FROM docs) d JOIN cut_words c ON c.word = d.word) p
JOIN voc v ON v.id = p.id GROUP BY v.id, v.piece"""))
def q_subword_vocab(spark, sf_dir):
    """How often each piece of the vocabulary stands in the page texts."""
    return SW.piece_counts(_texts(spark, sf_dir), SW.read_vocabulary(VOCABULARY))


@register("subword_encode", _with(f"""
SELECT d.sample_id, d.label, list_concat([n.first], b.ids, [n.first + 1], list_resize(CAST([] AS INTEGER[]), {K.MAX_TOKENS - 2} - len(b.ids), n.first + 2)) AS input_ids,
       list_concat(list_resize(CAST([] AS INTEGER[]), len(b.ids) + 2, 1), list_resize(CAST([] AS INTEGER[]), {K.MAX_TOKENS - 2} - len(b.ids), 0)) AS attention_mask
FROM docs d
JOIN (SELECT d.sample_id, coalesce(list_slice(flatten(list(c.ids ORDER BY p.pos) FILTER (WHERE c.ids IS NOT NULL)), 1, {K.MAX_TOKENS - 2}), []) AS ids
      FROM docs d LEFT JOIN (SELECT sample_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs) p ON p.sample_id = d.sample_id
      LEFT JOIN cut_words c ON c.word = p.word GROUP BY d.sample_id) b ON b.sample_id = d.sample_id
CROSS JOIN (SELECT max(id) + 1 AS first FROM voc) n"""))
def q_subword_encode(spark, sf_dir):
    """Ids and mask of the page texts, cut and padded to one length."""
    return SW.encode_subwords(_texts(spark, sf_dir), SW.read_vocabulary(VOCABULARY))
