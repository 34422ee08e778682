"""DuckDB SQL of the registered queries, built from the same parameters and fixed tables."""

from __future__ import annotations

from cohortkit.llm import license_scan as lic
from cohortkit.llm import line_dedup as ld
from cohortkit.llm import packing as pk
from cohortkit.llm import quality_rules as qr


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
on_page AS (SELECT source, unnest(list_distinct(list_transform(ls, lambda x: trim(x)))) AS l FROM d),
per_line AS (SELECT source, l, count(*) AS n FROM on_page WHERE l <> '' GROUP BY ALL),
total AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
found AS (
  SELECT p.source, list(p.l) AS bad
  FROM per_line p JOIN total t ON p.source IS NOT DISTINCT FROM t.source
  WHERE p.n >= {ld.MIN_PAGES} AND p.n > CAST({ld.RATIO} AS DOUBLE) * t.pages GROUP BY p.source),
cut AS (
  SELECT d.doc_id, d.text, d.ls,
         list_filter(d.ls, lambda x: trim(x) = '' OR NOT list_contains(coalesce(f.bad, []), trim(x))) AS kept
  FROM d LEFT JOIN found f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END AS text
FROM cut
"""

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_MARKS = "[" + "".join("\\" + chr(c) for c in qr.MARKS) + "]"
_CLOSING = "(" + "|".join(("\\" + x) if x in '.!?";:)' else x for x in qr.CLOSING) + ")$"
_SEPS = " + ".join(f"(len(string_split(line, {_text(x.decode())})) - 1)" for x in qr.SEPARATORS)
_LINKS = ", ".join(_text(x.decode()) for x in sorted(qr.LINK_WORDS))
_BOILER = " OR ".join(f"contains(lower(line), {_text(x)})" for x in qr.BOILERPLATE)
QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(
    range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])) AS g
  FROM w WHERE len(ws) >= 3),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
ln AS (
  SELECT doc_id, line, len(regexp_replace(line, '{_SPACE}', '', 'g')) AS chars,
         regexp_extract_all(line, '{_WORD}') AS lw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
judged AS (
  SELECT doc_id, line, chars,
    (len(lw) < {qr.SHORT_LINE_WORDS} AND NOT regexp_matches(regexp_replace(line, '{_SPACE}+$', ''), {_text(_CLOSING)}))
    OR (chars - len(regexp_replace(regexp_replace(line, '{_SPACE}', '', 'g'), {_text(_MARKS)}, '', 'g'))) * 100
       > {qr.MAX_MARK_PERCENT} * chars
    OR ({_SEPS}) >= 2
    OR (len(lw) <= 4 AND len(list_filter(lw, lambda x: trim(lower(x), '.,:;!?') NOT IN ({_LINKS}))) = 0)
    OR {_BOILER} AS failed
  FROM ln WHERE chars > 0),
per_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dups, sum(CASE WHEN failed THEN chars ELSE 0 END) AS lost
  FROM judged GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(ws) AS n_words, len(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars,
         len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(p.dups, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(p.lost, 0) AS lost_chars
  FROM w LEFT JOIN per_doc p ON w.doc_id = p.doc_id LEFT JOIN repeated r ON w.doc_id = r.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(lost_chars AS BIGINT) AS lost_chars,
       n_words < {qr.MIN_WORDS} OR 100 * n_repeat_words > {qr.MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {qr.MIN_WORDS} OR 100 * n_repeat_words > {qr.MAX_REPEAT_PERCENT} * n_words)
         AND 100 * lost_chars <= {qr.MAX_LOSS_PERCENT} * word_chars AS kept
FROM f
"""

EXACT_TOPK = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.vec) = len(c.vec)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def _license_scan() -> str:
    known = " ".join(f"WHEN {_text(s)} THEN {_text(i)}" for s, i in lic.SENTENCES.items())
    marked = "' ' || array_to_string(ids, '  ') || ' '"
    for licence, wanted in lic.RULES:
        marked = f"replace({marked}, {_text(' ' + '  '.join(wanted) + ' ')}, {_text(f' ={licence} ')})"
    return f"""
WITH s AS (
  SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), {_text(lic.SENTENCE_END)}),
    lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS norm
  FROM documents),
k AS (
  SELECT doc_id, list_filter(list_transform(norm, lambda x: CASE x {known} END), lambda x: x IS NOT NULL) AS ids
  FROM s),
m AS (
  SELECT doc_id, ids, list_transform(list_filter(regexp_split_to_array(trim({marked}), ' +'),
    lambda x: starts_with(x, '=')), lambda x: substr(x, 2)) AS found
  FROM k),
-- distinct in order of the first match
o AS (
  SELECT doc_id, ids, list_filter(found, lambda x, i: list_position(found, x) = i) AS lics FROM m)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS license_sentences,
       coalesce(array_to_string(lics, ','), '') AS licenses
FROM o
"""


LICENSE_SCAN = _license_scan()


def _length_buckets() -> str:
    steps = []
    for k in range(2, pk.N_BUCKETS + 1):
        steps.append(f"""p{k} AS MATERIALIZED (
  SELECT c.i, min(coalesce(p.best, 0) + c.pad) AS best,
         arg_min(list_append(coalesce(p.path, []), c.l),
                 CAST(coalesce(p.best, 0) + c.pad AS HUGEINT) * 100000 + c.j) AS path
  FROM cost c LEFT JOIN p{k - 1} p ON p.i = c.j GROUP BY c.i)""")
    chain = ",\n".join(steps)
    return f"""
WITH t AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{pk.WORD}')) AS n FROM documents),
q AS (
  SELECT doc_id, chunk, least({pk.CONTEXT}, n - chunk * {pk.CONTEXT}) AS length
  FROM (SELECT doc_id, n, unnest(range(0, CAST(ceil(n / {pk.CONTEXT}.0) AS BIGINT))) AS chunk FROM t WHERE n > 0)),
h AS (
  SELECT l, row_number() OVER (ORDER BY l) AS i, sum(n) OVER (ORDER BY l) AS rows_to, sum(n * l) OVER (ORDER BY l) AS tokens_to
  FROM (SELECT length AS l, count(*) AS n FROM q GROUP BY length)),
lower AS (SELECT 0 AS j, 0 AS rows_to, 0 AS tokens_to UNION ALL SELECT i, rows_to, tokens_to FROM h),
cost AS MATERIALIZED (
  SELECT b.j, h.i, h.l, CAST((h.rows_to - b.rows_to) * h.l - (h.tokens_to - b.tokens_to) AS BIGINT) AS pad
  FROM lower b JOIN h ON h.i > b.j),
p1 AS MATERIALIZED (SELECT i, pad AS best, [l] AS path FROM cost WHERE j = 0),
{chain},
bounds AS (SELECT unnest(path) AS bound FROM p{pk.N_BUCKETS} WHERE i = (SELECT max(i) FROM h)),
b AS (SELECT q.doc_id, q.chunk, q.length, (SELECT min(bound) FROM bounds WHERE bound >= q.length) AS bucket FROM q),
r AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY
    md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', CAST(chunk AS VARCHAR))), doc_id, chunk, length) - 1 AS pos
  FROM b)
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(length AS BIGINT) AS length, CAST(bucket AS BIGINT) AS bucket,
       CAST(pos // ({pk.TOKEN_BUDGET} // bucket) AS BIGINT) AS batch,
       CAST(pos % ({pk.TOKEN_BUDGET} // bucket) AS BIGINT) AS slot, CAST(bucket - length AS BIGINT) AS padding
FROM r
"""


LENGTH_BUCKETS = _length_buckets()


def _jaccard_classes(words: int, num: int, den: int) -> str:
    window = " || ' ' || ".join(f"ws[k + {i}]" if i else "ws[k]" for i in range(words))
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {words - 2}), lambda k: {window})) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE {den} * o >= {num} * (p.n + q.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       coalesce((SELECT min(other) FROM r WHERE r.doc_id = d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""


JACCARD_CLASSES = _jaccard_classes(3, 90, 100)

# UTF-8 characters in hex digits; bytes that a removal left of a character match none of them
_NEXT = "[89AB]."
_CHARACTER = (f"[0-7].|(?:C[2-9A-F]|D.){_NEXT}|E0[AB].{_NEXT}|ED[89].{_NEXT}|E[1-9A-CEF]{_NEXT}{_NEXT}|F0[9AB].{_NEXT}{_NEXT}"
              f"|F[1-3]{_NEXT}{_NEXT}{_NEXT}|F48.{_NEXT}{_NEXT}")

# every byte is two hex digits, so byte strings are text of twice the length
SUFFIX_DEDUP = f"""
WITH d AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT doc_id, unnest(range(0, CAST(len(x) // 2 - 399 AS BIGINT))) AS p, x FROM d WHERE len(x) >= 800),
h AS (SELECT doc_id, p, md5(substr(x, CAST(2 * p + 1 AS BIGINT), 800)) AS g FROM k),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY g) AS n FROM h) WHERE n > 1),
step AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM step),
span AS (SELECT doc_id, r, min(p) AS a, max(p) + 400 AS b FROM run GROUP BY ALL),
part AS (
  SELECT s.doc_id, s.a, s.b, coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0) AS since FROM span s),
kept AS (
  SELECT p.doc_id, count(*) AS n, sum(p.b - p.a) AS gone, max(p.b) AS last,
         string_agg(substr(d.x, CAST(2 * p.since + 1 AS BIGINT), CAST(2 * (p.a - p.since) AS BIGINT)), '' ORDER BY p.a) AS head
  FROM part p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id),
left_over AS (
  SELECT d.doc_id, d.text, d.x, k.gone, k.n,
         CASE WHEN k.n IS NULL THEN d.x ELSE k.head || substr(d.x, CAST(2 * k.last + 1 AS BIGINT)) END AS y
  FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(y)) AS kept_sha256,
       CASE WHEN n IS NULL THEN text ELSE decode(unhex(array_to_string(list_filter(
         regexp_extract_all(y, '{_CHARACTER}|..'), lambda c: len(c) > 2 OR c < '8'), ''))) END AS text
FROM left_over
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(range(1, len({text}) + 1), lambda i: list_transform(range(0, 8), lambda j: (ascii({text}[i]) >> j) & 1)))"
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform({bits}, lambda b: CAST(b AS BIGINT))), "
            "lambda c, b: xor(c >> 1, CAST(3988292384 AS BIGINT) * (xor(c, b) & 1))), CAST(4294967295 AS BIGINT))")


CONVERSATION_TRIE = f"""
WITH t AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS b,
         md5(concat(CAST(strlen(coalesce(role, '')) AS VARCHAR), ':', coalesce(role, ''), coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, k, b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS pos FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS head, {_crc32("s")} % 9 AS h
  FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t)),
r AS (
  SELECT c.conv_id, pos, k, b FROM c JOIN p ON p.conv_id = c.head AND pos < h
  UNION ALL SELECT c.conv_id, pos, k, b FROM c JOIN p ON p.conv_id = c.conv_id AND pos >= h),
q AS (
  SELECT conv_id, b, row_number() OVER w AS d, string_agg(k, '') OVER w AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT conv_id, d, b, path FROM q UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, max(b) AS b FROM a GROUP BY path, d),
kids AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(kids.n, 0) AS kids FROM n LEFT JOIN kids ON kids.path = n.path),
up AS (SELECT (n - 1) * b AS saved, kids, path, unnest(range(0, d + 1)) AS depth FROM f),
below AS (
  SELECT left(path, 32 * depth) AS path, sum(saved) AS saved, count(*) FILTER (WHERE kids = 0) AS leaves FROM up GROUP BY 1),
ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(path, d) AS path FROM a GROUP BY conv_id) GROUP BY path)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs, CAST(f.kids AS BIGINT) AS n_children,
       CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM f JOIN below ON below.path = f.path LEFT JOIN ends ON ends.path = f.path
LEFT JOIN n AS up ON f.d > 0 AND up.d = f.d - 1 AND up.path = left(f.path, 32 * (f.d - 1))
"""
