"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

import re

from quillspark.llm import licenses, quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH s AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s GROUP BY 1
), w AS (
  SELECT *, (CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM src
), o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM w
), level AS (
  SELECT arg_min((total - filled) / rest, cap / w) AS level FROM o WHERE (total - filled) / rest * w <= cap
), t AS (
  SELECT source, source_size, CASE WHEN level * w > cap THEN cap ELSE level * w END AS target FROM w, level
), q AS (
  SELECT *, round(target)::BIGINT // nullif(source_size, 0) AS whole, round(target)::BIGINT % nullif(source_size, 0) AS rest FROM t
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY source, u) AS cell FROM s
)
SELECT doc_id, size, source_size, target, (size * (coalesce(whole, 0) + coalesce((rest > 0 AND 2 * (upto - cell) + cell < 2 * rest)::INT, 0)))::BIGINT AS taken, c.source
FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source
"""

_BIT = " + ".join(f"(CASE WHEN {sql} THEN {1 << i} ELSE 0 END)" for i, (_, sql) in enumerate(quality.RULES))
_BASE, _REJECT = quality.mask(quality.BASE), quality.mask(quality.POLICIES[quality.CURRENT].reject)

OP3 = rf"""
WITH r AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, {_WORDS} AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM r
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), again AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, len(list_filter(ws, lambda x: x = '|')) AS n_bars
  FROM w LEFT JOIN covered USING (rid)
), f AS (SELECT *, ({_BIT})::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & {_BASE}) <> 0 AS base_failed, (failures & {_REJECT}) = 0 AND (failures & {_BASE}) = 0 AS kept, failures FROM f
"""


def _words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


_K = licenses.GRAM_WORDS
_TEMPLATES = ", ".join(f"({i}, '{label}', {_words(text)!r})" for i, (label, text) in enumerate(licenses.TEMPLATES))
_PHRASES = ", ".join(f"({p.split()!r}, '{label}')" for p, label in licenses.PHRASES.items())
_GRAM = " || ' ' || ".join(f"ws[i + {j}]" for j in range(_K))

OP9 = rf"""
WITH t(template, label, tw) AS (VALUES {_TEMPLATES}), ph(pw, label) AS (VALUES {_PHRASES}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), p AS (
  SELECT rid, i, ws FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)
), base AS (
  SELECT rid, i - 1 AS pos, ph.label FROM p JOIN ph ON ws[i] = pw[1] AND ws[i:i + len(pw) - 1] = pw
), b AS (
  SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY 1
), tg AS (
  SELECT template, label, len(ws) - {_K - 1} AS n, i, {_GRAM} AS gram FROM (SELECT template, label, tw AS ws, unnest(range(1, len(tw) - {_K - 2})) AS i FROM t)
), dg AS (
  SELECT rid, i, {_GRAM} AS gram FROM p WHERE i <= len(ws) - {_K - 1}
), v AS (
  SELECT rid, template, label, any_value(n) AS n, dg.i - tg.i AS diagonal, list(DISTINCT tg.i) AS ats FROM dg JOIN tg USING (gram) GROUP BY rid, template, label, dg.i - tg.i
), f AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER o > {licenses.DIAGONAL_GAP}, true)::INT AS fresh FROM v WINDOW o AS (PARTITION BY rid, template ORDER BY diagonal)
), s AS (
  SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM f
), c AS (
  SELECT rid, label, len(list_distinct(flatten(list(ats))))::DOUBLE / any_value(n) AS coverage FROM s GROUP BY rid, template, label, span
), m AS (
  SELECT rid, list(DISTINCT label) AS labels, max(coverage) AS best FROM c WHERE coverage >= {licenses.COVERAGE} GROUP BY 1
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE least(1.0, coalesce(best, 0.0)) END::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN m USING (rid)
"""

OP11 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), total AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY 1
), g AS (
  SELECT lang, ws[i:i + k - 1] AS path, count(*) AS f FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p), (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(ws) GROUP BY 1, 2 HAVING count(*) >= 100
), c AS (
  SELECT * FROM g WHERE len(path) > 1
), cut AS (
  SELECT c.lang, c.path, c.f AS a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM c, (SELECT unnest(range(1, 5)) AS k) JOIN total ON total.lang = c.lang JOIN g x ON x.lang = c.lang AND x.path = c.path[:k] JOIN g y ON y.lang = c.lang AND y.path = c.path[k + 1:] WHERE k < len(c.path)
), low AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, path ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, f, path[i:j] AS path FROM c, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 6)) AS j) WHERE i < j AND j <= len(path) AND j - i + 1 < len(path)
), kept AS (
  SELECT lang, array_to_string(path, ' ') AS phrase, a, l, r, n, score FROM low WHERE NOT EXISTS (FROM inner_ WHERE inner_.lang = low.lang AND inner_.path = low.path AND 100 * inner_.f >= 100 * low.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

OP13 = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid AS q, q.vec_id AS query_id, e.rid, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score FROM e q JOIN e ON q.rid <> e.rid WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, rid)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, rid) <= 10
"""

ORACLE_SQL = {"op11_collocations": OP11, "op13_exact_search": OP13, "op1_mix_sources": OP1, "op3_quality_rules": OP3, "op9_license_scan": OP9}
