"""SQL for those queries of this subpackage that SQL can express, from their contracts; doc_id is taken as unique."""

from __future__ import annotations

import math

#: Logarithm of the ratio of neighbouring buckets of a sketch with an error of a hundredth.
_STEP = math.log(1.01 / 0.99)
_MIDDLE = 2 / (1 + math.exp(_STEP))

_EXACT = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r"""


#: Texts at equal steps of a sorted list of buckets, 50 of them.
_STEPS = "list_transform(range(1, 51), lambda k: {0}[(k * len({0}) + 49) // 50])"


_QUALITY = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS k, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS words FROM w),
again AS (SELECT doc_id, k FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, words) > 1),
repeated AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM again, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN repeated USING (doc_id)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
ratios AS (SELECT doc_id, lang, source, base_failed, unnest(['symbols', 'dup', 'repeats', 'chars']) AS ratio, unnest([CAST(0.025 AS DOUBLE), 0.05, 0.025, 1]) AS spread,
  unnest([n_symbols / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1), word_chars / greatest(n_words, 1)]) AS v FROM base),
sketch AS (SELECT lang, source, ratio, spread, CASE WHEN v > 0 THEN exp(ceil(ln(v) / CAST({_STEP!r} AS DOUBLE)) * CAST({_STEP!r} AS DOUBLE)) * CAST({_MIDDLE!r} AS DOUBLE) ELSE 0 END AS b FROM ratios WHERE NOT base_failed),
every AS (SELECT ratio, list(b ORDER BY b) AS bs FROM sketch GROUP BY ratio),
tongues AS (SELECT lang, ratio, list(b ORDER BY b) AS bs FROM sketch GROUP BY lang, ratio),
tongue AS (SELECT lang, ratio, list_sort(t.bs || {_STEPS.format("e.bs")}) AS bs FROM tongues t JOIN every e USING (ratio)),
owns AS (SELECT lang, source, ratio, any_value(spread) AS spread, list(b ORDER BY b) AS bs FROM sketch GROUP BY lang, source, ratio),
own AS (SELECT o.lang, source, o.ratio, spread, list_sort(o.bs || {_STEPS.format("t.bs")}) AS bs FROM owns o JOIN tongue t ON t.ratio = o.ratio AND t.lang IS NOT DISTINCT FROM o.lang),
quantiles AS (SELECT *, bs[CAST(ceil(len(bs) * CAST(0.75 AS DOUBLE)) AS BIGINT)] AS upper, bs[CAST(ceil(len(bs) * CAST(0.5 AS DOUBLE)) AS BIGINT)] AS middle FROM own),
beyond AS (SELECT DISTINCT doc_id FROM ratios r JOIN quantiles q ON q.ratio = r.ratio AND q.lang IS NOT DISTINCT FROM r.lang AND q.source IS NOT DISTINCT FROM r.source
  WHERE v > upper + CAST(8 AS DOUBLE) * greatest(upper - middle, q.spread))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM beyond) AS kept FROM base"""

#: crc32 of a decimal, bit by bit, as unsigned number.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

_TRIE = f"""
WITH t AS (SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS b, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, b, m, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) AS at FROM t),
f AS (SELECT c, c - c % 5 AS p, {_CRC.format("c")} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
l AS (SELECT f.*, (SELECT count(*) FROM n WHERE n.c = f.p AND n.at <= f.h) AS given FROM f),
r AS (SELECT l.c, n.at AS d, b, m FROM l JOIN n ON n.c = l.p AND n.at <= h UNION ALL SELECT l.c, n.at - h + given, b, m FROM l JOIN n ON n.c = l.c AND n.at > h),
s AS (SELECT c, d, b, string_agg(m, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM r UNION ALL SELECT c, 0, 0, '' FROM f),
nodes AS (SELECT k, CAST(d AS BIGINT) AS d, any_value(b) AS b, min(c) AS conv_id, count(*) AS n FROM s GROUP BY k, d),
kids AS (SELECT left(k, 32 * (d - 1)) AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
ends AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS h FROM (SELECT c, max_by(k, d) AS k FROM s GROUP BY c) GROUP BY k),
up AS (SELECT left(x.k, 32 * e) AS k, count(*) FILTER (kids.k IS NULL) AS n_leaves, sum((x.n - 1) * b) AS saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM nodes) x LEFT JOIN kids ON kids.k = x.k GROUP BY 1)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(h, sha256('')) AS ends_sha256
FROM nodes x JOIN up ON up.k = x.k LEFT JOIN nodes y ON x.d > 0 AND y.k = left(x.k, 32 * (x.d - 1)) LEFT JOIN kids ON kids.k = x.k LEFT JOIN ends ON ends.k = x.k"""

ORACLE_SQL = {"op11_conversation_trie": _TRIE, "op6_exact_dedup": _EXACT, "op9_quality": _QUALITY}
