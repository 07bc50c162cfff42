"""SQL for the registered queries, each written from what the query means and not from how it runs."""

_ENTITIES = """entities AS (SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id, l_orderkey AS block_id, l_returnflag AS kind, l_linestatus AS name,
  CAST(trunc(l_quantity) AS INT) AS line, [CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)] AS uses FROM lineitem)"""
_BLOCKS = "blocks AS (SELECT o_orderkey AS id, o_orderpriority AS command, o_orderstatus AS theory, CAST(trunc(o_totalprice) AS INT) AS line FROM orders)"
_BOTH = f"WITH {_BLOCKS}, {_ENTITIES}"
_SOURCE = r"""base AS (SELECT doc_id, regexp_extract_all(text, '(::|[(){}\[\].,:"]|[^\x00-\x7F]|[^(){}\[\].,:"\s\x{80}-\x{10FFFF}]+)', 1) AS ts FROM documents),
tokens AS (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS k FROM base),
forms AS (SELECT doc_id, k, list_distinct(list_transform(list_concat([t, strip_accents(replace(t, 'ß', 'ss'))], list_concat(regexp_extract_all(t, '(\p{L}+|\p{N}+)', 1), regexp_extract_all(strip_accents(replace(t, 'ß', 'ss')), '(\p{L}+|\p{N}+)', 1))), lambda x: lower(x))) AS f FROM tokens)"""
_SEGMENTS = r"""spans AS (SELECT conv_id AS theory, turn AS n, text, CASE WHEN role = 'user' OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS opens,
  1 + coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  1 + coalesce(sum(length(text) - length(replace(text, chr(10), ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY theory ORDER BY n) AS island FROM spans),
segments AS (SELECT theory, island, CAST(min(start) AS BIGINT) AS start, CAST(max(start + length(text)) AS BIGINT) AS stop, CAST(min(line) AS INT) AS start_line, string_agg(text, '' ORDER BY n) AS src FROM islands GROUP BY theory, island)"""


def _replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        text = f"replace({text}, '{a}', '{b}')"
    return text


_QUERY = _replaced(
    r"lang || ' \<and> x ==> (|y|) ... ' || source",
    [("(|", "⦇"), ("|)", "⦈"), ("[|", "⟦"), ("|]", "⟧"), ("{|", "⦃"), ("|}", "⦄"), (":", "∈"), ("~:", "∉"), ("(=", "⊆"), (")=", "⊇"), ("[=", "⊑"), ("]=", "⊒"), (".=", "≐"), ("...", "…"), ("=_(", "⇘"), ("=_)", "⇙"), ("=^(", "⇗"), ("=^)", "⇖")],
)
_STRIPPED = _replaced(
    "regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g')",
    [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")],
)


def _score(token: str) -> str:
    df = f"(SELECT count(DISTINCT doc_id) FROM forms WHERE list_contains(f, '{token}'))"
    n = "(SELECT count(*) FROM documents WHERE text IS NOT NULL)"
    tf = f"(SELECT count(*) FROM forms g WHERE g.doc_id = b.doc_id AND list_contains(f, '{token}'))"
    avg = "(SELECT avg(len(ts)) FROM base)"
    return f"ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5)) * {tf} / ({tf} + 1.2 * (1 - 0.75 + 0.75 * len(b.ts) / {avg}))"


#: The continuations of segments, as a pattern of its own.
_CONTINUATION = (
    r"^\s*$|^\s*@?(also|and|apply|assume|back|by|case|\}|consider|defer|define|done|\.|\.\.|finally|fix|focus|from|guess|have|hence|let|moreover|next|nitpick|note|obtain|oops|prefer|presume|proof"
    r"|qed|quickcheck|refute|schematic_goal|show|sledgehammer|sorry|subgoal|supply|termination|then|thus|try0|ultimately|unfolding|using|where|with)"
)
_SEGMENT_CONTINUATIONS = "WITH {} SELECT theory, start, stop, start_line, md5(src) AS h FROM segments".format(
    _SEGMENTS.replace("turn AS n, text,", "turn AS n, lower(text) AS text,").replace("WHEN role = 'user' OR", f"WHEN NOT regexp_matches(lower(text), '{_CONTINUATION}') OR")
)

ORACLE_SQL = {
    "minimum_slice": f"{_BOTH}, hit AS (SELECT id FROM blocks b WHERE command = '1-URGENT' AND EXISTS (SELECT 1 FROM entities e WHERE e.block_id = b.id AND kind = 'R')) SELECT id, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY id LIMIT 10",
    "filter_exact_parent": f"{_BOTH} SELECT id FROM blocks WHERE command = '1-URGENT'",
    "filter_exact_int": f"{_BOTH} SELECT id FROM blocks WHERE line = 1234",
    "filter_range": f"{_BOTH} SELECT id FROM blocks WHERE line BETWEEN 1000 AND 20000",
    "filter_id_list": "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey IN (1, 7, 32)",
    "filter_wildcard": "SELECT p_partkey AS id FROM part WHERE p_name LIKE 'small%'",
    "filter_not_exists": "SELECT nullif(l_returnflag, 'N') AS kind, count(*) AS n FROM lineitem WHERE nullif(l_returnflag, 'N') IS NOT NULL AND l_returnflag <> 'A' GROUP BY 1",
    "filter_not_multivalued": "SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem WHERE NOT regexp_full_match(CAST(l_partkey AS VARCHAR), '1.') AND NOT regexp_full_match(CAST(l_suppkey AS VARCHAR), '1.')",
    "filter_and_or_nested": f"{_BOTH} SELECT id FROM blocks WHERE command <> '5-LOW' AND (command LIKE '1%' OR command LIKE '_-HIGH') AND (line BETWEEN 0 AND 5000 OR line BETWEEN 100000 AND 200000)",
    "block_join_same_child": f"{_BOTH} SELECT id FROM blocks b WHERE command = '3-MEDIUM' AND EXISTS (SELECT 1 FROM entities e WHERE e.block_id = b.id AND kind = 'R' AND name = 'F')",
    "block_join_colocated": f"{_BOTH} SELECT id FROM blocks b WHERE command = '3-MEDIUM' AND EXISTS (SELECT 1 FROM entities e WHERE e.block_id = b.id AND kind = 'R' AND name = 'F')",
    "block_join_two_filters_vs_any": f"{_BOTH} SELECT id FROM blocks b WHERE EXISTS (SELECT 1 FROM entities e WHERE e.block_id = b.id AND kind = 'R') AND EXISTS (SELECT 1 FROM entities e WHERE e.block_id = b.id AND name = 'O') AND NOT EXISTS (SELECT 1 FROM entities e WHERE e.block_id = b.id AND kind = 'R' AND name = 'O')",
    "children_of_blocks": f"{_BOTH} SELECT kind, count(*) AS n FROM entities WHERE block_id IN (SELECT id FROM blocks WHERE command = '5-LOW') GROUP BY kind",
    "block_childless": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "child_expansion": f"{_BOTH}, page AS (SELECT id FROM blocks b WHERE line BETWEEN 1000 AND 90000 AND EXISTS (SELECT 1 FROM entities e WHERE e.block_id = b.id AND kind = 'A') ORDER BY id LIMIT 20) SELECT page.id, count(*) AS n_entities, count(*) FILTER (kind = 'A') AS n_a FROM page JOIN entities ON block_id = page.id GROUP BY page.id",
    "in_result_capped": f"{_BOTH}, inside AS (SELECT uses FROM entities WHERE kind = 'R' ORDER BY id LIMIT 1000), v AS (SELECT list(DISTINCT u) AS vs FROM (SELECT unnest(uses) AS u FROM inside)) SELECT count(*) AS n, CAST(sum(block_id) AS BIGINT) AS s FROM entities, v WHERE list_has_any(uses, vs)",
    "used_by": f"{_BOTH} SELECT id FROM blocks b WHERE EXISTS (SELECT 1 FROM entities e WHERE e.block_id = b.id AND list_has_any(uses, ['1', '2', '17']))",
    "uses_of": "SELECT DISTINCT -l_partkey AS id FROM lineitem WHERE l_orderkey * 10 + l_linenumber BETWEEN 11 AND 40 AND l_partkey IN (SELECT p_partkey FROM part)",
    "facet_parent_multiselect": f"{_BOTH} SELECT 'Command' AS field, command AS value, count(*) AS count FROM blocks b WHERE theory = 'F' AND EXISTS (SELECT 1 FROM entities e WHERE e.block_id = b.id AND kind = 'R') GROUP BY command",
    "facet_child_distinct_blocks": f"{_BOTH} SELECT 'Kind' AS field, kind AS value, count(DISTINCT block_id) AS count FROM entities WHERE name = 'F' AND block_id IN (SELECT id FROM blocks WHERE command = '1-URGENT') GROUP BY kind",
    "facet_int_as_text": "SELECT 'StartLine' AS field, CAST(n_chars AS VARCHAR) AS value, count(*) AS count FROM documents WHERE lang = 'en' GROUP BY n_chars",
    "facet_overflow": "WITH c AS (SELECT p_brand AS value, count(*) AS count FROM part GROUP BY p_brand), m AS (SELECT unnest([25, 26]) AS max_facets) SELECT CAST(max_facets AS INT) AS max_facets, value, count FROM c, m WHERE (SELECT count(*) FROM c) < max_facets",
    "facet_tokens": r"SELECT 'SourceTheory' AS field, value, count(*) AS count FROM (SELECT DISTINCT p_partkey, unnest(list_transform(list_concat([t], regexp_extract_all(t, '(\p{L}+|\p{N}+)', 1)), lambda x: lower(x))) AS value FROM (SELECT p_partkey, unnest(string_split_regex(p_name, '\s+')) AS t FROM part)) GROUP BY value",
    "facet_merge_selection": f"{_BOTH}, c AS (SELECT command AS value, count(*) AS count FROM blocks WHERE line BETWEEN 0 AND 50000 GROUP BY command), s AS (SELECT unnest(['1-URGENT', '9-NONE']) AS value) SELECT 'Command' AS field, coalesce(c.value, s.value) AS value, coalesce(count, 0) AS count, s.value IS NOT NULL AS selected FROM c FULL JOIN s ON c.value = s.value",
    "facets_drill_down": f"""{_BOTH} SELECT 'Command' AS field, command AS value, count(*) AS count FROM blocks b WHERE EXISTS (SELECT 1 FROM entities e WHERE e.block_id = b.id AND name = 'F' AND kind = 'R') GROUP BY command
      UNION ALL SELECT 'SourceTheoryFacet', theory, count(*) FROM blocks b WHERE command IN ('1-URGENT', '5-LOW') AND EXISTS (SELECT 1 FROM entities e WHERE e.block_id = b.id AND name = 'F' AND kind = 'R') GROUP BY theory
      UNION ALL SELECT 'Kind', kind, count(DISTINCT block_id) FROM entities WHERE name = 'F' AND block_id IN (SELECT id FROM blocks WHERE command IN ('1-URGENT', '5-LOW')) GROUP BY kind""",
    "page_1": f"{_BOTH} SELECT id, CAST(line AS DOUBLE) AS score FROM blocks ORDER BY line DESC, id LIMIT 10",
    "page_2_keyset": f"{_BOTH} SELECT id, CAST(line AS DOUBLE) AS score FROM blocks ORDER BY line DESC, id LIMIT 10 OFFSET 10",
    "total_count": "SELECT count(*) AS total FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "lookup_block": "SELECT o_orderkey AS id, o_orderpriority AS command FROM orders WHERE o_orderkey = 7",
    "lookup_by_child": "SELECT o_orderkey AS id, o_orderpriority AS command FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE -l_orderkey * 10 - 1 = -71)",
    "resolve_uses": "SELECT l_partkey AS used, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) GROUP BY l_partkey",
    "entity_summary": "SELECT l_orderkey AS block_id, nullif(count(*) FILTER (l_returnflag = 'A'), 0) AS A, nullif(count(*) FILTER (l_returnflag = 'N'), 0) AS N, nullif(count(*) FILTER (l_returnflag = 'R'), 0) AS R FROM lineitem GROUP BY l_orderkey",
    "kind_ordering": "SELECT CAST(CASE WHEN toxic = 1 THEN 2 ELSE 0 END AS INT) AS rank, count(*) AS n FROM labels GROUP BY 1",
    "theory_listing": "SELECT doc_id AS id, CAST(n_chars AS INT) AS start_line FROM documents WHERE source = 'src3' ORDER BY n_chars, doc_id LIMIT 25",
    "tokenize_source": rf"WITH {_SOURCE} SELECT lower(t) AS token, count(*) AS n FROM tokens GROUP BY 1",
    "tokenize_name_wdg": r"SELECT token, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(list_transform(list_concat([t], regexp_extract_all(t, '(\p{L}+|\p{N}+)', 1)), lambda x: lower(x))) AS token FROM (SELECT p_partkey, unnest(string_split_regex(replace(p_type, ' ', '_') || ' ' || p_brand, '\s+')) AS t FROM part)) GROUP BY token",
    "tokenize_type": r"""SELECT token, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(replace('''a::' || p_brand || ' => (' || replace(p_type, ' ', ',') || ')', '=>', '⇒'), '\s*([(){},⇒]|::|([^(){},⇒\s:]|:[^(){},⇒\s:])+)\s*', 1))) AS token FROM part) GROUP BY token""",
    "ascii_folding": r"SELECT strip_accents(replace(lower(t), 'ß', 'ss')) AS token, count(*) AS n FROM (SELECT unnest(string_split_regex(trim(text), '\s+')) AS t FROM documents) WHERE t <> '' GROUP BY 1",
    "html_strip": f"SELECT page_id, md5({_STRIPPED}) AS h FROM pages",
    "query_replacements": rf"""SELECT token, count(*) AS n FROM (SELECT lower(replace(replace(CASE WHEN t = '\<and>' THEN '∧' ELSE t END, '==>', '⟹'), '=>', '⇒')) AS token FROM (
      SELECT unnest(regexp_extract_all({_QUERY}, '(::|[(){{}}\[\].,:"]|[^\x00-\x7F]|[^(){{}}\[\].,:"\s\x{{80}}-\x{{10FFFF}}]+)', 1)) AS t FROM documents)) GROUP BY token""",
    "command_kinds": r"""SELECT CASE WHEN starts_with(t, '{') THEN '{' WHEN starts_with(t, '(*') THEN '(*' ELSE string_split_regex(t, '\s+|\(|"|\.|‹|\{|\[|%|✐|―')[1] END AS command, count(*) AS n FROM (SELECT regexp_replace(text, '^\s+', '') AS t FROM documents) GROUP BY 1""",
    "drop_first_component": r"SELECT page_id, array_to_string(string_split(h, '.')[2:], '.') AS name, 'Fact.' || h AS id FROM (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS h FROM pages)",
    "resolve_all_uses": "SELECT used, count(DISTINCT l_orderkey) AS n FROM (SELECT l_orderkey, unnest([l_partkey, l_suppkey]) AS used FROM lineitem) WHERE used IN (SELECT p_partkey FROM part) GROUP BY used",
    "theory_listing_whole": "SELECT doc_id AS id, CAST(n_chars AS INT) AS start_line FROM documents WHERE source = 'src3' ORDER BY n_chars, doc_id LIMIT 10000",
    "resolved_entities": f"{_BOTH} SELECT e.id, CAST(CASE WHEN p_name IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_uses, p_name AS name FROM entities e LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = e.uses[1]",
    "best_child_score": """WITH w AS (SELECT p_size, string_split(p_name, ' ') AS t FROM part), s AS (SELECT count(*) AS n, avg(len(t)) AS a, count(*) FILTER (list_contains(t, 'small')) AS x, count(*) FILTER (list_contains(t, 'bolt')) AS y FROM w),
      g AS (SELECT p_size, round((ln(1 + (n - x + 0.5) / (x + 0.5)) * CAST(list_contains(t, 'small') AS INT) + ln(1 + (n - y + 0.5) / (y + 0.5)) * CAST(list_contains(t, 'bolt') AS INT)) / (1 + 1.2 * (0.25 + 0.75 * len(t) / a)), 6) AS g FROM w, s WHERE list_has_any(t, ['small', 'bolt']))
      SELECT CAST(p_size AS BIGINT) AS id, round(1 + max(g), 6) AS score FROM g GROUP BY p_size""",
    "or_ranks_both_first": rf"WITH {_SOURCE}, hit AS (SELECT DISTINCT doc_id FROM forms WHERE list_has_any(f, ['idiot', 'scum'])) SELECT b.doc_id AS id, round({_score('idiot')} + {_score('scum')}, 6) AS score FROM base b JOIN hit USING (doc_id) ORDER BY score DESC, id LIMIT 10",
    "facet_other_field": "SELECT 'SourceTheoryFacet' AS field, p_name AS value, count(*) AS count FROM part WHERE list_contains(string_split(p_name, ' '), 'small') GROUP BY p_name",
    "facet_without_values": f"{_BOTH} SELECT 'Command' AS field, command AS value, count(*) AS count FROM blocks WHERE line BETWEEN 0 AND 1500 GROUP BY command",
    "inner_query_of_texts": "SELECT p_partkey AS id FROM part WHERE list_has_any(string_split(p_name, ' '), (SELECT string_split(p_name, ' ') FROM part WHERE p_partkey = 7))",
    "filter_int_values": f"{_BOTH} SELECT id FROM blocks WHERE line IN (36901, 173665) OR line BETWEEN 90000 AND 91000",
    "term_blank": rf"WITH {_SOURCE} SELECT DISTINCT doc_id AS id FROM forms WHERE list_contains(f, 'idiot')",
    "tree_references": "SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS root, unnest(['Constant', 'Type', 'Type']) AS kind, unnest([p_brand, p_type, 'size' || p_size]) AS name FROM part",
    "proof_references": "SELECT kind, name, count(*) AS n FROM (SELECT unnest(['Fact', 'Fact', 'Fact', 'Type']) AS kind, unnest(['clerk' || o_custkey, o_orderpriority, 'trusted', o_orderstatus]) AS name FROM orders) GROUP BY kind, name",
    "type_printer": "SELECT c_custkey, '(?a' || CASE WHEN c_nationkey = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END || ' :: ' || c_mktsegment || ' ⇒ nat) ⇒ t' || c_nationkey || ' list' AS printed FROM customer",
    "pure_names": "SELECT name, count(*) AS n FROM (SELECT unnest([CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END, CASE WHEN l_linestatus = 'O' THEN NULL ELSE 'funs' END]) AS name FROM lineitem) WHERE name IS NOT NULL GROUP BY name",
    "last_blank_lines": r"SELECT doc_id, md5(regexp_replace(coalesce(text, '') || chr(10) || '  ' || chr(10) || chr(10) || ' ', '(\n\s*)+$', '')) AS h FROM documents",
    "segment_continuations": _SEGMENT_CONTINUATIONS,
    "adjacency": "SELECT theory, start, expected FROM (SELECT o_custkey AS theory, o_orderkey AS start, lag(o_orderkey + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 9 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS expected FROM orders) WHERE expected <> start",
    "extract_blocks": r"""WITH t AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN ' ' || chr(10) ELSE text END AS src FROM conversations),
      b AS (SELECT *, 1 + coalesce(sum(length(src)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, regexp_replace(src, '^\s+', '') AS s FROM t)
      SELECT 'T' || conv_id || '.' || CAST(start AS BIGINT) || '.' || CAST(start + length(src) AS BIGINT) AS id, CASE WHEN s = '' THEN NULL WHEN starts_with(s, '{') THEN '{' WHEN starts_with(s, '(*') THEN '(*' ELSE string_split_regex(s, '\s+|\(|"|\.|‹|\{|\[|%|✐|―')[1] END AS command, CASE WHEN s = '' THEN 'blank block' END AS message FROM b""",
    "extract_types": "SELECT 'Type.T.' || n_nationkey AS id, CAST(n_nationkey AS VARCHAR) AS name, 'Constant.C.' || n_regionkey || ',Type.A.' || n_regionkey || ',Type.R.' || n_regionkey AS uses FROM nation",
    "extract_constants": "SELECT 'Constant.T.' || c_custkey AS id, CAST(c_custkey AS VARCHAR) AS name, array_to_string(list_sort(['Constant.C.' || c_nationkey, 'Type.' || c_mktsegment, 'Type.N.' || c_nationkey]), ',') AS uses FROM customer",
    "extract_facts": """WITH i AS (SELECT l_orderkey AS k, list(DISTINCT 'Fact.part' || l_partkey) AS parts FROM lineitem GROUP BY l_orderkey)
      SELECT 'Fact.T.' || o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS name, array_to_string(list_sort(list_concat(['Constant.' || o_orderstatus, 'Fact.cust' || o_custkey], coalesce(parts, []))), ',') AS uses FROM orders LEFT JOIN i ON k = o_orderkey
      UNION ALL SELECT 'Fact.S.' || s_suppkey, CAST(s_suppkey AS VARCHAR), 'Type.N.' || s_nationkey FROM supplier WHERE s_acctbal >= 0 AND s_nationkey <> 3""",
    "sanity_warnings": """WITH e AS (SELECT CAST(l_partkey AS VARCHAR) AS entity, l_returnflag, l_linestatus, l_suppkey, l_linenumber FROM lineitem)
      SELECT entity, 'id repeats' AS message, 1 AS n FROM (SELECT DISTINCT * FROM e) GROUP BY entity HAVING count(*) > 1 UNION ALL SELECT entity, 'uses repeat', count(*) FROM e WHERE l_suppkey = l_linenumber GROUP BY entity""",
    "symbol_rules": r"""SELECT '\<n' || n_nationkey || '>' AS word, chr(CAST(8704 + n_nationkey AS INT)) AS replacement FROM nation UNION ALL SELECT '/' || n_nationkey, chr(CAST(8704 + n_nationkey AS INT)) FROM nation
      UNION ALL SELECT '&' || n_regionkey, min(chr(CAST(8704 + n_nationkey AS INT))) FROM nation GROUP BY n_regionkey HAVING count(*) = 1""",
    "catalog_upsert": """WITH o AS (SELECT c_nationkey AS k, count(*) AS entities FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
      SELECT 'T' || c_nationkey AS theory, count(*) AS blocks, CASE WHEN c_nationkey = 3 THEN 'again ' ELSE '' END || min(c_name) AS first, CASE WHEN c_nationkey = 3 THEN 0 ELSE coalesce(max(entities), 0) END AS entities FROM customer LEFT JOIN o ON k = c_nationkey GROUP BY c_nationkey""",
    "catalog_delete": """WITH o AS (SELECT c_nationkey AS k, count(*) AS entities FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1)
      SELECT 'T' || c_nationkey AS theory, count(*) AS blocks, min(c_name) AS first, coalesce(max(entities), 0) AS entities FROM customer LEFT JOIN o ON k = c_nationkey WHERE c_mktsegment <> 'BUILDING' GROUP BY c_nationkey""",
    "term_any_token": rf"WITH {_SOURCE} SELECT DISTINCT doc_id AS id FROM forms WHERE list_has_any(f, ['idiot', 'scum'])",
    "term_wildcard_token": rf"WITH {_SOURCE} SELECT DISTINCT doc_id AS id FROM forms WHERE len(list_filter(f, lambda x: regexp_full_match(x, 'path.t.*'))) > 0",
    "phrase_slop": rf"WITH {_SOURCE} SELECT DISTINCT a.doc_id AS id FROM forms a JOIN forms b ON a.doc_id = b.doc_id AND list_contains(a.f, 'than') AND list_contains(b.f, 'with') AND abs(a.k - (b.k - 1)) <= 10",
    "bm25_topk": rf"WITH {_SOURCE}, hit AS (SELECT DISTINCT doc_id FROM forms WHERE list_has_any(f, ['pathetic', 'clown'])) SELECT b.doc_id AS id, round({_score('pathetic')} + {_score('clown')}, 6) AS score FROM base b JOIN hit USING (doc_id) ORDER BY score DESC, id LIMIT 10",
    "unresolved_documents": f"{_BOTH} SELECT 'Parent' AS doc_kind, count(*) AS n FROM blocks WHERE line BETWEEN 10 AND 40 HAVING count(*) > 0 UNION ALL SELECT 'Child', count(*) FROM entities WHERE line BETWEEN 10 AND 40 HAVING count(*) > 0",
    "full_scan": f"{_BOTH} SELECT 'Parent' AS doc_kind, count(*) AS n, count(DISTINCT id) AS ids FROM blocks UNION ALL SELECT 'Child', count(*), count(DISTINCT id) FROM entities",
    "form_search": f"{_BOTH} SELECT id FROM blocks b WHERE command NOT IN ('1-URGENT', '2-HIGH') AND EXISTS (SELECT 1 FROM entities e WHERE e.block_id = b.id AND name = 'F' AND kind IN ('R', 'A'))",
    "dump_spans": r"""WITH t AS (SELECT *, 'S' || k % 3 AS session, 'S' || k % 3 || '.T' || k AS theory FROM (SELECT *, ((coalesce(conv_id, 0) % 40) + 40) % 40 AS k, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations)),
  s AS (SELECT session, theory, CAST(row_number() OVER (PARTITION BY theory ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, r, x) AS INT) AS n, '\<role> ∧ ' || x AS text FROM t WHERE session IN ('S0', 'S2'))
  SELECT session, theory, 2 * n - 1 AS n, md5(text) AS h FROM s UNION ALL SELECT session, theory, 2 * n, md5(chr(10)) FROM s""",
    "segment_spans": f"WITH {_SEGMENTS} SELECT theory, start, stop, start_line, md5(src) AS h FROM segments",
    "context_lines": rf"""WITH {_SEGMENTS}, beside AS (SELECT theory, start, coalesce(lag(src) OVER w, '') AS b, coalesce(lead(src) OVER w, '') AS a FROM segments WINDOW w AS (PARTITION BY theory ORDER BY start)),
      cut AS (SELECT *, regexp_extract_all(b, '[^\n]*\n|[^\n]+') AS bl, regexp_extract_all(a, '[^\n]*\n|[^\n]+') AS al FROM beside)
      SELECT theory, start, md5(array_to_string(bl[greatest(len(bl) - 4, 1):], '')) AS before, md5(array_to_string(al[1:5], '')) AS after FROM cut""",
    "range_join_containment": f"WITH {_SEGMENTS}, p AS (SELECT theory, n AS turn, start + length(text) // 2 AS at FROM spans) SELECT p.theory, p.turn, (SELECT min(s.start) FROM segments s WHERE s.theory = p.theory AND s.start <= p.at AND p.at <= s.stop) AS start FROM p",
    "dup_ids": "SELECT id, count(*) AS n FROM (SELECT DISTINCT l_orderkey || '.' || l_linenumber AS id, l_partkey, l_suppkey FROM lineitem) GROUP BY id HAVING count(*) > 1",
    "dup_uses": "SELECT l_orderkey AS id FROM lineitem GROUP BY l_orderkey HAVING count(*) <> count(DISTINCT l_suppkey)",
    "anti_join_axioms": "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_custkey <> 1",
    "definition_lookup": "SELECT 'no axiom ' || c_nationkey AS message, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20) GROUP BY 1",
    "copy_field_truncate": "SELECT doc_id, md5(substr(text, 1, 3276)) AS h FROM documents",
    "list_indexes": "WITH x AS (SELECT CASE WHEN n_nationkey % 10 = 7 THEN 'default_' || n_name ELSE n_name END AS name, n_nationkey AS o FROM nation) SELECT name, row_number() OVER (ORDER BY CASE WHEN o = (SELECT min(o) FROM x WHERE name LIKE '%default%') THEN 0 ELSE 1 END, o) AS rank FROM x",
    "index_name_parts": "SELECT n_nationkey, replace(n_name, '_', '-') AS name, CASE WHEN n_nationkey % 2 = 0 THEN '2020' END AS release, CASE WHEN n_nationkey % 2 = 0 THEN 'ARCHIVE' END AS archive FROM nation",
    "upsert_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "session_selection": r"SELECT DISTINCT string_split(regexp_extract(url, '//([^/]+)', 1), '.')[1] AS session FROM pages",
    "delete_by_query": "SELECT o_orderpriority AS command, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1",
}

_STORED = """WITH done AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS kinds FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey),
stored AS (SELECT o_orderkey AS id, coalesce(kinds, []) AS kinds, substring(o_orderpriority, 1, CAST(o_orderkey % 2 AS INT) + 1) AS line, o_orderstatus || ',' || o_orderpriority AS uses
  FROM orders LEFT JOIN done ON o_orderkey = l_orderkey)"""
ORACLE_SQL |= {
    "read_errors": f"""{_STORED}, errors AS (SELECT 'kind' AS field, CASE WHEN len(kinds) = 0 THEN 'missing' ELSE 'multiple' END AS problem, len(kinds) AS found FROM stored WHERE len(kinds) <> 1
  UNION ALL SELECT 'start_line', CASE WHEN line IS NULL THEN 'missing' ELSE 'malformed' END, CASE WHEN line IS NULL THEN 0 ELSE 1 END FROM stored WHERE try_cast(line AS INT) IS NULL)
SELECT field, problem, count(*) AS documents, CAST(sum(found) AS BIGINT) AS found FROM errors GROUP BY field, problem""",
    "read_valid": f"""{_STORED} SELECT id, kinds[1] AS kind, CAST(line AS INT) AS start_line, uses, CAST(NULL AS VARCHAR) AS type FROM stored WHERE len(kinds) = 1 AND try_cast(line AS INT) IS NOT NULL""",
}
