"""The same rows in the oracle's SQL, for the queries that SQL can express at the size of the correctness check.

The others (op3, op4, op5, op8, op9 and the pipeline) are compared with plain Python in tests/llm: template diagonals, seeded
hashes, tokenizers and checksummed spans are no SQL.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_REACH = """both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (SELECT node, node AS seen FROM nodes UNION SELECT node, b FROM reach JOIN both_ways ON a = seen),
components AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)"""

ORACLE_SQL = {
    "op1_quality": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
f AS (SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g) WHERE times > 1) GROUP BY doc_id),
c AS (SELECT f.*, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM f LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words <= 1000000 AND word_chars >= 2.0 * n_words AND word_chars <= 20.0 * n_words AND n_symbols <= 0.3 * n_words
  AND n_dup_lines <= 0.5 * len(lines) AND length(regexp_replace(t, '\P{{L}}+', '', 'g')) >= 0.5 * word_chars AS kept FROM b""",
    "op2_vectors": f"""WITH RECURSIVE v AS (SELECT vec_id AS node, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), nodes AS (SELECT node FROM v),
links AS (SELECT x.node AS a, y.node AS b FROM v x JOIN v y ON x.node < y.node AND list_cosine_similarity(x.e, y.e) >= 0.95), {_REACH}
SELECT node AS vec_id, (SELECT count(*) FROM both_ways WHERE a = node) AS n_links, component_id, component_id = node AS kept FROM components""",
    "op6_urls": rf"""WITH rules(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'block'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, CASE WHEN regexp_matches(host, '(^|[.-])(casino|pills|porn|spam|viagra|xxx)($|[.:-])') THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op7_jaccard": rf"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(shingle) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id), nodes AS (SELECT doc_id AS node FROM n),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)), {_REACH}
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN components ON node = doc_id""",
    "op10_substrings": rf"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY gram) AS times FROM g) WHERE times > 1),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone.p IS NULL) AS kept FROM w LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
