"""DuckDB SQL of the queries that SQL can express."""

#: Strips ASCII white space at both ends and lower-cases A-Z.
_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op5_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), stepped AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars,
  bool_and((before IS NULL AND role IN ('system', 'user')) OR (before IN ('system', 'assistant') AND role = 'user') OR (before = 'user' AND role = 'assistant')) AS valid
FROM stepped GROUP BY conv_id
""",
    "op8_warc_round_trip": """
WITH own AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), largest AS (
  SELECT digest, n, max(page_id) AS response FROM own WHERE n >= 1000 GROUP BY digest, n
)
SELECT page_id, CAST(o.n AS BIGINT) AS payload_bytes, o.digest AS payload_digest,
  CASE WHEN response IS NULL OR page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN response END AS refers_to,
  CAST(NULL AS VARCHAR) AS error
FROM own o LEFT JOIN largest l ON o.digest = l.digest AND o.n = l.n
""",
    "op9_perfect_hash_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, pos, line, {_KEY} AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), often AS (
  SELECT key, max(doc_id) AS largest FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, o.key IS NOT NULL AND l.doc_id IS DISTINCT FROM o.largest AS gone FROM lines l LEFT JOIN often o ON l.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}


def _rules_sql() -> str:
    from sievework.llm.quality_rules import FALSE_REJECTION, MAX_REPEAT, MIN_WORDS, RISK, RULES, TESTS

    limit = FALSE_REJECTION / len(RULES)
    cuts = ", ".join(f"('{rule}', CAST({cut} AS DOUBLE))" for rule, (_, xs) in RULES.items() for cut in xs)
    measure = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {m}" for rule, (m, _) in RULES.items()) + " END"
    first = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {k}" for k, rule in enumerate(RULES)) + " END"
    names = "[" + ", ".join(f"'{rule}'" for rule in RULES) + "]"
    return rf"""
WITH own AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), places AS (
  SELECT rid, i, list_slice(words, i, i + 7) AS win FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM own)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM places) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid
), seen AS (
  SELECT o.rid, o.doc_id, o.stratum, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(list_distinct(words)) AS n_distinct
  FROM own o LEFT JOIN covered c ON o.rid = c.rid
), based AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM seen
), cuts(rule, cut) AS (VALUES {cuts}
), measured AS (
  SELECT rid, stratum, rule, {measure} AS m FROM based, (SELECT DISTINCT rule FROM cuts) WHERE NOT base_failed
), held AS (
  SELECT rid FROM based WHERE doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)
), tests AS (
  SELECT stratum, c.rule, c.cut, count(*) AS n, CAST(count_if(m > cut) AS BIGINT) AS k FROM measured JOIN held USING (rid) JOIN cuts c ON c.rule = measured.rule GROUP BY ALL
), safe AS (
  SELECT stratum, rule, min(cut) AS cut FROM tests
  WHERE CASE WHEN k >= n * CAST({limit!r} AS DOUBLE) THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({limit!r}) + (n - j) * ln(1 - {limit!r})))) END
    <= CAST({RISK!r} AS DOUBLE) / ((SELECT count(DISTINCT stratum) FROM tests) * {TESTS})
  GROUP BY stratum, rule
), refused AS (
  SELECT rid, min({first.replace('CASE rule', 'CASE s.rule')}) AS k FROM measured JOIN safe s ON s.stratum = measured.stratum AND s.rule = measured.rule AND m > cut GROUP BY rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r.k IS NULL AS kept, ({names})[r.k + 1] AS rejected_by
FROM based b LEFT JOIN refused r ON b.rid = r.rid
"""


SQL["op3_risk_controlled_rules"] = _rules_sql()


def _urls_sql() -> str:
    """Rules as a table, of which the longest that fits is taken; the rounds as one common table each."""
    from sievework.llm.url_filter import DAMPING, LIMIT, LINK, ROUNDS, RULES, UNIT

    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = LINK.replace("'", "''")
    rounds = ", ".join(
        f"""r{n} AS MATERIALIZED (SELECT kind, node, CAST(sum(mass) AS BIGINT) AS mass FROM (
  SELECT e.kind, e.goal AS node, CAST(sum(r.mass // d.degree) AS BIGINT) // 100 * {DAMPING} AS mass FROM r{n - 1} r JOIN degrees d USING (kind, node) JOIN edges e USING (kind, node) GROUP BY e.kind, e.goal
  UNION ALL SELECT kind, node, mass FROM r0) GROUP BY kind, node)"""
        for n in range(1, ROUNDS + 1)
    )
    return rf"""
WITH rules(host, path, verdict) AS (VALUES {rules}
), own AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, page_id, html, {low("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), judged AS MATERIALIZED (
  SELECT o.*, r.rule, r.verdict FROM own o LEFT JOIN (
    SELECT rid, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.host || r.path) AS k
    FROM own o JOIN rules r ON ends_with('.' || o.host, '.' || r.host) AND starts_with(o.path, r.path)) r ON r.rid = o.rid AND r.k = 1
), seeds AS (
  SELECT host, CAST(count_if(verdict = 'allow') AS BIGINT) * {UNIT} // count(*) AS good, CAST(count_if(verdict = 'block') AS BIGINT) * {UNIT} // count(*) AS bad FROM judged WHERE host <> '' GROUP BY host
), links AS MATERIALIZED (
  SELECT DISTINCT host, goal FROM (SELECT host, {low('unnest(regexp_extract_all(html, ' + "'" + link + "'" + ', 1))')} AS goal FROM own WHERE host <> '') WHERE goal <> host
), edges AS MATERIALIZED (
  SELECT 'trust' AS kind, host AS node, goal FROM links UNION ALL SELECT 'distrust', goal, host FROM links
), degrees AS (SELECT kind, node, count(*) AS degree FROM edges GROUP BY kind, node
), r0 AS MATERIALIZED (
  SELECT 'trust' AS kind, host AS node, good // 100 * {100 - DAMPING} AS mass FROM seeds UNION ALL SELECT 'distrust', host, bad // 100 * {100 - DAMPING} FROM seeds
), {rounds}, bad AS (
  SELECT node FROM r{ROUNDS} GROUP BY node HAVING coalesce(sum(mass) FILTER (kind = 'distrust'), 0) > coalesce(sum(mass) FILTER (kind = 'trust'), 0) AND sum(mass) FILTER (kind = 'distrust') >= {UNIT * (100 - DAMPING) * LIMIT // 10000}
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""


SQL["op11_host_trust_url_filter"] = _urls_sql()
#: Each order is walked step by step over the documents' failed filters; nothing is inverted.
SQL["op12_filter_interaction_audit"] = r"""
WITH own AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), told AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), seen AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM own
), failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN seen.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM seen LEFT JOIN told ON told.doc_id = seen.doc_id
), patterns AS (
  SELECT part, fails, count(*) AS n, count_if(good) AS g, count_if(toxic) AS t FROM failed GROUP BY part, fails
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x) JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, left(filter_order, step - 1) AS before FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
), walked AS (
  SELECT part, filter_order, step, letter, n, g, t, fails, contains(fails, letter) AS here, translate(fails, before, '') <> fails AS earlier FROM patterns, steps
), counted AS (
  SELECT part, filter_order, step, letter, CAST(coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (here AND earlier), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = letter), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(g) FILTER (here AND NOT earlier), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(t) FILTER (here AND NOT earlier), 0) AS BIGINT) AS toxic_lost
  FROM walked GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counted
"""
#: The pieces are cut by lengths, and what is rebuilt must be the text.
SQL["op13_fill_in_middle"] = r"""
WITH own AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h, list_transform(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda x: length(x)) AS sizes FROM documents
), drawn AS (
  SELECT *, len(sizes) AS n, list_transform(range(0, 4), lambda k: CAST('0x' || h[8 * k + 1 : 8 * k + 8] AS BIGINT)) AS dice FROM own
), placed AS (
  SELECT *, list_sort([dice[1] % (n + 1), dice[2] % (n + 1)]) AS ends, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR dice[3] % 100 >= 50 THEN 'plain' WHEN dice[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
  SELECT *, CAST(coalesce(list_sum(sizes[1 : ends[1]]), 0) AS BIGINT) AS p, CAST(coalesce(list_sum(sizes[ends[1] + 1 : ends[2]]), 0) AS BIGINT) AS m FROM placed
), pieces AS (
  SELECT *, left(text, p) AS prefix, substr(text, p + 1, m) AS middle, substr(text, p + m + 1) AS suffix FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(text) AS restored_sha256
FROM pieces
"""
