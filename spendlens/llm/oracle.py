"""DuckDB SQL with the results that SQL can state.

Toxicity (a trained model), BPE, HTML extraction (a trained model), hashed
near-duplicate search, and sampling by Spark's hash have none; their tests hold
them against brute force, a round trip or held-out rows.
"""

from __future__ import annotations

from spendlens.llm import license_scan, quality_rules, url_filter

_WORD = r"[^\x20\x09-\x0D]+"


def _lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


NGRAM_JOIN = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_extract_all({_lower("coalesce(text, '')")}, '{_WORD}'), lambda x: x <> '') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s
  FROM words),
posting AS (SELECT doc_id, unnest(s) AS g FROM shingled),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM posting a JOIN posting b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM shared JOIN shingled p ON p.doc_id = x JOIN shingled q ON q.doc_id = y
  WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT r.node, e.y FROM reach r JOIN edge e ON e.x = r.other)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c.component_id
FROM shingled JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) c ON c.node = doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS latest FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM m
"""


def _rule_cases(host: str, path: str, value) -> str:
    out = []
    for verdict, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        own, tail = rule.split("/", 1)
        out.append(f"WHEN ({host} = '{own}' OR suffix({host}, '.{own}')) AND prefix({path}, '/{tail}') THEN '{value(verdict, rule)}'")
    return "CASE " + " ".join(out) + " END"


_TAG = r"""(?is)<(?:link|meta)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>"""


def _attribute(name: str) -> str:
    return (rf"""trim(replace(regexp_replace(regexp_extract(tag, '(?is)[\s"''/]{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1), """
            rf"""'^["'']|["'']$', '', 'g'), '&amp;', '&'))""")


#: Aliases with absolute targets, as the given tables would hold them.
URL_FILTER = rf"""
WITH RECURSIVE page AS (
  SELECT page_id, url, coalesce(html, '') AS html,
    {_lower("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    regexp_replace(url, '#.*$', '', 's') AS node FROM pages),
tags AS (SELECT node, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '{_TAG}')) AS tag
  FROM page WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
goal AS (SELECT node, CASE WHEN tag ILIKE '<link%' AND {_attribute("rel")} ILIKE 'canonical' THEN {_attribute("href")}
  WHEN tag ILIKE '<meta%' AND {_attribute("http-equiv")} ILIKE 'refresh'
  THEN regexp_extract({_attribute("content")}, '(?is)url\s*=\s*(.*)$', 1) END AS target FROM tags),
link AS (SELECT node AS x, regexp_replace(target, '#.*$', '', 's') AS y FROM goal WHERE target LIKE '%://%'),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x AS node, x AS other FROM edge UNION SELECT r.node, e.y FROM reach r JOIN edge e ON e.x = r.other),
ruled AS (SELECT node, {_rule_cases(
    "regexp_extract(other, '://([^/?#]*)', 1)", "regexp_extract(other, '://[^/?#]*([^?#]*)', 1)", lambda v, r: v)} AS v FROM reach),
class AS (SELECT node, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v FROM ruled GROUP BY node)
SELECT page_id, host, path, {_rule_cases("host", "path", lambda v, r: r)} AS rule,
  coalesce({_rule_cases("host", "path", lambda v, r: v)}, class.v, 'allow') AS verdict
FROM page LEFT JOIN class USING (node)
"""


def _license_sql() -> str:
    t, of = license_scan.CONTAINMENT
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    templates = ", ".join(f"({n}, '{label}', {words!r})" for n, label, words in license_scan.template_table())
    phrases = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in license_scan.PHRASES.items())
    return f"""
WITH template(number, label, words) AS (VALUES {templates}),
phrase(label, words) AS (VALUES {phrases}),
doc AS (SELECT doc_id, {_lower("coalesce(text, '')")} AS t FROM documents),
worded AS (SELECT doc_id, t, list_filter(regexp_extract_all(t, '{word}'), lambda x: x <> '') AS w FROM doc),
place AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(w) - len(words) + 1), lambda i: list_slice(w, i + 1, i + len(words)) = words)) AS start
  FROM worded, phrase),
based AS (SELECT doc_id, count(*) AS n, min(start) AS a, max(start) AS b, list(DISTINCT label) AS l FROM place GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM doc),
held AS (SELECT doc_id, list_distinct(regexp_extract_all(x, '{word}')) AS w FROM line),
found AS (
  SELECT doc_id, label, len(list_intersect(w, words)) / len(words) AS c FROM held, template
  WHERE {of} * len(list_intersect(w, words)) >= {t} * len(words)),
method AS (SELECT doc_id, list(DISTINCT label) AS l, max(c) AS c FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(based.n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(based.l), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(based.l, []), coalesce(method.l, [])))), ','), '') AS labels,
  CASE WHEN based.n > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM worded LEFT JOIN based USING (doc_id) LEFT JOIN method USING (doc_id)
"""


def _quality_sql() -> str:
    rules = quality_rules.GRIDS
    share = quality_rules.RISK / len(rules)
    level = quality_rules.ERROR / (len(rules) * (len(quality_rules.STRATA) + 1))
    grid = ", ".join(f"('{rule}', {step}, {float(cut)!r}::DOUBLE)" for rule, cuts in rules.items() for step, cut in enumerate(cuts))
    strata = ", ".join(f"'{s}'" for s in quality_rules.STRATA)
    long = "\nUNION ALL ".join(f"SELECT doc_id, stratum, h, base_failed, '{rule}' AS rule, {rule} AS x FROM measured" for rule in rules)
    return rf"""
WITH doc AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, list_filter(regexp_extract_all(t, '{_WORD}'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM doc),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM worded WHERE len(w) >= 3),
spread AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM windows),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM spread WHERE n > 1) GROUP BY doc_id),
counted AS (SELECT doc_id, lang, t, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l) AS lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS capitals FROM worded LEFT JOIN covered USING (doc_id)),
measured AS (SELECT *, md5(t) AS h, CASE WHEN lang IN ({strata}) THEN lang ELSE '{quality_rules.OTHER}' END AS stratum,
  n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words AS base_failed,
  coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_share, coalesce(n_dup_lines / nullif(lines, 0), 0) AS duplicate_line_share,
  coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeated_share, coalesce(capitals / nullif(word_chars, 0), 0) AS capital_share FROM counted),
long AS ({long}),
grid(rule, step, cutoff) AS (VALUES {grid}),
unit AS (SELECT DISTINCT stratum, h, rule, x FROM long WHERE NOT base_failed
  AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tested AS (SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER (x > cutoff) AS k FROM unit JOIN grid USING (rule) GROUP BY ALL),
proven AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
  + j * ln({share!r}) + (n - j) * ln(1 - {share!r})))) AS p FROM tested),
chosen AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM proven WHERE k < n * {share!r} AND p <= {level!r} GROUP BY ALL),
failed AS (SELECT DISTINCT doc_id FROM long JOIN chosen USING (stratum, rule) WHERE x > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM failed) AS kept
FROM measured
"""


# CRC-32 of a short ASCII text, byte by byte and bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(KEY, ''), lambda ch: ord(ch)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

CONVERSATION_REPAIR = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.replace("KEY", "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM keyed WHERE k <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS r
  FROM damaged),
marked AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') AS open_end,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered),
line AS (
  SELECT conv_id, i, r, role, text, turn, blank, NOT blank AND again AS dup, NOT blank AND NOT again AND open_end AS trunc,
    before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au') AS bad,
    CASE WHEN blank OR again THEN 1000000000 WHEN open_end THEN 3 ELSE 0 END AS k
  FROM marked),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
    count_if(dup) AS dup, count_if(trunc) AS trunc, count_if(bad) AS bad
  FROM line GROUP BY conv_id),
row_costs AS (  -- before a row: costs of coming to the end from nothing yet, after system, after user, after assistant
  SELECT conv_id, n + 1 AS i, [0, 6, 3, 0] AS c FROM facts
  UNION ALL
  SELECT conv_id, i, [least(e[1], 3 + e[3], 6 + e[4]), least(e[2], 3 + e[3], 6 + e[4]), least(e[3], 3 + e[4]), least(e[4], 3 + e[3])]
  FROM (
    SELECT l.conv_id, l.i, [
      least(4 + c[1], CASE r WHEN 's' THEN k + c[2] WHEN 'u' THEN k + c[3] ELSE 1000000000 END, 3 + k + c[3]),
      least(4 + c[2], CASE r WHEN 'u' THEN k + c[3] ELSE 1000000000 END, 3 + k + c[3]),
      least(4 + c[3], CASE r WHEN 'a' THEN k + c[4] ELSE 1000000000 END, 3 + k + c[4]),
      least(4 + c[4], CASE r WHEN 'u' THEN k + c[3] ELSE 1000000000 END, 3 + k + c[3])] AS e
    FROM row_costs b JOIN line l ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.i = b.i - 1)),
walk AS (  -- q: 1 to 4, as in row_costs
  SELECT conv_id, 1::BIGINT AS i, 1 AS q, '' AS audit, '' AS out FROM facts
  UNION ALL
  SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END,
    CASE WHEN edit = 'D' THEN q WHEN edit = 'K' AND r = 's' THEN 2 WHEN q = 3 THEN 4 ELSE 3 END, audit || edit,
    CASE WHEN edit = 'D' THEN out ELSE out || CASE WHEN out = '' THEN '' ELSE chr(10) END
      || CASE WHEN edit = 'K' THEN role || ':' || text ELSE CASE WHEN q = 3 THEN 'assistant:' ELSE 'user:' END
        || CASE WHEN edit = 'R' THEN text ELSE '' END END END
  FROM (
    SELECT w.*, l.r, l.role, l.text, CASE
      WHEN l.i IS NULL THEN 'I'
      WHEN 4 + t.c[w.q] = b.c[w.q] THEN 'D'
      WHEN 3 + b.c[CASE WHEN w.q = 3 THEN 4 ELSE 3 END] = b.c[w.q] THEN 'I'
      WHEN CASE WHEN w.q = 1 AND l.r = 's' THEN l.k + t.c[2] WHEN w.q <> 3 AND l.r = 'u' THEN l.k + t.c[3]
        WHEN w.q = 3 AND l.r = 'a' THEN l.k + t.c[4] END = b.c[w.q] THEN 'K'
      ELSE 'R' END AS edit
    FROM walk w JOIN row_costs b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i
    LEFT JOIN line l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i
    LEFT JOIN row_costs t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
    WHERE l.i IS NOT NULL OR b.c[w.q] > 0))
SELECT o.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.dup, 0)::BIGINT AS duplicate,
  coalesce(f.trunc, 0)::BIGINT AS truncated, coalesce(f.bad, 0)::BIGINT AS illegal, coalesce(b.c[1], 0)::BIGINT AS cost,
  coalesce(w.audit, '') AS audit, sha256(coalesce(w.out, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN row_costs b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.i = f.n + 1 AND [0, 6, 3, 0][w.q] = 0
"""

SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": NGRAM_JOIN,
    "op3_warc": WARC,
    "op4_url_filter": URL_FILTER,
    "op5_license_scan": _license_sql(),
    "op9_quality_rules": _quality_sql(),
    "op12_conversation_repair": CONVERSATION_REPAIR,
}
