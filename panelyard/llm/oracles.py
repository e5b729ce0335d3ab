"""DuckDB counterparts of the queries here that SQL can express on whole tables."""

from __future__ import annotations

from panelyard.llm.mixing import SEEDS
from panelyard.llm.quality_rules import BASE_FAILED
from panelyard.llm.resampling import BUCKETS, LEAST_WORDS, PERCENT, SEED
from panelyard.llm.url_filter import BLOCKED, LOWER, RULES, UPPER

WORDS = r"'[^\x20\x09-\x0D]+'"


def mix_sources() -> str:
    draw = lambda k: f"((h1 + {k} * h2) % 4503599627370496) / 4503599627370496.0"
    copies = lambda k: f"CAST(floor(rate) AS BIGINT) + CASE WHEN {draw(k)} < rate - floor(rate) THEN 1 ELSE 0 END"
    misses = ", ".join(f"abs(sum(size * ({copies(k)})) - any_value(target))" for k in range(SEEDS))
    return f"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORDS})), 0) AS size, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY 1),
weighed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM totals),
w AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM weighed),
fill AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
           sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unfilled FROM w WINDOW o AS (ORDER BY source_size / weight, pos)),
free AS (SELECT *, remaining * weight <= 3 * source_size * unfilled AS is_free FROM fill),
lvl AS (SELECT arg_max(remaining, remaining / unfilled) AS num, arg_max(unfilled, remaining / unfilled) AS den FROM free WHERE is_free),
targets AS (SELECT source, source_size, CASE WHEN is_free THEN CAST(weight * num AS DOUBLE) / den ELSE CAST(3 * source_size AS DOUBLE) END AS target FROM free LEFT JOIN lvl ON true),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
drawn AS (SELECT s.*, r.source_size, r.target, r.rate, ('0x' || substr(md5(key), 1, 13))::BIGINT AS h1, ('0x' || substr(md5(key), 14, 13))::BIGINT AS h2 FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
seeds AS (SELECT source, list_position(m, list_min(m)) - 1 AS seed FROM (SELECT source, [{misses}] AS m FROM drawn GROUP BY source))
SELECT doc_id, size, source_size, target, size * ({copies("seed")}) AS taken FROM drawn d JOIN seeds s ON d.source IS NOT DISTINCT FROM s.source"""


def url_filter() -> str:
    fits = " UNION ALL ".join(
        f"SELECT page_id, '{rule}' AS rule, '{verdict}' AS verdict, {len(rule)} AS n FROM u WHERE (host = '{rule.split('/', 1)[0]}' OR ends_with(host, '.{rule.split('/', 1)[0]}')) AND starts_with(path, '/{rule.split('/', 1)[1]}')"
        for verdict, rule in RULES
    )
    globs = " OR ".join(f"contains(host || path, '{g.strip('*')}')" for g in BLOCKED)
    pattern = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
    return f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, {pattern}, 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, {pattern}, 2), '') AS path FROM pages),
fits AS ({fits}), best AS (SELECT page_id, arg_max(rule, n) AS rule, arg_max(verdict, n) AS verdict FROM fits GROUP BY 1)
SELECT u.page_id, host, path, b.rule, coalesce(b.verdict, CASE WHEN {globs} THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN best b ON u.page_id = b.page_id"""


def near_duplicates() -> str:
    """Shingles as text, and every pair that shares one: a plain join, for whole tables of moderate size."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) AS w FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(list_transform(s, lambda x: hash(x))) AS x FROM sh),
classes AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(s), '|'))) AS rep FROM (SELECT doc_id, len(s) AS n, s FROM sh) WHERE n > 0),
reps AS (SELECT one.* FROM one JOIN (SELECT DISTINCT rep FROM classes) c ON one.doc_id = c.rep),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM reps a JOIN reps b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= 75 * (na + nb - i) UNION ALL SELECT b, a FROM pairs WHERE 100 * i >= 75 * (na + nb - i)),
reach(v, c) AS (SELECT DISTINCT rep, rep FROM classes UNION SELECT links.b, reach.c FROM reach JOIN links ON reach.v = links.a WHERE reach.c < links.b),
comp AS (SELECT v, min(c) AS c FROM reach GROUP BY 1)
SELECT sh.doc_id, CAST(len(sh.s) AS BIGINT) AS n_shingles, coalesce(comp.c, sh.doc_id) AS component_id, coalesce(comp.c, sh.doc_id) = sh.doc_id AS kept
FROM sh LEFT JOIN classes ON sh.doc_id = classes.doc_id LEFT JOIN comp ON comp.v = classes.rep"""


def quality_rules() -> str:
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM t WHERE len(w) >= 8),
hashed AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM windows),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM hashed) WHERE c > 1),
gaps AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS g FROM twice),
covered AS (SELECT doc_id, sum(g) AS n FROM gaps GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t),
dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, {WORDS}) GROUP BY 1),
base AS (SELECT t.doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM t LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, {BASE_FAILED} AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 2 * n_symbols > n_words OR (n_dup_lines >= 3 AND 3 * n_dup_lines > len(string_split(text, chr(10)))) OR word_chars > 20 * n_words OR word_chars < 2 * n_words
       OR 2 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > word_chars OR 4 * len(regexp_extract_all(text, '!!')) > n_words OR 3 * len(regexp_replace(text, '[^0-9]', '', 'g')) > word_chars) AS kept
FROM judged"""


def resampling() -> str:
    """The CRC-32 of a word is a fold over its bytes, eight steps each, made once for each distinct word."""
    words = lambda table: f"SELECT *, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"
    return f"""
WITH d AS ({words("documents")}), b AS ({words("benchmark")}),
dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY 1, 2),
bw AS (SELECT unnest(w) AS word FROM b),
bytes AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM dw UNION SELECT word FROM bw)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
  lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % {BUCKETS} AS bucket FROM bytes),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN hashed USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY 1),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
gains AS (SELECT word, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (ss + {BUCKETS}) / ((coalesce(s, 0) + 1.0::DOUBLE) * (tt + {BUCKETS}))))::BIGINT AS gain FROM hashed LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums),
sized AS (SELECT doc_id, sum(n * gain) AS weight FROM dw JOIN gains USING (word) GROUP BY 1),
scored AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN sized USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= n * {PERCENT} // 100 THEN r END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)"""


def main_texts() -> str:
    """What stands in a page's first ``article``: the pages here mark their main text so, which the labeller isn't told."""
    references = "html"
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        references = f"regexp_replace({references}, '&{name};?', '{sign}', 'g')"
    return f"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(</article>|$)', 1) AS html FROM pages),
parts AS (SELECT page_id, url, string_split_regex(regexp_replace(regexp_replace(html, '</?b>', '', 'g'), '<br[^>]*>', ' ', 'g'), '<[^>]*>') AS p FROM a),
plain AS (SELECT page_id, url, list_filter(list_transform(p, lambda html: trim(regexp_replace({references}, '\\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM parts)
SELECT page_id, url, array_to_string(p, chr(10)) AS text, CAST(length(array_to_string(p, chr(10))) AS BIGINT) AS n_chars FROM plain"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": mix_sources(), "op3_url_filter": url_filter(), "op4_near_duplicates": near_duplicates(), "op8_quality_rules": quality_rules(), "op12_importance_resampling": resampling(), "op13_html_extraction": main_texts()}
